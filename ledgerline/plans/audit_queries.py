"""Queries over events, checks and reviews: audit, consensus, reports, streams, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, evaluation
from ..session import load
from ..status import worst
from ..storage import stored
from ..streaming import events as streams
from . import shipment_queries as S
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_status(spark, sf_dir):
    return audit.latest(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events""")
def revisions(spark, sf_dir):
    return audit.revisions(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("version").cast("long").alias("version"))


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events), h AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT event_id FROM r LEFT JOIN h USING (user_id) WHERE v > coalesce(n, 0)""")
def unseen_events(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return audit.unseen(rows, rows.where("event_id % 3 = 0"), "user_id", ["ts", "event_id"]).select("event_id")


@query(f"""
WITH {S.CHECKS}, a AS (SELECT shipment_id, check_id, CASE WHEN shipment_id % 11 = 0 AND status = 'passed' THEN 'failed' ELSE status END AS status FROM checks WHERE NOT (shipment_id % 7 = 0 AND check_id LIKE '%form_e')),
j AS (SELECT c.shipment_id, c.status, a.status AS audited FROM checks c LEFT JOIN a USING (shipment_id, check_id)), g AS (SELECT shipment_id, count(*) FILTER (WHERE audited IS NULL) AS omitted, count(*) FILTER (WHERE audited <> status) AS differing, bool_or(status <> 'passed') AS o FROM j GROUP BY 1)
SELECT shipment_id, omitted, differing, CASE WHEN differing > 0 THEN 'disagreed' WHEN omitted > 0 THEN 'unresolved' ELSE 'agreed' END AS outcome, differing > 0 OR omitted > 0 OR o AS needs_review FROM g""")
def consensus(spark, sf_dir):
    checks = stored(S._checks(spark, sf_dir).select("shipment_id", "check_id", "status"))  # both lists are read off it
    k = F.col("shipment_id")
    audited = checks.where(~((k % 7 == 0) & F.col("check_id").like("%form_e"))).withColumn("status", F.when((k % 11 == 0) & (F.col("status") == "passed"), "failed").otherwise(F.col("status")))
    return audit.consensus(checks, audited)


@query(f"WITH {S.CHECKS} SELECT shipment_id, check_id, status FROM checks WHERE status IN ('failed', 'manual_review') AND NOT (shipment_id % 2 = 0 AND status = 'failed')")
def omissions(spark, sf_dir):
    checks = S._checks(spark, sf_dir)
    return audit.omissions(checks, checks.where("shipment_id % 2 = 0 and status = 'failed'"))


@query(f"""
WITH {S.CHECKS}, u AS (SELECT shipment_id, check_id, status, 1 AS o FROM checks UNION ALL SELECT shipment_id, check_id, 'failed', 2 FROM checks), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY shipment_id, check_id ORDER BY o) = 1)
SELECT shipment_id, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'manual_review') AS manual_review, count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable FROM f GROUP BY 1""")
def summary_counts(spark, sf_dir):
    # each check and then a failed one of its id, from one evaluation
    twice = F.array(F.struct("status", F.lit(1).alias("ordinal")), F.struct(F.lit("failed").alias("status"), F.lit(2).alias("ordinal")))
    return audit.summary_counts(S._checks(spark, sf_dir).select("shipment_id", "check_id", F.inline(twice)))


@query(f"""
WITH {S.CHECKS}
SELECT shipment_id, CASE WHEN check_id LIKE 'xr\\_common%' ESCAPE '\\' THEN 'missing_documents' ELSE 'legal' END AS bucket, string_agg(DISTINCT check_id, ',' ORDER BY check_id) AS checks
FROM checks WHERE status IN ('failed', 'manual_review') GROUP BY 1, 2""")
def problem_buckets(spark, sf_dir):
    return audit.problems(S._checks(spark, sf_dir))


@query(f"""
WITH {S.CHECKS}, r AS (SELECT *, CASE status WHEN 'failed' THEN 3 WHEN 'manual_review' THEN 2 WHEN 'passed' THEN 1 ELSE 0 END AS rank FROM checks),
s AS (SELECT *, coalesce(required_document, check_id) AS finding, rank * 100 + CASE WHEN check_id LIKE '%china%' THEN 30 ELSE 0 END + CASE WHEN check_id LIKE '%coo%' THEN 5 ELSE 0 END - CASE WHEN check_id LIKE '%other%' THEN 20 ELSE 0 END AS sp FROM r)
SELECT shipment_id, finding, max({{'sp': sp, 'id': check_id}}).id AS check_id, max(rank) AS rank, count(*) AS sources FROM s GROUP BY 1, 2""")
def consolidated_findings(spark, sf_dir):
    return audit.findings(S._checks(spark, sf_dir))


@query(f"WITH {S.CHECKS} SELECT c.* EXCLUDE (reasons) FROM checks c WHERE status IN ('failed', 'manual_review') AND (required_document IS NULL OR required_document IN ('commercial_invoice', 'packing_list'))")
def raw_findings(spark, sf_dir):
    """Open findings that are not on the list of outstanding documents."""
    from ..operators import rules

    checks = S._checks(spark, sf_dir)
    listed = rules.outstanding(checks).select("shipment_id", F.col("document").alias("required_document"))
    open_ = checks.where(F.col("status").isin("failed", "manual_review")).drop("reasons")
    return open_.join(listed, ["shipment_id", "required_document"], "left_anti")


@query("""
WITH e AS (SELECT user_id AS shipment_id, event_type AS check_id, CASE WHEN event_id % 5 = 0 THEN 'not_found' WHEN event_id % 5 = 1 AND user_id % 4 = 0 THEN 'conflicting' ELSE 'supported' END AS s, event_id % 3 <> 0 AS v FROM events),
g AS (SELECT shipment_id, check_id, count(*) AS n, count(*) FILTER (WHERE s = 'supported') AS y, count(*) FILTER (WHERE s = 'conflicting') AS c, count(*) FILTER (WHERE s = 'not_found') AS f, bool_and(v) AS v FROM e GROUP BY ALL)
SELECT shipment_id, check_id, CASE WHEN c > 0 THEN 'conflicting' WHEN f = n THEN 'not_found' WHEN y = n THEN 'supported' WHEN y > 0 THEN 'partially_supported' ELSE 'not_applicable' END AS support, CASE WHEN f = n THEN 'unavailable' WHEN c > 0 THEN 'conflicting' WHEN v THEN 'verified' ELSE 'partial' END AS grade FROM g""")
def evidence_grades(spark, sf_dir):
    k = F.col("event_id") % 5
    rows = load(spark, sf_dir, "events")
    return audit.evidence_grade(rows.select(F.col("user_id").alias("shipment_id"), F.col("event_type").alias("check_id"), F.when(k == 0, "not_found").when((k == 1) & (F.col("user_id") % 4 == 0), "conflicting").otherwise("supported").alias("support"), (F.col("event_id") % 3 != 0).alias("verified")))


@query("""SELECT user_id AS shipment_id, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 4) AS confidence FROM events GROUP BY 1""")
def broker_confidence(spark, sf_dir):
    return audit.broker_confidence(load(spark, sf_dir, "events").select(F.col("user_id").alias("shipment_id"), (F.col("value") > 50).alias("verified")))


@query("""
WITH m AS (SELECT doc_id AS row_id, text FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0), s(family, pattern) AS (VALUES ('shape', 'that'), ('shape', 'the '), ('size', 'er'))
SELECT family, row_id, pattern, row_number() OVER (PARTITION BY family ORDER BY row_id, pattern) AS number FROM m JOIN s ON contains(text, pattern)""")
def defect_register(spark, sf_dir):
    k = F.col("doc_id")
    rows = load(spark, sf_dir, "documents").select(k.alias("row_id"), F.col("text").alias("message"), F.when(k % 2 == 0, "failed").otherwise("passed").alias("status"), (k % 5 == 0).alias("blocked"))
    signatures = spark.createDataFrame([("shape", "that"), ("shape", "the "), ("size", "er")], "family string, pattern string")
    return audit.defects(rows, signatures).select("family", "row_id", "pattern", F.col("number").cast("long").alias("number"))


@query("""
SELECT conv_id, max(turn) AS turn, arg_max(text, {'n': turn, 't': text}) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1""")
def last_answers(spark, sf_dir):
    """The last assistant message of each conversation, from which it goes on."""
    said = load(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    return audit.latest(said, "conv_id", ["turn", "text"]).select("conv_id", "turn", "text")


@query("""SELECT event_type AS kind, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, count(*) FILTER (WHERE value > 90) AS over_budget FROM events GROUP BY 1""")
def durations(spark, sf_dir):
    return evaluation.durations(load(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("seconds"), F.lit(90).alias("budget")))


@query("""SELECT o_orderkey AS run_id, greatest(o_orderkey % 100 - 60, 0) AS shortfall FROM orders""")
def quota_shortfall(spark, sf_dir):
    return evaluation.shortfall(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 100).alias("estimate"), F.lit(60).cast("long").alias("headroom")))


@query(f"""
WITH {S.CHECKS}, v AS (SELECT shipment_id, max(CASE status WHEN 'failed' THEN 2 WHEN 'manual_review' THEN 1 ELSE 0 END) AS s FROM checks GROUP BY 1), t AS (SELECT shipment_id, s AS truth, CASE WHEN shipment_id % 10 = 0 THEN 0 ELSE s END AS said FROM v)
SELECT count(*) AS total, count(*) FILTER (WHERE truth = said) AS agreed, count(*) FILTER (WHERE said = 0 AND truth <> 0) AS false_passes FROM t""")
def false_passes(spark, sf_dir):
    truth = S._checks(spark, sf_dir).groupBy("shipment_id").agg(worst(F.col("status")).alias("status"))
    said = truth.withColumn("status", F.when(F.col("shipment_id") % 10 == 0, "passed").otherwise(F.col("status")))
    return evaluation.false_passes(said, truth, ["shipment_id"])


@query("""SELECT p_type AS category, count(*) AS products, string_agg(p_partkey, ',' ORDER BY p_partkey) AS codes FROM part GROUP BY 1""")
def family_counts(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("products"), F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("codes"))


@query("""
WITH c AS (SELECT p_brand || '-' || p_size AS question, p_partkey AS candidate FROM part), d AS (SELECT candidate, n AS document FROM c, unnest([2, 3, 5, 7]) t(n) WHERE candidate % n <> 0), k AS (SELECT question, count(*) AS n FROM c GROUP BY 1)
SELECT question, document FROM c JOIN d USING (candidate) JOIN k USING (question) GROUP BY question, document, n HAVING count(*) = n""")
def shared_requirements(spark, sf_dir):
    """Documents that every candidate product of an ambiguous question requires."""
    candidates = load(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("question"), F.col("p_partkey").alias("candidate"))
    needed = candidates.select("question", "candidate", F.explode(F.array(*map(F.lit, (2, 3, 5, 7)))).alias("document")).where("candidate % document <> 0")
    number = candidates.groupBy("question").agg(F.count("*").alias("_n"))
    return needed.groupBy("question", "document").agg(F.count("*").alias("_k")).join(number, "question").where("_k = _n").select("question", "document")


@query("""SELECT source, lang, count(*) AS uses FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def passage_uses(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("uses")).where("uses > 1")


@query("""
WITH r AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Z][a-z]+'), lambda x: length(x) > 3) AS n FROM benchmark)
SELECT item_id, CASE WHEN len(n) = 0 THEN 'unavailable' WHEN len(n) > 3 THEN 'direct' WHEN item_id % 2 = 0 THEN 'conflicting' WHEN item_id % 3 = 0 THEN 'rule_only' ELSE 'indirect' END AS evidence FROM r""")
def evidence_classes(spark, sf_dir):
    n = F.size(F.filter(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1), lambda x: F.length(x) > 3))
    k = F.col("item_id")
    return load(spark, sf_dir, "benchmark").select("item_id", F.when(n == 0, "unavailable").when(n > 3, "direct").when(k % 2 == 0, "conflicting").when(k % 3 == 0, "rule_only").otherwise("indirect").alias("evidence"))


@query("""SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, count(*) AS events FROM events GROUP BY 1""")
def streamed_status(spark, sf_dir):
    """The stateful projection, run over the events as a stream of files."""
    return streams.run_to_end(streams.latest_status(streams.read_events(spark, sf_dir)), "complete")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_windows(spark, sf_dir):
    """A windowed count over the stream: an extension, with a watermark."""
    return streams.run_to_end(streams.windowed_counts(streams.read_events(spark, sf_dir)), "complete").select("start", "event_type", "n")


@query("""WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS rounds FROM events GROUP BY 1) SELECT user_id, rounds, CASE WHEN rounds >= 2 THEN 'finalised' ELSE 'open' END AS state FROM e""")
def streamed_reviews(spark, sf_dir):
    """Review rounds kept in state per workflow; the batch's rows are the last state."""
    return streams.run_to_end(streams.review_rounds(streams.read_events(spark, sf_dir)), "update", "user_id")
