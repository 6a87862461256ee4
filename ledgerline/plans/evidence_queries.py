"""Queries over evidence, reviews, reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import audit, evaluation, lexical_index, reconcile, retrieval, rules
from ..session import load
from ..storage import table_signature
from . import retrieval_queries as R
from . import shipment_queries as S
from . import views
from .assistant_queries import asked, held, listed, lit
from .registry import registry

QUERIES, ORACLES, query = registry()

at = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
none = lambda kind="string": F.lit(None).cast(kind)
PATHS = ("invoice.line_items[2].quantity", "invoice.destination_country", "packing_list.items[1].net_weight", "invoice.line_items[1].pct_code", "invoice.invoice_total", "invoice.nonsense", "packing_list.declared_net_weight_total")


@query(f"""
WITH {S.CHECKS}, ch AS (SELECT shipment_id, ({listed(PATHS)})[shipment_id % {len(PATHS)} + 1] AS path FROM ships WHERE shipment_id % 3 = 0), d(path, direct, family) AS (VALUES
  ('invoice.line_items[2].quantity', ['positive_quantity', 'item_quantity_match', 'item_line_calculation', 'invoice_line_calculation', 'sum_line_totals_match_invoice_total'], false), ('invoice.destination_country', CAST([] AS VARCHAR[]), true),
  ('packing_list.items[1].net_weight', ['item_net_weight_match', 'packing_net_weight_total', 'weight_consistency'], false), ('invoice.line_items[1].pct_code', ['item_pct_code_match', 'mvp_pct_support'], true),
  ('invoice.invoice_total', ['sum_line_totals_match_invoice_total'], false), ('packing_list.declared_net_weight_total', ['packing_net_weight_total'], false)), k AS (SELECT * FROM ch JOIN d USING (path))
SELECT shipment_id, path, unnest(direct) AS check_id FROM k UNION SELECT shipment_id, path, check_id FROM k JOIN checks USING (shipment_id) WHERE family AND check_id LIKE 'xr\\_%' ESCAPE '\\'""")
def affected_checks(spark, sf_dir):
    checks = S._checks(spark, sf_dir)
    changes = views.shipments(spark, sf_dir).where("shipment_id % 3 = 0").select("shipment_id", at(PATHS, F.col("shipment_id")).alias("path"))
    return audit.affected_checks(changes, checks, spark)


@query(f"""
WITH {S.PACKING}, f AS (SELECT shipment_id, 'invoice' AS document, item_index, unnest(['quantity', 'unit_price', 'line_total']) AS field, unnest([units, price_cents, cents]) AS value FROM invoice UNION ALL SELECT shipment_id, 'packing_list', item_index, 'quantity', units FROM packing),
m(check_id, document, field) AS (VALUES ('item_quantity_match', 'invoice', 'quantity'), ('item_quantity_match', 'packing_list', 'quantity'), ('item_line_calculation', 'invoice', 'quantity'), ('item_line_calculation', 'invoice', 'unit_price'), ('item_line_calculation', 'invoice', 'line_total'))
SELECT shipment_id, check_id, item_index, document, field, CAST(value AS VARCHAR) AS value, CAST(item_index % 4 + 1 AS INTEGER) AS page FROM m JOIN f USING (document, field)
UNION ALL SELECT shipment_id, 'other_check', NULL, 'invoice', NULL, NULL, CAST(item_index % 3 AS INTEGER) FROM invoice WHERE item_index % 3 <> 0 UNION ALL SELECT shipment_id, 'other_check', NULL, 'packing_list', NULL, NULL, 2 FROM invoice WHERE item_index % 2 = 0
UNION ALL SELECT o_orderkey, 'invoice_total_consistency', NULL, 'invoice', 'invoice_total', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 1 FROM orders""")
def evidence_lookup(spark, sf_dir):
    """Three checks of each invoice item and one of each invoice; one of them is mapped to no field."""
    invoice, packing = S._items(spark, sf_dir)
    i = F.col("item_index")
    whole = lambda c, by=1: (F.col(c) * by).cast("long").cast("string")
    field = lambda n, v: F.struct(F.lit(n).alias("field"), v.alias("value"))
    fields = invoice.select("shipment_id", F.lit("invoice").alias("document"), "item_index", F.inline(F.array(field("quantity", whole("quantity")), field("unit_price", whole("unit_price", 100)), field("line_total", whole("line_total", 100)))))
    fields = fields.unionByName(packing.select("shipment_id", F.lit("packing_list").alias("document"), "item_index", F.lit("quantity").alias("field"), whole("quantity").alias("value"))).withColumn("page", (i % 4 + 1).cast("int"))
    orders = load(spark, sf_dir, "orders")
    total = orders.select(F.col("o_orderkey").alias("shipment_id"), F.lit("invoice").alias("document"), none("int").alias("item_index"), F.lit("invoice_total").alias("field"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"), F.lit(1).alias("page"))
    checks = invoice.select("shipment_id", F.explode(F.array(*map(F.lit, ("item_quantity_match", "item_line_calculation", "other_check")))).alias("check_id"), i.alias("invoice_index"), i.alias("packing_index"), F.when(i % 3 != 0, i % 3).cast("int").alias("invoice_page"), F.when(i % 2 == 0, 2).alias("packing_page"))
    header = orders.select(F.col("o_orderkey").alias("shipment_id"), F.lit("invoice_total_consistency").alias("check_id"))
    return audit.document_evidence(checks.unionByName(header, allowMissingColumns=True), fields.unionByName(total), spark)


@query("""
WITH o AS (SELECT user_id AS query_id, event_type AS source, event_id % 3 AS page, min(event_id) AS ordinal, arg_min(props, event_id) AS snippet FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) AS place FROM o)
SELECT query_id, source, page, place, place <= 2 AS display_primary, snippet FROM p""")
def citation_list(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source"), (F.col("event_id") % 3).alias("page"), F.col("event_id").alias("ordinal"), F.col("props").alias("snippet"))
    return audit.citations(rows).select("query_id", "source", "page", F.col("place").cast("long").alias("place"), "display_primary", "snippet")


@query(f"""
WITH {S.INVOICE}, {S.CHECKS.lstrip()}
SELECT shipment_id, item_index, 'weight_consistency' AS check_id, CASE WHEN net IS NULL OR gross IS NULL THEN 'not_applicable' WHEN gross >= net THEN 'passed' ELSE 'failed' END AS status, NULL AS required_document FROM invoice
UNION ALL SELECT shipment_id, NULL, check_id, status, required_document FROM checks""")
def combined_checks(spark, sf_dir):
    lines = reconcile.line_checks(views.invoice_items(spark, sf_dir)).select("shipment_id", "item_index", F.lit("weight_consistency").alias("check_id"), F.col("weight_consistency").alias("status"))
    return audit.all_checks(lines, S._checks(spark, sf_dir).drop("reasons")).select("shipment_id", "item_index", "check_id", "status", "required_document")


@query(f"""
WITH {S.CHECKS}, o AS (SELECT shipment_id, check_id, required_document, 'see ' || check_id AS message, CASE WHEN status = 'failed' THEN CASE WHEN required_document IS NOT NULL THEN 'missing_documents' ELSE 'regulatory_problems' END
  WHEN shipment_id % 2 = 0 THEN 'evidence_limitations' ELSE 'missing_or_uncertain_fields' END AS bucket FROM checks WHERE status IN ('failed', 'manual_review')), f AS (
  SELECT shipment_id, bucket, min({{'c': check_id, 'm': message}}) AS m FROM o GROUP BY shipment_id, bucket, CASE WHEN bucket = 'missing_documents' THEN required_document ELSE message END)
SELECT shipment_id, bucket, string_agg(m.m, '|' ORDER BY m.c, m.m) AS messages FROM f GROUP BY 1, 2""")
def problem_messages(spark, sf_dir):
    checks = S._checks(spark, sf_dir).select("shipment_id", "check_id", "status", F.concat(F.lit("see "), "check_id").alias("message"), "required_document", F.lit(True).alias("is_rule"), F.when(F.col("shipment_id") % 2 == 0, "partially_verified").otherwise("pending").alias("validation_status"))
    return audit.categorised(checks)


STATUSES, SUPPORT, ACTIONS = ("passed", "failed", "manual_review"), ("supported", "not_found", "conflicting", "partially_supported"), ("continue", "human_review", "evidence_missing", "rerun_extraction", "technical_failure", "continue")


@query(f"""
WITH r AS (SELECT o_orderkey AS k, ({listed(STATUSES)})[o_orderkey % 3 + 1] AS s, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS same, ({listed(SUPPORT)})[o_orderkey % 4 + 1] AS sup, ({listed(ACTIONS)})[o_orderkey % 6 + 1] AS act FROM orders),
t AS (SELECT *, list_filter([CASE WHEN same THEN 'deterministic_status' END, CASE WHEN k % 13 <> 0 THEN 'compliance_status_confirmed' END, CASE WHEN k % 5 <> 0 THEN 'detected_discrepancies' END, CASE WHEN k % 17 <> 0 THEN 'arithmetic_and_weights' END, CASE WHEN k % 19 <> 0 AND k % 2 = 0 THEN 'supporting_documents' END, CASE WHEN sup = 'supported' THEN 'evidence_availability' END], lambda x: x IS NOT NULL) AS agreed,
  list_filter([CASE WHEN NOT same THEN 'deterministic_status' END, CASE WHEN k % 13 = 0 THEN 'compliance_status_confirmed' END, CASE WHEN k % 5 = 0 THEN 'detected_discrepancies' END, CASE WHEN k % 17 = 0 THEN 'arithmetic_and_weights' END, CASE WHEN k % 19 = 0 THEN 'supporting_documents' END], lambda x: x IS NOT NULL) AS disagreed,
  list_filter([CASE WHEN k % 5 = 0 THEN 'omitted ' || k END, CASE WHEN k % 17 = 0 THEN 'sum' END, CASE WHEN k % 19 = 0 THEN 'form_e' END, CASE WHEN sup <> 'supported' THEN 'evidence_' || sup END, CASE WHEN k % 23 = 0 THEN 'no page' END, CASE WHEN k % 29 = 0 THEN 'unit conflict' END, CASE WHEN k % 31 = 0 THEN 'note' END, CASE WHEN k % 37 = 0 THEN 'unsupported_product_present' END], lambda x: x IS NOT NULL) AS open FROM r),
c AS (SELECT *, list_filter([CASE WHEN len(disagreed) > 0 THEN 'agent_disagreement' END, CASE WHEN k % 37 = 0 THEN 'unsupported_product' END, CASE WHEN act <> 'continue' THEN 'auditor_' || act END, CASE WHEN k % 29 = 0 THEN 'unit conflict' END], lambda x: x IS NOT NULL) AS critical, s = 'manual_review' OR sup <> 'supported' OR k % 23 = 0 AS unsure FROM t)
SELECT k AS shipment_id, array_to_string(agreed, ',') AS agreed, array_to_string(disagreed, ',') AS disagreed, array_to_string(open, ',') AS open, len(disagreed) = 0 AS consensus, len(critical) > 0 OR unsure AS needs_review,
  CASE WHEN len(critical) > 0 THEN 'critical anomaly requires human review: ' || array_to_string(critical, ', ') WHEN s = 'manual_review' THEN 'uncertainty requires human confirmation' WHEN unsure THEN 'unresolved issues: ' || array_to_string(open[1:5], '; ') ELSE 'reviewers agree; the result is clear' END AS reason FROM c""")
def review_agreement(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n, *xs: F.array_compact(F.array(*[F.when(k % m == 0, x) for m, x in zip(n, xs)]))
    engine = at(STATUSES, k)
    rows = load(spark, sf_dir, "orders").select(
        k.alias("shipment_id"), engine.alias("engine_status"), F.when(k % 7 == 0, "other").otherwise(engine).alias("first_status"), F.when(k % 11 == 0, "other").otherwise(engine).alias("second_status"), (k % 13 != 0).alias("confirmed"),
        some((5,), F.concat(F.lit("omitted "), k.cast("string"))).alias("omissions"), some((17,), F.lit("sum")).alias("arithmetic"), some((19,), F.lit("form_e")).alias("challenged"), some((2,), F.lit("coo")).alias("verified"), at(SUPPORT, k).alias("support"),
        some((23,), F.lit("no page")).alias("missing_provenance"), some((29, 31), F.lit("unit conflict"), F.lit("note")).alias("anomalies"), (k % 37 == 0).alias("unsupported"), at(ACTIONS, k).alias("action"),
    )
    return audit.agreement(rows)


GATED = ("what is the weight on the invoice", "show the packing list", "who is it for", "certificate of origin er", "is the form e that", "")
TYPES, SECTIONS = ("commercial_invoice", "packing_list", "form_e", "certificate_of_origin"), ("general_content", "header", "totals")


@query(f"""
WITH g AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, ({listed(GATED)})[(conv_id + turn) % {len(GATED)} + 1] AS q, ({listed(TYPES)})[conv_id % 4 + 1] AS type, ({listed(SECTIONS)})[turn % 3 + 1] AS section FROM conversations),
w AS (SELECT *, list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda x: NOT list_contains({listed(retrieval.STOPWORDS)}, x)) AS qw, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains({listed(retrieval.STOPWORDS)}, x)) AS tw FROM g)
SELECT conv_id, turn, role, CASE WHEN len(qw) > 0 AND NOT list_has_any(qw, tw) THEN 'shipment_evidence_unavailable' WHEN contains(q, 'invoice') AND type <> 'commercial_invoice' OR contains(q, 'packing list') AND type <> 'packing_list' OR contains(q, 'form e') AND type <> 'form_e' OR contains(q, 'certificate of origin') AND type <> 'certificate_of_origin' THEN 'shipment_evidence_conflicting'
  WHEN contains(q, 'weight') AND section <> 'general_content' THEN 'shipment_evidence_partial' ELSE 'shipment_evidence_verified' END AS gate FROM w""")
def shipment_evidence_gate(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", retrieval.shipment_gate(at(GATED, F.col("conv_id") + F.col("turn")), at(TYPES, F.col("conv_id")), at(SECTIONS, F.col("turn")), F.col("text")).alias("gate"))


@query(f"""
WITH {R.FUSED}, f10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS k FROM fused QUALIFY k <= 10),
qw AS (SELECT query_id, list_distinct({R.sql_tokens('text')}) AS qw FROM items), dw AS (SELECT doc_id, list_distinct({R.sql_tokens('text')}) AS dw FROM docs),
s AS (SELECT f10.query_id, f10.doc_id, rrf, round(len(list_intersect(qw, dw)) / len(qw) + 0.5 * len(list_filter(list_intersect(qw, dw), lambda w: regexp_matches(w, '^(pct|sro)[0-9]'))), 6) AS rerank FROM f10 JOIN qw USING (query_id) JOIN dw USING (doc_id))
SELECT query_id, doc_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, rrf DESC, doc_id) AS position FROM s QUALIFY position <= 5""")
def shipment_passages(spark, sf_dir):
    return retrieval.shipment_top(R._fused(spark, sf_dir), R._docs(spark, sf_dir), R._queries(spark, sf_dir)).select("query_id", "doc_id", "rerank", F.col("position").cast("long").alias("position"))


@query("""SELECT user_id AS query_id, event_id AS rank, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) % 2, event_id) AS shown FROM events""")
def official_order(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("rank"), (F.length("event_type") % 2 == 0).alias("is_official"))
    return retrieval.official_first(rows).select("query_id", "rank", F.col("shown").cast("long").alias("shown"))


@query("""
WITH c AS (SELECT label AS query_id, vec_id AS doc_id, CAST(vec_id % 3 AS BIGINT) AS page, CASE WHEN vec_id % 4 = 0 THEN 'SRO ' || (vec_id % 8) || '(I)/2025' END AS notice FROM embeddings), n AS (SELECT DISTINCT label AS query_id FROM embeddings WHERE vec_id % 8 = 0 AND vec_id % 5 <> 0)
SELECT query_id, doc_id, page, notice, CASE WHEN doc_id % 5 = 0 THEN 'document' WHEN doc_id % 8 = 4 OR doc_id % 8 = 0 AND n.query_id IS NULL THEN 'notice' WHEN doc_id % 2 = 0 THEN 'page' END AS reason FROM c LEFT JOIN n USING (query_id)""")
def citation_validation(spark, sf_dir):
    k = F.col("vec_id")
    notice = F.concat(F.lit("SRO "), (k % 8).cast("string"), F.lit("(I)/2025"))
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), k.alias("doc_id"), (k % 3).alias("page"), F.when(k % 4 == 0, notice).alias("notice"))
    found = rows.where("doc_id % 5 <> 0").withColumn("page", F.when(F.col("doc_id") % 2 == 0, 9).otherwise(F.col("page"))).withColumn("notice", F.when(F.col("doc_id") % 8 == 0, F.col("notice")))
    return retrieval.valid_citations(rows, found)


WANTED = ("form_e", "certificate_of_origin", "phytosanitary_certificate", "sbp_deposit_proof", "irrevocable_letter_of_credit", "import_permit")
SAID = ("", "a letter of credit", "the certificate of origin is not required", "see form-e", "phytosanitary measures; deposit", "the import permit and the form e are exempt", "certificate of origin and import permit")


@query(f"""
WITH p AS (SELECT doc_id // 4 AS case_id, ({listed(WANTED)})[(doc_id // 4) % 6 + 1] AS document, doc_id, lower({asked('text', 'doc_id', SAID)}) AS t FROM documents), d AS (SELECT *, CASE document {' '.join(f"WHEN {lit(d)} THEN {held('t', ts)}" for d, ts in retrieval.DOCUMENT_TERMS.items())} ELSE contains(t, replace(document, '_', ' ')) END AS direct,
  regexp_matches(t, {lit(retrieval.NOT_NEEDED)}) AS no FROM p), g AS (SELECT case_id, document, min({{'f': NOT direct, 'i': doc_id}}).i AS passage_id, bool_or(direct) AS direct, bool_or(direct AND no) AS no, bool_or(direct AND NOT no) AS yes FROM d GROUP BY 1, 2)
SELECT case_id, document, CASE WHEN no AND yes THEN 'conflicting_evidence' WHEN direct THEN 'direct_evidence' ELSE 'indirect_support' END AS evidence_class, passage_id FROM g
UNION ALL SELECT case_id, 'product_licence', CASE WHEN case_id % 2 = 0 THEN 'configured_rule_only' ELSE 'evidence_unavailable' END, NULL FROM g""")
def requirement_evidence(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    case = F.floor(F.col("doc_id") / 4)
    passages = docs.select(case.alias("case_id"), at(WANTED, case).alias("document"), F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("rank"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), at(SAID, F.col("doc_id"))).alias("text"))
    wanted = passages.select("case_id", "document", F.lit(True).alias("has_source")).distinct()
    more = wanted.select("case_id", F.lit("product_licence").alias("document"), (F.col("case_id") % 2 == 0).alias("has_source"))
    return retrieval.evidence_classes(wanted.unionByName(more), passages)


@query("""
WITH e AS (SELECT user_id AS check_id, CASE WHEN user_id % 2 = 0 THEN 'manual_review' ELSE 'failed' END AS original_status, event_id % 5 <> 0 AND user_id % 9 <> 0 AS there, CASE WHEN user_id % 6 = 0 AND event_id % 7 = 0 THEN 'conflicting' WHEN event_id % 3 = 0 AND user_id % 4 = 0 THEN 'verified' ELSE 'partially_verified' END AS v, event_id % 4 <> 0 AND user_id % 5 <> 0 AS grounded FROM events),
g AS (SELECT check_id, original_status, count(*) FILTER (WHERE there) AS n, bool_or(there AND v = 'conflicting') AS c, bool_or(there AND grounded) AS g, bool_or(there AND grounded AND v = 'verified') AS y FROM e GROUP BY 1, 2)
SELECT check_id, original_status, CASE WHEN n = 0 THEN 'evidence_not_found' WHEN c THEN 'conflicting_evidence' WHEN NOT g THEN 'manual_review_required' WHEN original_status = 'manual_review' AND NOT y THEN 'manual_review_required' ELSE 'explained' END AS status FROM g""")
def explanation_statuses(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    status = F.when((u % 6 == 0) & (e % 7 == 0), "conflicting").when((e % 3 == 0) & (u % 4 == 0), "verified").otherwise("partially_verified")
    return retrieval.explanation_status(load(spark, sf_dir, "events").select(u.alias("check_id"), F.when(u % 2 == 0, "manual_review").otherwise("failed").alias("original_status"), F.when((e % 5 != 0) & (u % 9 != 0), e).alias("passage_id"), status.alias("validation_status"), ((e % 4 != 0) & (u % 5 != 0)).alias("grounded")))


@query(f"""
WITH c AS (SELECT n_nationkey * 10 + i AS case_id, ({listed(views.CODES)})[i + 1] AS code, upper(n_name) = 'CHINA' AS china FROM nation, range(5) r(i)), o(code, document, requirement) AS (VALUES ('52010090', 'product_licence', 'conditional'), ('52010090', 'import_permit', 'conditional'), ('52010090', 'phytosanitary_certificate', 'required'), ('52010090', 'sbp_deposit_proof', 'required'),
  ('52010090', 'sbp_confirmation', 'required'), ('52010090', 'irrevocable_letter_of_credit', 'required'), ('61091000', 'product_licence', 'required')), l AS (SELECT case_id, document, requirement FROM c JOIN o USING (code) UNION ALL SELECT case_id, 'form_e', 'required' FROM c UNION ALL SELECT case_id, 'certificate_of_origin', CASE WHEN china THEN 'required' ELSE 'conditional' END FROM c WHERE code <> '52010090'),
p AS (SELECT ({listed(WANTED)})[item_id % 6 + 1] AS document, lower({asked('text', 'item_id', SAID)}) AS t FROM benchmark), d AS (SELECT *, CASE document {' '.join(f"WHEN {lit(d)} THEN {held('t', ts)}" for d, ts in retrieval.DOCUMENT_TERMS.items())} ELSE contains(t, replace(document, '_', ' ')) END AS direct, regexp_matches(t, {lit(retrieval.NOT_NEEDED)}) AS no FROM p),
g AS (SELECT document, bool_or(direct) AS direct, bool_or(direct AND no) AS no, bool_or(direct AND NOT no) AS yes FROM d GROUP BY 1)
SELECT case_id, document, requirement, CASE WHEN direct IS NULL THEN 'configured_rule_only' WHEN no AND yes THEN 'conflicting_evidence' WHEN direct THEN 'direct_evidence' ELSE 'indirect_support' END AS evidence_class FROM l LEFT JOIN g USING (document)
UNION ALL SELECT case_id, unnest(['commercial_invoice', 'packing_list']), 'required', 'configured_rule_only' FROM c""")
def export_guidance(spark, sf_dir):
    """Every product to every nation, before any document is sent."""
    cases = load(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("destination"), F.posexplode(F.array(*map(F.lit, views.CODES))).alias("i", "code"))
    cases = cases.select((F.col("n_nationkey") * 10 + F.col("i")).cast("long").alias("shipment_id"), "code", "destination", none("date").alias("shipment_date"), none("date").alias("letter_of_credit_date"))
    k = F.col("item_id")
    passages = load(spark, sf_dir, "benchmark").select(at(WANTED, k).alias("document"), k.alias("passage_id"), k.alias("rank"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), at(SAID, k)).alias("text"))
    return retrieval.pre_submission(cases, rules.sample_rules(spark), passages, spark.createDataFrame([], "shipment_id long, document string"))


@query("""
WITH f AS (SELECT 'quantity' AS field, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS e, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_partkey % 10 = 0 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS x, l_partkey % 7 = 0 AS r FROM lineitem
  UNION ALL SELECT 'pct_code', lpad(CAST(l_partkey AS VARCHAR), 8, '0'), CASE WHEN l_linenumber = 2 THEN NULL WHEN l_partkey % 5 = 0 THEN '1' ELSE lpad(CAST(l_partkey AS VARCHAR), 8, '0') END, false FROM lineitem), o AS (SELECT field, CASE WHEN r THEN 'manual_review' WHEN x IS NULL THEN 'missing' WHEN e = x THEN 'correct' ELSE 'incorrect' END AS o FROM f),
m AS (SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE 'matched' END AS a FROM lineitem), c AS (SELECT (['passed', 'failed', 'manual_review'])[o_orderkey % 3 + 1] AS es, (['passed', 'failed', 'manual_review', 'passed'])[o_orderkey % 4 + 1] AS s, o_orderkey % 2 = 0 AS me, o_orderkey % 3 = 0 AS md FROM orders)
SELECT (SELECT count(*) FROM o) AS total_fields, (SELECT count(*) FROM o WHERE o = 'correct') AS correct_fields, (SELECT count(*) FROM o WHERE o = 'incorrect') AS incorrect_fields, (SELECT count(*) FROM o WHERE o = 'missing') AS missing_fields, (SELECT count(*) FROM o WHERE o = 'manual_review') AS manual_review_fields,
  (SELECT round(count(*) FILTER (WHERE o = 'correct') / count(*), 4) FROM o) AS field_accuracy, (SELECT round(count(*) FILTER (WHERE o = 'correct') / count(*), 4) FROM o WHERE field = 'pct_code') AS pct_code_accuracy, (SELECT round(count(a) / count(*), 4) FROM m) AS item_matching_accuracy,
  (SELECT round(count(*) FILTER (WHERE me AND md) / count(*) FILTER (WHERE me), 4) FROM c) AS mismatch_detection_accuracy, (SELECT count(*) FROM c WHERE es <> 'passed' AND s = 'passed') AS false_passes""")
def accuracy_report(spark, sf_dir):
    lines, orders, p, k = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"), F.col("l_partkey"), F.col("o_orderkey")
    n, code = F.col("l_quantity").cast("long").cast("string"), F.lpad(p.cast("string"), 8, "0")
    dotted = F.concat_ws(".", F.substring(code, 1, 4), F.substring(code, 5, 4))
    one = lambda f, e, x, r: F.struct(F.lit(f).alias("field"), e.alias("expected"), x.alias("extracted"), r.alias("review"))
    fields = lines.select(F.inline(F.array(
        one("quantity", n, F.when(F.col("l_linenumber") == 3, none()).when(p % 10 == 0, "0").otherwise(n), p % 7 == 0),
        one("pct_code", code, F.when(F.col("l_linenumber") == 2, none()).when(p % 5 == 0, "1").otherwise(dotted), F.lit(False)))))
    matches = lines.select(F.lit("matched").alias("expected"), F.when(F.col("l_linenumber") != 4, "matched").alias("actual"))
    cases = orders.select(at(STATUSES, k).alias("expected_status"), at((*STATUSES, "passed"), k).alias("actual_status"), (k % 2 == 0).alias("mismatch_expected"), (k % 3 == 0).alias("mismatch_detected"))
    return evaluation.accuracy_summary(fields, matches, cases)


@query("""
WITH g AS (SELECT user_id AS q, 'click' AS es, CASE WHEN user_id % 3 = 0 THEN user_id % 5 END AS ep, user_id % 4 <> 0 AS there FROM events GROUP BY 1), r AS (SELECT user_id AS q, event_type AS source, event_id % 5 AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id % 8 <> 0 QUALIFY n <= 5),
e AS (SELECT g.q, there, ep, count(source) AS n, coalesce(bool_or(r.n = 1 AND source = es), false) AS f, coalesce(bool_or(page = ep), false) AS p FROM g LEFT JOIN r USING (q) GROUP BY 1, 2, 3)
SELECT count(*) AS questions, round(count(*) FILTER (WHERE there AND f) / count(*) FILTER (WHERE there), 4) AS source_document_rate, round(count(*) FILTER (WHERE there AND ep IS NOT NULL AND p) / count(*) FILTER (WHERE there AND ep IS NOT NULL), 4) AS page_reference_rate, round(count(*) FILTER (WHERE NOT there AND n = 0) / count(*) FILTER (WHERE NOT there), 4) AS evidence_not_found_accuracy FROM e""")
def source_rates(spark, sf_dir):
    from pyspark.sql import Window

    events, u = load(spark, sf_dir, "events"), F.col("user_id")
    gold = events.select(u.alias("query_id"), F.lit("click").alias("expected_source"), F.when(u % 3 == 0, u % 5).alias("expected_page"), (u % 4 != 0).alias("should_exist")).distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    ranked = events.where("user_id % 8 <> 0").withColumn("position", place).where("position <= 5").select(u.alias("query_id"), "position", F.col("event_type").alias("source"), (F.col("event_id") % 5).alias("page"))
    return evaluation.source_metrics(gold, ranked)


STATES = ("completed", "awaiting_human_review", "failed", None)


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 = 0 AS broke, (['passed', 'failed', 'manual_review'])[o_orderkey % 3 + 1] AS e, (['passed', 'failed', 'manual_review', 'passed'])[o_orderkey % 4 + 1] AS s, (['completed', 'awaiting_human_review', 'failed', NULL])[o_orderkey % 4 + 1] AS st FROM orders), u AS (SELECT * FROM r WHERE NOT broke),
f AS (SELECT l_orderkey AS k, (['quantity', 'weight'])[l_linenumber % 2 + 1] AS field, l_partkey % 3 <> 0 AS c, l_partkey % 6 = 0 AS m, l_partkey % 4 = 0 AS rv FROM lineitem WHERE l_orderkey % 10 <> 0)
SELECT 'line_item_count_accuracy' AS metric, round(100.0 * count(*) FILTER (WHERE k % 7 <> 0) / count(*), 2) AS value FROM u UNION ALL SELECT 'match_accuracy', round(100.0 * count(*) FILTER (WHERE k % 5 <> 0) / count(*), 2) FROM u
UNION ALL SELECT 'line_reference_matches', CAST(sum(k % 4) AS DOUBLE) FROM u UNION ALL SELECT 'pct_code_matches', CAST(sum(k % 3) AS DOUBLE) FROM u UNION ALL SELECT 'product_name_matches', CAST(sum(k % 2) AS DOUBLE) FROM u
UNION ALL SELECT 'overall_status_accuracy', round(100.0 * count(*) FILTER (WHERE e = s) / count(*), 2) FROM u UNION ALL SELECT 'expected_failed_checks_detected', round(100.0 * sum(k % 2) / sum(k % 2 + k % 3), 2) FROM u UNION ALL SELECT 'unexpected_failed_checks', CAST(sum(k % 5) AS DOUBLE) FROM u UNION ALL SELECT 'missed_failed_checks', CAST(sum(k % 3) AS DOUBLE) FROM u
UNION ALL SELECT 'false_pass_count', CAST(count(*) FILTER (WHERE e <> s AND s = 'passed') AS DOUBLE) FROM u UNION ALL SELECT 'false_failure_count', CAST(count(*) FILTER (WHERE e <> s AND s = 'failed') AS DOUBLE) FROM u UNION ALL SELECT 'false_manual_review_count', CAST(count(*) FILTER (WHERE e <> s AND s = 'manual_review') AS DOUBLE) FROM u
UNION ALL SELECT 'evaluated', CAST(count(*) AS DOUBLE) FROM u UNION ALL SELECT 'attempted', CAST(count(*) AS DOUBLE) FROM r UNION ALL SELECT 'technical_failures', CAST(count(*) FILTER (WHERE broke) AS DOUBLE) FROM r UNION ALL SELECT 'completed', CAST(count(*) FILTER (WHERE st = 'completed') AS DOUBLE) FROM r
UNION ALL SELECT 'awaiting_human_review', CAST(count(*) FILTER (WHERE st = 'awaiting_human_review') AS DOUBLE) FROM r UNION ALL SELECT 'workflow_failed', CAST(count(*) FILTER (WHERE st = 'failed') AS DOUBLE) FROM r UNION ALL SELECT 'human_review_accuracy', round(100.0 * count(*) FILTER (WHERE st IS NOT NULL AND (k % 2 = 0) = (k % 3 = 0)) / count(st), 2) FROM r
UNION ALL SELECT 'average_duration_seconds', round(avg(k % 97), 2) FROM r UNION ALL SELECT 'median_duration_seconds', round(median(k % 97), 2) FROM r UNION ALL SELECT 'exact_field_accuracy', round(100.0 * count(*) FILTER (WHERE c) / count(*), 2) FROM f UNION ALL SELECT 'missing_field_rate', round(100.0 * count(*) FILTER (WHERE m) / count(*), 2) FROM f
UNION ALL SELECT 'incorrect_field_rate', round(100.0 * count(*) FILTER (WHERE NOT c AND NOT m) / count(*), 2) FROM f UNION ALL SELECT 'manual_review_field_rate', round(100.0 * count(*) FILTER (WHERE rv) / count(*), 2) FROM f UNION ALL SELECT field || '_accuracy', round(100.0 * count(*) FILTER (WHERE c) / count(*), 2) FROM f GROUP BY field""")
def run_report(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("l_partkey")
    runs = load(spark, sf_dir, "orders").select(
        k.alias("run_id"), (k % 10 == 0).alias("broke"), at((*STATUSES, "passed"), k).alias("status"), at(STATUSES, k).alias("expected_status"), F.when(k % 7 == 0, 1).otherwise(2).alias("items"), F.lit(2).alias("expected_items"), F.when(k % 5 == 0, 1).otherwise(2).alias("matched"),
        (k % 4).alias("line_reference"), (k % 3).alias("pct_code"), (k % 2).alias("product"), (k % 2 + k % 3).alias("failed_expected"), (k % 2).alias("failed_detected"), (k % 5).alias("failed_unexpected"), at(STATES, k).alias("state"), (k % 2 == 0).alias("review"), (k % 3 == 0).alias("review_expected"), (k % 97).alias("seconds"),
    )
    fields = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), at(("quantity", "weight"), F.col("l_linenumber")).alias("field"), (p % 3 != 0).alias("correct"), (p % 6 == 0).alias("missing"), (p % 4 == 0).alias("review"))
    return evaluation.run_metrics(runs, fields)


PRINTED = ("Invoice No 12", "Exporter address: x", "Port of Lading", "FOB terms", "Grand  total", "Gross wt", "packages", "AWB 7", "GD no 5", "form-e", "NTN 7", "", "country of origin")


@query(f"""
WITH p AS (SELECT doc_id, {asked('text', 'doc_id', PRINTED)} AS t FROM documents), h AS ({' UNION ALL '.join(f"SELECT doc_id, {lit(f)} AS field FROM p WHERE regexp_matches(regexp_replace(t, '[^\\x00-\\x7F]', '_', 'g'), {lit('(?i)' + r)})" for f, r in evaluation.PROBES.items())})
SELECT field, count(*) AS present, count(*) FILTER (WHERE doc_id % 3 = 0) AS resolved, round(count(*) FILTER (WHERE doc_id % 3 = 0) / count(*), 4) AS coverage FROM h GROUP BY 1""")
def presence_report(spark, sf_dir):
    """Fields printed anywhere in a text; every third document counts as resolved."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), at(PRINTED, F.col("doc_id"))).alias("text"))
    fields = docs.select("doc_id", F.explode(F.array(*map(F.lit, evaluation.PROBES))).alias("field"), F.when(F.col("doc_id") % 3 == 0, "v").alias("value"), F.lit("high").alias("grade"))
    return evaluation.presence_coverage(fields, evaluation.present_fields(docs))


@query("""SELECT count(*) AS documents, count(*) FILTER (WHERE event_type = 'click') AS cache_hits, round(sum(event_id % 21) / (count(*) * 20), 4) AS pattern_coverage, CAST(sum(event_id % 3) AS BIGINT) AS calls, CAST(sum(event_id % 1000 + user_id % 100) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_id % 3 > 1) AS over_budget FROM events""")
def telemetry_report(spark, sf_dir):
    e = F.col("event_id")
    return evaluation.telemetry(load(spark, sf_dir, "events").select(e.alias("doc_id"), F.lit(20).alias("fields_total"), (e % 21).alias("fields_from_patterns"), (e % 1000).alias("prompt_tokens"), (F.col("user_id") % 100).alias("completion_tokens"), (e % 3).alias("calls"), (F.col("event_type") == "click").alias("cache_hit")))


@query("""
WITH d AS (SELECT l_orderkey AS k, string_agg('line' || l_linenumber || ':' || sha256(CAST(l_partkey AS VARCHAR)), ',' ORDER BY 'line' || l_linenumber || ':' || sha256(CAST(l_partkey AS VARCHAR))) AS docs FROM lineitem GROUP BY 1)
SELECT o_orderkey AS scenario_id, sha256(concat_ws(chr(30), CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus, coalesce(docs, ''), 'code=3' || chr(31) || 'prompt=1' || chr(31) || 'schema=2')) AS key FROM orders LEFT JOIN d ON k = o_orderkey""")
def evaluation_keys(spark, sf_dir):
    scenarios = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("inputs"))
    documents = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    return evaluation.evaluation_keys(scenarios, documents, {"schema": "2", "prompt": "1", "code": "3"})


@query("""
WITH f AS (SELECT user_id AS case_id, arg_min(event_type, event_id) AS s FROM events WHERE user_id % 6 <> 0 GROUP BY 1), c AS (SELECT DISTINCT user_id AS case_id FROM events)
SELECT case_id, s AS primary_source, coalesce(contains(lower(s), CASE WHEN case_id % 2 = 0 THEN 'click' ELSE 'view' END), false) AS matched FROM c LEFT JOIN f USING (case_id)""")
def primary_source_check(spark, sf_dir):
    from pyspark.sql import Window

    events, u = load(spark, sf_dir, "events"), F.col("user_id")
    cases = events.select(u.alias("case_id"), F.when(u % 2 == 0, "Click").otherwise("VIEW").alias("expected_primary")).distinct()
    ranked = events.where("user_id % 6 <> 0").select(u.alias("case_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("position"), F.col("event_type").alias("source"))
    return evaluation.primary_sources(cases, ranked)


@query(f"""
WITH {S.INVOICE}, f AS (SELECT * FROM invoice WHERE item_index = 1), s AS (SELECT o_orderkey AS k, o_totalprice AS total, n_name, o_orderdate, f.* FROM orders LEFT JOIN f ON f.shipment_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey), m AS (
  SELECT k, list_filter([CASE WHEN trim(coalesce(product, '')) = '' THEN 'product_name' END, CASE WHEN code IS NULL OR k % 6 = 0 THEN 'pct_code' END, CASE WHEN units IS NULL THEN 'quantity' END, CASE WHEN price_cents IS NULL THEN 'unit_price' END, CASE WHEN cents IS NULL THEN 'invoice_line_total' END, CASE WHEN k % 7 = 0 THEN 'invoice_total' END,
    CASE WHEN net IS NULL OR k % 11 = 0 THEN 'net_weight' END, CASE WHEN gross IS NULL THEN 'gross_weight' END, CASE WHEN n_name IS NULL OR k % 13 = 0 THEN 'destination_country' END, CASE WHEN o_orderdate IS NULL THEN 'shipment_date' END, CASE WHEN k % 17 = 0 THEN 'uploaded_document_types' END], lambda x: x IS NOT NULL) AS m FROM s)
SELECT k AS shipment_id, CASE WHEN len(m) > 0 THEN 'manual_review' ELSE 'passed' END AS status, array_to_string(m, ', ') AS missing FROM m""")
def required_shipment_fields(spark, sf_dir):
    first = views.invoice_items(spark, sf_dir).where("item_index = 1").select("shipment_id", F.col("product").alias("product_name"), F.col("code").cast("string").alias("pct_code"), "quantity", "unit_price", F.col("line_total").alias("invoice_line_total"), "net_weight", "gross_weight")
    k = F.col("shipment_id")
    ships = views.shipments(spark, sf_dir).select("shipment_id", F.when(k % 7 != 0, F.col("amount")).alias("invoice_total"), F.when(k % 13 == 0, " ").otherwise(F.col("destination")).alias("destination_country"), "shipment_date", F.when(k % 17 != 0, "x").alias("uploaded_document_types"))
    rows = ships.join(first, "shipment_id", "left").withColumn("pct_code", F.when(k % 6 != 0, F.col("pct_code"))).withColumn("net_weight", F.when(k % 11 != 0, F.col("net_weight")))
    return rules.required_fields(rows)


@query("""
WITH c AS (SELECT o_orderkey AS shipment_id, o_orderkey % 40 AS p FROM orders), g AS (SELECT n_nationkey AS p, n_nationkey % 5 <> 0 AS meta, CASE n_nationkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN ' ' END AS v FROM nation)
SELECT shipment_id, CASE WHEN meta AND trim(coalesce(v, '')) <> '' THEN 'passed' ELSE 'manual_review' END AS status, CASE WHEN g.p IS NULL THEN 'outside_validated_mvp_scope' WHEN NOT meta THEN 'missing_tariff_metadata' WHEN trim(coalesce(v, '')) = '' THEN 'missing' ELSE v END AS reason FROM c LEFT JOIN g USING (p)""")
def code_support_checks(spark, sf_dir):
    n = F.col("n_nationkey")
    catalog = load(spark, sf_dir, "nation").select(n.cast("long").alias("code"), (n % 5 != 0).alias("has_metadata"), F.when(n % 3 == 0, "verified").when(n % 3 == 1, " ").alias("validation_status"))
    return rules.code_support(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shipment_id"), (F.col("o_orderkey") % 40).alias("code")), catalog)


VALIDATIONS = ("verified", "partially_verified", "not_verified", "", "Unclear source", "verified")


@query(f"""
WITH c AS (SELECT o_orderkey AS k, (['passed', 'not_applicable', 'failed', 'manual_review'])[o_orderkey % 4 + 1] AS s, o_orderkey % 9 <> 0 AS g, ({listed(VALIDATIONS)})[o_orderkey % 6 + 1] AS v FROM orders), m AS (SELECT *, list_filter([CASE WHEN k % 5 = 0 THEN 'source_document' END, CASE WHEN k % 7 = 0 THEN 'source_url' END, CASE WHEN k % 8 = 0 THEN 'source_page_or_source_locator' END, CASE WHEN k % 11 = 0 THEN 'issuing_authority' END, CASE WHEN k % 13 = 0 THEN 'effective_date' END,
  CASE WHEN k % 17 = 0 THEN 'rule_data_version' END, CASE WHEN v = '' THEN 'validation_status' END], lambda x: x IS NOT NULL) AS m, v = '' OR regexp_matches(lower(v), 'missing|unclear|unknown|unverified|not_verified|not verified') AS u FROM c), d AS (SELECT *, g AND s IN ('passed', 'not_applicable') AND (len(m) > 0 OR u) AS down FROM m)
SELECT k AS shipment_id, 'rule' AS check_id, CASE WHEN down THEN 'manual_review' ELSE s END AS status, CASE WHEN down THEN 'Done. Manual review required because ' || concat_ws(' and ', CASE WHEN len(m) > 0 THEN 'missing legal source field(s): ' || array_to_string(m, ', ') END, CASE WHEN u THEN 'validation status is absent or uncertain' END) || '.' ELSE 'Done.' END AS message FROM d""")
def provenance_downgrade(spark, sf_dir):
    k = F.col("o_orderkey")
    have = lambda n, x: F.when(k % n != 0, x)
    checks = load(spark, sf_dir, "orders").select(
        k.alias("shipment_id"), F.lit("rule").alias("check_id"), at(("passed", "not_applicable", "failed", "manual_review"), k).alias("status"), F.lit("Done.").alias("message"), (k % 9 != 0).alias("government"), have(5, "title").alias("source_document"), have(7, "url").alias("source_url"),
        F.when(k % 4 != 0, 3).alias("source_page"), F.when(k % 8 == 4, "annex").alias("source_locator"), have(11, "body").alias("issuing_authority"), have(13, F.lit("2025-01-01").cast("date")).alias("effective_date"), none("date").alias("legal_cutoff_date"), have(17, "v1").alias("rule_data_version"), at(VALIDATIONS, k).alias("validation_status"),
    )
    return rules.with_provenance(checks)


@query(f"""
WITH {S.SHIPMENTS}, n(document) AS (VALUES ('commercial_invoice'), ('packing_list'), ('form_e'))
SELECT s.shipment_id, 'required_document_' || n.document AS check_id, CASE WHEN d.document IS NOT NULL THEN 'passed' ELSE 'failed' END AS status FROM ships s CROSS JOIN n LEFT JOIN docs d ON d.shipment_id = s.shipment_id AND d.document = n.document""")
def general_document_checks(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    return rules.general_documents(ships, views.shipment_documents(ships), "https://example.org/clearance")


@query(f"""
WITH {S.SHIPMENTS}, req(code, document, v, s) AS (SELECT c.code, t.document, CASE (ascii(t.document) + CAST(c.code AS BIGINT)) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'conditional' WHEN 2 THEN 'true' END, CASE length(t.document) % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'partially_verified' ELSE 'unverified claim' END
  FROM (VALUES ('52010090'), ('52051100'), ('52094200'), ('61091000'), ('63023110')) c(code), (VALUES ('product_licence'), ('import_permit'), ('phytosanitary_certificate'), ('product_approval')) t(document))
SELECT s.shipment_id, r.document, CASE WHEN r.s = 'unverified claim' OR v IS NULL THEN 'manual_review' WHEN v = 'false' THEN 'not_applicable' WHEN d.document IS NOT NULL THEN 'passed' WHEN v = 'conditional' THEN 'manual_review' ELSE 'failed' END AS status
FROM ships s JOIN req r ON r.code = s.code LEFT JOIN docs d ON d.shipment_id = s.shipment_id AND d.document = r.document""")
def verified_requirements(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    names = ("product_licence", "import_permit", "phytosanitary_certificate", "product_approval")
    table = spark.createDataFrame([(c, d) for c in views.CODES for d in names], "code string, document string")
    value = F.element_at(F.array(F.lit("false"), F.lit("conditional"), F.lit("true"), none()), ((F.ascii("document") + F.col("code").cast("long")) % 4 + 1).cast("int"))
    table = table.select("code", "document", value.alias("value"), at(("verified", "partially_verified", "unverified claim"), F.length("document")).alias("verification"))
    return rules.verified_requirements(ships, views.shipment_documents(ships), table)


@query(f"""
WITH {S.CHECKS}, o AS (SELECT shipment_id, required_document AS document, status, check_id AS ordinal, 'because of ' || (length(check_id) % 2) AS message, 'notice ' || left(check_id, 6) AS source FROM checks WHERE status IN ('failed', 'manual_review') AND required_document IS NOT NULL AND required_document NOT IN ('commercial_invoice', 'packing_list')),
m AS (SELECT shipment_id, document, message, min(ordinal) AS f FROM o GROUP BY 1, 2, 3), s AS (SELECT shipment_id, document, source, min(ordinal) AS f FROM o GROUP BY 1, 2, 3), g AS (SELECT shipment_id, document, min(ordinal) AS f, bool_or(status = 'failed') AS r FROM o GROUP BY 1, 2)
SELECT shipment_id, document, CASE WHEN r THEN 'required' ELSE 'conditional' END AS requirement, (SELECT string_agg(message, '|' ORDER BY m.f) FROM m WHERE m.shipment_id = g.shipment_id AND m.document = g.document) AS reasons, (SELECT string_agg(source, '|' ORDER BY s.f) FROM s WHERE s.shipment_id = g.shipment_id AND s.document = g.document) AS sources, row_number() OVER (PARTITION BY shipment_id ORDER BY f) AS place FROM g""")
def outstanding_reasons(spark, sf_dir):
    checks = S._checks(spark, sf_dir).select("shipment_id", F.col("check_id").alias("ordinal"), "status", "required_document", F.concat(F.lit("because of "), (F.length("check_id") % 2).cast("string")).alias("message"), F.concat(F.lit("notice "), F.substring("check_id", 1, 6)).alias("source"))
    found = rules.outstanding_details(checks)
    return found.select("shipment_id", "document", "requirement", "reasons", "sources", F.col("place").cast("long").alias("place"))


@query("""
SELECT p_partkey AS code, '2026-07-22' AS effective_date, CASE WHEN p_size % 3 = 0 THEN 'Ministry of Commerce' ELSE p_brand END AS issuing_authority, CASE WHEN p_size % 2 = 0 THEN 'false' ELSE 'true' END AS licence_value, CASE WHEN p_size % 2 = 0 THEN 'verified_no_licence_required_under_epo_2022_general_permission' ELSE 'stated' END AS licence_verification,
  CASE WHEN p_size % 5 = 0 THEN 'false' ELSE 'conditional' END AS permit_value, CASE WHEN p_size % 5 = 0 THEN 'verified_no_permit_required_under_epo_2022_general_permission' END AS permit_verification, 'false' AS approval_value, 'verified_no_approval_required_under_epo_2022_general_permission' AS approval_verification FROM part""")
def requirement_patch(spark, sf_dir):
    s = F.col("p_size")
    products = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), F.when(s % 3 == 0, F.when(s % 2 == 0, "")).otherwise(F.col("p_brand")).alias("issuing_authority"), F.when(s % 2 != 0, "true").alias("licence_value"), F.lit("stated").alias("licence_verification"),
        F.when(s % 5 != 0, "conditional").alias("permit_value"), none().alias("permit_verification"), none().alias("approval_value"), none().alias("approval_verification"),
    )
    return rules.patched_requirements(products, "2026-07-22")


@query(f"""
WITH {S.PACKING}, a AS (SELECT shipment_id, count(*) AS n, count(net) AS kn, count(gross) AS kg, sum(net) AS sn, sum(gross) AS sg FROM invoice GROUP BY 1), b AS (SELECT shipment_id, count(*) AS n, count(net) AS kn, count(gross) AS kg, sum(net) AS sn, sum(gross) AS sg FROM packing GROUP BY 1),
t AS (SELECT o_orderkey AS k, a.n AS an, a.kn AS akn, a.kg AS akg, a.sn AS asn, a.sg AS asg, b.n AS bn, b.kn AS bkn, b.kg AS bkg, b.sn AS bsn, b.sg AS bsg FROM orders LEFT JOIN a ON a.shipment_id = o_orderkey LEFT JOIN b ON b.shipment_id = o_orderkey)
SELECT k AS shipment_id, unnest(['invoice_net_weight_total', 'invoice_gross_weight_total', 'packing_net_weight_total', 'packing_gross_weight_total']) AS check_id, unnest([
  CASE WHEN k % 4 = 0 THEN 'not_applicable' WHEN an IS NULL OR akn < an THEN 'manual_review' WHEN k % 3 = 0 THEN 'passed' ELSE 'failed' END, CASE WHEN an IS NULL OR akg < an THEN 'manual_review' WHEN abs(coalesce(asg, 0) - coalesce(asg, 0)) <= 0.01 THEN 'passed' ELSE 'failed' END,
  CASE WHEN k % 5 = 0 THEN 'not_applicable' WHEN bn IS NULL OR bkn < bn THEN 'manual_review' WHEN abs(bsn - asn) <= 0.01 THEN 'passed' ELSE 'failed' END, CASE WHEN k % 6 = 0 THEN 'not_applicable' WHEN bn IS NULL OR bkg < bn THEN 'manual_review' WHEN abs(bsg - coalesce(asg, 0)) <= 0.01 THEN 'passed' ELSE 'failed' END]) AS status FROM t""")
def declared_weight_totals(spark, sf_dir):
    invoice, packing = S._items(spark, sf_dir)
    k = F.col("shipment_id")
    sums = invoice.groupBy("shipment_id").agg(F.sum("net_weight").alias("n"), F.coalesce(F.sum("gross_weight"), F.lit(0)).alias("g"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shipment_id")).join(sums, "shipment_id", "left")
    n, g = F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0))
    header = orders.select("shipment_id", F.when(k % 4 != 0, n + k % 3).alias("declared_invoice_net"), g.alias("declared_invoice_gross"), F.when(k % 5 != 0, n).alias("declared_packing_net"), F.when(k % 6 != 0, g).alias("declared_packing_gross"))
    return reconcile.declared_weights(invoice, packing, header)


GUIDED = ("product_licence", "import_permit", "phytosanitary_certificate", "sbp_deposit_proof", "sbp_confirmation", "irrevocable_letter_of_credit", "form_e", "certificate_of_origin")
GUIDED_SQL = f"""docs AS (SELECT doc_id, {asked('text', 'doc_id', SAID)} AS text FROM documents), items(query_id, text) AS (VALUES {', '.join("('" + d + "', '" + ' '.join([d.replace('_', ' '), *retrieval.DOCUMENT_TERMS.get(d, ()), 'required for export']) + "')" for d in GUIDED)})"""


@query(f"""
WITH {GUIDED_SQL}{R.BM25_OVER}, top AS (SELECT query_id AS document, doc_id AS passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 5),
x AS (SELECT top.*, lower(text) AS t FROM top JOIN docs ON doc_id = passage_id), d AS (SELECT *, CASE document {' '.join(f"WHEN {lit(n)} THEN {held('t', ts)}" for n, ts in retrieval.DOCUMENT_TERMS.items())} ELSE contains(t, replace(document, '_', ' ')) END AS direct, regexp_matches(t, {lit(retrieval.NOT_NEEDED)}) AS no FROM x),
g AS (SELECT document, bool_or(direct) AS direct, bool_or(direct AND no) AS no, bool_or(direct AND NOT no) AS yes, min({{'far': NOT direct, 'rank': rank, 'p': passage_id}}).p AS passage_id FROM d GROUP BY 1),
ca AS (SELECT n_nationkey * 10 + i AS case_id, ({listed(views.CODES)})[i + 1] AS code, upper(n_name) = 'CHINA' AS china FROM nation, range(5) r(i)), o(code, document, requirement) AS (VALUES ('52010090', 'product_licence', 'conditional'), ('52010090', 'import_permit', 'conditional'), ('52010090', 'phytosanitary_certificate', 'required'), ('52010090', 'sbp_deposit_proof', 'required'),
  ('52010090', 'sbp_confirmation', 'required'), ('52010090', 'irrevocable_letter_of_credit', 'required'), ('61091000', 'product_licence', 'required')), l AS (SELECT case_id, document, requirement FROM ca JOIN o USING (code) UNION ALL SELECT case_id, 'form_e', 'required' FROM ca UNION ALL SELECT case_id, 'certificate_of_origin', CASE WHEN china THEN 'required' ELSE 'conditional' END FROM ca WHERE code <> '52010090')
SELECT case_id, document, requirement, CASE WHEN direct IS NULL THEN 'configured_rule_only' WHEN no AND yes THEN 'conflicting_evidence' WHEN direct THEN 'direct_evidence' ELSE 'indirect_support' END AS evidence_class FROM l LEFT JOIN g USING (document)
UNION ALL SELECT case_id, unnest(['commercial_invoice', 'packing_list']), 'required', 'configured_rule_only' FROM ca""")
def guidance_by_retrieval(spark, sf_dir):
    """Every product to every nation: what the rules leave to obtain, each with the class of the passages that a search finds for it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), at(SAID, F.col("doc_id"))).alias("text"))
    index = lexical_index.index_of(docs, table_signature(spark, f"{sf_dir}/documents.parquet") + "-said")
    cases = load(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("destination"), F.posexplode(F.array(*map(F.lit, views.CODES))).alias("i", "code"))
    cases = cases.select((F.col("n_nationkey") * 10 + F.col("i")).cast("long").alias("shipment_id"), "code", "destination", none("date").alias("shipment_date"), none("date").alias("letter_of_credit_date"))
    return retrieval.pre_submission(cases, rules.sample_rules(spark), retrieval.passages_for_documents(index, docs, GUIDED), spark.createDataFrame([], "shipment_id long, document string"))
