"""Queries over documents: extraction, chunks, indexes, supporting documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions, tokens
from ..operators import chunking, evaluation, extraction, ingestion, supporting
from ..session import load
from ..storage import new_path
from . import views
from .registry import registry

QUERIES, ORACLES, query = registry()

#: Headers printed over each document's text, so that labels are there to be found.
PRINTED = """
  d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'INV-A' || doc_id WHEN doc_id % 5 <> 4 THEN 'INV-' || doc_id END AS invoice, doc_id % 5 = 3 AS twice,
           CASE doc_id % 4 WHEN 0 THEN '2026-03-0' || (doc_id % 9 + 1) WHEN 1 THEN '05/03/2026' WHEN 2 THEN '25/03/2026' END AS printed_date FROM d
  )"""


def _printed(spark, sf_dir):
    k = F.col("doc_id")
    number = F.when(k % 5 == 0, F.concat(F.lit("INV-A"), k.cast("string"))).when(k % 5 != 4, F.concat(F.lit("INV-"), k.cast("string")))
    date = F.when(k % 4 == 0, F.concat(F.lit("2026-03-0"), (k % 9 + 1).cast("string"))).when(k % 4 == 1, "05/03/2026").when(k % 4 == 2, "25/03/2026")
    head = F.concat_ws("\n", F.concat(F.lit("Invoice No: "), number), F.when(k % 5 == 3, F.lit("Invoice No: INV-SECOND-1")), F.concat(F.lit("Invoice Date\n"), date), F.lit("PCT Code 6109.10.00"))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", head, F.coalesce("text", F.lit(""))).alias("text"), F.length("text").alias("n_chars"))


FIELDS = tuple(f for f in extraction.FIELDS if f[0] in ("invoice_number", "invoice_date", "pct_code"))


@query(f"""
WITH {PRINTED}
SELECT doc_id, 'invoice_number' AS field, invoice AS value, CASE WHEN invoice IS NULL THEN 'missing' WHEN twice THEN 'low' ELSE 'high' END AS grade FROM h
UNION ALL SELECT doc_id, 'invoice_date', CASE doc_id % 4 WHEN 0 THEN printed_date WHEN 1 THEN printed_date WHEN 2 THEN '2026-03-25' END, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'missing' END FROM h
UNION ALL SELECT doc_id, 'pct_code', '61091000', 'high' FROM h""")
def graded_fields(spark, sf_dir):
    docs = _printed(spark, sf_dir)
    return extraction.graded(docs, fields=FIELDS).select("doc_id", "field", "value", "grade")


@query(f"""
WITH {PRINTED}, g AS (SELECT 'invoice_number' AS field, invoice IS NOT NULL AND NOT twice AS ok FROM h UNION ALL SELECT 'invoice_date', doc_id % 4 IN (0, 2) FROM h UNION ALL SELECT 'pct_code', true FROM h)
SELECT field, count(*) AS total, count(*) FILTER (WHERE ok) AS resolved, round(avg(CAST(ok AS INTEGER)), 4) AS coverage FROM g GROUP BY 1""")
def extraction_coverage(spark, sf_dir):
    docs = _printed(spark, sf_dir)
    return extraction.coverage(extraction.graded(docs, fields=FIELDS))


@query(f"""
WITH {PRINTED}, g AS (
  SELECT doc_id, 'invoice_number' AS field, invoice AS value, CASE WHEN invoice IS NULL THEN 0 WHEN twice THEN 0.5 ELSE 0.95 END AS c FROM h
  UNION ALL SELECT doc_id, 'invoice_date', CASE doc_id % 4 WHEN 0 THEN printed_date WHEN 2 THEN '2026-03-25' END, CASE doc_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.5 WHEN 2 THEN 0.95 ELSE 0 END FROM h
  UNION ALL SELECT doc_id, 'pct_code', '61091000', 0.95 FROM h)
SELECT doc_id, field, CASE WHEN c >= 0.8 THEN value END AS value, CAST(c AS DOUBLE) AS confidence, CASE WHEN c >= 0.8 THEN 'verified' ELSE 'manual_review' END AS status FROM g""")
def trusted_fields(spark, sf_dir):
    docs = _printed(spark, sf_dir)
    return extraction.trusted(extraction.graded(docs, fields=FIELDS))


@query("""
WITH l AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed under') THEN 1 ELSE 0 END AS hit FROM documents)
SELECT count(*) AS documents, CAST(sum(hit) AS BIGINT) AS licensed FROM l""")
def license_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("text").rlike("(?i)licensed under")).alias("licensed"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'B' END AS v1, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS v2 FROM documents)
SELECT doc_id, 'reference' AS field, CASE WHEN doc_id % 7 = 0 THEN 'invalid' WHEN v1 = v2 THEN 'valid' ELSE 'conflicting' END AS state, CASE WHEN doc_id % 7 <> 0 AND v1 = v2 THEN v1 END AS value, CAST(0.99 AS DOUBLE) AS confidence FROM c""")
def candidate_selection(spark, sf_dir):
    k = F.col("doc_id")
    valid = k % 7 != 0
    one = lambda v, p, c: F.struct(v.alias("value"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), valid.alias("valid"))
    found = F.array(one(F.when(k % 3 == 0, "A").otherwise("B"), 1, 0.99), one(F.when(k % 2 == 0, "A").otherwise("B"), 1, 0.99), one(F.lit("C"), 1, 0.94), one(F.lit("D"), 2, 0.99))
    return extraction.selected(load(spark, sf_dir, "documents").select("doc_id", F.lit("reference").alias("field"), F.inline(found)))


@query(f"""
WITH {PRINTED}
SELECT doc_id, 'invoice_number' AS field, coalesce(invoice, CASE WHEN doc_id % 2 = 0 THEN 'GAP-' || doc_id END) AS value, CASE WHEN invoice IS NOT NULL THEN 'deterministic' WHEN doc_id % 2 = 0 THEN 'gap' ELSE 'none' END AS method, invoice IS NOT NULL AND doc_id % 2 = 0 AS disagrees FROM h""")
def gap_filling(spark, sf_dir):
    docs = _printed(spark, sf_dir)
    fields = extraction.graded(docs, fields=FIELDS[:1])
    gap = F.concat(F.lit("GAP-"), F.col("doc_id").cast("string"))
    gaps = docs.select("doc_id", F.lit("invoice_number").alias("field"), gap.alias("value"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ref gap "), F.col("doc_id").cast("string"), F.lit("!"))).otherwise("nothing").alias("snippet"))
    return extraction.filled(fields, gaps)


@query("""
WITH a AS (SELECT doc_id, unnest([0, n_chars // 3, n_chars // 2, n_chars]) AS place, n_chars FROM documents), s AS (SELECT DISTINCT doc_id, greatest(place - 400, 0) AS s, least(place + 400, n_chars) AS e FROM a),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM m)
SELECT doc_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY doc_id, g""")
def context_windows(spark, sf_dir):
    n = F.col("n_chars")
    places = F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 3), F.floor(n / 2), n))).alias("place")
    return extraction.context_windows(load(spark, sf_dir, "documents").select("doc_id", "n_chars", places)).select("doc_id", "start", "end")


@query("""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 20 AS useful FROM documents""")
def useful_pages(spark, sf_dir):
    return extraction.useful_pages(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "useful")


@query("""SELECT conv_id AS doc_id, string_agg('<page number="' || turn || '">' || chr(10) || text || chr(10) || '</page>', chr(10) ORDER BY turn, text) AS text
FROM conversations WHERE length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 20 GROUP BY 1""")
def page_marked_text(spark, sf_dir):
    return extraction.page_marked(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("""
WITH k AS (SELECT doc_id, sha256('v1' || chr(31) || sha256(coalesce(text, ''))) AS fingerprint FROM documents)
SELECT * FROM k WHERE fingerprint NOT IN (SELECT fingerprint FROM k WHERE doc_id % 3 = 0)""")
def cache_misses(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    cached = docs.where("doc_id % 3 = 0").select(F.sha2(F.concat_ws("\x1f", F.lit("v1"), F.sha2(F.coalesce("text", F.lit("")), 256)), 256).alias("fingerprint"))
    return extraction.cache_misses(docs, cached, "v1")


@query("""
WITH p AS (SELECT p_partkey AS doc_id, p_name AS name, p_size AS size, p_partkey % 6 = 0 AS bad FROM part)
SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(1 AS INTEGER) AS row, unnest(['description', 'quantity', 'line_total']) AS "column", unnest([split_part(name, ' ', 1), CASE WHEN bad THEN 'few' ELSE CAST(size AS VARCHAR) END, CAST(size * 2 AS VARCHAR)]) AS cell, unnest(['high', CASE WHEN bad THEN 'low' ELSE 'high' END, 'high']) AS grade FROM p""")
def word_box_tables(spark, sf_dir):
    """A table of one item by the boxes of its words; every sixth quantity is no number. What stands under "Net Wt (KG)" is no field."""
    part = load(spark, sf_dir, "part")
    word = lambda x0, y, x1, t: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x1)).alias("x1"), F.lit(float(y + 10)).alias("y1"), t.cast("string").alias("text"))
    name = F.substring_index("p_name", " ", 1)
    words = F.array(
        word(10, 100, 80, F.lit("Description")), word(120, 101, 150, F.lit("Qty")), word(200, 100, 230, F.lit("Line")), word(232, 100, 260, F.lit("Total")), word(300, 100, 320, F.lit("Net")), word(322, 100, 335, F.lit("Wt")), word(337, 100, 360, F.lit("(KG)")),
        word(12, 120, 60, name), word(125, 121.5, 140, F.when(F.col("p_partkey") % 6 == 0, "few").otherwise(F.col("p_size").cast("string"))), word(205, 122.5, 250, F.col("p_size") * 2), word(310, 121, 330, F.lit("7")), word(10, 140, 40, F.lit("Total")), word(205, 140, 250, F.lit("9")),
    )
    return extraction.tables(part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.inline(words)))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, i - 1 AS line, ls[i] AS t FROM l, unnest(range(1, len(ls) + 1)) r(i)),
r AS (SELECT doc_id, (line - 1) // 3 AS row, (line - 1) % 3 AS c, t FROM x WHERE line >= 1), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, row) AS n FROM r)
SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(c AS INTEGER) AS "column", t AS cell FROM n WHERE n = 3""")
def stacked_tables(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return extraction.stacked_rows(lines, 3, 1)


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, i AS line, unnest(string_split(ls[i], ' ')) AS w, generate_subscripts(string_split(ls[i], ' '), 1) AS word FROM l, unnest(range(1, len(ls) + 1)) r(i)),
s AS (SELECT *, (length(w) * 7 + word) % 60 + 40 AS conf FROM x WHERE trim(w) <> ''), p AS (SELECT doc_id, line, string_agg(w, ' ' ORDER BY word) AS t FROM s GROUP BY 1, 2),
c AS (SELECT doc_id, CAST(sum(conf) AS BIGINT) AS c, count(*) AS n FROM s GROUP BY 1)
SELECT doc_id, CAST(1 AS INTEGER) AS page, sha256(string_agg(t, chr(10) ORDER BY line)) AS text, ((20 * any_value(c) + any_value(n)) // (2 * any_value(n))) / 1000.0 AS ocr_confidence, CASE WHEN (20 * any_value(c) + any_value(n)) // (2 * any_value(n)) >= 800 THEN 'verified' ELSE 'manual_review' END AS status
FROM p JOIN c USING (doc_id) GROUP BY 1""")
def ocr_pages(spark, sf_dir):
    # texts are dealt out by document before they are split, so that no word of theirs is moved
    lines = load(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "_text"))
    words = lines.select("doc_id", F.lit(1).alias("page"), "line", F.posexplode(F.split("_text", " ")).alias("word", "text"))
    words = words.withColumn("conf", ((F.length("text") * 7 + F.col("word") + 1) % 60 + 40).cast("long"))
    return extraction.ocr_pages(words).withColumn("text", F.sha2("text", 256))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chunk_sql(units: str) -> str:
    """Parents and children of ``units`` (place, text) in SQL: the greedy folds as recursive tables."""
    return rf"""
u AS ({units}),
b AS (SELECT place, list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS}), chr(10) || chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS bs FROM u),
w AS (SELECT place, 1 AS i, 0 AS g, length(bs[1]) AS size FROM b WHERE len(bs) > 0 UNION ALL
  SELECT place, i + 1, CASE WHEN cut THEN g + 1 ELSE g END, CASE WHEN cut THEN n ELSE size + n END FROM (
    SELECT place, i, g, size, length(bs[i + 1]) AS n, regexp_matches(bs[i + 1], '^\s*(S\.?\s*R\.?\s*O\.?|Sr\.?\s*No\.?|Schedule|SCHEDULE|===\s*Page|\(\s*[ivx]+\s*\))') OR size + length(bs[i + 1]) > 1800 OR size >= 3200 AS cut
    FROM w JOIN b USING (place) WHERE i < len(bs))),
p AS (SELECT place, g, string_agg(bs[i], chr(10) || chr(10) ORDER BY i) AS text FROM w JOIN b USING (place) GROUP BY place, g),
l AS (SELECT place, g, string_split(text, chr(10)) AS ls FROM p),
v AS (SELECT place, g, 1 AS i, 0 AS h, length(ls[1]) + 1 AS size FROM l UNION ALL
  SELECT place, g, i + 1, CASE WHEN cut THEN h + 1 ELSE h END, CASE WHEN cut THEN n ELSE size + n END FROM (
    SELECT place, g, i, h, size, length(ls[i + 1]) + 1 AS n, size + length(ls[i + 1]) + 1 > 480 AS cut FROM v JOIN l USING (place, g) WHERE i < len(ls))),
c AS (SELECT place, g, h, trim(string_agg(ls[i], chr(10) ORDER BY i), {BLANKS}) AS text FROM v JOIN l USING (place, g) GROUP BY place, g, h),
k AS (SELECT place, g, row_number() OVER (PARTITION BY place, g ORDER BY h) - 1 AS h, text FROM c WHERE text <> ''),
made AS (
  SELECT place || ':p' || g AS chunk_id, CAST(NULL AS VARCHAR) AS parent_chunk_id, 'parent' AS role, CAST(g AS INTEGER) AS chunk_index, text FROM p
  UNION ALL SELECT place || ':p' || g || ':c' || h, place || ':p' || g, 'child', CAST(h AS INTEGER), text FROM k)"""


@query(f"WITH RECURSIVE {chunk_sql("SELECT 'doc-' || doc_id || ':u0' AS place, coalesce(text, '') AS text FROM documents")} SELECT *, CAST(length(text) AS INTEGER) AS char_count, sha256(text) AS checksum FROM made")
def parent_child_chunks(spark, sf_dir):
    """Parents and children of each document, a unit of its own."""
    docs = load(spark, sf_dir, "documents")
    return chunking.chunks(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("unit"), "text"))


@query(r"""
WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> '') AS ps FROM documents), q AS (SELECT doc_id, i - 1 AS parent, list_filter(string_split(ps[i], chr(10)), lambda x: trim(x) <> '') AS ls, ps[i] AS p FROM p, unnest(range(1, len(ps) + 1)) r(i)),
c AS (SELECT doc_id, parent, CASE WHEN len(ls) > 1 THEN ls ELSE list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x) <> '') END AS cs FROM q), e AS (SELECT doc_id, parent, i - 1 AS child_index, trim(cs[i]) AS child FROM c, unnest(range(1, len(cs) + 1)) r(i))
SELECT doc_id, CAST(parent AS INTEGER) AS parent, CAST(child_index AS INTEGER) AS child_index, CASE WHEN (contains(lower(child), 'invoice') AND contains(lower(child), 'no')) OR contains(lower(child), 'date') THEN 'header' WHEN contains(lower(child), 'total') THEN 'totals' WHEN contains(lower(child), 'weight') THEN 'weights' ELSE 'body' END AS section, sha256(child) AS content_hash FROM e""")
def line_chunks(spark, sf_dir):
    return chunking.line_children(load(spark, sf_dir, "documents")).select("doc_id", "parent", "child_index", "section", "content_hash")


@query("""
SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'insert' WHEN doc_id % 4 = 1 THEN 'update' WHEN doc_id % 8 = 2 THEN 'update' ELSE 'keep' END AS action FROM documents
UNION ALL SELECT -1 - doc_id, 'delete' FROM documents WHERE doc_id % 50 = 0""")
def index_actions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    k = F.col("doc_id")
    new = docs.select(k.alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    old = docs.where(k % 4 != 0).select(k.alias("chunk_id"), F.when(k % 4 == 1, "other").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("checksum"), F.when(k % 8 == 2, "v0").otherwise("v1").alias("index_version"))
    gone = docs.where(k % 50 == 0).select((-1 - k).alias("chunk_id"), F.lit("x").alias("checksum"), F.lit("v1").alias("index_version"))
    return chunking.index_actions(new, old.unionByName(gone), "v1")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 6 = 3""")
def changed_sources(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("source_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    seen = docs.where("doc_id % 3 = 0").select("source_path", F.when(F.col("doc_id") % 6 == 3, "old").otherwise(F.col("checksum")).alias("checksum"))
    return chunking.changed_sources(docs, seen).select("doc_id", "checksum")


@query("""SELECT event_id, ts = max(ts) OVER (PARTITION BY user_id, event_type) AS active FROM events""")
def active_chunks(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("shipment_id"), F.col("event_type").alias("document_type"), F.col("ts").alias("uploaded"))
    return chunking.active_chunks(rows).select("event_id", "active")


@query(f"""
SELECT o_orderkey AS shipment_id, sha256(concat_ws(chr(10), 'shipment_id: ' || o_orderkey, 'destination: ' || coalesce(n_name, 'unknown'), 'shipment_date: ' || coalesce(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'unknown'),
  'code: ' || (['{"', '".join(views.CODES)}'])[o_orderkey % {len(views.CODES)} + 1], 'exporter: ' || coalesce(c_name, 'unknown'), 'amount: ' || coalesce(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), 'unknown'))) AS checksum
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def shipment_summaries(spark, sf_dir):
    return chunking.summary_text(views.shipments(spark, sf_dir)).select("shipment_id", "checksum")


DOCS = """
  s AS (SELECT o_orderkey AS id, c_name AS exporter, n_name AS destination, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
  v AS (SELECT id, (['certificate_of_origin', 'import_permit', 'sbp_deposit_proof', 'form_e'])[id % 4 + 1] AS type, CASE id % 4 WHEN 3 THEN 'form_e' ELSE (['certificate_of_origin', 'UNKNOWN', 'sbp_deposit_proof'])[id % 4 + 1] END AS detected_type,
    CASE WHEN id % 10 = 0 THEN 'claimed_only' WHEN id % 10 = 1 THEN 'unreadable' END AS early, id % 13 = 0 AS soft,
    list_filter([CASE WHEN id % 5 = 2 THEN 'exporter_match' END, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'destination_match' END, CASE WHEN id % 4 = 0 AND id % 7 = 0 THEN 'pct_match' END, CASE WHEN id % 4 = 1 AND id % 6 = 5 THEN 'not_expired' END, CASE WHEN id % 4 = 2 AND id % 3 = 1 THEN 'deposit_percentage' END], lambda x: x IS NOT NULL) AS failed FROM s)"""


def _supporting(spark, sf_dir):
    ships = views.shipments(spark, sf_dir).withColumn("invoice_number", F.concat(F.lit("INV-"), F.col("shipment_id").cast("string")))
    k = F.col("shipment_id")
    named = lambda *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (k % 4 + 1).cast("int"))
    documents = ships.select(
        "shipment_id", named("Certificate of Origin", "import_permit", "SBP deposit-proof", "E-Form").alias("claimed_type"),
        F.when(k % 10 != 0, F.when(k % 10 == 1, "short").otherwise("a document of twenty letters or more")).alias("text"), named("COO", None, "deposit proof", "form-e").alias("detected"),
        F.when(k % 5 == 2, "Somebody Else").otherwise(F.upper("exporter")).alias("exporter"), F.when(k % 3 == 0, "NOWHERE").otherwise(F.lower("destination")).alias("destination"),
        F.when(k % 7 == 0, "00000000").otherwise(F.concat_ws(".", F.substring("code", 1, 4), F.substring("code", 5, 4))).alias("code"), "invoice_number",
        F.when(k % 6 == 5, F.date_sub("shipment_date", 1)).otherwise(F.col("shipment_date")).alias("expiry"), F.when(k % 3 == 1, 2).otherwise(1).alias("percentage"), F.when(k % 13 == 0, 0.74).otherwise(0.75).alias("ocr_confidence"),
    )
    return supporting.verify(documents, ships.withColumn("code", F.col("code")))


@query(f"""
WITH {DOCS}
SELECT id AS shipment_id, CASE WHEN type = 'import_permit' THEN 'UNKNOWN' ELSE type END AS type, CASE WHEN type = 'import_permit' THEN 'UNKNOWN' ELSE detected_type END AS detected_type,
  coalesce(early, CASE WHEN len(f) = 0 THEN 'shipment_matched' WHEN soft THEN 'fields_verified' ELSE 'type_verified' END) AS state,
  CASE WHEN early = 'claimed_only' THEN 'failed' WHEN early = 'unreadable' THEN 'manual_review' WHEN len(f) = 0 THEN 'passed' WHEN soft THEN 'manual_review' ELSE 'failed' END AS content_status,
  CASE WHEN early IS NOT NULL THEN '' ELSE array_to_string(f, ',') END AS open_checks
FROM (SELECT *, list_filter(failed, lambda x: x <> 'not_expired') AS f FROM v)""")
def supporting_documents(spark, sf_dir):
    return _supporting(spark, sf_dir)


@query(f"""
WITH {DOCS}, w AS (SELECT id, CASE WHEN type = 'import_permit' THEN 'UNKNOWN' ELSE type END AS type, early, soft, len(list_filter(failed, lambda x: x <> 'not_expired')) AS n FROM v)
SELECT id AS shipment_id, CASE WHEN early IS DISTINCT FROM 'claimed_only' THEN type ELSE '' END AS present, CASE WHEN early IS NULL AND (n = 0 OR soft) THEN type ELSE '' END AS verified,
  CASE WHEN early = 'claimed_only' THEN 'failed' WHEN early = 'unreadable' THEN 'manual_review' WHEN n = 0 THEN 'passed' WHEN soft THEN 'manual_review' ELSE 'failed' END AS status FROM w""")
def document_presence(spark, sf_dir):
    return supporting.presence(_supporting(spark, sf_dir))


@query("""SELECT o_orderkey AS shipment_id, CASE WHEN o_orderkey % 3 = 0 THEN 'manual_review' WHEN o_orderkey % 3 = 1 THEN 'passed' ELSE 'failed' END AS related_deposit_match FROM orders""")
def deposit_references(spark, sf_dir):
    k = F.col("o_orderkey")
    number = F.concat(F.lit("DEP-"), k.cast("string"))
    row = lambda o, t, n, r: F.struct(F.lit(o).alias("ordinal"), F.lit(t).alias("type"), n.alias("document_number"), r.alias("related_reference"))
    none = F.lit(None).cast("string")
    rows = F.array(row(1, "sbp_deposit_proof", F.when(k % 3 != 0, number), none), row(2, "sbp_deposit_proof", F.when(k % 3 != 0, F.lit("DEP-LATER")), none), row(3, "sbp_confirmation", none, F.when(k % 3 == 2, "DEP-OTHER").otherwise(F.lower(number))))
    return supporting.reference_chain(load(spark, sf_dir, "orders").select(k.alias("shipment_id"), F.inline(rows)))


@query("""SELECT o_orderkey AS shipment_id, 'form_e' AS type FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def claimed_only_types(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shipment_id"))
    return supporting.claimed_only(orders.where("shipment_id % 2 = 0").withColumn("claimed_type", F.lit("Electronic Form E")), orders.where("shipment_id % 3 = 0").withColumn("type", F.lit("form_e")))


@query(f"""
WITH {PRINTED}
SELECT doc_id, 'invoice_number' AS field, 'INV-' || doc_id AS value, coalesce(contains(invoice, 'INV-' || doc_id), false) AS present FROM h""")
def ground_truth_presence(spark, sf_dir):
    docs = _printed(spark, sf_dir)
    return evaluation.present_in_pages(docs.select("doc_id", F.lit("invoice_number").alias("field"), F.concat(F.lit("INV-"), F.col("doc_id").cast("string")).alias("value")), docs)


@query(f"""
WITH {PRINTED}, t AS (SELECT 'invoice_number' AS field, 'INV-' || doc_id AS truth, invoice AS value FROM h UNION ALL SELECT 'pct_code', '61091000', '61091000' FROM h)
SELECT field, count(*) FILTER (WHERE truth = value) AS correct, count(*) FILTER (WHERE value <> truth) AS incorrect, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) AS total, round(count(*) FILTER (WHERE truth = value) / count(*), 4) AS accuracy FROM t GROUP BY 1""")
def field_accuracy(spark, sf_dir):
    docs = _printed(spark, sf_dir)
    got = extraction.graded(docs, fields=FIELDS).select("doc_id", "field", "value")
    number = docs.select("doc_id", F.lit("invoice_number").alias("field"), F.concat(F.lit("INV-"), F.col("doc_id").cast("string")).alias("value"))
    truth = number.unionByName(docs.select("doc_id", F.lit("pct_code").alias("field"), F.lit("61091000").alias("value")))
    return evaluation.field_accuracy(got, truth, ["doc_id", "field"])


LONGEST = 20_000


def _readable(text: str) -> str:
    if len(text) > LONGEST:
        raise ValueError("too long to read")
    return text


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t1, coalesce(text, '') || CASE WHEN doc_id % 5 = 1 THEN ' as amended' ELSE '' END AS t2 FROM documents),
k AS (SELECT *, doc_id % 3 <> 0 AND length(t1) <= {LONGEST} AS known, length(t2) <= {LONGEST} AS ok FROM d)
SELECT 1 AS run, 'doc-' || doc_id AS source_path, CASE WHEN known THEN 'ingested' ELSE 'error' END AS status FROM k WHERE doc_id % 3 <> 0
UNION ALL SELECT 2, 'doc-' || doc_id, CASE WHEN known AND t1 = t2 THEN 'skipped_idempotent' WHEN NOT ok THEN 'error' WHEN known THEN 'updated' ELSE 'ingested' END FROM k
UNION ALL SELECT 3, 'doc-' || doc_id, CASE WHEN ok THEN 'skipped_idempotent' ELSE 'error' END FROM k""")
def ingestion_runs(spark, sf_dir):
    """Three runs into one table: some sources; all, some of them amended; the same again. Sources too long to read fail alone."""
    table = ingestion.chunk_table(spark, new_path(spark))
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    units = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), k.cast("string")).alias("source_path"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("unit"), text.alias("text"))
    amended = units.withColumn("text", F.when(k % 5 == 1, F.concat("text", F.lit(" as amended"))).otherwise(F.col("text")))
    runs = [ingestion.ingest(table, u.drop("doc_id"), _readable).select(F.lit(n).alias("run"), "source_path", "status") for n, u in enumerate((units.where(k % 3 != 0), amended, amended), start=1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("""
WITH d AS (SELECT *, doc_id % 3 <> 0 AS first, doc_id % 4 <> 0 AS second, doc_id % 5 = 1 AS changed FROM documents)
SELECT 1 AS run, count(*) FILTER (first) AS discovered, count(*) FILTER (first) AS embedded, 0::BIGINT AS updated, 0::BIGINT AS skipped, 0::BIGINT AS stale_removed, 'hash-64' AS models, count(*) FILTER (first) AS vectors FROM d
UNION ALL SELECT 2, count(*) FILTER (second), count(*) FILTER (second AND NOT first), count(*) FILTER (second AND first AND changed), count(*) FILTER (second AND first AND NOT changed), count(*) FILTER (first AND NOT second), 'hash-64', count(*) FILTER (second) FROM d
UNION ALL SELECT 3, count(*) FILTER (second), 0, count(*) FILTER (second), 0, 0, 'hash-64', count(*) FILTER (second) FROM d
UNION ALL SELECT 4, count(*) FILTER (second), 0, 0, count(*) FILTER (second), 0, 'hash-64', count(*) FILTER (second) FROM d""")
def vector_index_runs(spark, sf_dir):
    """Vectors of a corpus over four runs: some; others, some changed, some gone; a new index version; nothing new."""
    table = ingestion.vector_table(spark, new_path(spark))
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = load(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    later = docs.where(k % 4 != 0).withColumn("text", F.when(k % 5 == 1, F.concat("text", F.lit(" as amended"))).otherwise(F.col("text")))
    rows = []
    for n, (chunks, version) in enumerate(((docs.where(k % 3 != 0), "1"), (later, "1"), (later, "2"), (later, "2")), start=1):
        report = ingestion.index_vectors(table, chunks.select(k.alias("chunk_id"), "text", F.sha2("text", 256).alias("checksum")), tokens.embedder(64), "hash-64", version)
        meta = ingestion.index_meta(table).first()
        rows.append((n, *(report[c] for c in ("discovered", "embedded", "updated", "skipped", "stale_removed")), ",".join(meta["models"]), meta["vectors"]))
    return spark.createDataFrame(rows, "run int, discovered long, embedded long, updated long, skipped long, stale_removed long, models string, vectors long")


@query("""SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id % 3 <> 0 AS was_stored, 64 AS size FROM documents""")
def stored_or_embedded(spark, sf_dir):
    """A vector for every chunk: the stored one, or for chunks the index misses one made now."""
    table = ingestion.vector_table(spark, new_path(spark))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("checksum", F.sha2("text", 256))
    ingestion.index_vectors(table, docs.where("chunk_id % 3 <> 0"), tokens.embedder(64), "hash-64", "1")
    found = ingestion.vectors_for(table, docs, tokens.embedder(64), "hash-64", 64)
    return found.select("chunk_id", "was_stored", F.size("embedding").alias("size"))


@query(f"""WITH RECURSIVE {chunk_sql("SELECT coalesce(source, 'none') || ':u' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, coalesce(text, '') AS text FROM documents")} SELECT chunk_id, parent_chunk_id, role, chunk_index, sha256(text) AS text FROM made""")
def chunks_by_sql(spark, sf_dir):
    """The documents of a source as its units, in order, cut by a table function that SQL calls."""
    table_functions.register(spark)
    units = load(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("slug"), F.lit(None).cast("int").alias("page"), "doc_id", "text")
    return spark.sql("SELECT chunk_id, parent_chunk_id, role, chunk_index, sha2(text, 256) AS text FROM chunk_units(TABLE(SELECT * FROM {units}) PARTITION BY slug ORDER BY doc_id)", units=units)
