"""Queries over printed invoices and supporting documents, pages, tables, files and their upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, chunking, extraction, matching, reconcile, supporting
from ..functions import predicates as P
from ..session import load
from ..sources import files
from . import shipment_queries as S
from . import views
from .assistant_queries import listed, lit
from .registry import registry

QUERIES, ORACLES, query = registry()

at = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))


def invoices(spark, sf_dir):
    """(doc_id, text): an invoice for each order, its 21 labelled fields in one of three layouts, and a bare unit.

    Nations are spelled with letters for their digits, as a country is.

    Every seventh has a second number, every eleventh no Form-E; every fifth date is in figures.
    """
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, nation, text = F.col("o_orderkey"), F.translate("n_name", "0123456789_", "abcdefghij "), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    day = F.to_date("o_orderdate")
    fields = (
        ("Commercial Invoice No.", text("INV-", k)), ("Invoice Date", F.when(k % 5 == 4, F.date_format(day, "dd/MM/yyyy")).otherwise(day.cast("string"))), ("Exporter Name", F.col("c_name")), ("Address of Exporter", text("Plot ", F.col("o_custkey"), ", ", nation)),
        ("NTN No", text(F.lpad(F.col("o_custkey").cast("string"), 7, "0"), "-", k % 10)), ("Buyer / Consignee", text("House of ", nation)), ("Address of Consignee", text("Road ", k % 100 + 1, ", ", nation)), ("Country of Origin", F.lit("Pakistan")), ("Destination Country", nation),
        ("Port of Loading", F.lit("Karachi")), ("Port of Discharge", nation), ("Incoterms 2020", F.lit("FOB Karachi")), ("Currency", F.lit("USD")), ("Grand Total", F.format_string("USD %.2f", "o_totalprice")), ("Gross Weight", text(k % 500 + 10, ".50 KG")), ("Net Weight", text(k % 500 + 1, ".25 KG")),
        ("No. of Packages", text(k % 90 + 1, " CARTONS")), ("Bill of Lading No", text("HLCU", k)), ("GD No", text("KAPE-", k)), ("Form-E No", F.when(k % 11 != 0, text("FE-", k))), ("HS Code", F.lit("6109.10.00")),
    )
    line = lambda label, v: F.concat(F.lit(label), F.when(k % 3 == 0, "\n").when(k % 3 == 1, ": ").otherwise("  "), v)
    lines = F.concat_ws("\n", *[line(*f) for f in fields], F.lit("Sold in PCS only"), F.when(k % 7 == 0, "Invoice No: OTHER-1"))
    # a small table makes much text: deal its rows out before the texts are read
    return o.select(k.alias("doc_id"), lines.alias("text")).repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")


INVOICES = """
  o AS (SELECT o_orderkey AS k, o_custkey AS cust, c_name, translate(n_name, '0123456789_', 'abcdefghij ') AS n_name, o_totalprice AS total, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT *, k % 5 = 4 AND day(d) <= 12 AND day(d) <> month(d) AS unclear FROM o),
  f AS (SELECT k, unnest(['invoice_number', 'invoice_date', 'exporter_name', 'exporter_address', 'exporter_ntn', 'consignee_name', 'consignee_address', 'country_of_origin', 'country_of_destination', 'port_of_loading', 'port_of_discharge', 'incoterm', 'currency', 'total_invoice_value', 'gross_weight', 'net_weight', 'number_of_packages', 'bl_awb_number', 'gd_number', 'form_e_number', 'pct_code', 'unit']) AS field,
    unnest([CASE WHEN k % 7 = 0 AND k % 3 = 2 THEN 'OTHER-1' ELSE 'INV-' || k END, CASE WHEN unclear THEN strftime(d, '%d/%m/%Y') ELSE CAST(d AS VARCHAR) END, c_name, 'Plot ' || cust || ', ' || n_name, lpad(CAST(cust AS VARCHAR), 7, '0') || '-' || (k % 10), 'House of ' || n_name, 'Road ' || (k % 100 + 1) || ', ' || n_name, 'Pakistan', n_name, 'Karachi', n_name, 'FOB KARACHI', 'USD',
      printf('%.2f', total), (k % 500 + 10) || '.50', (k % 500 + 1) || '.25', CAST(k % 90 + 1 AS VARCHAR), 'HLCU' || k, 'KAPE-' || k, CASE WHEN k % 11 <> 0 THEN 'FE-' || k END, '61091000', 'KG']) AS value,
    unnest([CASE WHEN k % 7 = 0 THEN 'low' ELSE 'high' END, CASE WHEN unclear THEN 'low' ELSE 'high' END, 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', 'high', CASE WHEN k % 11 = 0 THEN 'missing' ELSE 'high' END, 'high', 'low']) AS grade FROM p)"""


@query(f"WITH {INVOICES} SELECT k AS doc_id, field, value, grade FROM f")
def invoice_fields(spark, sf_dir):
    docs = invoices(spark, sf_dir)
    return extraction.graded(docs).select("doc_id", "field", "value", "grade")


@query(f"WITH {INVOICES} SELECT field, count(*) AS total, count(*) FILTER (WHERE grade = 'high') AS resolved, round(avg(CASE WHEN grade = 'high' THEN 1 ELSE 0 END), 4) AS coverage FROM f GROUP BY 1")
def invoice_coverage(spark, sf_dir):
    docs = invoices(spark, sf_dir)
    return extraction.coverage(extraction.graded(docs))


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part), r AS (SELECT k, unnest(['exporter_or_applicant', 'amount', 'destination_country', 'pct_code', 'currency', 'buyer_or_beneficiary', 'product_or_commodity']) AS field, unnest([n, CAST(k AS VARCHAR) || '.00', 'FRANCE', '6109.10.00', 'USD', 'House', 'cotton']) AS value,
  unnest(['Exporter / Applicant', 'Declared Amount', 'Country of Destination', 'HS Code', 'Currency', 'B u y e r', 'Goods']) AS label, unnest([2, 0, 1, 2, 0, 4, 5]) AS priority, unnest(['explicit', 'table', 'next_line', 'whitespace', 'explicit', 'explicit', 'next_line']) AS layout, unnest([0.99, 0.99, 0.98, 0.94, 0.99, 0.90, 0.98]) AS c FROM p)
SELECT k AS doc_id, CAST(1 AS INTEGER) AS page, field, value, label, CAST(priority AS INTEGER) AS priority, layout, CAST(CASE WHEN k % 2 = 0 THEN least(c, 0.90) ELSE c END AS DOUBLE) AS confidence FROM r""")
def label_candidates(spark, sf_dir):
    k = F.col("p_partkey")
    lines = (F.concat(F.lit("Exporter / Applicant: "), "p_name"), F.concat(F.lit("| Declared Amount | "), k.cast("string"), F.lit(".00 | x")), F.lit("Country of Destination\n\n  FRANCE"), F.lit("HS Code 6109.10.00"), F.lit("(3) Currency: USD"), F.lit("B u y e r: House"), F.lit("Quantity:\nGoods\ncotton"), F.lit("nothing else"))
    pages = load(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text"), (k % 2 == 0).alias("is_ocr"))
    # as with invoices: dealt out before the texts are read
    return extraction.label_candidates(pages.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents), a AS (SELECT doc_id, n, unnest([n // 3, n // 2, n]) AS place FROM d WHERE doc_id % 3 = 0), s AS (SELECT DISTINCT doc_id, greatest(place - 400, 0) AS s, least(place + 400, n) AS e FROM a), m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM m), w AS (SELECT doc_id, g, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2), c AS (SELECT doc_id, string_agg(substr(text, s + 1, e - s), chr(10) || '---' || chr(10) ORDER BY s, e) AS c FROM w JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, sha256(substr(coalesce(c, substr(text, 1, 1500)), 1, 2000)) AS context FROM d LEFT JOIN c USING (doc_id)""")
def gap_contexts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    anchors = docs.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array_distinct(F.array(F.floor(n / 3), F.floor(n / 2), n))).alias("place"))
    return extraction.gap_context(docs, anchors).select("doc_id", F.sha2("context", 256).alias("context"))


NOTES = ("hybrid extractor: regex_labeled", "supporting_hybrid:llm_gapfill x", "supporting_hybrid:ocr_regex", "hybrid extractor: unresolved", "a note", None)


@query(f"""
WITH p AS (SELECT doc_id // 3 AS doc, doc_id % 3 AS page, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 20 AND doc_id % 7 <> 0 AS useful, doc_id % 4 = 0 AS ocr, doc_id % 5 <> 0 AS high, doc_id % 6 <> 0 AS ok FROM documents), w AS (SELECT doc, bool_or(useful) AS texts FROM p GROUP BY 1),
c AS (SELECT doc_id // 3 AS doc, 'f' || (doc_id % 3) AS field, CASE WHEN doc_id % 8 = 0 THEN 7 ELSE doc_id % 3 END AS page, doc_id, doc_id % 9 <> 0 AS sure, ([{', '.join('NULL' if n is None else lit(n) for n in NOTES)}])[doc_id % 6 + 1] AS note FROM documents),
j AS (SELECT c.*, coalesce(p.useful, false) AND sure AND (NOT coalesce(ocr, false) OR high AND ok) AS good, coalesce(ocr, false) AS ocr, texts, (['regex_label', 'llm_gapfill', 'ocr_regex', 'unresolved', 'pdf_text_llm_structured_output', 'pdf_text_llm_structured_output'])[doc_id % 6 + 1] AS m FROM c LEFT JOIN p USING (doc, page) LEFT JOIN w USING (doc))
SELECT doc AS doc_id, field, CASE WHEN good THEN 'v' || doc_id END AS value, CASE WHEN good THEN 'verified' ELSE 'manual_review' END AS status, CASE WHEN NOT good AND NOT texts THEN 'not_extracted_ocr_required' WHEN ocr THEN CASE m WHEN 'regex_label' THEN 'ocr_regex' WHEN 'llm_gapfill' THEN 'llm_gapfill' ELSE 'tesseract_ocr_llm_structured_output' END ELSE m END AS method FROM j""")
def page_gate(spark, sf_dir):
    k = F.col("doc_id")
    docs = load(spark, sf_dir, "documents")
    pages = docs.select(F.floor(k / 3).alias("doc_id"), (k % 3).cast("int").alias("page"), F.when(k % 7 != 0, F.col("text")).alias("text"), (k % 4 == 0).alias("is_ocr"), F.when(k % 5 != 0, 0.9).otherwise(0.7).alias("ocr_confidence"), (k % 6 != 0).alias("ocr_verified"))
    found = docs.select(F.floor(k / 3).alias("doc_id"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("field"), F.concat(F.lit("v"), k.cast("string")).alias("value"), F.when(k % 8 == 0, 7).otherwise(k % 3).cast("int").alias("page"), F.when(k % 9 != 0, 0.85).otherwise(0.5).alias("confidence"), F.lit("verified").alias("status"), at(NOTES, k).alias("note"))
    return extraction.materialised(found, pages)


@query("""
WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS n, p_size AS s, p_partkey % 4 = 0 AS bad FROM part), r AS (SELECT k, 1 AS row, n, s, bad FROM p UNION ALL SELECT k, 2, n || ' two', s + 1, false FROM p WHERE k % 3 = 0)
SELECT k AS doc_id, CAST(1 AS INTEGER) AS page, CAST(row AS INTEGER) AS row, unnest(['description', 'line_total', 'pct_code', 'quantity']) AS "column", unnest([n, (s * 2) || '.50', '61091000', CASE WHEN bad THEN 'n/a' ELSE CAST(s AS VARCHAR) END]) AS cell, unnest(['high', 'high', 'high', CASE WHEN bad THEN 'low' ELSE 'high' END]) AS grade FROM r""")
def stacked_items(spark, sf_dir):
    """Tables of one or two items printed one cell to a line, below a title and above the totals."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.substring_index("p_name", " ", 1)
    row = lambda n, q, size: F.concat_ws("\n", n, F.lit("6109.10.00"), q, F.concat(F.lit("USD "), (size * 2).cast("string"), F.lit(".50")), F.lit("12 KG"))
    text = F.concat_ws("\n", F.lit("Invoice\n\nProduct Description\nPCT Code\nQuantity\nLine Total\nNet Weight"), row(name, F.when(k % 4 == 0, "n/a").otherwise(s.cast("string")), s), F.when(k % 3 == 0, row(F.concat(name, F.lit(" two")), (s + 1).cast("string"), s + 1)), F.lit("Total\n9\n9\n9\n9"))
    return extraction.stacked_tables(load(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text")))


KINDS = tuple(P.SUPPORTING_TYPES)


@query(f"""
WITH o AS (SELECT o_orderkey AS k, ({listed(KINDS)})[o_orderkey % {len(KINDS)} + 1] AS type, o_orderkey % 13 = 0 AS soft FROM orders), c AS (SELECT k, type, soft, [
  ['exporter_match', CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'passed' END], CASE WHEN type IN ('form_e_or_psw_export_declaration', 'sbp_deposit_proof', 'sbp_confirmation', 'goods_declaration') THEN ['invoice_reference_match', CASE WHEN k % 7 = 0 THEN 'manual_review' ELSE 'passed' END] END,
  CASE WHEN type IN ('certificate_of_origin', 'phytosanitary_certificate', 'importing_country_permit') THEN ['destination_match', CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'passed' END] END, CASE WHEN k % 4 <> 0 THEN ['pct_match', CASE WHEN k % 9 = 0 THEN 'failed' ELSE 'passed' END] END,
  CASE WHEN type = 'irrevocable_letter_of_credit' THEN ['beneficiary_match', CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'passed' END] END, CASE WHEN type = 'irrevocable_letter_of_credit' THEN ['shipment_deadline', CASE WHEN k % 6 = 0 THEN 'manual_review' WHEN k % 8 = 0 THEN 'failed' ELSE 'passed' END] END,
  CASE WHEN type = 'irrevocable_letter_of_credit' AND k % 11 <> 0 THEN ['amount_cover', CASE WHEN k % 10 = 4 AND k % 20 = 4 THEN 'failed' ELSE 'passed' END] END, CASE WHEN type = 'sbp_confirmation' THEN ['related_deposit_match', CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'passed' END] END,
  CASE WHEN type IN ('form_e_or_psw_export_declaration', 'goods_declaration') THEN ['amount_match', CASE WHEN k % 11 = 0 THEN 'manual_review' WHEN k % 20 = 4 THEN 'failed' ELSE 'passed' END] END, CASE WHEN k % 2 = 0 THEN ['currency_match', CASE WHEN k % 12 = 0 THEN 'failed' ELSE 'passed' END] END,
  CASE WHEN type = 'phytosanitary_certificate' THEN ['commodity_match', CASE WHEN k % 15 = 0 THEN 'failed' ELSE 'passed' END] END, CASE WHEN type = 'sbp_deposit_proof' THEN ['deposit_percentage', CASE WHEN k % 7 = 0 THEN 'manual_review' WHEN k % 3 = 0 THEN 'failed' ELSE 'passed' END] END,
  CASE WHEN k % 6 <> 1 THEN ['not_expired', CASE WHEN k % 14 = 0 THEN 'failed' ELSE 'passed' END] END] AS cs FROM o), u AS (SELECT k, type, soft, unnest(list_filter(cs, lambda x: x IS NOT NULL)) AS c FROM c)
SELECT k AS shipment_id, type, c[1] AS "check", CASE WHEN soft AND c[2] = 'failed' THEN 'manual_review' ELSE c[2] END AS status FROM u""")
def supporting_comparisons(spark, sf_dir):
    """A supporting document of each order, one type after another; what differs follows the order's number."""
    k = F.col("shipment_id")
    ships = views.shipments(spark, sf_dir)
    shipments = ships.select("shipment_id", F.concat("exporter", F.lit(" (Private) Limited")).alias("s_exporter"), F.concat(F.lit("INV-"), k.cast("string")).alias("s_invoice"), F.col("destination").alias("s_destination"), F.col("code").alias("s_code"), F.col("shipment_date").alias("s_date"), F.col("amount").alias("s_total"), F.lit("DEP-1").alias("s_deposit"), F.lit("usd").alias("s_currency"), F.lit("Raw cotton").alias("s_product"))
    documents = ships.select(
        "shipment_id", at(KINDS, k).alias("type"), F.when(k % 5 == 0, "Other").otherwise(F.concat(F.upper("exporter"), F.lit("  PVT. LTD."))).alias("exporter"), F.when(k % 7 != 0, F.concat(F.lit("inv-"), k.cast("string"), F.lit("."))).alias("invoice_reference"), F.when(k % 3 == 0, "NOWHERE").otherwise(F.lower("destination")).alias("destination"),
        F.when(k % 4 != 0, F.when(k % 9 == 0, "00000000").otherwise(F.concat_ws(".", F.substring("code", 1, 4), F.substring("code", 5, 4)))).alias("code"), F.when(k % 6 != 0, F.date_add("shipment_date", F.when(k % 8 == 0, -1).otherwise(0))).alias("deadline"), F.when(k % 11 != 0, F.when(k % 20 == 4, F.col("amount") - 1).otherwise(F.col("amount"))).alias("amount"),
        F.when(k % 3 == 0, "DEP-2").otherwise("dep-1").alias("related_reference"), F.when(k % 2 == 0, F.when(k % 12 == 0, "EUR").otherwise("USD")).alias("currency"), F.when(k % 15 == 0, "Yarn").otherwise("RAW  COTTON!").alias("commodity"), F.when(k % 7 != 0, F.when(k % 3 == 0, 2).otherwise(1)).alias("percentage"),
        F.when(k % 6 != 1, F.when(k % 14 == 0, F.lit("2026-01-01")).otherwise(F.lit("2026-12-31")).cast("date")).alias("expiry"), F.when(k % 13 == 0, 0.74).otherwise(0.75).alias("ocr_confidence"),
    )
    return supporting.comparisons(documents, shipments, "2026-07-22")


@query(f"""
WITH r AS (SELECT o_custkey AS id, ({listed(KINDS)})[o_orderkey % {len(KINDS)} + 1] AS type, o_orderkey % 4 <> 0 AS known, o_orderkey % 3 <> 0 AS good FROM orders), n(type, name) AS (VALUES {', '.join(f'({lit(k)}, {lit(x)})' for k, xs in P.SUPPORTING_TYPES.items() for x in dict.fromkeys([k, *xs]))})
SELECT id AS shipment_id, name, bool_or(good) AS verified FROM r JOIN n USING (type) WHERE known GROUP BY 1, 2""")
def presence_names(spark, sf_dir):
    k = F.col("o_orderkey")
    results = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shipment_id"), at(KINDS, k).alias("type"), F.when(k % 4 == 0, "claimed_only").otherwise("fields_verified").alias("state"), F.when(k % 3 == 0, "failed").otherwise("passed").alias("content_status"))
    return supporting.presence_names(results)


@query("""
WITH l AS (SELECT l_orderkey AS k, list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ps, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS cs FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1),
o AS (SELECT o_orderkey AS k, c_name, n_name, (['passed', 'failed', NULL])[o_orderkey % 3 + 1] AS s, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'Net Weight differs' END, CASE WHEN o_orderkey % 5 = 0 THEN 'quantity differs' END, CASE WHEN o_orderkey % 10 = 0 THEN 'quantity differs' END], lambda x: x IS NOT NULL) AS m, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'sum' END], lambda x: x IS NOT NULL) AS e FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
j AS (SELECT o.*, list_filter(ps, lambda x, i: list_position(ps, x) = i) AS p, list_filter(cs, lambda x, i: list_position(cs, x) = i) AS c, list_concat(m, e) AS f FROM o LEFT JOIN l USING (k))
SELECT k AS shipment_id, sha256(concat_ws(chr(10), 'Shipment ID: ' || k, 'Exporter: ' || c_name, 'Destination: ' || CASE WHEN k % 4 = 0 THEN 'unknown' ELSE n_name END, 'Products: ' || coalesce(nullif(array_to_string(p, ', '), ''), 'none recorded'), 'PCT codes: ' || coalesce(nullif(array_to_string(c, ', '), ''), 'none recorded'), 'Compliance status: ' || coalesce(s, 'unknown'),
  'Failed checks: ' || coalesce(nullif(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '; '), ''), 'none'), 'Weight discrepancies: ' || CASE WHEN k % 2 = 0 THEN 'Net Weight differs' ELSE 'none' END, 'Quantity discrepancies: ' || CASE WHEN k % 10 = 0 THEN 'quantity differs; quantity differs' WHEN k % 5 = 0 THEN 'quantity differs' ELSE 'none' END, 'Human review: ' || CASE WHEN k % 6 = 0 THEN 'required' ELSE 'not required' END)) AS checksum FROM j""")
def audit_summaries(spark, sf_dir):
    k = F.col("shipment_id")
    items = views.invoice_items(spark, sf_dir).groupBy("shipment_id").agg(F.array_sort(F.collect_list(F.struct("item_index", "product", F.col("code").cast("string").alias("code")))).alias("_i"))
    some = lambda *xs: F.array_compact(F.array(*[F.when(k % n == 0, x) for n, x in xs]))
    empty = F.array().cast("array<string>")
    reports = views.shipments(spark, sf_dir).join(items, "shipment_id", "left").select(
        "shipment_id", "exporter", F.when(k % 4 != 0, F.col("destination")).alias("destination"), F.coalesce(F.transform("_i", lambda i: i["product"]), empty).alias("products"), F.coalesce(F.transform("_i", lambda i: i["code"]), empty).alias("codes"), at(("passed", "failed", None), k).alias("status"),
        some((2, F.lit("Net Weight differs")), (5, F.lit("quantity differs")), (10, F.lit("quantity differs"))).alias("mismatches"), some((7, F.lit("sum"))).alias("calculation_errors"), empty.alias("regulatory_problems"), (k % 6 == 0).alias("needs_review"),
    )
    return chunking.audit_summary(reports).select("shipment_id", "checksum")


@query("""SELECT * FROM (VALUES ('nation.parquet', NULL, 'unknown content'), ('region.parquet', NULL, 'unknown content'), ('benchmark.parquet', NULL, 'unknown content')) t(file_name, kind, refused)""")
def refused_uploads(spark, sf_dir):
    """The small tables' files taken as uploads: their content is none that is accepted, whatever it is called."""
    return files.uploads(spark, f"{sf_dir}/{{nation,region,benchmark}}.parquet").select("file_name", "kind", "refused")


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_partkey % 3 <> 0), m AS (SELECT p_partkey AS code FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey FROM part WHERE p_size > 48), r AS (SELECT p_partkey AS code FROM part WHERE p_size < 45)
SELECT code, 'no metadata' AS problem FROM c WHERE code NOT IN (SELECT code FROM m) UNION ALL SELECT code, 'no requirements' FROM c WHERE code NOT IN (SELECT code FROM r) UNION ALL SELECT DISTINCT code, 'metadata of no code' FROM m WHERE code NOT IN (SELECT code FROM c)
UNION ALL SELECT code, 'requirements of no code' FROM r WHERE code NOT IN (SELECT code FROM c) UNION ALL SELECT code, 'metadata repeated' FROM m GROUP BY 1 HAVING count(*) > 1""")
def config_problems(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), "p_size")
    codes = load(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("code")).distinct()
    return files.config_problems(codes, part.where("p_size > 5").unionByName(part.where("p_size > 48")), part.where("p_size < 45"))


@query("""
WITH t AS (SELECT page_id FROM pages WHERE page_id % 5 <> 0)
SELECT page_id, 'SRO ' || page_id AS number, 'Notice ' || (page_id % 7) AS title, CASE WHEN page_id % 3 = 0 THEN 'not dated' ELSE '2025-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS date FROM t""")
def page_notices(spark, sf_dir):
    """A table of notices at the end of each page's own HTML; every fifth page has it under other headings."""
    k = F.col("page_id")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    day = F.format_string("Mar %d, 2025", k % 28 + 1)
    head = F.concat(F.lit("<table><tr><th> No</th><th>Title</th><th>"), F.when(k % 5 == 0, "Picture").otherwise("File"), F.lit("</th><th>Date</th></tr><tr class='x'>"))
    row = F.concat(head, cell(F.concat(F.lit("SRO <b>"), k.cast("string"), F.lit("</b>"))), cell(F.concat(F.lit(" Notice  "), (k % 7).cast("string"))), cell(F.lit("pdf")), cell(F.when(k % 3 == 0, "not dated").otherwise(day)), F.lit("</tr></table>"))
    pages = load(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), row).alias("html"))
    return files.html_table(pages, headings=("No", "Title", "File", "Date")).where("number like 'SRO %'").select("page_id", "number", "title", "date")


@query(f"""
WITH {S.MATCHES}, c AS (SELECT m.shipment_id, m.invoice_index, a.units = b.units AS q, a.code IS NOT NULL AND b.code IS NOT NULL AND a.code = b.code AS p FROM matches m JOIN invoice a ON a.shipment_id = m.shipment_id AND a.item_index = m.invoice_index JOIN packing b ON b.shipment_id = m.shipment_id AND b.item_index = m.packing_index)
SELECT i.shipment_id, i.item_index, CASE WHEN q THEN CAST(i.units AS DOUBLE) END AS quantity, CASE WHEN p THEN i.code END AS code FROM invoice i LEFT JOIN c ON c.shipment_id = i.shipment_id AND c.invoice_index = i.item_index""")
def strict_handoff(spark, sf_dir):
    """As the mask of several lines, but a check that did not apply allows nothing."""
    invoice, packing = S._items(spark, sf_dir)
    return reconcile.masked(invoice, reconcile.item_comparisons(matching.match_items(invoice, packing), invoice, packing), strict=True)


@query("""SELECT user_id, max(struct_pack(t := ts, e := event_id)).e AS event_id FROM events WHERE event_type = 'click' GROUP BY 1""")
def open_tasks(spark, sf_dir):
    """The newest open task of each workflow; clicks stand for open ones."""
    return audit.latest(load(spark, sf_dir, "events").where("event_type = 'click'"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


def _schema_sql(schema) -> str:
    return f"(VALUES {', '.join(f'({lit(a)}, {lit(b)})' for a, b in schema.items())})"


@query(f"""
WITH {INVOICES}, m(source, target) AS {_schema_sql({"exporter_name": "exporter_name", "consignee_name": "buyer_name", "invoice_number": "invoice_number", "invoice_date": "invoice_date", "currency": "currency", "country_of_destination": "destination_country", "total_invoice_value": "invoice_total", "net_weight": "declared_net_weight_total", "gross_weight": "declared_gross_weight_total"})}
SELECT k AS doc_id, target AS field, CASE WHEN grade = 'high' THEN value END AS value, CASE WHEN grade = 'high' THEN 0.95::DOUBLE ELSE 0::DOUBLE END AS confidence, CASE WHEN grade = 'high' THEN 'verified' ELSE 'manual_review' END AS validation_status,
  CASE WHEN grade = 'high' THEN 'regex_labeled' ELSE 'more than one reading, or an unsure one' END AS note FROM f JOIN m ON field = source""")
def invoice_candidates(spark, sf_dir):
    """Each invoice as the schema of invoices asks for it."""
    found = extraction.schema_candidates(extraction.graded(invoices(spark, sf_dir)), extraction.INVOICE_SCHEMA)
    return found.select("doc_id", "field", "value", F.col("confidence").cast("double").alias("confidence"), "validation_status", "note")


@query(f"""
WITH {S.INVOICE}, c AS (SELECT shipment_id AS doc_id, item_index AS line_number, unnest(['line_number', 'product_name', 'pct_code', 'quantity', 'unit', 'unit_price', 'line_total', 'net_weight', 'gross_weight']) AS field,
  unnest([CAST(item_index AS VARCHAR), product, CAST(code AS VARCHAR), CASE WHEN item_index % 3 = 0 THEN 'about ' ELSE '' END || units, NULL, printf('%d.%02d', price_cents // 100, price_cents % 100), printf('%d.%02d', cents // 100, cents % 100), NULL, NULL]) AS raw FROM invoice)
SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, field, CASE WHEN raw NOT LIKE 'about %' THEN raw END AS value, CASE WHEN raw IS NULL OR raw LIKE 'about %' THEN 0::DOUBLE ELSE 0.95::DOUBLE END AS confidence, CASE WHEN raw IS NULL OR raw LIKE 'about %' THEN 'manual_review' ELSE 'verified' END AS validation_status,
  CASE WHEN field = 'line_number' THEN 'table row position' WHEN field IN ('net_weight', 'gross_weight') THEN 'not a reconstructed column on this table' WHEN raw IS NULL THEN 'not found in the document'
    WHEN raw LIKE 'about %' THEN '''' || raw || ''' could not be converted to the type this field requires' ELSE 'regex_table' END AS note FROM c""")
def invoice_line_candidates(spark, sf_dir):
    """The rows of invoices' tables as the schema of lines asks for them; every third quantity is no number."""
    i = F.col("item_index")
    rows = views.invoice_items(spark, sf_dir).select(
        F.col("shipment_id").alias("doc_id"), i.alias("item_index"), F.col("product").alias("description"), F.col("code").cast("string").alias("pct_code"),
        F.concat(F.when(i % 3 == 0, "about ").otherwise(""), F.col("quantity").cast("long").cast("string")).alias("quantity"), F.lit(None).cast("string").alias("unit"), F.col("unit_price").cast("string").alias("unit_price"), F.col("line_total").cast("string").alias("line_total"),
    )
    found = extraction.line_candidates(rows, ("net_weight", "gross_weight"))
    return found.select("doc_id", F.col("line_number").cast("int").alias("line_number"), "field", "value", F.col("confidence").cast("double").alias("confidence"), "validation_status", "note")
