"""Queries over invoices, packing lists, shipments and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, reconcile, rules
from ..session import load
from . import views
from .registry import registry

QUERIES, ORACLES, query = registry()

INVOICE = """
  inv AS (
    SELECT l_orderkey AS shipment_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS item_index,
           l_linenumber AS line_ref, l_partkey AS code, p_name AS product, CAST(l_quantity AS BIGINT) AS units, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  ), invoice AS (
    SELECT *, (2 * cents + units) // (2 * units) AS price_cents, CASE WHEN item_index % 5 <> 0 THEN units * 2 END AS net,
           CASE WHEN item_index % 7 <> 0 THEN units * 2 + line_ref - 2 END AS gross FROM inv
  )"""
PACKING = INVOICE + """, packing AS (
    SELECT shipment_id, item_index, CASE WHEN item_index % 4 <> 0 THEN line_ref END AS line_ref, CASE WHEN item_index % 8 <> 0 THEN code END AS code, product,
           units + CASE WHEN item_index % 6 = 0 THEN 1 ELSE 0 END AS units, net, CASE WHEN item_index % 10 <> 0 THEN gross END AS gross
    FROM invoice WHERE (shipment_id * 31 + item_index * 7) % 9 <> 0
  )"""


def _pass(name: str, key: str, left: str, right: str) -> str:
    return f"""
  {name}_a AS (SELECT shipment_id, {key}, min(item_index) AS i FROM {left} WHERE {key} IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
  {name}_b AS (SELECT shipment_id, {key}, min(item_index) AS p FROM {right} WHERE {key} IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
  {name} AS (SELECT shipment_id, i, p FROM {name}_a JOIN {name}_b USING (shipment_id, {key})),
  {name}_l AS (SELECT * FROM {left} x WHERE NOT EXISTS (SELECT 1 FROM {name} m WHERE m.shipment_id = x.shipment_id AND m.i = x.item_index)),
  {name}_r AS (SELECT * FROM {right} x WHERE NOT EXISTS (SELECT 1 FROM {name} m WHERE m.shipment_id = x.shipment_id AND m.p = x.item_index))"""


MATCHES = PACKING + "," + ",".join([_pass("m1", "line_ref", "invoice", "packing"), _pass("m2", "code", "m1_l", "m1_r"), _pass("m3", "product", "m2_l", "m2_r")]) + """,
  matches AS (
    SELECT shipment_id, i AS invoice_index, p AS packing_index, 'matched' AS match_status, 'line_reference' AS strategy FROM m1
    UNION ALL SELECT shipment_id, i, p, 'matched', 'pct_code' FROM m2 UNION ALL SELECT shipment_id, i, p, 'matched', 'product' FROM m3
    UNION ALL SELECT shipment_id, item_index, NULL, 'invoice_only', NULL FROM m3_l UNION ALL SELECT shipment_id, NULL, item_index, 'packing_only', NULL FROM m3_r
  )"""


def _items(spark, sf_dir):
    invoice = views.invoice_items(spark, sf_dir)
    return invoice, views.packing_items(invoice)


@query(f"""
WITH {INVOICE}, s AS (
  SELECT shipment_id, sum(cents) AS c, count(*) AS n, count(*) FILTER (WHERE abs(units * price_cents - cents) > 1) AS bad FROM invoice GROUP BY 1
), h AS (
  SELECT o_orderkey AS shipment_id, c, n, bad, CASE WHEN o_orderkey % 7 <> 0 THEN coalesce(c, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END END AS declared
  FROM orders LEFT JOIN s ON shipment_id = o_orderkey
), t AS (SELECT *, CASE WHEN declared IS NULL OR n IS NULL THEN 'manual_review' WHEN abs(c - declared) <= 1 THEN 'passed' ELSE 'failed' END AS total_status FROM h)
SELECT shipment_id, declared / 100.0 AS declared_total, CAST(c AS DOUBLE) / 100.0 AS line_sum, coalesce(n, 0) AS lines, coalesce(bad, 0) AS failed_lines, total_status,
       CASE WHEN n IS NULL THEN 'manual_review' WHEN total_status = 'failed' OR bad > 0 THEN 'failed' ELSE total_status END AS overall_status
FROM t""")
def order_reconciliation(spark, sf_dir):
    invoice = views.invoice_items(spark, sf_dir)
    return reconcile.order_reconciliation(invoice, views.invoice_header(invoice, load(spark, sf_dir, "orders")))


@query(f"""
WITH {INVOICE}
SELECT shipment_id, item_index, CASE WHEN units > 0 THEN 'passed' ELSE 'failed' END AS positive_quantity, CASE WHEN price_cents > 0 THEN 'passed' ELSE 'failed' END AS positive_price,
       CASE WHEN abs(units * price_cents - cents) <= 1 THEN 'passed' ELSE 'failed' END AS product_calculation,
       CASE WHEN abs(units * price_cents - cents) <= 1 THEN 'passed' ELSE 'failed' END AS item_calculation,
       CASE WHEN net IS NULL OR gross IS NULL THEN 'not_applicable' WHEN gross >= net THEN 'passed' ELSE 'failed' END AS weight_consistency
FROM invoice""")
def line_checks(spark, sf_dir):
    return reconcile.line_checks(views.invoice_items(spark, sf_dir))


@query(f"""
WITH {INVOICE}, h AS (SELECT shipment_id, item_index, units * price_cents AS v FROM invoice)
SELECT shipment_id, item_index, ((v + 1) // 2) / 100.0 AS engine, CASE WHEN v % 2 = 0 THEN v // 2 WHEN (v // 2) % 2 = 0 THEN v // 2 ELSE v // 2 + 1 END / 100.0 AS audit,
       (v + 1) // 2 = CASE WHEN v % 2 = 0 THEN v // 2 WHEN (v // 2) % 2 = 0 THEN v // 2 ELSE v // 2 + 1 END AS agreed FROM h""")
def rederived_halves(spark, sf_dir):
    return reconcile.rederived(views.invoice_items(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT * FROM matches")
def item_matching(spark, sf_dir):
    return matching.match_items(*_items(spark, sf_dir)).select("shipment_id", "invoice_index", "packing_index", "match_status", "strategy")


@query(f"""
WITH {MATCHES}
SELECT shipment_id, invoice_index, packing_index, row_number() OVER (PARTITION BY shipment_id
  ORDER BY CASE WHEN match_status = 'matched' THEN 0 ELSE 1 END, coalesce(invoice_index, 10000), coalesce(packing_index, 10000)) AS position FROM matches""")
def match_order(spark, sf_dir):
    return matching.in_order(matching.match_items(*_items(spark, sf_dir))).select("shipment_id", "invoice_index", "packing_index", "position")


@query(f"""
WITH {MATCHES}, j AS (
  SELECT m.shipment_id, m.invoice_index, m.packing_index, a.units AS au, b.units AS bu, a.net AS an, b.net AS bn, a.gross AS ag, b.gross AS bg, a.code AS ac, b.code AS bc
  FROM matches m JOIN invoice a ON a.shipment_id = m.shipment_id AND a.item_index = m.invoice_index JOIN packing b ON b.shipment_id = m.shipment_id AND b.item_index = m.packing_index
)
SELECT shipment_id, invoice_index, packing_index, 'item_quantity_match' AS check_id, CASE WHEN au = bu THEN 'passed' ELSE 'failed' END AS status FROM j
UNION ALL SELECT shipment_id, invoice_index, packing_index, 'item_net_weight_match', CASE WHEN an IS NULL AND bn IS NULL THEN 'not_applicable' WHEN an IS NULL OR bn IS NULL THEN 'manual_review' WHEN an = bn THEN 'passed' ELSE 'failed' END FROM j
UNION ALL SELECT shipment_id, invoice_index, packing_index, 'item_gross_weight_match', CASE WHEN ag IS NULL AND bg IS NULL THEN 'not_applicable' WHEN ag IS NULL OR bg IS NULL THEN 'manual_review' WHEN ag = bg THEN 'passed' ELSE 'failed' END FROM j
UNION ALL SELECT shipment_id, invoice_index, packing_index, 'item_pct_match', CASE WHEN ac IS NULL OR bc IS NULL THEN 'not_applicable' WHEN ac = bc THEN 'passed' ELSE 'failed' END FROM j""")
def item_comparisons(spark, sf_dir):
    invoice, packing = _items(spark, sf_dir)
    return reconcile.item_comparisons(matching.match_items(invoice, packing), invoice, packing)


@query(f"""
WITH {MATCHES}
SELECT shipment_id, count(*) FILTER (WHERE match_status = 'matched') AS matched, count(*) FILTER (WHERE match_status = 'invoice_only') AS invoice_only,
       count(*) FILTER (WHERE match_status = 'packing_only') AS packing_only, CASE WHEN count(*) FILTER (WHERE match_status <> 'matched') > 0 THEN 'failed' ELSE 'passed' END AS status
FROM matches GROUP BY 1""")
def single_document_items(spark, sf_dir):
    return reconcile.single_document_items(matching.match_items(*_items(spark, sf_dir)))


@query(f"""
WITH {INVOICE}, refs AS (SELECT shipment_id, 'line_reference' AS kind, string_agg(item_index, ',' ORDER BY item_index) AS positions, count(*) AS n FROM invoice WHERE line_ref IS NOT NULL GROUP BY shipment_id, line_ref HAVING count(*) > 1),
sig AS (SELECT shipment_id, 'signature' AS kind, string_agg(item_index, ',' ORDER BY item_index) AS positions, count(*) AS n FROM invoice WHERE product IS NOT NULL OR code IS NOT NULL GROUP BY shipment_id, product, code, units, price_cents HAVING count(*) > 1)
SELECT * FROM refs UNION ALL SELECT * FROM sig""")
def duplicate_items(spark, sf_dir):
    return reconcile.duplicate_items(views.invoice_items(spark, sf_dir))


@query(f"""
WITH {INVOICE}, s AS (SELECT shipment_id, count(*) AS n, count(net) AS kn, count(gross) AS kg, sum(net) AS sn, sum(gross) AS sg FROM invoice GROUP BY 1),
d AS (SELECT *, CASE WHEN shipment_id % 4 <> 0 THEN coalesce(sn, 0) + shipment_id % 3 END AS dn, CASE WHEN shipment_id % 6 <> 0 THEN coalesce(sg, 0) END AS dg FROM s)
SELECT shipment_id, CASE WHEN dn IS NULL THEN 'not_applicable' WHEN kn < n THEN 'manual_review' WHEN abs(sn - dn) <= 0.01 THEN 'passed' ELSE 'failed' END AS net_status,
       CASE WHEN dg IS NULL THEN 'not_applicable' WHEN kg < n THEN 'manual_review' WHEN abs(sg - dg) <= 0.01 THEN 'passed' ELSE 'failed' END AS gross_status FROM d""")
def weight_totals(spark, sf_dir):
    invoice = views.invoice_items(spark, sf_dir)
    sums = invoice.groupBy("shipment_id").agg(F.coalesce(F.sum("net_weight"), F.lit(0)).alias("n"), F.coalesce(F.sum("gross_weight"), F.lit(0)).alias("g"))
    header = sums.select("shipment_id", F.when(F.col("shipment_id") % 4 != 0, F.col("n") + F.col("shipment_id") % 3).alias("declared_net_weight"), F.when(F.col("shipment_id") % 6 != 0, F.col("g")).alias("declared_gross_weight"))
    return reconcile.weight_totals(invoice, header)


@query(f"""
WITH {MATCHES}, c AS (
  SELECT m.shipment_id, m.invoice_index, a.units = b.units AS q, CASE WHEN a.code IS NULL OR b.code IS NULL THEN true ELSE a.code = b.code END AS p
  FROM matches m JOIN invoice a ON a.shipment_id = m.shipment_id AND a.item_index = m.invoice_index JOIN packing b ON b.shipment_id = m.shipment_id AND b.item_index = m.packing_index
)
SELECT i.shipment_id, i.item_index, CASE WHEN q THEN CAST(i.units AS DOUBLE) END AS quantity, CASE WHEN p THEN i.code END AS code
FROM invoice i LEFT JOIN c ON c.shipment_id = i.shipment_id AND c.invoice_index = i.item_index""")
def handoff_mask(spark, sf_dir):
    invoice, packing = _items(spark, sf_dir)
    return reconcile.masked(invoice, reconcile.item_comparisons(matching.match_items(invoice, packing), invoice, packing))


@query(f"""
WITH {INVOICE}, s AS (SELECT shipment_id, count(*) AS n, max(units) * 2 AS declared FROM invoice GROUP BY 1)
SELECT i.shipment_id, i.item_index, CAST(CASE WHEN n = 1 AND v IS NULL AND d IS NOT NULL THEN d ELSE v END AS DOUBLE) AS net_weight, (n = 1 AND v IS NULL AND d IS NOT NULL) AS derived
FROM (SELECT i.shipment_id, i.item_index, CASE WHEN i.shipment_id % 2 = 0 THEN i.net END AS v, n, CASE WHEN i.shipment_id % 3 <> 0 THEN declared END AS d FROM invoice i JOIN s USING (shipment_id)) i""")
def declared_fallback(spark, sf_dir):
    invoice = views.invoice_items(spark, sf_dir)
    header = invoice.groupBy("shipment_id").agg((F.max("quantity") * 2).alias("_d")).select("shipment_id", F.when(F.col("shipment_id") % 3 != 0, F.col("_d")).alias("declared_net_weight_total"))
    items = invoice.withColumn("net_weight", F.when(F.col("shipment_id") % 2 == 0, F.col("net_weight")))
    return reconcile.declared_fallback(items, header, "net_weight", "declared_net_weight_total")


@query(f"""
WITH {INVOICE}, f AS (
  SELECT shipment_id, item_index, 1 AS ordinal, 0.95 - (item_index % 3) * 0.1 AS confidence, CASE WHEN item_index % 2 = 0 THEN line_ref END AS page FROM invoice
  UNION ALL SELECT shipment_id, item_index, 2, 0.9, 7 FROM invoice
)
SELECT shipment_id, item_index, CAST(min(confidence) AS DOUBLE) AS confidence, CASE WHEN bool_or(confidence < 0.8) THEN 'manual_review' ELSE 'verified' END AS status, arg_min(page, ordinal) FILTER (WHERE page IS NOT NULL) AS page
FROM f GROUP BY 1, 2""")
def item_rollup(spark, sf_dir):
    invoice = views.invoice_items(spark, sf_dir)
    confidence = (F.lit("0.95").cast("decimal(3,2)") - (F.col("item_index") % 3) * F.lit("0.10").cast("decimal(3,2)")).cast("double")
    first = invoice.select("shipment_id", "item_index", F.lit(1).alias("ordinal"), F.round(confidence, 2).alias("confidence"), F.when(F.col("item_index") % 2 == 0, F.col("line_ref")).alias("page"))
    second = invoice.select("shipment_id", "item_index", F.lit(2).alias("ordinal"), F.lit(0.9).alias("confidence"), F.lit(7).alias("page"))
    fields = first.unionByName(second).withColumn("status", F.when(F.col("confidence") < 0.8, "manual_review").otherwise("verified"))
    return reconcile.item_rollup(fields)


SHIPMENTS = """
  ships AS (
    SELECT o_orderkey AS shipment_id, n_name AS destination, CAST(o_orderdate AS DATE) AS shipped, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 240 - 20 END AS elapsed,
           (['52010090', '52051100', '52094200', '61091000', '63023110'])[o_orderkey % 5 + 1] AS code, c_name AS exporter, o_totalprice AS amount
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  ), types(document, every) AS (VALUES ('commercial_invoice', 23), ('packing_list', 19), ('form_e', 11), ('certificate_of_origin', 3), ('phytosanitary_certificate', 7),
    ('sbp_deposit_proof', 5), ('sbp_confirmation', 13), ('irrevocable_letter_of_credit', 6), ('product_licence', 4), ('import_permit', 8)
  ), docs AS (SELECT shipment_id, document FROM ships JOIN types ON shipment_id % every <> 0)"""
CHECKS = SHIPMENTS + """, applied AS (
    SELECT s.*, r.*, d.document IS NOT NULL AS has FROM ships s JOIN (
      SELECT c.code AS rcode, 'xr_common_' || doc AS rule_id, 'required' AS kind, doc, 'ok' AS prov FROM (VALUES ('52010090'), ('52051100'), ('52094200'), ('61091000'), ('63023110')) c(code), (VALUES ('commercial_invoice'), ('packing_list'), ('form_e')) t(doc)
      UNION ALL SELECT code, 'xr_' || code || '_export_status', 'info', NULL, 'ok' FROM (VALUES ('52010090'), ('52051100'), ('52094200'), ('61091000'), ('63023110')) c(code)
      UNION ALL VALUES ('52010090', 'xr_52010090_licence_required', 'conditional', 'product_licence', 'ok'), ('61091000', 'xr_61091000_licence_required', 'required', 'product_licence', 'ok'),
        ('52051100', 'xr_52051100_licence_required', 'pass', NULL, 'ok'), ('52094200', 'xr_52094200_licence_required', 'review', NULL, 'ok'), ('63023110', 'xr_63023110_licence_required', 'review', NULL, 'ok'),
        ('52010090', 'xr_52010090_permit_required', 'review', 'import_permit', 'ok'), ('52010090', 'xr_52010090_phytosanitary_certificate', 'required', 'phytosanitary_certificate', 'ok'),
        ('52010090', 'xr_52010090_sbp_deposit_proof', 'required', 'sbp_deposit_proof', 'ok'), ('52010090', 'xr_52010090_sbp_confirmation', 'required', 'sbp_confirmation', 'ok'),
        ('52010090', 'xr_52010090_irrevocable_letter_of_credit', 'required', 'irrevocable_letter_of_credit', 'ok'), ('52010090', 'xr_52010090_shipment_within_180_days', 'deadline', NULL, 'ok')
      UNION ALL SELECT code, 'xr_coo_china', 'china', 'certificate_of_origin', 'missing' FROM (VALUES ('52051100'), ('52094200'), ('61091000'), ('63023110')) c(code)
      UNION ALL SELECT code, 'xr_coo_other_destinations', 'coo', 'certificate_of_origin', 'ok' FROM (VALUES ('52051100'), ('52094200'), ('61091000'), ('63023110')) c(code)
    ) r ON r.rcode = s.code LEFT JOIN docs d ON d.shipment_id = s.shipment_id AND d.document = r.doc
  ), checks AS (
    SELECT shipment_id, rule_id AS check_id, doc AS required_document, CASE kind
        WHEN 'required' THEN CASE WHEN has THEN 'passed' ELSE 'failed' END WHEN 'info' THEN 'not_applicable' WHEN 'conditional' THEN CASE WHEN has THEN 'passed' ELSE 'manual_review' END
        WHEN 'pass' THEN 'passed' WHEN 'review' THEN 'manual_review'
        WHEN 'deadline' THEN CASE WHEN elapsed IS NULL THEN 'manual_review' WHEN elapsed BETWEEN 0 AND 180 THEN 'passed' ELSE 'failed' END
        WHEN 'china' THEN CASE WHEN upper(destination) = 'CHINA' THEN CASE WHEN has THEN 'manual_review' ELSE 'failed' END ELSE 'not_applicable' END
        WHEN 'coo' THEN CASE WHEN upper(destination) = 'CHINA' THEN 'not_applicable' WHEN has THEN 'passed' ELSE 'manual_review' END END AS status,
      CASE WHEN kind = 'china' AND upper(destination) = 'CHINA' AND has THEN 'effective_date' ELSE '' END AS reasons
    FROM applied
  )"""


def _checks(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    return rules.evaluate(ships, views.shipment_documents(ships), rules.sample_rules(spark))


@query(f"WITH {CHECKS} SELECT * FROM checks")
def rule_evaluation(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(f"""
WITH {CHECKS}
SELECT shipment_id, required_document AS document, CASE WHEN bool_or(status = 'failed') THEN 'required' ELSE 'conditional' END AS requirement, string_agg(DISTINCT check_id, ',' ORDER BY check_id) AS checks
FROM checks WHERE status IN ('failed', 'manual_review') AND required_document IS NOT NULL AND required_document NOT IN ('commercial_invoice', 'packing_list') GROUP BY 1, 2""")
def outstanding_documents(spark, sf_dir):
    return rules.outstanding(_checks(spark, sf_dir))


@query(f"""
WITH {CHECKS}, c AS (SELECT *, status IN ('failed', 'manual_review') AND required_document IS NOT NULL AND required_document NOT IN ('commercial_invoice', 'packing_list') AS out,
  CASE status WHEN 'failed' THEN 2 WHEN 'manual_review' THEN 1 ELSE 0 END AS sev FROM checks)
SELECT shipment_id, (['passed', 'manual_review', 'failed'])[max(sev) + 1] AS overall_status, (['passed', 'manual_review', 'failed'])[coalesce(max(sev) FILTER (WHERE NOT out), 0) + 1] AS content_status, count(*) FILTER (WHERE out) AS outstanding
FROM c GROUP BY 1""")
def split_verdict(spark, sf_dir):
    return rules.split_verdict(_checks(spark, sf_dir))


@query(f"""
WITH {SHIPMENTS}, req(code, document, v) AS (
  SELECT c.code, t.document, CASE (ascii(t.document) + CAST(c.code AS BIGINT)) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'conditional' WHEN 2 THEN 'true' END
  FROM (VALUES ('52010090'), ('52051100'), ('52094200'), ('61091000'), ('63023110')) c(code), (VALUES ('product_licence'), ('import_permit'), ('phytosanitary_certificate'), ('product_approval')) t(document)
)
SELECT s.shipment_id, r.document, CASE WHEN v = 'false' THEN 'passed' WHEN v = 'conditional' THEN CASE WHEN d.document IS NOT NULL THEN 'passed' ELSE 'manual_review' END
  WHEN v = 'true' THEN CASE WHEN d.document IS NOT NULL THEN 'passed' ELSE 'failed' END ELSE 'manual_review' END AS status
FROM ships s JOIN req r ON r.code = s.code LEFT JOIN docs d ON d.shipment_id = s.shipment_id AND d.document = r.document""")
def requirement_checks(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    names = ("product_licence", "import_permit", "phytosanitary_certificate", "product_approval")
    value = lambda n: F.element_at(F.array(F.lit("false"), F.lit("conditional"), F.lit("true"), F.lit(None).cast("string")), ((F.ascii(F.lit(n)) + F.col("code").cast("long")) % 4 + 1).cast("int"))
    table = spark.createDataFrame([(c,) for c in views.CODES], "code string").select("code", *[value(n).alias(n) for n in names])
    return rules.requirement_checks(ships, views.shipment_documents(ships), table)


@query(f"""
WITH {SHIPMENTS}
SELECT s.shipment_id, CASE WHEN code = '52010090' THEN 'not_applicable' WHEN d.document IS NOT NULL THEN 'passed' WHEN destination IS NULL THEN 'manual_review' WHEN upper(destination) = 'CHINA' THEN 'failed' ELSE 'manual_review' END AS status
FROM ships s LEFT JOIN docs d ON d.shipment_id = s.shipment_id AND d.document = 'certificate_of_origin'""")
def certificate_of_origin(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    return rules.certificate_of_origin(ships, views.shipment_documents(ships))


@query(f"""
WITH {SHIPMENTS}, c AS (SELECT * FROM ships WHERE code = '52010090'), n(document) AS (VALUES ('sbp_deposit_proof'), ('sbp_confirmation'), ('irrevocable_letter_of_credit'))
SELECT c.shipment_id, 'raw_cotton_' || n.document AS check_id, CASE WHEN d.document IS NOT NULL THEN 'passed' ELSE 'failed' END AS status FROM c CROSS JOIN n LEFT JOIN docs d ON d.shipment_id = c.shipment_id AND d.document = n.document
UNION ALL SELECT shipment_id, 'raw_cotton_shipment_within_180_days', CASE WHEN elapsed IS NULL THEN 'manual_review' WHEN elapsed BETWEEN 0 AND 180 THEN 'passed' ELSE 'failed' END FROM c""")
def raw_cotton_pack(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    return rules.raw_cotton_pack(ships, views.shipment_documents(ships))


@query(f"""
WITH {SHIPMENTS}, n(document) AS (VALUES ('commercial_invoice'), ('packing_list'), ('form_e'))
SELECT shipment_id, 'required_fields' AS check_id, CASE WHEN elapsed IS NULL OR destination IS NULL THEN 'manual_review' ELSE 'passed' END AS status,
       concat_ws(',', CASE WHEN destination IS NULL THEN 'destination' END, CASE WHEN elapsed IS NULL THEN 'letter_of_credit_date' END) AS detail FROM ships
UNION ALL SELECT shipment_id, 'mvp_pct_support', CASE WHEN code IN ('52010090', '52051100', '61091000') THEN 'passed' ELSE 'manual_review' END, code FROM ships
UNION ALL SELECT s.shipment_id, 'required_document_' || n.document, CASE WHEN d.document IS NOT NULL THEN 'passed' ELSE 'failed' END, n.document FROM ships s CROSS JOIN n LEFT JOIN docs d ON d.shipment_id = s.shipment_id AND d.document = n.document""")
def general_checks(spark, sf_dir):
    ships = views.shipments(spark, sf_dir)
    return rules.general_checks(ships, views.shipment_documents(ships), ["52010090", "52051100", "61091000"])


@query("""
WITH p AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_partkey % 3 AS k FROM part), t AS (
  SELECT code, f.field, (['conditional', 'true', NULL])[(k + f.n) % 3 + 1] AS value FROM p, (VALUES ('licence_required', 0), ('permit_required', 1), ('approval_required', 2)) f(field, n)
)
SELECT 'xr_' || code || '_' || field AS rule_id, code, CASE WHEN value = 'conditional' THEN 'conditional_document' ELSE 'requirement_status' END AS check_type,
       CASE WHEN value IS NOT NULL THEN 'product_' || split_part(field, '_', 1) END AS required_document, value AS requirement FROM t""")
def flat_rules(spark, sf_dir):
    k = F.col("p_partkey") % 3
    value = lambda n: F.element_at(F.array(F.lit("conditional"), F.lit("true"), F.lit(None).cast("string")), ((k + n) % 3 + 1).cast("int"))
    products = load(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), value(0).alias("licence_required"), value(1).alias("permit_required"), value(2).alias("approval_required"))
    return rules.flat_rules(products)


@query("""
SELECT 'r' || p_partkey AS rule_id, CASE WHEN p_size < 40 THEN '2025-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') ELSE '2026-07-22' END AS effective_date,
       CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'partially_verified' WHEN p_partkey % 3 = 0 THEN 'unverified' ELSE 'verified' END AS validation_status,
       CASE WHEN p_partkey % 5 = 0 THEN 'checked; ' ELSE '' END || 'effective date ' || CASE WHEN p_size < 40 THEN '2025-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') ELSE '2026-07-22' END AS validation_note
FROM part""")
def effective_dates(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    flat = part.select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_size").alias("sro_number"), F.when(F.col("p_partkey") % 2 == 0, "requirement_status").otherwise("required_document").alias("check_type"),
        F.when(F.col("p_partkey") % 3 == 0, "unverified").otherwise("verified").alias("validation_status"), F.when(F.col("p_partkey") % 5 == 0, "checked").alias("validation_note"),
    )
    dates = spark.range(1, 40).select(F.col("id").cast("int").alias("sro_number"), F.format_string("2025-01-%02d", F.col("id") % 28 + 1).alias("legal_date"))
    return rules.overlay_dates(flat, dates, "2026-07-22")


@query("""
WITH r AS (SELECT p_type AS code, CASE p_size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'partially_verified' ELSE 'unverified' END AS status, p_brand AS url, p_size > 45 OR p_retailprice IS NULL AS blocked FROM part)
SELECT code, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'partially_verified') AS partially_verified, count(*) FILTER (status = 'unverified') AS unverified, count(DISTINCT url) AS sources, count(*) FILTER (blocked) AS blocked, NOT bool_or(blocked) AS can_pass FROM r GROUP BY 1""")
def provenance_report(spark, sf_dir):
    """Each part is a rule for its type: brands are sources, large sizes have no date."""
    n = F.col("p_size")
    kind = F.when(n % 3 == 0, "verified").when(n % 3 == 1, "partially_verified").otherwise("unverified")
    part = load(spark, sf_dir, "part").select(
        F.array("p_type").alias("applies_to"), kind.alias("validation_status"), F.col("p_name").alias("source_document"), F.col("p_brand").alias("source_url"), F.col("p_retailprice").cast("string").alias("issuing_authority"),
        F.when(n <= 45, "2025-01-01").alias("effective_date"), F.lit(True).alias("government"),
    )
    return rules.provenance_report(part)


@query("""SELECT DISTINCT CAST(l_partkey % 2300 AS BIGINT) AS code FROM lineitem WHERE CAST(l_partkey % 2300 AS BIGINT) NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def missing_metadata(spark, sf_dir):
    codes = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 2300).alias("code"))
    return rules.missing_metadata(codes, load(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("code")))


@query("""
SELECT o_orderkey AS shipment_id, o_totalprice AS declared, round(coalesce(sum(l_quantity * p_retailprice), 0), 2) AS computed, abs(coalesce(sum(l_quantity * p_retailprice), 0) - o_totalprice) > 0.01 AS differs
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def demo_validation(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")
    sums = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("_sum"))
    joined = load(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total = F.coalesce("_sum", F.lit(0.0))
    return joined.select(F.col("o_orderkey").alias("shipment_id"), F.col("o_totalprice").alias("declared"), F.round(total, 2).alias("computed"), (F.abs(total - F.col("o_totalprice")) > 0.01).alias("differs"))


@query(f"""
WITH {MATCHES}
SELECT m.shipment_id, invoice_index, packing_index, match_status, coalesce(a.product, b.product) AS product, CAST(a.cents AS DOUBLE) / 100 AS line_total
FROM matches m LEFT JOIN invoice a ON a.shipment_id = m.shipment_id AND a.item_index = m.invoice_index LEFT JOIN packing b ON b.shipment_id = m.shipment_id AND b.item_index = m.packing_index""")
def report_lines(spark, sf_dir):
    from ..operators import audit

    invoice, packing = _items(spark, sf_dir)
    return audit.report_lines(matching.match_items(invoice, packing), invoice, packing)


@query(f"WITH {MATCHES} SELECT shipment_id, CAST(sum(CAST(p.units AS BIGINT)) AS BIGINT) AS packages FROM packing p GROUP BY 1")
def package_totals(spark, sf_dir):
    _, packing = _items(spark, sf_dir)
    return packing.groupBy("shipment_id").agg(F.sum(F.col("quantity").cast("string").try_cast("decimal(18,4)").cast("long")).alias("packages"))


SINGLE_LINES = """, one AS (
    SELECT i.shipment_id, i.product AS a_product, p.product || CASE WHEN i.shipment_id % 6 = 1 THEN ' (new)' WHEN i.shipment_id % 6 = 2 THEN ' - ' ELSE '' END AS b_product, i.units AS a_quantity, p.units AS b_quantity,
           i.net AS a_net, p.net AS b_net, i.gross AS a_gross, p.gross AS b_gross, i.code AS a_code, p.code AS b_code
    FROM invoice i LEFT JOIN packing p ON p.shipment_id = i.shipment_id AND p.item_index = 1 WHERE i.item_index = 1), seven AS (
    SELECT shipment_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS place, unnest(['product_match', 'quantity_match', 'net_weight_match', 'gross_weight_match', 'invoice_gross_not_below_net', 'packing_list_gross_not_below_net', 'pct_code_match']) AS check_id,
           unnest([trim(regexp_replace(lower(a_product), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(b_product), '[^a-z0-9]+', ' ', 'g')), a_quantity = b_quantity, a_net = b_net, a_gross = b_gross, a_gross >= a_net, b_gross >= b_net, a_code = b_code]) AS ok FROM one)"""


def _single_lines(spark, sf_dir):
    """The first line of each shipment's documents; products of the packing list are written otherwise here and there."""
    invoice, packing = _items(spark, sf_dir)
    fields = ("product", "quantity", "net_weight", "gross_weight", "code")
    k = F.col("shipment_id")
    a = invoice.where("item_index = 1").select("shipment_id", *[F.col(c).alias(f"invoice_{c}") for c in fields])
    b = packing.where("item_index = 1").withColumn("product", F.concat("product", F.when(k % 6 == 1, " (new)").when(k % 6 == 2, " - ").otherwise("")))
    return a.join(b.select("shipment_id", *[F.col(c).alias(f"packing_{c}") for c in fields]), "shipment_id", "left")


@query(f"WITH {PACKING}{SINGLE_LINES} SELECT shipment_id, CAST(place AS INTEGER) AS place, check_id, CASE WHEN ok IS NULL THEN 'manual_review' WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM seven")
def single_line_checks(spark, sf_dir):
    return reconcile.single_line_checks(_single_lines(spark, sf_dir)).drop("message")


@query(f"""
WITH {PACKING}{SINGLE_LINES}, w AS (SELECT shipment_id, bool_or(check_id = 'product_match' AND ok) AS p, bool_or(check_id = 'quantity_match' AND ok) AS q, bool_or(check_id = 'net_weight_match' AND ok) AS n, bool_or(check_id = 'gross_weight_match' AND ok) AS g, bool_or(check_id = 'pct_code_match' AND ok) AS c FROM seven GROUP BY 1)
SELECT shipment_id, CASE WHEN p THEN a_product END AS product, CAST(CASE WHEN q THEN a_quantity END AS DOUBLE) AS quantity, CAST(CASE WHEN n THEN a_net END AS DOUBLE) AS net_weight, CAST(CASE WHEN g THEN a_gross END AS DOUBLE) AS gross_weight, CASE WHEN c THEN a_code END AS code FROM one JOIN w USING (shipment_id)""")
def single_line_input(spark, sf_dir):
    lines = _single_lines(spark, sf_dir)
    found = reconcile.single_line_input(lines, reconcile.single_line_checks(lines))
    return found.select("shipment_id", "product", *[F.col(c).cast("double").alias(c) for c in ("quantity", "net_weight", "gross_weight")], "code")
