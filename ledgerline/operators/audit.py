"""Audit: events, revisions, dependencies, consensus, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..status import FAILED, PASSED, REVIEW
from .numbering import dense_numbers

#: Document, field, whether of an item, the checks that depend on it, whether the rules do too.
DEPENDENCIES = (
    ("invoice", "quantity", True, ("positive_quantity", "item_quantity_match", "item_line_calculation", "invoice_line_calculation", "sum_line_totals_match_invoice_total"), False),
    ("invoice", "unit_price", True, ("positive_unit_price", "item_line_calculation", "invoice_line_calculation", "sum_line_totals_match_invoice_total"), False),
    ("invoice", "line_total", True, ("item_line_calculation", "invoice_line_calculation", "sum_line_totals_match_invoice_total"), False),
    ("invoice", "net_weight", True, ("item_net_weight_match", "invoice_net_weight_total", "weight_consistency"), False),
    ("invoice", "gross_weight", True, ("item_gross_weight_match", "invoice_gross_weight_total", "weight_consistency"), False),
    ("invoice", "pct_code", True, ("item_pct_code_match", "mvp_pct_support"), True),
    ("invoice", "product_name", True, (), True),
    ("packing_list", "quantity", True, ("item_quantity_match",), False),
    ("packing_list", "net_weight", True, ("item_net_weight_match", "packing_net_weight_total", "weight_consistency"), False),
    ("packing_list", "gross_weight", True, ("item_gross_weight_match", "packing_gross_weight_total", "weight_consistency"), False),
    ("packing_list", "pct_code", True, ("item_pct_code_match",), False),
    ("invoice", "destination_country", False, (), True),
    ("invoice", "declared_net_weight_total", False, ("invoice_net_weight_total",), False),
    ("invoice", "declared_gross_weight_total", False, ("invoice_gross_weight_total",), False),
    ("invoice", "invoice_total", False, ("sum_line_totals_match_invoice_total",), False),
    ("invoice", "exporter_name", False, (), False),
    ("invoice", "shipment_date", False, (), True),
    ("packing_list", "declared_net_weight_total", False, ("packing_net_weight_total",), False),
    ("packing_list", "declared_gross_weight_total", False, ("packing_gross_weight_total",), False),
)
#: The checks that make up the rules' family.
FAMILY_START, FAMILY_ID = "xr_", "mvp_pct_support"
#: Check, label, level, and the document and field that it rests on.
RESTS_ON = (
    *(("item_quantity_match", "quantity", "item", d, "quantity") for d in ("invoice", "packing_list")),
    *(("item_net_weight_match", "net weight", "item", d, "net_weight") for d in ("invoice", "packing_list")),
    *(("item_gross_weight_match", "gross weight", "item", d, "gross_weight") for d in ("invoice", "packing_list")),
    ("item_pct_code_match", "PCT code", "item", "invoice", "pct_code"),
    *((c, "quantity, unit price and line total", "item", "invoice", f) for c in ("item_line_calculation", "invoice_line_calculation") for f in ("quantity", "unit_price", "line_total")),
    ("sum_line_totals_match_invoice_total", "invoice total", "header", "invoice", "invoice_total"),
    ("invoice_total_consistency", "invoice total", "header", "invoice", "invoice_total"),
    ("invoice_net_weight_total", "declared net weight", "header", "invoice", "declared_net_weight_total"),
    ("invoice_gross_weight_total", "declared gross weight", "header", "invoice", "declared_gross_weight_total"),
    ("packing_net_weight_total", "packing-list net weight", "header", "packing_list", "declared_net_weight_total"),
    ("packing_gross_weight_total", "packing-list gross weight", "header", "packing_list", "declared_gross_weight_total"),
)
#: Checks by what is wrong when they fail.
MISMATCH_IDS = ("item_quantity_match", "item_net_weight_match", "item_gross_weight_match", "item_pct_match", "single_document_items")
ARITHMETIC_IDS = ("item_calculation", "product_calculation", "order_total", "net_weight_total", "gross_weight_total")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def revisions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events numbered from 1 on in each key."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def unseen(events: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Only the events beyond the number already stored for their key: an append-only suffix."""
    have = stored.groupBy(key).agg(F.count("*").alias("_have"))
    return revisions(events, key, order).join(have, key, "left").where(F.col("version") > F.coalesce("_have", F.lit(0))).drop("_have")


def affected_checks(changes: DataFrame, checks: DataFrame, spark) -> DataFrame:
    """(shipment_id, path, check_id): checks to run again after a correction; the rest keep their evidence.

    changes: shipment_id and path, of an item (``invoice.line_items[2].quantity``) or a document
    (``invoice.invoice_total``); a path that is not known affects nothing and is for the caller to refuse.
    """
    from ..functions.predicates import field_path

    table = spark.createDataFrame([(d, f, i, list(c), r) for d, f, i, c, r in DEPENDENCIES], "document string, field string, of_item boolean, direct array<string>, family boolean")
    parsed = changes.select("shipment_id", "path", field_path(F.col("path")).alias("_p")).select("shipment_id", "path", F.regexp_replace("_p.document", "^commercial_", "").alias("document"), F.col("_p.field").alias("field"), F.col("_p.index").isNotNull().alias("of_item"))
    known = parsed.join(F.broadcast(table), ["document", "field", "of_item"])
    direct = known.select("shipment_id", "path", F.explode("direct").alias("check_id"))
    present = checks.where(F.col("check_id").startswith(FAMILY_START) | (F.col("check_id") == FAMILY_ID)).select("shipment_id", "check_id").distinct()
    return direct.unionByName(known.where("family").select("shipment_id", "path").join(present, "shipment_id")).distinct()


def document_evidence(checks: DataFrame, fields: DataFrame, spark) -> DataFrame:
    """(shipment_id, check_id, item_index, document, field, value, page): what a check rests on.

    checks: shipment_id, check_id, invoice_index, packing_index, invoice_page, packing_page; fields:
    shipment_id, document, item_index (null for the document's own), field, value, page. A check
    without known fields shows its own pages, so that none comes without evidence.
    """
    # what a check rests on goes by number until it has met the fields, so that no words move; fields that no check rests on stay behind
    places = {x: n for n, x in enumerate(dict.fromkeys(r[3:] for r in RESTS_ON))}
    table = spark.createDataFrame([(n, *r, places[r[3:]]) for n, r in enumerate(RESTS_ON)], "_n int, check_id string, label string, level string, document string, field string, _place int")
    where = spark.createDataFrame([(*x, n) for x, n in places.items()], "document string, field string, _place int")
    own = checks.join(F.broadcast(table.drop("field")), "check_id", "left")
    index = F.when(F.col("level") == "item", F.when(F.col("document") == "invoice", F.col("invoice_index")).otherwise(F.col("packing_index")))
    known = own.where("level is not null").withColumn("_index", index).where("level = 'header' or _index is not null")
    asked = known.select("shipment_id", F.coalesce("_index", F.lit(0)).alias("_at"), "_place", "_n")
    at = fields.join(F.broadcast(where), ["document", "field"]).select("shipment_id", F.coalesce("item_index", F.lit(0)).alias("_at"), "_place", "value", "page")
    found = asked.join(at, ["shipment_id", "_at", "_place"]).join(F.broadcast(table), "_n").withColumn("item_index", F.when(F.col("level") == "item", F.col("_at")))
    pages = F.array(F.struct(F.lit("invoice").alias("document"), F.col("invoice_page").alias("page")), F.struct(F.lit("packing_list").alias("document"), F.col("packing_page").alias("page")))
    rest = own.where("level is null").drop("document").select("shipment_id", "check_id", F.inline(pages)).where("page is not null")
    return found.select("shipment_id", "check_id", "item_index", "document", "field", "value", "page").unionByName(rest, allowMissingColumns=True)


def citations(cited: DataFrame, primary: int = 2, width: int = 320) -> DataFrame:
    """Each source and page once in a query, in order; the first ``primary`` are shown expanded."""
    from ..functions.predicates import citation_snippet

    first = Window.partitionBy("query_id", "source", "page").orderBy("ordinal")
    one = cited.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal"))
    return one.withColumn("place", place).withColumn("display_primary", F.col("place") <= primary).withColumn("snippet", citation_snippet(F.col("snippet"), width))


def all_checks(*lists: DataFrame) -> DataFrame:
    """Item, shipment and rule checks as one list; columns that a list lacks are null."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def categorised(checks: DataFrame) -> DataFrame:
    """Open checks by what a reader has to do: (shipment_id, bucket, messages), one message for a missing document.

    checks: shipment_id, check_id, status, message, required_document, is_rule, validation_status.
    """
    c, rule = F.col("check_id"), F.coalesce("is_rule", F.lit(False))
    note = F.lower(F.concat_ws(" ", "message", "validation_status"))
    limited = note.rlike("effective date|provenance|source page|evidence|verified")
    bucket = (
        F.when(F.col("status") == FAILED, F.when(c.startswith("required_document"), "missing_documents").when(c.isin(*ARITHMETIC_IDS), "calculation_errors").when(c.isin(*MISMATCH_IDS), "document_mismatches")
               .when(rule & F.col("required_document").isNotNull(), "missing_documents").otherwise("regulatory_problems"))
        .when(rule & limited, "evidence_limitations").otherwise("missing_or_uncertain_fields")
    )
    open_ = checks.where(F.col("status").isin(FAILED, REVIEW)).withColumn("bucket", bucket)
    once = F.when(F.col("bucket") == "missing_documents", F.coalesce(F.lower(F.trim("required_document")), "message")).otherwise(F.col("message"))
    first = open_.groupBy("shipment_id", "bucket", once.alias("_once")).agg(F.min(F.struct("check_id", "message")).alias("_m"))
    return first.groupBy("shipment_id", "bucket").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list("_m")), lambda m: m["message"])), "|").alias("messages"))


def agreement(reviews: DataFrame) -> DataFrame:
    """Two reviewers' reports by topic: agreed and disagreed topics, open issues, whether a person must look, and why.

    reviews: shipment_id, engine_status, first_status, second_status, confirmed, omissions, arithmetic,
    challenged, verified (arrays), support, missing_provenance, anomalies (arrays), unsupported, action.
    """
    uncertain = F.col("support").isin("not_found", "conflicting", "partially_supported")
    topics = (
        ("deterministic_status", (F.col("engine_status") == F.col("first_status")) & (F.col("engine_status") == F.col("second_status")), F.lit(True)),
        ("compliance_status_confirmed", F.col("confirmed"), F.lit(True)), ("detected_discrepancies", F.size("omissions") == 0, F.lit(True)), ("arithmetic_and_weights", F.size("arithmetic") == 0, F.lit(True)),
        ("supporting_documents", F.size("challenged") == 0, (F.size("challenged") > 0) | (F.size("verified") > 0)),
    )
    said = lambda good: F.array_compact(F.array(*[F.when(applies & (F.coalesce(ok, F.lit(False)) == good), F.lit(name)) for name, ok, applies in topics]))
    agreed = F.concat(said(True), F.when(~uncertain, F.array(F.lit("evidence_availability"))).otherwise(F.array().cast("array<string>")))
    no = F.array().cast("array<string>")
    open_ = F.concat("omissions", "arithmetic", "challenged", F.when(uncertain, F.array(F.concat(F.lit("evidence_"), "support"))).otherwise(no), "missing_provenance", "anomalies", F.when(F.col("unsupported"), F.array(F.lit("unsupported_product_present"))).otherwise(no))
    escalates = F.col("action").isin("human_review", "evidence_missing", "rerun_extraction", "technical_failure")
    critical = F.array_compact(F.concat(F.array(F.when(F.size(said(False)) > 0, F.lit("agent_disagreement")), F.when(F.col("unsupported"), F.lit("unsupported_product")), F.when(escalates, F.concat(F.lit("auditor_"), "action"))), F.filter("anomalies", lambda a: F.contains(a, F.lit("conflict")) | F.contains(a, F.lit("anomaly")))))
    judged = reviews.select("shipment_id", "engine_status", agreed.alias("agreed"), said(False).alias("disagreed"), open_.alias("open"), critical.alias("critical"), (uncertain | (F.size("missing_provenance") > 0)).alias("_unsure"))
    unsure = F.col("_unsure") | (F.col("engine_status") == REVIEW)
    reason = (
        F.when(F.size("critical") > 0, F.concat(F.lit("critical anomaly requires human review: "), F.array_join(F.array_distinct("critical"), ", "))).when(F.col("engine_status") == REVIEW, "uncertainty requires human confirmation")
        .when(unsure, F.concat(F.lit("unresolved issues: "), F.array_join(F.slice("open", 1, 5), "; "))).otherwise("reviewers agree; the result is clear")
    )
    return judged.select("shipment_id", *[F.array_join(c, ",").alias(c) for c in ("agreed", "disagreed", "open")], (F.size("disagreed") == 0).alias("consensus"), ((F.size("critical") > 0) | unsure).alias("needs_review"), reason.alias("reason"))


def consensus(engine: DataFrame, audit: DataFrame) -> DataFrame:
    """Per shipment: agreed, disagreed (some check differs), unresolved (some check not audited)."""
    # both lists as one, dealt out by shipment once; pairs of equal ids are counted, not made
    key, one = ["shipment_id", "check_id"], F.lit(1).cast("long")
    auditable = audit.where("shipment_id is not null and check_id is not null")
    both = engine.select(*key, "status", one.alias("_e"), F.lit(0).cast("long").alias("_a")).unionByName(auditable.select(*key, "status", F.lit(0).cast("long").alias("_e"), one.alias("_a"))).repartition("shipment_id")
    each = both.groupBy(*key, "status").agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    known, e, a = F.col("status").isNotNull(), F.col("_e"), F.col("_a")
    pairs = each.groupBy(*key).agg(
        F.sum("_e").alias("_e"), F.sum("_a").alias("_a"), F.sum(F.when(known, e).otherwise(0)).alias("_ke"), F.sum(F.when(known, a).otherwise(0)).alias("_ka"),
        F.sum(F.when(known, e * a).otherwise(0)).alias("_same"), F.bool_or(F.when(e > 0, F.col("status") != PASSED)).alias("_open"),
    )
    omitted = F.when(a == 0, e).otherwise(e * (a - F.col("_ka")))
    found = pairs.where(e > 0).groupBy("shipment_id").agg(F.sum(omitted).alias("omitted"), F.sum(F.col("_ke") * F.col("_ka") - F.col("_same")).alias("differing"), F.bool_or("_open").alias("_open"))
    outcome = F.when(F.col("differing") > 0, "disagreed").when(F.col("omitted") > 0, "unresolved").otherwise("agreed")
    return found.select("shipment_id", "omitted", "differing", outcome.alias("outcome"), ((outcome != "agreed") | F.col("_open")).alias("needs_review"))


def omissions(engine: DataFrame, flagged: DataFrame) -> DataFrame:
    """Failed or open checks that the first reviewer did not flag."""
    return engine.where(F.col("status").isin(FAILED, REVIEW)).join(flagged.select("shipment_id", "check_id"), ["shipment_id", "check_id"], "left_anti").select("shipment_id", "check_id", "status")


def summary_counts(checks: DataFrame) -> DataFrame:
    """Per shipment and status: how many check ids, each by its first row only."""
    first = Window.partitionBy("shipment_id", "check_id").orderBy("ordinal")
    rows = checks.repartition("shipment_id").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.groupBy("shipment_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "manual_review", "not_applicable")])


def problems(checks: DataFrame) -> DataFrame:
    """Open checks in buckets; in each, distinct ids."""
    c = F.col("check_id")
    bucket = (
        F.when(c.like("required_document%") | c.like("xr_common%"), "missing_documents").when(c.like("item_%"), "document_conflicts").when(c.like("%calculation%") | c.like("%total%"), "arithmetic")
        .when(c.like("raw_cotton%") | c.like("xr_%"), "legal").when(F.col("status") == REVIEW, "to_confirm").otherwise("other")
    )
    return checks.where(F.col("status").isin(FAILED, REVIEW)).groupBy("shipment_id", bucket.alias("bucket")).agg(F.array_join(F.sort_array(F.collect_set("check_id")), ",").alias("checks"))


def evidence_grade(evidence: DataFrame) -> DataFrame:
    """Per check: support (conflicting, then not found, all, partial) and the evidence's grade."""
    e = evidence.groupBy("shipment_id", "check_id").agg(F.count("*").alias("n"), F.count_if(F.col("support") == "supported").alias("yes"), F.count_if(F.col("support") == "conflicting").alias("against"), F.count_if(F.col("support") == "not_found").alias("none"), F.bool_and("verified").alias("_verified"))
    support = F.when(F.col("against") > 0, "conflicting").when(F.col("none") == F.col("n"), "not_found").when(F.col("yes") == F.col("n"), "supported").when(F.col("yes") > 0, "partially_supported").otherwise("not_applicable")
    grade = F.when(F.col("none") == F.col("n"), "unavailable").when(F.col("against") > 0, "conflicting").when(F.col("_verified"), "verified").otherwise("partial")
    return e.select("shipment_id", "check_id", support.alias("support"), grade.alias("grade"))


def broker_confidence(checks: DataFrame) -> DataFrame:
    return checks.groupBy("shipment_id").agg(F.round(F.coalesce(F.avg(F.col("verified").cast("int")), F.lit(0.0)), 4).alias("confidence"))


def report_lines(matches: DataFrame, invoice: DataFrame, packing: DataFrame) -> DataFrame:
    a = invoice.select("shipment_id", F.col("item_index").alias("invoice_index"), F.col("product").alias("invoice_product"), F.col("line_total").cast("double").alias("line_total"))
    b = packing.select("shipment_id", F.col("item_index").alias("packing_index"), F.col("product").alias("packing_product"))
    return matches.join(a, ["shipment_id", "invoice_index"], "left").join(b, ["shipment_id", "packing_index"], "left").select("shipment_id", "invoice_index", "packing_index", "match_status", F.coalesce("invoice_product", "packing_product").alias("product"), "line_total")


def findings(checks: DataFrame) -> DataFrame:
    """Findings by required document, else check; the most specific represents, with rank for display.

    Specificity: status times 100, 30 for a China rule, 5 for a destination's, 20 less if conditional.
    """
    rank = F.when(F.col("status") == FAILED, 3).when(F.col("status") == REVIEW, 2).when(F.col("status") == PASSED, 1).otherwise(0)
    specific = rank * 100 + F.when(F.col("check_id").like("%china%"), 30).otherwise(0) + F.when(F.col("check_id").like("%coo%"), 5).otherwise(0) - F.when(F.col("check_id").like("%other%"), 20).otherwise(0)
    return checks.groupBy("shipment_id", F.coalesce("required_document", "check_id").alias("finding")).agg(F.max_by("check_id", F.struct(specific, F.col("check_id"))).alias("check_id"), F.max(rank).alias("rank"), F.count("*").alias("sources"))


def defects(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """A record for every signature that a row that is neither fine nor blocked matches, by family."""
    open_ = rows.where("status <> 'passed' and not blocked")
    joined = open_.join(F.broadcast(signatures), F.col("message").contains(F.col("pattern")))  # a fixed list of signatures
    return dense_numbers(joined.select("family", "row_id", "pattern"), ["family"], [F.col("row_id"), F.col("pattern")])  # few families, of any size
