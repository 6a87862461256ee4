"""Supporting documents: states, comparisons with the shipment, presence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.predicates import SUPPORTING_TYPES, document_type
from ..status import FAILED, NOT_APPLICABLE, PASSED, REVIEW, compared, worst

LOW_OCR = 0.75
#: Types whose invoice reference is compared.
REFERENCED = ("export_declaration", "sbp_deposit_proof", "sbp_confirmation", "goods_declaration")


def verify(documents: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row per claimed document: detected type, state, checks' verdict, failing checks.

    documents: shipment_id, claimed_type, text (null if only claimed), detected, exporter,
    destination, code, invoice_number, expiry, percentage, ocr_confidence.
    """
    ships = shipments.select("shipment_id", F.col("exporter").alias("_exporter"), F.col("destination").alias("_destination"), F.col("code").alias("_code"), F.col("invoice_number").alias("_invoice"), "shipment_date")
    claimed, detected = document_type(F.col("claimed_type")), document_type(F.col("detected"))
    joined = documents.join(ships, "shipment_id").withColumn("type", claimed).withColumn("detected_type", detected)
    unknown = lambda *c: reduce(lambda a, b: a | b, [F.col(x).isNull() for x in c])
    check = lambda name, applies, status: F.struct(F.lit(name).alias("check"), F.when(applies, status).otherwise(NOT_APPLICABLE).alias("status"))
    all_ = F.lit(True)
    checks = F.array(
        check("exporter_match", all_, compared(unknown("exporter", "_exporter"), N.company(F.col("exporter")) == N.company(F.col("_exporter")))),
        check("destination_match", F.col("type") == "certificate_of_origin", compared(unknown("destination", "_destination"), N.plain(F.col("destination")) == N.plain(F.col("_destination")))),
        check("pct_match", F.col("type") == "certificate_of_origin", compared(unknown("code", "_code"), N.digits(F.col("code")) == N.digits(F.col("_code")))),
        check("invoice_reference_match", F.col("type").isin(*REFERENCED), compared(unknown("invoice_number", "_invoice"), N.plain(F.col("invoice_number")) == N.plain(F.col("_invoice")))),
        check("not_expired", F.col("type") == "import_permit", compared(unknown("expiry", "shipment_date"), F.col("expiry") >= F.col("shipment_date"))),
        check("deposit_percentage", F.col("type") == "sbp_deposit_proof", compared(unknown("percentage"), F.col("percentage") == 1)),
    )
    soft = F.col("ocr_confidence") < LOW_OCR  # a poor scan never fails a document, and never improves it
    checks = F.transform(checks, lambda c: F.struct(c["check"].alias("check"), F.when(F.coalesce(soft, F.lit(False)) & (c["status"] == FAILED), REVIEW).otherwise(c["status"]).alias("status")))
    readable = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 20
    failed = F.exists("checks", lambda c: c["status"] == FAILED)
    review = F.exists("checks", lambda c: c["status"] == REVIEW)
    state = (
        F.when(F.col("text").isNull(), "claimed_only").when(~readable, "unreadable").when((F.col("detected_type") != "UNKNOWN") & (F.col("detected_type") != F.col("type")), "type_mismatch")
        .when(failed, "type_verified").when(review, "fields_verified").otherwise("shipment_matched")
    )
    content = F.when(F.col("state").isin("claimed_only", "type_mismatch"), FAILED).when(F.col("state") == "unreadable", REVIEW).when(failed, FAILED).when(review, REVIEW).otherwise(PASSED)
    listed = F.array_join(F.transform(F.filter("checks", lambda c: c["status"].isin(FAILED, REVIEW)), lambda c: c["check"]), ",")
    judged = joined.withColumn("checks", checks).withColumn("state", state)
    return judged.select("shipment_id", "type", "detected_type", "state", content.alias("content_status"), F.when(F.col("state").isin("claimed_only", "unreadable", "type_mismatch"), "").otherwise(listed).alias("open_checks"))


def reference_chain(documents: DataFrame) -> DataFrame:
    """A deposit confirmation's reference against the shipment's first deposit proof's number."""
    first = Window.partitionBy("shipment_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.first(F.when(F.col("type") == "sbp_deposit_proof", F.col("document_number")), ignorenulls=True).over(first)
    rows = documents.withColumn("_number", number).where("type = 'sbp_confirmation'")
    return rows.select("shipment_id", compared(F.col("_number").isNull() | F.col("related_reference").isNull(), N.plain(F.col("_number")) == N.plain(F.col("related_reference"))).alias("related_deposit_match"))


def claimed_only(claimed: DataFrame, uploaded: DataFrame) -> DataFrame:
    return claimed.select("shipment_id", document_type(F.col("claimed_type")).alias("type")).distinct().join(uploaded.select("shipment_id", "type"), ["shipment_id", "type"], "left_anti")


def presence(verified: DataFrame) -> DataFrame:
    """Types present and types verified in each shipment, and what each document counts as."""
    counts = F.when(F.col("state") == "claimed_only", "missing").when(F.col("state") == "unreadable", "unresolved").when(F.col("state") == "type_mismatch", "invalid").when(F.col("content_status") == FAILED, "mismatched").otherwise("matched")
    rows = verified.withColumn("presence", counts)
    return rows.groupBy("shipment_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("presence") != "missing", F.col("type")))), ",").alias("present"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("presence") == "matched", F.col("type")))), ",").alias("verified"), worst(F.col("content_status")).alias("status"),
    )


#: Types whose invoice reference, destination or amount is compared with the shipment's.
BY_INVOICE = ("form_e_or_psw_export_declaration", "sbp_deposit_proof", "sbp_confirmation", "goods_declaration")
BY_DESTINATION = ("certificate_of_origin", "phytosanitary_certificate", "importing_country_permit")
BY_AMOUNT = ("form_e_or_psw_export_declaration", "goods_declaration")
DEPOSIT_PERCENTAGE = 1


def comparisons(documents: DataFrame, shipments: DataFrame, today: str) -> DataFrame:
    """(shipment_id, type, check, status): what a supporting document says against its shipment.

    documents: shipment_id, type, exporter, invoice_reference, destination, code, deadline, amount,
    related_reference, currency, commodity, percentage, expiry, ocr_confidence; shipments:
    shipment_id, and s_exporter, s_invoice, s_destination, s_code, s_date, s_total, s_deposit,
    s_currency, s_product. Which checks apply follows the type, and for some whether a value was read.
    """
    j, kind = documents.join(shipments, "shipment_id"), F.col("type")
    have = lambda *c: reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c])
    same = lambda f, a, b: compared(~have(a, b), f(F.col(a)) == f(F.col(b)))
    as_is = lambda c: c
    credit = kind == "irrevocable_letter_of_credit"
    rules = (
        ("exporter_match", F.lit(True), same(N.company, "exporter", "s_exporter")), ("invoice_reference_match", kind.isin(*BY_INVOICE), same(N.plain, "invoice_reference", "s_invoice")),
        ("destination_match", kind.isin(*BY_DESTINATION), same(N.plain, "destination", "s_destination")), ("pct_match", have("code", "s_code"), same(N.digits, "code", "s_code")),
        ("beneficiary_match", credit, same(N.company, "exporter", "s_exporter")), ("shipment_deadline", credit, compared(~have("deadline", "s_date"), F.col("deadline") >= F.col("s_date"))),
        ("amount_cover", credit & have("amount", "s_total"), compared(F.lit(False), F.col("amount") >= F.col("s_total"))), ("related_deposit_match", kind == "sbp_confirmation", same(N.plain, "related_reference", "s_deposit")),
        ("amount_match", kind.isin(*BY_AMOUNT), same(as_is, "amount", "s_total")), ("currency_match", have("currency", "s_currency"), same(N.plain, "currency", "s_currency")),
        ("commodity_match", kind == "phytosanitary_certificate", same(N.product, "commodity", "s_product")), ("deposit_percentage", kind == "sbp_deposit_proof", compared(~have("percentage"), F.col("percentage") == DEPOSIT_PERCENTAGE)),
        ("not_expired", have("expiry"), compared(F.lit(False), F.col("expiry") >= F.lit(today).cast("date"))),
    )
    soft = F.coalesce(F.col("ocr_confidence") < LOW_OCR, F.lit(False))
    made = [F.when(applies, F.struct(F.lit(n).alias("check"), F.when(soft & (status == FAILED), REVIEW).otherwise(status).alias("status"))) for n, applies, status in rules]
    return j.select("shipment_id", "type", F.inline(F.array_compact(F.array(*made))))


def presence_names(results: DataFrame) -> DataFrame:
    """(shipment_id, name, verified): every name of each type that was sent and recognised; verified unless its content failed."""
    kept = results.where(F.col("state").isin("type_verified", "fields_verified", "shipment_matched"))
    names = F.create_map(*[v for k, xs in SUPPORTING_TYPES.items() for v in (F.lit(k), F.array(*map(F.lit, dict.fromkeys([k, *xs]))))])
    tall = kept.select("shipment_id", F.explode(F.coalesce(F.try_element_at(names, F.col("type")), F.array("type"))).alias("name"), (F.col("content_status") != FAILED).alias("ok"))
    return tall.groupBy("shipment_id", "name").agg(F.bool_or("ok").alias("verified"))
