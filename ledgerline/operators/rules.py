"""Rule tables against shipments: six rule types, suppression, provenance, outstanding documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..status import FAILED, NOT_APPLICABLE, PASSED, REVIEW, named, severity, worst

RULE_SCHEMA = "rule_id string, check_type string, applies_to array<string>, required_document string, destination string, deadline_days int, requirement string, validation_status string, source_document string, source_url string, issuing_authority string, effective_date string, government boolean, source_page int, source_locator string, legal_cutoff_date date, rule_data_version string"
#: Provenance that the report on rules counts as blocking.
PROVENANCE = ("source_document", "source_url", "issuing_authority", "effective_date")
#: Spellings of one destination.
CHINA = ("CHINA", "PEOPLE'S REPUBLIC OF CHINA", "PRC")
COTTON, OTHERS = "52010090", ("52051100", "52094200", "61091000", "63023110")


def sample_rules(spark: SparkSession) -> DataFrame:
    """Synthetic rules in the shape of the configured ones; no rule file is at hand to read."""
    every, gov = [COTTON, *OTHERS], "Ministry of Commerce"
    rule = lambda rid, kind, codes, doc=None, dest=None, days=None, req=None, status="verified", date="2025-01-01", url="https://example.org/rules": (rid, kind, list(codes), doc, dest, days, req, status, "notice", url, gov, date, True, 3, None, None, "2026-07")
    rows = [
        *[rule(f"xr_common_{d}", "required_document", every, d, status="partially_verified") for d in ("commercial_invoice", "packing_list", "form_e")],
        *[rule(f"xr_{c}_export_status", "export_status_informational", [c], status="unverified") for c in every],
        *[rule(f"xr_{c}_licence_required", "conditional_document" if c == COTTON else "requirement_status", [c], "product_licence" if c in (COTTON, "61091000") else None, req={COTTON: "conditional", "61091000": "true", "52051100": "false"}.get(c), status="verified") for c in every],
        rule("xr_52010090_permit_required", "requirement_status", [COTTON], "import_permit", req="true", status="unverified"),
        rule("xr_52010090_phytosanitary_certificate", "required_document", [COTTON], "phytosanitary_certificate"),
        *[rule(f"xr_52010090_{d}", "required_document", [COTTON], d) for d in ("sbp_deposit_proof", "sbp_confirmation", "irrevocable_letter_of_credit")],
        rule("xr_52010090_shipment_within_180_days", "shipment_deadline", [COTTON], days=180),
        rule("xr_coo_china", "destination_document", OTHERS, "certificate_of_origin", dest="CHINA", date=None),
        rule("xr_coo_other_destinations", "conditional_document", OTHERS, "certificate_of_origin", status="partially_verified"),
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _same_destination(left, right):
    a, b = F.upper(F.trim(left)), F.upper(F.trim(right))
    return (a == b) | (a.isin(*CHINA) & b.isin(*CHINA))


def evaluate(shipments: DataFrame, documents: DataFrame, rules: DataFrame) -> DataFrame:
    """(shipment_id, check_id, required_document, status, reasons): each rule that applies to a shipment.

    Rules are a configured dimension, exploded by code; Spark broadcasts them while they are small.
    A conditional rule gives way to a destination rule for the same document that matches. Last,
    a government rule's pass (or inapplicability) without whole provenance, or with an uncertain
    validation status, becomes manual_review; inapplicability for structural reasons does not.
    """
    by_code = rules.withColumn("code", F.explode("applies_to")).drop("applies_to").withColumnRenamed("destination", "rule_destination")
    rows = shipments.join(by_code, "code").join(documents.select("shipment_id", F.col("document").alias("required_document"), F.lit(True).alias("_has")), ["shipment_id", "required_document"], "left")
    has = F.coalesce("_has", F.lit(False))
    days = F.datediff("shipment_date", "letter_of_credit_date")
    kind = F.col("check_type")
    verified = F.col("validation_status").isin("verified", "partially_verified")
    there = _same_destination(F.col("destination"), F.col("rule_destination"))
    by_document = F.when(has, PASSED).otherwise(FAILED)
    requirement = F.when(F.col("requirement") == "false", PASSED).when(F.col("requirement") == "true", by_document).otherwise(REVIEW)
    status = (
        F.when(kind == "export_status_informational", NOT_APPLICABLE)
        .when(~verified, REVIEW)
        .when(kind == "required_document", by_document)
        .when(kind == "conditional_document", F.when(has, PASSED).otherwise(REVIEW))
        .when(kind == "destination_document", F.when(~F.coalesce(there, F.lit(False)), NOT_APPLICABLE).otherwise(by_document))
        .when(kind == "shipment_deadline", F.when(days.isNull() | F.col("deadline_days").isNull(), REVIEW).when((days >= 0) & (days <= F.col("deadline_days")), PASSED).otherwise(FAILED))
        .otherwise(requirement)
    )
    structural = ((kind == "destination_document") & ~F.coalesce(there, F.lit(False))) | (kind == "export_status_informational")
    judged = rows.withColumn("status", status).withColumn("_structural", structural)
    # a matching destination rule for the same document settles the conditional one
    same = Window.partitionBy("shipment_id", "required_document")
    settled = F.max((kind == "destination_document") & F.coalesce(there, F.lit(False))).over(same)
    give_way = (kind == "conditional_document") & settled & F.col("required_document").isNotNull()
    judged = judged.withColumn("_give_way", F.coalesce(give_way, F.lit(False)))
    missing, unsure = _provenance_gaps()
    status = F.when(F.col("_give_way"), NOT_APPLICABLE).otherwise(F.col("status"))
    down = F.col("government") & ~F.col("_structural") & ~F.col("_give_way") & status.isin(PASSED, NOT_APPLICABLE) & ((F.size(missing) > 0) | unsure)
    return judged.select(
        "shipment_id", F.col("rule_id").alias("check_id"), "required_document", F.when(down, REVIEW).otherwise(status).alias("status"),
        F.when(down, F.array_join(F.concat(missing, F.when(unsure, F.array(F.lit("uncertain_validation"))).otherwise(F.array().cast("array<string>"))), ",")).otherwise(F.lit("")).alias("reasons"),
    )


def outstanding(checks: DataFrame) -> DataFrame:
    """Documents still to obtain: required if any of their checks failed, else conditional."""
    open_ = checks.where(F.col("status").isin(FAILED, REVIEW) & F.col("required_document").isNotNull() & ~F.col("required_document").isin("commercial_invoice", "packing_list"))
    return open_.groupBy("shipment_id", F.col("required_document").alias("document")).agg(
        F.when(F.bool_or(F.col("status") == FAILED), "required").otherwise("conditional").alias("requirement"),
        F.array_join(F.sort_array(F.collect_set("check_id")), ",").alias("checks"),
    )


def split_verdict(checks: DataFrame, manual_fields: DataFrame | None = None) -> DataFrame:
    """The verdict on what was sent, apart from documents still outstanding, beside the whole one."""
    out = F.col("required_document").isNotNull() & F.col("status").isin(FAILED, REVIEW) & ~F.col("required_document").isin("commercial_invoice", "packing_list")
    found = checks.groupBy("shipment_id").agg(worst(F.col("status")).alias("overall_status"), worst(F.col("status"), ~out).alias("content_status"), F.count_if(out).alias("outstanding"))
    if manual_fields is None:
        return found
    level = lambda c: F.greatest(severity(F.col(c)), F.when(F.col("manual") > 0, 1).otherwise(0))
    joined = found.join(manual_fields.groupBy("shipment_id").agg(F.count("*").alias("manual")), "shipment_id", "left")
    return joined.select("shipment_id", named(level("overall_status")).alias("overall_status"), named(level("content_status")).alias("content_status"), "outstanding")


def requirement_checks(shipments: DataFrame, documents: DataFrame, requirements: DataFrame) -> DataFrame:
    """Licence, permit, certificate and approval: value false, conditional or true, by presence."""
    tall = requirements.unpivot(["code"], ["product_licence", "import_permit", "phytosanitary_certificate", "product_approval"], "document", "value")
    rows = shipments.join(tall, "code").join(documents.withColumn("_has", F.lit(True)), ["shipment_id", "document"], "left")
    has = F.coalesce("_has", F.lit(False))
    status = (
        F.when(F.col("value") == "false", PASSED).when(F.col("value") == "conditional", F.when(has, PASSED).otherwise(REVIEW))
        .when(F.col("value") == "true", F.when(has, PASSED).otherwise(FAILED)).otherwise(REVIEW)
    )
    return rows.select("shipment_id", "document", status.alias("status"))


def certificate_of_origin(shipments: DataFrame, documents: DataFrame) -> DataFrame:
    """Required for China, and for other destinations dependent on the scheme; raw cotton is exempt."""
    rows = shipments.join(documents.where("document = 'certificate_of_origin'").select("shipment_id", F.lit(True).alias("_has")), "shipment_id", "left")
    has, china = F.coalesce("_has", F.lit(False)), F.coalesce(F.upper("destination").isin(*CHINA), F.lit(False))
    status = F.when(F.col("code") == COTTON, NOT_APPLICABLE).when(has, PASSED).when(F.col("destination").isNull(), REVIEW).when(china, FAILED).otherwise(REVIEW)
    return rows.select("shipment_id", status.alias("status"))


def raw_cotton_pack(shipments: DataFrame, documents: DataFrame, days: int = 180) -> DataFrame:
    """Three documents and the shipment window after the letter of credit, for raw cotton."""
    cotton = shipments.where(F.col("code") == COTTON)
    names = ("sbp_deposit_proof", "sbp_confirmation", "irrevocable_letter_of_credit")
    held = documents.where(F.col("document").isin(*names)).groupBy("shipment_id").agg(*[F.bool_or(F.col("document") == n).alias(n) for n in names])
    joined = cotton.join(held, "shipment_id", "left")
    elapsed = F.datediff("shipment_date", "letter_of_credit_date")
    window = F.when(elapsed.isNull(), REVIEW).when(elapsed.between(0, days), PASSED).otherwise(FAILED)
    checks = [F.struct(F.lit(f"raw_cotton_{n}").alias("check_id"), F.when(F.coalesce(n, F.lit(False)), PASSED).otherwise(FAILED).alias("status")) for n in names]
    checks.append(F.struct(F.lit(f"raw_cotton_shipment_within_{days}_days").alias("check_id"), window.alias("status")))
    return joined.select("shipment_id", F.inline(F.array(*checks)))


def general_checks(shipments: DataFrame, documents: DataFrame, supported: list[str]) -> DataFrame:
    """Required fields, supported code, and the three general documents."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("destination", "shipment_date", "letter_of_credit_date", "code", "exporter", "amount")]))
    names = ("commercial_invoice", "packing_list", "form_e")
    held = documents.where(F.col("document").isin(*names)).groupBy("shipment_id").agg(F.collect_set("document").alias("_held"))
    joined = shipments.join(held, "shipment_id", "left")
    has = lambda n: F.coalesce(F.array_contains("_held", n), F.lit(False))
    checks = [
        F.struct(F.lit("required_fields").alias("check_id"), F.when(F.size(missing) > 0, REVIEW).otherwise(PASSED).alias("status"), F.array_join(missing, ",").alias("detail")),
        F.struct(F.lit("mvp_pct_support").alias("check_id"), F.when(F.coalesce(F.col("code").isin(*supported), F.lit(False)), PASSED).otherwise(REVIEW).alias("status"), F.coalesce("code", F.lit("")).alias("detail")),
        *[F.struct(F.lit(f"required_document_{n}").alias("check_id"), F.when(has(n), PASSED).otherwise(FAILED).alias("status"), F.lit(n).alias("detail")) for n in names],
    ]
    return joined.select("shipment_id", F.inline(F.array(*checks)))


def flat_rules(products: DataFrame) -> DataFrame:
    """One wide row of requirements for each product becomes one rule for each requirement."""
    tall = products.unpivot(["code"], ["licence_required", "permit_required", "approval_required"], "field", "value")
    kind = F.when(F.col("value") == "conditional", "conditional_document").otherwise("requirement_status")
    document = F.when(F.col("value").isin("conditional", "true"), F.concat(F.lit("product_"), F.regexp_extract("field", r"^(\w+)_required$", 1)))
    return tall.select(F.concat_ws("_", F.lit("xr"), "code", "field").alias("rule_id"), "code", kind.alias("check_type"), document.alias("required_document"), F.col("value").alias("requirement"))


def overlay_dates(rules: DataFrame, dates: DataFrame, default: str) -> DataFrame:
    """Effective dates by notice number, a status upgrade, and a note that is added once."""
    joined = rules.join(dates, "sro_number", "left")
    date = F.coalesce("legal_date", F.lit(default))
    note = F.concat(F.lit("effective date "), date)
    upgrade = (F.col("check_type") == "requirement_status") & (F.col("validation_status") == "unverified")
    text = F.coalesce("validation_note", F.lit(""))
    return joined.select(
        "rule_id", date.alias("effective_date"), F.when(upgrade, "partially_verified").otherwise(F.col("validation_status")).alias("validation_status"),
        F.when(F.contains(text, note), text).otherwise(F.concat_ws("; ", F.nullif(text, F.lit("")), note)).alias("validation_note"),
    )


def provenance_report(rules: DataFrame) -> DataFrame:
    """Per code: rules by validation status, distinct sources, rules without whole provenance, can pass."""
    by_code = rules.withColumn("code", F.explode("applies_to"))
    blocked = F.lit(False)
    for c in PROVENANCE:
        blocked = blocked | F.col(c).isNull()
    return by_code.groupBy("code").agg(
        *[F.count_if(F.col("validation_status") == s).alias(s) for s in ("verified", "partially_verified", "unverified")],
        F.count_distinct("source_url").alias("sources"), F.count_if(blocked).alias("blocked"), (~F.bool_or(blocked & F.col("government"))).alias("can_pass"),
    )


def missing_metadata(codes: DataFrame, products: DataFrame) -> DataFrame:
    """Codes without metadata: a difference of sets that should be empty."""
    return codes.select("code").distinct().join(products.select("code"), "code", "left_anti")


#: Fields that a shipment needs, the date that rules were checked up to, and what makes a status uncertain.
REQUIRED_FIELDS = ("product_name", "pct_code", "quantity", "unit_price", "invoice_line_total", "invoice_total", "net_weight", "gross_weight", "destination_country", "shipment_date", "uploaded_document_types")
LEGAL_CUTOFF = "2026-07-22"
UNCERTAIN = ("missing", "unclear", "unknown", "unverified", "not_verified", "not verified")
LEGAL_FIELDS = ("source_document", "source_url", "source_page_or_source_locator", "issuing_authority", "effective_date", "legal_cutoff_date", "rule_data_version", "validation_status")


def required_fields(shipments: DataFrame) -> DataFrame:
    """(shipment_id, status, missing): the fields that are null or blank; what is unknown is for review, not a failure."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in REQUIRED_FIELDS]))
    return shipments.select("shipment_id", F.when(F.size(missing) > 0, REVIEW).otherwise(PASSED).alias("status"), F.array_join(missing, ", ").alias("missing"))


def code_support(shipments: DataFrame, catalog: DataFrame) -> DataFrame:
    """(shipment_id, status, reason): a code in the catalog, with metadata of a known status, is supported.

    catalog: code, has_metadata, validation_status; a configured list, which Spark broadcasts while it is small.
    """
    joined = shipments.join(catalog.withColumn("_in", F.lit(True)), "code", "left")
    reason = (
        F.when(F.col("_in").isNull(), "outside_validated_mvp_scope").when(~F.coalesce("has_metadata", F.lit(False)), "missing_tariff_metadata")
        .when(F.coalesce(F.trim("validation_status"), F.lit("")) == "", "missing").otherwise(F.col("validation_status"))
    )
    fine = F.col("_in").isNotNull() & F.coalesce("has_metadata", F.lit(False)) & (F.coalesce(F.trim("validation_status"), F.lit("")) != "")
    return joined.select("shipment_id", F.when(fine, PASSED).otherwise(REVIEW).alias("status"), reason.alias("reason"))


def _provenance_gaps():
    """(legal fields that are missing, as an array; whether the validation status is absent or uncertain) of a rule's columns."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    cutoff = F.coalesce("legal_cutoff_date", F.when(F.col("government"), F.lit(LEGAL_CUTOFF).cast("date")))
    lacks = {c: empty(c) for c in LEGAL_FIELDS if c not in ("source_page_or_source_locator", "legal_cutoff_date")}
    lacks |= {"source_page_or_source_locator": F.col("source_page").isNull() & empty("source_locator"), "legal_cutoff_date": cutoff.isNull()}
    low = F.lower(F.coalesce("validation_status", F.lit("")))
    unsure = (low == "") | F.exists(F.array(*map(F.lit, UNCERTAIN)), lambda m: F.contains(low, m))
    return F.array_compact(F.array(*[F.when(lacks[c], F.lit(c)) for c in LEGAL_FIELDS])), unsure


def with_provenance(checks: DataFrame) -> DataFrame:
    """A government rule's pass, or inapplicability, without whole or with uncertain provenance becomes manual_review.

    checks: shipment_id, check_id, status, message, government, source_document, source_url,
    source_page, source_locator, issuing_authority, effective_date, legal_cutoff_date,
    rule_data_version, validation_status. Applied once, last; failures stay.
    """
    missing, unsure = _provenance_gaps()
    down = F.coalesce("government", F.lit(False)) & F.col("status").isin(PASSED, NOT_APPLICABLE) & ((F.size(missing) > 0) | unsure)
    why = F.array_join(F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing legal source field(s): "), F.array_join(missing, ", "))), F.when(unsure, F.lit("validation status is absent or uncertain")))), " and ")
    message = F.when(down, F.concat("message", F.lit(" Manual review required because "), why, F.lit("."))).otherwise(F.col("message"))
    return checks.select("shipment_id", "check_id", F.when(down, REVIEW).otherwise(F.col("status")).alias("status"), message.alias("message"))


def general_documents(shipments: DataFrame, documents: DataFrame, source_url: str | None) -> DataFrame:
    """The three documents that every shipment needs; a rule without a source to cite is for review."""
    names = ("commercial_invoice", "packing_list", "form_e")
    wanted = shipments.select("shipment_id", F.explode(F.array(*map(F.lit, names))).alias("document"))
    joined = wanted.join(documents.select("shipment_id", "document", F.lit(True).alias("_has")), ["shipment_id", "document"], "left")
    present = F.col("_has").isNotNull()
    return joined.select("shipment_id", F.concat(F.lit("required_document_"), "document").alias("check_id"), (F.lit(REVIEW) if not source_url else F.when(present, PASSED).otherwise(FAILED)).alias("status"))


def verified_requirements(shipments: DataFrame, documents: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements of a product whose own status is known: false, conditional or true, by presence.

    requirements: code, document, value, verification. One whose verification is absent or
    uncertain, or without a value, is for review; what is verified as not required does not apply.
    """
    rows = shipments.join(requirements, "code").join(documents.withColumn("_has", F.lit(True)), ["shipment_id", "document"], "left")
    has, low = F.coalesce("_has", F.lit(False)), F.lower(F.coalesce("verification", F.lit("")))
    unsure = (low == "") | F.exists(F.array(*map(F.lit, UNCERTAIN)), lambda m: F.contains(low, m)) | F.col("value").isNull()
    status = F.when(unsure, REVIEW).when(F.col("value") == "false", NOT_APPLICABLE).when(has, PASSED).when(F.col("value") == "conditional", REVIEW).otherwise(FAILED)
    return rows.select("shipment_id", "document", status.alias("status"))


def outstanding_details(checks: DataFrame) -> DataFrame:
    """Documents still to obtain in the order first named, with the distinct reasons and sources of all their checks.

    checks: shipment_id, ordinal, status, required_document, message, source.
    """
    document = F.lower(F.trim("required_document"))
    open_ = checks.where(F.col("status").isin(FAILED, REVIEW)).withColumn("document", document).where("document <> '' and document not in ('commercial_invoice', 'packing_list')")
    once = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))), lambda x: x[c])), "|")
    found = open_.groupBy("shipment_id", "document").agg(F.min("ordinal").alias("_first"), F.when(F.bool_or(F.col("status") == FAILED), "required").otherwise("conditional").alias("requirement"), once("message").alias("reasons"), once("source").alias("sources"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("shipment_id").orderBy("_first"))).drop("_first")


def patched_requirements(products: DataFrame, date: str, authority: str = "Ministry of Commerce") -> DataFrame:
    """Requirements with what a primary source settles: date, authority where absent, unknown values as not required.

    products: code, issuing_authority, and for licence, permit and approval a value and a verification.
    """
    out = [F.col("code"), F.lit(date).alias("effective_date"), F.coalesce(F.nullif("issuing_authority", F.lit("")), F.lit(authority)).alias("issuing_authority")]
    for kind in ("licence", "permit", "approval"):
        unknown = F.col(f"{kind}_value").isNull()
        out += [F.when(unknown, "false").otherwise(F.col(f"{kind}_value")).alias(f"{kind}_value"), F.when(unknown, f"verified_no_{kind}_required_under_epo_2022_general_permission").otherwise(F.col(f"{kind}_verification")).alias(f"{kind}_verification")]
    return products.select(*out)
