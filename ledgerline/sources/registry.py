"""The dimension of curated sources: kind, validation, currency, page window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: slug, title, document type, kind, validation, currency, first and last page
SOURCES = (
    ("tariff", "Customs tariff", "tariff", "official_tariff", "verified", "current", None, None),
    ("customs-act", "Customs act", "customs_act", "official_regulation", "verified", "current", None, None),
    ("customs-rules", "Customs rules", "customs_rules", "official_regulation", "partially_verified", "current", 1, 400),
    ("export-policy", "Export policy order", "policy", "official_policy", "verified", "current", None, None),
    ("export-policy-old", "Export policy order, earlier", "policy", "official_policy", "verified", "superseded", None, None),
    ("single-declaration", "Single declaration manual", "manual", "official_manual", "partially_verified", "current", None, None),
    ("certificate-of-origin", "Electronic certificate of origin manual", "manual", "official_manual", "partially_verified", "current", None, None),
    ("notices", "Notices in force", "notice", "official_regulation", "verified", "historical_reference", None, None),
    ("requirements", "Curated product requirements", "json", "curated_rule_summary", "partially_verified", "current", None, None),
)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "slug string, title string, document_type string, source_kind string, validation_status string, currency_status string, first_page int, last_page int")


def registered(units: DataFrame) -> DataFrame:
    """``units`` (slug, page, ...) with what the registry says of their source; pages outside the source's window and unknown sources go."""
    known = sources(units.sparkSession)
    joined = units.join(F.broadcast(known), "slug")  # a dimension of a few sources
    inside = (F.col("first_page").isNull() | (F.col("page") >= F.col("first_page"))) & (F.col("last_page").isNull() | (F.col("page") <= F.col("last_page")))
    return joined.where(inside).drop("first_page", "last_page")
