"""Numbers, medians and digests where one group holds most rows; whole provenance in rule evaluation."""

import datetime
import random
import statistics

from pyspark.sql import functions as F

from ledgerline.operators import evaluation, rules
from ledgerline.sources import files


def test_medians_are_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, *[rnd.randint(0, 40) / 4 for _ in range(9)]])) for _ in range(3000)] + [("none", None)] * 3 + [("one", 7.5)]
    df = spark.createDataFrame(rows, "kind string, v double").repartition(7)
    want = {k: (statistics.median(vs) if (vs := [v for q, v in rows if q == k and v is not None]) else None) for k in {k for k, _ in rows}}
    assert {r["kind"]: r["median"] for r in evaluation.medians(df, ["kind"], "v").collect()} == want
    assert evaluation.medians(df, [], "v").first()["median"] == statistics.median([v for _, v in rows if v is not None])
    assert evaluation.medians(df.limit(0), [], "v").first()["median"] is None


def test_version_is_of_contents_not_of_partitions(spark):
    rows = [(f"p{k:04}", f"text {k}" if k % 9 else None) for k in range(5000)]
    df = spark.createDataFrame(rows, "path string, text string")
    found = {files.version(df.repartition(n)).first()["version"] for n in (1, 5, 13)}
    assert len(found) == 1 and None not in found
    other = df.withColumn("text", F.when(F.col("path") == "p4321", "changed").otherwise(F.col("text")))
    assert files.version(other).first()["version"] not in found
    assert files.version(df.limit(1)).first()["version"] and files.version(df.limit(0)).first()["version"] is None


def test_evaluation_needs_whole_provenance(spark):
    """A pass falls for each of the eight legal fields that is missing, and for an uncertain status; others stay."""
    base = dict(rule_id="r", check_type="required_document", applies_to=["1"], required_document="form_e", destination=None, deadline_days=None, requirement=None, validation_status="verified", source_document="d", source_url="u", issuing_authority="a", effective_date="2025-01-01", government=True, source_page=3, source_locator=None, legal_cutoff_date=datetime.date(2026, 7, 22), rule_data_version="1")
    cases = {
        "whole": {}, "locator": {"source_page": None, "source_locator": "annex"}, "cutoff": {"legal_cutoff_date": None}, "private": {"government": False, "source_url": None},
        "source_document": {"source_document": ""}, "source_url": {"source_url": None}, "source_page_or_source_locator": {"source_page": None}, "issuing_authority": {"issuing_authority": None}, "effective_date": {"effective_date": None}, "rule_data_version": {"rule_data_version": None},
        "uncertain_validation": {"validation_status": "partially_verified", "check_type": "required_document"},
    }
    rows = [{**base, **change, "rule_id": name} for name, change in cases.items()]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], rules.RULE_SCHEMA)
    ships = spark.createDataFrame([(1, "1", "Germany", datetime.date(2026, 1, 1), None)], "shipment_id long, code string, destination string, shipment_date date, letter_of_credit_date date")
    documents = spark.createDataFrame([(1, "form_e")], "shipment_id long, document string")
    got = {r["check_id"]: (r["status"], r["reasons"]) for r in rules.evaluate(ships, documents, table).collect()}
    for name in ("whole", "locator", "cutoff", "private", "uncertain_validation"):
        assert got[name] == ("passed", ""), name
    for name in set(cases) - {"whole", "locator", "cutoff", "private", "uncertain_validation"}:
        assert got[name] == ("manual_review", name), name
