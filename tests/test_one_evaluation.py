"""Checks that are used twice are evaluated once, and only numbers move to the fields that they rest on."""

import itertools
import random

from ledgerline.operators import audit
from ledgerline.plans import audit_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_checks_are_evaluated_once(spark):
    assert plan(audit_queries.summary_counts(spark, SF)).count("orders.parquet") <= 1 and plan(audit_queries.summary_counts(spark, SF)).count("Union") == 0
    assert "Join" not in plan(audit_queries.consensus(spark, SF))


def test_consensus_counts_pairs_of_equal_ids_and_nulls(spark):
    rnd = random.Random(3)
    row = lambda: (rnd.choice([1, 2, 3, None]), rnd.choice(["a", "b", None]), rnd.choice(["passed", "failed", None]))
    for _ in range(4):
        engine, audited = [row() for _ in range(14)], [row() for _ in range(9)]
        want = {}
        for s, c, status in engine:
            w = want.setdefault(s, [0, 0, False])
            found = [x for t, d, x in audited if s is not None and c is not None and (t, d) == (s, c)] or [None]
            w[0] += sum(x is None for x in found)
            w[1] += sum(None not in (x, status) and x != status for x in found)
            w[2] |= status is not None and status != "passed"
        schema = "shipment_id long, check_id string, status string"
        got = {r["shipment_id"]: r for r in audit.consensus(spark.createDataFrame(engine, schema), spark.createDataFrame(audited, schema)).collect()}
        assert {s: (r["omitted"], r["differing"]) for s, r in got.items()} == {s: tuple(w[:2]) for s, w in want.items()}
        assert all(bool(got[s]["needs_review"]) == (w[0] > 0 or w[1] > 0 or w[2]) for s, w in want.items())


def test_evidence_moves_numbers_and_leaves_what_no_check_rests_on(spark):
    checks = spark.createDataFrame([(1, "item_quantity_match", 2, 3, 1, None), (1, "invoice_total_consistency", None, None, None, None), (1, "other", 2, 3, 4, 5)], "shipment_id long, check_id string, invoice_index int, packing_index int, invoice_page int, packing_page int")
    places = itertools.product(("invoice", "packing_list"), (2, 3, None), ("quantity", "invoice_total", "colour"))
    fields = spark.createDataFrame([(1, d, i, f, f"{d}{i}{f}", 7) for d, i, f in places], "shipment_id long, document string, item_index int, field string, value string, page int")
    found = audit.document_evidence(checks, fields, spark)
    got = sorted((r["check_id"], r["item_index"], r["document"], r["value"], r["page"]) for r in found.collect() if r["check_id"] != "other")
    assert got == [("invoice_total_consistency", None, "invoice", "invoiceNoneinvoice_total", 7), ("item_quantity_match", 2, "invoice", "invoice2quantity", 7), ("item_quantity_match", 3, "packing_list", "packing_list3quantity", 7)]
    assert sorted((r["document"], r["page"]) for r in found.where("check_id = 'other'").collect()) == [("invoice", 4), ("packing_list", 5)]
    keys = [line for line in plan(found).splitlines() if "Join Inner" in line and "shipment_id" in line]
    assert len(keys) == 1 and "document" not in keys[0] and "_place" in keys[0]
