"""Small cases with known answers: ambiguity, null arms, rounding, lattice, bounds."""

from pyspark.sql import functions as F

from ledgerline.functions import normalise as N
from ledgerline.functions import predicates as P
from ledgerline.functions.tokens import _embed
from ledgerline.operators import chunking, extraction, matching, reconcile, retrieval
from ledgerline.status import overall, worst

ITEM = "shipment_id long, item_index int, line_ref int, code long, product string"


def test_ambiguous_keys_wait_for_a_later_strategy(spark):
    invoice = spark.createDataFrame([(1, 1, 1, 10, "a"), (1, 2, 1, 20, "b"), (1, 3, 2, 30, "c"), (1, 4, None, None, None)], ITEM)
    packing = spark.createDataFrame([(1, 1, 1, 20, "b"), (1, 2, 2, 99, "x"), (1, 3, None, None, None)], ITEM)
    got = {(r["invoice_index"], r["packing_index"], r["strategy"]) for r in matching.match_items(invoice, packing).collect()}
    assert got == {(3, 2, "line_reference"), (2, 1, "pct_code"), (1, None, None), (4, None, None), (None, 3, None)}


def test_lattice(spark):
    rows = spark.createDataFrame([(1, "not_applicable"), (2, "passed"), (2, "manual_review"), (3, "failed"), (3, "manual_review")], "k int, s string")
    assert {r["k"]: r["v"] for r in rows.groupBy("k").agg(worst(F.col("s")).alias("v")).collect()} == {1: "passed", 2: "manual_review", 3: "failed"}
    assert rows.where("k = 2").agg(overall(F.col("s"), F.lit(0)).alias("v")).first()["v"] == "manual_review"


def test_rounding_and_tolerance(spark):
    schema = "shipment_id long, item_index int, quantity decimal(18,4), unit_price decimal(18,4), line_total decimal(18,4), net_weight decimal(18,4), gross_weight decimal(18,4)"
    from decimal import Decimal as D

    rows = spark.createDataFrame([(1, 1, D("1"), D("2.345"), D("2.36"), None, None), (1, 2, None, D("1"), D("1"), D("2"), D("1")), (1, 3, D("1"), D("2"), D("2.02"), D("1"), D("1"))], schema)
    got = {r["item_index"]: (r["item_calculation"], r["product_calculation"], r["weight_consistency"]) for r in reconcile.line_checks(rows).collect()}
    assert got == {1: ("passed", "passed", "not_applicable"), 2: ("manual_review", "not_applicable", "failed"), 3: ("failed", "failed", "passed")}


def test_dates(spark):
    rows = spark.createDataFrame([("05/03/2026",), ("25/03/2026",), ("05/05/2026",), ("3 Mar 79",), ("Mar 3, 80",), ("2026-02-30",), (None,)], "x string")
    d = N.date_parts(F.col("x"))
    got = {r["x"]: (str(r["d"]["date"]), r["d"]["ambiguous"]) for r in rows.select("x", d.alias("d")).collect()}
    assert got["05/03/2026"] == ("None", True) and got["25/03/2026"] == ("2026-03-25", False) and got["05/05/2026"] == ("2026-05-05", False)
    assert got["3 Mar 79"][0] == "2079-03-03" and got["Mar 3, 80"][0] == "1980-03-03" and got["2026-02-30"] == ("None", False) and got[None] == ("None", False)


def test_destinations(spark):
    rows = spark.createDataFrame([("Goods for the U.S.A., from China",), ("cotton",), ("to the United Kingdom from pakistan",)], "x string")
    assert [r[0] for r in rows.select(P.asked_destination(F.col("x"))).collect()] == ["USA", None, "United Kingdom"]


def test_query_tokens_count_with_multiplicity(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    index = retrieval.postings(docs)
    queries = spark.createDataFrame([(1, "a"), (2, "a a")], "query_id long, text string")
    got = {r["query_id"]: r["score"] for r in retrieval.bm25(index, queries).collect()}
    assert abs(got[2] - 2 * got[1]) < 2e-6


def test_rows_are_anchored_at_their_first_word():
    words = [(0, m - 1, 5, m + 1, str(m)) for m in (0.0, 2.5, 5.0)]
    assert [[w[4] for w in r] for r in extraction.word_rows(words)] == [["0.0", "2.5"], ["5.0"]]


def test_chunks_keep_all_text():
    text = "\n\n".join(f"Section {k}\n" + "word " * 150 for k in range(6)) + "\n\n" + "x" * 5000
    parents = chunking.parent_sections(text)
    assert "".join("".join(parents).split()) == "".join(text.split())
    assert all("".join("".join(chunking.child_windows(p)).split()) == "".join(p.split()) for p in parents)


def test_embedding_has_length_one():
    v = _embed("export of cotton", 256)
    assert abs((v * v).sum() - 1) < 1e-9 and not _embed("", 256).any()


def test_matching_counts_keys_anew_after_each_strategy(spark):
    """Against the cascade spelled out, on small shipments with many equal and null keys; with one exchange."""
    import random

    rnd = random.Random(5)
    pick = lambda xs: rnd.choice(xs)
    item = lambda: (pick([None, 1, 2, 3]), pick([None, 10, 20]), pick(["p", "q", None]))
    sides = [[(s, k, *item()) for s in range(120) for k in range(1, rnd.randint(0, 5) + 1)] for _ in range(2)]
    a, b = (spark.createDataFrame(rows, "shipment_id long, item_index int, line_ref int, code int, product string") for rows in sides)
    want = set()
    for s in range(120):
        left, right = ({r[1]: r[2:] for r in rows if r[0] == s} for rows in sides)
        for n, (name, _) in enumerate(matching.STRATEGIES):
            once = lambda side: {k: i for i, ks in side.items() if (k := ks[n]) is not None and sum(o[n] == k for o in side.values()) == 1}  # noqa: B023, E731
            l1, r1 = once(left), once(right)
            for k in l1.keys() & r1.keys():
                want.add((s, l1[k], r1[k], "matched", name))
                del left[l1[k]], right[r1[k]]
        want |= {(s, i, None, "invoice_only", None) for i in left} | {(s, None, i, "packing_only", None) for i in right}
    found = matching.match_items(a, b)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
