"""Queries over small tables of their own, in cases that the given tables lack."""

import hashlib
import re

from compare import both

from ledgerline import catalog
from ledgerline.operators import chunking
from ledgerline.plans import views


def _table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_labels_in_bodies_count(spark, tmp_path):
    far = "word " * 5000
    rows = [(10, f"{far}\nInvoice No: INV-777\n{far}"), (14, f"{far}\n  invoice number\nINV-9999\n{far}"), (20, f"{far} Invoice No: INV-777"), (30, None), (15, "Date: 2026-01-02")]
    sf = _table(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {(r["doc_id"], r["field"]): (r["value"], r["grade"]) for r in catalog.QUERIES["graded_fields"](spark, sf).collect()}
    number = {k: got[k, "invoice_number"] for k, _ in rows}
    assert number == {10: ("INV-A10", "low"), 14: ("INV-9999", "high"), 20: ("INV-A20", "high"), 30: ("INV-A30", "high"), 15: ("INV-A15", "high")}
    assert got[15, "invoice_date"] == ("2026-01-02", "high") and all(got[k, "pct_code"] == ("61091000", "high") for k, _ in rows)
    assert {r["field"]: r["resolved"] for r in catalog.QUERIES["extraction_coverage"](spark, sf).collect()}["invoice_number"] == 4
    assert {r["doc_id"]: r["value"] for r in catalog.QUERIES["gap_filling"](spark, sf).collect()}[14] == "INV-9999"


#: As the SQL of ``line_chunks``, which leaves out paragraphs of one line, with their sentences.
LINES_AND_SENTENCES = r"""
WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> '') AS ps FROM documents), q AS (SELECT doc_id, i - 1 AS parent, list_filter(string_split(ps[i], chr(10)), lambda x: trim(x) <> '') AS ls, ps[i] AS p FROM p, unnest(range(1, len(ps) + 1)) r(i)),
c AS (SELECT doc_id, parent, CASE WHEN len(ls) > 1 THEN ls ELSE list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x) <> '') END AS cs FROM q), e AS (SELECT doc_id, parent, i - 1 AS child_index, trim(cs[i]) AS child FROM c, unnest(range(1, len(cs) + 1)) r(i))
SELECT doc_id, CAST(parent AS INTEGER) AS parent, CAST(child_index AS INTEGER) AS child_index, CASE WHEN (contains(lower(child), 'invoice') AND contains(lower(child), 'no')) OR contains(lower(child), 'date') THEN 'header' WHEN contains(lower(child), 'total') THEN 'totals' WHEN contains(lower(child), 'weight') THEN 'weights' ELSE 'body' END AS section, sha256(child) AS content_hash FROM e"""


def test_line_chunks_equal_sql_of_lines_and_sentences(spark):
    got, want = both(spark, catalog.QUERIES["line_chunks"], LINES_AND_SENTENCES)
    assert got == want


def test_line_chunks_of_one_line_are_sentences(spark, tmp_path):
    texts = ["One. Two!  Three?four. Total 5", "no stop", "a.\n b. c\n\nx. y\n \nWeight.", " . . ", "\nalone. \n", "", None]
    sf = _table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    want = []
    for k, text in enumerate(texts):
        for p, paragraph in enumerate(x for x in re.split(r"\n\s*\n", text or "") if x.strip(" ")):
            lines = [x for x in paragraph.split("\n") if x.strip(" ")]
            lines = lines if len(lines) > 1 else [x for x in re.split(r"(?<=[.!?])\s+", paragraph) if x.strip(" ")]
            want += [(k, p, c, hashlib.sha256(x.strip(" ").encode()).hexdigest()) for c, x in enumerate(lines)]
    found = catalog.QUERIES["line_chunks"](spark, sf).collect()
    assert sorted((r["doc_id"], r["parent"], r["child_index"], r["content_hash"]) for r in found) == sorted(want)
    assert {(r["doc_id"], r["section"]) for r in found} >= {(0, "totals"), (1, "body"), (2, "weights")}


#: As the SQL of ``shipment_summaries``, which hashes two lines, with all lines.
WHOLE_SUMMARIES = f"""
SELECT o_orderkey AS shipment_id, sha256(concat_ws(chr(10), 'shipment_id: ' || o_orderkey, 'destination: ' || coalesce(n_name, 'unknown'), 'shipment_date: ' || coalesce(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'unknown'),
  'code: ' || (['{"', '".join(views.CODES)}'])[o_orderkey % {len(views.CODES)} + 1], 'exporter: ' || coalesce(c_name, 'unknown'), 'amount: ' || coalesce(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), 'unknown'))) AS checksum
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"""


def test_checksums_equal_sql_of_all_lines(spark):
    got, want = both(spark, catalog.QUERIES["shipment_summaries"], WHOLE_SUMMARIES)
    assert got == want


def test_every_line_counts_in_the_checksum(spark):
    first = (1, "CHINA", "2026-01-02", "61091000", "A", "1.00")
    rows = [first, *((*first[:k], x, *first[k + 1 :]) for k, x in enumerate(("FRANCE", "2026-01-03", "52010090", "B", None), start=1))]
    ships = spark.createDataFrame(rows, "shipment_id long, destination string, shipment_date string, code string, exporter string, amount string")
    found = chunking.summary_text(ships).collect()
    assert len({r["checksum"] for r in found}) == len(rows)
    text = "shipment_id: 1\ndestination: CHINA\nshipment_date: 2026-01-02\ncode: 61091000\nexporter: A\namount: 1.00"
    assert hashlib.sha256(text.encode()).hexdigest() in {r["checksum"] for r in found}


def test_last_answers_with_repeated_rows_and_tied_turns(spark, tmp_path):
    rows = [(1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (2, 3, "assistant", "x"), (2, 3, "assistant", "y"), (2, 4, "user", "u"), (3, 1, "assistant", "only"), (4, 1, "user", "u"), (5, 1, "assistant", "t"), (5, 2, "assistant", None)]
    sf = _table(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    found = sorted(tuple(r) for r in catalog.QUERIES["last_answers"](spark, sf).select("conv_id", "turn", "text").collect())
    assert found == [(1, 2, "b"), (2, 3, "y"), (3, 1, "only"), (5, 1, "t")]
