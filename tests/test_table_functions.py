"""Chunkers called from SQL."""

from ledgerline.functions import table_functions
from ledgerline.operators.chunking import child_windows, parent_sections


def test_pieces_of_each_row(spark):
    table_functions.register(spark)
    text = "first block\n\nSchedule I\nline\n\n" + "x" * 1700 + "\n\n" + "y" * 300
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("texts_to_cut")
    got = spark.sql("SELECT id, s.chunk_index, c.chunk_index AS child_index, c.child FROM texts_to_cut, LATERAL parent_sections(text) s, LATERAL child_windows(s.section) c").collect()
    want = [(1, p, c, child) for p, parent in enumerate(parent_sections(text)) for c, child in enumerate(child_windows(parent))]
    assert sorted(map(tuple, got)) == want and len({w[1] for w in want}) == 3


def test_units_of_a_source_are_numbered_in_order(spark):
    table_functions.register(spark)
    rows = [("b", None, 3, "third"), ("b", None, 1, "first"), ("a", 7, 1, "page"), ("b", None, 2, "second"), ("a", None, 2, None)]
    spark.createDataFrame(rows, "slug string, page int, n int, text string").repartition(4).createOrReplaceTempView("units_to_cut")
    got = spark.sql("SELECT chunk_id, role, text FROM chunk_units(TABLE(units_to_cut) PARTITION BY slug ORDER BY n) WHERE role = 'child'").collect()
    assert sorted(map(tuple, got)) == [("a:pg7:p0:c0", "child", "page"), ("b:u1:p0:c0", "child", "first"), ("b:u2:p0:c0", "child", "second"), ("b:u3:p0:c0", "child", "third")]
