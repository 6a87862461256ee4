"""Dense numbers against row_number, with keys that span many ranges."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.numbering import dense_numbers


def test_numbers_equal_row_number(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", F.desc("id"))).cast("long"))
    got = dense_numbers(df, ["k"], [F.col("v"), -F.col("id")], "n", ranges=13)
    assert got.columns == ["k", "v", "id", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_equal_rows_no_keys_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1)] * 500, "k string, v int").repartition(4)
    assert sorted(r["n"] for r in dense_numbers(df, ["k"], [F.col("v")], "n", ranges=7).collect()) == list(range(1, 501))
    assert sorted(r["n"] for r in dense_numbers(df, [], [F.col("v")], "n", ranges=7).collect()) == list(range(1, 501))
    assert dense_numbers(df.limit(0), ["k"], [F.col("v")], "n").count() == 0
