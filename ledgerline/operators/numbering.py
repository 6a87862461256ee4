"""Dense numbers of rows by key, where one key may hold most of the rows.

``row_number`` over a key sorts all rows of the key in one task. Here rows are first dealt to sorted
ranges of (key, order), so that a large key lies in several of them, and written; a row's number is
its number within its key and range, plus the rows of its key in the ranges before. Only a key that
goes on from one range to the next has such rows: at most one for each range, which bounds the table
that is broadcast.

Defined results: equal rows get neighbouring numbers in any order; a null key is a key; columns keep
their order, and the number comes last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def dense_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "number", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each value of ``keys``, by ``order``."""
    spark = rows.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [F.col(k) for k in keys]
    sort = [f"_order{k}" for k in range(len(order))]
    held = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*plain).alias("_key") if keys else F.lit(0).alias("_key"), *[o.alias(s) for o, s in zip(order, sort)])
    held = held.withColumn("_tie", F.monotonically_increasing_id())  # lets equal rows lie in several ranges
    dealt = stored(held.repartitionByRange(parts, "_key", *sort, "_tie").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_key", "_part").count()
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("_key", "_part", earlier.alias("_before")).where("_before > 0")
    local = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*sort, "_tie"))
    numbered = dealt.select("_row", "_key", "_part", local.alias("_local")).join(F.broadcast(before), ["_key", "_part"], "left")
    return numbered.select("_row.*", (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
