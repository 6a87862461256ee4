"""Pairing two sets of line items through a cascade of keys that are unique on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strategies in order: name, key column, key expression.
STRATEGIES = (("line_reference", "line_ref"), ("pct_code", "code"), ("product", "product"))
#: Where an item without an invoice index stands in the order of results.
LAST = 10_000


def match_items(invoice: DataFrame, packing: DataFrame, strategies: Sequence[tuple[str, str]] = STRATEGIES) -> DataFrame:
    """(shipment_id, invoice_index, packing_index, match_status, strategy): a full outer match.

    Each strategy pairs what stands exactly once on each side among the rows that earlier ones
    left; so later strategies count anew. Null keys never match. Both sides are one table with
    one exchange, by shipment: a strategy counts its keys' free rows in a window, where each row of a
    pair sees its partner, and no side is ever read again.
    """
    keys = [k for _, k in strategies]
    side = lambda df, first: df.select("shipment_id", F.col("item_index").cast("int").alias("_index"), *keys, F.lit(first).alias("_first"))
    rows = side(invoice, True).unionByName(side(packing, False)).repartition("shipment_id")
    rows = rows.withColumns({"_partner": F.lit(None).cast("int"), "strategy": F.lit(None).cast("string")})
    first = F.col("_first")
    for name, key in strategies:
        group = Window.partitionBy("shipment_id", key)
        free = F.col("_partner").isNull() & F.col(key).isNotNull()
        seen = lambda mine: F.struct(F.count_if(free & mine).over(group).alias("n"), F.max(F.when(free & mine, F.col("_index"))).over(group).alias("index"))
        rows = rows.withColumns({"_a": seen(first), "_b": seen(~first)})
        hit = free & (F.col("_a.n") == 1) & (F.col("_b.n") == 1)
        rows = rows.withColumns({"strategy": F.when(hit, name).otherwise(F.col("strategy")), "_partner": F.when(hit, F.when(first, F.col("_b.index")).otherwise(F.col("_a.index"))).otherwise(F.col("_partner"))})
    paired = F.col("_partner").isNotNull()
    return rows.where(first | ~paired).select(
        "shipment_id",
        F.when(first, F.col("_index")).alias("invoice_index"),
        F.when(first, F.col("_partner")).otherwise(F.col("_index")).alias("packing_index"),
        F.when(paired, "matched").when(first, "invoice_only").otherwise("packing_only").alias("match_status"),
        "strategy",
    )


def in_order(matches: DataFrame) -> DataFrame:
    """With the position of each row in its shipment's results: matched first, then by index."""
    order = Window.partitionBy("shipment_id").orderBy(
        F.when(F.col("match_status") == "matched", 0).otherwise(1), F.coalesce("invoice_index", F.lit(LAST)), F.coalesce("packing_index", F.lit(LAST))
    )
    return matches.withColumn("position", F.row_number().over(order))
