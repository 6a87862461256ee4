"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group and stay together, unless the group exceeds a whole shard by
bytes, tokens or rows; such a group is cut into pieces of a quarter of a shard. Groups of more than
one part in ``SINGLES`` of a shard, and pieces, are packed one by one, with their own vectors. The
many small ones are gathered into bundles of alike vectors: by the magnitude of their bytes and of
their tokens, and by hash. So what is packed is a list whose length is bounded by the number of
shards, whatever the corpus holds, and the vector of each item is measured exactly. Items are packed from the
largest on, each into the shard where the dot product of its vector with the shard's residual
capacity is highest; a shard without room left for the bytes comes last. Slots are numbered by
lanes of rows inside an item, from each lane's offset, so no shard or item is ever sorted as a whole.

Defined results: a null text has 1 byte, no token, and the CRC of no bytes; an empty table gives
no rows; repeated rows get a slot each; the order of ids decides slots, null ids first; a very long
text is a group of its own and is never cut; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_WORD, stored

#: A group that holds more than one part in so many of a shard is packed on its own.
SINGLES = 64
#: Pieces of a shard's size that a group is cut into which exceeds one.
PIECES = 4
#: Bundles of each class of small groups, for each shard.
BUNDLES = 2
#: Rows of an item that are numbered together, about.
LANE_ROWS = 100_000
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (1.0, 1.0, 1.0)


def pack(vectors: np.ndarray, bins: int, weights=WEIGHTS) -> np.ndarray:
    """The bin of each row of ``vectors``, whose first dimension is the one that must come out even."""
    total = np.maximum(vectors.sum(axis=0), 1e-9)
    need = vectors / total * bins
    left, place = np.ones((bins, vectors.shape[1])), np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(need)), -need.max(axis=1))) if len(need) else []:
        score = left @ (need[i] * weights)
        fits = left[:, 0] >= need[i, 0]
        at = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        place[i] = at
        left[at] -= need[i]
    return place


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row (``row_col``, or its position when read), id, size, text_crc32, tokens, item, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(BLANK_WORD)), F.lit(0)).cast("long").alias("tokens"), F.xxhash64(text).alias("_text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"),
    ))
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = rows.agg(*sums).first()
    share = F.greatest(*[F.col(c) * shards / F.lit(max(total[c] or 0, 1)) for c in ("b", "t", "n")])  # of a shard
    key = ["_text", "text_crc32", "size"]
    pieces = F.when(share > 1, F.ceil(share * PIECES)).otherwise(F.lit(1)).cast("long")
    # 3 * shards * SINGLES at most
    single = rows.groupBy(*key).agg(*sums).where(share > 1 / SINGLES).select(*key, pieces.alias("_pieces")).collect()
    first = np.cumsum([0] + [r["_pieces"] for r in single])
    single = spark.createDataFrame([(*r, int(f)) for r, f in zip(single, first)], "_text long, text_crc32 long, size long, _pieces long, _first long")
    magnitude = lambda c: F.floor(F.log2(c + 1)).cast("long")
    bundle = (magnitude(F.col("size")) * 64 + magnitude(F.col("tokens"))) * (shards * BUNDLES) + F.pmod(F.xxhash64(*key, F.lit(5)), F.lit(shards * BUNDLES))
    item = F.coalesce(F.col("_first") + F.pmod(F.xxhash64("_row"), "_pieces"), -1 - bundle)
    rows = rows.join(F.broadcast(single), key, "left").withColumn("item", item)
    items = sorted(rows.groupBy("item").agg(*sums).collect(), key=lambda r: r["item"])
    place = pack(np.array([[r["b"], r["t"], r["n"]] for r in items], dtype=float).reshape(-1, 3), shards)
    filled, to = [0] * shards, []
    for r, at in zip(items, place.tolist()):
        to.append((r["item"], at, filled[at], -(-r["n"] // LANE_ROWS)))
        filled[at] += r["n"]
    to = spark.createDataFrame(to, "item long, shard int, _before long, _lanes long")
    rows = rows.join(F.broadcast(to), "item").withColumn("_lane", F.pmod(F.xxhash64("_row", F.lit(3)), "_lanes"))
    earlier = Window.partitionBy("item").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = rows.where("_lanes > 1").groupBy("item", "_lane").agg(F.count("*").alias("n"))
    lanes = lanes.select("item", "_lane", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_skip"))
    order = Window.partitionBy("item", "_lane").orderBy("_id", "text_crc32", "size", "_row")
    slot = F.col("_before") + F.coalesce("_skip", F.lit(0)) + F.row_number().over(order) - 1
    return rows.join(lanes, ["item", "_lane"], "left").select(F.col("_row").alias("row"), F.col("_id").alias(id_col), "size", "text_crc32", "tokens", "item", "shard", slot.alias("slot"))
