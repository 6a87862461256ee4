"""Sources mixed to target weights by a low-discrepancy schedule.

Targets: each source gets its weight's share of all words, up to ``max_epochs`` times its own
size; what is above is shared anew by weight until none is above (``water_fill``, in closed form
over running sums). Schedule: slot i is the point ``frac((i + 1/2) * golden ratio)``, mapped through
the cumulative shares of slots, which names its source; the r-th slot of a source takes its block
``r mod blocks``, in epoch ``r div blocks``. Blocks: the documents of a source, shuffled by hash,
laid end to end and cut into blocks of equal words (give or take one), through documents where need
be. Joining blocks with slots gives the words of each document that the mix takes.

Positions in a source come from running sums over hash buckets and then inside a bucket, so no
source, however large, is sorted in one task. The schedule is bounded by ``slots`` plus
``max_epochs * LEAST_BLOCKS`` for each source.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source of
its own, last in order; an empty table gives no rows; equal rows may differ in the words taken,
yet the same set of rows comes out of each run; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_WORD, stored

#: Slots that all words make at about one epoch, and blocks that a source is cut into at least.
SLOTS, LEAST_BLOCKS = 65_536, 256
#: Hash buckets of all documents; a source gets its share of them.
BUCKETS = 1024
GOLDEN = 0.6180339887498949
#: Words of a source whose documents are rounded to whole copies together, about.
COPY_WORDS = 4_000_000
#: Pieces of the unit interval by which slots meet the shares of sources.
STRIPS = 64


def water_fill(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """``sizes`` (source, source_size, weight, sid) with the target of each source."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), "sid")
    all_ = Window.partitionBy(F.lit(0))
    capped = F.coalesce(F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum(F.col("weight").cast("double")).over(by.rowsBetween(0, Window.unboundedFollowing))
    # the level if this source and all with a higher cap per weight are not capped
    level = (F.sum("source_size").over(all_) - capped) / open_
    held = sizes.withColumn("_level", level).withColumn("_fits", F.col("_level") <= cap / F.col("weight"))
    first = F.min(F.when(F.col("_fits"), F.struct(F.lit(0), cap / F.col("weight"), F.col("sid"), F.col("_level").alias("level")))).over(all_)["level"]
    return held.withColumn("target", F.when(first.isNull(), cap).otherwise(F.least(cap, first * F.col("weight")))).drop("_level", "_fits")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, source_id (the source's rank), id, size, source_size, target, taken.

    row is the column ``row_col``, which numbers the rows of a table, or else the position when read.

    The sources in code-point order, null last, weigh ``weights``, repeating.
    """
    rows = stored(docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(BLANK_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hash"),
    ))
    by_source = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    sizes = sizes.withColumn("sid", F.row_number().over(by_source) - 1)
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    sizes = water_fill(sizes.withColumn("weight", weigh), max_epochs)
    cut = F.greatest(F.round(F.col("source_size") * SLOTS / F.sum("source_size").over(every)), F.least(F.lit(LEAST_BLOCKS), F.col("source_size")))
    sizes = stored(
        sizes.withColumn("blocks", F.greatest(cut, F.lit(1)).cast("long"))
        .withColumn("buckets", F.greatest(F.ceil(F.col("_docs") * BUCKETS / F.sum("_docs").over(every)), F.lit(1)).cast("long"))
        .withColumn("_slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    )
    uses = schedule(sizes, max_epochs).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    named = sizes.select(F.col("source").alias("_name"), "sid", "source_size", "target", "blocks", "buckets")
    rows = rows.join(named, rows["source"].eqNullSafe(named["_name"]), "left")
    rows = rows.withColumn("_bucket", F.pmod("_hash", "buckets"))
    running = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sid", "_bucket").agg(F.sum("size").alias("_sum"))
    starts = starts.select("sid", "_bucket", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("sid", "_bucket").orderBy("_hash", "_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, ["sid", "_bucket"]).withColumn("_from", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    block_of = lambda x: F.expr(f"(({x} + 1) * blocks - 1) div source_size")
    edge = lambda j: F.expr(f"({j} * source_size) div blocks")
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(block_of("_from"), block_of("_from + size - 1")))))
    parts = parts.withColumn("_part", F.least(F.expr("_from + size"), edge("(block + 1)")) - F.greatest(F.col("_from"), edge("block")))
    taken = parts.join(uses, ["sid", "block"], "left").groupBy("_row", "_id", "sid", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("_part") * F.col("uses")), F.lit(0)).alias("taken"))
    return taken.select(F.col("_row").alias("row"), F.col("sid").alias("source_id"), F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def copies(mixed: DataFrame) -> DataFrame:
    """What ``mix`` returns with ``copies``: how often each whole document comes.

    That is its words taken by its size, rounded so that a source's words stay near what is taken of
    it: a source's documents are dealt to buckets by hash, laid out by size in each, and of the
    running sum of the exact numbers the whole ones count. The rounding of one document is thus
    carried on to the next, which is about as long. No document comes more than ``max_epochs`` times.
    """
    exact = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    part = F.pmod(F.xxhash64("row"), F.greatest(F.ceil(F.col("source_size") / COPY_WORDS), F.lit(1)))
    order = Window.partitionBy("source_id", "_part").orderBy(F.desc("size"), "row")
    whole = lambda c: F.floor(c + 0.5 + 1e-9)
    sums = mixed.withColumn("_part", part).withColumn("_exact", exact).withColumn("_to", F.sum("_exact").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sums.withColumn("copies", (whole(F.col("_to")) - whole(F.col("_to") - F.col("_exact"))).cast("int")).drop("_part", "_exact", "_to")


def schedule(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """(slot, sid, epoch, block): which block of which source each slot of the mix takes.

    sizes: sid, blocks, _slots (a source's slots, as a fraction).
    """
    spark = sizes.sparkSession
    total = int(round(sizes.agg(F.sum("_slots")).first()[0] or 0))
    order = Window.partitionBy(F.lit(0)).orderBy("sid")
    share = F.col("_slots") / F.sum("_slots").over(Window.partitionBy(F.lit(0)))
    ends = sizes.withColumn("_share", share).withColumn("_to", F.sum("_share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("sid").desc())) == 1
    ends = ends.where("_slots > 0").withColumn("_from", F.coalesce(F.lag("_to").over(order), F.lit(0.0))).withColumn("_to", F.when(last, F.lit(2.0)).otherwise(F.col("_to")))
    strip = lambda c: F.least(F.floor(F.col(c) * STRIPS), F.lit(STRIPS - 1))
    ends = ends.select("sid", "blocks", "_from", "_to", F.explode(F.sequence(strip("_from"), strip("_to"))).alias("_strip"))
    point = F.expr(f"((id + 0.5D) * {GOLDEN}D) - floor((id + 0.5D) * {GOLDEN}D)")
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("_at")).withColumn("_strip", strip("_at"))
    named = slots.join(ends, "_strip").where("_at >= _from and _at < _to")
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1
    ranked = named.withColumn("_rank", rank).where(F.col("_rank") < F.col("blocks") * max_epochs)
    return ranked.select("slot", "sid", F.expr("_rank div blocks").alias("epoch"), F.expr("_rank % blocks").alias("block"))
