"""Prefix tree of conversations by partition refinement.

All conversations begin in one class, the root's. A round splits every class of several members at
the first turn where its members differ or one ends, by the turn they have there; the turns up to
it are a run of nodes that all members share. Classes of one member retire: their remaining turns
are a chain of nodes with no branch, written without looking at them again. Rounds go on while a
class of several is left, so there are as many as branches lie above each other, whatever the
length of conversations. What nodes say of their subtree is then folded back, round by round, from the last to the first.

Turns stay rows, of a hash (SHA-256 of role and text), a length and a place; no list of the turns
of a conversation or of the members of a class is ever held in a row. Members meet their class in
plain joins, whose hot keys Spark splits, after counts that are summed before they are shuffled.
Places of turns are dense numbers by sorted ranges, so that a conversation may hold most rows.
The ids of those that end at a node are joined in chunks of ``CHUNK`` by their number, and the chunks
of a node, in order, pass through one running hash.

Defined results: null roles and texts are empty; turns with equal numbers go by role and text, null
turns first; rows without a conversation id belong to none and make no node; repeated rows are
turns of their own; an empty table has no node, not even the root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import dense_numbers
from .common import shipped, stored

CHUNK = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, key, chars): the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    numbers = dense_numbers(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], "p")
    key = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    return numbers.select("conv_id", "p", key.alias("key"), F.length("text").cast("long").alias("chars"))


def with_shared_openings(rows: DataFrame, base: Column, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation begins with the first ``opening`` turns of the one
    ``base`` names (all if fewer, none if absent), and goes on with its own after its first ``opening``.

    ``rows`` is what ``turns`` returns; ``base`` and ``opening`` (at most ``most``) are of conv_id.
    """
    heads = rows.where(F.col("p") <= most)
    convs = rows.where("p = 1").select("conv_id", base.alias("_base"), opening.alias("_h"))
    known = heads.groupBy(F.col("conv_id").alias("_base")).agg(F.max("p").alias("_known"))
    convs = stored(convs.join(known, "_base", "left").withColumn("_gap", F.col("_h") - F.least("_h", F.coalesce("_known", F.lit(0)))))
    begun = convs.join(heads.withColumnRenamed("conv_id", "_base"), "_base").where("p <= _h").select("conv_id", "p", "key", "chars")
    gaps = convs.where("_gap > 0").select("conv_id", "_gap")
    own = rows.where(F.col("p") > opening).join(gaps, "conv_id", "left").select("conv_id", (F.col("p") - F.coalesce("_gap", F.lit(0))).alias("p"), "key", "chars")
    return stored(begun.unionByName(own)), convs.select("conv_id")


def _refined(seq: DataFrame, convs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of runs (rep, first, last, n, up, up_first) and of ends (rep, at, conv_id), one for each round.

    A run is the nodes at depths ``first`` to ``last`` of ``rep``, its least member; ``up`` and
    ``up_first`` name the run above. Ends are of runs of several members.
    """
    lengths = seq.groupBy("conv_id").agg(F.max("p").alias("length"))
    members = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    top = members.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).first()
    if not top["n"]:
        return [], []
    spark = seq.sparkSession
    many = stored(members.withColumns({"rep": F.lit(top["rep"]).cast("long"), "first": F.lit(0).cast("long")}))
    classes = spark.createDataFrame([(top["rep"], 0, top["n"], None, None)], "rep long, first long, n long, up long, up_first long")
    runs, ends, root = [], [], True
    while True:
        # turns of the members below their class's first node, and how far all agree
        below = many.join(seq, "conv_id").where("p > first")
        if root:
            agreed = classes.select("rep", "first", "n", "up", "up_first", F.col("first").alias("last"))
        else:
            places = below.groupBy("rep", "first", "p").agg(F.count("*").alias("have"), F.min("key").alias("a"), F.max("key").alias("b")).join(classes.select("rep", "first", "n"), ["rep", "first"])
            alike = (F.col("have") == F.col("n")) & (F.col("a") == F.col("b"))
            reach = places.groupBy("rep", "first").agg(F.min(F.when(~alike, F.col("p") - 1)).alias("parts"), F.max("p").alias("deepest"))
            agreed = classes.join(reach, ["rep", "first"], "left").select("rep", "first", "n", "up", "up_first", F.coalesce("parts", "deepest", "first").alias("last"))
        agreed = stored(agreed)
        runs.append(agreed)
        ends.append(many.join(agreed.select("rep", "first", "last"), ["rep", "first"]).where("length = last").select("rep", F.col("last").alias("at"), "conv_id"))
        parted = stored(
            many.join(agreed.select("rep", "first", "last"), ["rep", "first"]).where("length > last")
            .withColumn("p", F.col("last") + 1).join(seq.select("conv_id", "p", "key"), ["conv_id", "p"])
            .select("conv_id", "length", F.col("rep").alias("up"), F.col("first").alias("up_first"), "p", "key")
        )
        split = stored(parted.groupBy("up", "up_first", "p", "key").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("length").alias("length")))
        runs.append(split.where("n = 1").select("rep", F.col("p").alias("first"), "n", "up", "up_first", F.col("length").alias("last")))
        again = split.where("n > 1")
        if again.isEmpty():
            return runs, ends
        classes = again.select("rep", F.col("p").alias("first"), "n", "up", "up_first")
        many = stored(parted.join(again.select("up", "up_first", "key", "rep"), ["up", "up_first", "key"]).select("conv_id", "length", "rep", F.col("p").alias("first")))
        root = False


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where members end, by their ids in ascending order."""
    numbers = dense_numbers(ends, ["rep", "at"], [F.col("conv_id")], "k")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")), ",")
    chunks = numbers.groupBy("rep", "at", F.floor((F.col("k") - 1) / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.repartition(parts, "rep", "at").sortWithinPartitions("rep", "at", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, None
        for batch in batches:
            out = []
            for rep, at, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "at", "ids"))):
                if (rep, at) == node:
                    held.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, held.hexdigest()))
                    node, held = (rep, at), hashlib.sha256(ids.encode())
            yield _node_rows(out)
        if node:
            yield _node_rows([(*node, held.hexdigest())])

    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _node_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])


def prefix_trie(seq: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the tree of ``seq`` (conv_id, p from 1 without gaps, key, chars), the
    root included; ``convs`` (conv_id) names all conversations, also those without turns."""
    spark = shipped(seq.sparkSession)
    runs, ends = _refined(seq, convs)
    if not runs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # what the nodes of a shared run save, from each to the run's end
    shared = runs[0]
    for table in runs[2::2]:
        shared = shared.unionByName(table)
    down = Window.partitionBy("rep", "first").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = shared.join(seq.select(F.col("conv_id").alias("rep"), "p", "chars"), "rep").where("p between first and last")
    tails = stored(nodes.select("rep", "first", "p", (F.sum("chars").over(down) * (F.col("n") - 1)).alias("tail")))
    whole = tails.where("p = first").select("rep", "first", "tail")
    # fold back: each round's runs give their leaves and savings to the runs above
    folded, given = [], None
    for k in range(len(runs) - 2, -1, -2):
        single = runs[k + 1].select("up", "up_first", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        given = single if given is None else single.unionByName(given)
        sums = given.groupBy(F.col("up").alias("rep"), F.col("up_first").alias("first")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        level = runs[k].join(sums, ["rep", "first"], "left").join(whole, ["rep", "first"], "left")
        level = stored(level.select("rep", "first", "last", "n", "up", "up_first", F.coalesce("children", F.lit(0)).cast("long").alias("children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), F.coalesce("below", F.lit(0)).cast("long").alias("below"), F.coalesce("tail", F.lit(0)).cast("long").alias("tail")))
        folded.append(level)
        given = level.select("up", "up_first", "leaves", (F.col("below") + F.col("tail")).alias("saved"))
    levels, chains, ended = folded[0], runs[1], ends[0]
    for table in folded[1:]:
        levels = levels.unionByName(table)
    for table in runs[3::2]:
        chains = chains.unionByName(table)
    for table in ends[1:]:
        ended = ended.unionByName(table)
    zero = F.lit(0).cast("long")
    every = levels.select("rep", "first", "last", "n", "up", "children", "leaves", "below").unionByName(
        chains.select("rep", "first", "last", "n", "up", zero.alias("children"), F.lit(1).cast("long").alias("leaves"), zero.alias("below")))
    root = levels.where("first = 0").select("rep", "first", "last", "n", "up", "children", "leaves", "below", zero.alias("p"))
    placed = every.join(seq.select(F.col("conv_id").alias("rep"), "p"), "rep").where("p between first and last").unionByName(root)
    rows = placed.join(tails, ["rep", "first", "p"], "left").join(_ends_hashes(ended).select(F.col("conv_id").alias("rep"), F.col("depth").alias("p"), "ends_sha256"), ["rep", "p"], "left")
    alone = (F.col("n") == 1) & (F.col("p") == F.col("last")) & (F.col("p") > 0)
    return rows.select(
        F.col("rep").alias("conv_id"),
        F.col("p").alias("depth"),
        F.when(F.col("p") > F.col("first"), F.col("rep")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("p") < F.col("last"), F.lit(1).cast("long")).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.coalesce("tail", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.when(alone, F.sha2(F.col("rep").cast("string"), 256)), F.lit(NO_IDS)).alias("ends_sha256"),
    )
