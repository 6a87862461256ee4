"""A stored BM25 index: postings in blocks, read by token, scored only where they can matter.

A row of the index is the postings of one token in one *range* of documents (ranges are dealt by a
hash of the id, about ``RANGE_DOCS`` documents each): ids, frequencies and lengths as arrays, beside
how many they are, the greatest frequency and the least length. Rows lie in ``BUCKETS`` folders by a
hash of the token and sorted by token in them, so that a search opens the folders of its tokens and
Parquet's statistics skip the rest. Corpus figures are the postings of the empty token, which every
document has. Frequencies are in the index as they are, not as scores, so no figure of it goes stale.

A search takes all queries at once and never looks at a text. From the small columns of its tokens'
rows it bounds what a document of each range can score. The ranges with the greatest bounds that surely
hold enough documents are scored first; their last wanted score is a threshold, and of the other
ranges only those whose bound reaches it are read. What is left out can't be among the best, so
results are those of scoring everything.

Work is dealt by (block of queries, range): one matrix of at most ``QUERY_BLOCK`` queries or so times
the documents of a range, whatever the frequency of a token.

Defined results: documents without tokens and null texts are not indexed; rows with equal ids are one
document if their lengths agree; queries without known tokens have no hits; ties go by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import tokens
from ..storage import cached, stored
from .retrieval import K1, B

BUCKETS, RANGE_DOCS, QUERY_BLOCK = 32, 4096, 512
#: A small corpus is cut into this many ranges all the same, so that they can be scored side by side.
LEAST_RANGES = 32
#: The token that every document has.
EVERY = ""


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _postings(range_: int, held: list[tuple[pa.Array, pa.Array, pa.Array]]) -> pa.RecordBatch:
    """The blocks of one range, from batches of (id, tokens, length) of its documents; by token."""
    ids, lists, lengths = (pa.concat_arrays(x) for x in zip(*held))
    place = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    length = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).dictionary_encode()
    names = pa.concat_arrays([flat.dictionary, pa.array([EVERY], pa.string())])
    token = np.concatenate((flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(ids), len(names) - 1)))
    row = np.concatenate((np.repeat(np.arange(len(ids)), length), np.arange(len(ids))))
    # rows with equal ids and lengths are one document
    _, first, document = np.unique(np.stack((place, length)), axis=1, return_index=True, return_inverse=True)
    key, tf = np.unique(token * len(first) + document.ravel()[row], return_counts=True)
    token, row = key // len(first), first[key % len(first)]
    edges = np.flatnonzero(np.diff(token, prepend=-1, append=-1))
    cut, dl = pa.array(edges, pa.int32()), length[row]
    listed = lambda x: pa.ListArray.from_arrays(cut, x)
    starts = edges[:-1]
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(token[starts])), pa.array(np.full(len(starts), range_), pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array(np.maximum.reduceat(tf, starts), pa.int32()), pa.array(np.minimum.reduceat(dl, starts), pa.int32()),
         listed(ids.take(pa.array(row))), listed(pa.array(tf, pa.int32())), listed(pa.array(dl, pa.int32()))],
        names=["token", "range", "n", "tf_most", "dl_least", "docs", "tfs", "dls"],
    )


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", range_docs: int = RANGE_DOCS) -> None:
    """Index ``docs`` at ``path``, which must not exist.

    Texts move once, to the task of their range, where all its postings are made; postings never move.
    """
    count = docs.count()
    ranges = max(1, count // range_docs, min(LEAST_RANGES, count // 256))
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
    split = dealt.repartition("range").sortWithinPartitions("range").select("range", "doc_id", tokens(F.col("_text")).alias("_t")).select("range", "doc_id", "_t", F.size("_t").alias("dl")).where("dl > 0")

    def run(batches):
        last, held = None, []
        for batch in batches:
            numbers = batch.column("range").to_numpy()
            edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1)).tolist()
            for begin, end in zip(edges, edges[1:]):
                if held and numbers[begin] != last:
                    made = _postings(last, held)
                    yield from (made.slice(at, 2000) for at in range(0, made.num_rows, 2000))
                    held = []
                last = int(numbers[begin])
                held.append(tuple(batch.column(c).slice(begin, end - begin) for c in ("doc_id", "_t", "dl")))
        if held:
            made = _postings(last, held)
            yield from (made.slice(at, 2000) for at in range(0, made.num_rows, 2000))

    ids = T.ArrayType(split.schema["doc_id"].dataType)
    schema = T.StructType([*T.StructType.fromDDL("token string, range int, n int, tf_most int, dl_least int").fields, T.StructField("docs", ids), *T.StructType.fromDDL("tfs array<int>, dls array<int>").fields])
    blocks = split.mapInArrow(run, schema).withColumn("bucket", _bucket(F.col("token")))
    blocks.sortWithinPartitions("bucket", "token", "range").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def index_of(docs: DataFrame, signature: str) -> DataFrame:
    """The index of ``docs`` in the shared folder, written when ``signature`` (of data and reading) is not there yet."""
    return cached(docs, f"lexical-{signature}-{BUCKETS}-{RANGE_DOCS}", lambda path: write_index(docs, path))


def terms(index: DataFrame) -> DataFrame:
    """(token, df, total) of the indexed corpus, without its texts."""
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return index.where(F.col("token") != EVERY).groupBy("token").agg(F.sum("n").alias("df"), F.sum(total).alias("total"))


def _scored(blocks: DataFrame, weights: DataFrame, pairs: DataFrame, average: float, limit: int) -> DataFrame:
    """(query_id, doc_id, score): in each range that ``pairs`` (qblock, query_id, range, threshold) names for a query, its first ``limit`` from ``threshold`` on.

    Postings move bare, once for each block of queries that needs them, and meet what is asked of their range there.
    """
    asked = weights.groupBy("qblock", "query_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("weight").alias("weights"))
    active = pairs.select("qblock", "query_id", "range", "threshold").join(asked, ["qblock", "query_id"])
    places = stored(pairs.select("qblock", "range").distinct())
    wanted = stored(weights.select("qblock", "token").distinct())
    rows = blocks.select("token", "range", "docs", "tfs", "dls").join(wanted, "token").join(places, ["qblock", "range"], "left_semi")
    id_type, query_type = blocks.schema["docs"].dataType.elementType, weights.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])

    def score(postings: pa.Table, queries: pa.Table) -> pa.Table:
        flat = lambda c: postings.column(c).combine_chunks()
        known = pa.array([], _arrow(id_type))
        asked, least = queries.column("query_id").to_pylist(), queries.column("threshold").to_pylist()
        by_token: dict[str, tuple[list, list]] = {}
        for k, (names, ws) in enumerate(zip(queries.column("tokens").to_pylist(), queries.column("weights").to_pylist())):
            for t, w in zip(names, ws):
                at = by_token.setdefault(t, ([], []))
                at[0].append(k)
                at[1].append(w)
        if postings.num_rows:
            coded = pc.list_flatten(flat("docs")).dictionary_encode()
            known, where = coded.dictionary, coded.indices.to_numpy()
            tf, dl = (pc.list_flatten(flat(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("tfs", "dls"))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
            ends = np.cumsum(pc.list_value_length(flat("docs")).to_numpy())
        total = np.zeros((len(asked), len(known)))
        if postings.num_rows:
            for begin, end, token in zip(np.r_[0, ends[:-1]], ends, flat("token").to_pylist()):
                if token in by_token:
                    at, w = map(np.array, by_token[token])
                    total[at[:, None], where[begin:end]] += w[:, None] * part[begin:end]
        total = np.round(total, 6)
        order = pc.rank(known, tiebreaker="dense").to_numpy()
        rows_q, rows_d, rows_s = [], [], []
        for k in range(len(asked)):
            s = total[k]
            held = np.flatnonzero((s > 0) & (s >= least[k]))
            if len(held) > limit:
                held = held[s[held] >= -np.partition(-s[held], limit - 1)[limit - 1]]
            held = held[np.lexsort((order[held], -s[held]))][:limit]
            rows_q += [asked[k]] * len(held)
            rows_d.append(held)
            rows_s.append(s[held])
        picked = np.concatenate(rows_d) if rows_d else np.zeros(0, int)
        return pa.table({"query_id": pa.array(rows_q, type=_arrow(query_type)), "doc_id": known.take(pa.array(picked, pa.int64())), "score": np.concatenate(rows_s) if rows_s else np.zeros(0)})

    return rows.groupBy("qblock", "range").cogroup(active.groupBy("qblock", "range")).applyInArrow(score, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score, lexical_rank): the first ``limit`` documents of each query (query_id, text) by BM25."""
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    wanted = stored(wanted.withColumn("bucket", _bucket(F.col("token"))))
    buckets, count = wanted.agg(F.collect_set("bucket"), F.count_distinct("query_id")).first()  # BUCKETS at most
    blocks = index.where(F.col("bucket").isin(buckets))
    corpus = index.where((F.col("bucket") == _bucket(F.lit(EVERY))) & (F.col("token") == EVERY))
    long_sum = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
    n, length = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(long_sum), F.lit(0))).first()
    average = length / n if n else 1.0
    held = blocks.select("token", "range", "n", "tf_most", "dl_least").join(wanted.select("token").distinct(), "token", "left_semi")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(held.groupBy("token").agg(F.sum("n").alias("df")), "token").select("query_id", "token", (F.col("qtf") * idf).alias("weight"))
    weights = stored(weights.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-count // QUERY_BLOCK)))).cast("int")))
    most = F.col("tf_most") * (K1 + 1) / (F.col("tf_most") + K1 * (1 - B + B * F.col("dl_least") / average))
    bounds = stored(held.join(weights, "token").groupBy("qblock", "query_id", "range").agg(F.sum(F.col("weight") * most).alias("bound"), F.max("n").alias("surely")))
    before = F.sum("surely").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range").rowsBetween(Window.unboundedPreceding, -1))
    ranked = bounds.withColumn("_before", F.coalesce(before, F.lit(0)))
    first = stored(_scored(blocks, weights, ranked.where(F.col("_before") < limit).withColumn("threshold", F.lit(0.0)), average, limit))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    least = first.withColumn("k", F.row_number().over(order)).where(F.col("k") == limit).select("query_id", F.col("score").alias("threshold"))
    rest = ranked.where(F.col("_before") >= limit).join(least, "query_id").where("bound + 1e-6 >= threshold")
    every = first.unionByName(_scored(blocks, weights, rest, average, limit))
    return every.withColumn("lexical_rank", F.row_number().over(order)).where(F.col("lexical_rank") <= limit)
