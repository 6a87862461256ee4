"""Search of stored vectors by blocks: matrices of vectors times matrices of queries.

``pack_vectors`` turns rows into blocks (ids, and one matrix as bytes), which is what a cache keeps: it
is written once for each signature of the source and read without unpacking lists. A search takes the
queries in blocks of at most ``QUERY_BYTES``; each task multiplies its blocks with them and keeps the
best of each query so far, so that only ``limit`` rows for each task and query are ever emitted.

Defined results: the score is the dot product in doubles, rounded to six digits; vectors of another
length than the query's, and null ones, score 0; ties go by id; a null entry scores as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cached

QUERY_BYTES, BLOCK = 8 << 20, 4096
PACKED = "dim int, ids array<long>, block binary"


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """(dim, ids, block) of (doc_id long, embedding): blocks of vectors of one length; null vectors have length -1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sizes = pc.list_value_length(part.column("embedding")).fill_null(-1).to_numpy(zero_copy_only=False)
                ids = part.column("doc_id")
                for size in np.unique(sizes):
                    mine = np.flatnonzero(sizes == size)
                    block = pc.list_flatten(part.column("embedding").take(pa.array(mine))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids.take(pa.array(mine))], pa.list_(pa.int64())), pa.array([block.tobytes()])], names=["dim", "ids", "block"])

    return vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(pack, PACKED)


def cached_vectors(vectors: DataFrame, signature: str) -> DataFrame:
    """The packed blocks of ``vectors`` in the shared folder, written when ``signature`` is not there yet."""
    return cached(pack_vectors(vectors), f"vectors-{signature}-{BLOCK}")


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    block, held = [], 0
    for row in queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator():
        block.append((row["query_id"], row["vector"] or []))
        held += 8 * len(block[-1][1]) + 64
        if held >= QUERY_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _best_of(packed: DataFrame, block: list[tuple], limit: int, query_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", T.LongType()), T.StructField("dense", T.DoubleType())])
    by_size: dict[int, tuple[list[int], np.ndarray]] = {}
    for size in {len(v) for _, v in block}:
        at = [k for k, (_, v) in enumerate(block) if len(v) == size]
        by_size[size] = (at, np.array([[0.0 if x is None else x for x in block[k][1]] for k in at]).reshape(len(at), size))
    names = [q for q, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in names]
        for batch in batches:
            for dim, ids, data in zip(batch.column("dim").to_pylist(), batch.column("ids"), batch.column("block").to_pylist()):
                ids = ids.values.to_numpy(zero_copy_only=False)
                scores = np.zeros((len(ids), len(names)))
                if dim in by_size and dim > 0:
                    at, q = by_size[dim]
                    scores[:, at] = np.round(np.frombuffer(data, np.float32).reshape(len(ids), dim).astype(float) @ q.T, 6)
                for k, (old_ids, old) in enumerate(kept):
                    s = scores[:, k]
                    if len(old) == limit:
                        near = np.flatnonzero(s >= old[-1])
                        if not len(near):
                            continue
                        s, new = s[near], ids[near]
                    else:
                        new = ids
                    s, new = np.r_[old, s], np.r_[old_ids, new]
                    order = np.lexsort((new, -s))[:limit]
                    kept[k] = (new[order], s[order])
        n = [len(i) for i, _ in kept]
        which = pa.array(np.repeat(np.arange(len(names)), n))
        yield pa.RecordBatch.from_arrays([pa.array(names, type=_arrow(query_type)).take(which), pa.array(np.concatenate([i for i, _ in kept])), pa.array(np.concatenate([s for _, s in kept]))], names=schema.names)

    return packed.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def dense_top(packed: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, dense, dense_rank): the first ``limit`` of each query (query_id, vector)."""
    query_type = queries.schema["query_id"].dataType
    found = None
    for block in _query_blocks(queries):
        part = _best_of(packed, block, limit, query_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("dense")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("dense"), "doc_id")
    return found.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= limit)
