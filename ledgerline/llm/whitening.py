"""Embedding whitening by LOBPCG over distributed products of the covariance with a block of vectors.

Entries become whole numbers, so that sums S over the n distinct vectors are exact and a centred
row, (n*x - S) / n, is rounded once, whatever the offset. The covariance itself is never formed: a
pass over the fit list multiplies it with a block Q as the sum of row' * (row * Q), one partial
product a task, added up by Spark. Each round applies Rayleigh-Ritz to the span of the iterate, its
residuals and the previous directions, and ends when the residuals of all asked components, by a
product computed anew, are at rounding (``AT_ROUNDING`` times the greatest eigenvalue) or, near it
(``CERTIFIED``), shrink no more. A block has ``GUARDS`` vectors beside those asked for, which speeds up the last of them.

The driver holds blocks of (entries a vector) x (3 blocks) numbers, never rows.

Defined results: rows whose vector is null or empty, holds a null or an entry that is not finite, or
does not fit in a long, are left out, as are those whose length isn't the one most distinct vectors
have (of two equally frequent ones the greater counts); repeated rows give equal rows, and the fit counts
their vector once; null ids are values; components whose eigenvalue is zero up to rounding have no
whitened values and are left out, so that a table with one distinct vector, or an empty one, gives no rows; a
deviation beyond a long is null. Extra columns pass through if asked for, but those named like a result give way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, GUARDS, ADDERS = 16, 8, 8
AT_ROUNDING, CERTIFIED, ZERO, ROUNDS = 1e-15, 1e-12, 1e-12, 1000
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whole_numbers(vectors: DataFrame, vector_col: str, keep: Sequence[str]) -> DataFrame:
    """(_kept, _x): the usable rows, each vector as longs."""
    v = F.col(vector_col)
    entry = lambda c: F.floor(c.cast("double") * SCALE)
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**62 / SCALE))  # not so for NaN, which is the greatest
    return vectors.where(v.isNotNull() & usable).select(F.struct(*keep).alias("_kept"), F.transform(v, lambda c: entry(c) + F.lit(OFFSET).cast("long")).alias("_x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Centre:
    """n, the sums S, and whether n*x - S and its squares' sum fit in a long."""

    def __init__(self, fit: DataFrame) -> None:
        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, least, most = 0, None, None, None
            for x in _blocks(batches):
                part = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
                total = [a + b for a, b in zip(total, part)] if total else part
                least = np.minimum(least, x.min(axis=0)) if n else x.min(axis=0)
                most = np.maximum(most, x.max(axis=0)) if n else x.max(axis=0)
                n += len(x)
            if n:
                d = len(total)
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(least), pa.array(most)], names=["d", "n", "total", "least", "most"])

        found = fit.mapInArrow(moments, "d int, n long, total decimal(38,0), least long, most long")
        rows = sorted(found.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
        self.n = rows[0]["n"] if rows else 0
        self.sums = [int(r["total"]) for r in rows]
        far = [max(abs(self.n * r["least"] - s), abs(self.n * r["most"] - s)) for r, s in zip(rows, self.sums)]
        near = all(self.n * max(abs(r["least"]), abs(r["most"])) < 1 << 62 and abs(s) < 1 << 62 for r, s in zip(rows, self.sums))
        self.small, self.square_small = near, near and sum(f * f for f in far) < 1 << 63

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        kind = np.int64 if self.small else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.scaled(x)
        if self.square_small:
            return (d * d).sum(axis=1).tolist()
        return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in d]


def _summed(fit: DataFrame, shape: tuple[int, int], partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of rows of ``partial(block)``, a matrix of ``shape``: one matrix a task, added in ``ADDERS`` tasks and then in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _blocks(batches):
            for at in range(0, len(x), 4096):
                total += partial(x[at : at + 4096])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for one in batch.column("sum"):
                total += np.frombuffer(one.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    sums = fit.mapInArrow(run, "sum binary").repartition(ADDERS).mapInArrow(add, "sum binary").repartition(1).mapInArrow(add, "sum binary")
    return sum(np.frombuffer(r["sum"]).reshape(shape) for r in sums.collect()) + np.zeros(shape)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what ``block`` adds to the orthonormal ``against``."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8] if len(s) else block
    block = block - against @ (against.T @ block)
    return np.linalg.qr(block)[0] if block.shape[1] else block


def lobpcg(times: Callable[[np.ndarray], np.ndarray], size: int, asked: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, vectors, greatest residual / greatest eigenvalue) of the ``asked`` greatest, given products with the matrix."""
    block = min(size, asked + GUARDS)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, block)))[0]
    directions, before, fresh = np.zeros((size, 0)), np.inf, True
    ax = times(x)
    for _ in range(ROUNDS):
        values, y = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, y = values[::-1], y[:, ::-1]
        x, ax = x @ y, ax @ y
        residual = ax - x * values
        error = np.linalg.norm(residual[:, :asked], axis=0).max() / values[0] if values[0] > 0 else 0.0
        if error <= AT_ROUNDING or error <= CERTIFIED and error > before / 2:
            if fresh:
                return values[:asked], x[:, :asked], error
            x = np.linalg.qr(x)[0]
            ax, fresh = times(x), True  # the product kept so far holds the rounding of all rounds: certify by a new one
            continue
        before = error
        w = _orthonormal(np.hstack([residual, directions]), x)
        if not w.shape[1]:
            return values[:asked], x[:, :asked], error
        q, aq = np.hstack([x, w]), np.hstack([ax, times(w)])
        gram = q.T @ aq
        _, y = np.linalg.eigh((gram + gram.T) / 2)
        y = y[:, ::-1][:, :block]
        directions = w @ y[block:]
        x, ax, fresh = q @ y, aq @ y, False
    raise RuntimeError(f"residuals are {error:.1e} of the greatest eigenvalue after {ROUNDS} rounds")


def whiten(vectors: DataFrame, vector_col: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: the columns ``keep`` and those of ``RESULT``."""
    spark = shipped(vectors.sparkSession)
    keep = [c for c in keep if c not in RESULT]
    rows = whole_numbers(vectors, vector_col, keep)
    distinct = stored(rows.select("_x").distinct())
    length = distinct.groupBy(F.size("_x").alias("l")).count().orderBy(F.desc("count"), F.desc("l")).first()
    rows, fit = (t.where(F.size("_x") == (length["l"] if length else 0)) for t in (rows, distinct))
    centre = Centre(fit)
    kinds = [rows.schema["_kept"].dataType[c].dataType for c in keep]
    if centre.n < 2:
        fields = [T.StructField(c, k) for c, k in zip(keep, kinds)]
        fields += [T.StructField(c, k) for c, k in zip(RESULT, (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()))]
        return spark.createDataFrame([], T.StructType(fields))
    size = len(centre.sums)

    def times(q: np.ndarray) -> np.ndarray:
        return _summed(fit, q.shape, lambda x: (c := centre.rows(x)).T @ (c @ q)) / centre.n

    trace = float(_summed(fit, (1, 1), lambda x: np.square(centre.rows(x)).sum().reshape(1, 1))[0, 0]) / centre.n
    values, basis, _ = lobpcg(times, size, min(components, size))
    real = values > ZERO * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values, basis = values[real], basis[:, real]
    scaled = basis / np.sqrt(values)
    m = len(values)

    def whitened_moments(x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = _summed(fit, (m + 1, m), whitened_moments) / centre.n
    off = float(np.abs(moments[:m] - np.outer(moments[m], moments[m]) - np.eye(m)).max()) if m else 0.0
    schema = T.StructType([rows.schema["_kept"], T.StructField("deviation", T.LongType()), T.StructField("_w", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _blocks([batch]):
                w = centre.rows(x) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(centre.deviations(x), pa.int64()), lists], names=schema.names)

    explained = F.array(*[F.lit(float(v / trace)) for v in values]) if m else F.array().cast("array<double>")
    each = rows.mapInArrow(project, schema).select("_kept.*", "deviation", F.posexplode("_w").alias("_k", "whitened"))
    return each.select(
        *keep,
        (F.col("_k") + 1).cast("int").alias("component"),
        F.lit(centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("_k") + 1).alias("explained"),
        F.lit(off).alias("identity_error"),
    )
