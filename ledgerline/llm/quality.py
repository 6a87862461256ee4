"""Quality by hierarchical empirical Bayes.

Each document has evidence of its own, the probability of a logistic model over shares of
characters, repeated lines and words. Its site has two levels, host and path (by default the
source and the language, as documents carry no URL). Grouped aggregation gives each level's mean
evidence. A host's posterior shrinks its mean toward the global mean, a path's shrinks toward its
host's posterior, each by the weight of a Beta prior whose strength is estimated from how much the
means of groups differ beyond chance: sparse sites fall back on the level above. A document's
posterior odds are its own, moved by its path's posterior odds against the global ones.

At most ``TRAIN_ROWS`` labelled rows, the first by a hash of their id and text, are fitted on; sums
cover all documents. Only sizes, ids and sites are shuffled, never texts, and sums are pre-aggregated.

Defined results: a null or empty text has all shares 0; null hosts and paths are groups of their
own; labels that are null or in no document do not count; without labels of both kinds every
document's evidence is the smoothed share; an empty table gives no rows; repeated rows count each
and get equal values; a very long text is measured whole; extra columns are ignored, whatever their
names; ids may be of any type that labels share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, shipped, stored
from .linear import fit, predict

TRAIN_ROWS, THRESHOLD = 8000, 0.5
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1e6
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]


def measures(text: bytes | None) -> np.ndarray:
    """Shares and ratios of one text, over all of it."""
    out = np.zeros(len(_PUNCTUATION) + 10)
    if not text:
        return out
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = lambda n: np.log1p(200 * n / len(text))
    out[: len(_PUNCTUATION)] = share(count[_PUNCTUATION])
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    common = Counter(words).most_common(1)[0][1] if words else 0
    out[len(_PUNCTUATION) :] = (
        share(count[65:91].sum()), share(count[48:58].sum()), share(count[128:].sum()), share(count[10]),
        1 - len(set(lines)) / len(lines) if lines else 0, 1 - len(set(words)) / len(words) if words else 0, np.log1p(len(text)) / 10,
        len(text) / (len(words) + 1) / 10, len(text) / (len(lines) + 1) / 1000, common / (len(words) + 1),
    )
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_y"), pa.array([measures(t).tolist() for t in b.column("_text").to_pylist()], pa.list_(pa.float64()))], names=["h", "y", "x"])

    got = sorted(labelled(docs, labels, TRAIN_ROWS, id_col, text_col, label_col).mapInArrow(run, "h long, y int, x array<double>").collect())  # TRAIN_ROWS at most
    return np.array([r["x"] for r in got]).reshape(len(got), len(_PUNCTUATION) + 10), np.array([r["y"] for r in got], dtype=float)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        self.w = fit((x - self.mean) / self.spread, y)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.array([measures(t) for t in texts]).reshape(len(texts), len(_PUNCTUATION) + 10)
        return predict((x - self.mean) / self.spread, self.w if len(self.w) > 1 else np.append(np.zeros(x.shape[1]), self.w))


def _strength(groups: DataFrame, mean: str, toward: str) -> float:
    """The prior's documents, by moments: spread of the groups' means beyond that within them."""
    stat = groups.agg(
        F.sum(F.col("n") * F.pow(F.col(mean) - F.col(toward), F.lit(2))).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("square") - F.col("n") * F.col(mean) * F.col(mean)).alias("within"), F.sum(F.col("n") * F.col(toward)).alias("level"),
    ).first()
    if not stat["n"] or stat["n"] <= stat["k"]:
        return STRONGEST
    level, noise = stat["level"] / stat["n"], max(0.0, stat["within"]) / (stat["n"] - stat["k"])
    spread = (stat["between"] - stat["k"] * noise) / stat["n"]
    return float(min(max(level * (1 - level) / spread - 1, WEAKEST), STRONGEST)) if spread > 1e-12 else STRONGEST


def score_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, host, path, evidence, host_quality, path_quality, quality, keep."""
    spark = shipped(docs.sparkSession)
    model = spark.sparkContext.broadcast(Model(*_sample(docs, labels, id_col, text_col, label_col)))
    source = docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("host"), b.column("path"), pa.array(model.value.score(b.column("_text").to_pylist()).round(9), pa.float64())], names=["_id", "host", "path", "evidence"])

    rows = stored(source.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, host string, path string, evidence double"))
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square")]
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.col("evidence").cast("decimal(20,9)")).cast("double").alias("total"), F.sum((F.col("evidence") * F.col("evidence")).cast("decimal(20,9)")).cast("double").alias("square")))
    hosts = paths.groupBy("host").agg(*sums)
    whole = paths.agg(*sums).first()
    world = whole["total"] / whole["n"] if whole["n"] else 0.5
    hosts = hosts.withColumn("mean", F.col("total") / F.col("n")).withColumn("world", F.lit(world))
    strength = _strength(hosts, "mean", "world")
    hosts = stored(hosts.select("host", ((F.col("total") + strength * world) / (F.col("n") + strength)).alias("host_quality")))
    paths = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host").withColumn("mean", F.col("total") / F.col("n"))
    strength = _strength(paths, "mean", "host_quality")
    paths = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_quality", ((F.col("total") + strength * F.col("host_quality")) / (F.col("n") + strength)).alias("path_quality"))
    logit = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = logit(safe(F.col("evidence"))) + logit(safe(F.col("path_quality"))) - logit(safe(F.lit(world)))
    joined = rows.join(paths, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    quality = F.round(1 / (1 + F.exp(-odds)), 6)
    return joined.select(F.col("_id").alias(id_col), "host", "path", "evidence", F.round("host_quality", 6).alias("host_quality"), F.round("path_quality", 6).alias("path_quality"), quality.alias("quality"), (quality >= THRESHOLD).alias("keep"))
