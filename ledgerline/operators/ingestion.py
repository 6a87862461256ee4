"""Tables that are kept up to date by what changed: chunks by source, vectors by chunk.

A table lies in a folder as *generations*, each written once by one run and never changed, and a
*manifest* that names, for each key (a source, a chunk), the checksum and the generation that holds its rows. A run
writes one generation with what changed and then the next manifest, which is moved to its place in
one step: until then readers see the old state as a whole, and a run that fails leaves nothing to
see. A run without changes writes nothing. If two runs meet, the second one to finish is refused.

Readers join rows with the manifest, so rows of an older generation stop counting without being
rewritten; ``compact`` writes the rows that count into one generation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import exists, files, new_path, stored
from .chunking import child_windows, parent_sections


class KeptTable:
    """Rows of ``schema`` by ``key``, in generations under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema)
        self.manifest_schema = T.StructType.fromDDL("key string, checksum string, generation string")

    def version(self) -> int:
        """Of the newest manifest; 0 if there is none."""
        root, fs = files(self.spark, f"{self.path}/manifest")
        if not fs.exists(root):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(root)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(key, checksum, generation); of an older version if asked for."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.manifest_schema)
        return self.spark.read.schema(self.manifest_schema).parquet(f"{self.path}/manifest/{version:08d}")

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows that count."""
        kept = self.manifest(version)
        if not exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("generation", T.StringType())])).parquet(f"{self.path}/data")
        named = kept.select(F.col("key").alias(self.key), "generation")
        return every.join(named, [self.key, "generation"], "left_semi").select(*self.schema.names)

    def write(self, rows: DataFrame) -> str:
        """Write a generation, unseen until a manifest names it; its name."""
        generation = uuid.uuid4().hex
        rows.select(*self.schema.names).write.parquet(f"{self.path}/data/generation={generation}")
        return generation

    def commit(self, manifest: DataFrame, since: int) -> int:
        """Make ``manifest`` the newest, if that still is ``since``."""
        staged = new_path(self.spark)
        manifest.select("key", "checksum", "generation").write.parquet(staged)
        target, fs = files(self.spark, f"{self.path}/manifest/{since + 1:08d}")
        fs.mkdirs(target.getParent())
        if self.version() != since or not fs.rename(files(self.spark, staged)[0], target):
            raise RuntimeError("another run has changed the table; run again")
        return since + 1

    def compact(self) -> None:
        """One generation with the rows that count."""
        since = self.version()
        generation = self.write(self.rows(since))
        self.commit(self.manifest(since).withColumn("generation", F.lit(generation)), since)


def content_checksums(units: DataFrame) -> DataFrame:
    """(source_path, checksum) of all units of a source, in any order, by partial sums."""
    h = lambda seed: F.xxhash64("page", "unit", "text", F.lit(seed))
    sums = [F.sum(h(s).cast("decimal(20,0)")).cast("string") for s in (1, 2, 3)]
    return units.groupBy("source_path").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("checksum"))


CHUNKS = "source_path string, chunk_id string, parent_chunk_id string, role string, chunk_index int, page int, text string, checksum string, char_count int"


def chunk_table(spark: SparkSession, path: str) -> KeptTable:
    return KeptTable(spark, path, "source_path", CHUNKS)


MADE = "source_path string, chunk_id string, parent_chunk_id string, role string, chunk_index int, page int, text string, error string"
#: Characters of units whose chunks a task hands on at once, or one unit.
HANDED_ON = 1_000_000


def cut_units(read: Callable[[str], str] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches of units (source_path, page, unit, text) as ``MADE``; a task holds the chunks of a few units, however many a batch has."""
    names = [f.split()[0] for f in MADE.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for source, page, unit, text in batch.itertuples(index=False, name=None):
                where = f"{source}:u{unit}" if pd.isna(page) else f"{source}:pg{int(page)}"
                page, made = None if pd.isna(page) else int(page), []
                try:
                    for p, parent in enumerate(parent_sections(read(text or "") if read else text or "")):
                        made.append((source, f"{where}:p{p}", None, "parent", p, page, parent, None))
                        made += [(source, f"{where}:p{p}:c{c}", f"{where}:p{p}", "child", c, page, child, None) for c, child in enumerate(child_windows(parent))]
                except Exception as e:  # of this source; the others go on
                    made = [(source, where, None, "error", 0, page, None, f"{type(e).__name__}: {e}")]
                rows += made
                held += len(text or "")
                if held >= HANDED_ON:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return cut


def ingest(table: KeptTable, units: DataFrame, read: Callable[[str], str] | None = None) -> DataFrame:
    """Bring the chunks of ``units`` (source_path, page or null, unit, text) up to date; a report.

    Sources with the checksum that the table knows are skipped; the others are read by ``read`` (as
    they are, if none), cut into parents and children, and replace what the table holds of them. A source of which a unit
    raises is reported with the error and keeps its old chunks; it is tried again by the next run. Sources that are not
    offered stay. Report: source_path, status (ingested, updated, skipped_idempotent, error), parents, children, error.
    """
    since = table.version()
    known = table.manifest(since).select(F.col("key").alias("source_path"), F.col("checksum").alias("_old"))
    offered = stored(content_checksums(units).join(known, "source_path", "left"))
    same = offered.where("checksum = _old")
    todo = offered.where("_old is null or checksum <> _old")
    report = same.select("source_path", F.lit("skipped_idempotent").alias("status"), F.lit(None).cast("long").alias("parents"), F.lit(None).cast("long").alias("children"), F.lit(None).cast("string").alias("error"))
    if todo.isEmpty():
        return report

    fresh = units.join(todo.select("source_path"), "source_path", "left_semi").select("source_path", "page", "unit", "text")
    made = stored(fresh.mapInPandas(cut_units(read), MADE))
    count = lambda role: F.count_if(F.col("role") == role)
    results = made.groupBy("source_path").agg(count("parent").alias("parents"), count("child").alias("children"), F.min("error").alias("error"))
    results = stored(todo.join(results, "source_path", "left"))
    good = results.where("error is null")
    generation = table.write(made.join(good.select("source_path"), "source_path", "left_semi").withColumns({"checksum": F.sha2("text", 256), "char_count": F.length("text")}))
    stay = table.manifest(since).join(good.select(F.col("source_path").alias("key")), "key", "left_anti")
    table.commit(stay.unionByName(good.select(F.col("source_path").alias("key"), "checksum", F.lit(generation).alias("generation"))), since)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("_old").isNull(), "ingested").otherwise("updated")
    numbers = [F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("parents", "children")]
    return report.unionByName(results.select("source_path", status.alias("status"), *numbers, "error"))


VECTORS = "chunk_id string, embedding array<float>, model string, dimension int, checksum string, index_version string"


def vector_table(spark: SparkSession, path: str) -> KeptTable:
    return KeptTable(spark, path, "chunk_id", VECTORS)


def _stamp(checksum: Column, model: str, version: str) -> Column:
    return F.concat_ws("|", checksum, F.lit(model), F.lit(version))


def index_vectors(table: KeptTable, chunks: DataFrame, embed: Callable[[Column], Column], model: str, version: str) -> dict[str, int | str | None]:
    """Embed the chunks (chunk_id, text, checksum) that have no vector of this checksum, model and version; drop those that are gone.

    Report: discovered, embedded, updated, skipped, stale_removed, failures, error. If embedding fails, the index stays as it was.
    """
    since = table.version()
    old = table.manifest(since)
    wanted = chunks.select(F.col("chunk_id").cast("string").alias("key"), _stamp(F.col("checksum"), model, version).alias("_new"), "text", F.col("checksum").alias("_checksum"))
    state = wanted.select("key", "_new").join(old, "key", "full_outer")
    fresh = F.col("checksum").isNotNull() & (F.col("_new") == F.col("checksum"))
    action = F.when(F.col("_new").isNull(), "stale_removed").when(F.col("checksum").isNull(), "embedded").when(fresh, "skipped").otherwise("updated")
    state = stored(state.select("key", "_new", "checksum", "generation", action.alias("action")))
    found = {r["action"]: r["count"] for r in state.groupBy("action").count().collect()}  # four actions
    report: dict[str, int | str | None] = {a: found.get(a, 0) for a in ("embedded", "updated", "skipped", "stale_removed")}
    report |= {"discovered": sum(found.values()) - report["stale_removed"], "failures": 0, "error": None}
    todo = report["embedded"] + report["updated"]
    if not todo and not report["stale_removed"]:
        return report
    manifest = state.where("action = 'skipped'").select("key", "checksum", "generation")
    if todo:
        rows = wanted.join(state.where("action in ('embedded', 'updated')").select("key"), "key", "left_semi")
        made = rows.select(F.col("key").alias("chunk_id"), embed(F.col("text")).alias("embedding"), F.lit(model).alias("model"), F.col("_checksum").alias("checksum"), F.lit(version).alias("index_version"))
        try:
            generation = table.write(made.withColumn("dimension", F.size("embedding")))
        except Exception as e:
            return report | {"embedded": 0, "updated": 0, "stale_removed": 0, "failures": todo, "error": type(e).__name__}
        manifest = manifest.unionByName(state.where("action in ('embedded', 'updated')").select("key", F.col("_new").alias("checksum"), F.lit(generation).alias("generation")))
    table.commit(manifest, since)
    return report


def vectors_for(table: KeptTable, chunks: DataFrame, embed: Callable[[Column], Column], model: str, dimension: int) -> DataFrame:
    """(chunk_id, embedding, was_stored): stored vectors of this model and dimension, and for chunks without one a new one, which is not stored."""
    held = table.rows().where((F.col("model") == model) & (F.col("dimension") == dimension)).select("chunk_id", "embedding")
    asked = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    hits = asked.join(held, "chunk_id").select("chunk_id", "embedding", F.lit(True).alias("was_stored"))
    misses = asked.join(held.select("chunk_id"), "chunk_id", "left_anti")
    return hits.unionByName(misses.select("chunk_id", embed(F.col("text")).alias("embedding"), F.lit(False).alias("was_stored")))


def index_meta(table: KeptTable) -> DataFrame:
    """(vectors, models, versions, dimensions): one row on a vector table, lists sorted."""
    listed = lambda c: F.sort_array(F.collect_set(c))  # noqa: E731  few models, versions and dimensions
    return table.rows().agg(F.count("*").alias("vectors"), listed("model").alias("models"), listed("index_version").alias("versions"), listed("dimension").alias("dimensions"))
