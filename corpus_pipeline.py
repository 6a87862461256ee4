"""A training-data pipeline over ``documents``: five stages, each written and read again.

Toxic documents go; of each group of near duplicates the first stays; documents that hold benchmark
passages go; sources are mixed to their target weights, a document coming as often as the mix takes
its words; what remains is dealt to shards. No SQL states the toxicity stage, so there is none for
the whole; ``tests/llm/test_pipeline.py`` holds the other stages against plain versions in Python.

Defined results: a null or empty text is not toxic, not a near copy and not contaminated; documents
without words leave in the mix, which counts words; repeated rows are near copies of each other;
of near duplicates the one read first stays; an empty table gives no rows and the columns of the
last stage; extra columns pass through, whatever their names, but those that are named like a
column of the last stage (``SHARD_COLUMNS``), which give way to it; null ids and sources are values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontamination, jaccard, mixing, packing, toxicity
from ledgerline.llm.common import stored, table

ORACLE_SQL = None
SHARDS = 16
SHARD_COLUMNS = ("size", "text_crc32", "shard", "slot")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers the rows, written once so that the numbers stay; its name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that operators read beside all of them in one, so that no name meets a result's."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_carried(docs), table(spark, sf_dir, "labels"), keep=["_doc"])
    return scored.where("not toxic").select("_doc.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    first = jaccard.near_duplicates(rows, row_col=row).where("row = first_row").select(F.col("row").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_carried(docs), table(spark, sf_dir, "benchmark"), keep=["_doc"])
    return found.where("size(spans) = 0").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    times = mixing.copies(mixing.mix(rows, row_col=row)).where("copies > 0").select(F.col("row").alias(row), "copies")
    each = rows.select(row, F.struct(*docs.columns).alias("_doc")).join(times, row)
    return each.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    placed = packing.shard(rows, SHARDS, row_col=row).select(F.col("row").alias(row), *SHARD_COLUMNS)
    rest = [c for c in docs.columns if c not in SHARD_COLUMNS]
    return rows.select(row, *rest).join(placed, row).select(*rest, *SHARD_COLUMNS)


STAGES = [
    ("toxicity", drop_toxic), ("n-gram Jaccard join", one_of_near_duplicates), ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources), ("sharding", deal_to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
