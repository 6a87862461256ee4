"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shipped
from ..storage import shared_dir, stored

__all__ = ["BLANK_WORD", "ascii_lower", "labelled", "numbered", "shared_dir", "shipped", "stored", "table"]

#: Words of the mixing and similarity operators: maximal runs of anything but these blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, row_col: str | None = None, **columns) -> DataFrame:
    """``columns`` of ``docs`` with ``_row``, a number that each row keeps.

    Without ``row_col``, a column that numbers the rows of a written table, rows are numbered here and
    written: a position computed anew by a later job may differ, as it follows how files are cut.
    """
    named = [c.alias(n) for n, c in columns.items()]
    if row_col:
        return docs.select(F.col(row_col).alias("_row"), *named)
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), *named))


def labelled(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_h, _y, _text): at most ``most`` labelled rows, the first by a hash of id and text.

    Bounded by rows, as an id may stand in any number of rows; ``most`` labels are chosen first.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    chosen = stored(known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), "_id")
    return rows.select(F.xxhash64("_id", "_text").alias("_h"), "_y", "_text").orderBy("_h", "_y").limit(most)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
