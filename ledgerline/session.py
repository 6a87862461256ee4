"""Sessions and input tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results rely on; a cluster's own are kept."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shipped(spark: SparkSession) -> SparkSession:
    """Have Python workers import this package, wherever they run; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", None) is None:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ledgerline-")) / "ledgerline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(target))
        sc._ledgerline_shipped = True
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, for work whose functions the workers can import."""
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
