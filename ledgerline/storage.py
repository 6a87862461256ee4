"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, removed when the driver's file system closes."""
    path = f"{shared_dir(spark)}/ledgerline/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts lineage as a checkpoint does, survives lost executors and is computed once.
    """
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str):
    """(path, file system) of the JVM."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = files(spark, path)
    return fs.exists(target)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Move a written folder to its place, whole or not at all; if another session was first, its work stands."""
    target, fs = files(spark, path)
    fs.mkdirs(target.getParent())
    if not fs.exists(target):
        fs.rename(files(spark, staged)[0], target)


def cached(df: DataFrame, name: str, write=None) -> DataFrame:
    """The table ``name`` of the shared folder; when it isn't there yet, written by ``write`` (a plain one of ``df`` if none)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{name}"
    if not exists(spark, path):
        staged = new_path(spark)
        (write or (lambda to: df.write.parquet(to)))(staged)
        publish(spark, staged, path)
    return spark.read.parquet(path)


def table_signature(spark: SparkSession, path: str) -> str:
    """Of a table's files: names, sizes and times; equal as long as nothing was written."""
    root, fs = files(spark, path)
    found, seen = fs.listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()
