"""Audit events as a stream: latest status by key, idempotent ingest, a windowed count (an extension)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import exists, files, new_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State on local disks and in the checkpoint instead of in memory, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_end(stream: DataFrame, mode: str, key: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a query over what is there and return its result, as a table of files in the shared folder.

    Each batch writes its rows in a folder of its own number, so a batch that runs again takes its own place. In
    complete mode the last batch is the result. In update mode every batch adds its rows; with ``key`` the last of each key are returned.
    """
    spark, target = stream.sparkSession, new_path(stream.sparkSession)

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    with _rocks(spark):
        writer = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint or new_path(spark))
        writer.trigger(availableNow=True).start().awaitTermination()
    columns = [T.StructField("epoch", T.LongType()), *stream.schema.fields]
    rows = spark.read.schema(T.StructType(columns)).parquet(target) if exists(spark, target) else spark.createDataFrame([], T.StructType(columns))
    if mode == "complete":
        return rows.join(rows.agg(F.max("epoch").alias("epoch")), "epoch").select(*stream.columns)
    if not key:
        return rows.select(*stream.columns)
    others = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "epoch").alias("_")).select(key, "_.*")


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each key: a stateful projection, in update or complete mode."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value"))
    return events.groupBy("user_id").agg(last.alias("_"), F.count("*").alias("events")).select("user_id", F.col("_.event_id").alias("event_id"), F.col("_.event_type").alias("event_type"), "events")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling windows with a watermark; beyond the library's models, for operations."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to, kept in it; a lost checkpoint starts another run."""
    path, fs = files(spark, f"{checkpoint}/run-name")
    if not fs.exists(path):
        out = fs.create(path)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    held = fs.open(path)
    try:
        return held.readUTF()
    finally:
        held.close()


def _append_new(stream: DataFrame, target: str, checkpoint: str, keys: list[str], late: tuple[str, str] | None = None) -> None:
    """Append each value of ``keys`` once.

    What was seen is state of the query, so a batch costs what it brings, however large the target is; with ``late``
    (time column, delay) keys are forgotten when the watermark has passed them by that delay. Each batch
    writes its own folder (run, epoch) and takes its place when it runs again. Only where other runs have
    written to the target, as after a lost checkpoint, are their keys read.
    """
    spark = stream.sparkSession
    run = _run_of(spark, checkpoint)
    once = stream.withWatermark(*late).dropDuplicatesWithinWatermark(keys) if late else stream.dropDuplicates(keys)
    others = []
    root, fs = files(spark, target)
    if fs.exists(root):
        others = [str(f.getPath()) for f in fs.listStatus(root) if f.getPath().getName().startswith("run=") and f.getPath().getName() != f"run={run}"]

    def batch(df: DataFrame, epoch: int) -> None:
        if others:
            df = df.join(df.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(*others).select(*keys), keys, "left_anti")
        df.write.mode("overwrite").parquet(f"{target}/run={run}/epoch={epoch}")

    with _rocks(spark):
        once.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_once(stream: DataFrame, target: str, checkpoint: str, late: tuple[str, str] | None = None) -> None:
    """Each event id once into a table of files, over all batches; a batch that runs again writes the same."""
    _append_new(stream, target, checkpoint, ["event_id"], late)


def ingest_changed(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Each content of each source once into a table of files: what comes again unchanged is skipped."""
    _append_new(stream, target, checkpoint, ["source_path", "checksum"])


class Reviews(StatefulProcessor):
    """Rounds of review of a key: paused between events, resumed by the next, ended after ``most`` rounds or by a timer.

    State of a key is its count of rounds and the timer that is set; both go when the review ends by
    the timer, and by themselves after ``keep_ms`` without an event, if given.
    """

    def __init__(self, most: int, patience_ms: int | None, keep_ms: int | None) -> None:
        self.most, self.patience_ms, self.keep_ms = most, patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rounds = handle.getValueState("rounds", "rounds long", self.keep_ms)
        self.timer = handle.getValueState("timer", "at long")

    def _row(self, key: tuple, rounds: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "rounds": [rounds], "state": [state]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rounds, last = self.rounds.get()[0] if self.rounds.exists() else 0, None
        for b in rows:
            rounds += int((b["event_type"] == "error").sum())
            last = b["ts"].max() if last is None else max(last, b["ts"].max())
        self.rounds.update((rounds,))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if self.patience_ms and 0 < rounds < self.most:
            at = int(pd.Timestamp(last).value // 1_000_000) + self.patience_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield self._row(key, rounds, "finalised" if rounds >= self.most else "open")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rounds = self.rounds.get()[0] if self.rounds.exists() else 0
        self.rounds.clear()
        self.timer.clear()
        yield self._row(key, rounds, "lapsed")


def review_rounds(events: DataFrame, most: int = 2, patience_ms: int | None = None, late: str = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """Pause and resume: (user_id, rounds, state) whenever a key's review moves on.

    An open review is finalised after ``most`` rounds. With ``patience_ms`` it lapses when the watermark
    (``late`` behind the latest event) passes its last event by that time, and begins anew with the next.
    """
    if patience_ms:
        events = events.withWatermark("ts", late)
    processor = Reviews(most, patience_ms, keep_ms)
    mode = "EventTime" if patience_ms else "ProcessingTime" if keep_ms else "None"
    return events.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, rounds long, state string", "Update", mode)
