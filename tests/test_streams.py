"""Streams over several batches: exactly-once appends, reviews that pause, resume and lapse."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.storage import new_path
from ledgerline.streaming import events

DAY = 86_400_000


def at(day, second=0):
    return datetime.datetime(2026, 3, 1) + datetime.timedelta(days=day, seconds=second)


def drop(spark, inbox, name, rows):
    spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.parquet(str(inbox / name))


def test_reviews_pause_resume_and_lapse(spark, tmp_path):
    inbox, check = tmp_path / "in", str(tmp_path / "check")
    inbox.mkdir()
    event = lambda n, day, user, kind: (n, at(day, n), user, kind, 1.0, "{}")
    batches = (
        [event(1, 0, 1, "error"), event(2, 0, 2, "error"), event(3, 0, 3, "view")],  # two reviews open
        [event(4, 1, 1, "error")],  # one is resumed and finalised
        [event(5, 30, 9, "view")],  # time goes on: the other one lapses
        [event(6, 31, 2, "error")],  # and begins anew
    )
    seen = []
    for n, rows in enumerate(batches):
        drop(spark, inbox, f"b{n}", rows)
        stream = events.review_rounds(events.read_events(spark, str(inbox), "*.parquet"), 2, 10 * DAY)
        seen.append({(r["user_id"], r["rounds"], r["state"]) for r in events.run_to_end(stream, "update", checkpoint=check).collect()})
    assert seen[0] == {(1, 1, "open"), (2, 1, "open"), (3, 0, "open")} and seen[1] == {(1, 2, "finalised")}
    assert (9, 0, "open") in seen[2] and (2, 1, "lapsed") in seen[2] | seen[3] and (2, 1, "open") in seen[3]
    assert not any(u == 1 and s == "lapsed" for batch in seen for u, _, s in batch)


def test_state_is_kept_between_runs_without_timers(spark, tmp_path):
    inbox, check = tmp_path / "in", str(tmp_path / "check")
    inbox.mkdir()
    out = []
    for n in range(3):
        drop(spark, inbox, f"b{n}", [(n, at(n), 1, "error", 1.0, "{}")])
        out += [tuple(r) for r in events.run_to_end(events.review_rounds(events.read_events(spark, str(inbox), "*.parquet")), "update", checkpoint=check).collect()]
    assert out == [(1, 1, "open"), (1, 2, "finalised"), (1, 3, "finalised")]


def test_a_batch_does_not_read_the_target(spark, tmp_path, monkeypatch):
    """What a run wrote itself is never read again: a target made unreadable in between does no harm."""
    inbox, target, check = tmp_path / "in", tmp_path / "target", str(tmp_path / "check")
    inbox.mkdir()
    row = lambda i: (i, at(0, i), 1, "view", 1.0, "{}")
    for n, ids in enumerate(([1, 2, 2], [2, 3], [1, 4, 4])):
        drop(spark, inbox, f"b{n}", [row(i) for i in ids])
        events.ingest_once(events.read_events(spark, str(inbox), "*.parquet"), str(target), check)
        if n == 0:
            (first,) = target.glob("run=*/epoch=*")
            kept = first.rename(tmp_path / "moved")
    kept.rename(first)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(target)).collect()) == [1, 2, 3, 4]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    inbox, target, check = tmp_path / "in", str(tmp_path / "target"), str(tmp_path / "check")
    inbox.mkdir()
    for n, (key, day) in enumerate(((1, 0), (1, 0), (2, 20), (3, 40), (1, 41))):
        drop(spark, inbox, f"b{n}", [(key, at(day, n), 1, "view", 1.0, "{}")])
        events.ingest_once(events.read_events(spark, str(inbox), "*.parquet"), target, check, ("ts", "5 days"))
    assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == [1, 1, 2, 3]


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_results_of_several_batches(spark, tmp_path, mode):
    inbox, check = tmp_path / "in", new_path(spark)
    inbox.mkdir()
    for n in range(2):
        drop(spark, inbox, f"b{n}", [(10 * n + k, at(n, k), k % 2, "view", 1.0, "{}") for k in range(4)])
        stream = events.read_events(spark, str(inbox), "*.parquet").groupBy("user_id").agg(F.count("*").alias("events"))
        found = sorted(tuple(r) for r in events.run_to_end(stream, mode, "user_id", check).collect())
    assert found == [(0, 4), (1, 4)]
