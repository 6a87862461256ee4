"""Chunks and vectors that are kept up to date over several runs."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ingestion
from ledgerline.operators.chunking import child_windows, parent_sections
from ledgerline.storage import new_path

UNITS = "source_path string, page int, unit int, text string"
BASE = [("a.pdf", 1, 0, "Schedule I\n\nshort\nlines"), ("a.pdf", 2, 1, "second page"), ("b.txt", None, 0, "x" * 900 + "\n" + "y"), ("empty", None, 0, None)]


def statuses(report):
    return {r["source_path"]: (r["status"], r["parents"], r["children"], r["error"]) for r in report.collect()}


def test_second_run_writes_nothing_and_changes_replace(spark):
    table = ingestion.chunk_table(spark, new_path(spark))
    assert table.rows().count() == 0 and table.version() == 0
    first = statuses(ingestion.ingest(table, spark.createDataFrame(BASE, UNITS)))
    assert first == {"a.pdf": ("ingested", 2, 2, None), "b.txt": ("ingested", 1, 2, None), "empty": ("ingested", 0, 0, None)}
    want = [(f"a.pdf:pg{p}:p{k}", None, x) for p, t in ((1, BASE[0][3]), (2, BASE[1][3])) for k, x in enumerate(parent_sections(t))]
    want += [(f"{i}:c{c}", i, child) for i, _, x in want for c, child in enumerate(child_windows(x))]
    rows = {(r["chunk_id"], r["parent_chunk_id"], r["text"]) for r in table.rows().where("source_path = 'a.pdf'").collect()}
    assert rows == set(want)
    assert {s[0] for s in statuses(ingestion.ingest(table, spark.createDataFrame(BASE[::-1], UNITS).repartition(3))).values()} == {"skipped_idempotent"}
    assert table.version() == 1
    changed = [("b.txt", None, 0, "new text"), ("c.txt", None, 0, "third")]
    assert statuses(ingestion.ingest(table, spark.createDataFrame(changed, UNITS))) == {"b.txt": ("updated", 1, 1, None), "c.txt": ("ingested", 1, 1, None)}
    assert sorted(r["text"] for r in table.rows().where("role = 'child' and source_path <> 'a.pdf'").collect()) == ["new text", "third"]
    before = sorted(map(tuple, table.rows().collect()), key=str)
    table.compact()
    assert sorted(map(tuple, table.rows().collect()), key=str) == before and table.manifest().select("generation").distinct().count() == 1
    assert table.rows(1).where("source_path = 'c.txt'").count() == 0  # the first state can still be read


def test_a_failing_source_leaves_the_others(spark):
    def read(text):
        if "broken" in text:
            raise ValueError("can't be read")
        return text

    table = ingestion.chunk_table(spark, new_path(spark))
    ingestion.ingest(table, spark.createDataFrame(BASE, UNITS), read)
    bad = [("a.pdf", 1, 0, "fine"), ("a.pdf", 2, 1, "broken"), ("d.txt", None, 0, "good")]
    for _ in range(2):  # tried again by the next run
        report = statuses(ingestion.ingest(table, spark.createDataFrame(bad, UNITS), read))
        assert report["a.pdf"] == ("error", None, None, "ValueError: can't be read")
    assert report["d.txt"][0] == "skipped_idempotent"
    assert table.rows().where("source_path = 'a.pdf'").count() == 4  # as before


def test_runs_that_meet_and_runs_that_die(spark):
    table = ingestion.chunk_table(spark, new_path(spark))
    ingestion.ingest(table, spark.createDataFrame(BASE, UNITS))
    with pytest.raises(RuntimeError):
        table.commit(table.manifest(), 0)
    table.write(table.rows())  # a run that died before its manifest
    assert table.rows().count() == 7


def test_vectors_follow_checksum_model_and_version(spark):
    embed = lambda size: lambda c: F.array(*[F.length(c).cast("float")] * size)
    chunks = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string").withColumn("checksum", F.sha2("text", 256))
    table = ingestion.vector_table(spark, new_path(spark))
    run = lambda rows, size=2, model="m", version="1": ingestion.index_vectors(table, chunks(rows), embed(size), model, version)
    counts = lambda r: tuple(r[k] for k in ("discovered", "embedded", "updated", "skipped", "stale_removed", "failures"))
    assert counts(run([("a", "x"), ("b", "yy"), ("c", "z")])) == (3, 3, 0, 0, 0, 0)
    assert counts(run([("a", "x"), ("b", "yy"), ("c", "z")])) == (3, 0, 0, 3, 0, 0) and table.version() == 1
    assert counts(run([("a", "x"), ("b", "changed"), ("d", "new")])) == (3, 1, 1, 1, 1, 0)
    assert {r["chunk_id"]: r["embedding"] for r in table.rows().collect()} == {"a": [1.0, 1.0], "b": [7.0, 7.0], "d": [3.0, 3.0]}
    failing = ingestion.index_vectors(table, chunks([("e", "q")]), lambda c: F.array(F.raise_error(F.concat(F.lit("no model "), c)).cast("float")), "m", "1")
    assert counts(failing) == (1, 0, 0, 0, 0, 1) and table.rows().count() == 3
    found = {r["chunk_id"]: (r["embedding"], r["was_stored"]) for r in ingestion.vectors_for(table, chunks([("a", "x"), ("zz", "miss")]), embed(2), "m", 2).collect()}
    assert found == {"a": ([1.0, 1.0], True), "zz": ([4.0, 4.0], False)} and table.rows().count() == 3
    assert counts(run([("a", "x"), ("b", "changed"), ("d", "new")], 3, "other")) == (3, 0, 3, 0, 0, 0)
    assert tuple(ingestion.index_meta(table).first()) == (3, ["other"], ["1"], [3])
    assert counts(run([])) == (0, 0, 0, 0, 3, 0) and table.rows().count() == 0


def test_a_task_hands_chunks_on_by_parts_of_a_batch():
    import pandas as pd

    from ledgerline.operators import ingestion

    text = "\n\n".join("word " * 60 for _ in range(10))
    batch = pd.DataFrame({"source_path": [f"s{k}" for k in range(2000)], "page": [None] * 2000, "unit": [0] * 2000, "text": [text] * 2000})
    frames = list(ingestion.cut_units(None)(iter([batch])))
    assert len(frames) > 4 and max(f["text"].str.len().sum() for f in frames) < 3 * ingestion.HANDED_ON
    got = pd.concat(frames)
    assert got["source_path"].nunique() == 2000 and not got["chunk_id"].duplicated().any()
    assert list(ingestion.cut_units(None)(iter([batch.head(0)])))[0].empty
