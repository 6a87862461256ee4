"""The pipeline's stages, each against a plain version in Python over what it was given."""

import collections

import pytest
from compare import both
from test_jaccard import brute as all_pairs
from test_others import _words

import corpus_pipeline
from ledgerline.llm import queries
from ledgerline.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    words = _words(text)
    windows = {tuple(w[a : a + 10]) for w in map(_words, items) for a in range(max(1, len(w) - 9) if w else 0)}
    return any(tuple(words[a : a + n]) in windows for n in {len(x) for x in windows} for a in range(len(words) - n + 1))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_toxic_documents_go(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    before, after = rows_of(steps[0]), rows_of(steps[1])
    assert not collections.Counter(after) - collections.Counter(before)
    gone = collections.Counter(before) - collections.Counter(after)
    known = [(labels[r[0]], r in gone) for r in set(before) if labels.get(r[0]) is not None]
    assert sum(t == g for t, g in known) / len(known) > 0.95 and sum(g for t, g in known if t == 0) <= 1
    assert all(r[1] for r in gone)


def test_one_of_each_group_stays(steps):
    before, after = steps[1].collect(), steps[2].collect()
    groups = {(r["doc_id"]): c for r, (_, _, c) in zip(sorted(before, key=lambda r: r["doc_id"]), sorted(all_pairs([(r["doc_id"], r["text"]) for r in before])))}
    assert sorted(groups[r["doc_id"]] for r in after) == sorted(set(groups.values()))


def test_contaminated_documents_go(spark, steps):
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    want = sorted((tuple(r) for r in steps[2].collect() if not contaminated(r["text"], items)), key=str)
    assert rows_of(steps[3]) == want


def test_sources_come_near_their_targets(steps):
    before, after = steps[3].collect(), steps[4].collect()
    size = lambda r: len((r["text"] or "").split())
    times = collections.Counter(tuple(r) for r in after)
    assert set(times) <= {tuple(r) for r in before} and all(n <= 3 * sum(tuple(b) == k for b in before) for k, n in list(times.items())[:50])
    names = sorted({r["source"] for r in before})
    have = {s: sum(size(r) for r in before if r["source"] == s) for s in names}
    target, capped = {}, set()
    while True:
        free, share = sum(have.values()) - sum(3 * have[s] for s in capped), sum(1 + k % 3 for k, s in enumerate(names) if s not in capped)
        target = {s: 3 * have[s] if s in capped else free * (1 + k % 3) / share for k, s in enumerate(names)}
        above = {s for s in names if target[s] > 3 * have[s] * (1 + 1e-12)}
        if not above:
            break
        capped |= above
    got = {s: sum(size(r) for r in after if r["source"] == s) for s in names}
    longest = {s: max(size(r) for r in before if r["source"] == s) for s in names}
    assert all(abs(got[s] - target[s]) <= longest[s] + 0.02 * target[s] for s in names)


def test_shards_hold_all_rows(steps):
    before, after = steps[4], steps[5]
    assert rows_of(after.select(*before.columns)) == rows_of(before)
    placed = after.toPandas()
    assert placed["shard"].between(0, 15).all() and all(sorted(g["slot"]) == list(range(len(g))) for _, g in placed.groupby("shard"))


def test_columns_of_any_name(spark, steps, tmp_path):
    docs = steps[0]
    for c in ("toxic", "spans", "items", "n_words", "row", "_row", "_doc", "copies", "size", "shard"):
        docs = docs.withColumn(c, docs["doc_id"])
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF))
        kept = [c for c in ("toxic", "spans", "items", "n_words", "row", "_row", "_doc", "copies") if c in docs.columns]
        assert len(kept) == 8 and docs.where(" or ".join(f"{c} <> doc_id" for c in kept)).count() == 0
    assert docs.where("shard = doc_id").count() < docs.count()


def test_empty_and_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (None, "", "", "", 0), (2, "one two", "en", "s", 7), (2, "one two", "en", "s", 7)]
    for rows, many in (([], 0), (odd, 1)):
        path = str(tmp_path / str(many))
        spark.createDataFrame(rows, schema).write.parquet(path)
        docs = spark.read.parquet(path)
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
        assert {tuple(r)[:2] for r in docs.collect()} == ({(2, "one two")} if many else set())
        assert set(corpus_pipeline.SHARD_COLUMNS) <= set(docs.columns)


def test_url_query_equals_its_sql(spark):
    got, want = both(spark, queries.QUERIES["op4_url_filter"], queries.ORACLE_SQL["op4_url_filter"])
    assert got == want
