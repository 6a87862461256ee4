"""The stored lexical index and blocked vector search against scoring everything."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import lexical_index, retrieval, vector_index
from ledgerline.storage import new_path


def corpus(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = [(k, " ".join(f"w{min(int(rnd.expovariate(0.08)), 80)}" for _ in range(rnd.randint(0, 30)))) for k in range(n)] + [(9000, None), (9001, ""), (9002, "common 5201.0090"), (9003, "zz " * 3000)]
    rows += [(10_000 + k, "same text of many copies") for k in range(300)]
    queries = [(1, "w1 w2 w70"), (2, "w80 w80"), (3, "absent"), (4, "same text w3"), (5, ""), (6, "pct 52010090 w0"), (7, " ".join(f"w{k}" for k in range(40)))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "query_id int, text string")


def test_search_equals_scoring_everything(spark, monkeypatch):
    docs, queries = corpus(spark)
    want = retrieval._best(retrieval.bm25(retrieval.postings(docs), queries), "score", 15, "lexical_rank").select("query_id", "doc_id", "score", "lexical_rank").collect()
    for ranges, block in ((10_000, 256), (40, 2), (7, 256)):
        monkeypatch.setattr(lexical_index, "QUERY_BLOCK", block)
        path = new_path(spark)
        lexical_index.write_index(docs, path, range_docs=ranges)
        got = lexical_index.search(spark.read.parquet(path), queries, 15).collect()
        key = lambda rows: sorted((r["query_id"], r["lexical_rank"], r["doc_id"], round(r["score"], 5)) for r in rows)
        assert key(got) == key(want)


def test_ranges_that_cannot_matter_are_not_read(spark, monkeypatch):
    """One range holds all the good documents; the others are bounded away."""
    docs = spark.createDataFrame([(k, "rare " * 5 if k < 30 else "rare and a long tail of other words " * 9) for k in range(3000)], "doc_id long, text string")
    path, read = new_path(spark), []
    lexical_index.write_index(docs, path, range_docs=20)
    score = lexical_index._scored
    monkeypatch.setattr(lexical_index, "_scored", lambda blocks, weights, pairs, *more: read.append(pairs.count()) or score(blocks, weights, pairs, *more))
    found = lexical_index.search(spark.read.parquet(path), spark.createDataFrame([(1, "rare")], "query_id int, text string"), 1)
    assert [r["doc_id"] for r in found.collect()] == [0]
    assert sum(read) < 60  # of 150 ranges


def test_a_search_reads_the_index_alone_and_only_its_buckets(spark):
    docs, queries = corpus(spark, 100)
    index = lexical_index.index_of(docs, "test-buckets")
    found = lexical_index.search(index, queries.where("query_id = 2"), 5)
    plan = found._jdf.queryExecution().toString()
    assert "lexical-test-buckets" in plan and "PartitionFilters: [" in plan and "bucket" in plan
    again = lexical_index.index_of(docs.withColumn("text", F.raise_error(F.lit("texts are read again")).cast("string")), "test-buckets")
    assert lexical_index.search(again, queries, 5).count() > 0
    assert {(r["token"], r["df"]) for r in lexical_index.terms(index).where("token = 'zz' or token like 'pct%'").collect()} == {("zz", 1), ("pct52010090", 1)}


def test_an_empty_corpus(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    path = new_path(spark)
    lexical_index.write_index(docs, path)
    index = spark.read.schema("token string, range int, n int, tf_most int, dl_least int, docs array<long>, tfs array<int>, dls array<int>, bucket int").parquet(path)
    assert lexical_index.search(index, spark.createDataFrame([(1, "a")], "query_id int, text string"), 5).count() == 0


def test_dense_top_equals_all_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in rnd.integers(-3, 4, 6)]) for k in range(500)] + [(600 + k, [1.0] * 6) for k in range(80)] + [(700, None), (701, [1.0]), (702, [])]
    queries = [(f"q{k}", [float(x) for x in rnd.integers(-3, 4, 6)]) for k in range(9)] + [("short", [2.0])]
    df = spark.createDataFrame(vectors, "doc_id long, embedding array<float>").repartition(7)
    asked = spark.createDataFrame(queries, "query_id string, vector array<float>")
    want = []
    for q, v in queries:
        scored = sorted(((-(sum(a * b for a, b in zip(x, v)) if x is not None and len(x) == len(v) else 0.0), k) for k, x in vectors))[:20]
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(scored)]
    for size in (8 << 20, 300):
        monkeypatch.setattr(vector_index, "QUERY_BYTES", size)
        got = [tuple(r) for r in vector_index.dense_top(vector_index.pack_vectors(df), asked, 20).collect()]
        assert sorted(got) == sorted(want)
    assert vector_index.dense_top(vector_index.pack_vectors(df), asked.limit(0), 3).count() == 0
