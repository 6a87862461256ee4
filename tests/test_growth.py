"""Steps whose cost must follow their input: by their plans, and by results over many small batches."""

from ledgerline.operators import extraction


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_off_one_stream(spark):
    head = [(10.0, 100.0, 80.0, 110.0, "Description"), (120.0, 101.0, 150.0, 111.0, "Qty"), (200.0, 100.0, 230.0, 110.0, "Amount")]
    pages = {(d, p): head + [(12.0, 120.0 + 20 * k, 60.0, 130.0 + 20 * k, f"cloth{d}"), (125.0, 120.0 + 20 * k, 140.0, 130.0 + 20 * k, str(d + k))] for d in range(30) for p in (1, 2) for k in (d % 3,)}
    words = spark.createDataFrame([(d, p, *w) for (d, p), ws in pages.items() for w in ws], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    want = sorted(c for (d, p), ws in pages.items() for c in extraction._cells(d, p, extraction.table_rows(ws)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # pages lie over several batches
    try:
        found = extraction.tables(words)
        assert sorted(map(tuple, found.collect())) == want and len(want) == 120
        assert "InPandas" not in _plan(found)  # no call for each page
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_the_index_moves_each_text_once_and_a_search_bare_postings(spark):
    import random

    from ledgerline.operators import lexical_index
    from ledgerline.storage import new_path

    rnd, path = random.Random(3), new_path(spark)
    rows = [(k, " ".join(f"w{rnd.randrange(2000)}" for _ in range(100))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began, size = _shuffled(spark), sum(len(t) for _, t in rows)
    lexical_index.write_index(docs, path)
    wrote = _shuffled(spark) - began  # the texts to their places here, and to their ranges
    queries = spark.createDataFrame([(k, " ".join(f"w{rnd.randrange(2000)}" for _ in range(60))) for k in range(200)], "query_id int, text string")
    began = _shuffled(spark)
    assert lexical_index.search(spark.read.parquet(path), queries, 5).count() == 1000
    assert wrote < 2.2 * size and _shuffled(spark) - began < 8 * size


def test_printed_pages_are_dealt_out_before_their_labels_are_read(spark):
    from compare import SF

    from ledgerline import catalog

    assert "REPARTITION_BY_NUM" in _plan(catalog.QUERIES["label_candidates"](spark, SF))


def test_words_of_scans_are_not_moved_again(spark):
    from compare import SF

    from ledgerline import catalog

    assert _plan(catalog.QUERIES["ocr_pages"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_features_are_hashed_once(monkeypatch):
    import hashlib
    from collections import Counter

    import numpy as np
    from ledgerline.functions import tokens as T

    texts = ["Export of raw cotton, of cotton", "", "a", "ab", "İstanbul  ünïcode\tblank", "export of raw cotton " * 200]
    for text in texts:
        low = text.lower()
        w, flat, want = T.re.findall("[a-z0-9]+", low), " ".join(low.split()), np.zeros(64)
        for f, n in Counter([*w, *map("_".join, zip(w, w[1:])), *(flat[i : i + 3] for i in range(len(flat) - 2))]).items():
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            want[(h >> 1) % 64] += n if h & 1 else -n
        assert (T._embed(text, 64) == (want / np.linalg.norm(want) if want.any() else want)).all()
    monkeypatch.setattr(T.hashlib, "blake2b", None)  # known features are not hashed again
    for text in texts:
        T._embed(text, 64)
