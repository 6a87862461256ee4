"""Nulls, ties, repeats, empty tables, clashing columns and changing partitions, for all operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as all_pairs
from test_jaccard import corpus as near_copies
from test_repeats import brute as every_window
from test_repeats import corpus as repeats_corpus

from ledgerline.llm import common, decontamination, jaccard, media, mixing, packing, page_text, quality, repeats, toxicity, url_filter


@pytest.fixture
def recut(spark, monkeypatch):
    """Files are cut otherwise in each job that follows a written table, as when executors come and go."""
    write, sizes = common.stored, ["2k", "1g", "512"]

    def stored(df):
        out = write(df)
        sizes.append(sizes.pop(0))
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out

    from ledgerline.llm import components

    for module in (common, components, jaccard, repeats):
        monkeypatch.setattr(module, "stored", stored)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_links_do_not_depend_on_how_files_are_cut(saved, recut):
    rows = near_copies()
    got = jaccard.near_duplicates(saved(rows, "doc_id long, text string", 12)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == all_pairs(rows)


def test_repeats_do_not_depend_on_how_files_are_cut(saved, recut):
    texts = repeats_corpus(24, 7)
    docs = saved([(k, bytearray(t)) for k, t in enumerate(texts)], "doc_id long, text binary", 12)
    assert sorted(tuple(r)[1:5] for r in repeats.remove_repeats(docs, 24).drop("spans").collect()) == every_window(texts, 24)


CLASH = "doc_id long, text string, source string, lang string, _row int, _text int, row int, item int, size int, toxic string, spans int, n_words int, kept int, _id int, clips int"
ROWS = [(k, f"some words of text number {k % 3} here and there", "s", "en", *[7] * 5, "t", *[7] * 5) for k in range(6)] + [(None, None, None, None, *[7] * 5, "t", *[7] * 5)]


def test_clashing_columns(saved):
    docs = saved(ROWS, CLASH)
    labels = saved([(0, 1, 0), (1, 0, 1), (2, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int", 1)
    bench = saved([(1, "some words of text number 1")], "item_id long, text string", 1)
    kept = repeats.remove_repeats(docs, 20, keep=["doc_id", "_row", "_text", "row", "spans"])
    assert kept.count() == 7 and set(kept.columns) >= {"_row", "_text", "row", "n_removed"} and {r["_row"] for r in kept.collect()} == {7}
    clean = decontamination.decontaminate(docs, bench, keep=["doc_id", "_row", "_text", "spans"])
    assert {r["_row"] for r in clean.collect()} == {7} and clean.where("size(spans) > 0").count() == 2
    assert jaccard.near_duplicates(docs).count() == 7 and packing.shard(docs, 2).count() == 7 and mixing.mix(docs).count() == 7
    assert quality.score_quality(docs, labels).count() == 7
    assert {r["_text"] for r in toxicity.score_toxicity(docs, labels, keep=["doc_id", "_text", "toxic"]).collect()} == {7}
    assert {r["_row"] for r in media.media_columns(docs, keep=["doc_id", "_row", "clips"]).collect()} == {7}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/x").alias("url"), F.col("text").alias("html"), "_row", "_id", "_text")
    assert page_text.page_text(pages).count() == 7


def test_empty_tables(saved):
    docs = saved([], "doc_id long, text string, source string, lang string")
    labels = saved([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int", 1)
    pages = saved([], "page_id long, url string, html string")
    for empty in (toxicity.score_toxicity(docs, labels), quality.score_quality(docs, labels), media.media_columns(docs), page_text.page_text(pages), url_filter.url_filter(pages, (("net", "/", "block"),)), decontamination.decontaminate(docs, labels.selectExpr("doc_id as item_id", "cast(null as string) as text"))):
        assert empty.count() == 0
    one = saved([(1, "http://x.net/", "")], "page_id long, url string, html string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.url_filter(one, ()).collect()] == [(None, "allow")]


def test_ids_of_another_type_and_repeated_ids(saved, monkeypatch):
    docs = saved([(f"d{k % 4}", f"text {k} bad" if k % 4 == 1 else f"text {k} fine", "s", "l") for k in range(40)], "doc_id string, text string, source string, lang string")
    labels = saved([(f"d{k}", k % 2, int(k == 1)) for k in range(4)], "doc_id string, quality int, toxic int", 1)
    assert common.labelled(docs, labels, 5, "doc_id", "text", "toxic").count() == 4 * 0 + 5
    scored = toxicity.score_toxicity(docs, labels)
    assert scored.count() == 40 and {r["toxic"] for r in scored.where("doc_id = 'd1'").collect()} == {True} and scored.where("doc_id <> 'd1' and toxic").count() == 0
    assert quality.score_quality(docs, labels).count() == 40


def test_groups_of_equal_texts_share_a_shard(saved):
    docs = [(k, f"text {k % 150} " * (1 + k % 7)) for k in range(900)] + [(5000 + k, "huge " * 400) for k in range(300)]
    rows = packing.shard(saved(docs, "doc_id long, text string"), 16).toPandas()
    text = dict(docs)
    rows["text"] = [text[d] for d in rows.doc_id]
    shards = rows.groupby("text")["shard"].nunique()
    assert shards[shards.index != "huge " * 400].max() == 1 and shards["huge " * 400] > 1  # more than a shard holds
    sums = rows.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.1 * sums.mean()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_slots_by_lanes(saved, monkeypatch):
    monkeypatch.setattr(packing, "LANE_ROWS", 7)
    rows = packing.shard(saved([(k, "same text") for k in range(200)], "doc_id long, text string"), 4).toPandas()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_packing_by_dot_product():
    rnd = np.random.default_rng(3)
    vectors = rnd.integers(1, 60, (80, 3)).astype(float)
    need, left, want = vectors / vectors.sum(axis=0) * 5, np.ones((5, 3)), {}
    for i in sorted(range(80), key=lambda i: (-max(need[i]), i)):  # the rule, spelled out
        fits = [b for b in range(5) if left[b][0] >= need[i][0]]
        best = max(fits, key=lambda b: (sum(left[b][d] * need[i][d] for d in range(3)), -b)) if fits else max(range(5), key=lambda b: (left[b][0], -b))
        left[best] = left[best] - need[i]
        want[i] = best
    assert packing.pack(vectors, 5).tolist() == [want[i] for i in range(80)]


def test_clips_are_timed_rows(saved):
    cut = b"\0" * 1024 + bytes([200]) * 2048 + b"\0" * 512
    docs = saved([(1, bytearray(cut)), (2, None), (1, bytearray(cut))], "doc_id long, text binary")
    found = media.media_columns(docs)
    clips = sorted((r["doc_id"], r["clip"], r["start_ms"], r["end_ms"], r["frames"]) for r in media.clip_rows(found).collect())
    assert clips == sorted(2 * [(1, 0, 0, 40, 1), (1, 1, 40, 120, 2), (1, 2, 120, 160, 1)] + [(2, 0, 0, 40, 1)])
    assert found.where("doc_id = 1").select("media_sha256").distinct().count() == 1


def test_copies_keep_to_what_is_taken(saved):
    rnd = np.random.default_rng(4)
    docs = [(k, "word " * int(n), f"s{k % 4}") for k, n in enumerate(rnd.integers(0, 400, 2000))]
    mixed = mixing.copies(mixing.mix(saved(docs, "doc_id long, text string, source string"))).toPandas()
    assert (mixed.copies <= 3).all() and (mixed.copies[mixed["size"] == 0] == 0).all()
    for _, g in mixed.groupby("source_id"):
        assert abs((g.copies * g["size"]).sum() - g.taken.sum()) < 0.01 * g.taken.sum()


def test_a_repeated_page_and_a_very_long_one(saved):
    plain = lambda x: f"<body><div>Menu</div><div>{x}</div><div>Imprint</div></body>"
    long = "<article>" + "<p>one line of text</p>" * 20_000 + "</article>"
    rows = [(1, "http://b.net/1", plain("one")), (1, "http://b.net/1", plain("one")), (2, "http://b.net/2", plain("two")), (3, "http://b.net/3", long)]
    got = sorted((r["page_id"], len(r["text"].split("\n")), r["text"][:3]) for r in page_text.page_text(saved(rows, "page_id long, url string, html string", 2)).collect())
    assert got == [(1, 1, "one"), (1, 1, "one"), (2, 1, "two"), (3, 20_000, "one")]
