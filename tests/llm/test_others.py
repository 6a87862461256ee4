"""Decontamination, media, pages, packing, mixing, URL rules, classifiers: cases and brute force."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import decontamination, media, mixing, packing, page_text, quality, toxicity, url_filter
from ledgerline.llm.queries import URL_RULES


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination_equals_brute_force(saved):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "Of", "é1", "zz", "that", "x"])
    items = [(k, " ".join(word() for _ in range(rnd.randint(0, 14)))) for k in range(12)] + [(99, None), (100, ""), (101, "only"), (None, "zz zz zz"), (5, "the the")]
    docs = [(k, ", ".join(word() for _ in range(rnd.randint(0, 60))), "z") for k in range(60)] + [(200, None, "z"), (201, "", "z"), (202, "Only.", "z"), (202, "Only.", "z")]
    windows: dict = {}
    for number, (i, t) in enumerate(items):
        w = _words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add((i, number))
    want = []
    for d, t, _ in docs:
        w = _words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    found |= windows[key]
                    hit |= set(range(a, a + n))
        ids = sorted(str(i) for i, _ in found if i is not None)
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    benchmark = saved(items, "item_id long, text string", 1)
    table = saved(docs, "doc_id long, text string, spans string")
    for block in (16 << 20, 40):
        decontamination.BLOCK_BYTES, kept = block, decontamination.BLOCK_BYTES
        got = decontamination.digest(decontamination.decontaminate(table, benchmark, keep=["doc_id"])).collect()
        decontamination.BLOCK_BYTES = kept
        assert sorted(map(tuple, got)) == sorted(want)
    none = decontamination.digest(decontamination.decontaminate(table, benchmark.where("false"), keep=["doc_id"]))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def test_media_round_trip():
    rnd = random.Random(1)
    texts = [None, b"", b"a" * 64, b"x" * 65, bytes([255] * 1000), rnd.randbytes(5000), b"\0" * 640 + bytes([200]) * 1280 + b"\0" * 640]
    for text, row in zip(texts, media.describe(texts)):
        payload = media.payload_of(text)
        assert len(payload) % 64 == 0 and payload and row[1:4] == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(media.describe(texts)[-1][-1]) == 2 or len(media.describe(texts)[-1][-1]) == 3
    data = media.encode([b"q" * 128])[0]
    frames, ms = media.indexed_frames(data)
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8 and len(frames) == 1 and ms == 40


def test_url_filter_equals_plain_rules(saved):
    rnd = random.Random(3)
    host = lambda: ".".join(rnd.choice(["a", "example", "net", "org", "com", "Net", "xnet", ""]) for _ in range(rnd.randint(1, 4)))
    urls = [f"{rnd.choice(['http', 'HTTPS'])}://{host()}{rnd.choice(['', '/', '/en/x', '/en', '/fr/?q', '/de/#a', '?x/en/'])}" for _ in range(400)] + [None, "", "no scheme", "a://b://c.net/", "http://example.net/en/1", "http://example.net/en/1"]
    rows = [(k, u, "r") for k, u in enumerate(urls)]
    want = []
    for k, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        p = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(a + b), a + b, v) for a, b, v in URL_RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=(0, None, "allow"))
        want.append((k, h, p, best[1], best[2]))
    got = url_filter.url_filter(saved(rows, "page_id long, url string, rule string"), URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_packing(saved):
    rnd = random.Random(4)
    docs = [(k, "word " * rnd.randint(0, 300)) for k in range(300)] + [(1000 + k, "copy of a text") for k in range(400)] + [(None, None)] * 50
    rows = packing.shard(saved(docs, "doc_id long, text string")).toPandas()
    assert len(rows) == len(docs) and rows["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in docs)
    sums = rows.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() < 0.1 * sums.mean()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert set(rows[rows.doc_id.isna()].text_crc32) == {0} and set(rows[rows.doc_id >= 1000].text_crc32) == {zlib.crc32(b"copy of a text")}
    assert packing.shard(saved([], "doc_id long, text string")).count() == 0


def test_mixing(saved):
    rnd = random.Random(5)
    docs = [(k, "word " * rnd.randint(0, 90), rnd.choice(["a", "a", "a", "b", "é", "ø", None])) for k in range(600)] + [(700, None, "a"), (701, "one two", "tiny")]
    rows = mixing.mix(saved(docs, "doc_id long, text string, source string")).toPandas()
    source = dict((d, s) for d, _, s in docs)
    rows["source"] = [source[d] or "￿" for d in rows.doc_id]
    assert len(rows) == len(docs) and (rows.taken <= 3 * rows["size"]).all()
    total = rows["size"].sum()
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(set(rows.source)))}
    sizes = rows.groupby("source")["size"].sum()
    target, capped = {}, set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in weight if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else free * weight[s] / share for s in weight}
        above = {s for s in weight if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            break
        capped |= above
    for s, g in rows.groupby("source"):
        assert abs(g.target.iloc[0] - target[s]) < 1e-6 * total and (g.target == g.target.iloc[0]).all() and (g.source_size == sizes[s]).all()
        assert abs(g.taken.sum() - target[s]) <= max(0.03 * target[s], 3)
    assert mixing.mix(saved([], "doc_id long, text string, source string")).count() == 0


def test_page_text(saved):
    article = "<html><head><title>t</title></head><body><header>H</header><nav><a>m</a></nav><div class='cookie-notice'>c</div><article><h1>Top &amp; more</h1><p>a <b>b</b>\n c<p>d<script>x</script><div id='comments'>no</div></article><aside>s</aside><form>f</form><footer>&copy;</footer>"
    plain = lambda x: f"<body><div>Menu</div><div>{x}</div><div>Imprint</div></body>"
    rows = [(1, "http://a.net/x", article), (2, "http://b.net/a/1", plain("one")), (3, "http://b.net/a/2", plain("two")), (4, None, None), (5, "", ""), (6, "http://c.net/", plain("alone"))]
    got = {r["page_id"]: r["text"] for r in page_text.page_text(saved(rows, "page_id long, url string, html string", 1)).collect()}
    assert got == {1: "Top & more\na b c\nd", 2: "one", 3: "two", 4: "", 5: "", 6: "Menu\nalone\nImprint"}


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        got = page_text.shared_lines(a, b)
        assert len(got) == table[-1, -1]
        rest = iter(b)
        assert all(a[k] in rest for k in sorted(got))


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, held = labels.where(F.col("doc_id") % 3 != 0), labels.where(F.col("doc_id") % 3 == 0)
    good = quality.score_quality(docs, seen).join(held.withColumnRenamed("quality", "_q"), "doc_id").select((F.col("keep").cast("int") == F.col("_q")).cast("int").alias("ok"))
    assert good.agg(F.avg("ok")).first()[0] > 0.95
    scored = toxicity.score_toxicity(docs, seen).join(held.withColumnRenamed("toxic", "_t"), "doc_id").select(F.col("toxic").cast("int").alias("said"), "_t").toPandas()
    assert (scored.said == scored._t).mean() > 0.9 and scored._t[scored.said == 1].mean() > 0.8


def test_classifiers_without_labels(saved):
    docs = saved([(1, None, None, None), (None, "", "s", "l"), (2, "text", "s", "l"), (2, "text", "s", "l")], "doc_id long, text string, source string, lang string")
    labels = saved([], "doc_id long, quality int, toxic int", 1)
    assert quality.score_quality(docs, labels).count() == 4 and toxicity.score_toxicity(docs, labels).count() == 4
    one = saved([(2, 1, 0), (3, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int", 1)
    assert quality.score_quality(docs, one).where("keep").count() == 4 and toxicity.score_toxicity(docs, one).where("toxic").count() == 0


def test_features_of_labelled_rows_take_little_memory():
    import random
    import tracemalloc

    from ledgerline.llm.toxicity import Sample, features_of

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))).encode()
    texts = [b" ".join(sorted({word() for _ in range(rnd.choice([0, 3, 150, 300]))})) for _ in range(2000)]
    tracemalloc.start()
    sample = Sample(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for k in (*range(60), len(texts) - 1):
        want = {}
        for w in texts[k].split():
            for f in features_of(w):
                want[f] = want.get(f, 0) + 1
        own = sample.row == k
        assert dict(zip((sample.names[c] for c in sample.column[own]), sample.count[own].tolist())) == want
    assert peak < 170 * len(sample.word) + 150 * len(sample.names), (peak, len(sample.word), len(sample.names))
