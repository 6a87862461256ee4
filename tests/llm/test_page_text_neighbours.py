"""Pages without marked blocks: each is compared with the nearest pages that differ."""

import random
from collections import defaultdict

import pytest

from ledgerline.llm import page_text

SCHEMA = "page_id long, url string, html string"


def _page(*blocks):
    return "".join(f"<div>{x}</div>" for x in ("Menu", *blocks, "Imprint"))


def _texts(pages):
    return {r["page_id"]: r["text"] for r in page_text.page_text(pages).collect()}


def test_copies_get_the_text_of_one(saved):
    rows = [(k, "http://a.net/2", _page("two")) for k in range(5)] + [(10 + k, f"http://a.net/3/{k}", _page("two")) for k in range(4)]
    rows += [(20, "http://a.net/1", _page("one", "only left")), (30, "http://a.net/4", _page("four")), (40, "http://b.net/", _page("two")), (41, "http://b.net/", _page("two"))]
    want = {k: "two" for k in [*range(5), *range(10, 14)]} | {20: "one\nonly left", 30: "four", 40: "Menu\ntwo\nImprint", 41: "Menu\ntwo\nImprint"}
    assert _texts(saved(rows, SCHEMA)) == want


def _plain(hosts):
    """By host its lists of lines, in order: each without lines shared with the nearest that differ."""
    out = []
    for pages in hosts:
        for k, x in enumerate(pages):
            near = [next((y for y in side if y != x), []) for side in (pages[:k][::-1], pages[k + 1 :])]
            gone = set().union(*(page_text.shared_lines(x, y) for y in near))
            out.append("\n".join(line for j, line in enumerate(x) if j not in gone))
    return out


def test_cuts_do_not_change_the_text():
    rnd = random.Random(7)
    for _ in range(3000):
        hosts = [[["m", *rnd.choice(["a", "b", "ab", "ba"]), "i"] for _ in range(rnd.randint(1, 6))] for _ in range(rnd.randint(1, 3))]
        rows = [((f"h{h}", h, k), x) for h, pages in enumerate(hosts) for k, x in enumerate(pages)]
        cuts = sorted(rnd.randint(0, len(rows)) for _ in range(rnd.randint(0, 6)))
        out, held, runs = {}, defaultdict(list), []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            for key, text, edge, lines, within in page_text.differenced(iter(rows[a:b])):
                if lines is not None:
                    runs.append((part, edge, key[0], lines, within))
                elif edge is not None:
                    held[part, edge].append(key)
                else:
                    out[key] = text
        for part, edge, text in page_text.edge_texts(iter(sorted(runs, key=lambda r: r[:2]))):
            out |= dict.fromkeys(held.pop((part, edge)), text)
        assert not held and [out[k] for k, _ in rows] == _plain(hosts)


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_ranges_do_not_change_the_text(spark, saved, ranges):
    rows = [(k, f"http://{'ab'[k % 2]}.net/{k // 2:02}", _page(f"text {k // 8}")) for k in range(40)] + [(90, "http://c.net/1", _page("x")), (91, "http://c.net/2", _page("y"))]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert _texts(saved(rows, SCHEMA)) == {k: f"text {k // 8}" for k in range(40)} | {90: "x", 91: "y"}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
