"""All pages are compared with their neighbours; markup then checks what the comparison deleted."""

import random
import time

import pytest

from ledgerline.llm import page_text

SCHEMA = "page_id long, url string, html string"


def _rows(pages):
    return {r["page_id"]: (r["text"], r["n_shared"], r["n_restored"]) for r in page_text.page_text(pages).collect()}


def _article(*lines, aside=""):
    return "<nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + f"</article>{aside}<footer>Imprint</footer>"


def test_marked_pages_are_compared_and_keep_their_articles(saved):
    rows = [(1, "http://a.net/1", _article("one", "passage", aside="<div>Follow us</div>")), (2, "http://a.net/2", _article("passage", "two", aside="<div>Follow us</div>"))]
    rows += [(3, "http://a.net/3", _article("three")), (4, "http://b.net/1", _article("passage"))]
    assert _rows(saved(rows, SCHEMA)) == {1: ("one\npassage", 2, 1), 2: ("passage\ntwo", 2, 1), 3: ("three", 0, 0), 4: ("passage", 0, 0)}


def test_lines_of_main_beside_its_articles_are_left_to_the_comparison(saved):
    def page(k):
        return f"<main><div>Read more on our site</div><h1>Title {k}</h1><article><p>passage</p><p>{k}</p></article></main>"

    assert _rows(saved([(k, f"http://a.net/{k}", page(k)) for k in range(4)], SCHEMA)) == {k: (f"Title {k}\npassage\n{k}", 2, 1) for k in range(4)}


def test_a_line_in_the_article_of_the_next_page_is_no_template(saved):
    beside = "<main><article><p>passage</p></article><div>tail</div></main>"
    rows = [(1, "http://a.net/1", "<div>passage</div><div>own</div><div>tail</div>"), (2, "http://a.net/2", beside)]
    assert _rows(saved(rows, SCHEMA)) == {1: ("passage\nown", 2, 1), 2: ("passage", 2, 1)}


def _length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not b else _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_alignment_by_bits_against_a_plain_table():
    rnd = random.Random(7)
    for _ in range(2000):
        a, b = ([rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        for found in (page_text.aligned(a, b), page_text.aligned_by_bits(a, b)):
            assert len(found) == _length(a, b) and all(a[i] == b[j] for i, j in found)
            assert all(x[0] > y[0] and x[1] > y[1] for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("values", [1, 2, 10])
def test_many_equal_lines_are_aligned_in_bounded_time(values):
    rnd = random.Random(7)
    a, b = ([str(rnd.randrange(values)) for _ in range(n)] for n in (20_000, 15_000))
    began = time.process_time()
    page_text.shared_lines(a, b)
    assert time.process_time() - began < 5
