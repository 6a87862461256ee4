"""Blocks of a page by its markup: lines stay whole, articles stay, time stays linear."""

import random
import time

import pytest

from ledgerline.llm.page_text import blocks_of, marks_boilerplate, tags_of, NAMES

CASES = (
    ('<article><p>Hello <span class="share">Share</span> world</p></article>', ["Hello world"]),
    ("<article><p>a<button>x</button>b <svg><text>no</text></svg>c</p><p>d</p></article>", ["ab c", "d"]),
    ('<article class="post no-sidebar"><p>kept</p></article>', ["kept"]),
    ('<main><div class="related-history"><p>kept too</p></div></main>', ["kept too"]),
    ('<main class="content sidebar"><h1>T</h1><div class="main-nav">menu</div><div class="comment-list"><p>c</p></div><p>x</p></main>', ["T", "x"]),
    ('<article><p>one<br>two &amp; <b>three</b></p><ul><li>i<li>j</ul></article>', ["one two & three", "i", "j"]),
    ('<article><p>a <span class="ad"><div>gone</div><p>gone</p></span> b</p></article>', ["a b"]),
    ('<article><p>a <a href="x>y" title=\'">\'>link</a> b</p></article>', ["a link b"]),
    ("<article><p>5 < 6 and 7 <8</p></article>", ["5 < 6 and 7 <8"]),
    ("<article>x<script>if (a<b) { '</p>' }</script>y<style>p{}</style>z</article>", ["xyz"]),
    ("<article><p>open <i>never closed</p><p>next</p></article>", ["open never closed", "next"]),
    ('<article><p>a <span class="share">unclosed</p><p>b</p></article>', ["a", "b"]),
    ("<article><p>x</p><!-- <p>no</p> --><p>y</p></article><footer><p>f</p></footer>", ["x", "y"]),
    ("<article><header><h1>Title</h1></header><p>x</p><footer>by</footer></article>", ["Title", "x"]),
    ("<article><p>x</p></article", ["x"]),
)


@pytest.mark.parametrize("page, want", CASES)
def test_blocks(page, want):
    assert [b.strip() for b in blocks_of(page)[0]] == [w.strip() for w in want]


def test_names():
    yes = "ad|ads|site-nav|cookie-banner|comment-list|sidebar_left|social-share|nav-bar-2|newsletter|Page-Footer sidebar".split("|")
    no = "no-sidebar|has-ads|related-history|content|adventure|post|share-price|not-a-comment|commentary|header-of-things".split("|")
    assert [n for n in yes if not marks_boilerplate(n, NAMES)] == [] and [n for n in no if marks_boilerplate(n, NAMES)] == []


@pytest.mark.parametrize("unit", ["<a b ", "<div>", "<p class='", '<a "', "<!-", "</div>", "<script", "</script ", "<b>x", "<div><span class=ad>", "<", "&amp;"])
@pytest.mark.parametrize("tail", ["", ">", "\"'>"])
def test_time_grows_with_length_alone(unit, tail):
    page = "<article><script>" * (unit == "</script ") + unit * (1_000_000 // len(unit)) + tail
    began = time.process_time()
    blocks_of(page)
    assert time.process_time() - began < 5


def plain(page):
    """The same by a plain recursive reading of well-formed pages: (main blocks)."""
    out, line = [], []

    def end():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    def walk(node, dropped):
        for child in node[2]:
            if isinstance(child, str):
                if not dropped:
                    line.append(child)
                continue
            gone = dropped or child[0] in ("button", "aside", "form") or child[1] == "ad"
            block = child[0] in ("p", "div", "aside", "form", "h2")
            if block and not dropped:
                end()
            walk(child, gone)
            if block and not dropped:
                end()

    walk(page, False)
    end()
    return out


def test_well_formed_pages_against_a_plain_reading():
    rnd = random.Random(7)

    def made(depth):
        kids = []
        for _ in range(rnd.randint(1, 4)):
            kids.append(rnd.choice(["one ", " two", "three", " ", ""]))
            if depth and rnd.random() < 0.7:
                tag = rnd.choice(["div", "div", "h2", "b", "span", "button", "aside", "form"])
                kids.append((tag, rnd.choice(["", "", "ad", "x"]), made(depth - 1)))
        return kids

    def written(node):
        return f"<{node[0]}" + (f' class="{node[1]}"' if node[1] else "") + ">" + "".join(k if isinstance(k, str) else written(k) for k in node[2]) + f"</{node[0]}>"

    for _ in range(3000):
        tree = ("article", "", made(4))
        assert blocks_of(written(tree))[0] == plain(tree), written(tree)


def test_tags_cover_a_page_in_order():
    page = "a<b c='>'>d</b><!-- x --><i>e<br/>"
    assert [page[a:b] for a, b, *_ in tags_of(page)] == ["<b c='>'>", "</b>", "<!-- x -->", "<i>", "<br/>"]
