"""Repeated strings against counting every window."""

import collections
import hashlib
import itertools
import random

import pytest

from ledgerline.llm import repeats


def brute(texts, least):
    count = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        runs = sum(k for k, _ in itertools.groupby(mark))
        out.append((len(t), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(t, mark) if not m)).hexdigest()))
    return sorted(out)


def corpus(least, seed):
    rnd, out = random.Random(seed), []
    for _ in range(60):
        base = bytes(rnd.choice(b"abcdefgh ") for _ in range(rnd.randint(0, least * 6)))
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t = bytearray(base)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                if t:
                    i = rnd.randrange(len(t))
                    t[i : i + rnd.randint(0, 2)] = b"XY"[: rnd.randint(0, 2)]
            out.append(bytes(t))
    passage = bytes(rnd.choice(b"abcdefgh ") for _ in range(least + least // 3))
    out = [t[: len(t) // 2] + passage + t[len(t) // 2 :] if k % 4 == 0 else t for k, t in enumerate(out)]
    return [*out, b"", b"a" * least * 5, b"ab" * least * 3, b"a" * (least - 1), passage, passage]


@pytest.mark.parametrize("least,large", [(24, 256), (24, 3), (41, 2)])
def test_equals_counting_every_window(saved, monkeypatch, least, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    texts = corpus(least, least)
    docs = saved([(k, bytearray(t), "x") for k, t in enumerate(texts)], "doc_id long, text binary, n_spans string")
    got = sorted(tuple(r)[1:5] for r in repeats.remove_repeats(docs, least).drop("spans").collect())
    assert got == brute(texts, least)


def test_pieces_of_long_texts(saved, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    texts = corpus(30, 9)
    docs = saved([(k, bytearray(t)) for k, t in enumerate(texts)], "doc_id long, text binary")
    assert sorted(tuple(r)[1:5] for r in repeats.remove_repeats(docs, 30).drop("spans").collect()) == brute(texts, 30)


def test_nulls_repeats_of_rows_and_empty_tables(saved):
    long = "".join(random.Random(1).choice("abcdefg ") for _ in range(900))
    docs = saved([(None, long), (None, long), (1, None), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in repeats.remove_repeats(docs).drop("spans").collect()), key=str)
    assert got == sorted([(None, 900, 900), (None, 900, 900), (1, 0, 0), (2, 5, 0), (2, 5, 0)], key=str)
    assert repeats.remove_repeats(saved([], "doc_id long, text string")).count() == 0


def test_maximal_repeats_are_maximal():
    found = {(n, tuple(sorted(o))) for n, o in repeats.maximal_repeats([b"xabcdey", b"zabcdew", b"abcdq"], 3)}
    assert (5, ((0, 1), (1, 1))) in found and (4, ((0, 1), (1, 1), (2, 0))) in found
    assert not any((0, 2) in o for _, o in found)
