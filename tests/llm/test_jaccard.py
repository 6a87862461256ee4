"""The join's components against all pairs."""

import collections
import random
import re

import numpy as np
import pytest

from ledgerline.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for group, most in [(40, 2)] * 1 + [(1, 4)]:
        for _ in range(group):
            base = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
            for _ in range(rnd.choice([1, 1, 2, 5]) if group > 1 else 80):
                words = list(base)
                for _ in range(rnd.randint(0, most)):
                    if words:
                        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
                rows.append((len(rows), " ".join(words)))
    return [*rows, (None, None), (None, ""), (5000, " \t "), (5001, "One two"), (5002, "one TWO"), (None, "one two"), (7, "x " * 500), (7, "x " * 400)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(saved, monkeypatch, small):
    if small:  # salted groups, several blocks, several batches of a leader
        for name, value in {"FAMILY_TOKENS": 1, "GROUP_ROWS": 4, "BLOCK_ROWS": 8, "PER_COUNTER": 1, "LEADER_PAIRS": 5}.items():
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    got = jaccard.near_duplicates(saved(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_several_files_in_a_task(spark):
    # 23 small files, of which a task reads several: numbers far apart and in no order within a batch
    rows = [(d, t) for d, t in corpus() if d is not None]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(23)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(saved):
    assert jaccard.near_duplicates(saved([], "doc_id long, text string")).count() == 0


def test_filters_are_bounds():
    rnd, nothing = np.random.default_rng(1), np.zeros(1 << 10, dtype=np.uint8)
    for _ in range(300):
        n = int(rnd.integers(1, 200))
        a = np.unique(rnd.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * rnd.uniform(0.6, 1))], rnd.integers(0, 1 << 60, int(n * rnd.uniform(0, 0.2))).astype(np.uint64))))
        if len(b) and jaccard.linked(a, b):
            assert np.intersect1d(jaccard.prefix(a, nothing), jaccard.prefix(b, nothing)).size
            assert jaccard.heads_meet(jaccard.heads(a), jaccard.heads(b))


def test_rows_without_candidates_do_not_move(saved, spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(300))) for k in range(1200)]
    rows += [(k + 5000, t.rsplit(" ", 4)[0]) for k, t in rows[:6]]
    docs = saved(rows, "doc_id long, text string")
    sc = spark.sparkContext

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    began = shuffled()
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    moved = shuffled() - began
    assert got == {d: d - 5000 if d >= 5000 else d for d, _ in rows}
    assert moved < sum(len(t) for _, t in rows), moved  # the index mainly; all texts and sketches moved before, twice each


def test_no_row_of_a_pair_is_lost(saved, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_MOST", 1 << 16)
    table = saved([(k, f"t{k}") for k in [*range(20_000), -7, 1 << 62, 5 << 33]], "_row long, text string")
    for pairs in ([], [(0, 19_999), (5, 1 << 62), (5, 5 << 33), (-7, 3)]):
        got = jaccard.of_pairs(table, "_row", saved(pairs, "a long, b long")).collect()
        assert {x for p in pairs for x in p} <= {r._row for r in got} and len(got) < 100
        assert all(r.text == f"t{r._row}" for r in got)
    crowd = saved([(k, k + 1) for k in range(0, 20_000, 2)], "a long, b long")
    assert {r._row for r in jaccard.of_pairs(table, "_row", crowd).collect()} >= set(range(20_000))
