"""The prefix tree against one built turn by turn in Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries, trie


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, convs=400, hot=150):
    rnd, rows = random.Random(seed), []
    role = lambda k: ["user", "assistant", None, ""][k % 2 if k % 7 else 2 + k % 2]
    common = [(k, role(k), f"common turn {k}") for k in range(4)]
    deep = [(k, role(k), f"deep {k} " + "é" * (k % 5)) for k in range(60)]
    for c in range(convs):
        kind = rnd.random()
        if c < hot:
            made = common
        elif kind < 0.1:
            made = deep[: rnd.randint(1, 60)] + [(99, "user", rnd.choice(["x", "y"]))] * rnd.randint(0, 1)
        elif kind < 0.5:
            made = [(k, role(k), f"t{rnd.randint(0, 2)}") for k in range(rnd.randint(1, 8))]
        else:
            made = [(k, role(k), f"own {c} {k}") for k in range(rnd.randint(1, 8))]
        rows += [(c * rnd.choice([1, 1, 1, 7]) + 3, *m) for m in made]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_the_ones_built_in_python(saved, monkeypatch, seed):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = talk(seed)
    assert rows_of(queries.conversation_nodes(saved(rows, SCHEMA))) == brute(rows)


def test_nulls_ties_repeats_and_turnless_conversations(saved):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (2, 5, "user", ""), (2, 5, "user", ""), (None, 1, "user", "x"), (100, 1, "a:b", "c"), (101, 1, "a", "b:c")]
    rows += [(c, 1, "user", "only one") for c in range(900, 960)]  # the shared opening takes their turn
    rows += [(-7, 1, "user", "below"), (-100, 1, "user", "zero")]
    want = brute([r for r in rows if r[0] is None or r[0] >= 0])
    assert rows_of(queries.conversation_nodes(saved([r for r in rows if r[0] is None or r[0] >= 0], SCHEMA))) == want
    assert queries.conversation_nodes(saved(rows, SCHEMA)).where("depth = 0").count() == 1
    assert rows_of(queries.conversation_nodes(saved([], SCHEMA))) == []
    assert rows_of(queries.conversation_nodes(saved([(None, 1, "user", "x")], SCHEMA))) == []
    wide = saved([(1, 1, "user", "x", 7, 8, 9)], SCHEMA + ", p int, key int, chars int")
    assert rows_of(queries.conversation_nodes(wide)) == brute([(1, 1, "user", "x")])


def test_copies_of_a_very_long_conversation_take_few_rounds(spark, saved, monkeypatch):
    rows = [(c, k, "user", f"turn {k}") for c in (0, 6, 12) for k in range(3000)] + [(6, 5000, "user", "more")]
    tables = []
    write = trie.stored
    monkeypatch.setattr(trie, "stored", lambda df: tables.append(1) or write(df))
    seq = trie.turns(saved(rows, SCHEMA))
    found = trie.prefix_trie(trie.stored(seq), spark.createDataFrame([(0,), (6,), (12,)], "conv_id long"))
    assert found.count() == 3002 and len(tables) < 20
    last = found.where("depth = 3000").first()
    assert (last["n_convs"], last["n_children"], last["n_leaves"]) == (3, 1, 1)
    assert found.where("depth = 0").first()["saved_tokens"] == 2 * sum(len(f"turn {k}") for k in range(3000))


def test_equals_its_sql(spark):
    from compare import both

    got, want = both(spark, queries.op11_conversation_trie, queries.ORACLE_SQL["op11_conversation_trie"])
    assert got == want and got
