"""Whitening against dense eigenvectors of the exact covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import whitening


def brute(rows, components=16):
    """{id: (n, deviation, whitened, explained)} by exact sums and a dense solver."""
    usable = [(k, [math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for x in {tuple(x) for _, x in usable}]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    usable = [(k, x) for k, x in usable if len(x) == d]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda x: [n * a - s for a, s in zip(x, sums)]
    m = np.array([centred(x) for x in fit], float) / n
    v = m.T @ m / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    real = e > 1e-12 * e[0]
    e, u = e[real], u[:, real]
    out = {}
    for k, x in usable:
        c = centred(x)
        out.setdefault(k, []).append((n, sum(a * a for a in c), np.array(c, float) / n @ u / np.sqrt(e), e / np.trace(v)))
    return out


def held(found, want):
    got = {}
    rows = found.collect()
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == set(want) and len(rows) == sum(len(w[0][2]) * len(w) for w in want.values())
    signs = {}
    for k, w in want.items():
        n, deviation, white, explained = w[0]
        for r in got[k]:
            c = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-8
            if abs(white[c]) > 1e-3:
                sign = signs.setdefault(c, np.sign(white[c] * r["whitened"]))
                assert abs(sign * r["whitened"] - white[c]) < 1e-6
            else:
                assert abs(r["whitened"]) < 2e-3


def vectors(n, d, seed, rank=None):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n, rank or d)) * np.geomspace(3, 0.2, rank or d)
    return (base @ np.linalg.qr(rnd.standard_normal((d, rank or d)))[0].T if rank is None else base @ rnd.standard_normal((rank, d))).astype(np.float32).tolist()


SCHEMA = "vec_id long, embedding array<float>, component int, n string"


@pytest.mark.parametrize("n, d", [(300, 64), (40, 3), (60, 90), (5, 1)])
def test_rows_equal_the_dense_ones(saved, n, d):
    rows = list(enumerate(vectors(n, d, d)))
    rows += [(1000 + k, v) for k, v in rows[: n // 3]]  # copies count once in the fit
    held(whitening.whiten(saved([(k, v, 1, "x") for k, v in rows], SCHEMA)), brute(rows))


def test_unusable_rows_ties_and_empty_tables(saved):
    rows = list(enumerate(vectors(50, 4, 1)))
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [0.0, float("-inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0])]
    found = whitening.whiten(saved([(k, v, 1, "x") for k, v in rows + odd] + [(7, rows[7][1], 1, "x"), (None, rows[8][1], 1, "x")], SCHEMA))
    assert found.columns == ["vec_id", *whitening.RESULT]
    held(found, brute(rows + [(7, rows[7][1]), (None, rows[8][1])]))
    for few in ([], [(1, [1.0, 2.0], 1, "x")] * 3, [(1, None, 1, "x")]):
        assert whitening.whiten(saved(few, SCHEMA)).count() == 0


def test_zero_components_are_left_out_and_far_values_stay_exact(saved):
    low = vectors(80, 12, 2, rank=3)
    small = [[float(round(c * 64)) / 64 for c in v] for v in low]
    flat = [(k, v[:2] + [v[0] + v[1]] * 3) for k, v in enumerate(small)]
    found = whitening.whiten(saved([(k, v, 1, "x") for k, v in flat], SCHEMA))
    assert found.agg(F.max("component")).first()[0] == 2
    held(found, brute(flat))
    far = [(k, [float(np.float32(1e12 + 1e8 * a)), float(b)]) for k, (a, b) in enumerate(np.random.default_rng(3).standard_normal((30, 2)))]
    want = brute(far)
    for r in whitening.whiten(saved([(k, v, 1, "x") for k, v in far], SCHEMA)).collect():
        assert r["deviation"] == (want[r["vec_id"]][0][1] if want[r["vec_id"]][0][1] < 1 << 63 else None)


def test_rounds_reach_rounding_where_the_block_does_not_span_the_space():
    rnd = np.random.default_rng(0)
    u = np.linalg.qr(rnd.standard_normal((400, 400)))[0]
    e = np.sort(np.r_[np.linspace(9, 3, 30), rnd.uniform(0.01, 3, 370)])[::-1]
    a, passes = u * e @ u.T, []

    def times(q):
        passes.append(q.shape[1])
        return a @ q

    values, x, error = whitening.lobpcg(times, 400, 16)
    assert error < 1e-12 and np.abs(values / e[:16] - 1).max() < 1e-12
    assert np.abs(np.abs((x * u[:, :16]).sum(axis=0)) - 1).max() < 1e-12
    assert len(passes) < 150 and max(passes) <= 48
