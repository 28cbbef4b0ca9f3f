import math

import numpy as np
import pytest

from ticketflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, dim int, x string, i int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["random", "clustered", "repeated", "low rank", "identity", "two"])
def test_components_against_a_library(kind):
    draw = np.random.default_rng(3)
    n = 2 if kind == "two" else 40
    q, _ = np.linalg.qr(draw.standard_normal((n, n)))
    e = {"random": draw.uniform(0, 10, n), "clustered": np.r_[5, 5 + 1e-9, 5 + 1e-6, draw.uniform(0, 1, n - 3)],
         "repeated": np.r_[[7.0] * 5, [2.0] * (n - 5)], "low rank": np.r_[[3.0, 2.0], np.zeros(n - 2)],
         "identity": np.ones(n), "two": np.array([1.0, 4.0])}[kind] if kind != "two" else np.array([1.0, 4.0])
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    values, w = W.components(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(values, want, rtol=0, atol=1e-12 * max(1, want[0]))
    assert np.allclose(w.T @ w, np.eye(len(values)), atol=1e-12)
    assert np.abs(v @ w - w * values).max() < 1e-12 * max(1, want[0])


def test_polar_factor_is_the_sign():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))
    e = np.r_[np.linspace(-1, -1e-9, 15), np.linspace(1e-6, 3, 15)]
    assert np.allclose(W.polar_factor((q * e) @ q.T), (q * np.sign(e)) @ q.T, atol=1e-6)


def brute(rows, k=4):
    x = {i: [math.floor(256 * c) for c in v] for i, v in enumerate(v for _, v in rows)}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(s) / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    return n, s, x, e[::-1][:k], w[:, ::-1][:, :k], np.trace(v)


def check(rows, out):
    n, s, x, e, w, total = brute(rows)
    by = {(r.vec_id, r.component): r for r in out}
    assert len(out) == len(rows) * len(e)
    signs = None
    for at, (i, _) in enumerate(rows):
        z = (np.array(x[at], float) - np.array(s) / n) @ w / np.sqrt(e)
        got = np.array([by[i, c + 1].whitened for c in range(len(e))])
        if signs is None and np.abs(z).min() > 1e-6:
            signs = np.sign(z * got)
        if signs is not None:
            assert np.allclose(got, z * signs, atol=1e-8)
        for c in range(len(e)):
            r = by[i, c + 1]
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[at], s))
            assert abs(r.explained - e[c] / total) <= 1e-9 * r.explained and r.identity_error < 1e-9


def test_query_against_brute_force(spark, sf):
    out = W.op13(spark, sf).collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, out)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(0)
    good = [(i, draw.normal(size=6).tolist()) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [nan] + [1.0] * 5), (103, [inf] + [1.0] * 5), (104, [])]
    again = [(200, good[3][1]), (200, [-0.0] * 6), (None, good[4][1])]
    out = W.whiten(vectors(spark, good + odd + again)).collect()
    assert {r.vec_id for r in out} == {*range(30), 200, None}
    assert {r.n for r in out} == {31} and len(out) == 33 * 4  # copies count once in the fit, and keep their rows
    check(good + [(300, [0.0] * 6)], W.whiten(vectors(spark, good + [(300, [0.0] * 6)])).collect())


def test_nothing_varies_few_entries_and_lengths(spark):
    out = W.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(out)] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    out = W.whiten(vectors(spark, [(1, [1.0]), (2, [3.0]), (3, [1.0, 0.0]), (4, [3.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in out) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    assert all(r.whitened is None for r in out if (r.vec_id, r.component) in {(3, 2), (4, 2)})
    assert {abs(r.whitened) for r in out if r.component == 1} == {1.0}
    assert W.whiten(vectors(spark, [])).collect() == []


def test_beyond_long(spark):
    out = W.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]), 1).collect()
    assert len(out) == 3 and all(r.deviation is None for r in out if r.vec_id < 3)
