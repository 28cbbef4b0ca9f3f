"""Links of vectors against all pairs, and the share of links found."""

import numpy as np
import pytest

from ticketflow.llm import embeddings
from ticketflow.llm.common import table

from .helpers import collected, groups

SCHEMA = "vec_id long, embedding array<float>, label int, v int, n_links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, 0) for i, v, lab in rows], SCHEMA)


def brute(rows, threshold=0.98):
    """vec_id -> (links, smallest reachable id), over all pairs."""
    good = {}
    for i, v, lab in rows:
        a = np.array([np.nan if c is None else c for c in v or []], np.float32).astype(np.float64)
        if lab is not None and len(a) and np.isfinite(a).all() and a.any():
            good[i] = (lab, a / np.linalg.norm(a))
    ids, edges, links = sorted(good), [], dict.fromkeys([r[0] for r in rows], 0)
    for lab in {good[i][0] for i in ids}:
        own = [i for i in ids if good[i][0] == lab]
        x = np.array([good[i][1] for i in own])
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        edges += [(own[p], own[q]) for p, q in zip(a, b)]
    for p, q in edges:
        links[p] += 1
        links[q] += 1
    roots = groups(edges, [r[0] for r in rows])
    return {i: (links[i], roots[i], roots[i] == i) for i in links}


def test_a_table(spark, sf):
    given = table(spark, sf, "embeddings")
    wanted = brute([(r["vec_id"], r["embedding"], r["label"]) for r in given.collect()])
    found = {r[0]: r[1:] for r in collected(embeddings.op9(spark, sf), "vec_id")}
    assert found.keys() == wanted.keys()
    n, m = sum(v[0] for v in wanted.values()), sum(v[0] for v in found.values())
    assert all(found[i][0] <= wanted[i][0] for i in wanted) and m >= 0.95 * n


@pytest.mark.parametrize("dim", [64, 3, 100])
def test_groups_blocks_and_copies(spark, dim):
    """Noise, exact copies and one large group of near copies, cut into several blocks."""
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).tolist(), i % 3) for i in range(200)]
    center = rng.normal(size=dim)
    rows += [(1000 + i, (center * rng.uniform(0.5, 2) + rng.normal(size=dim) * 0.03).tolist(), 0) for i in range(150)]
    rows += [(2000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(60)]
    found = {r[0]: r[1:] for r in collected(embeddings.near_vectors(frame(spark, rows), block=16), "vec_id")}
    wanted = brute(rows)
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(f[0] for f in found.values()) >= 0.97 * sum(w[0] for w in wanted.values())
    same = [i for i in wanted if found[i] == wanted[i]]
    assert len(same) >= 0.9 * len(wanted)
    assert all(found[2000 + i][0] >= 1 and found[2000 + i][1] == found[i % 7][1] for i in range(60))


def test_share_of_links_at_the_threshold():
    rng = np.random.default_rng(2)
    x = embeddings.unit(rng.normal(size=(4000, 64)))
    away = rng.normal(size=x.shape)
    away = embeddings.unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * away
    a, b = embeddings.buckets(x), embeddings.buckets(y)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() > 0.95, met.mean()


def test_turns_keep_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(embeddings.hadamard(x) @ embeddings.hadamard(x).T, 32 * x @ x.T)


def test_what_links_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, None, 1), (3, [], 1), (4, [0.0, -0.0, 0.0], 1), (5, [1.0, None, 3.0], 1), (6, [float("nan"), 2.0, 3.0], 1),
            (7, [float("inf"), 2.0, 3.0], 1), (8, one, None), (9, one, 2), (10, [1.0, 2.0], 1), (11, [2.0, 4.0, 6.0], 1), (11, [2.0, 4.0, 6.0], 1),
            (12, [1e-30, 2e-30, 3e-30], 1), (13, [-1.0, -2.0, -3.0], 1), (14, [1e38, 2e38, 3e38], 1), (None, one, 1)]
    out = collected(embeddings.near_vectors(frame(spark, rows)), "vec_id")
    assert out[0] == (None, 0, None, None)
    assert [r for r in out if r[0] == 1] == [(1, 3, 1, True)]
    assert [r for r in out if r[0] == 11] == [(11, 3, 1, False)] * 2
    assert {r[0] for r in out if r[1]} == {1, 11, 12, 14}
    assert all(r[2] == r[0] and r[3] for r in out if r[0] and not r[1])
    assert embeddings.near_vectors(frame(spark, [])).count() == 0
