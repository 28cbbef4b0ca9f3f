import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ticketflow.llm import search as S

from .helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(docs, items, top=S.TOP):
    """``(item_id, rank, doc_id, score)`` by scoring every document for every item."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
                        for w in set(words(text)) if c[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return out


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "item_id long, text string, doc_id string, term int")


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(S.op11(spark, sf)) == sorted(brute(docs, items), key=str)


def test_odd_texts_ties_and_repeated_rows(spark):
    docs = [(5, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (None, "ALPHA-beta"), (9, None), (8, ""), (7, "..."), (6, "ÉTÉ été alpha"),
            (4, "gamma " * 30_000), (2, "alpha_alpha İ K k"), (-1, "beta\x00alpha"), (10, "delta"), (11, "epsilon")]
    items = [(1, "Alpha alpha BETA"), (1, "été"), (2, None), (3, ""), (4, "unknown words"), (None, "k gamma"), (5, "É")]
    assert got(S.search(documents(spark, docs), benchmark(spark, items))) == sorted(brute(docs, items), key=str)
    for top in (1, 2, 3):
        assert got(S.search(documents(spark, docs), benchmark(spark, items), top)) == sorted(brute(docs, items, top), key=str)


def test_no_rows(spark):
    some, none = documents(spark, ["alpha"]), documents(spark, [])
    items = benchmark(spark, [(1, "alpha")])
    assert got(S.search(none, items)) == got(S.search(some, benchmark(spark, []))) == got(S.search(documents(spark, [None, "-"]), items)) == []


def test_a_term_in_every_document_and_several_waves(spark, monkeypatch):
    draw = random.Random(1)
    docs = [(i, "the " * (1 + i % 3) + " ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(20))) for i in range(900)]
    items = [(i, "the " + docs[37 * i % 900][1]) for i in range(40)]
    monkeypatch.setattr(S, "WAVE", 24)
    monkeypatch.setattr(S, "ITEMS", 10)
    assert got(S.search(documents(spark, docs), benchmark(spark, items), 5)) == sorted(brute(docs, items, 5), key=str)


@pytest.mark.parametrize("weight", [1, 5000, 10 ** 9])
def test_a_block_is_searched_exactly_and_partly_left(weight):
    """One block against all products; the largest weight needs 64-bit sums instead of doubles."""
    draw = np.random.default_rng(weight)
    terms = [f"t{i}".encode() for i in range(400)]
    docs = [sorted((50 * (d // 32) + draw.choice(50, 20, replace=False)).tolist()) for d in range(250)]  # leaves have terms of their own
    shares = draw.integers(1, 1000, 250 * 20)
    shares[:40] = 900_000  # two documents stand out
    tops = np.zeros(400, np.int64)
    np.maximum.at(tops, np.concatenate(docs), shares)
    items = [(50 * (i // 13) + draw.choice(50, 8, replace=False)).tolist() for i in range(100)]
    tree = S.ItemTree(list(range(100)), [[terms[t] for t in i] for i in items], [[weight] * 8 for _ in items])
    assert tree.kind is (np.int64 if weight == 10 ** 9 else np.float64)
    exact = np.array([[weight * sum(int(shares[20 * d + docs[d].index(t)]) for t in i if t in docs[d]) for d in range(250)] for i in items])
    want = {i: sorted((-int(exact[i, d]), d) for d in range(250) if exact[i, d])[:2] for i in range(100)}
    best = S.Best(100, 2, np.zeros(100, np.int64))
    args = (list(range(250)), terms, tops, np.arange(0, 5001, 20), np.concatenate(docs), shares)
    assert S.searched(tree, best, *args) <= 100 * 250
    best.settle()
    found = {i: sorted((-int(s), int(d)) for j, s, d in zip(best.kept[0], best.kept[1], best.kept[3]) if j == i) for i in range(100)}
    assert found == want
    floor = best.least
    again = S.Best(100, 2, floor)
    assert S.searched(tree, again, *args) < 100 * 250 / 2  # bounds leave most pairs
    again.settle()
    for i in range(100):  # what reaches the floor is found again
        mine = sorted((-int(s), int(d)) for j, s, d in zip(again.kept[0], again.kept[1], again.kept[3]) if j == i)
        assert mine == [x for x in want[i] if -x[0] >= floor[i]]
