"""SimHash groups against a brute-force comparison of all fingerprints."""

import random
import re

import numpy as np
import xxhash

from ticketflow.llm import simhash
from ticketflow.llm.common import components, table

from .helpers import documents, groups


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def check(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == prints
    ids = sorted(prints)
    words = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(i, ids[j]) for n, i in enumerate(ids) for j in np.flatnonzero(np.bitwise_count(words[n] ^ words) <= 2)]
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups(pairs, ids)
    return rows


def test_all_documents_of_a_table(spark, sf):
    rows = check(spark, table(spark, sf, "documents"))
    assert len({r["component_id"] for r in rows}) < len(rows)


def test_odd_texts(spark):
    word = "word " * 3
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "ONE", "one two", "one two three", "one two", "É a b", "é a b",
             word * 5000, word * 5000, "\x1c a", "x" * 100_000]
    rows = check(spark, documents(spark, texts))
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fp"] == by[1]["fp"] == by[2]["fp"] == 0 and by[2]["component_id"] == 0


def test_chains_of_two_bits_and_ties(spark):
    rng = random.Random(3)
    words = {rng.getrandbits(64) for _ in range(200)}
    for w in list(words):
        for _ in range(4):
            w ^= 1 << rng.randrange(64)
            w ^= 1 << rng.randrange(64)
            words.add(w)
    fps = sorted(simhash._signed(w) for w in words)
    df = spark.createDataFrame([(w,) for w in fps], "fp long")
    n, both = simhash.bit_statistics(df)
    plan = simhash.allocate(n, both)
    assert sum(t + 1 for _, t in plan) == 3
    edges = simhash.links(simhash.candidates(df, plan))
    arr = np.array(fps, np.int64).view(np.uint64)
    pairs = [(w, fps[j]) for i, w in enumerate(fps) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr) <= 2) if j != i]
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    wanted = groups(pairs, fps)
    assert {n: r for n, r in wanted.items() if n in found} == found
    assert all(wanted[n] == n for n in fps if n not in found)


def test_thresholds_follow_the_bits(spark):
    """Bits that are nearly constant make a partition useless, so another one is probed wider."""
    rng = np.random.default_rng(0)
    bits = rng.random((4000, 64)) < np.where(np.arange(64) < 32, 0.001, 0.5)
    both = bits.T.astype(float) @ bits
    plan = simhash.allocate(10 ** 9, both * (10 ** 9 / 4000))
    assert sum(t + 1 for _, t in plan) == 3 and max(t for _, t in plan) >= 1


def test_no_rows(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 600)] + [(3, 3), (600, 139), (None, 4)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] is not None and p[0] != p[1]}
    assert found == groups([p for p in pairs if p[0] is not None and p[0] != p[1]], nodes)
