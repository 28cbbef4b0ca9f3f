"""Groups of likeness 0.8 against all pairs of sets."""

import random

import numpy as np

import corpus_pipeline
from ticketflow.llm import likeness, simhash

from .helpers import documents, groups


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def firsts(texts):
    sets = [plain(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    return sorted(set(groups(pairs, range(len(sets))).values())), pairs, sets


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(60, 400))
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # edits spread over the text; each breaks five runs
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
        cut = len(base) // 8
        texts += [" ".join(base[cut:]), " ".join(base + rng.choices(words, k=cut)), " ".join(base[:len(base) // 2])]
    rng.shuffle(texts)
    return texts + ["", None, "   ", "one two", "One  two", "one three"]


def test_near_copies_of_the_stage(spark, sf):
    texts = corpus()
    wanted, pairs, sets = firsts(texts)
    far = [p for p in pairs if sets[p[0]] != sets[p[1]] and (simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])).bit_count() > 2]
    assert len(far) > 50  # the radius of op8 would leave these
    kept = corpus_pipeline.keep_first_of_near_copies(spark, documents(spark, texts), sf).collect()
    assert sorted(r["doc_id"] for r in kept) == wanted


def test_a_large_group_and_no_rows(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i % 200] + [f"x{rng.random()}"] + base[i % 200:]) for i in range(1200)]
    assert [r["doc_id"] for r in likeness.first_of_alike(documents(spark, texts)).collect()] == [0]
    assert likeness.first_of_alike(documents(spark, [])).count() == 0


def test_ids_of_the_kept_rows(spark):
    docs = documents(spark, [(None, "same text here"), (4, "same text here"), (3, "same text here"), (3, "same text here"), (None, "alone it is")])
    assert sorted(map(str, (r["doc_id"] for r in likeness.first_of_alike(docs).collect()))) == ["3", "None"]


def test_alike_classes_under_a_key_of_unlike_ones(spark, monkeypatch):
    """No leader of the key is like the pairs that are alike; they are found in one block of the key and across several."""
    rng = random.Random(5)
    common = list(range(100))  # all share these, which is not enough
    sets = [sorted(common + rng.sample(range(1000, 10 ** 6), 100)) for _ in range(60)]
    for i in (50, 52, 54):
        sets[i + 1] = sorted(sets[i][:-10] + rng.sample(range(1000, 10 ** 6), 10))
    held = spark.createDataFrame(list(enumerate(sets)), "cls long, runs array<int>")
    placed = spark.createDataFrame([(7, i, 200) for i in range(60)] + [(8, 50, 200), (8, 3, 200)], "key long, cls long, n int")
    for size in (likeness.BLOCK, 9):
        monkeypatch.setattr(likeness, "BLOCK", size)
        assert {(r["node"], r["root"]) for r in likeness.groups(placed, held).collect()} == {(i + d, i) for i in (50, 52, 54) for d in (0, 1)}
    assert likeness.groups(placed.where("cls < 50"), held) is None


def test_links_join_different_groups_only():
    cls, sets = np.array([5, 6, 7, 8]), [np.arange(20), np.arange(1, 20), np.arange(2, 20), np.arange(100, 120)]
    assert likeness.linked(cls, cls, np.zeros(4, int), sets) == [(5, 6), (5, 7)]
    assert likeness.linked(cls, np.array([5, 5, 7, 8]), np.zeros(4, int), sets) == [(5, 7)]
    assert likeness.linked(cls, cls, np.array([0, 0, 1, 1]), sets) == [(5, 7), (6, 7)]


def test_components_are_sought_again_only_for_links_of_the_second_round(spark, monkeypatch):
    """Links known beforehand and those of leaders go through one search; they used to take three."""
    calls, seek = [], likeness.components
    monkeypatch.setattr(likeness, "components", lambda edges: calls.append(1) or seek(edges))
    held = spark.createDataFrame([(i, list(range(i, i + 100))) for i in (1, 3, 900, 902, 5000)], "cls long, runs array<int>")
    placed = spark.createDataFrame([(1, 1, 100), (1, 3, 100), (2, 900, 100), (2, 902, 100)], "key long, cls long, n int")
    known = spark.createDataFrame([(3, 900), (5000, 5000)], "a long, b long")
    found = likeness.groups(placed, held, known)
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 1) for i in (1, 3, 900, 902)} and len(calls) == 1
    placed = placed.union(spark.createDataFrame([(3, 1, 100), (3, 5000, 100), (3, 5001, 100)], placed.schema))
    held = held.union(spark.createDataFrame([(5001, list(range(5001, 5101)))], held.schema))
    assert {(r["node"], r["root"]) for r in likeness.groups(placed, held, known).collect()} == {(1, 1), (3, 1), (900, 1), (902, 1), (5000, 5000), (5001, 5000)}
    assert len(calls) == 3
