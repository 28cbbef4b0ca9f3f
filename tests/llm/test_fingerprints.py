"""Fingerprints: edits by hand, and collision rates against the generalised Jaccard similarity."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ticketflow.llm import fingerprints as fp
from ticketflow.llm.common import table

from .helpers import collected, documents, saved


def edited(pairs):
    """doc_id -> (length, edited text, next doc_id)"""
    order = sorted(pairs, reverse=True)
    out = {}
    for i, doc in enumerate(order):
        after = order[(i + 1) % len(order)]
        text, n = pairs[doc] or "", len(pairs[doc] or "") // 3
        out[doc] = (len(text), text[:len(text) - n] + (pairs[after] or "")[:n], after)
    return out


def check(spark, folder, pairs):
    rows = {r["doc_id"]: r for r in fp.op4(spark, folder).collect()}
    wanted = edited(pairs)
    assert set(rows) == set(wanted)
    for doc, (n, text, after) in wanted.items():
        r = rows[doc]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        places = [[f[i:i + 8] for i in range(0, len(f), 8)] for f in (r["fingerprint"], r["edited_fingerprint"], rows[after]["fingerprint"])]
        assert r["near_edited"] == np.mean([a == b for a, b in zip(places[0], places[1])])
        assert r["near_next"] == np.mean([a == b for a, b in zip(places[0], places[2])])
    return rows


def test_all_documents_of_a_table(spark, sf):
    pairs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = check(spark, sf, pairs)
    by_text = {}
    for doc, text in pairs.items():
        assert by_text.setdefault(text, rows[doc]["fingerprint"]) == rows[doc]["fingerprint"]
    wanted = [jaccard(pairs[d], edited(pairs)[d][1]) for d in rows]
    assert abs(np.mean([r["near_edited"] for r in rows.values()]) - np.mean(wanted)) < 0.03
    assert np.mean([r["near_next"] for r in rows.values()]) < 0.1


def test_odd_texts(spark, tmp_path):
    texts = [None, "", "a", "é🙂" * 10, "one two", "\n lead", "same same same same same same", "x y " * 30_000, "long " * 9, "long " * 9]
    folder = saved(spark, documents(spark, texts), tmp_path, "documents")
    check(spark, folder, dict(enumerate(texts)))
    folder = saved(spark, documents(spark, [(5, "only one")]), tmp_path / "one", "documents")
    row = check(spark, folder, {5: "only one"})[5]
    assert row["near_next"] == 1.0
    folder = saved(spark, documents(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c")]), tmp_path / "odd", "documents")
    assert [r[0] for r in collected(fp.op4(spark, folder), "doc_id")] == [None, 1, 1]
    folder = saved(spark, documents(spark, []), tmp_path / "none", "documents")
    assert fp.op4(spark, folder).count() == 0


def counts(text, words=5):
    w = text.lower().split()
    return Counter(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else Counter([tuple(w)])


def jaccard(one, two):
    a, b = counts(one or ""), counts(two or "")
    return sum((a & b).values()) / sum((a | b).values())


def test_terms_and_their_weights(spark):
    texts = ["a b c d e a b c d e a b c d e f", "A  b\tC d e", "a b", "", "\u000ba b c d e\n"]
    rows = fp.terms(documents(spark, texts).select("doc_id", F.col("text").alias("content"))).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], {})[r["_s"]] = r["_w"]
    for i, t in enumerate(texts):
        assert sorted(found[i].values()) == sorted(counts(t).values()), t
    assert found[1].keys() == found[4].keys() and found[1].keys() < found[0].keys()


def test_places_agree_as_often_as_weights_overlap(spark):
    """Long fingerprints of weighted texts: the share of equal places is the generalised Jaccard similarity."""
    rng = random.Random(1)
    blocks = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(5)) for _ in range(60)]
    pairs = []
    for case in range(6):
        one = {b: rng.randint(1, 12) for b in blocks[:40]}
        two = {b: max(1, w + rng.randint(-3, 3)) for b, w in one.items() if rng.random() < 1 - case / 8} | {b: 4 for b in blocks[40:40 + 3 * case]}
        pairs.append((one, two))
    texts = [(10 * i + j, "".join(f"{b} {b} " * 0 + f"{b} " for b, w in side.items() for _ in range(w)))
             for i, p in enumerate(pairs) for j, side in enumerate(p)]
    places = 96
    docs = documents(spark, texts).select("doc_id", F.col("text").alias("content"))
    each = fp.terms(docs)
    low = each.groupBy("doc_id").agg(*[F.max(fp.sample(k, F.col("_s"), F.col("_w"), F.xxhash64("_s", F.lit(0).cast("long")))).alias(f"p{k}") for k in range(places)])
    rows = {r["doc_id"]: np.array(r[1:]) & fp.LOW for r in low.collect()}
    texts, off = dict(texts), []
    for i in range(len(pairs)):
        share = (rows[10 * i] == rows[10 * i + 1]).mean()
        assert abs(share - jaccard(texts[10 * i], texts[10 * i + 1])) < 0.2, (i, share)
        off.append(share - jaccard(texts[10 * i], texts[10 * i + 1]))
    assert abs(np.mean(off)) < 0.06


def test_no_python_in_the_plan(spark, sf):
    text = fp.op4(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Cartesian" not in text and "NestedLoop" not in text
