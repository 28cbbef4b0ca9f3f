"""Repeated passages against a table of all strings, and the suffix order against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from ticketflow.llm import suffixes
from ticketflow.llm.common import table

from .helpers import documents


def brute(pairs, length):
    """(doc_id, kept bytes, spans) for each (doc_id, text), sorted."""
    data = [(suffixes.LAST if i is None else i, (t or "").encode()) for i, t in pairs]
    least = {}
    for i, d in data:
        for p in range(len(d) - length + 1):
            s = d[p:p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for (own, _), (i, d) in zip(pairs, data):
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if least[d[p:p + length]] < i:
                gone[p:p + length] = [True] * length
        spans = [(p, next((q for q in range(p, len(d)) if not gone[q]), len(d))) for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((own, bytes(b for b, g in zip(d, gone) if not g), spans))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r["doc_id"], bytes(r["kept"]), [tuple(s) for s in r["removed"]]) for r in df.collect()], key=repr)


def test_all_documents_of_a_table(spark, sf):
    pairs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    wanted = {i: (len(kept) + sum(b - a for a, b in spans), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
              for i, kept, spans in brute(pairs, 50)}
    rows = suffixes.op1(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == wanted
    assert len(rows) == len(pairs) and sum(w[1] for w in wanted.values()) > 0


@pytest.mark.parametrize("seed, length, anchor", [(1, 8, 3), (2, 6, 4), (3, 12, 12), (4, 9, 1)])
def test_random_texts_of_few_letters(spark, seed, length, anchor):
    rng = random.Random(seed)
    letters = ["ab", "abc", "aé\x00", "xyz "][seed % 4]
    pairs = [(rng.randrange(-40, 40), "".join(rng.choices(letters, k=rng.choice([0, 3, 8, 20, 60])))) for _ in range(70)]
    line = "".join(rng.choices(letters, k=15))
    pairs += [(100 + i, "".join(rng.choices(letters, k=rng.randrange(9))) + line + "".join(rng.choices(letters, k=9))) for i in range(25)]
    pairs += [(None, pairs[3][1]), (None, pairs[60][1]), (None, None), (7, ""), *pairs[:9]]
    df = suffixes.without_repeats(documents(spark, pairs), length, anchor)
    assert found(df) == brute(pairs, length)


def test_texts_over_the_border_of_a_chunk(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh ", k=700_000))
    pairs = [(1, base), (2, base[5:600_000] + "!" + base[600_000:]), (3, base[:49]), (4, base[100:150]), (5, "new " + base[524_200:524_400])]
    out = {r[0]: r for r in found(suffixes.without_repeats(documents(spark, pairs)))}
    assert out[1][2] == [] and out[2][1] == b"!" and out[3][2] == [] and out[4][1] == b"" and out[5][1] == b"new "


def test_characters_stay_whole(spark):
    shared = "é" * 30
    docs = documents(spark, [(1, "a" + shared + "ü"), (2, "b" + shared + "ö")])  # the last bytes differ in their second half only
    plain, whole = (found(suffixes.without_repeats(docs, characters=c)) for c in (False, True))
    assert plain[1][2] == [(1, 62)] and whole[1][2] == [(1, 61)] and whole[1][1].decode() == "bö"


def test_all_columns_stay_and_no_rows(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    out = suffixes.without_repeats(docs)
    assert out.columns == [*docs.columns, "kept", "removed"] and out.drop("kept", "removed").dtypes == docs.dtypes
    assert sorted(map(repr, out.drop("kept", "removed").collect())) == sorted(map(repr, docs.collect()))
    assert suffixes.without_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [3, 40])
def test_rows_do_not_grow_with_partitions(spark, sf, partitions, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 1 << 16)
    docs = table(spark, sf, "documents").repartition(partitions).selectExpr("doc_id _key", "xxhash64(text) & 4294967295 _tag", "cast(text AS binary) _data")
    rows = suffixes.decided(suffixes.sent_segments(docs, 16, 50, 18))
    at = rows.where(rows.kind == suffixes.COVERED).selectExpr("doc", "explode(sequence(at, at + n - 1)) p").distinct().count()
    assert rows.where(rows.kind == suffixes.COVERED).count() <= at and at > 0


def test_many_texts_around_one_anchor(spark):
    rng = random.Random(3)
    line = "a line of eighteen or more bytes in all texts"
    pairs = [(i, "".join(rng.choices("abcdefgh", k=60)) + line + "".join(rng.choices("abcdefgh", k=60))) for i in range(600)]
    pairs += [(1000 + i, pairs[i][1][40:120]) for i in range(0, 600, 7)]
    df = suffixes.without_repeats(documents(spark, pairs).repartition(30))
    assert found(df) == brute(pairs, 50)


def test_segments_without_a_common_side_share_no_window():
    rng = random.Random(4)
    anchor = b"0123456789abcdefgh"
    texts = [bytes(rng.choices(b"xyzuvw", k=32)) + anchor + bytes(rng.choices(b"xyzuvw", k=32)) for _ in range(40)]
    texts += [texts[0][:66] + b"!" * 16, b"?" * 16 + texts[1][16:], texts[2][:65] + b"!" * 17]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.full(len(texts), 82)
    begin = np.cumsum(size) - size
    start, n, h, _ = suffixes.segments(np.frombuffer(anchor + bytes(32), np.uint8), np.r_[True, np.zeros(49, bool)], 18, 18)
    keep = suffixes.sided(data, begin, size, np.repeat(h, len(texts)), 50, 18)
    assert set(np.flatnonzero(keep)) == {0, 1, 2, 40, 41, 42}


@pytest.mark.parametrize("seed", range(8))
def test_common_prefixes_by_increasing_value(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(1, 3 + seed % 3, rng.integers(1, 40)).astype(np.int16) for _ in range(12)]
    strings += strings[:4]
    text = np.concatenate([np.r_[s, 0] for s in strings]).astype(np.int16)
    depth = [1, 2, 5, 9][seed % 4]
    order = suffixes.suffix_array(text, depth)
    padded = np.r_[text, np.zeros(70, np.int16)]
    prefix = [tuple(padded[i:i + depth]) for i in order]
    assert prefix == sorted(prefix)
    ends = suffixes.common_prefix_ends(text[order - 1], depth)
    for p in range(1, len(text)):
        if 0 not in prefix[p - 1] or 0 not in prefix[p]:  # prefixes that cross an end are of no use
            assert ends[p] == (prefix[p] != prefix[p - 1]), p
