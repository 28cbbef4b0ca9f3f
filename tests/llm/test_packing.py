"""Packing of token ids: against the tokenizer itself, and against best-fit decreasing one by one."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ticketflow.llm import bestfit, binpack, tokens
from ticketflow.llm.common import table

from .helpers import collected, documents

ODD = [None, "", " ", "  two  spaces ", "a \n b\n\n c\t d   e f \x1c g", "it's <|endoftext|> 's  's", "é" * 3000,
       "word " * 4000, "x" * 20_000, "a\n b \n", " lead", "tail ", "\x85 \x85a \x85", "日本 語 テキスト", "1 22 333 4!!  !! \r\n x"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ranks_give_the_ids_of_the_file(tokenizer):
    encoder, rng = tokens.ByteBpe(tokens.vocabulary()), random.Random(1)
    texts = [t or "" for t in ODD] + [" " * 1_000_000 + "x"] + ["".join(rng.choice(" \n\t'sa!9é\x1c\x85　") for _ in range(rng.randrange(60)))
                                      for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def one_by_one(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_as_few_sequences_as_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.choice([rng.randint(1, 64), rng.paretovariate(1), 7]))) for _ in range(700)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    ranges = bestfit.superstep_ranges(counts, 64)
    used: dict[int, list] = {}
    for length, a, b, seq, off in ranges:
        for r in range(a, b + 1):
            used.setdefault(seq + r - a, []).append((off, length))
    for parts in used.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 64
    assert sum(map(len, used.values())) == 700
    assert len(used) == one_by_one(lengths, 64) == len(binpack.best_fit_decreasing(lengths, 64))


def check(rows, docs, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    places, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids = ids_of(tokenizer, texts[doc])
        at = 0
        for i, (piece, start, length, crc) in enumerate(sorted(found)):
            assert (piece, start) == (i, at) and 1 <= length <= 1024 and (i == 0 or length == 1024)
            assert crc == zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes())
            at += length
        assert at == len(ids) and len(found) == -(-len(ids) // 1024)
    for parts in places.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 1024
    assert len(places) == one_by_one([p[2] for f in pieces.values() for p in f], 1024)


def test_packing_of_a_table(spark, sf, tokenizer):
    docs = table(spark, sf, "documents")
    check(bestfit.op5(spark, sf).collect(), docs, tokenizer)


def test_packing_of_odd_texts(spark, tokenizer):
    docs = documents(spark, ODD + ["same text"] * 40)
    check(bestfit.pack(bestfit.token_pieces(docs)).collect(), docs, tokenizer)
    none = documents(spark, [])
    assert bestfit.pack(bestfit.token_pieces(none)).count() == 0


def test_rows_without_a_place_and_repeated_rows(spark):
    rows = [(1, 0, 5), (1, 0, 5), (2, 0, 0), (3, 0, None), (4, 0, 11), (None, 0, 10), (5, 0, -3), (6, 0, 4)]
    out = collected(bestfit.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 10), "doc_id", "offset")
    placed = [(r[3], r[4], r[2]) for r in out if r[3] is not None]
    assert len(placed) == 4 and {r[0] for r in out if r[3] is None} == {2, 3, 4, 5}
    assert len({p[:2] for p in placed}) == 4


def test_matrix_gives_back_all_ids(spark, tokenizer):
    docs = documents(spark, ODD + ["same text"] * 40)
    packed = binpack.pack_matrix(docs, block=5000)
    rows = packed.collect()
    for r in rows:
        ends, positions = np.frombuffer(r["cu_seqlens"], "<i4"), np.frombuffer(r["positions"], "<u2")
        assert len(r["ids"]) == 2048 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 1024
        assert positions.tolist() == [i for n in np.diff(ends) for i in range(n)] + [0] * (1024 - r["n_tokens"])
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    parts = {}
    for r in binpack.unpack(packed).collect():
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for r in docs.collect():
        ids = b"".join(p[2] for p in sorted(parts[r["doc_id"]]))
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, r["text"])
    assert binpack.pack_matrix(documents(spark, [])).count() == 0


def test_written_matrix(spark, tmp_path):
    docs = documents(spark, ["a b c", "d"])
    binpack.write(binpack.pack_matrix(docs), f"{tmp_path}/matrix")
    assert binpack.unpack(spark.read.parquet(f"{tmp_path}/matrix")).count() == 2


def test_ids_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="do not fit"):
        binpack.pack_matrix(documents(spark, ["many words of a text"]), dtype="<u1").collect()
