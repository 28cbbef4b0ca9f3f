"""Segmentation against the library with the same pieces and scores, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from ticketflow.llm import pieces
from ticketflow.llm.common import table
from ticketflow.llm.tokens import vocabulary

from .helpers import collected, documents

FILE = "piece_bpe_32k.model"
ODD = ["", " ", "a", "  two  blanks ", "tab\tand\nline\r\n", "▁mark▁ ▁", "日本語 テキスト 🙂🙂", "é", "x" * 3000, "\x00\x1c",
       " " * 50, " " * 20 + "word", "naïve café", "1234567890", "<unk> <s> </s> <0x41>", "� ͸"]


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(vocabulary(FILE))


@pytest.fixture(scope="module")
def library():
    """The same vocabulary searched by the library itself for the highest sum of scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary(FILE), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # unigram: no training, pieces and scores stay
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def brute(own, word):
    """Best segmentation of one word over all ways, as (score, last pieces longest first)."""
    ways = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            found = own.ids.get(word[start:end].replace(" ", pieces.MARK))
            if found and word[start:end].replace(pieces.MARK, "") == word[start:end]:
                score = ways[start][0] + found[0]
                if ways[end] is None or score > ways[end][0]:
                    ways[end] = (score, [*ways[start][1], found[1]])
        if ways[end] is None:
            ways[end] = (ways[end - 1][0] + own.unknown, [*ways[end - 1][1], *[own.byte[b] for b in word[end - 1].encode()]])
    return ways[-1][1]


def test_words_as_by_brute_force(own):
    rng = random.Random(0)
    words = sorted({" " * rng.choice([0, 1, 1, 1, 2, 5]) + "".join(rng.choice("aeinthsr,.é9X") for _ in range(rng.randrange(1, 14)))
                    for _ in range(800)})
    for word, ids in own.search(words).items():
        assert np.frombuffer(ids, "<u4").tolist() == brute(own, word), word


def test_words_as_by_the_library(spark, sf, own, library):
    """Against the library's lattice search (its faster search may miss the best way)."""
    texts = [r["text"] for r in table(spark, sf, "documents").collect()]
    words = sorted({w for t in texts for w in pieces.WORDS.findall(" " + t) if w.startswith(" ") and w[1:] and "\n" not in w})
    found = own.search(words)
    for word in words[::7]:
        best = library.nbest_encode(word[1:], nbest_size=2, out_type=int)[0]
        ours = np.frombuffer(found[word], "<u4").tolist()
        assert sum(map(library.get_score, ours)) == sum(map(library.get_score, best)), word
    assert all(np.frombuffer(found[w], "<u4").tolist() == brute(own, w) for w in words[::11])


def test_round_trip_of_a_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in pieces.op2(spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_ids"] == len(r["ids"]) and (r["n_ids"] > 0) == bool(texts[r["doc_id"]])


def test_round_trip_of_odd_texts(spark):
    docs = documents(spark, [None, *ODD, *ODD])
    ids = pieces.encode(docs)
    assert collected(pieces.decode(ids), "doc_id") == [(i, t or "") for i, t in enumerate([None, *ODD, *ODD])]
    assert pieces.encode(documents(spark, [])).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert collected(pieces.decode(nulls), "doc_id") == [(1, None), (2, "")]


def test_order_of_words_does_not_matter(own):
    words = sorted({"ab", "abc", "abcd", " ab", "a", "b", "abd"})
    together = own.search(words)
    assert together == {w: own.search([w])[w] for w in words}
