"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked as the library marks it: a blank in front, blanks written as the mark U+2581. No piece of the
vocabulary has a mark behind another character, so a text is a sequence of marked words (a run of marks, then
what follows up to the next mark), and its best segmentation is that of its words. Each task sorts the distinct
marked words of a batch, which lays them out as a depth-first walk through their trie: the forward scores of
the prefix that a word shares with the one before are kept, only the rest is searched.

The best segmentation maximises the sum of piece scores; of equal ones, the one whose last piece is longest
wins, as in the library. Characters outside the vocabulary become byte pieces, at the library's penalty.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query
from .tokens import vocabulary

MARK, NO_PIECE = "▁", "\U0010ffff"
WORDS = re.compile("^[^ ]+| +[^ ]*")
REMEMBERED, TOGETHER = 600_000, 1 << 23  # encoded words kept per worker; characters whose words are searched together
PENALTY = 10.0  # the library's: an unknown character scores this much below the lowest piece


class Pieces:
    """Vocabulary of a SentencePiece file, with encoding of words and decoding of ids."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[float, int]] = {}
        self.surface: list[bytes] = []
        self.byte = [model.unk_id()] * 256
        low = 0.0
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.ids[piece] = (score, i)
                self.surface.append(piece.replace(MARK, " ").encode())
                low = min(low, score)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind another character; words can't be searched apart")
        self.unknown = low - PENALTY
        self.trie: dict[str, tuple] = {p[:n]: () for p in self.ids for n in range(1, len(p))} | self.ids  # () where none ends
        self.longest = max(map(len, self.ids))
        self.known: dict[str, bytes] = {}

    def search(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of sorted distinct ``words``, blanks standing for marks."""
        out, last = {}, ""
        forward = [0.0]  # best score of each prefix of the present word
        back: list[tuple[int, int]] = [(0, 0)]  # start and id (-1: byte pieces) of the last piece on that way
        step, longest, none, unknown = self.trie.get, self.longest, float("-inf"), self.unknown
        for word in words:
            keep, n = 0, len(word)
            for a, b in zip(word, last):
                if a != b:
                    break
                keep += 1
            forward[keep + 1:] = [none] * (n - keep)
            back[keep + 1:] = [(0, 0)] * (n - keep)
            marked = word.replace(MARK, NO_PIECE).replace(" ", MARK)  # a mark in the text itself is no blank
            for start in range(max(0, keep + 1 - longest), n + 1):
                if start > keep and not step(marked[start - 1]) and forward[start - 1] + unknown > forward[start]:
                    # a character without a piece of its own may also be spelled in bytes
                    forward[start], back[start] = forward[start - 1] + unknown, (start - 1, -1)
                score = forward[start]
                for end in range(start + 1 if start >= keep else keep + 1, n + 1):
                    found = step(marked[start:end])
                    if found is None:
                        break  # no piece begins like this
                    if found and score + found[0] > forward[end]:  # earlier starts come first, so longer last pieces win ties
                        forward[end], back[end] = score + found[0], (start, found[1])
            ids, at = [], n
            while at:
                start, piece = back[at]
                if piece < 0:
                    ids += [self.byte[b] for b in reversed(word[start:at].encode("utf-8"))]
                else:
                    ids.append(piece)
                at = start
            out[word] = array("I", ids[::-1]).tobytes()
            last = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; an empty text has none."""
        split = [WORDS.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        wanted: set[str] = set()
        for s in split:
            wanted.update(s)
        self.known.update(self.search(sorted(w for w in wanted if w not in self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8: pieces put together, without the blank in front."""
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return text[1:] if text[:1] == b" " else text


@cache
def worker_pieces(file: str) -> Pieces:
    """One vocabulary, with the words it remembers, for all tasks of a worker."""
    return Pieces(vocabulary(file))


def together(batches, size: int = TOGETHER):
    """Keys and texts of several batches, up to about ``size`` characters."""
    keys, texts, held = [], [], 0
    for batch in batches:
        some = [t or "" for t in batch.column(1).to_pylist()]
        keys.append(batch.column(0))
        texts += some
        held += sum(map(len, some))
        if held >= size:
            yield pa.chunked_array(keys).combine_chunks(), texts
            keys, texts, held = [], [], 0
    if texts:
        yield pa.chunked_array(keys).combine_chunks(), texts


def encode(docs: DataFrame, file: str = "piece_bpe_32k.model", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids array<int>)`` of every row; null text counts as empty, which has no ids. Equal texts have equal
    ids; rows that repeat stay; other columns are ignored; an empty table gives no rows."""
    def run(batches):
        pieces = worker_pieces(file)
        for keys, texts in together(batches):
            found = pieces.encode(texts)
            for at in range(0, len(texts), 256):
                yield pa.RecordBatch.from_arrays([keys[at:at + 256], lists(found[at:at + 256])], ["key", "ids"])
    kind = dict(docs.select(key).dtypes)[key]
    return (docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>")
            .withColumnRenamed("key", key))


def lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(b) // 4 for b in found]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))


def decode(encoded: DataFrame, file: str = "piece_bpe_32k.model", key: str = "doc_id") -> DataFrame:
    """``(key, text)`` from ``(key, ids)``: the exact text that was encoded. Null ids give null; ids that spell no
    valid UTF-8 give the replacement character."""
    def run(batches):
        pieces = worker_pieces(file)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(np.array(ids, "<u4").tobytes()).decode("utf-8", "replace")
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])
    kind = dict(encoded.select(key).dtypes)[key]
    return (encoded.select(key, F.col("ids").cast("array<int>")).mapInArrow(run, f"key {kind}, text string")
            .withColumnRenamed("key", key))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of every document, their checksum, and the digest of the text decoded from them."""
    def digests(batches):
        pieces = worker_pieces("piece_bpe_32k.model")
        for batch in batches:
            column = batch.column(1)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4")
            spans = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            decoded = [hashlib.sha256(pieces.decode(s)).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column, pa.array([len(s) // 4 for s in spans], pa.int64()),
                 pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(decoded)],
                ["doc_id", "ids", "n_ids", "ids_crc32", "decoded_sha256"])
    return encode(table(spark, sf_dir, "documents")).mapInArrow(
        digests, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string")
