"""Token ids packed into rows of a matrix, with segment lengths and position resets.

Each task encodes its share of the documents and packs blocks of some million ids by best-fit decreasing;
a segment tree over the free space finds the fullest row that still holds a piece. Nothing is shuffled. Only
the last rows of a block may stay partly empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query
from .tokens import CAPACITY, END, cuts, worker_encoder

BLOCK = 1 << 22  # ids packed together
SCHEMA = ("sequence_id long, n_tokens int, ids binary, cu_seqlens binary, positions binary, "
          "doc_ids array<long>, pieces array<int>, starts array<long>")


class SpaceTree:
    """Numbers of rows by free space ``0..capacity``, with the smallest used space from some value on."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, space: int, n: int) -> None:
        at = space + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def successor(self, space: int) -> int:
        """Smallest free space of any row that is at least ``space``, or -1."""
        at = space + self.leaves
        while not self.count[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if at == 0:
                return -1
            at += 1
            if at & (at - 1) == 0:  # past the last node of its level
                return -1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``lengths``; every length is at most ``capacity``."""
    tree, rows, free = SpaceTree(capacity), [], [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        space = tree.successor(lengths[i])
        if space < 0:
            row, space = len(rows), capacity
            rows.append([])
        else:
            row = free[space].pop()
            tree.add(space, -1)
        rows[row].append(i)
        left = space - lengths[i]
        free[left].append(row)
        tree.add(left, 1)
    return rows


def pack_matrix(docs: DataFrame, capacity: int = CAPACITY, file: str = "byte_bpe_50k.json", end: int = END,
                pad: int = END, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """One row per matrix row: ``ids`` and ``positions`` (``capacity`` values of ``dtype``), ``cu_seqlens`` (``<i4``, from
    0 to ``n_tokens``), and for each segment its doc_id, piece number and start in the document.

    Ids are those of the text, then ``end``; longer documents are cut, first piece shorter, and no id is lost.
    Behind ``n_tokens`` stand ``pad`` and position 0. Positions start at 0 in every segment. Null text is empty; rows
    with the same doc_id are segments of their own; an empty table has no rows. Ids that ``dtype`` does not hold are an error.
    """
    def emit(first, pieces):
        lengths = [len(p[3]) for p in pieces]
        for n, row in enumerate(best_fit_decreasing(lengths, capacity)):
            ids, positions = np.full(capacity, pad, dtype), np.zeros(capacity, dtype)
            ends = np.cumsum([0, *[lengths[i] for i in row]])
            for i, a, b in zip(row, ends[:-1], ends[1:]):
                ids[a:b] = pieces[i][3]
                positions[a:b] = np.arange(b - a)
            yield (first + n, int(ends[-1]), ids.tobytes(), ends.astype("<i4").tobytes(), positions.tobytes(),
                   [pieces[i][0] for i in row], [pieces[i][1] for i in row], [pieces[i][2] for i in row])

    def run(batches):
        encoder, last = worker_encoder(file), np.array([end], "<u4").tobytes()
        pieces, held, done = [], 0, TaskContext.get().partitionId() << 33  # a repeated task gives the same ids

        def flush():
            nonlocal pieces, held, done
            rows = list(emit(done, pieces))
            pieces, held, done = [], 0, done + len(rows)
            for at in range(0, len(rows), 2048):
                yield pd.DataFrame(rows[at:at + 2048], columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"], encoder.encode([t or "" for t in pdf["text"]])):
                values = np.frombuffer(ids + last, "<u4")
                if values.max() > np.iinfo(dtype).max:
                    raise ValueError(f"ids of {file} do not fit into {dtype}")
                values = values.astype(dtype)
                doc = None if pd.isna(doc) else int(doc)
                pieces += [(doc, i, s, values[s:s + n]) for i, (s, n) in enumerate(cuts(len(values), capacity))]
                held += len(values)
                if held >= block:
                    yield from flush()
        yield from flush()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """The matrix as Parquet files; each row's binary columns are fixed-width rows of the matrix."""
    packed.write.option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """``(doc_id, piece, start, ids)`` of every segment: what was packed."""
    def run(batches):
        for pdf in batches:
            rows = []
            for ids, ends, doc_ids, pieces, starts in zip(*[pdf[c] for c in ("ids", "cu_seqlens", "doc_ids", "pieces", "starts")]):
                values, ends = np.frombuffer(ids, dtype), np.frombuffer(ends, "<i4")
                rows += [(d, p, s, values[a:b].astype("<u4").tobytes())
                         for d, p, s, a, b in zip(doc_ids, pieces, starts, ends[:-1], ends[1:])]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "ids"]).astype({"doc_id": "Int64"})
    return packed.mapInPandas(run, "doc_id long, piece int, start long, ids binary")


@query("op10_token_matrix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_matrix(table(spark, sf_dir, "documents"))
