"""Best-fit packing in supersteps over ranges of ranks.

Documents are range-sorted by length, and get a dense rank among those of their length. Lengths are whole
numbers up to the capacity, so documents of one length, and sequences with one gap, are interchangeable:
each superstep matches a whole range of ranks. In order of falling length, a sweep looks up the successor
(the smallest gap that holds the length), the lower ranks win it, gaps are updated, and the sweep is repeated
until the length is placed; what finds no gap opens new sequences. The table of lengths has ``capacity`` rows
at most whatever the input, so it alone meets on the driver; documents find their place by joining their rank
to the ranges. The outcome is that of best-fit decreasing, document by document.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import row_index
from .common import cut, table
from .registry import query
from .tokens import CAPACITY, END, cuts, worker_encoder


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, file: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's ids with ``end`` behind them.

    Documents longer than ``capacity`` are cut; the first piece takes the remainder. Null text is empty, and an
    empty text is one piece with the end id alone. Rows with the same doc_id are cut one by one.
    """
    def run(batches):
        encoder = worker_encoder(file)
        last = np.array([end], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["doc_id"], encoder.encode([t or "" for t in pdf["text"]])):
                ids += last
                rows += [(doc, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                         for i, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def superstep_ranges(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, last_rank, first_sequence, offset)``: rank ``r`` of the range lies at ``offset`` in
    sequence ``first_sequence + r - first_rank``. ``counts`` has the number of documents of each length."""
    out, opened = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # space left -> runs of sequences (first, how many)
    spaces: list[int] = []

    def leave(space, first, n):
        if space and n:
            if space not in gaps:
                gaps[space] = []
                insort(spaces, space)
            gaps[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, free = gaps[space].pop()
                took = min(free, n - rank)
                out.append((length, rank, rank + took - 1, first, capacity - space))
                if took < free:
                    gaps[space].append((first + took, free - took))
                elif not gaps[space]:
                    del gaps[space], spaces[at]
                leave(space - length, first, took)
                rank += took
                continue
            each = capacity // length
            full, more = divmod(n - rank, each)
            for layer in range(each):
                took = full + (layer < more)
                if took:
                    out.append((length, rank, rank + took - 1, opened, layer * length))
                    rank += took
            leave(capacity - each * length, opened, full)
            leave(capacity - more * length, opened + full, int(more > 0))
            opened += full + (more > 0)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (both long).

    ``length`` (long) is each row's size and ``order`` ranks rows of one length. Rows whose length is null, below
    one or above ``capacity`` have no place: both columns are null. Rows that are equal in all of ``order`` get
    different places. Columns of these two names, and ``_rank``, are replaced.
    """
    plain = pieces.drop("sequence_id", "offset", "_rank")
    ranked = row_index(plain, ["length", *order], "_rank")
    sizes = {r["length"]: r["n"] for r in ranked.where(F.col("length").between(1, capacity))
             .groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    below, base = ranked.where("length < 1").count(), {}
    for length in sorted(sizes):
        base[length], below = below, below + sizes[length]
    rows = [(length, base[length] + a, base[length] + b, seq, off) for length, a, b, seq, off
            in superstep_ranges(sizes, capacity)]
    places = plain.sparkSession.createDataFrame(rows, "_length long, _from long, _to long, _first long, _offset long")
    fits = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    # the ranges are bounded by the square of the capacity, in practice a few per length
    return (ranked.join(F.broadcast(places), fits, "left")
            .select(*plain.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
                    F.col("_offset").alias("offset")))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(token_pieces(table(spark, sf_dir, "documents"))))
