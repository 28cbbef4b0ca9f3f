"""Ranked lexical search by dual trees.

Documents become bags of those terms that some item may have, are ordered by their rarest such term, and are written in blocks.
A block is the root of a small tree whose nodes hold, for each term, the largest share that any document below gives it. Items form trees in
the same way: a node holds the weights of all terms below it. The product of two nodes is then no less than the score of any item
below the one in any document below the other. A pair of nodes is left, with all pairs below it, once this bound is less than the weakest
``top``-th score that the node's items have so far; else both nodes are divided, down to documents and items, which are
scored exactly. Bounds and scores are sums of whole numbers, so nothing is lost to rounding.

Three rounds over the blocks: bounds of the blocks' roots name the most promising blocks of each few items; these blocks are scored, and
give each item a first ``top``-th score; then all blocks are searched with it, each task raising it further for itself. Items go through in
waves of a fixed number, so what tasks are sent is bounded. Bags leave out the terms that no item has by a table of
``SIEVE`` hash places, of the same size for any number of items.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import row_index
from .common import forget, put, table
from .registry import query

TOP = 50
DOCS, POSTINGS, LEAF = 256, 1 << 16, 32  # documents and their terms in a block, documents in a leaf
ITEMS, WAVE, SEEDS = 256, 16384, 4  # items in a block and in a wave, promising blocks for each eight items
SIEVE = 1 << 20
#: A-Z are lowered, and what is neither letter nor digit of ASCII nor beyond ASCII is a blank.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def lists(values: list, ends: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def bags(texts: DataFrame, key: str, sieve: bytes | None = None) -> DataFrame:
    """``(key, n, terms, tf)`` of each row: all its terms counted, and those distinct ones that pass the sieve with their counts."""
    def run(batches):
        for batch in batches:
            ns, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = terms_of(text or b"")
                ns.append(len(words))
                for word, n in Counter(words).items():
                    if sieve is None or sieve[zlib.crc32(word) & (SIEVE - 1)]:
                        terms.append(word)
                        counts.append(n)
                ends.append(len(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), lists(terms, ends, pa.binary()),
                                              lists(counts, ends, pa.int32())], ["key", "n", "terms", "tf"])
    return (texts.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").cast("binary"))
            .mapInArrow(run, "key long, n long, terms array<binary>, tf array<int>"))


def blocks_of(bag: DataFrame, rarity: bytes, n_docs: int, n_terms: int) -> DataFrame:
    """Documents in blocks, ordered by their rarest term: ``block, docs, terms, tops, starts, cols, shares``.

    ``shares`` are what the terms ``terms[cols]`` give to a score for each unit of their weight, document by document from ``starts``; ``tops``
    is the largest share of each term.
    """
    rank = np.frombuffer(rarity, np.int64)

    def keyed(batches):
        for batch in batches:
            words, ends = batch.column(2).values.to_pylist(), batch.column(2).offsets.to_numpy()
            keys = [min(words[a:b], key=lambda w: (rank[zlib.crc32(w) & (SIEVE - 1)], w)) if b > a else None
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], ["rarest", "key", "n", "terms", "tf"])

    def blocked(batches):
        done, held, size = TaskContext.get().partitionId() << 33, [], 0  # a repeated task gives the same ids

        def block():
            at: dict[bytes, int] = {}
            cols = [at.setdefault(w, len(at)) for _, _, words, _ in held for w in words]
            starts = np.cumsum([0, *[len(h[2]) for h in held]])
            tf = np.array([c for h in held for c in h[3]], np.int64)
            m = np.repeat([50 + 50 * h[1] * n_docs // n_terms for h in held], np.diff(starts)).astype(np.int64)
            shares = 1_000_000_000 * tf // (1000 * tf + 20 * m)
            tops = np.zeros(len(at), np.int64)
            np.maximum.at(tops, cols, shares)
            return pa.RecordBatch.from_arrays(
                [pa.array([done], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([list(at)], pa.list_(pa.binary())),
                 *[pa.array([v.tolist() if isinstance(v, np.ndarray) else v], pa.list_(pa.int32())) for v in (tops, starts, cols, shares)]],
                ["block", "docs", "terms", "tops", "starts", "cols", "shares"])
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                held.append(row)
                size += len(row[2])
                if len(held) == DOCS or size >= POSTINGS:
                    yield block()
                    done, held, size = done + 1, [], 0
        if held:
            yield block()
    rows = (bag.where(F.size("terms") > 0).mapInArrow(keyed, "rarest binary, key long, n long, terms array<binary>, tf array<int>")
            .repartitionByRange("rarest", "key").sortWithinPartitions("rarest", "key").drop("rarest"))
    return rows.mapInArrow(blocked, "block long, docs array<long>, terms array<binary>, tops array<int>, starts array<int>, "
                                    "cols array<int>, shares array<int>")


class ItemTree:
    """A block of items: ``items[i]`` has weight ``weight[j]`` on term ``cols[j]`` where ``rows[j]`` is ``i``."""

    def __init__(self, items: list[int], words: list[list[bytes]], weights: list[list[int]]):
        self.items = np.array(items, np.int64)
        self.at: dict[bytes, int] = {}
        self.cols = np.array([self.at.setdefault(w, len(self.at)) for some in words for w in some], np.int64)
        self.rows = np.repeat(np.arange(len(items)), [len(w) for w in words])
        self.weight = np.array([x for some in weights for x in some], np.int64)
        most = max((sum(some) for some in weights), default=0)
        # no score or bound leaves the whole numbers that a double holds; a node has no more weight than all terms together
        all_terms = np.zeros(len(self.at), np.int64)
        all_terms[self.cols] = self.weight
        self.kind = np.float64 if max(most, int(all_terms.sum())) * 1_000_000 < 1 << 53 else np.int64

    def shared(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which of a block's terms some item has, and the items' weights for these."""
        found = np.array([self.at.get(t, -1) for t in terms], np.int64)
        mine = np.flatnonzero(found >= 0)
        place = np.full(len(self.at), -1, np.int64)
        place[found[mine]] = np.arange(len(mine))
        to = place[self.cols]
        met = to >= 0
        q = np.zeros((len(self.items), len(mine)), self.kind)
        q[self.rows[met], to[met]] = self.weight[met]
        return mine, q


def joined(x: np.ndarray, n: int) -> np.ndarray:
    """Largest values of each ``n`` rows, one row for each node."""
    return np.maximum.reduceat(x, np.arange(0, len(x), n), axis=0)


class Best:
    """The ``top`` best of each item of a block so far; ``least`` is what a further document must reach."""

    def __init__(self, size: int, top: int, least: np.ndarray):
        self.size, self.top, self.least = size, top, least.copy()
        self.kept = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]  # item, score, no id, id
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, items, scores, no_id, ids) -> None:
        self.new.append([items, scores, no_id, ids])
        self.waiting += len(items)
        if self.waiting > 1 << 13:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        item, score, none, ids = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((ids, none, -score, item))
        item, score, none, ids = item[order], score[order], none[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.top
        self.kept = [c[keep] for c in (item, score, none, ids)]
        last = rank == self.top - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        self.new, self.waiting = [], 0


def searched(tree: ItemTree, best: Best, docs: list, terms: list[bytes], tops: np.ndarray, starts: np.ndarray, cols: np.ndarray,
             shares: np.ndarray) -> int:
    """Search one block of documents for one block of items; how many pairs were scored."""
    mine, q = tree.shared(terms)
    if not len(mine):
        return 0
    kind = tree.kind
    levels = [joined(q, len(q)), joined(q, 64), joined(q, 8), q]
    least = [np.minimum.reduceat(best.least, np.arange(0, len(q), n)) for n in (len(q), 64, 8, 1)]
    root = tops[mine].astype(kind)
    if not (levels[0] @ root >= np.maximum(least[0], 1)).any() or not (levels[2] @ root >= np.maximum(least[2], 1)).any():
        return 0
    n = len(docs)
    place = np.full(len(terms), -1, np.int64)
    place[mine] = np.arange(len(mine))
    to = place[cols]
    met = to >= 0
    x = np.zeros((n, len(mine)), kind)
    x[np.repeat(np.arange(n), np.diff(starts))[met], to[met]] = shares[met]
    parts = [joined(x, LEAF)]
    while len(parts) < 3:
        parts.append(joined(parts[-1], 2))
    nodes = [root[None, :], *parts[::-1]]  # the documents' tree has four levels, too
    alive = np.ones((1, 1), bool)
    for level, (a, b) in enumerate(zip(levels, nodes)):
        if level:
            up = np.arange(len(a)) // (64, 8, 8)[level - 1] if level > 1 else np.zeros(len(a), np.int64)
            side = np.arange(len(b)) // 2 if level > 1 else np.zeros(len(b), np.int64)
            alive = alive[up][:, side]
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            return 0
        reach = np.maximum(least[level], 1)[rows][:, None]
        here = alive[rows] & (a[rows] @ b.T >= reach)
        alive = np.zeros_like(alive)
        alive[rows] = here
    ids = np.array([d or 0 for d in docs], np.int64)
    none = np.array([d is None for d in docs], bool)
    scored = 0
    for leaf in range(alive.shape[1]):
        rows = np.flatnonzero(alive[:, leaf])
        if len(rows):
            first = leaf * LEAF
            scores = q[rows] @ x[first:first + LEAF].T
            scored += scores.size
            i, d = np.nonzero(scores >= np.maximum(best.least[rows], 1)[:, None])
            if len(i):
                best.add(rows[i], scores[i, d].astype(np.int64), none[first + d], ids[first + d])
    return scored


def read_blocks(batches) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for r in range(batch.num_rows):
            yield tuple(c[r].as_py() if i < 3 else c[r].values.to_numpy() for i, c in enumerate(columns))


def promising(blocks: DataFrame, items, seeds: int) -> DataFrame:
    """``(block)``: for each eight items the ``seeds`` blocks with the largest bounds."""
    def run(batches):
        trees = items.value
        found: dict[tuple[int, int], list] = {}
        for block, terms, tops in ((b[0].as_py(), b[1].as_py(), b[2].values.to_numpy()) for batch in batches for b in zip(*batch.columns)):
            for t, tree in enumerate(trees):
                mine, q = tree.shared(terms)
                if len(mine):
                    for node, bound in enumerate((joined(q, 8) @ tops[mine].astype(tree.kind)).tolist()):
                        own = found.setdefault((t, node), [])
                        own.append((int(bound), block))
                        if len(own) > 8 * seeds:
                            found[t, node] = sorted(own, reverse=True)[:seeds]
        rows = [(t << 32 | node, *x) for (t, node), own in found.items() for x in sorted(own, reverse=True)[:seeds]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3,
                                         ["node", "bound", "block"])
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bound"), F.desc("block")))
    return (blocks.select("block", "terms", "tops").mapInArrow(run, "node long, bound long, block long")
            .withColumn("r", rank).where(F.col("r") <= seeds).select("block").distinct())


def candidates(blocks: DataFrame, items, least, top: int) -> DataFrame:
    """``(item, score, doc_id)``: for each item (its place in the wave) the best ``top`` of each task, as far as they reach ``least``."""
    def run(batches):
        trees, floors = items.value, least.value
        best = [Best(len(tree.items), top, floor) for tree, floor in zip(trees, floors)]
        for _, docs, terms, tops, starts, cols, shares in read_blocks(batches):
            for tree, own in zip(trees, best):
                searched(tree, own, docs, terms, tops, starts, cols, shares)
        for t, own in enumerate(best):
            own.settle()
            item, score, none, ids = own.kept
            yield pa.RecordBatch.from_arrays([pa.array(item + t * ITEMS), pa.array(score), pa.array(ids, mask=none)], ["item", "score", "doc_id"])
    return blocks.mapInArrow(run, "item long, score long, doc_id long")


def best_of(found: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def weighted_items(items: DataFrame, bag: DataFrame, n_docs: int) -> DataFrame:
    """``(r, item_id, terms, weights)``, numbered by ``r`` in the order of their rarest terms; items without a term of any document
    are left out. ``items`` has ``row, item_id, terms``."""
    each = items.select("row", "item_id", F.explode("terms").alias("term"))
    df = (bag.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
          .join(each.select("term").distinct(), "term", "left_semi"))
    weight = F.floor(F.lit(1000) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    rows = (each.join(df.select("term", weight.alias("weight")), "term").groupBy("row", "item_id")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("t")))  # one item's terms
    rows = rows.select("row", "item_id", F.col("t.term").alias("terms"), F.transform("t.w", lambda w: -w).alias("weights"),
                       F.element_at("t.term", 1).alias("rarest"))
    return row_index(rows, ["rarest", "row"], "r").select("r", "item_id", "terms", "weights")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item, score above 0, equal ones by ascending doc_id, null last.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; null text has no terms. Rows that repeat, or share an id,
    are documents, or items, of their own: an item row has its own ranks from 1. Empty tables and items without a term give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    spark.conf.set(BATCH_BYTES, str(16 << 20))
    listed, at_items = put(bags(items.select("item_id", "text"), "item_id")
                           .select(F.monotonically_increasing_id().alias("row"), F.col("key").alias("item_id"), "terms"), "items")
    spots = (listed.select(F.explode("terms").alias("term")).select(F.crc32("term").bitwiseAND(F.lit(SIEVE - 1)).alias("b")).distinct()
             .collect())  # SIEVE places at most
    sieve = bytearray(SIEVE)
    for r in spots:
        sieve[r["b"]] = 1
    bag, at_bags = put(bags(docs, "doc_id", bytes(sieve)), "bags")
    head = bag.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not head["docs"] or not spots:
        return empty
    rarity = np.full(SIEVE, np.iinfo(np.int64).max, np.int64)
    for r in (bag.select(F.explode("terms").alias("term")).groupBy(F.crc32("term").bitwiseAND(F.lit(SIEVE - 1)).alias("b"))
              .count().collect()):  # SIEVE places at most
        rarity[r["b"]] = r["count"]
    ready, at_ready = put(weighted_items(listed, bag, head["docs"]), "weighted")
    blocks, at_blocks = put(blocks_of(bag, rarity.tobytes(), head["docs"], head["terms"]), "blocks")
    forget(spark, at_items, at_bags)
    out = empty
    count = ready.count()
    for first in range(0, count, WAVE):
        wave = ready.where(F.col("r").between(first, first + WAVE - 1)).orderBy("r").collect()  # WAVE rows at most
        groups = [wave[i:i + ITEMS] for i in range(0, len(wave), ITEMS)]
        trees = spark.sparkContext.broadcast([ItemTree([r["r"] for r in g], [[bytes(t) for t in r["terms"]] for r in g],
                                                       [r["weights"] for r in g]) for g in groups])
        nothing = [np.zeros(len(g), np.int64) for g in groups]
        seeds = promising(blocks, trees, SEEDS)
        start = candidates(blocks.join(F.broadcast(seeds), "block", "left_semi"), trees, spark.sparkContext.broadcast(nothing), top)
        floors = [n.copy() for n in nothing]
        for r in best_of(start, "item", top).where(F.col("rank") == top).select("item", "score").collect():  # WAVE rows at most
            floors[r["item"] // ITEMS][r["item"] % ITEMS] = r["score"]
        found = candidates(blocks, trees, spark.sparkContext.broadcast(floors), top)
        ranked, _ = put(best_of(found.withColumn("r", F.col("item") + first), "r", top), "ranked")
        out = out.unionByName(ranked.join(F.broadcast(ready.where(F.col("r").between(first, first + WAVE - 1)).select("r", "item_id")), "r")
                              .select("item_id", "rank", "doc_id", "score"))
        trees.destroy()
    forget(spark, at_blocks)
    return out


_UPPER = "".join(map(chr, range(65, 91)))
_WORDS = "regexp_extract_all(translate(text, '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(u=_UPPER, l=_UPPER.lower())

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest({_WORDS}) AS term FROM benchmark)),
f AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
c AS (SELECT i.item, i.item_id, m.r, m.doc_id, sum(f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0
QUALIFY rank <= {TOP}
"""


@query("op11_ranked_search", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
