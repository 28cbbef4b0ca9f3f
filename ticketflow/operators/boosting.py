"""Gradient boosting of binary labels on binned features, stopped by patience on a validation table.

Features are cut into bins at quantiles that Spark computes. Rows lie in blocks, one table row per some ten thousand tickets with
its bins and labels as arrays. A level of a tree is one pass over the blocks: each task adds its rows to histograms per
node and feature. There is a task per core, so what they all send is bounded by the cluster, not by the rows: up to ``SENT`` bytes
the driver adds them up; of more, the histograms of one node and feature meet in one task, and only the best split of each comes back.
A task counts several features together, in ``CELLS`` cells of all their bins at most, and takes each one's histogram from these.
The pass that takes the loss of a round also takes the first level of the next one. Executors
keep the blocks with the margins of the last round, so a pass applies no earlier tree anew; margins are written out every ``KEPT``
rounds, so that a repeated task applies at most so many.

Tables of up to ``near_rows`` rows are boosted where their blocks are, in the driver's memory, by the same functions: some tens of
passes a second instead of some ten. The model is the same (tested), up to the order of sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release_path, ship, stage, stage_at

BLOCK, BINS, KEPT, NEAR_ROWS = 1 << 16, 64, 10, 1 << 18
SENT = 1 << 24  # bytes of histograms of a pass that the driver adds up itself
CELLS = 1 << 15  # cells of several features together that a level of ``Far`` may have
SUMS_A_TASK = 64  # histograms that are added up in a task, before there are more tasks
BLOCK_SCHEMA = "block long, held boolean, n int, used binary, bins binary, label binary, weight double, margin binary"


@dataclass
class Settings:
    trees: int = 500
    patience: int = 50
    rate: float = 0.05
    depth: int = 6
    least_rows: int = 20
    least_curvature: float = 1e-3
    rows_share: float = 0.8  # drawn anew every ``rows_every`` rounds
    rows_every: int = 5
    features_share: float = 0.8  # drawn for each tree
    seed: int = 42


@dataclass
class Tree:
    """A binary heap: children of node ``i`` are ``2i + 1`` (bin up to ``at``) and ``2i + 2``; ``feature`` -1 is a leaf."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """Where each row (a column of ``bins``) ends. A split is a few operations on whole columns of small numbers."""
        small = np.min_scalar_type(len(self.feature))
        at = np.zeros(bins.shape[1], small)
        for i in np.flatnonzero(self.feature >= 0).tolist():  # parents come before their children
            above = (bins[self.feature[i]] > int(self.at[i])).astype(small)
            above += small.type(i + 1)
            above *= at == i
            at += above  # from i to 2i + 1, or 2i + 2
        return at.astype(np.int64)


@dataclass
class Boosted:
    """Trees kept, and how the training went: ``losses[r]`` is the validation loss with ``r`` trees."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for t in self.trees:
            out += t.value[t.node(bins)]
        return out

    def probability(self) -> Column:
        """The probability of label 1, from the columns named ``features``."""
        cuts, model, small = [np.array(c) for c in self.cuts], self, np.min_scalar_type(max(map(len, self.cuts)))

        @F.pandas_udf("double")
        def scored(table: pd.DataFrame) -> pd.Series:
            bins = np.stack([np.searchsorted(c, table[f].to_numpy(float)) for f, c in zip(model.features, cuts)]).astype(small)
            return pd.Series(1 / (1 + np.exp(-model.margin(bins))))
        return scored(F.struct(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.features]))

    def splits(self) -> dict[str, int]:
        """How many splits use each feature."""
        used = np.bincount(np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.zeros(0, np.int64)]),
                           minlength=len(self.features))
        return dict(zip(self.features, used.tolist()))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table, for ``restored``: a row per node, and per feature's cuts, and one for the rest."""
        rows = [("node", t, i, int(f), int(a), float(v), None) for t, tree in enumerate(self.trees)
                for i, (f, a, v) in enumerate(zip(tree.feature, tree.at, tree.value)) if i == 0 or tree.feature[(i - 1) // 2] >= 0]
        rows += [("cuts", None, i, None, None, None, [float(x) for x in c]) for i, c in enumerate(self.cuts)]
        rows.append(("rest", None, len(self.trees[0].feature) if self.trees else 1, None, None, float(self.base), [float(x) for x in self.losses]))
        return spark.createDataFrame(rows, "kind string, tree int, i int, feature int, at int, value double, list array<double>")

    @classmethod
    def restored(cls, table: DataFrame, features: list[str]) -> Boosted:
        rows = table.collect()  # a model
        rest = next(r for r in rows if r["kind"] == "rest")
        out = cls(list(features), [list(r["list"]) for r in sorted((r for r in rows if r["kind"] == "cuts"), key=lambda r: r["i"])],
                  rest["value"], losses=list(rest["list"]))
        for r in sorted((r for r in rows if r["kind"] == "node"), key=lambda r: (r["tree"], r["i"])):
            if r["tree"] == len(out.trees):
                out.trees.append(Tree(np.full(rest["i"], -1, np.int64), np.zeros(rest["i"], np.int64), np.zeros(rest["i"])))
            tree = out.trees[-1]
            tree.feature[r["i"]], tree.at[r["i"]], tree.value[r["i"]] = r["feature"], r["at"], r["value"]
        return out


@dataclass
class Block:
    block: int
    held: bool
    bins: np.ndarray
    label: np.ndarray
    weight: float  # of label 1; others have 1
    margin: np.ndarray

    @classmethod
    def of(cls, row, features: int) -> Block:
        bins = np.zeros((features, row[2]), np.uint8)
        used = np.frombuffer(row[3], np.int32)
        bins[used] = np.frombuffer(row[4], np.uint8).reshape(len(used), row[2])
        return cls(row[0], row[1], bins, np.frombuffer(row[5], np.int8), row[6], np.frombuffer(row[7], np.float64).copy())

    def row(self) -> tuple:
        """Without the features that are in bin 0 throughout, which is what each pass moves."""
        used = np.flatnonzero(self.bins.any(1)).astype(np.int32)
        return (self.block, self.held, len(self.label), used.tobytes(), self.bins[used].tobytes(), self.label.tobytes(), self.weight, self.margin.tobytes())

    def loss(self) -> tuple[float, float]:
        """Sum of the log losses, and number, of the rows."""
        sign = np.where(self.label > 0, self.margin, -self.margin)
        return float(np.logaddexp(0, -sign).sum()), float(len(sign))

    def sums(self, tree: Tree, level: int, chosen: np.ndarray, s: Settings, turn: int, cells: int = 0) -> np.ndarray:
        """Sums of gradient, curvature and rows for each bin, for the nodes of a level: feature, sum, node, bin. Features are counted
        together, in cells of all their bins, while a level has no more than ``cells`` of these."""
        draw = np.random.default_rng([s.seed, self.block, turn // s.rows_every])
        first = 2 ** level - 1
        node = tree.node(self.bins) - first
        rows = np.flatnonzero((draw.random(len(node)) < s.rows_share) & (node >= 0))
        p = 1 / (1 + np.exp(-self.margin[rows]))
        weight = np.where(self.label[rows] == 1, self.weight, 1.0)
        g, h = weight * (p - self.label[rows]), weight * p * (1 - p)
        node = node[rows]
        out = np.zeros((len(chosen), 3, 2 ** level, BINS))
        widths = [int(self.bins[f].max()) + 1 for f in chosen]
        for group in together(widths, cells >> level):
            size, cell = 1, np.zeros(len(self.label), np.int32)
            for k in group:
                if widths[k] > 1:
                    size, cell = size * widths[k], cell * np.int32(widths[k]) + self.bins[chosen[k]]
            cell = node * size + cell[rows]
            for i, w in enumerate((g, h, None)):
                table, left = np.bincount(cell, w, 2 ** level * size), 1
                for k in group:
                    split = table.reshape(2 ** level, left, widths[k], -1)
                    out[k, i, :, :widths[k]] = split.sum(3).sum(1) if len(group) > 1 else split[:, 0, :, 0]
                    left *= widths[k]
        return out

    def histograms(self, tree: Tree, level: int, chosen: np.ndarray, s: Settings, turn: int, cells: int = 0) -> dict[tuple[int, int], np.ndarray]:
        """``sums`` by ``(node, feature)``, of nodes that have rows."""
        return by_node(self.sums(tree, level, chosen, s, turn, cells), chosen)


def together(widths: list[int], cells: int) -> list[list[int]]:
    """Groups of places, narrow ones first, whose widths multiply to ``cells`` at most; a group may be a single place of any width."""
    groups: list[list[int]] = []
    size = 0
    for k in sorted(range(len(widths)), key=lambda k: widths[k]):
        if groups and size * widths[k] <= cells:
            groups[-1].append(k)
            size *= widths[k]
        else:
            groups.append([k])
            size = widths[k]
    return groups


def by_node(sums: np.ndarray, chosen: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    present = np.flatnonzero(sums[0, 2].any(1))
    return {(int(n), int(f)): x[:, n] for f, x in zip(chosen, sums) for n in present}


def best_split(sums: np.ndarray, s: Settings) -> tuple[float, int, float, float]:
    """Gain, bin, gradient and curvature of the best split of one node's histogram; a gain of 0 is none."""
    g, h, n = sums
    gl, hl, nl = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    fine = (nl >= s.least_rows) & (nr >= s.least_rows) & (hl >= s.least_curvature) & (hr >= s.least_curvature)
    total = g.sum() ** 2 / h.sum() if h.sum() > 0 else 0.0
    with np.errstate(all="ignore"):
        gain = np.where(fine, gl ** 2 / hl + gr ** 2 / hr - total, 0.0)
    at = int(gain.argmax())
    return (float(gain[at]) if gain[at] > 1e-9 else 0.0), at, float(g.sum()), float(h.sum())


def split_sums(sums: np.ndarray, s: Settings) -> tuple[float, int, float, float, float, float]:
    """``best_split``, and the gradient and curvature of what lies below the split."""
    best = best_split(sums, s)
    return (*best, *map(float, sums[:2, :best[1] + 1].sum(1)))


class Near:
    """Blocks in the driver's memory."""

    sums_below = False

    def __init__(self, blocks: DataFrame, features: int):
        self.blocks = [Block.of(r, features) for r in blocks.collect()]  # near_rows rows at most

    def level(self, tree, level, chosen, s, turn) -> list[tuple]:
        sums: dict = {}
        for b in self.blocks:
            if not b.held:
                for key, x in b.histograms(tree, level, chosen, s, turn).items():
                    sums[key] = sums[key] + x if key in sums else x
        return [(*key, *split_sums(x, s)) for key, x in sums.items()]

    def add(self, tree: Tree) -> None:
        for b in self.blocks:
            b.margin += tree.value[tree.node(b.bins)]

    def loss(self, *next_level) -> float:
        parts = [b.loss() for b in self.blocks if b.held]
        return sum(x for x, _ in parts) / max(1.0, sum(n for _, n in parts))

    def close(self) -> None:
        self.blocks = []


class Far:
    """Blocks, with their margins, as an RDD that the executors keep; each level of a tree, and each loss, is a short Spark job."""

    sums_below = True

    def __init__(self, blocks: DataFrame, features: int):
        self.spark, self.features, self.turns, self.path, self.before, self.root = blocks.sparkSession, features, 0, None, None, None
        self.kept = self._keep(self._dealt(blocks))

    @staticmethod
    def _dealt(blocks: DataFrame):
        """As many partitions as the cluster has cores, with as many blocks each."""
        return blocks.repartitionByRange(blocks.sparkSession.sparkContext.defaultParallelism, "block").rdd.map(tuple)

    @staticmethod
    def _keep(rows):
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    def level(self, tree, level, chosen, s, turn) -> list[tuple]:
        if level == 0 and self.root is not None and self.root[0] == turn:
            return self.root[1]
        features = self.features
        if self._bytes(level, chosen) <= SENT:
            return self._pass(tree, level, chosen, s, turn, False)[1]

        def parts(rows):
            sums: dict = {}
            for row in rows:
                if not row[1]:
                    for (n, f), x in Block.of(row, features).histograms(tree, level, chosen, s, turn, CELLS).items():
                        key = n * features + f
                        sums[key] = sums[key] + x if key in sums else x
            return sums.items()
        tasks = max(1, min(self.kept.getNumPartitions(), 2 ** level * len(chosen) // SUMS_A_TASK))
        sums = self.kept.mapPartitions(parts).reduceByKey(add, tasks)
        return sums.map(lambda item: (*divmod(item[0], features), *split_sums(item[1], s))).collect()

    def _bytes(self, level: int, chosen: np.ndarray) -> int:
        """What all tasks send for a level."""
        return self.kept.getNumPartitions() * 2 ** level * len(chosen) * 3 * BINS * 8

    def _pass(self, tree, level, chosen, s, turn, loss: bool) -> tuple[list[tuple[float, float]], list[tuple]]:
        """The parts of the loss, if wanted, and the splits of a level, in one pass whose sums the driver adds up."""
        features = self.features

        def parts(rows):
            sums, losses = None, (0.0, 0.0)
            for row in rows:
                block = Block.of(row, features)
                if not block.held:
                    x = block.sums(tree, level, chosen, s, turn, CELLS)
                    sums = x if sums is None else sums + x
                elif loss:
                    losses = tuple(map(add, losses, block.loss()))
            return [(losses, None if sums is None else sums.tobytes())]
        total, losses = np.zeros((len(chosen), 3, 2 ** level, BINS)), []
        for lost, x in self.kept.mapPartitions(parts).collect():  # SENT bytes at most
            losses.append(lost)
            if x is not None:
                total += np.frombuffer(x).reshape(total.shape)
        return losses, [(*key, *split_sums(x, s)) for key, x in by_node(total, chosen).items()]

    def add(self, tree: Tree) -> None:
        features = self.features

        def moved(row):
            b = Block.of(row, features)
            b.margin += tree.value[tree.node(b.bins)]
            return b.row()
        self._free()
        self.before, self.kept = self.kept, self._keep(self.kept.map(moved))
        self.turns += 1
        if self.turns % KEPT == 0:
            last, path = self.kept, self.path
            blocks, self.path = stage_at(self.spark.createDataFrame(last, BLOCK_SCHEMA, verifySchema=False), "margins")
            self._free()
            self.before, self.kept = last, self._keep(self._dealt(blocks))
            if path:
                release_path(self.spark, path)

    def _free(self) -> None:
        """Margins of a round before, once those that follow are kept."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def loss(self, tree: Tree, chosen: np.ndarray, s: Settings, turn: int) -> float:
        """The first level of ``turn``, the round to come, is taken in the same pass, if the driver adds it up."""
        features = self.features

        def sums(rows):
            parts = [Block.of(row, features).loss() for row in rows if row[1]]
            return [tuple(sum(p[i] for p in parts) for i in (0, 1))]
        if self._bytes(0, chosen) <= SENT:
            parts, found = self._pass(tree, 0, chosen, s, turn, True)
            self.root = turn, found
        else:
            parts = self.kept.mapPartitions(sums).collect()  # two numbers per task
        return sum(x for x, _ in parts) / max(1.0, sum(n for _, n in parts))

    def close(self) -> None:
        self._free()
        self.kept.unpersist()
        if self.path:
            release_path(self.spark, self.path)


def cuts_of(train: DataFrame, features: list[str]) -> list[list[float]]:
    """Up to ``BINS - 1`` cuts of each feature; a value up to a cut lies below it."""
    at = [(i + 1) / BINS for i in range(BINS - 1)]
    row = train.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in features]).first()
    return [sorted(set(map(float, row[f] or [0.0]))) for f in features]


def in_blocks(rows: DataFrame, features: list[str], cuts: list[list[float]], base: float, weight: float) -> DataFrame:
    """``rows`` (``held``, ``label`` and the features) in blocks, written out; ``weight`` is that of label 1."""
    edges = [np.array(c) for c in cuts]
    names, kinds = zip(*[c.split() for c in BLOCK_SCHEMA.split(", ")])
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[k] for k in kinds]

    def run(batches):
        from pyspark import TaskContext
        done = TaskContext.get().partitionId() << 33  # a repeated task gives the same ids
        held: dict[bool, list] = {False: [], True: []}

        def block(side):
            nonlocal done
            table = np.concatenate(held[side], axis=1)
            held[side] = []
            bins = np.stack([np.searchsorted(e, x) for e, x in zip(edges, table[1:])]).astype(np.uint8)
            done += 1
            row = Block(done - 1, side, bins, table[0].astype(np.int8), weight, np.full(table.shape[1], base)).row()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names)
        for batch in batches:
            side = np.asarray(batch.column(0).to_pylist(), bool)
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for s in (False, True):
                if (side == s).any():
                    held[s].append(table[:, side == s])
                    if sum(x.shape[1] for x in held[s]) >= BLOCK:
                        yield block(s)
        for s in (False, True):
            if held[s]:
                yield block(s)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("label", *features)]
    return stage(rows.select(F.col("held"), *values).mapInArrow(run, BLOCK_SCHEMA), "blocks")


def boost(train: DataFrame, val: DataFrame, features: list[str], label: str = "label", settings: Settings | None = None,
          near_rows: int = NEAR_ROWS) -> Boosted:
    """Trees fitted on ``train``, positives weighted by their rarity, until ``patience`` rounds brought no smaller log loss on ``val``;
    the trees of the best round are kept. Without validation rows all ``trees`` are fitted and kept. A null label or feature is 0.
    """
    s, spark = settings or Settings(), train.sparkSession
    ship(spark)
    columns = [*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("label")]
    head = train.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(label).cast("int"), F.lit(0))).alias("rate")).first()
    held_rows, rate = val.count(), head["rate"] or 0.0
    if not head["n"]:
        return Boosted(list(features), [[0.0] for _ in features], 0.0)
    weight = max(1.0, (1 - rate) / rate) if rate > 0 else 1.0
    share = weight * rate / (weight * rate + 1 - rate) if 0 < rate < 1 else min(max(rate, 1e-6), 1 - 1e-6)
    both = train.select(*columns, F.lit(False).alias("held")).unionByName(val.select(*columns, F.lit(True).alias("held")))
    model = Boosted(list(features), cuts_of(train.select(*columns), features), float(np.log(share / (1 - share))))
    blocks = in_blocks(both, features, model.cuts, model.base, float(weight))
    side = (Near if head["n"] + held_rows <= near_rows else Far)(blocks, len(features))
    trees: list[Tree] = []
    best = 0
    draw = np.random.default_rng(s.seed)

    def drawn() -> np.ndarray:
        return np.sort(draw.permutation(len(features))[:max(1, round(s.features_share * len(features)))])
    chosen = drawn()
    model.losses.append(side.loss(Tree.stump(s.depth), chosen, s, 0))
    for turn in range(s.trees):
        tree = grown(side, chosen, s, turn)
        trees.append(tree)
        side.add(tree)
        chosen = drawn()
        if held_rows:
            model.losses.append(side.loss(Tree.stump(s.depth), chosen, s, turn + 1))
            if model.losses[-1] < model.losses[best]:
                best = turn + 1
            elif turn + 1 - best >= s.patience:
                break
    side.close()
    model.trees = trees[:best] if held_rows else trees
    return model


def grown(side, chosen: np.ndarray, s: Settings, turn: int) -> Tree:
    """One tree, level by level. What falls to the leaves of the last level is known from the splits above them, which spares ``Far`` a pass."""
    tree = Tree.stump(s.depth)
    alive = {0}
    for level in range(s.depth + 1):
        first, found = 2 ** level - 1, {}
        for node, f, *split in side.level(tree, level, chosen, s, turn):
            if node + first in alive:
                found.setdefault(node + first, []).append((split[0], -f, *split[1:]))
        alive = set()
        for i, splits in found.items():
            gain, f, at, g, h, g_below, h_below = max(splits)
            tree.value[i] = _value(g, h, s)
            if gain > 0 and level < s.depth:
                tree.feature[i], tree.at[i] = -f, at
                alive |= {2 * i + 1, 2 * i + 2}
                if side.sums_below and level == s.depth - 1:
                    tree.value[2 * i + 1], tree.value[2 * i + 2] = _value(g_below, h_below, s), _value(g - g_below, h - h_below, s)
        if not alive or side.sums_below and level == s.depth - 1:
            break
    return tree


def _value(g: float, h: float, s: Settings) -> float:
    return -s.rate * g / h if h > 0 else 0.0
