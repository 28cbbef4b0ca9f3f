"""Nearest tickets by cosine similarity, exactly, on tables of any size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .ranking import row_index

MAX_LOCAL_QUERIES = 10_000  # queries in a block of ``local``
SAMPLE = 20_000  # vectors that the coarse index is fitted on, at most
MAX_CELLS = 1024
BLOCK_ROWS = 4096
LANES, LANE_ROWS, LEAST_ROWS = 24, 1 << 18, 256  # lanes of queries while these are few, rows in one at most, and rows that are worth one
TILE_VALUES, EXACT_VALUES, HIT_ROWS = 1 << 19, 1 << 20, 10_000
FIRST_ROWS = 256  # base rows that are compared in double precision, before queries have a k-th best
DIGITS = 10  # similarities are compared at this many digits, so that equal vectors tie


def kb_rows(df: DataFrame) -> DataFrame:
    """Metadata kept next to each vector: text, never null, the subject cut."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select("ticket_id", "embedding", text("split").alias("split"), text("category").alias("category"),
                     text("priority").alias("priority"), F.substring(text("subject"), 1, 200).alias("subject"))


def attach_vectors(rows: DataFrame, vectors: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Vectors meet their rows by id, never by position."""
    return rows.join(vectors.select(key, "embedding"), key)


def _comparable(df: DataFrame, key: str) -> DataFrame:
    """``key``, ``embedding`` and its length as ``__dim``, of the rows whose vector can be compared: not null, without null or
    non-finite numbers. Only vectors of one length meet."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return df.select(key, "embedding", F.size("embedding").alias("__dim")).where(F.col("embedding").isNotNull() & (F.col("__dim") > 0) & finite)


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision, and which rows have a direction at all."""
    matrix = np.array(column.tolist(), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    keep = norms > 0
    return matrix[keep] / norms[keep, None], keep


def _best(query_ids: np.ndarray, queries: np.ndarray, block: pd.DataFrame, k: int, id_column: str,
          exclude_self: bool) -> pd.DataFrame:
    """The k best rows of ``block`` for each query, ties by id, as ``__q``, ``similarity`` and block columns."""
    block = block.sort_values(id_column, ignore_index=True)
    vectors, keep = _unit(block["embedding"])
    block = block[keep].drop(columns=["embedding"]).reset_index(drop=True)
    parts = []
    for start in range(0, len(query_ids), 1024):
        ids = query_ids[start:start + 1024]
        sims = np.round(queries[start:start + 1024] @ vectors.T, DIGITS)
        if exclude_self:
            at = pd.Index(block[id_column]).get_indexer(ids)
            rows = np.nonzero(at >= 0)[0]
            sims[rows, at[rows]] = -np.inf
        if sims.shape[1] > k:
            floor = np.partition(sims, -k, axis=1)[:, -k][:, None]
            row, col = np.nonzero((sims >= floor) & (sims > -np.inf))
        else:
            row, col = np.nonzero(sims > -np.inf)
        # block columns are in id order, so the column number breaks ties
        order = np.lexsort((col, -sims[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row, side="left")
        top = np.arange(len(row)) - first < k
        row, col = row[top], col[top]
        part = block.take(col).reset_index(drop=True)
        part.insert(0, "similarity", sims[row, col])
        part.insert(0, "__q", ids[row])
        parts.append(part)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def _hit_schema(queries: DataFrame, base: DataFrame, query_id: str) -> StructType:
    return StructType([StructField("__q", queries.schema[query_id].dataType),
                       StructField("similarity", DoubleType()),
                       *[f for f in base.schema if f.name != "embedding"]])


def _rank(found: DataFrame, k: int, base_id: str) -> DataFrame:
    """Final ranks. Spark cuts each task's rows to k per query before the shuffle."""
    order = Window.partitionBy("__q").orderBy(F.desc("similarity"), base_id)
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _matrices(batch, key: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of its vectors: the ids, as objects, and the vectors of a batch, in double precision only if they come so."""
    column, dims = batch.column("embedding"), batch.column("__dim").to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False)
    values = values if values.dtype == np.float32 else values.astype(np.float64)
    ids = np.empty(len(dims), object)
    ids[:] = batch.column(key).to_pylist()
    ends = np.cumsum(dims)
    return {int(d): (ids[dims == d], values.reshape(-1, d) if len(dims) * d == len(values) else np.stack([values[e - d:e] for e in ends[dims == d]]))
            for d in np.unique(dims)}


class Nearest:
    """The ``k`` best base rows so far of each query of a block. Base rows come in the order of their ids, so of equal
    similarities the earlier one wins.

    A tile of similarities is made in single precision; what might be better than a query's k-th best by more than that
    can be wrong is computed again in double precision, or the whole tile, where that is much. The first tiles are narrow, as
    queries without a k-th best have all of a tile computed in double precision.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool):
        norms = _norms(vectors)
        self.ids, self.vectors, self.norms = ids[norms > 0], vectors[norms > 0], norms[norms > 0]
        self.k, self.exclude_self, self.seen = k, exclude_self, 0
        self.sims = np.full((len(self.ids), k), -np.inf)
        self.found = np.empty((len(self.ids), k), object)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = _norms(vectors)
        ids, base = ids[norms > 0], vectors[norms > 0] / norms[norms > 0, None]
        while len(ids):
            width = max(FIRST_ROWS, self.seen)
            self._tiles(ids[:width], base[:width])
            self.seen += min(width, len(ids))
            ids, base = ids[width:], base[width:]

    def _tiles(self, ids: np.ndarray, base: np.ndarray) -> None:
        single, dim = base.astype(np.float32).T, base.shape[1]
        slack = (dim + 4) * 2.0 ** -23  # twice what a single-precision product of unit vectors can be wrong by
        step = max(32, TILE_VALUES // len(ids))  # a tile stays in a core's cache
        size = min(step, len(self.ids)) * len(ids)
        tile, near = np.empty(size, np.float32), np.zeros(-(-size // 8) * 8, bool)
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            asked = self.vectors[part] / self.norms[part, None]
            floor = self.sims[part, -1]
            row = None
            if (floor > -np.inf).all():
                sims, may = (x[:len(asked) * len(ids)].reshape(len(asked), len(ids)) for x in (tile, near))
                np.matmul(asked.astype(np.float32), single, out=sims)
                np.greater_equal(sims, (floor - slack).astype(np.float32)[:, None], out=may)
                near[may.size:] = False
                row, col = np.divmod(_marked(near), len(ids))
                if len(row) * dim <= EXACT_VALUES:
                    sims = np.round(np.einsum("ij,ij->i", asked[row], base[col]), DIGITS)
                    better = sims > floor[row]
                    if self.exclude_self:
                        better &= ids[col] != self.ids[part][row]
                    row, col, sims = row[better], col[better], sims[better]
                else:
                    row = None
            if row is None:
                row, col, sims = self._all(asked, base, floor, ids, self.ids[part])
            if len(row):
                self._merge(at, row, col, sims, ids)

    def _all(self, asked: np.ndarray, base: np.ndarray, floor: np.ndarray, ids: np.ndarray, own: np.ndarray):
        sims = np.round(asked @ base.T, DIGITS)
        if self.exclude_self:
            codes = pd.factorize(np.concatenate([own, ids]), use_na_sentinel=False)[0]
            sims[codes[:len(own), None] == codes[None, len(own):]] = -np.inf
        good = sims > floor[:, None]
        if sims.shape[1] > self.k:
            good &= sims >= np.partition(sims, -self.k, axis=1)[:, -self.k][:, None]
        row, col = np.nonzero(good)
        return row, col, sims[row, col]

    def _merge(self, at: int, row: np.ndarray, col: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((col, -sims, row))
        row, col, sims = row[order], col[order], sims[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        row, col, sims, place = (x[place < self.k] for x in (row, col, sims, place))
        rows, own = np.unique(row, return_inverse=True)
        new_sims, new_ids = np.full((len(rows), self.k), -np.inf), np.empty((len(rows), self.k), object)
        new_sims[own, place], new_ids[own, place] = sims, ids[col]
        rows = rows + at
        both, names = np.hstack([self.sims[rows], new_sims]), np.hstack([self.found[rows], new_ids])
        best = np.argsort(-both, axis=1, kind="stable")[:, :self.k]
        self.sims[rows], self.found[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)

    def columns(self) -> tuple[list, list, list]:
        """Query ids, similarities and base ids of the rows found."""
        row, col = np.nonzero(self.sims > -np.inf)
        return self.ids[row].tolist(), self.sims[row, col].tolist(), self.found[row, col].tolist()


def _marked(marks: np.ndarray) -> np.ndarray:
    """Where ``marks``, a multiple of eight and few of them true, are true: eight at a time, which ``nonzero`` alone takes as long for as the product of a tile."""
    eights = np.flatnonzero(marks.view(np.uint64) != 0)
    at, bit = np.nonzero(marks.reshape(-1, 8)[eights])
    return 8 * eights[at] + bit


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.linalg.norm(vectors.astype(np.float64, copy=False), axis=1)


def _search(blocks: dict[int, Nearest], held: dict[int, list], batch, key: str, block_rows: int) -> None:
    """Add a batch of base rows, ``block_rows`` at a time; ``held`` has what is left over."""
    for dim, (ids, vectors) in _matrices(batch, key).items():
        if dim in blocks:
            held.setdefault(dim, []).append((ids, vectors))
            if sum(len(i) for i, _ in held[dim]) >= block_rows:
                _flush(blocks, held, dim, block_rows)


def _flush(blocks: dict[int, Nearest], held: dict[int, list], dim: int, block_rows: int) -> None:
    parts = held.pop(dim)
    ids, vectors = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
    for at in range(0, len(ids), block_rows):
        blocks[dim].add(ids[at:at + block_rows], vectors[at:at + block_rows])


def _hits(blocks: dict[int, Nearest], kinds: list[pa.DataType]):
    for block in blocks.values():
        columns = block.columns()
        for at in range(0, len(columns[0]), HIT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + HIT_ROWS], kind) for c, kind in zip(columns, kinds)], ["__q", "similarity", "__b"])


def _local(queries: pd.DataFrame, base: DataFrame, schema: StructType, k: int, query_id: str, base_id: str,
           exclude_self: bool, block_rows: int) -> DataFrame:
    """A bounded set of queries travels to every task; the base is only scanned, each part of it in the order of its ids."""
    ids = np.empty(len(queries), object)
    ids[:] = [None if pd.isna(x) else x for x in queries[query_id].tolist()]
    shared = base.sparkSession.sparkContext.broadcast((ids, np.array(queries["embedding"].tolist())))

    def scan(batches):
        blocks, held, kinds = {}, {}, None
        for batch in batches:
            if not blocks:
                own, vectors = shared.value
                blocks = {vectors.shape[1]: Nearest(own, vectors, k, exclude_self)}
                kinds = [kind_of_query, pa.float64(), batch.schema.field(base_id).type]
            _search(blocks, held, batch, base_id, block_rows)
        for dim in list(held):
            _flush(blocks, held, dim, block_rows)
        yield from _hits(blocks, kinds)

    kind_of_query = to_arrow_type(schema["__q"].dataType)
    return base.sortWithinPartitions(base_id).mapInArrow(scan, _pairs(schema, base_id)).withColumnRenamed("__b", base_id)


def _pairs(schema: StructType, base_id: str) -> StructType:
    return StructType([schema["__q"], schema["similarity"], StructField("__b", schema[base_id].dataType)])


def _grid(queries: DataFrame, base: DataFrame, schema: StructType, k: int, query_id: str, base_id: str,
          exclude_self: bool, block_rows: int) -> DataFrame:
    """Lanes of up to ``LANE_ROWS`` queries, a task each, past which the base streams in the order of its ids, ``block_rows`` rows at a time.

    A query is sent once, to its lane, which finds all its hits; a base row is sent once per lane, so what is sent grows
    with the queries, and with the base times ``LANES`` until these are full. A task holds its queries and one block.
    """
    n, own, other, vectors = queries.count(), schema["__q"].dataType, schema[base_id].dataType, _values(queries, base)
    lanes = max(1, min(LANES, math.ceil(n / LEAST_ROWS)), math.ceil(n / LANE_ROWS))
    left = _comparable(queries, query_id).select(
        F.pmod(F.xxhash64(query_id, "embedding"), F.lit(lanes)).cast("int").alias("__lane"), F.lit(0).alias("__side"),
        F.col(query_id).alias("__q"), F.lit(None).cast(other).alias("__b"), F.col("embedding").cast(vectors).alias("embedding"), "__dim")
    right = _comparable(base, base_id).select(
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("__lane"), F.lit(1).alias("__side"),
        F.lit(None).cast(own).alias("__q"), F.col(base_id).alias("__b"), F.col("embedding").cast(vectors).alias("embedding"), "__dim")
    dealt = left.unionByName(right).repartitionById(lanes, F.col("__lane")).sortWithinPartitions("__lane", "__side", "__b")

    def stream(batches):
        """One lane after the other: its queries, then the base."""
        lane, asked, blocks, held, kinds = None, {}, {}, {}, None

        def ended():
            for dim in list(held):
                _flush(blocks, held, dim, block_rows)
            yield from _hits(blocks, kinds)
        for whole in batches:
            kinds = [whole.schema.field("__q").type, pa.float64(), whole.schema.field("__b").type]
            marks = 2 * whole.column("__lane").to_numpy().astype(np.int64) + whole.column("__side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                batch, here, side = whole.slice(start, end - start), int(marks[start]) // 2, int(marks[start]) % 2
                if here != lane:
                    yield from ended()
                    lane, asked, blocks, held = here, {}, {}, {}
                if side == 0:
                    for dim, found in _matrices(batch, "__q").items():
                        asked.setdefault(dim, []).append(found)
                    continue
                for dim in list(asked):
                    parts = asked.pop(dim)
                    blocks[dim] = Nearest(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), k, exclude_self)
                _search(blocks, held, batch, "__b", block_rows)
        if kinds:
            yield from ended()

    return dealt.mapInArrow(stream, _pairs(schema, base_id)).withColumnRenamed("__b", base_id)


def _values(*tables: DataFrame) -> str:
    """The type of the vectors of several tables: single precision if all have it, else double."""
    return "array<float>" if all(t.schema["embedding"].dataType == ArrayType(FloatType()) for t in tables) else "array<double>"


def _in_blocks(queries: DataFrame, base: DataFrame, schema: StructType, k: int, query_id: str, base_id: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """``_local`` for ``MAX_LOCAL_QUERIES`` queries after the other, until all are answered; each block scans the base once."""
    rows = row_index(_comparable(queries, query_id), [query_id], "__r")
    vectors, found = _comparable(base, base_id), None
    for first in range(0, max(1, rows.count()), MAX_LOCAL_QUERIES):
        known = rows.where(F.col("__r").between(first, first + MAX_LOCAL_QUERIES - 1)).toPandas()  # MAX_LOCAL_QUERIES rows at most
        for dim, part in known.groupby("__dim"):
            some = _local(part, vectors.where(F.col("__dim") == int(dim)), schema, k, query_id, base_id, exclude_self, block_rows)
            found = some if found is None else found.unionByName(some)
    return base.sparkSession.createDataFrame([], schema) if found is None else found


def top_k(queries: DataFrame, base: DataFrame, k: int, query_id: str = "ticket_id", base_id: str = "ticket_id",
          payload: tuple[str, ...] = ("category", "priority", "subject"), exclude_self: bool = False,
          category: str | None = None, strategy: str = "grid", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, <base id>, similarity, payload)`` of the k most similar rows per query, exactly.

    ``category`` restricts the base before ranking. ``grid`` suits two large sides. ``local``, for few queries, sends
    blocks of ``MAX_LOCAL_QUERIES`` of them to the tasks that scan the base, one block after the other. ``block_rows`` base rows are compared at once. Zero vectors, null and empty ones,
    and those with null or non-finite numbers match nothing; vectors of different lengths do not meet.
    """
    if category is not None:
        base = base.where(F.col("category") == category)
    narrow = base.select(base_id, "embedding")
    schema = _hit_schema(queries, narrow, query_id)
    slim = queries.select(query_id, "embedding")
    if strategy == "local":
        found = _in_blocks(slim, narrow, schema, k, query_id, base_id, exclude_self, block_rows)
    elif strategy == "grid":
        found = _grid(slim, narrow, schema, k, query_id, base_id, exclude_self, block_rows)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    best = _rank(found, k, base_id)
    return best.join(base.select(base_id, *payload), base_id).select(
        F.col("__q").alias("query_id"), "rank", base_id, F.round("similarity", 4).alias("similarity"), *payload)


def coarse_index(sample: np.ndarray, n: int, k: int, wanted: float, seed: int) -> tuple[np.ndarray, int]:
    """Centroids of cells for ``n`` vectors, and how many cells a query has to look into.

    ``sample`` holds unit vectors. There are as many cells as the root of ``n``. The number of cells to look into is the least one that
    holds the share ``wanted`` of the ``k`` nearest of up to 500 sampled vectors, among the sample itself.
    """
    draw = np.random.default_rng(seed)
    cells = int(min(MAX_CELLS, len(sample), max(1, math.isqrt(n))))
    centroids = sample[draw.choice(len(sample), cells, replace=False)]
    for _ in range(12):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), centroids)
    own = (sample @ centroids.T).argmax(1)
    asked = draw.choice(len(sample), min(500, len(sample)), replace=False)
    near = np.argpartition(-(sample[asked] @ sample.T), min(k, len(sample) - 1), axis=1)[:, :k]
    order = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1), axis=1)  # place of each cell for each query
    places = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return centroids, int(places[min(len(places) - 1, math.ceil(wanted * len(places)))]) + 1


def approximate_top_k(queries: DataFrame, base: DataFrame, k: int, query_id: str = "ticket_id", base_id: str = "ticket_id",
                      wanted: float = 0.97, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """``(query_id, rank, <base id>, similarity)`` among the rows in the cells nearest to the query, ranked exactly.

    The cells are those of a coarse index, fitted on a sample of at most ``SAMPLE`` vectors, which also says how many cells must be probed
    for the share ``wanted`` of the neighbours. All rows are indexed. A full cell is cut into parts by id, so it is many tasks. What
    ``top_k`` says of vectors that match nothing holds here, too.
    """
    left, right = _comparable(queries, query_id), _comparable(base, base_id)
    schema = _hit_schema(queries, base.select(base_id, "embedding"), query_id)
    sizes = {r["__dim"]: r["n"] for r in right.groupBy("__dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    out = None
    for dim, n in sorted(sizes.items()):
        some = right.where(F.col("__dim") == dim)
        drawn = (some if n <= SAMPLE else some.sample(min(1.0, 1.1 * SAMPLE / n), seed)).limit(SAMPLE).select("embedding").toPandas()
        sample, keep = _unit(drawn["embedding"])
        if not keep.any():
            continue
        centroids, probes = coarse_index(sample, n, k, wanted, seed)

        def placed(df: DataFrame, key: str, many: int, centroids=centroids) -> DataFrame:
            kind = StructType([df.schema[key], df.schema["embedding"], StructField("__cells", ArrayType(IntegerType()))])

            def run(batches):
                for pdf in batches:
                    unit, live = _unit(pdf["embedding"]) if len(pdf) else (np.empty((0, 1)), np.zeros(0, dtype=bool))
                    if live.any():
                        near = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :many]
                        yield pdf[live].assign(__cells=list(near.astype(np.int32)))
            return df.drop("__dim").mapInPandas(run, kind).select(key, "embedding", F.explode("__cells").alias("__cell"))
        asked, held = placed(left.where(F.col("__dim") == dim), query_id, probes), placed(some, base_id, 1)
        parts = held.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__parts"))
        asked = asked.join(parts, "__cell").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
        held = held.join(parts, "__cell").withColumn("__part", F.pmod(F.xxhash64(base_id), F.col("__parts")).cast("int")).drop("__parts")

        def pair(q, b):
            if len(q) == 0 or len(b) == 0:
                return pd.DataFrame(columns=schema.fieldNames())
            return _best(q[query_id].to_numpy(), _unit(q["embedding"])[0], b[[base_id, "embedding"]], k, base_id, False)[schema.fieldNames()]
        cell = ["__cell", "__part"]
        found = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(pair, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = base.sparkSession.createDataFrame([], schema)
    return _rank(out, k, base_id).select(
        F.col("__q").alias("query_id"), "rank", base_id, F.round("similarity", 4).alias("similarity"))


def collect_hits(hits: DataFrame) -> DataFrame:
    """One row per query with its hits as an array of at most k structs."""
    hit = F.struct("rank", "ticket_id", "similarity", "category", "priority", "subject")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two array columns; null for a zero vector."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda acc, v: acc + v)
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 4)
