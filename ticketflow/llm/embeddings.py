"""Near-duplicate vectors by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the nearest of the
vectors ``+e_i, -e_i``. Each of ``TABLES`` tables joins ``FUNCTIONS`` hashes to one bucket. A vector lies in its own bucket
of each table and also looks into the buckets where one hash is replaced by the second nearest vector (multiprobe).
Vectors that meet are compared in double precision, so no wrong pair is ever linked.

Identical vectors are one class. Buckets that hold nobody else are dropped while rows are still narrow. Full ones are cut
into blocks that are compared two by two; a task returns how many links each class has and edges that connect
what is linked, never the pairs themselves. A pair is counted in the first bucket where it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table
from .registry import query

THRESHOLD, TABLES, FUNCTIONS, BLOCK = 0.98, 8, 3, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their number of columns is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, seed: int = 1) -> np.ndarray:
    """``(rows, tables, 1 + functions)`` bucket codes of unit vectors: the own bucket, then those with one hash replaced."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, functions, 3, width))
    out = np.empty((n, tables, 1 + functions), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, second = np.empty((functions, n), np.int64), np.empty((functions, n), np.int64)
        for f in range(functions):
            y = padded
            for s in signs[t, f]:
                y = hadamard(y * s)
            size = np.abs(y)
            for best in (first, second):
                at = size.argmax(1)
                best[f] = 2 * at + (y[rows, at] < 0)
                size[rows, at] = -1
        base = np.array([(2 * width) ** f for f in range(functions)])[:, None]
        own = (first * base).sum(0)
        out[:, t, 0] = own
        for f in range(functions):
            out[:, t, 1 + f] = own + (second[f] - first[f]) * base[f]
    return out


def unit(values: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one without overflow."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(v, kind: str) -> bytes | None:
    if v is None or len(v) == 0:
        return None
    try:
        a = np.array([np.nan if c is None else c for c in v] if isinstance(v, list) else v, kind) + 0.0  # no negative zero
    except (TypeError, ValueError):
        return None
    return a.tobytes() if np.isfinite(a).all() and a.any() else None


def _groups(batches, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of each run of equal keys, over the borders of batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
        for a, b in zip(starts[:-1], starts[1:]):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[starts[-1]:]
    if rest is not None and len(rest):
        yield rest


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, functions: int = FUNCTIONS,
                 block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Vectors of one label and length are linked if their cosine reaches ``threshold`` and they meet in a bucket. Null, empty
    and zero vectors, vectors with null or non-finite components, and rows with null label or vec_id link with nothing
    (0 links, own id, kept; null id: both null). ``component_id`` is the smallest vec_id that links reach, and the vector
    with that id is kept. Rows equal in id, label and vector are one vector; links of other rows that share an id are pooled.
    An empty table gives no rows; other columns are ignored.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    item = np.dtype(kind).itemsize

    def as_bytes(batches):
        for pdf in batches:
            pdf["v"] = [_usable(v, kind) for v in pdf["embedding"]]
            yield pdf[["vec_id", "label", "v"]]

    rows = cut(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
               .mapInPandas(as_bytes, "vec_id long, label long, v binary"))
    usable = rows.where("vec_id is not null and label is not null and v is not null")
    classes = cut(usable.distinct().groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))

    def hashed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["v"].str.len()
            for n, some in pdf.groupby(size):
                x = unit(np.frombuffer(b"".join(some["v"]), kind).reshape(len(some), n // item))
                codes = buckets(x, tables, functions)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "label": some["label"].to_numpy(), "n": some["n"].to_numpy(),
                                    "dim": n // item, "v": some["v"].to_numpy(), "codes": [c.tobytes() for c in codes],
                                    "places": [[{"t": t, "code": int(c), "own": p == 0} for t in range(tables)
                                                for p, c in enumerate(row[t])] for row in codes]})
    known = cut(classes.mapInPandas(hashed, "id long, label long, n long, dim int, v binary, codes binary, "
                                            "places array<struct<t: int, code: long, own: boolean>>"))
    bucket = ["label", "dim", "t", "code"]
    narrow = known.select("id", "label", "dim", F.explode("places").alias("p")).select(
        "id", "label", "dim", "p.t", "p.code", "p.own")
    full = (narrow.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members"), F.max("own").alias("home"))
            .where("members > 1 and home"))
    met = narrow.join(full.drop("home"), bucket).withColumn("blocks", F.ceil(F.col("members") / F.lit(block)).cast("int"))
    block_of = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = (met.select(*bucket, "id", "own", block_of.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
             .select(*bucket, "id", "own", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b"))
    unit_of_work = [*bucket, "i", "j"]
    work = (pairs.join(known.select("id", "label", "dim", "n", "v", "codes"), ["id", "label", "dim"])
            .repartition(*unit_of_work).sortWithinPartitions(*unit_of_work, "id"))

    def compared(batches):
        out = []
        for g in _groups(batches, unit_of_work):
            if len(g) < 2:
                continue
            head = g.iloc[0]
            x = unit(np.frombuffer(b"".join(g["v"]), kind).reshape(len(g), -1))
            side, own, ids, weight = (g[c].to_numpy() for c in ("b", "own", "id", "n"))
            linked = (x @ x.T >= threshold) & (own[:, None] | own[None, :]) & (ids[:, None] != ids[None, :])
            if head["i"] != head["j"]:
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(linked, 1))
            if not len(a):
                continue
            codes = np.frombuffer(b"".join(g["codes"]), np.int64).reshape(len(g), tables, 1 + functions)
            counted = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 14):  # the first bucket where a pair meets counts it
                ca, cb = codes[a[at:at + (1 << 14)]], codes[b[at:at + (1 << 14)]]
                one = (ca[:, :, :1] == cb).any(2)
                two = (cb[:, :, :1] == ca).any(2)
                t = (one | two).argmax(1)
                r = np.arange(len(t))
                counted[at:at + (1 << 14)] = (t == head["t"]) & (
                    np.where(one[r, t], ca[r, t, 0], cb[r, t, 0]) == head["code"])
            links = (np.bincount(a[counted], weight[b[counted]], len(g)) + np.bincount(b[counted], weight[a[counted]], len(g)))
            low = ids.copy()
            while True:  # smallest id of what is connected here
                new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1))
                if (new == low).all():
                    break
                low = new
            some = (links > 0) | (low != ids)
            out.append(pd.DataFrame({"a": ids[some], "b": low[some], "links": links[some].astype(np.int64)}))
            if len(out) >= 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    found = cut(work.mapInPandas(compared, "a long, b long, links long"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    roots = components(found.select("a", "b")).withColumnRenamed("node", "id")
    labelled = (classes.join(counts, "id", "left").join(roots, "id", "left")
                .select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("root", "id").alias("component_id")))
    out = rows.join(labelled, ["label", "v"], "left").withColumn(
        "known", F.col("vec_id").isNotNull() & F.col("n_links").isNotNull())
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("known"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: All pairs, for tables small enough for them.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reached(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT pairs.b, reached.r FROM reached JOIN pairs ON reached.n = pairs.a),
roots AS (SELECT n, min(r) AS r FROM reached GROUP BY n),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, coalesce(c.r, e.vec_id) AS component_id, coalesce(c.r, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN roots c ON c.n = e.vec_id
"""


@query("op9_embedding_near_dedup", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
