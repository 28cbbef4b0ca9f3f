"""Whitening of vectors by spectral divide-and-conquer.

A vector's components become whole numbers ``floor(256 c)``. Each distinct vector of whole numbers counts once: their number and
sums are exact, and the covariance is the sum of centred products, added up per task and then per cell. The covariance is as
large as the square of the dimension, whatever the number of rows; it is taken apart on the driver. The polar factor ``U`` of
``V - s I``, by the QR form of the dynamically weighted Halley iteration, gives the projector ``(U + I) / 2`` onto the space of all
eigenvalues above ``s``. Bases of that space and of the rest turn ``V`` into two blocks, which are split in the same way until
a block is one component, or a multiple of the identity. Blocks that hold no wanted component are left alone. Components, means and
scales are sent to the tasks, and rows are whitened where they lie.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, stage
from .registry import query

COMPONENTS, SCALE = 4, 256
#: Below this share of the largest variance, a component is rounding error: it has no whitened values.
FLAT = 1e-11
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix without a zero eigenvalue."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(np.linalg.qr(x, "r")))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low if np.isfinite(low) else 0.0, 1e-17), 1.0)
    for _ in range(20):
        if 1 - low < 1e-15:
            break
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = (1 + d) ** 0.5
        alpha = root + 0.5 * max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)) ** 0.5
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack((gamma ** 0.5 * x, np.eye(n))))
        x = beta / gamma * x + (alpha - beta / gamma) / gamma ** 0.5 * (q[:n] @ q[n:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (alpha + beta * square) / (1 + gamma * square))
    return x


def divided(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first ``r`` columns span the larger eigenvalues; None for a multiple of the identity."""
    n = len(a)
    middle = np.trace(a) / n
    spread, size = np.linalg.norm(a - middle * np.eye(n)), np.linalg.norm(a)
    if spread <= 4 * np.finfo(float).eps * size:
        return None
    low, high, shift, best = middle - spread, middle + spread, float(np.median(np.diag(a))), None
    draw = np.random.default_rng(0)
    for _ in range(80):
        p = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        r = int(round(float(np.trace(p))))
        if 0 < r < n:
            start = draw.standard_normal((n, n))
            q, _ = np.linalg.qr(np.hstack((p @ start[:, :r], start[:, r:] - p @ start[:, r:])))
            q, _ = np.linalg.qr(np.hstack((p @ q[:, :r], q[:, r:] - p @ q[:, r:])))
            left = np.linalg.norm(q[:, :r].T @ a @ q[:, r:])
            if best is None or left < best[0]:
                best = left, q, r
            if left <= 1e-14 * n * size:  # else an eigenvalue lies too near to the shift
                break
            shift = low + (high - low) * draw.uniform(0.2, 0.8)
            continue
        low, high = (shift, high) if r == n else (low, shift)
        shift = low + (high - low) * draw.uniform(0.4, 0.6)
        if high - low <= 4 * np.finfo(float).eps * size:
            break
    return best and best[1:]


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors in columns."""
    n = len(v)
    k = min(k, n)
    cut = divided(v) if n > 1 and k else None
    if cut is None:
        return np.diag(v)[:k].copy(), np.eye(n)[:, :k]
    q, r = cut
    found = []
    for basis, some in ((q[:, :r], min(k, r)), (q[:, r:], k - min(k, r))):
        if some:
            block = basis.T @ v @ basis
            found.append(basis @ components((block + block.T) / 2, some)[1])
    w = np.hstack(found)
    w /= np.sqrt((w * w).sum(0))
    e = (w * (v @ w)).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order], w[:, order]


def whole_numbers(batch: pa.RecordBatch, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in column ``at``: the rows, and their vectors as whole numbers."""
    column = batch.column(at)
    ends = column.offsets.to_numpy()
    values, size = np.asarray(column.values), np.diff(ends)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        c = np.floor(SCALE * values[ends[rows][:, None] + np.arange(d)])
        x = np.where(np.abs(c) < 2.0 ** 63, c, 0).astype(np.int64)
        x[c >= 2.0 ** 63] = np.iinfo(np.int64).max
        x[c <= -2.0 ** 63] = np.iinfo(np.int64).min
        out.append((rows, x))
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in as few bytes a number as hold the row's largest one."""
    top = np.maximum(x.max(1, initial=0), -(x.min(1, initial=0) + 1))
    return [row.astype("<i2" if t < 1 << 15 else "<i4" if t < 1 << 31 else "<i8").tobytes() for row, t in zip(x, top)]


def unpacked(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    """``(dim, x)`` of a batch of ``dim`` and ``x``."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        groups.setdefault((d, len(b) // max(d, 1)), []).append(b)
    return [(d, np.frombuffer(b"".join(some), f"<i{width or 8}").reshape(len(some), d).astype(np.int64))
            for (d, width), some in groups.items()]


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding array<double>)`` of the rows whose vector is not null and holds finite numbers only."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .where(F.col("embedding").isNotNull() & finite))


def fit_list(rows: DataFrame) -> DataFrame:
    """``(dim, x)``: each distinct vector of whole numbers once, written out."""
    def run(batches):
        for batch in batches:
            for _, x in whole_numbers(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(packed(x), pa.binary())],
                                                 ["dim", "x"])
    return stage(rows.select("embedding").mapInArrow(run, "dim int, x binary").distinct(), "fit")


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension the number of vectors and their exact sums."""
    def run(batches):
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for d, x in unpacked(batch):
                n, s = held.get(d, (0, [0] * d))
                small = d == 0 or max(-int(x.min()), int(x.max())) < 1 << 40  # a batch has under 2**22 rows
                part = x.sum(0).tolist() if small else x.astype(object).sum(0).tolist()
                held[d] = n + len(x), [a + b for a, b in zip(s, part)]
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (d or 1), pa.int32()), pa.array(range(d or 1), pa.int32()), pa.array([n] * (d or 1), pa.int64()),
                 pa.array([Decimal(v) for v in s or [0]], pa.decimal128(38, 0))], ["dim", "i", "n", "s"])
    cells = fit.mapInArrow(run, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "i").collect()  # as many as dimensions
    out: dict[int, tuple[int, list[int]]] = {}
    for r in cells:
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return {d: (n, s if d else []) for d, (n, s) in out.items()}


def sums_of_products(fit: DataFrame, turn: dict) -> dict[int, np.ndarray]:
    """For each dimension the matrix of sums of products of ``(x - mean) @ columns``; ``turn`` has mean and columns (None: as
    they are)."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in unpacked(batch):
                if d in turn:
                    mean, columns = turn[d]
                    y = x - mean if columns is None else (x - mean) @ columns
                    held[d] = held.get(d, 0) + y.T @ y
        for d, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()),
                                              pa.array(g.tolist(), pa.list_(pa.float64()))], ["dim", "i", "v"])
    cells = (fit.mapInArrow(run, "dim int, i int, v array<double>").select("dim", "i", F.posexplode("v").alias("j", "v"))
             .groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect())  # the square of the dimension
    out: dict[int, np.ndarray] = {}
    for d in {r["dim"] for r in cells}:
        own = [r for r in cells if r["dim"] == d]
        out[d] = np.zeros((max(r["i"] for r in own) + 1,) * 2)
        for r in own:
            out[d][r["i"], r["j"]] = r["v"]
    return out


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """For each row of ``vectors`` (``vec_id``, ``embedding``) and each of its first ``k`` components: ``vec_id, component, n,
    deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds null or non-finite entries have no result, nor have empty vectors, which have no
    components; a vector of fewer than ``k`` entries has as many components. Vectors of each length are fitted on their own. Repeated rows,
    and null or equal ids, each have their results. ``deviation`` is null beyond the range of long; entries beyond it are clamped
    to it. A component whose variance is nil (``FLAT``) has a null ``whitened`` and is left out of ``identity_error``, which is null if all are;
    ``explained`` is null if nothing varies. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors)
    fit = fit_list(rows)
    known = moments(fit)
    means = {d: np.array([v / n for v in s]) for d, (n, s) in known.items() if d}
    turn, model = {}, {}
    for d, g in sums_of_products(fit, {d: (m, None) for d, m in means.items()}).items():
        n, s = known[d]
        v = g / n
        e, w = components((v + v.T) / 2, k)
        total = float(np.trace(v))
        live = e > FLAT * max(float(e[0]), 0.0)
        scaled = np.where(live, w / np.sqrt(np.where(live, e, 1.0)), 0.0)
        model[d] = n, s, means[d], scaled, live, [float(x) / total if total > 0 else None for x in e]
        if live.any():
            turn[d] = means[d], scaled[:, live]
    errors = {d: float(np.abs(g / known[d][0] - np.eye(len(g))).max()) for d, g in sums_of_products(fit, turn).items()}

    def run(batches):
        for batch in batches:
            for at, x in whole_numbers(batch, 1):
                d = x.shape[1]
                if d not in model:
                    continue
                n, s, mean, scaled, live, explained = model[d]
                z = (x - mean) @ scaled
                reach = n * max(-int(x.min()), int(x.max()), 1) + max(map(abs, s))
                if reach * reach * d < 1 << 62:
                    away = ((n * x - np.array(s, np.int64)) ** 2).sum(1).tolist()
                else:
                    away = [a if a < 1 << 63 else None
                            for a in (sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x.tolist())]
                ids = batch.column(0).take(pa.array(at)).to_pylist()
                c = len(live)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i in ids for _ in range(c)], pa.int64()), pa.array(list(range(1, c + 1)) * len(ids), pa.int32()),
                     pa.array([n] * (c * len(ids)), pa.int64()), pa.array([a for a in away for _ in range(c)], pa.int64()),
                     pa.array(np.where(live, z, 0).ravel(), pa.float64(), mask=np.tile(~live, len(ids))),
                     pa.array(explained * len(ids), pa.float64()), pa.array([errors.get(d)] * (c * len(ids)), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, SCHEMA + ", identity_error double")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
