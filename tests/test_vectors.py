"""Both ways of the nearest-ticket join against a full matrix."""

import numpy as np
import pytest

from ticketflow.functions.prompts import format_context
from ticketflow.operators.vectors import approximate_top_k, attach_vectors, collect_hits, cosine, top_k
from pyspark.sql import functions as F

SCHEMA = "ticket_id string, embedding array<float>, category string, priority string, subject string"


def table(spark, matrix, prefix="v"):
    rows = [(f"{prefix}{i:04d}", [float(x) for x in v], "bug" if i % 3 else "docs", "low", f"s{i}") for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def truth(queries, base, k, prefix="v", exclude_self=False, keep=None):
    def unit(m):
        m = np.asarray(m, dtype=np.float32).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1), n[:, 0] > 0
    q, qok = unit(queries)
    b, bok = unit(base)
    sims = np.round(q @ b.T, 10)
    out = {}
    for i in range(len(q)):
        if not qok[i]:
            continue
        ranked = sorted((-sims[i, j], j) for j in range(len(b)) if bok[j] and not (exclude_self and i == j)
                        and (keep is None or keep(j)))
        out[f"{prefix}{i:04d}"] = [(f"v{j:04d}", round(-s, 4)) for s, j in ranked[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["ticket_id"], r["similarity"]))
    return out


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(7)
    clusters = np.concatenate([rng.normal(size=8) * 5 + rng.normal(scale=0.1, size=(40, 8)) for _ in range(6)])
    copies = np.concatenate([np.tile(rng.normal(size=8), (80, 1)), rng.normal(size=(120, 8)), np.zeros((3, 8))])
    return {"clusters": clusters, "copies": copies, "noise": rng.normal(size=(150, 8))}


@pytest.mark.parametrize("strategy", ["local", "grid"])
@pytest.mark.parametrize("shape", ["clusters", "copies", "noise"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_against_full_matrix(spark, shapes, shape, strategy, exclude_self):
    matrix = shapes[shape]
    rows = table(spark, matrix)
    got = found(top_k(rows, rows, 4, exclude_self=exclude_self, strategy=strategy, block_rows=32))
    assert got == truth(matrix, matrix, 4, exclude_self=exclude_self)


def test_category_before_ranking(spark, shapes):
    matrix = shapes["noise"]
    rows = table(spark, matrix)
    got = found(top_k(rows, rows, 3, category="docs"))
    assert got == truth(matrix, matrix, 3, keep=lambda j: j % 3 == 0)


def test_fewer_rows_than_k(spark, shapes):
    rows = table(spark, shapes["noise"][:3])
    for strategy in ("local", "grid"):
        got = found(top_k(rows, rows, 10, strategy=strategy, block_rows=2))
        assert all(len(v) == 3 for v in got.values()) and len(got) == 3


def test_vectors_that_cannot_be_compared(spark):
    """Null, empty, broken and zero vectors match nothing; vectors of different lengths do not meet."""
    nan = float("nan")
    vectors = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": None, "d": [], "e": [1.0, None], "f": [nan, 1.0], "g": [0.0, 0.0],
               "h": [1.0, 0.0, 0.0], "i": [0.0, 1.0, 0.0], "j": [float("inf"), 1.0]}
    rows = spark.createDataFrame([(i, v, "docs", "low", i) for i, v in vectors.items()],
                                 "ticket_id string, embedding array<double>, category string, priority string, subject string")
    wanted = {"a": [("a", 1.0), ("b", 0.9939)], "b": [("b", 1.0), ("a", 0.9939)], "h": [("h", 1.0), ("i", 0.0)], "i": [("i", 1.0), ("h", 0.0)]}
    for strategy in ("local", "grid"):
        assert found(top_k(rows, rows, 5, strategy=strategy)) == wanted
        assert found(top_k(rows.where("ticket_id = 'c'"), rows, 5, strategy=strategy)) == {}
    assert found(approximate_top_k(rows, rows, 5)) == wanted
    assert found(approximate_top_k(rows, rows.where("ticket_id = 'c'"), 5)) == {}


def test_registered_local_query_answers_beyond_the_bound(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from ticketflow.operators import vectors
    wanted = entry.queries()["topk_cosine"](spark, sf).collect()
    monkeypatch.setattr(vectors, "MAX_LOCAL_QUERIES", 10)
    assert sorted(entry.queries()["topk_local"](spark, sf).collect()) == sorted(wanted)


@pytest.mark.parametrize("shape", ["clusters", "noise"])
def test_approximate_search_finds_most(spark, shapes, shape):
    matrix = shapes[shape]
    rows = table(spark, matrix)
    wanted = truth(matrix, matrix, 3)
    got = found(approximate_top_k(rows, rows, 3))
    right = sum(len(set(wanted[q]) & set(got.get(q, []))) for q in wanted)
    assert right >= 0.9 * sum(map(len, wanted.values()))


def test_context_block(spark):
    hits = [("q", 2, "b", 0.29, "docs", "low", "two"), ("q", 1, "a", 0.9999, "bug", "high", "one")]
    df = spark.createDataFrame(hits, "query_id string, rank int, ticket_id string, similarity double, category string, priority string, subject string")
    row = collect_hits(df).select(format_context(F.col("hits"))).first()[0]
    assert row == ("[Ticket 1 | Similarity: 99% | Category: bug | Priority: high]\nSubject: one\n\n"
                   "[Ticket 2 | Similarity: 28% | Category: docs | Priority: low]\nSubject: two")
    empty = df.select(format_context(F.array().cast("array<struct<rank:int,similarity:double,category:string,priority:string,subject:string>>"))).first()[0]
    assert empty == "No similar historical tickets found."


def test_cosine_and_attach(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, None]
    rows = spark.createDataFrame([("x",), ("y",)], "ticket_id string")
    vecs = spark.createDataFrame([("y", [1.0])], "ticket_id string, embedding array<float>")
    assert [tuple(r) for r in attach_vectors(rows, vecs).collect()] == [("y", [1.0])]


def test_queries_are_sent_once_whatever_the_block(spark, shapes):
    """Only base rows are copied, once per lane of queries; smaller blocks make no more copies."""
    rows = table(spark, np.tile(shapes["noise"], (2, 1)))
    plans = [top_k(rows, rows, 4, block_rows=n)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 64)]
    assert [p.count("Generate explode") for p in plans] == [1, 1]


@pytest.mark.parametrize("exclude_self", [False, True])
def test_tiles_in_single_precision_rank_as_doubles(exclude_self):
    """Copies, near copies within single precision, and repeated ids."""
    from ticketflow.operators.vectors import DIGITS, Nearest
    rng = np.random.default_rng(3)
    one = rng.normal(size=16)
    base = np.concatenate([np.tile(one, (40, 1)), one + rng.normal(scale=1e-7, size=(40, 16)), rng.normal(size=(60, 16)), np.zeros((2, 16))])
    ids = np.array([f"v{i // 2:03d}" for i in range(len(base))], object)
    found = Nearest(ids, base, 5, exclude_self)
    for at in range(0, len(base), 9):
        found.add(ids[at:at + 9], base[at:at + 9])
    unit = base[:-2] / np.linalg.norm(base[:-2], axis=1)[:, None]
    sims = np.round(unit @ unit.T, DIGITS)
    for i in range(len(unit)):
        wanted = sorted((-sims[i, j], j) for j in range(len(unit)) if not (exclude_self and ids[i] == ids[j]))[:5]
        assert found.sims[i].tolist() == pytest.approx([-s for s, _ in wanted], abs=2e-10)
    assert [[ids[j] for _, j in sorted((-sims[i, j], j) for j in range(len(unit)) if not (exclude_self and ids[i] == ids[j]))[:5]] for i in range(80, 140)] == found.found[80:140].tolist()


def test_memory_of_a_search_is_that_of_a_tile(spark):
    """10,000 queries against a batch of 10,000 rows: before, tiles of 1024 x 10,000 doubles were held several times."""
    import tracemalloc

    import pyarrow as pa
    from ticketflow.operators import vectors
    matrix = np.random.default_rng(5).normal(size=(10_000, 32)).astype(np.float32)
    ids = np.array([f"v{i:05d}" for i in range(len(matrix))], object)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(matrix)), pa.array(np.full(len(matrix), 32, np.int32))], ["ticket_id", "embedding", "__dim"])
    blocks, held = {32: vectors.Nearest(ids, matrix, 5, False)}, {}
    tracemalloc.start()
    vectors._search(blocks, held, batch, "ticket_id", vectors.BLOCK_ROWS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and not held and (blocks[32].found[:, 0] == ids).all()


def test_few_base_rows_are_compared_in_double_precision(monkeypatch):
    """Queries without a k-th best have whole tiles computed in double precision; before, that was all of the first block."""
    from ticketflow.operators import vectors
    rng = np.random.default_rng(11)
    base, asked = rng.normal(size=(3000, 16)).astype(np.float32), rng.normal(size=(500, 16)).astype(np.float32)
    ids = np.array([f"v{i:04d}" for i in range(len(base))], object)
    widths, whole = [], vectors.Nearest._all
    monkeypatch.setattr(vectors.Nearest, "_all", lambda self, asked, base, *more: widths.append(len(base)) or whole(self, asked, base, *more))
    found = vectors.Nearest(np.arange(500).astype(object), asked, 3, False)
    found.add(ids, base)
    assert max(widths) <= 256
    unit = [x / np.linalg.norm(x.astype(float), axis=1)[:, None] for x in (asked, base)]
    sims = np.round(unit[0] @ unit[1].T, vectors.DIGITS)
    assert found.found.tolist() == [ids[np.lexsort((np.arange(len(base)), -row))[:3]].tolist() for row in sims]


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_marks_are_found_eight_at_a_time(share):
    from ticketflow.operators.vectors import _marked
    marks = np.random.default_rng(2).random(8 * 123) < share
    assert _marked(marks).tolist() == np.flatnonzero(marks).tolist()
