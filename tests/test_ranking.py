"""Global positions, cuts and running sums against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from ticketflow.operators.evaluate import auc
from ticketflow.operators.log import latency_stats
from ticketflow.operators.ranking import row_index, rows_at, running_sums
from ticketflow.operators.split import sample_n, time_split


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one time."""
    rng = random.Random(1)
    rows = [(f"id-{i:05d}", 500 if rng.random() < 0.34 else rng.randrange(1000)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id string, v long").repartition(7)


def test_row_index(hot):
    rows, df = hot
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["id"]: r["n"] for r in row_index(df, ["v", "id"], "n", start=5).collect()}
    assert got == {r[0]: i + 5 for i, r in enumerate(order)}


def test_running_sums(hot):
    rows, df = hot
    order, ahead, truth = sorted(rows, key=lambda r: (r[1], r[0])), 0, {}
    for r in order:
        truth[r[0]] = ahead
        ahead += r[1]
    got = {r["id"]: r["before_v"] for r in running_sums(df, ["v", "id"], ["v"]).collect()}
    assert got == truth


@pytest.mark.parametrize("fractions", [[0.0, 0.5], [0.7, 0.85], [0.4999, 0.99], [1.0]])
def test_rows_at(hot, fractions):
    rows, df = hot
    order = sorted((v, i) for i, v in rows)
    n, found = rows_at(df, F.col("v"), ["id"], fractions, lambda n, f: int(n * f))
    assert n == len(rows)
    for f, r in zip(fractions, found):
        place = int(n * f)
        assert (r is None) if place >= n else ((r["_lead"], r["id"]) == order[place])


def test_rows_at_empty(hot):
    _, df = hot
    assert rows_at(df.limit(0), F.col("v"), ["id"], [0.5], lambda n, f: int(n * f)) == (0, [None])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(i, f"{i:04d}") for i in range(n)], "t long, id string")
    got = {r["split"]: r["count"] for r in time_split(df, "t", "id").groupBy("split").count().collect()}
    a, b = int(n * 0.70), int(n * (0.70 + 0.15))
    assert [got.get(s, 0) for s in ("train", "val", "test")] == [a, b - a, n - b]


def test_split_hot_time(hot):
    rows, df = hot
    order = [i for v, i in sorted((v, i) for i, v in rows)]
    cut = (int(len(rows) * 0.70), int(len(rows) * (0.70 + 0.15)))
    truth = {i: "train" if k < cut[0] else "val" if k < cut[1] else "test" for k, i in enumerate(order)}
    assert {r["id"]: r["split"] for r in time_split(df, "v", "id").collect()} == truth


def test_p99_is_an_element(spark):
    for values in ([3.0], [float(i) for i in range(200)], [1.0] * 150 + [9.0] * 3):
        df = spark.createDataFrame([(v,) for v in values], "ms double")
        row = latency_stats(df, "ms").first()
        assert row["p99_ms"] == sorted(values)[int(0.99 * len(values))]
        assert row["n"] == len(values)


def test_sample_is_stable(hot):
    _, df = hot
    first = {r["id"] for r in sample_n(df, 50, "id").collect()}
    again = {r["id"] for r in sample_n(df.repartition(3), 50, "id").collect()}
    assert first == again and len(first) == 50


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.1, 0.2, 0.2, 0.5, 0.9, rng.random()]), int(rng.random() < 0.3)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    truth = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert abs(got["auc"] - truth) < 1e-12
    assert auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()["auc"] is None


