"""The ordinal model: its gradient's optimum, held-out accuracy, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow.llm import quality
from ticketflow.llm.common import table

from .helpers import documents

LABELS = "doc_id long, quality int, toxic int, grade int"


def test_held_out_documents(spark):
    """Fitted on documents with even ids, judged on the others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rest = quality.graded(docs, model).join(quality.rated(labels.where("doc_id % 2 = 1")), "doc_id").withColumn(
        "kept", F.col("p_at_least_2") >= quality.KEEP_AT)
    kept = {r["grade"]: r["share"] for r in rest.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[0] < 0.08 and kept[1] < 0.08 and kept[2] > 0.98, kept  # from 2,000 ratings
    order = {r["grade"]: r["g"] for r in rest.groupBy("grade").agg(F.avg("expected_grade").alias("g")).collect()}
    assert order[0] < order[1] < order[2]


def test_thresholds_are_ordered_and_likelihood_is_at_its_top():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)) < 0.4
    score = x @ np.array([2.0, -2.0, 1.0, 0.0, 0.0, -1.0]) + rng.logistic(size=3000)
    grades = np.digitize(score, [-0.5, 1.5])
    samples = [np.flatnonzero(r).astype(np.uint32) for r in x]
    model = quality.fit(samples, grades, rounds=800)
    assert model.thresholds[0] < model.thresholds[1]
    weights = dict(zip(model.keys.tolist(), model.weights))
    assert weights[0] > weights[2] > 0 > weights[5] > weights[1]

    def loss(w, cuts):
        m = quality.Model(model.keys, w, cuts)
        tails = m.tails(np.array([m.score(s) for s in samples]))
        p = np.column_stack([np.ones(len(tails)), tails, np.zeros(len(tails))])
        p = p[np.arange(len(p)), grades] - p[np.arange(len(p)), grades + 1]
        return -(np.log(p) / np.bincount(grades)[grades]).sum() / 3 + quality.RIDGE / 2 * (w ** 2).sum()
    best = loss(model.weights, model.thresholds)
    for i in range(len(model.weights)):
        for step in (-0.1, 0.1):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved, model.thresholds) > best - 1e-4


def test_tails_fall_and_add_up():
    m = quality.Model(np.array([3, 9], np.uint32), np.array([1.0, -2.0]), np.array([-1.0, 0.5]))
    assert m.score(np.array([3, 5], np.uint32)) == 1.0 and m.score(np.zeros(0, np.uint32)) == 0.0
    tails = m.tails(np.array([-50.0, 0.0, 50.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and tails[2].sum() == pytest.approx(2.0)


def test_odd_tables(spark):
    docs = documents(spark, [(1, "good text"), (2, None), (3, ""), (None, "x"), (1, "good text"), (4, "word " * 50_000)])
    none = spark.createDataFrame([], LABELS)
    assert quality.good(docs, none).count() == 6 and quality.good(docs, none).columns == docs.columns
    labels = spark.createDataFrame([(1, 1, 0, 9), (1, 0, 1, 9), (2, None, None, 9), (3, None, 1, 9), (None, 1, 0, 9), (4, 1, None, 9)], LABELS)
    assert {r["doc_id"]: r["grade"] for r in quality.rated(labels).collect()} == {1: 0, 3: 0, 4: 2}
    rows = quality.graded(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r["p_at_least_2"] <= r["p_at_least_1"] <= 1 for r in rows)
    only_bad = quality.train(docs, spark.createDataFrame([(1, 0, 0, 0)], LABELS))
    assert quality.graded(docs, only_bad).where("p_at_least_2 > 0.5 or p_at_least_1 < 0.5").count() == 0
    assert quality.graded(documents(spark, []), only_bad).count() == 0


def test_a_bounded_sample_reaches_the_driver(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    few = quality.train(docs, labels, sample=5)
    assert len(few.keys) == 0 and len(few.thresholds) == 2
    assert quality.op3(spark, sf).columns == ["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "kept"]
