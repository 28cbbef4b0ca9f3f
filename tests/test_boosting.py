"""Boosting: splits by hand, blocks near and far, patience, and metrics of stored scores."""

import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow.operators import boosting as B
from ticketflow.operators import models as m

NAMES = ["a", "b", "c"]


def table(spark, n, seed, noise=0.0):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 40, (n, 3))
    y = ((x[:, 0] > 20) ^ (x[:, 1] > 10)) ^ (draw.random(n) < noise)
    return spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, label int")


def test_best_split_against_all_splits():
    draw, s = np.random.default_rng(1), B.Settings(least_rows=5)
    for _ in range(20):
        g, n = draw.normal(size=B.BINS), draw.integers(0, 6, B.BINS).astype(float)
        h = n * 0.2
        want = [(g[:k].sum() ** 2 / h[:k].sum() + g[k:].sum() ** 2 / h[k:].sum() - g.sum() ** 2 / h.sum(), k - 1)
                for k in range(1, B.BINS) if min(n[:k].sum(), n[k:].sum()) >= 5]
        gain, at, gs, hs = B.best_split(np.stack([g, h, n]), s)
        assert gain == pytest.approx(max(want)[0]) and at == max(want)[1] and (gs, hs) == pytest.approx((g.sum(), h.sum()))
    assert B.best_split(np.zeros((3, B.BINS)), s)[0] == 0.0


def test_blocks_near_and_far_give_one_model(spark, monkeypatch):
    monkeypatch.setattr(B, "KEPT", 2)
    train, val = table(spark, 900, 1).repartition(3), table(spark, 300, 2)
    s = B.Settings(trees=5, depth=3)
    near, far = B.boost(train, val, NAMES, settings=s), B.boost(train, val, NAMES, settings=s, near_rows=0)
    assert near.losses == pytest.approx(far.losses) and len(near.trees) == len(far.trees) == 5
    x = np.random.default_rng(0).integers(0, 60, (3, 500))
    assert near.margin(x) == pytest.approx(far.margin(x), abs=1e-6)


def test_patience_keeps_the_best_round(spark):
    """Each round gains less than one per cent, which must not end the training; noise ends it."""
    train, val = table(spark, 1500, 1, 0.25), table(spark, 500, 2, 0.25)
    s = B.Settings(trees=300, patience=15, rate=0.02, depth=3)
    model = B.boost(train, val, NAMES, settings=s)
    gains = -np.diff(model.losses) / model.losses[:-1]
    assert len(model.trees) > 50 and gains.max() < 0.01
    assert model.losses[len(model.trees)] == min(model.losses)
    assert len(model.losses) == 301 or len(model.losses) - 1 == len(model.trees) + 15
    sudden = B.boost(train, val, NAMES, settings=B.Settings(trees=300, patience=3, rate=0.9))
    assert len(sudden.losses) - 1 == len(sudden.trees) + 3 < 300


def test_no_rows_one_class_nulls_and_no_validation(spark):
    empty = table(spark, 5, 1).where("false")
    assert B.boost(empty, empty, NAMES).trees == []
    one = B.boost(table(spark, 200, 1).withColumn("label", F.lit(1)), empty, NAMES, settings=B.Settings(trees=2))
    assert len(one.trees) == 2 and one.margin(np.zeros((3, 1), int))[0] > 5
    rows = table(spark, 300, 3).withColumn("a", F.when(F.col("a") > 20, F.col("a")))
    model = B.boost(rows, rows.limit(50), NAMES, settings=B.Settings(trees=3))
    out = rows.select("*", model.probability().alias("p")).collect()
    assert len(out) == 300 and all(0 < r["p"] < 1 for r in out)


def test_saved_model_and_metrics_of_stored_scores(spark, tmp_path):
    from ticketflow.operators import evaluate as ev
    train, val, test = table(spark, 1500, 1, 0.1), table(spark, 400, 2, 0.1), table(spark, 400, 3, 0.1)
    model = B.boost(train, val, NAMES, settings=B.Settings(trees=60, depth=3, rate=0.2))
    m.save_model(model, str(tmp_path / "model"))
    again = B.Boosted.restored(spark.read.parquet(str(tmp_path / "model")), NAMES)
    assert again.losses == model.losses and again.cuts == model.cuts and len(again.trees) == len(model.trees)
    test.select("label", again.probability().alias("p")).withColumn("hit", (F.col("p") >= 0.5).cast("int")).write.parquet(str(tmp_path / "scores"))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    auc = ev.auc(scores, "p", "label").first()["auc"]
    metrics = ev.binary_metrics(scores, "label", "hit").first().asDict()
    want = duckdb.connect().execute(f"""
        WITH s AS (FROM '{tmp_path}/scores/*.parquet')
        SELECT (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.label = 1 AND b.label = 0),
               count(*) FILTER (WHERE hit = 1 AND label = 1) / count(*) FILTER (WHERE hit = 1),
               count(*) FILTER (WHERE hit = 1 AND label = 1) / count(*) FILTER (WHERE label = 1) FROM s""").fetchall()[0]
    assert (auc, metrics["precision"], metrics["recall"]) == pytest.approx(want)
    assert auc > 0.85 and set(again.splits()) == set(NAMES) and again.splits()["a"] > 0


def test_query_learns_more_than_one_tree(spark, sf):
    from ticketflow.catalog import load
    rows = load()[0]["sla_rounds"](spark, sf).collect()
    losses = [r["loss"] for r in sorted(rows, key=lambda r: r["round"])]
    kept = max(r["round"] for r in rows if r["kept"])
    assert kept > 1 and losses[kept] == min(losses) and losses[kept] < 0.8 * losses[0] and rows[0]["right"] > 0.75


def test_workers_import_the_package_from_any_folder(tmp_path):
    """A session of its own, started elsewhere, without the package's folder on the workers' path."""
    import ticketflow
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(ticketflow.__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from ticketflow.session import build_session
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2")
from ticketflow.operators.vectors import top_k
rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1])], "ticket_id string, embedding array<float>").selectExpr("*", "'x' category", "'y' priority", "'z' subject")
import ticketflow.operators.vectors as v
print("found", v.top_k(rows, rows, 1, exclude_self=True).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "found 2" in done.stdout, done.stderr[-2000:]


def test_far_tree_needs_no_pass_over_its_last_level(spark, monkeypatch):
    """A pass per level above the leaves; leaves have the values that a pass over them gives, to the order of sums."""
    passes = []
    level = B.Far.level
    monkeypatch.setattr(B.Far, "level", lambda self, tree, at, *more: passes.append(at) or level(self, tree, at, *more))
    train, val = table(spark, 900, 1).repartition(3), table(spark, 300, 2)
    far = B.boost(train, val, NAMES, settings=B.Settings(trees=2, depth=3), near_rows=0)
    assert passes == [0, 1, 2] * 2
    near = B.boost(train, val, NAMES, settings=B.Settings(trees=2, depth=3))
    assert all(a.feature.tolist() == b.feature.tolist() and a.value == pytest.approx(b.value) for a, b in zip(near.trees, far.trees))


def test_far_round_is_a_pass_per_level(spark, monkeypatch):
    """The loss of a round and the first level of the next one are one Spark job, and no job shuffles; each level and each loss used to
    be a job of its own, levels with a shuffle. Sums that are too large for the driver meet in tasks, with the same trees."""
    train, val = table(spark, 900, 1).repartition(3), table(spark, 300, 2)
    s, sc = B.Settings(trees=4, depth=3), spark.sparkContext
    stages = []

    def boosted(group):
        close = B.Far.close

        def counted(side):
            jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
            stages.append([len(j.stageIds) for j in jobs])
            close(side)
        init = B.Far.__init__

        def begun(side, *args):
            init(side, *args)
            sc.setJobGroup(group, "rounds")
        with monkeypatch.context() as m:
            m.setattr(B.Far, "close", counted)
            m.setattr(B.Far, "__init__", begun)
            try:
                return B.boost(train, val, NAMES, settings=s, near_rows=0)
            finally:
                sc.setJobGroup("", "")
    one = boosted("in-the-driver")
    assert len(stages[0]) <= 1 + 4 * s.depth
    monkeypatch.setattr(B, "SENT", 0)
    two = boosted("in-tasks")
    assert len(stages[1]) >= 1 + 4 * (s.depth + 1)
    assert one.losses == pytest.approx(two.losses)
    assert all(a.feature.tolist() == b.feature.tolist() and a.value == pytest.approx(b.value) for a, b in zip(one.trees, two.trees))


def block(n=3000, seed=4):
    draw = np.random.default_rng(seed)
    bins = np.stack([draw.integers(0, w, n) for w in (64, 40, 5, 1, 3, 1)]).astype(np.uint8)
    return B.Block(7, False, bins, draw.integers(0, 2, n).astype(np.int8), 1.7, draw.normal(size=n))


def grown_stump(depth, features, seed=5):
    draw, tree = np.random.default_rng(seed), B.Tree.stump(depth)
    for i in range(2 ** depth - 1):
        if i == 0 or tree.feature[(i - 1) // 2] >= 0 and draw.random() < 0.8:
            tree.feature[i], tree.at[i] = draw.integers(0, features), draw.integers(0, 30)
    return tree


@pytest.mark.parametrize("depth", [0, 3, 6, 8])
def test_nodes_of_rows_one_by_one(depth):
    b, tree = block(), grown_stump(depth, 6)
    wanted = []
    for row in b.bins.T.tolist():
        at = 0
        while tree.feature[at] >= 0:
            at = 2 * at + 1 + (row[tree.feature[at]] > tree.at[at])
        wanted.append(at)
    assert tree.node(b.bins).tolist() == tree.node(b.bins.astype(np.int64)).tolist() == wanted


def test_features_counted_together_have_the_sums_of_each():
    """A level counted each feature by itself, three times; now several meet in cells, and their sums are taken from these."""
    b, s, chosen = block(), B.Settings(), np.array([0, 1, 2, 3, 4])
    assert B.together([64, 40, 5, 1, 3], 0) == [[3], [4], [2], [1], [0]]
    assert B.together([64, 40, 5, 1, 3], 64) == [[3, 4, 2], [1], [0]]
    for level in (0, 2, 4):
        tree = grown_stump(level, 6)
        alone = b.sums(tree, level, chosen, s, 3)
        for cells in (64, 1 << 12, 1 << 20):
            assert b.sums(tree, level, chosen, s, 3, cells) == pytest.approx(alone)
        assert b.sums(tree, level, chosen, s, 3, 1 << 20)[:, 2].tolist() == alone[:, 2].tolist()


def test_a_row_of_a_block_has_what_a_pass_needs():
    """Features in bin 0 throughout, and a weight per row, were moved with every pass."""
    b = block()
    row = b.row()
    assert sum(len(x) for x in row if isinstance(x, bytes)) <= len(b.label) * (4 + 1 + 8) + 100
    again = B.Block.of(row, len(b.bins))
    assert (again.bins == b.bins).all() and (again.label == b.label).all() and (again.margin == b.margin).all() and again.weight == 1.7
