"""Every query against its SQL, and plans that hold at scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    ours, theirs = normal(QUERIES[name](spark, sf).toPandas()), normal(db.execute(ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


# the nearest-ticket join multiplies blocks of vectors in Python tasks, model hooks are Python, and so are the operators of
# the training-data folder; all other queries have none
NEAREST = ("topk", "approximate", "retrieval", "eval_retrieval", "rag", "display_hits", "triage_log", "generate", "grade", "op")
RELATIONAL = sorted(n for n in ORACLES if not n.startswith((*NEAREST, "stream")) and n != "triage")


@pytest.mark.parametrize("name", RELATIONAL)
def test_plans_stay_inside_the_engine(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Python" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filtered(spark, sf):
    text = plan(spark, sf, "scan_parquet")
    assert "text" not in text.split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull(ts)" in plan(spark, sf, "latest_features")


def test_masking_runs_once_per_pattern(spark, sf):
    for name in ("silver", "pii_stats", "silver_stats"):
        text = plan(spark, sf, name)
        assert text.count("EMAIL_REDACTED") == 2, name  # one per column


def test_dedup_reduces_before_the_shuffle(spark, sf):
    text = plan(spark, sf, "silver")
    assert "partial_min_by" in text and "Window" not in text


def test_ranks_are_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "topk_cosine")


def test_wide_rows_are_not_shuffled_by_the_split(spark, sf):
    text = plan(spark, sf, "time_split")
    assert "Exchange" not in text and "Window" not in text
