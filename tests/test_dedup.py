"""One row per key, with hot keys."""

from pyspark.sql import functions as F

from ticketflow.operators.dedup import dedup, latest, upsert


def test_first_of_equal_texts_stays(spark):
    rows = [(i, "s", "same" if i % 3 else f"b{i}") for i in range(2000)]
    got = {r["id"] for r in dedup(spark.createDataFrame(rows, "id int, subject string, body string").repartition(9), ["id"]).collect()}
    assert got == {i for i in range(2000) if i % 3 == 0} | {1}


def test_separator_joins_subject_and_body(spark):
    rows = [(1, "x|||y", "z"), (2, "x", "y|||z"), (3, None, "q"), (4, "", "q")]
    got = {r["id"] for r in dedup(spark.createDataFrame(rows, "id int, subject string, body string"), ["id"]).collect()}
    assert got == {1, 3}


def test_latest_respects_the_window(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-03-01 00:00:00"), ("a", 3, "2024-05-01 00:00:00"),
            ("b", 4, "2023-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, v int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = latest(df, "k", "t", "2024-04-01 00:00:00", "90 DAYS").collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", 2)]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept"), ("c", 2, "c")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("a", 0, "late"), ("b", 4, "stale"), ("d", 1, "added"), ("d", 1, "added")],
                                "k string, v int, x string")
    once = upsert(base, new, "k", "v")
    expected = {("a", 1, "new"), ("b", 5, "kept"), ("c", 2, "c"), ("d", 1, "added")}
    assert {tuple(r) for r in once.collect()} == expected and once.count() == 4
    assert {tuple(r) for r in upsert(once, new, "k", "v").collect()} == expected
