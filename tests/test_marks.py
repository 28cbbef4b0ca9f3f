"""Ids of a log from its high marks."""

import glob

import pytest

from ticketflow.schemas import TRIAGE_LOG
from ticketflow.sources import marks, sinks
from ticketflow.streaming import intake


def rows(spark, tickets):
    return spark.createDataFrame([("2024-01-01 00:00:00", t) for t in tickets], "ts string, ticket_id string").selectExpr(
        "cast(ts AS timestamp) AS ts", "ticket_id", *[f"cast(null AS {f.dataType.simpleString()}) AS {f.name}"
                                                      for f in TRIAGE_LOG if f.name not in ("id", "ts", "ticket_id")])


def ids(spark, path):
    return {r["ticket_id"]: r["id"] for r in spark.read.schema(TRIAGE_LOG).parquet(path).collect()}


def test_an_append_reads_no_data_of_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(rows(spark, "ba"), path)
    for f in glob.glob(f"{path}/*.parquet"):
        open(f, "wb").write(b"no table")
    with pytest.raises(Exception):
        ids(spark, path)
    sinks.append_log(rows(spark, "dc"), path)
    assert marks.last_mark(spark, path) == {"number": 2, "first": 3, "next": 5, "owner": ""}


def test_ids_go_on_and_an_empty_append_takes_none(spark, tmp_path):
    path = str(tmp_path / "log")
    for part in ("cab", "", "ed"):
        sinks.append_log(rows(spark, part), path)
    assert ids(spark, path) == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}


def test_a_log_without_marks_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.as_log(rows(spark, "a").selectExpr("*", "7L AS id")).write.parquet(path)
    sinks.append_log(rows(spark, "b"), path)
    assert ids(spark, path) == {"a": 7, "b": 8}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    marks.claim(spark, path, 1, 1, 5)
    with pytest.raises(RuntimeError, match="another writer"):
        marks.claim(spark, path, 1, 1, 3)
    assert marks.last_mark(spark, path) == {"number": 1, "first": 1, "next": 6, "owner": ""}


def test_a_repeated_batch_keeps_its_ids(spark, tmp_path):
    path = str(tmp_path / "log")
    for n, part in enumerate(("ba", "dc", "e")):
        intake.number_log(rows(spark, part), path, n, "stream")
    intake.number_log(rows(spark, "cd"), path, 1, "stream")
    assert ids(spark, path) == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    with pytest.raises(RuntimeError, match="belongs to"):
        intake.number_log(rows(spark, "f"), path, 3, "another stream")


def test_a_streamed_log_without_marks_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.as_log(rows(spark, "a").selectExpr("*", "7L AS id")).write.parquet(f"{path}/{intake.BATCH}=0")
    intake.number_log(rows(spark, "b"), path, 1)
    intake.number_log(rows(spark, "c"), path, 2)
    assert ids(spark, path) == {"a": 7, "b": 8, "c": 9}
