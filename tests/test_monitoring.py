"""Drift, log and validation."""

import math
import random
from datetime import datetime, timedelta

import pytest
from ticketflow.operators.drift import align, drift_by, drift_report, kl, psi, shares
from ticketflow.operators.log import category_counts, display_log, explode_timings, log_stats, recent, to_log_rows
from ticketflow.operators.quality import (
    GateError, bronze_gate, bronze_suite, expectations, gate, silver_gate, silver_suite, split_valid, validate_requests,
    validate_tickets,
)
from ticketflow.sources.readers import read_triage_log
from ticketflow.sources.sinks import append_log


def drift_in_python(e, a):
    names = sorted(set(e) | set(a))
    es, acs = [e.get(c, 0) + 1e-4 for c in names], [a.get(c, 0) + 1e-4 for c in names]
    es, acs = [x / sum(es) for x in es], [x / sum(acs) for x in acs]
    return (sum((y - x) * math.log(y / x) for x, y in zip(es, acs)), sum(y * math.log(y / x) for x, y in zip(es, acs)))


def both(spark, e, a):
    tables = [spark.createDataFrame(list(d.items()), "category string, p double") for d in (e, a)]
    row = align(*tables).agg(psi().alias("psi"), kl().alias("kl")).first()
    return row["psi"], row["kl"]


@pytest.mark.parametrize("e, a, check", [
    ({"bug": 0.5, "docs": 0.5}, {"bug": 0.5, "docs": 0.5}, lambda p, k: p < 0.05 and k < 0.05),
    ({"bug": 0.99, "docs": 0.01}, {"bug": 0.01, "docs": 0.99}, lambda p, k: p > 0.2 and k > 1),
    ({"bug": 0.5, "docs": 0.5}, {"bug": 0.55, "docs": 0.45}, lambda p, k: 0 < p < 0.15),
    ({"bug": 1.0}, {"bug": 0.5, "new": 0.5}, lambda p, k: p > 0 and k > 0),
])
def test_drift_cases(spark, e, a, check):
    got = both(spark, e, a)
    assert check(*got)
    assert got == pytest.approx(drift_in_python(e, a), abs=1e-12)


def test_drift_is_never_negative(spark):
    rng = random.Random(0)
    for _ in range(5):
        draws = []
        for _ in range(2):
            w = [rng.gammavariate(1, 1) for _ in range(5)]
            draws.append({f"c{i}": x / sum(w) for i, x in enumerate(w)})
        got = both(spark, *draws)
        assert min(got) >= -1e-12 and got == pytest.approx(drift_in_python(*draws), abs=1e-10)


def test_drift_report(spark):
    train = spark.createDataFrame([("bug",)] * 8 + [("docs",)] * 2 + [(None,)], "category string")
    live = spark.createDataFrame([("docs",)] * 3 + [("new",)], "category string")
    row = drift_report(train, live).first()
    expected = drift_in_python({"bug": 0.8, "docs": 0.2}, {"docs": 0.75, "new": 0.25})
    assert (row["psi"], row["kl"]) == pytest.approx(expected)
    assert (row["train_categories"], row["live_categories"], row["live_rows"], row["band"], row["low_sample"]) == (
        2, 2, 4, "alert", True)
    assert drift_report(train, live.limit(0)).count() == 0
    assert [tuple(r) for r in shares(train).orderBy("category").collect()] == [("bug", 8, 0.8), ("docs", 2, 0.2)]


def test_drift_by_period_equals_each_period(spark):
    rng = random.Random(2)
    train = [rng.choice("aabbbcd") for _ in range(100)]
    live = [(day, rng.choice("abxy"[: day + 1])) for day in (1, 2, 3) for _ in range(30)]
    got = {r["day"]: r["psi"] for r in drift_by(spark.createDataFrame([(c,) for c in train], "category string"),
                                                spark.createDataFrame(live, "day int, category string"), "day").collect()}
    for day in (1, 2, 3):
        part = [c for d, c in live if d == day]
        e = {c: train.count(c) / len(train) for c in set(train)}
        a = {c: part.count(c) / len(part) for c in set(part)}
        assert got[day] == pytest.approx(drift_in_python(e, a)[0], abs=1e-10)


LOG = ("ts timestamp, ticket_id string, subject string, category string, priority string, routing_team string, "
       "auto_escalate boolean, sla_risk double, confidence double, timings map<string,double>, run_rag boolean")


def results(spark, n):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=i), f"T{i}", "s" * 300, "bug" if i else "docs", "high", "infra", i == 0, 0.123456,
             0.9, {"total_ms": 3000.0 + 2000 * i, "classify_ms": 1.0}, False) for i in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_log_rows_and_stats(spark):
    rows = to_log_rows(results(spark, 2))
    first = rows.orderBy("ts").first()
    assert (len(first["subject"]), first["auto_escalate"], first["sla_risk"], first["rag_ms"], first["run_rag"]) == (
        200, 1, 0.1235, 0.0, 0)
    assert tuple(log_stats(rows).first()) == (2, 1, 0.5, 4000.0)
    assert tuple(log_stats(rows.limit(0)).first()) == (0, 0, 0.0, 0.0)
    assert category_counts(rows.limit(0)).count() == 0


def test_log_append_numbers_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    append_log(to_log_rows(results(spark, 4)), path)
    append_log(to_log_rows(results(spark, 10)), path)
    log = read_triage_log(spark, path)
    assert sorted(r["id"] for r in log.select("id").collect()) == list(range(1, 15))
    assert [r["id"] for r in recent(log, 5).collect()] == [14, 13, 12, 11, 10]
    assert [r["ticket_id"] for r in log.where("id > 4").orderBy("id").collect()] == [f"T{i}" for i in range(10)]
    assert read_triage_log(spark, path, ["category"]).columns == ["category"]


def test_display(spark):
    row = display_log(to_log_rows(results(spark, 1))).first()
    assert (row["auto_escalate"], row["sla_risk"], row["confidence"], row["total_ms"]) == ("YES", "12%", "90%", "3000ms")
    steps = explode_timings(results(spark, 1), "ticket_id").collect()
    assert [tuple(r) for r in steps] == [("T0", "Classify", 1.0)]


def test_requests(spark):
    schema = "ticket_id string, subject string, body string, run_rag boolean"
    rows = [("a", "s", "b", False), (None, "s", "b", None), ("b", None, "b", True), ("c", "s" * 501, "", True),
            ("d", "s", "b" * 10_001, True)]
    ok, bad = split_valid(validate_requests(spark.createDataFrame(rows, schema)))
    assert {tuple(r) for r in ok.collect()} == {("a", "s", "b", False), ("", "s", "b", True)}
    assert {r["ticket_id"]: r["reasons"] for r in bad.collect()} == {"b": ["subject"], "c": ["subject", "body"], "d": ["body"]}
    missing = validate_requests(spark.createDataFrame([("s",)], "subject string")).first()
    assert missing["reasons"] == ["body"] and missing["run_rag"] is True


def test_tickets(spark):
    schema = ("ticket_id string, source string, created_at timestamp, subject string, body string, category string, "
              "priority string, routing_team string, customer_tier string")
    at = datetime(2024, 1, 1)
    rows = [("a", "github", at, "s", "b", "bug", "high", "infra", None), ("b", "else", None, "s", "b", "odd", "HIGH", None, "gold")]
    out = validate_tickets(spark.createDataFrame(rows, schema)).orderBy("ticket_id").collect()
    assert out[0]["reasons"] == [] and out[0]["customer_tier"] == "free" and out[0]["reopen_count"] == 0
    assert out[1]["reasons"] == ["created_at", "source", "category", "priority", "routing_team", "customer_tier"]


def test_suites(spark):
    schema = "ticket_id string, source string, subject string, body string, created_at string"
    good = spark.createDataFrame([("a", "github", "s", "b" * 20, None)] * 3, schema)
    results_ = expectations(good, bronze_suite(3)).collect()
    assert len(results_) == 11 and all(r["success"] for r in results_)
    bad = spark.createDataFrame([(None, "fax", "s", "short", None)], schema)
    failed = {(r["rule"], r["column"]): r["unexpected_count"] for r in expectations(bad, bronze_suite(3)).collect()
              if not r["success"]}
    assert failed == {("row_count", "*"): 2, ("not_null", "ticket_id"): 1, ("in_set", "source"): 1, ("min_length", "body"): 1}
    assert len(silver_suite()) == 20 and len(silver_gate()) == 4 and len(bronze_gate()) == 6
    missing = {(r["rule"], r["column"]) for r in expectations(good, silver_suite(3)).collect() if not r["success"]}
    assert ("exists", "category") in missing and ("not_null", "category") in missing


def test_gate(spark):
    good = spark.createDataFrame([("a", "b" * 20)] * 3, "ticket_id string, body string")
    assert gate(good, bronze_gate(3), "bronze") == (6, 0)
    with pytest.raises(GateError, match="row_count"):
        gate(good, bronze_gate(), "bronze")


def test_one_pass(spark):
    good = spark.createDataFrame([("a", "b" * 20)], "ticket_id string, body string")
    plan = expectations(good, bronze_gate(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    assert plan.count("count_if") + plan.count("count(") >= 3
