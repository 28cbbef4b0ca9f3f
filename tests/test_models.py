"""Replies, pluggable models, trained models."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ticketflow.constants import FEATURES
from ticketflow.functions.replies import cascade, extract_json, parse_judgement, validate_reply
from ticketflow.operators import models as m
from ticketflow.operators.evaluate import (
    binary_metrics, class_weight, classification_report, observe_batch, routing_accuracy,
)


@pytest.mark.parametrize("raw, expected", [
    ('{"category": " Bug", "priority": "HIGH", "routing_team": "infra", "confidence": 1}', ("bug", "high", "infra", 1.0, None)),
    ('text {"category": "docs"} more {"category": "bug"}', ("docs", "medium", "support", 0.5, None)),
    ('{"category": "odd", "confidence": "x"}', ("question", "medium", "support", 0.0, None)),
    ('{"category": "bug", "confidence": "x"}', ("question", "medium", "support", 0.0, "invalid field type")),
    ('{"category": "bug", "confidence": null}', ("question", "medium", "support", 0.0, "invalid field type")),
    ('{"category": null}', ("question", "medium", "support", 0.0, "invalid field type")),
    ('{"category": "bug", "priority": 3}', ("question", "medium", "support", 0.0, "invalid field type")),
    ('{"category": "bug", "confidence": true}', ("bug", "medium", "support", 1.0, None)),
    ('{"category": "bug", "confidence": " 0.25 "}', ("bug", "medium", "support", 0.25, None)),
    ("{'category': 'bug'}", ("question", "medium", "support", 0.0, "JSON parse failed")),
    ('{"category": {"a": "b"}}', ("question", "medium", "support", 0.0, "JSON parse failed")),
    ("{}", ("question", "medium", "support", 0.5, None)),
    ("", ("question", "medium", "support", 0.0, "JSON parse failed")),
    (None, ("question", "medium", "support", 0.0, "JSON parse failed")),
])
def test_reply(spark, raw, expected):
    row = validate_reply(spark.createDataFrame([(raw,)], "raw string"), "raw", "r").first()["r"]
    assert (row["category"], row["priority"], row["routing_team"], row["confidence"], row["error"]) == expected


def test_first_object_spans_lines(spark):
    df = spark.createDataFrame([('a {"x":\n1} {2}',), ("none",)], "raw string")
    assert [r[0] for r in df.select(extract_json(F.col("raw"))).collect()] == ['{"x":\n1}', None]


@pytest.mark.parametrize("p, f, model", [
    ({"category": "bug", "confidence": 0.75}, {"category": "docs", "confidence": 1}, "primary"),
    ({"category": "bug", "confidence": 0.74}, {"category": "docs", "confidence": 0.1}, "fallback"),
    ({"category": "bug", "confidence": 0.74}, None, "primary"),
    (None, None, "fallback"),
])
def test_cascade(spark, p, f, model):
    rows = spark.createDataFrame([(json.dumps(p) if p else "x", json.dumps(f) if f else "y")], "p string, f string")
    rows = validate_reply(validate_reply(rows, "p", "pr"), "f", "fr")
    row = cascade(rows, "pr", "fr", "out").first()["out"]
    assert (row["model"], row["escalated"]) == (model, model == "fallback")


@pytest.mark.parametrize("raw, score, reason", [
    ('{"score": 1, "reason": "r"}', 1.0, "r"), ('{"reason": "r"}', 0.0, "r"), ('{"score": "0.5"}', 0.5, ""),
    ('{"score": null}', 0.0, "Eval failed"), ('{"score": "bad"}', 0.0, "Eval failed"), ("text", 0.0, "Eval failed"),
    (' {"score": 0.5} ', 0.5, ""),
])
def test_judgement(spark, raw, score, reason):
    row = spark.createDataFrame([(raw,)], "raw string").select(parse_judgement(F.col("raw")).alias("g")).first()["g"]
    assert (row["score"], row["reason"]) == (score, reason)


TICKETS = [("a", "sure", "body"), ("b", "unsure", "body"), ("c", "boom", "body"), ("d", "garbled", "body")]


def primary(prompts):
    out = []
    for p in prompts:
        subject = p.split("Ticket Subject: ")[1].split("\n")[0]
        if subject == "boom":
            raise ValueError("no answer")
        out.append("?" if subject == "garbled" else json.dumps({"category": "bug", "confidence": 0.9 if subject == "sure" else 0.2}))
    return out


def fallback(prompts):
    if any("Ticket Subject: sure" in p for p in prompts):
        raise AssertionError("a sure row was sent")
    return [json.dumps({"category": "docs", "confidence": 1.0}) for _ in prompts]


def test_classify_sends_only_unsure_rows(spark):
    df = spark.createDataFrame(TICKETS, "ticket_id string, subject string, body string").coalesce(1)
    got = {r["ticket_id"]: r["reply"] for r in m.classify(df, primary, fallback).collect()}
    assert {k: (r["category"], r["model"], r["escalated"], r["error"]) for k, r in got.items()} == {
        "a": ("bug", "primary", False, None), "b": ("docs", "fallback", True, None),
        "c": ("docs", "fallback", True, None), "d": ("docs", "fallback", True, None)}


def test_classify_keeps_failures_per_row(spark):
    df = spark.createDataFrame(TICKETS, "ticket_id string, subject string, body string").coalesce(1)
    got = {r["ticket_id"]: r["reply"] for r in m.classify(df, primary).collect()}
    assert got["a"]["error"] is None and got["c"]["error"] == "no answer" and got["d"]["error"] == "JSON parse failed"
    assert not got["c"]["escalated"] and got["c"]["category"] == "question"


def test_batch_counters(spark):
    seen = Observation("batch")
    df = spark.createDataFrame(TICKETS, "ticket_id string, subject string, body string").coalesce(1)
    observe_batch(m.classify(df, primary, fallback), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 4, "escalated": 3}


def test_generate_keeps_failures_as_text(spark):
    def write(prompts):
        if "bad" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]
    df = spark.createDataFrame([("x",), ("bad",)], "prompt string").coalesce(1)
    assert [r["response"] for r in m.generate(df, write).collect()] == ["X", "[Generation failed: down]"]


def test_grade(spark):
    df = spark.createDataFrame([("q", "c", "a"), ("q", "c", "")], "question string, context string, answer string")
    graded = m.grade(df, lambda prompts: ['{"score": 0.5, "reason": "ok"}' if "Context" in p else "no" for p in prompts])
    assert tuple(m.grade_summary(graded).first()) == (2, 0.5, 0.0)


def test_embed(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", "  "), ("c", None), ("d", "fail")], "id string, text string").coalesce(1)

    def vectors(texts):
        if "fail" in texts:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: list(r["embedding"]) for r in m.embed(df, "text", vectors, dim=2).collect()}
    assert got == {"a": [7.0, 1.0], "b": [0.0, 0.0], "c": [0.0, 0.0], "d": [0.0, 0.0]}
    own = {r["id"]: list(r["embedding"]) for r in m.embed(df, "text", dim=16).collect()}
    assert sum(x * x for x in own["a"]) == pytest.approx(1, abs=1e-5) and len(own["a"]) == 16
    assert sum(map(abs, own["b"])) == 0 and sum(map(abs, own["c"])) == 0


def test_sla_model(spark, tmp_path):
    rows = [tuple([float((i * (j + 3)) % 17) for j in range(17)] + [f"t{i}", int((i * 3) % 17 > 12)]) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", ticket_id string, label int")
    model = m.train_sla(df.where("ticket_id < 't300'"), df.where("ticket_id >= 't300'"), trees=3)
    scored = m.score_sla(df, model)
    assert {"sla_risk_score", "breach_flag", "risk_level"} <= set(scored.columns) and scored.count() == 400
    assert m.importances(spark, model).count() == 17
    m.save_model(model, str(tmp_path / "model"))
    again = m.score_sla(df.drop("source_encoded", "label"), m.load_model(str(tmp_path / "model")))
    assert again.count() == 400


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert tuple(binary_metrics(df, "y", "p").first()) == (0, 0, 1, 0.0, 0.0, 0.0)
    assert tuple(class_weight(spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int"), "y").first()) == (0.25, 3.0)
    assert class_weight(spark.createDataFrame([(0,)], "y int"), "y").first()["weight"] == 1.0
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y_true string, y_pred string")
    got = {r["label"]: (r["precision"], r["recall"], round(r["f1"], 6), r["support"]) for r in classification_report(pairs).collect()}
    assert got["a"] == (1.0, 0.5, 0.666667, 2) and got["c"] == (0.0, 0.0, 0.0, 0)
    assert got["macro avg"] == (pytest.approx(1 / 3), pytest.approx(1 / 6), 0.222222, 3)
    routed = spark.createDataFrame([("infra", True, "infra", True), ("infra", True, "support", True)],
                                   "routing_team string, auto_escalate boolean, expected_team string, expected_escalate boolean")
    assert tuple(routing_accuracy(routed).first()) == (2, 0.5, 1.0, 0.5)
