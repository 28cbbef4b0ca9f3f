"""Joins against loops in Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ticketflow.operators import joins
from ticketflow.operators.joins import as_of_join, best_overlap, route_by_rule, with_labels
from ticketflow.operators.routing import triage_route


def test_as_of_hot_key(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)

    def draw(n):
        return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", start + timedelta(minutes=rng.randrange(40000)), i)
                for i in range(n)]

    left, facts = draw(400), draw(300)
    facts += [(k, t, 1000 + i) for i, (k, t, _) in enumerate(left[:20])]  # facts at the very time of a row
    l = spark.createDataFrame([(i, k, t) for k, t, i in left], "id int, k string, t timestamp")
    f = spark.createDataFrame([(k, t, i, i * 10) for k, t, i in facts], "k string, t timestamp, n int, v int")
    got = {r["id"]: r["fact_v"] for r in as_of_join(l, f, "k", "t", ["v"], "5 DAYS", tie="n").collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        seen = [(ft, n) for fk, ft, n in facts if fk == k and ft <= t]
        best = max(seen) if seen else None
        assert got[i] == (best[1] * 10 if best and best[0] > t - timedelta(days=5) else None)


def test_overlap_against_python(spark):
    keys = {1: "API down error", 2: "refund please Refund", 3: "", 4: "down API now please"}
    texts = {10: "the api is DOWN with an error", 11: "nothing", 12: "refund please", 13: "", 14: "api down now please ok"}
    got = best_overlap(spark.createDataFrame(list(texts.items()), "q int, t string"), "q", F.col("t"),
                       spark.createDataFrame(list(keys.items()), "k int, t string"), "k", "t").collect()
    for r in got:
        best, score = 1, 0.0
        for k, text in keys.items():
            ws = set(text.lower().split())
            s = len(ws & set(texts[r["q"]].lower().split())) / max(len(ws), 1)
            if s > score:
                best, score = k, s
        assert (r["k"], round(r["score"], 9)) == (best, round(score, 9))
    assert len(got) == len(texts)


def test_left_join_keeps_rows(spark):
    feats = spark.createDataFrame([("a", 1), ("b", 2)], "ticket_id string, n int")
    tickets = spark.createDataFrame([("a", "bug", "x")], "ticket_id string, category string, body string")
    got = {tuple(r) for r in with_labels(feats, tickets).collect()}
    assert got == {("a", 1, "bug"), ("b", 2, None)}


def test_routing_cases(spark):
    rows = [("incident", "critical", 0.1), ("incident", "high", 0.75), ("security", "high", 0.9), ("docs", "low", 0.74),
            ("question", "medium", 0.999), ("performance", "high", None)]
    df = spark.createDataFrame(rows, "category string, priority string, sla_risk double")
    assert route_by_rule(df).count() == 6
    got = {(r["category"], r["priority"]): (r["routing_team"], r["auto_escalate"], r["sla_escalated"], r["escalation_reason"])
           for r in triage_route(df).collect()}
    standard = "Standard routing — no escalation required"
    assert got == {
        ("incident", "critical"): ("engineering", True, False, "Critical incident incident"),
        ("incident", "high"): ("engineering", True, True, "SLA breach risk 75%"),
        ("security", "high"): ("security", True, False, "Critical security incident"),
        ("docs", "low"): ("support", False, False, standard),
        ("question", "medium"): ("support", True, True, "SLA breach risk 100%"),
        ("performance", "high"): ("infra", False, False, standard),
    }


def test_as_of_one_hot_hour(spark, monkeypatch):
    """Nine tenths of all rows lie in one key and hour: no block has many of them, and wide rows are joined once."""
    rng, start = random.Random(7), datetime(2024, 1, 1)

    def draw(n, first):
        return [("hot" if rng.random() < 0.9 else f"k{rng.randrange(9)}", start + timedelta(seconds=rng.randrange(3600)), first + i) for i in range(n)]
    left, facts = draw(4000, 0), draw(150, 0) + [(None, start, 900), ("hot", None, 901)]
    left += [(None, start, 5000), ("hot", None, 5001), ("hot", start - timedelta(days=1), 5002), ("zzz", start, 5003)]
    seen = {}
    blocks = joins.sorted_blocks

    def spied(df, order):
        seen["columns"], out = df.columns, blocks(df, order)
        seen["sizes"] = [r["count"] for r in out.groupBy("_block").count().collect()]
        return out
    monkeypatch.setattr(joins, "sorted_blocks", spied)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = as_of_join(spark.createDataFrame([(i, k, t, "wide" * 50) for k, t, i in left], "id int, k string, t timestamp, wide string"),
                         spark.createDataFrame([(k, t, i, i * 10) for k, t, i in facts], "k string, t timestamp, n int, v int"),
                         "k", "t", ["v"], "20 MINUTES", tie="n")
        got = {r["id"]: r["fact_v"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(left)
    for k, t, i in left:
        known = [(ft, n) for fk, ft, n in facts if k and t and fk == k and ft and ft <= t]
        best = max(known) if known else None
        assert got[i] == (best[1] * 10 if best and best[0] > t - timedelta(minutes=20) else None), (k, t, i)
    assert "wide" not in seen["columns"] and max(seen["sizes"]) < 0.4 * len(left)


def test_as_of_nothing_to_find(spark):
    left = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "id int, k string, t timestamp")
    none = spark.createDataFrame([], "k string, t timestamp, v int")
    assert [tuple(r) for r in as_of_join(left, none, "k", "t", ["v"], "5 DAYS").collect()] == [(1, "a", datetime(2024, 1, 1), None, None)]
    assert as_of_join(left.where("false"), none, "k", "t", ["v"], "5 DAYS").collect() == []


def test_overlap_of_many_keys_with_a_frequent_word(spark, monkeypatch):
    """Every key and query has the same word; it stands last in all keys, and few pairs meet by it."""
    monkeypatch.setattr(joins, "SLOT_BITS", 5)
    rng = random.Random(3)
    keys = {k: "the " + " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(12)) for k in range(60)}
    texts = {q: "the " + " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(40)) for q in range(300)}
    texts[300], texts[301], texts[302] = keys[7], "", None
    q = spark.createDataFrame(list(texts.items()), "q int, t string")
    k = spark.createDataFrame(list(keys.items()), "k int, t string")
    for r in best_overlap(q, "q", F.col("t"), k, "k", "t").collect():
        asked = set((texts[r["q"]] or "").split())
        scores = {i: len(set(t.split()) & asked) / len(set(t.split())) for i, t in keys.items()}
        best = min(scores, key=lambda i: (-scores[i], i))
        assert (r["k"], round(r["score"], 9)) == (best, round(scores[best], 9))


def test_overlap_joins_few_rows(spark):
    from ticketflow.catalog.fixtures import table
    sf = "/root/testdata/sf0.01"
    parts = joins.overlap_parts(table(spark, sf, "documents"), "doc_id", F.col("text"), table(spark, sf, "benchmark"), "item_id", "text")
    all_rows = parts["asked"].join(parts["postings"], "__word").count()
    joined = parts["rare"].count() + parts["prefix"].count()
    assert joined < 0.5 * all_rows
