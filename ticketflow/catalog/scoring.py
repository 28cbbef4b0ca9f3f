"""Queries over routing, replies and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FAILED_REASONING, STANDARD_REASON
from ..functions.replies import cascade, extract_json, parse_judgement, validate_reply
from ..functions.rules import risk_bucket, sla_label
from ..operators import evaluate as ev
from ..operators.joins import route_by_rule
from ..operators.routing import triage_route
from . import sqltext as q
from .fixtures import fixture, table, with_views
from .registry import query

ORDERS = with_views("fx_orders_triage")
ROUTED = ORDERS + f""",
rules AS (SELECT * FROM {q.RULES}),
r AS (SELECT o.*, coalesce(x.team, 'support') AS routing_team, coalesce(x.escalate, false) AS by_rule
      FROM fx_orders_triage o LEFT JOIN rules x ON o.category = x.category AND o.priority = x.priority),
routed AS (SELECT *, sla_risk >= 0.75 AND NOT by_rule AS sla_escalated, by_rule OR sla_risk >= 0.75 AS auto_escalate FROM r)
"""


@query("route_rule", ROUTED + "SELECT ticket_id, category, priority, routing_team, by_rule AS rule_escalate FROM routed")
def route_rule(spark, sf):
    return route_by_rule(fixture(spark, sf, "fx_orders_triage")).select(
        "ticket_id", "category", "priority", "routing_team", "rule_escalate")


@query("triage_route", ROUTED + f"""
SELECT ticket_id, routing_team, auto_escalate, sla_escalated,
       CASE WHEN auto_escalate THEN concat_ws(' + ', CASE WHEN by_rule THEN concat('Critical ', category, ' incident') END,
            CASE WHEN sla_escalated THEN concat('SLA breach risk ', CAST(CAST(round_even(sla_risk * 100, 0) AS BIGINT) AS VARCHAR), '%') END)
            ELSE '{STANDARD_REASON}' END AS escalation_reason FROM routed""")
def routed(spark, sf):
    return triage_route(fixture(spark, sf, "fx_orders_triage")).select(
        "ticket_id", "routing_team", "auto_escalate", "sla_escalated", "escalation_reason")


@query("routing_accuracy", ROUTED + """
SELECT count(*) AS n, round(avg(CAST(routing_team = expected_team AS INT)), 6) AS team_accuracy,
       round(avg(CAST(auto_escalate = expected_escalate AS INT)), 6) AS escalation_accuracy,
       round(avg(CAST(routing_team = expected_team AND auto_escalate = expected_escalate AS INT)), 6) AS full_match,
       round(avg(total_ms), 2) AS avg_ms FROM routed""")
def routing_accuracy(spark, sf):
    scored = ev.routing_accuracy(triage_route(fixture(spark, sf, "fx_orders_triage")), "total_ms")
    rounded = {c: F.round(c, 6) for c in ("team_accuracy", "escalation_accuracy", "full_match")}
    return scored.withColumns({**rounded, "avg_ms": F.round("avg_ms", 2)})


@query("routing_eval", ROUTED + """
SELECT ticket_id, routing_team, expected_team, routing_team = expected_team AS team_ok, auto_escalate, expected_escalate,
       auto_escalate = expected_escalate AS escalation_ok FROM routed""")
def routing_pairs(spark, sf):
    rows = fixture(spark, sf, "fx_orders_triage")
    result = triage_route(rows).select("ticket_id", "routing_team", "auto_escalate")
    return ev.routing_eval(result, rows)


@query("risk_bucket", ORDERS + """
SELECT ticket_id, round(sla_risk, 4) AS sla_risk_score, sla_risk >= 0.5 AS breach_flag,
       CASE WHEN sla_risk >= 0.8 THEN 'critical' WHEN sla_risk >= 0.6 THEN 'high' WHEN sla_risk >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level
FROM fx_orders_triage""")
def risk_buckets(spark, sf):
    return fixture(spark, sf, "fx_orders_triage").select("ticket_id", *risk_bucket(F.col("sla_risk")))


@query("sla_label", ORDERS + """
SELECT ticket_id, CAST(category IN ('incident', 'sla_breach', 'security') AS INT) AS label FROM fx_orders_triage""")
def sla_labels(spark, sf):
    return fixture(spark, sf, "fx_orders_triage").select("ticket_id", sla_label(F.col("category")).alias("label"))


REPLIES = with_views("fx_replies")
FOUND = r"nullif(regexp_extract({}, '\{{[\s\S]*?\}}', 0), '')"
SETS = {
    "category": "('bug', 'feature', 'security', 'billing', 'performance', 'docs', 'question', 'incident', 'sla_breach', "
                "'ui', 'test', 'dependency')",
    "priority": "('critical', 'high', 'medium', 'low')",
    "routing_team": "('support', 'engineering', 'infra', 'billing', 'security')",
}


def checked(raw: str, name: str) -> str:
    """CTEs that clean the reply column ``raw`` into the view ``name``."""
    def word(c, default):
        return (f"CASE WHEN json_type(j, '$.{c}') IS NULL THEN '{default}' "
                f"ELSE lower(trim(json_extract_string(j, '$.{c}'))) END")
    bad = " OR ".join(f"coalesce(json_type(j, '$.{c}'), 'VARCHAR') <> 'VARCHAR'" for c in SETS)
    return f"""
{name}_j AS (SELECT ticket_id, CASE WHEN json_valid(f) THEN CAST(f AS JSON) END AS j
             FROM (SELECT ticket_id, {FOUND.format(raw)} AS f FROM fx_replies)),
{name}_f AS (SELECT ticket_id, j, {word('category', 'question')} AS c, {word('priority', 'medium')} AS p,
                    {word('routing_team', 'support')} AS t, ({bad}) AS bad,
                    CASE WHEN json_type(j, '$.confidence') IS NULL THEN 0.5
                         ELSE try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) END AS x FROM {name}_j),
{name}_e AS (SELECT *, c IN {SETS['category']} AS known,
                    CASE WHEN j IS NULL THEN 'JSON parse failed'
                         WHEN bad OR (c IN {SETS['category']} AND x IS NULL) THEN 'invalid field type' END AS error FROM {name}_f),
{name} AS (SELECT ticket_id, error,
                  CASE WHEN error IS NULL AND known THEN c ELSE 'question' END AS category,
                  CASE WHEN error IS NULL AND p IN {SETS['priority']} THEN p ELSE 'medium' END AS priority,
                  CASE WHEN error IS NULL AND t IN {SETS['routing_team']} THEN t ELSE 'support' END AS routing_team,
                  CASE WHEN error IS NULL AND known THEN greatest(0.0, least(1.0, x)) ELSE 0.0 END AS confidence,
                  CASE WHEN error IS NOT NULL THEN '{FAILED_REASONING}' ELSE json_extract_string(j, '$.reasoning') END AS reasoning
           FROM {name}_e)"""


@query("extract_json", REPLIES + f"SELECT ticket_id, {FOUND.format('primary_raw')} AS found, coalesce(json_valid({FOUND.format('primary_raw')}), false) AS valid FROM fx_replies")
def json_found(spark, sf):
    found = extract_json(F.col("primary_raw"))
    valid = F.try_parse_json(found).isNotNull()
    return fixture(spark, sf, "fx_replies").select("ticket_id", found.alias("found"), valid.alias("valid"))


@query("validate_reply", REPLIES + "," + checked("primary_raw", "p") +
       " SELECT ticket_id, category, priority, routing_team, confidence, reasoning, error FROM p")
def replies_checked(spark, sf):
    return validate_reply(fixture(spark, sf, "fx_replies"), "primary_raw", "r").select("ticket_id", "r.*")


CASCADE = REPLIES + "," + checked("primary_raw", "p") + "," + checked("fallback_raw", "f") + """,
u AS (SELECT p.ticket_id, (p.error IS NOT NULL OR p.confidence < 0.75) AND (f.error IS NULL OR p.error IS NOT NULL) AS escalated
      FROM p JOIN f ON p.ticket_id = f.ticket_id),
chosen AS (SELECT u.ticket_id, u.escalated, c.* EXCLUDE (ticket_id), CASE WHEN u.escalated THEN 'fallback' ELSE 'primary' END AS model
           FROM u JOIN (SELECT 1 AS side, * FROM f UNION ALL BY NAME SELECT 0 AS side, * FROM p) c
           ON u.ticket_id = c.ticket_id AND CAST(u.escalated AS INT) = c.side)
"""


def cascaded(spark, sf):
    rows = validate_reply(fixture(spark, sf, "fx_replies"), "primary_raw", "p")
    return cascade(validate_reply(rows, "fallback_raw", "f"), "p", "f", "reply")


@query("cascade", CASCADE + "SELECT ticket_id, category, priority, routing_team, confidence, error, model, escalated FROM chosen")
def cascade_rows(spark, sf):
    return cascaded(spark, sf).select("ticket_id", "reply.*").drop("reasoning")


@query("cascade_stats", CASCADE + """
SELECT count(*) AS n, count(*) FILTER (WHERE escalated) AS escalated, round(avg(CAST(escalated AS INT)), 6) AS escalation_rate
FROM chosen""")
def cascade_figures(spark, sf):
    return ev.cascade_stats(cascaded(spark, sf)).withColumn("escalation_rate", F.round("escalation_rate", 6))


@query("judge_parse", REPLIES + """,
v AS (SELECT ticket_id, CASE WHEN json_valid(judge_raw) THEN CAST(judge_raw AS JSON) END AS j FROM fx_replies)
SELECT ticket_id, CASE WHEN j IS NULL THEN 0.0 ELSE coalesce(try_cast(json_extract_string(j, '$.score') AS DOUBLE), 0.0) END AS score,
       CASE WHEN j IS NULL THEN 'Eval failed' ELSE coalesce(json_extract_string(j, '$.reason'), '') END AS reason FROM v""")
def judge_parse(spark, sf):
    return fixture(spark, sf, "fx_replies").select("ticket_id", parse_judgement(F.col("judge_raw")).alias("g")).select(
        "ticket_id", "g.*")


LABELLED = with_views("fx_labelled")


@query("class_weight", LABELLED + """
SELECT round(r, 9) AS positive_rate, round(CASE WHEN r > 0 THEN greatest(1.0, (1 - r) / r) ELSE 1.0 END, 9) AS weight
FROM (SELECT avg(toxic) AS r FROM fx_labelled)""")
def class_weight(spark, sf):
    return ev.class_weight(fixture(spark, sf, "fx_labelled"), "toxic").select(
        F.round("positive_rate", 9).alias("positive_rate"), F.round("weight", 9).alias("weight"))


@query("auc", LABELLED + """,
r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS mid FROM fx_labelled),
s AS (SELECT CAST(sum(quality) AS BIGINT) AS positives, CAST(count(*) - sum(quality) AS BIGINT) AS negatives,
             sum(mid) FILTER (WHERE quality = 1) AS total FROM r)
SELECT positives, negatives, round((total - positives * (positives + 1) / 2) / (positives * negatives), 9) AS auc FROM s""")
def auc(spark, sf):
    return ev.auc(fixture(spark, sf, "fx_labelled"), "n_chars", "quality").withColumn("auc", F.round("auc", 9))


# every order scored by its price against its status: one row per order, nearly all scores distinct
@query("auc_orders", """
WITH s AS (SELECT o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM s),
t AS (SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives, sum(mid) FILTER (WHERE y = 1) AS total FROM r)
SELECT positives, negatives, round((total - positives * (positives + 1) / 2) / (positives * negatives), 9) AS auc FROM t""")
def auc_orders(spark, sf):
    scored = table(spark, sf, "orders").select(F.col("o_totalprice").alias("score"),
                                               F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return ev.auc(scored, "score", "y").withColumn("auc", F.round("auc", 9))


@query("binary_metrics", LABELLED + """,
s AS (SELECT count(*) FILTER (WHERE quality = 1 AND flag = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND flag = 1) AS fp,
             count(*) FILTER (WHERE quality = 1 AND flag <> 1) AS fn FROM fx_labelled)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM s""")
def binary_metrics(spark, sf):
    figures = ev.binary_metrics(fixture(spark, sf, "fx_labelled"), "quality", "flag")
    return figures.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


#: Report from a view ``pairs(t, p)`` of true and predicted labels.
REPORT = """
names AS (SELECT t AS label FROM pairs UNION SELECT p FROM pairs),
counted AS (SELECT label, (SELECT count(*) FROM pairs x WHERE x.t = label) AS support, (SELECT count(*) FROM pairs x WHERE x.p = label) AS predicted,
             (SELECT count(*) FROM pairs x WHERE x.t = label AND x.p = label) AS tp FROM names),
scored AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
             coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1, support, tp FROM counted)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support,
       round(coalesce(tp / nullif(support, 0), 0), 9) AS accuracy FROM scored
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT),
       round(sum(tp) / sum(support), 9) FROM scored"""


@query("classification_report", LABELLED + ",\npairs AS (SELECT lower(trim(y_true)) AS t, lower(trim(y_pred)) AS p FROM fx_labelled)," + REPORT)
def classification_report(spark, sf):
    rows = fixture(spark, sf, "fx_labelled")
    pairs = ev.pair_predictions(rows.select("ticket_id", F.col("y_pred").alias("category")),
                                rows.select("ticket_id", F.col("y_true").alias("category")))
    report = ev.classification_report(pairs)
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})
