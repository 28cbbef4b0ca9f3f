"""Ticket-shaped views over the given tables. One SQL text serves Spark and the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

AS_OF = "2025-01-01 00:00:00"

TICKETS = """
SELECT doc_id,
       concat('DOC-', CAST(doc_id AS STRING)) AS ticket_id,
       CASE doc_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'hf_customer_support' WHEN 2 THEN 'synthetic' ELSE 'zendesk' END AS source,
       CASE WHEN doc_id % 4 = 2 THEN NULL WHEN doc_id % 9 = 0 THEN 'not a date'
            ELSE concat('2024-', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'),
                        'T', lpad(CAST(doc_id % 24 AS STRING), 2, '0'), ':30:00', CASE WHEN doc_id % 4 = 0 THEN 'Z' ELSE '.123456' END) END AS created_raw,
       substr(text, 1, 60) AS subject,
       text AS body,
       split(CASE doc_id % 8 WHEN 0 THEN 'wontfix,Bug' WHEN 1 THEN 'enhancement' WHEN 2 THEN 'billing' WHEN 3 THEN ' CVE ,bug'
                             WHEN 4 THEN 'slow' WHEN 5 THEN ',OUTAGE' WHEN 6 THEN 'UX' ELSE 'help' END, ',') AS labels_raw,
       CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'bogus' WHEN 3 THEN NULL ELSE 'low' END AS priority_raw,
       CASE doc_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' ELSE NULL END AS customer_tier,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 END AS reopen_count
FROM documents
"""

LOG = """
SELECT event_id AS id, ts,
       concat('T-', CAST(user_id AS STRING)) AS ticket_id,
       concat(event_type, ' reported') AS subject,
       CASE event_type WHEN 'error' THEN 'incident' WHEN 'click' THEN 'bug' WHEN 'purchase' THEN 'billing' WHEN 'signup' THEN 'question' ELSE 'performance' END AS category,
       CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN value > 100 THEN 1 ELSE 0 END AS auto_escalate,
       value / 500 AS sla_risk,
       CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 100 AS confidence,
       value * 10 AS total_ms, value * 6 AS classify_ms, value AS retrieve_ms,
       CASE WHEN event_id % 2 = 0 THEN value * 3 ELSE NULL END AS rag_ms,
       CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS run_rag,
       CASE event_type WHEN 'view' THEN '/health' WHEN 'click' THEN '/classify' ELSE '/triage' END AS handler,
       CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 500 ELSE 422 END AS status,
       value / 1000 AS duration
FROM events
"""

KB = """
SELECT vec_id, concat('V-', lpad(CAST(vec_id AS STRING), 12, '0')) AS ticket_id, embedding,
       CASE label WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' WHEN 2 THEN 'security' WHEN 3 THEN 'billing' WHEN 4 THEN 'performance'
                  WHEN 5 THEN 'docs' WHEN 6 THEN 'question' WHEN 7 THEN 'incident' WHEN 8 THEN 'ui' ELSE 'test' END AS category,
       CASE vec_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'val' ELSE 'test' END AS split,
       concat('subject of vector ', CAST(vec_id AS STRING)) AS subject
FROM embeddings
"""

#: Orders as tickets with features; the label follows from four of them, but for one row in twelve.
SLA = """
SELECT *, CASE WHEN ticket_number % 12 = 5 THEN 1 - expected ELSE expected END AS label
FROM (SELECT *, CASE WHEN (CASE WHEN text_length > 1500 THEN 1 ELSE 0 END) + (CASE WHEN reopen_count >= 3 THEN 1 ELSE 0 END)
                        + (CASE WHEN hour_of_day < 9 THEN 1 ELSE 0 END) + (CASE WHEN customer_tier_encoded = 2 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS expected
      FROM (SELECT o_orderkey AS ticket_number, concat('O-', CAST(o_orderkey AS STRING)) AS ticket_id, o_orderdate AS created_at,
                   CAST(floor(o_totalprice / 100) AS BIGINT) AS text_length, o_custkey % 119 AS word_count, o_custkey % 61 AS subject_length,
                   o_orderkey % 5 AS url_count, (o_orderkey * 7 + o_custkey) % 24 AS hour_of_day, o_orderkey % 7 AS day_of_week,
                   (o_orderkey + o_custkey) % 5 AS reopen_count, (o_orderkey * 3 + o_custkey) % 4 AS customer_tier_encoded,
                   o_custkey % 4 AS source_encoded FROM orders) AS f) AS e
"""

ORDERS = """
SELECT o_orderkey, concat('O-', CAST(o_orderkey AS STRING)) AS ticket_id,
       CASE o_custkey % 6 WHEN 0 THEN 'incident' WHEN 1 THEN 'bug' WHEN 2 THEN 'security' WHEN 3 THEN 'billing' WHEN 4 THEN 'performance' ELSE 'question' END AS category,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
       CAST(o_orderkey % 1001 AS DOUBLE) / 1000 AS sla_risk,
       CASE o_custkey % 5 WHEN 0 THEN 'engineering' WHEN 1 THEN 'security' WHEN 2 THEN 'billing' WHEN 3 THEN 'infra' ELSE 'support' END AS expected_team,
       o_totalprice > 200000 AS expected_escalate,
       o_totalprice AS total_ms
FROM orders
"""

REPLIES = """
SELECT o_orderkey, concat('O-', CAST(o_orderkey AS STRING)) AS ticket_id,
       CASE o_orderkey % 10
            WHEN 0 THEN 'no json here'
            WHEN 1 THEN 'Sure: {"category": "Bug ", "priority": "HIGH", "routing_team": "engineering", "confidence": 1.7} done'
            WHEN 2 THEN '{"category": "unknown", "priority": "urgent", "routing_team": "nobody", "confidence": 0.9}'
            WHEN 3 THEN '{"category": "billing", "priority": "low"}'
            WHEN 4 THEN '{"category": {"nested": "bug"}, "confidence": 0.4}'
            WHEN 5 THEN '{"category": "security", "priority": "critical", "routing_team": "security", "confidence": -1}'
            WHEN 6 THEN '{"category": 7, "priority": "low", "confidence": 0.9}'
            WHEN 7 THEN '{"category": "docs", "priority": "low", "confidence": "high"}'
            WHEN 8 THEN '{"category": "ui", "priority": "low", "routing_team": "support", "confidence": "0.8"}'
            ELSE '{"category": "incident", "priority": "high", "routing_team": "infra", "confidence": 0.74}' END AS primary_raw,
       CASE o_orderkey % 3
            WHEN 0 THEN 'broken {'
            ELSE '{"category": "performance", "priority": "medium", "routing_team": "infra", "confidence": 0.8}' END AS fallback_raw,
       CASE o_orderkey % 5
            WHEN 0 THEN '{"score": 1.0, "reason": "supported"}'
            WHEN 1 THEN '{"score": 0.25}'
            WHEN 2 THEN 'cannot grade'
            WHEN 3 THEN '{"reason": "no score"}'
            ELSE '{"score": "0.5", "reason": "half"}' END AS judge_raw
FROM orders
"""

RAW_GITHUB = """
SELECT subject AS title, body, labels_raw AS labels, created_raw AS created_at,
       CASE WHEN doc_id % 12 = 0 THEN NULL ELSE 'org/app' END AS repo, doc_id AS issue_number
FROM fx_tickets WHERE source = 'github'
"""
RAW_A = """
SELECT subject, body, labels_raw[{first}] AS queue, customer_tier AS type
FROM fx_tickets WHERE source = 'hf_customer_support'
"""
RAW_B = """
SELECT subject AS Ticket_Subject, body AS Combined_Text, labels_raw[{first}] AS Ticket_Type
FROM fx_tickets WHERE source = 'zendesk'
"""
RAW_SYNTHETIC = """
SELECT ticket_id, source, created_raw AS created_at, subject, body, labels_raw, priority_raw AS priority, customer_tier
FROM fx_tickets WHERE source = 'synthetic'
"""

LABELLED = """
SELECT d.doc_id, concat('DOC-', CAST(d.doc_id AS STRING)) AS ticket_id, d.n_chars, l.quality, l.toxic,
       CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS y_true,
       CASE WHEN d.n_chars > 2000 THEN ' Good' WHEN d.n_chars > 500 THEN 'poor' ELSE 'junk' END AS y_pred,
       CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS flag
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

# view -> (tables or views it reads, text)
VIEWS = {
    "fx_tickets": (("documents",), TICKETS),
    "fx_log": (("events",), LOG),
    "fx_kb": (("embeddings",), KB),
    "fx_orders_triage": (("orders",), ORDERS),
    "fx_replies": (("orders",), REPLIES),
    "fx_sla": (("orders",), SLA),
    "fx_labelled": (("documents", "labels"), LABELLED),
    "fx_raw_github": (("fx_tickets",), RAW_GITHUB),
    "fx_raw_a": (("fx_tickets",), RAW_A),
    "fx_raw_b": (("fx_tickets",), RAW_B),
    "fx_raw_synthetic": (("fx_tickets",), RAW_SYNTHETIC),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, in as many partitions as the session asks for in ``ticketflow.readPartitions`` (unset: as read)."""
    rows = prepare(spark).read.parquet(f"{sf}/{name}.parquet")
    parts = spark.conf.get("ticketflow.readPartitions", None)
    return rows.repartition(int(parts)) if parts else rows


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a DataFrame. Arrays count from 0 in Spark SQL."""
    parents, sql = VIEWS[name]
    for parent in parents:
        source = fixture(spark, sf, parent) if parent in VIEWS else table(spark, sf, parent)
        source.createOrReplaceTempView(parent)
    return spark.sql(sql.replace("{first}", "0"))


def with_views(*names: str) -> str:
    """The same views as a WITH clause. Arrays count from 1 there."""
    wanted: list[str] = []
    for name in names:
        for view in (*[p for p in VIEWS[name][0] if p in VIEWS], name):
            if view not in wanted:
                wanted.append(view)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v][1].replace('{first}', '1')})" for v in wanted)


def bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets under their Bronze names; every fifth one comes without an id."""
    return prepare(spark).sql(BRONZE_OF.format(view=_named(spark, sf)))


BRONZE_OF = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ticket_id END AS ticket_id, source,
       created_raw AS created_at, subject, body, labels_raw, priority_raw AS priority, customer_tier, reopen_count
FROM {view}
"""


def _named(spark: SparkSession, sf: str) -> str:
    fixture(spark, sf, "fx_tickets").createOrReplaceTempView("fx_tickets")
    return "fx_tickets"
