"""Queries over the triage log and its drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log as ops
from ..operators.drift import align, counted_splits, drift_of_counts, drift_report, kl, psi, shares
from ..session import work_path
from ..sources.readers import read_triage_log
from ..sources.sinks import append_log
from .fixtures import fixture, with_views
from .registry import query

LOG = with_views("fx_log")
HALVES = LOG + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS rn, count(*) OVER () AS total FROM fx_log),
train AS (SELECT category, count(*) / sum(count(*)) OVER () AS p FROM ranked WHERE rn < floor(total * 0.7) GROUP BY category),
live AS (SELECT category, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM ranked WHERE rn >= floor(total * 0.7) GROUP BY category),
both_sides AS (SELECT coalesce(t.category, l.category) AS category, coalesce(t.p, 0) AS e, coalesce(l.p, 0) AS a,
               t.category AS tc, l.category AS lc, l.n FROM train t FULL JOIN live l ON t.category = l.category),
smooth AS (SELECT *, (e + 1e-4) / sum(e + 1e-4) OVER () AS es, (a + 1e-4) / sum(a + 1e-4) OVER () AS acs FROM both_sides)
"""


def halves(spark, sf):
    """Counts of the older part of the log and of the rest, by day and category."""
    rows = counted_splits(fixture(spark, sf, "fx_log"), "ts", "id")
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")


@query("scan_log", LOG + "SELECT row_number() OVER (ORDER BY ts, ticket_id) AS id, category FROM fx_log")
def scan_log(spark, sf):
    """The log appended to a table, and two columns of it read back."""
    path = work_path(spark, "log")
    append_log(ops.to_log_rows(as_results(fixture(spark, sf, "fx_log"))), path)
    return read_triage_log(spark, path, ["id", "category"])


def as_results(log):
    """The log as triage results with a map of timings."""
    timings = F.map_filter(F.create_map(
        F.lit("total_ms"), F.col("total_ms"), F.lit("classify_ms"), F.col("classify_ms"),
        F.lit("retrieve_ms"), F.col("retrieve_ms"), F.lit("rag_ms"), F.col("rag_ms")),
        lambda _, v: v.isNotNull())
    return log.select("id", "ts", "ticket_id", F.repeat("subject", 20).alias("subject"), "category", "priority",
                      F.lit("support").alias("routing_team"), (F.col("auto_escalate") == 1).alias("auto_escalate"),
                      "sla_risk", "confidence", timings.alias("timings"), (F.col("run_rag") == 1).alias("run_rag"))


LOG_ROWS = """
SELECT ts, ticket_id, substr(repeat(subject, 20), 1, 200) AS subject, category, priority, 'support' AS routing_team,
       auto_escalate, round(sla_risk, 4) AS sla_risk, round(confidence, 4) AS confidence, total_ms, classify_ms, retrieve_ms,
       coalesce(rag_ms, 0) AS rag_ms, run_rag FROM fx_log"""


@query("log_rows", LOG + LOG_ROWS)
def log_rows(spark, sf):
    return ops.to_log_rows(as_results(fixture(spark, sf, "fx_log")))


@query("log_stats", LOG + """
SELECT count(*) AS total, count(*) FILTER (WHERE auto_escalate = 1) AS escalated,
       round(count(*) FILTER (WHERE auto_escalate = 1) / count(*), 3) AS escalation_rate,
       round(avg(total_ms), 0) AS avg_latency_ms FROM fx_log""")
def log_stats(spark, sf):
    return ops.log_stats(fixture(spark, sf, "fx_log"))


@query("category_counts", LOG + "SELECT category, count(*) AS n FROM fx_log GROUP BY category ORDER BY n DESC, category")
def category_counts(spark, sf):
    return ops.category_counts(fixture(spark, sf, "fx_log"))


@query("recent", LOG + "SELECT id, ts, ticket_id, category FROM fx_log ORDER BY id DESC LIMIT 50")
def recent(spark, sf):
    return ops.recent(fixture(spark, sf, "fx_log").select("id", "ts", "ticket_id", "category"))


@query("display_log", LOG + """
SELECT ts, ticket_id, category, priority, CASE WHEN auto_escalate = 1 THEN 'YES' ELSE 'no' END AS auto_escalate,
       concat(CAST(CAST(round_even(sla_risk * 100, 0) AS BIGINT) AS VARCHAR), '%') AS sla_risk,
       concat(CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR), '%') AS confidence,
       concat(CAST(CAST(round_even(total_ms, 0) AS BIGINT) AS VARCHAR), 'ms') AS total_ms FROM fx_log""")
def display_log(spark, sf):
    return ops.display_log(fixture(spark, sf, "fx_log"))


@query("explode_timings", LOG + """
SELECT id, step, CAST(round(CAST(CAST(ms AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DOUBLE) AS latency_ms, round(classify_ms + retrieve_ms + coalesce(rag_ms, 0), 4) AS total FROM (
  SELECT id, 'Classify' AS step, classify_ms AS ms, * EXCLUDE (id) FROM fx_log
  UNION ALL SELECT id, 'Retrieve', retrieve_ms, * EXCLUDE (id) FROM fx_log
  UNION ALL SELECT id, 'Rag', rag_ms, * EXCLUDE (id) FROM fx_log) WHERE ms IS NOT NULL""")
def explode_timings(spark, sf):
    results = as_results(fixture(spark, sf, "fx_log"))
    stages = F.map_filter("timings", lambda k, _: k != "total_ms")
    keyed = results.select(F.struct("id", F.round(ops.total_ms(stages), 4).alias("total")).alias("key"), "timings")
    return ops.explode_timings(keyed, "key").select("key.id", "step", "latency_ms", "key.total")


@query("latency_stats", LOG + """,
r AS (SELECT total_ms, row_number() OVER (ORDER BY total_ms) - 1 AS rn, count(*) OVER () AS n FROM fx_log)
SELECT count(*) AS n, round(avg(total_ms), 6) AS avg_ms, max(total_ms) FILTER (WHERE rn = floor(0.99 * n)) AS p99_ms FROM r""")
def latency_stats(spark, sf):
    stats = ops.latency_stats(fixture(spark, sf, "fx_log"), "total_ms")
    return stats.withColumn("avg_ms", F.round("avg_ms", 6))


@query("distribution", LOG + "SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM fx_log GROUP BY category")
def distribution(spark, sf):
    return shares(fixture(spark, sf, "fx_log")).withColumn("p", F.round("p", 9))


@query("drift_align", HALVES + "SELECT category, round(e, 9) AS p_expected, round(a, 9) AS p_actual FROM both_sides")
def drift_align(spark, sf):
    train, live = halves(spark, sf)
    return align(shares(train, weight="n"), shares(live, weight="n")).select(
        "category", F.round("p_expected", 9).alias("p_expected"), F.round("p_actual", 9).alias("p_actual"))


@query("drift_psi", HALVES + """
SELECT round(psi, 8) AS psi, round(kl, 8) AS kl, train_categories, live_categories, live_rows,
       CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warn' ELSE 'alert' END AS band, live_rows < 20 AS low_sample
FROM (SELECT sum((acs - es) * ln(acs / es)) AS psi, sum(acs * ln(acs / es)) AS kl, count(tc) AS train_categories,
             count(lc) AS live_categories, CAST(sum(n) AS BIGINT) AS live_rows FROM smooth)""")
def drift_psi(spark, sf):
    report = drift_report(*halves(spark, sf), weight="n")
    return report.withColumns({"psi": F.round("psi", 8), "kl": F.round("kl", 8)})


@query("drift_kl", HALVES + "SELECT round(sum(acs * ln(acs / es)), 8) AS kl, round(sum((acs - es) * ln(acs / es)), 8) AS psi FROM smooth")
def drift_kl(spark, sf):
    train, live = halves(spark, sf)
    return align(shares(train, weight="n"), shares(live, weight="n")).agg(F.round(kl(), 8).alias("kl"), F.round(psi(), 8).alias("psi"))


DAILY = HALVES + """,
days AS (SELECT CAST(ts AS DATE) AS day, category, count(*) AS n FROM ranked WHERE {live} GROUP BY ALL),
totals AS (SELECT day, sum(n) AS total FROM days GROUP BY day),
names AS (SELECT category FROM train UNION SELECT category FROM days),
grid AS (SELECT t.day, c.category, t.total FROM totals t CROSS JOIN names c),
cells AS (SELECT g.day, g.category, g.total, coalesce(tr.p, 0) + 1e-4 AS e, coalesce(d.n, 0) / g.total + 1e-4 AS a,
                 tr.category IS NOT NULL OR d.category IS NOT NULL AS used
          FROM grid g LEFT JOIN train tr ON g.category = tr.category
          LEFT JOIN days d ON d.day = g.day AND d.category = g.category),
norm AS (SELECT day, total, e / sum(e) OVER (PARTITION BY day) AS es, a / sum(a) OVER (PARTITION BY day) AS acs
         FROM cells WHERE used),
daily AS (SELECT day, CAST(max(total) AS BIGINT) AS n, sum((acs - es) * ln(acs / es)) AS psi FROM norm GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, n, round(psi, 8) AS psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warn' ELSE 'alert' END AS band FROM daily
"""


@query("drift_daily", DAILY.replace("{live}", "rn >= floor(total * 0.7)"))
def drift_daily(spark, sf):
    train, live = halves(spark, sf)
    return drift_of_counts(train, live.groupBy("day", "category").agg(F.sum("n").alias("n")), "day", weight="n").withColumn("psi", F.round("psi", 8))
