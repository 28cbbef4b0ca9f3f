"""The triage log: rows, statistics, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import percent
from ..session import stage
from .ranking import running_sums
from .split import numeric

TIMINGS = ("total_ms", "classify_ms", "retrieve_ms", "rag_ms")


def to_log_rows(df: DataFrame) -> DataFrame:
    """Triage results as log rows. ``timings`` is a map; a stage that did not run counts as 0."""
    stage = [F.coalesce(F.try_element_at("timings", F.lit(name)), F.lit(0.0)).alias(name) for name in TIMINGS]
    return df.select(
        "ts", "ticket_id", F.substring("subject", 1, 200).alias("subject"), "category", "priority", "routing_team",
        F.col("auto_escalate").cast("int").alias("auto_escalate"),
        F.round("sla_risk", 4).alias("sla_risk"), F.round("confidence", 4).alias("confidence"),
        *stage, F.col("run_rag").cast("int").alias("run_rag"),
    )


def log_stats(log: DataFrame) -> DataFrame:
    """One row of totals, zero on an empty log."""
    total, hot = F.count(F.lit(1)), F.count_if(F.col("auto_escalate") == 1)
    rate = F.when(total > 0, F.round(hot / total, 3)).otherwise(0.0)
    return log.agg(total.alias("total"), hot.alias("escalated"), rate.alias("escalation_rate"),
                   F.round(F.coalesce(F.avg("total_ms"), F.lit(0.0)), 0).alias("avg_latency_ms"))


def category_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def recent(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


def display_log(log: DataFrame) -> DataFrame:
    """The log as shown to people, in the columns it has."""
    shown: dict[str, Column] = {
        "ts": F.col("ts"), "ticket_id": F.col("ticket_id"), "category": F.col("category"),
        "priority": F.col("priority"), "routing_team": F.col("routing_team"),
        "auto_escalate": F.when(F.col("auto_escalate") == 1, "YES").when(F.col("auto_escalate") == 0, "no"),
        "sla_risk": percent(F.col("sla_risk")), "confidence": percent(F.col("confidence")),
        "total_ms": F.concat(F.bround("total_ms", 0).cast("bigint").cast("string"), F.lit("ms")),
    }
    return log.select(*[c.alias(name) for name, c in shown.items() if name in log.columns])


def display_hits(hits: DataFrame) -> DataFrame:
    """Similar tickets as shown to people: one decimal of percent, half-even on the four stored digits."""
    tenths = F.bround(F.col("similarity").cast("decimal(10,4)") * 100, 1)
    shown = F.concat(tenths.cast("decimal(10,1)").cast("string"), F.lit("%"))
    columns = [c for c in ("query_id", "ticket_id", "similarity", "category", "priority", "subject") if c in hits.columns]
    return hits.select(*[shown.alias(c) if c == "similarity" else F.col(c) for c in columns])


def explode_timings(df: DataFrame, key: str, timings: str = "timings") -> DataFrame:
    """One row per stage, with a readable name."""
    step = F.initcap(F.replace(F.regexp_replace("stage", "_ms", ""), F.lit("_"), F.lit(" ")))
    return (df.select(key, F.explode(timings).alias("stage", "ms"))
            .where((F.col("stage") != "total_ms") & F.col("ms").isNotNull())
            .select(key, step.alias("step"), F.round("ms", 1).alias("latency_ms")))


def total_ms(timings: Column) -> Column:
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def latency_stats(df: DataFrame, column: str, fraction: float = 0.99) -> DataFrame:
    """Mean, and the element at index floor(fraction * n) of the ascending values.

    Rows collapse to a count per value before anything is sorted, so a value that most rows have is one row. The table is read once.
    """
    known = df.where(F.col(column).isNotNull()).select(numeric(df, column).alias("value"))
    counts = stage(known.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("avg_ms")).first()
    at = int(fraction * total["n"])
    ranked = running_sums(counts, ["value"], ["n"])
    found = ranked.where((F.col("before_n") <= at) & (F.col("before_n") + F.col("n") > at))
    return found.agg(F.lit(total["n"]).cast("bigint").alias("n"), F.lit(total["avg_ms"]).cast("double").alias("avg_ms"),
                     F.max("value").cast("double").alias("p99_ms"))
