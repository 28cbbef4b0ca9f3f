"""Data-quality rules: a whole suite is one aggregate over the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES, MIN_BODY, MIN_ROWS, PRIORITIES, SOURCES, TEAMS, TIERS


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str
    bad: Column | None = None
    min_rows: int = 0


def row_count(minimum: int = MIN_ROWS) -> Rule:
    return Rule("row_count", "*", min_rows=minimum)


def exists(column: str) -> Rule:
    return Rule("exists", column)


def not_null(column: str) -> Rule:
    return Rule("not_null", column, F.col(column).isNull())


def in_set(column: str, values: tuple[str, ...]) -> Rule:
    return Rule("in_set", column, F.col(column).isNotNull() & ~F.col(column).isin(*values))


def min_length(column: str, n: int = MIN_BODY) -> Rule:
    return Rule("min_length", column, F.length(column) < n)


def bronze_suite(minimum: int = MIN_ROWS) -> list[Rule]:
    return [row_count(minimum), exists("ticket_id"), not_null("ticket_id"), exists("source"),
            in_set("source", SOURCES), exists("body"), not_null("body"), min_length("body"), exists("subject"),
            not_null("subject"), exists("created_at")]


def silver_suite(minimum: int = MIN_ROWS) -> list[Rule]:
    there = ("ticket_id", "source", "subject", "body", "category", "priority", "routing_team", "created_at",
             "pii_flags")
    full = ("ticket_id", "subject", "body", "category", "priority", "routing_team")
    return [row_count(minimum), *[exists(c) for c in there], *[not_null(c) for c in full],
            in_set("category", CATEGORIES), in_set("priority", PRIORITIES), in_set("routing_team", TEAMS),
            min_length("body")]


def bronze_gate(minimum: int = MIN_ROWS) -> list[Rule]:
    """The six rules checked between stages."""
    return [row_count(minimum), exists("ticket_id"), not_null("ticket_id"), exists("body"), not_null("body"),
            min_length("body")]


def silver_gate(minimum: int = MIN_ROWS) -> list[Rule]:
    """The four rules checked between stages."""
    return [row_count(minimum), in_set("category", CATEGORIES), in_set("priority", PRIORITIES),
            not_null("ticket_id")]


def expectations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(rule, column, success, unexpected_count)`` per rule, from one pass.

    Existence is answered by the schema; a value rule on an absent column fails without being run.
    """
    have = set(df.columns)
    aggregates, rows = [], []
    for i, rule in enumerate(rules):
        if rule.kind == "row_count":
            aggregates.append(F.count(F.lit(1)).alias(f"r{i}"))
            n = F.col(f"r{i}")
            success, bad = n >= rule.min_rows, F.greatest(F.lit(rule.min_rows) - n, F.lit(0))
        elif rule.kind == "exists" or rule.column not in have:
            success, bad = F.lit(rule.column in have), F.lit(0 if rule.column in have else 1).cast("bigint")
        else:
            aggregates.append(F.count_if(rule.bad).alias(f"r{i}"))
            success, bad = F.col(f"r{i}") == 0, F.col(f"r{i}")
        rows.append(F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.column).alias("column"),
                             success.alias("success"), bad.cast("bigint").alias("unexpected_count")))
    one = df.agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))
    return one.select(F.inline(F.array(*rows)))


class GateError(RuntimeError):
    pass


def gate(df: DataFrame, rules: list[Rule], name: str) -> tuple[int, int]:
    """Passed and failed rule counts. Raises with the failed rules; the result has one row per rule."""
    results = expectations(df, rules).collect()
    failed = [f"{r['rule']}({r['column']})" for r in results if not r["success"]]
    if failed:
        raise GateError(f"{name}: {', '.join(failed)}")
    return len(results), 0


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
                                     for name, ok in checks.items()]))


def validate_requests(df: DataFrame) -> DataFrame:
    """Requests with defaults filled and an array of ``reasons``, empty where the request is valid."""
    out = df
    defaults = {"ticket_id": F.lit(""), "run_rag": F.lit(True)}
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), value) if c in df.columns else value)
    length = {"subject": 500, "body": 10_000}
    checks = {c: (F.length(c).between(1, n) if c in df.columns else F.lit(False)) for c, n in length.items()}
    return out.withColumn("reasons", reasons(checks))


def validate_tickets(df: DataFrame) -> DataFrame:
    """Tickets with defaults filled and an array of ``reasons``."""
    have, out = set(df.columns), df
    strings = F.array().cast("array<string>")
    defaults = {"customer_tier": F.lit("free"), "reopen_count": F.lit(0), "labels_raw": strings,
                "comments": strings}
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), value) if c in have else value)
    there = {c: (F.col(c).isNotNull() if c in have else F.lit(False))
             for c in ("ticket_id", "created_at", "subject", "body")}
    allowed = {"source": SOURCES, "category": CATEGORIES, "priority": PRIORITIES, "routing_team": TEAMS,
               "customer_tier": TIERS}
    member = {c: (F.col(c).isin(*values) if c in set(out.columns) else F.lit(False))
              for c, values in allowed.items()}
    return out.withColumn("reasons", reasons({**there, **member}))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("reasons") == 0
    return df.where(ok).drop("reasons"), df.where(~ok)
