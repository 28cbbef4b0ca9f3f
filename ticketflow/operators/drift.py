"""Distributions and their distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DRIFT_EPSILON, DRIFT_MIN_LIVE
from ..functions.rules import drift_band
from ..session import stage
from .split import time_split


def shares(df: DataFrame, column: str = "category", weight: str | None = None) -> DataFrame:
    """Count and share of each value, nulls excluded. ``weight`` names the counts of a table that is counted already.

    The total is a scalar subquery over the counts, not a window over the rows.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(rows.alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("p"))


def align(expected: DataFrame, actual: DataFrame, column: str = "category") -> DataFrame:
    """Both distributions on the union of their values, absent ones as 0."""
    zero = F.lit(0.0)
    return (expected.select(column, F.col("p").alias("p_expected"))
            .join(actual.select(column, F.col("p").alias("p_actual")), column, "full_outer")
            .select(column, F.coalesce("p_expected", zero).alias("p_expected"),
                    F.coalesce("p_actual", zero).alias("p_actual")))


def _smooth() -> tuple[Column, Column, Column]:
    e, a = F.col("p_expected") + DRIFT_EPSILON, F.col("p_actual") + DRIFT_EPSILON
    return e, a, F.log(a / e)


def psi() -> Column:
    """Population stability index of an aligned table, as one aggregate.

    With shares renormalised by their sums E and A, the terms in ln(E/A) cancel, which leaves
    sum(a ln(a/e))/A - sum(e ln(a/e))/E.
    """
    e, a, ratio = _smooth()
    return F.sum(a * ratio) / F.sum(a) - F.sum(e * ratio) / F.sum(e)


def kl() -> Column:
    """Kullback-Leibler divergence of the actual from the expected shares, in nats."""
    e, a, ratio = _smooth()
    return F.sum(a * ratio) / F.sum(a) + F.log(F.sum(e) / F.sum(a))


def drift_report(train: DataFrame, live: DataFrame, column: str = "category", weight: str | None = None) -> DataFrame:
    """One row of drift figures, or none while there are no live rows."""
    expected, actual = shares(train, column, weight), shares(live, column, weight)
    both = (expected.select(column, F.col("p").alias("p_expected"), F.lit(0).cast("bigint").alias("n_live"))
            .unionByName(actual.select(column, F.col("p").alias("p_actual"), F.col("n").alias("n_live")),
                         allowMissingColumns=True)
            .groupBy(column).agg(F.sum("p_expected").alias("e"), F.sum("p_actual").alias("a"),
                                 F.sum("n_live").alias("n_live"))
            .select(column, F.coalesce("e", F.lit(0.0)).alias("p_expected"),
                    F.coalesce("a", F.lit(0.0)).alias("p_actual"),
                    F.col("e").isNotNull().alias("in_train"), F.col("a").isNotNull().alias("in_live"), "n_live"))
    report = both.agg(psi().alias("psi"), kl().alias("kl"),
                      F.count_if("in_train").alias("train_categories"),
                      F.count_if("in_live").alias("live_categories"),
                      F.coalesce(F.sum("n_live"), F.lit(0)).alias("live_rows"))
    return (report.where(F.col("live_rows") > 0)
            .withColumn("band", drift_band(F.col("psi")))
            .withColumn("low_sample", F.col("live_rows") < DRIFT_MIN_LIVE))


def drift_by(train: DataFrame, live: DataFrame, by: str, column: str = "category") -> DataFrame:
    """PSI of each period of ``live`` against ``train``; periods are compared on the union of values."""
    counts = live.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    return drift_of_counts(train, counts, by, column)


def counted_splits(df: DataFrame, ts: str, tie: str, column: str = "category") -> DataFrame:
    """``(split, day, column, n)``: all that the drift figures need. The table is read once, for the three columns."""
    rows = time_split(stage(df.select(ts, tie, column), "drift-rows"), ts, tie)
    day = F.to_date(ts).cast("string").alias("day")
    return stage(rows.groupBy("split", day, column).agg(F.count(F.lit(1)).alias("n")), "drift-counts")


def drift_of_counts(train: DataFrame, counts: DataFrame, by: str, column: str = "category", weight: str | None = None) -> DataFrame:
    """PSI per period from counts ``(by, column, n)``.

    Terms split in two: values present in the period, and training values the period lacks. The latter
    share one actual value, epsilon, so they come from totals over the training table instead of from a
    product of periods and values.
    """
    eps = DRIFT_EPSILON
    expected = shares(train, column, weight)
    totals = expected.agg(F.sum(F.col("p") + eps).alias("e"), F.count(F.lit(1)).alias("m"),
                          F.sum(F.log(eps / (F.col("p") + eps))).alias("l"),
                          F.sum((F.col("p") + eps) * F.log(eps / (F.col("p") + eps))).alias("el"))
    period = counts.groupBy(by).agg(F.sum("n").alias("total"))
    joined = (counts.join(period, by)
              .join(expected.select(column, F.col("p").alias("pe")), column, "left")
              .withColumn("pa", F.col("n") / F.col("total")))
    pe, known = F.coalesce("pe", F.lit(0.0)), F.col("pe").isNotNull().cast("int")
    e, a = pe + eps, F.col("pa") + eps
    base = F.log(eps / e)
    sums = joined.groupBy(by).agg(
        F.max("total").alias("n"), F.sum(a).alias("a_sum"), F.sum(a * F.log(a / e)).alias("al"),
        F.sum(e * F.log(a / e)).alias("el_here"), F.sum(e * (1 - known)).alias("e_new"),
        F.sum(known).alias("m_here"), F.sum(base * known).alias("l_here"), F.sum(e * base * known).alias("el_known"))
    one = {c: totals.select(c).scalar() for c in ("e", "m", "l", "el")}
    a_all = F.col("a_sum") + eps * (one["m"] - F.col("m_here"))
    al_all = F.col("al") + eps * (one["l"] - F.col("l_here"))
    e_all = one["e"] + F.col("e_new")
    el_all = F.col("el_here") + one["el"] - F.col("el_known")
    value = al_all / a_all - el_all / e_all
    return sums.select(by, "n", value.alias("psi"), drift_band(value).alias("band"))

