"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import norm_label
from .ranking import running_sums


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    rate = F.avg(F.col(label).cast("double"))
    weight = F.when(rate > 0, F.greatest(F.lit(1.0), (1 - rate) / rate)).otherwise(1.0)
    return df.agg(rate.alias("positive_rate"), weight.alias("weight"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve from mid-ranks.

    Rows collapse to distinct scores first; the running count of negatives is built over blocks of
    scores. Null when a class is absent.
    """
    hist = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))
    ranked = running_sums(hist, ["score"], ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return ranked.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                      F.try_divide(wins, pos * neg).alias("auc"))


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), _ratio(tp, tp + fp).alias("precision"),
                  _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pair_predictions(predicted: DataFrame, truth: DataFrame, key: str = "ticket_id") -> DataFrame:
    """``(key, y_true, y_pred)``, both labels cleaned."""
    return (truth.select(key, norm_label(F.col("category")).alias("y_true"))
            .join(predicted.select(key, norm_label(F.coalesce("category", F.lit("question"))).alias("y_pred")), key))


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support of every class seen on either side, and their plain mean.

    Rows collapse to one count per pair of classes before anything else.
    """
    pairs = df.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 hit.alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))))
    tp, support, predicted = F.sum("tp"), F.sum("support"), F.sum("predicted")
    classes = sides.groupBy("label").agg(
        _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"), support.alias("support"), tp.alias("tp"))
    return classes.rollup("label").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("support"), _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
    ).withColumn("label", F.coalesce("label", F.lit("macro avg")))


def cascade_stats(df: DataFrame, reply: str = "reply", ms: str | None = None) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(reply)["escalated"]).alias("escalated"),
                  F.avg(F.col(reply)["escalated"].cast("int")).alias("escalation_rate")]
    if ms:
        aggregates.append((F.avg(ms) / 1000).alias("avg_seconds"))
    return df.agg(*aggregates)


def _matches(hits: DataFrame) -> DataFrame:
    same = norm_label(F.col("query_category")) == norm_label(F.col("category"))
    return hits.groupBy("query_id").agg(F.first(norm_label(F.col("query_category"))).alias("query_category"),
                                        F.count_if(same).alias("matches"))


def hit_rate_at_k(hits: DataFrame) -> DataFrame:
    """Share of queries with a neighbour of their own category."""
    found = (F.col("matches") > 0).cast("int")
    return _matches(hits).agg(F.count(F.lit(1)).alias("queries"), F.sum(found).alias("found"),
                              F.avg(found).alias("hit_rate"))


def precision_at_k(hits: DataFrame, k: int) -> DataFrame:
    """Per category, matches over k times the number of queries, however many rows came back."""
    return _matches(hits).groupBy("query_category").agg(
        F.count(F.lit(1)).alias("queries"),
        (F.sum("matches") / (F.count(F.lit(1)) * k)).alias("precision"))


def routing_eval(result: DataFrame, expected: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Produced next to expected routing, with whether team and escalation agree."""
    pairs = result.join(expected.select(key, "expected_team", "expected_escalate"), key)
    return pairs.withColumns({"team_ok": F.col("routing_team") == F.col("expected_team"),
                              "escalation_ok": F.col("auto_escalate") == F.col("expected_escalate")})


def observe_batch(df: DataFrame, observation: Observation, reply: str = "reply") -> DataFrame:
    """Count rows and escalations of a batch while something else consumes it."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.col(reply)["escalated"]).alias("escalated"))


def routing_accuracy(df: DataFrame, ms: str | None = None) -> DataFrame:
    """Columns ``routing_team``, ``auto_escalate`` against ``expected_team``, ``expected_escalate``."""
    team = F.col("routing_team") == F.col("expected_team")
    hot = F.col("auto_escalate") == F.col("expected_escalate")
    aggregates = [F.count(F.lit(1)).alias("n"), F.avg(team.cast("int")).alias("team_accuracy"),
                  F.avg(hot.cast("int")).alias("escalation_accuracy"),
                  F.avg((team & hot).cast("int")).alias("full_match")]
    if ms:
        aggregates.append(F.avg(ms).alias("avg_ms"))
    return df.agg(*aggregates)
