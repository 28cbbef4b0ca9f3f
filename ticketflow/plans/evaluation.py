"""End-to-end evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import (
    cascade_stats, classification_report, hit_rate_at_k, precision_at_k,
)
from ..functions.text import norm_label
from ..operators.models import Batch, classify
from ..operators.split import sample_n
from ..operators.vectors import top_k
from ..session import stage


def neighbours(queries: DataFrame, kb: DataFrame, k: int, exclude_self: bool = False, **options) -> DataFrame:
    """Hits with the category of the query next to that of the hit; a query without a hit has one row without one."""
    hits = top_k(queries, kb, k, exclude_self=exclude_self, **options)
    asked = queries.select(F.col("ticket_id").alias("query_id"), F.col("category").alias("query_category"))
    return asked.join(hits, "query_id", "left")


def eval_retrieval(queries: DataFrame, kb: DataFrame, k: int = 5, sample: int | None = 200,
                   exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hit rate, and precision per category. A query that is itself indexed finds itself unless excluded."""
    chosen = sample_n(queries, sample, "ticket_id") if sample else queries
    hits = stage(neighbours(chosen, kb, k, exclude_self), "neighbours")
    return hit_rate_at_k(hits), precision_at_k(hits, k)


def eval_classifier(tickets: DataFrame, primary: Batch, fallback: Batch | None = None,
                    sample: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """Report per class, and escalation figures, on a seeded sample of labelled tickets."""
    chosen = sample_n(tickets, sample, "ticket_id") if sample else tickets
    replies = stage(classify(chosen.select("ticket_id", "subject", "body", "category"), primary, fallback), "replies")
    pairs = replies.select("ticket_id", norm_label(F.col("category")).alias("y_true"),
                           norm_label(F.coalesce("reply.category", F.lit("question"))).alias("y_pred"))
    return (classification_report(pairs),
            cascade_stats(replies, ms="classify_ms"))
