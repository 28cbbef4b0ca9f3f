"""Silver to Gold: chronological split, features, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import features
from ..functions.text import embed_text
from ..operators.models import embed
from ..operators.split import layer_summary, time_split
from ..sources.readers import read_layer
from ..sources.sinks import write_features, write_layer, write_splits, write_vectors


def gold_features(tickets: DataFrame, as_of: str) -> DataFrame:
    """Features per ticket with the time at which they hold and the split, where the table has one."""
    keep = ("ticket_id",) + (("split",) if "split" in tickets.columns else ())
    timed = tickets.withColumn("event_timestamp", F.col("created_at"))
    return features(timed, as_of, keep=(*keep, "event_timestamp"))


def gold_vectors(tickets: DataFrame, embedder=None, dim: int | None = None) -> DataFrame:
    text = tickets.select("ticket_id", "split", "category", "priority", "subject",
                          embed_text(F.col("subject"), F.col("body")).alias("text"))
    return embed(text, "text", embedder, **({"dim": dim} if dim else {})).drop("text")


def build_gold(spark: SparkSession, silver: str, gold: str, as_of: str, embedder=None, with_vectors: bool = True,
               dim: int | None = None) -> DataFrame:
    """Write ``splits``, ``features``, ``vectors`` and ``summary`` below ``gold``; return the summary.

    Later layers read the splits back, so the split is computed once.
    """
    write_splits(time_split(read_layer(spark, silver), "created_at", "ticket_id"), f"{gold}/splits")
    splits = read_layer(spark, f"{gold}/splits")
    write_features(gold_features(splits, as_of), f"{gold}/features")
    if with_vectors:
        write_vectors(gold_vectors(splits, embedder, dim), f"{gold}/vectors")
    summary = layer_summary(splits, with_vectors)
    write_layer(summary, f"{gold}/summary")
    return read_layer(spark, f"{gold}/summary")
