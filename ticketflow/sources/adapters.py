"""Raw sources to Bronze. Ids that the source lacks are hashes of the row, so reruns agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_BODY


def _hash(*columns: Column) -> Column:
    """40 hex digits: ids key everything later, and must not collide on any number of rows."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.sha1(F.concat_ws("\x1f", *parts))


def admit(df: DataFrame) -> DataFrame:
    """Rows with a subject and a body of at least 20 characters."""
    return df.where((F.coalesce("subject", F.lit("")) != "") & (F.length("body") >= MIN_BODY))


def adapt_github(df: DataFrame) -> DataFrame:
    number = F.coalesce(F.col("issue_number").cast("string"), _hash(F.col("title"), F.col("body")))
    return admit(df.select(
        F.concat(F.lit("GH-"), F.coalesce("repo", F.lit("unknown")), F.lit("-"), number).alias("ticket_id"),
        F.lit("github").alias("source"), "created_at", F.col("title").alias("subject"), "body",
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels_raw")))


def adapt_support_a(df: DataFrame) -> DataFrame:
    return admit(df.select(
        F.concat(F.lit("HF-A-"), _hash(F.col("subject"), F.col("body"))).alias("ticket_id"),
        F.lit("hf_customer_support").alias("source"), F.lit(None).cast("string").alias("created_at"),
        "subject", "body",
        F.array(F.coalesce("queue", F.lit("")), F.coalesce("type", F.lit(""))).alias("labels_raw")))


def adapt_support_b(df: DataFrame, subject: str = "Ticket Subject", body: str = "Combined Text",
                    kind: str = "Ticket Type") -> DataFrame:
    def named(c):
        return F.col(f"`{c}`")
    return admit(df.select(
        F.concat(F.lit("HF-B-"), _hash(named(subject), named(body))).alias("ticket_id"),
        F.lit("hf_customer_support").alias("source"), F.lit(None).cast("string").alias("created_at"),
        named(subject).alias("subject"), named(body).alias("body"),
        F.array(F.coalesce(named(kind), F.lit(""))).alias("labels_raw")))


def adapt_passthrough(df: DataFrame) -> DataFrame:
    """Rows already in Bronze form; extra columns survive."""
    return admit(df)


def combine(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def source_counts(df: DataFrame) -> DataFrame:
    """Rows per source and in total."""
    return df.rollup("source").count().select(F.coalesce("source", F.lit("total")).alias("source"),
                                              F.col("count").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def provenance(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Source metadata with row counts; a source without rows keeps a null count."""
    return meta.join(df.groupBy("source").agg(F.count(F.lit(1)).alias("row_count")), "source", "left")

