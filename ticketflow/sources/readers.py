"""Readers. Every one has an explicit schema or reads Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import strip
from ..schemas import BRONZE, TRIAGE_LOG

CORRUPT = "_corrupt_record"


def read_json_source(spark: SparkSession, glob: str, schema: StructType) -> DataFrame:
    """Rows of JSON-array files. A file that cannot be parsed yields no rows and stops nothing."""
    with_bad = StructType([*schema.fields]).add(CORRUPT, StringType())
    rows = (spark.read.schema(with_bad).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("ignoreCorruptFiles", True).json(glob))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Bronze as this package writes it: JSON lines, so files split across tasks."""
    return spark.read.schema(BRONZE).json(path)


def read_layer(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Vectors of the splits that exist; a missing one is reported and skipped."""
    df = spark.read.parquet(path)
    have = {r["split"] for r in df.select("split").distinct().collect()}  # a partition column: three values
    for split in splits:
        if split not in have:
            print(f"no vectors for split {split}, skipped")
    return df.where(F.col("split").isin(*splits))


def read_triage_log(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(TRIAGE_LOG).parquet(path)
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where(F.col("value") != "")


def flatten_issues(df: DataFrame, repo: str) -> DataFrame:
    """Ten fields of an issue page; label structs become names."""
    text = ("title", "body", "state", "created_at", "closed_at", "comments_url")
    names = F.transform(F.filter("labels", lambda x: x.isNotNull()), lambda x: x["name"])
    return df.select(*text, F.coalesce(names, F.array().cast("array<string>")).alias("labels"),
                     F.lit(repo).alias("repo"), F.col("number").alias("issue_number"),
                     F.col("pull_request").isNotNull().alias("is_pull_request"))


def issues_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("pull_request").isNull())


def columns_to_rows(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A record of parallel arrays as rows."""
    return df.select(*keep, F.inline(F.arrays_zip(*columns)))
