"""Writers. All are distributed; nothing is written row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import upsert
from ..operators.ranking import row_index
from ..schemas import METRICS, TRIAGE_LOG
from .marks import claim, last_mark


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_layer(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, one folder per value of ``by`` in a single pass."""
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_silver(df: DataFrame, path: str, by: str | None = None) -> None:
    write_layer(df, path, by)


def write_splits(df: DataFrame, path: str) -> None:
    write_layer(df, path, "split")


def write_features(df: DataFrame, path: str) -> None:
    write_layer(df, path, "split")


def write_vectors(df: DataFrame, path: str) -> None:
    write_layer(df, path, "split")


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows with ids that continue the stored ones, in the order ``(ts, ticket_id)``.

    The last id comes from the log's high mark (``marks``). A log that was written without marks is read once, by its first append.
    """
    spark = rows.sparkSession
    mark = last_mark(spark, path)
    if mark is None and path_exists(spark, path):
        stored = spark.read.schema(TRIAGE_LOG).parquet(path).agg(F.max("id")).first()[0]
        mark = {"number": 0, "next": (stored or 0) + 1}
    number, first = (mark["number"] + 1, mark["next"]) if mark else (1, 1)
    numbered = row_index(rows, ["ts", "ticket_id"], "id", start=first)
    claim(spark, path, number, first, numbered.count())
    as_log(numbered).write.mode("append").parquet(path)


def as_log(numbered: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in TRIAGE_LOG}
    return numbered.select(*[F.col(c).cast(kinds[c]).alias(c) for c in TRIAGE_LOG.fieldNames()])


def build_if_missing(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> bool:
    """Write ``make()`` unless the table exists. Returns whether it was built."""
    if path_exists(spark, path) and not force:
        return False
    write_layer(make(), path)
    return True


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions of a table: one small folder listing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in fs.globStatus(target))


def read_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest finished version of the vector index."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/v{versions[-1]:06d}") if versions else None


def upsert_index(updates: DataFrame, root: str, key: str, order: str) -> str:
    """Write the index with ``updates`` applied as a new version, so that readers of the old one are safe."""
    spark = updates.sparkSession
    current, versions = read_index(spark, root), _versions(spark, root)
    path = f"{root}/v{(versions[-1] if versions else 0) + 1:06d}"
    base = current if current is not None else updates.limit(0)
    upsert(base, updates, key, order).write.parquet(path)
    return path


def metrics_df(spark: SparkSession, run_id: str, params: dict, metrics: dict) -> DataFrame:
    rows = [(run_id, "param", k, str(v)) for k, v in params.items()]
    rows += [(run_id, "metric", k, str(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, METRICS)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def partition_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
