"""Streams of tickets and triage results, written to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import text_key
from ..operators.drift import drift_of_counts
from ..operators.log import to_log_rows
from ..operators.ranking import row_index
from ..plans.silver import clean, ensure_columns, order_columns
from ..schemas import TRIAGE_LOG
from ..session import work_path
from ..sources.marks import claim, last_mark, mark_of
from ..sources.sinks import as_log, path_exists
from .metrics import daily_counts, with_watermark

BATCH = "log_batch"


def start(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream to Parquet, exactly once per row. ``once`` stops after the rows at hand."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")
    return writer.start(path)


def run_once(df: DataFrame, name: str) -> DataFrame:
    """Process the rows at hand and return the written table."""
    spark = df.sparkSession
    path = work_path(spark, name)
    start(df, path, work_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def windows_once(df: DataFrame, name: str, keys: list[str]) -> tuple[DataFrame, int]:
    """Process the rows at hand and return every window as it last was, open ones included, and the number of late rows.

    Each batch writes the windows it changed to a folder of its own, which a repeated batch replaces; of a window's rows that of
    the last batch counts.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    stream = (df.writeStream.outputMode("update").option("checkpointLocation", work_path(spark, f"{name}-checkpoint"))
              .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}"))
              .trigger(availableNow=True).start())
    stream.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in stream.recentProgress for s in p["stateOperators"])
    if not path_exists(spark, path):
        return spark.createDataFrame([], df.schema), late
    values = [c for c in df.columns if c not in keys]
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in values]), late


def log_stream(results: DataFrame) -> DataFrame:
    """Triage results as log rows, without ids."""
    return to_log_rows(results)


def number_log(rows: DataFrame, path: str, batch: int, owner: str = "") -> None:
    """Write one batch of log rows below ``path``, with ids that go on from the batch before, in the order of time and ticket.

    A batch owns its folder and its mark, so a repeated one replaces itself and keeps its ids, whatever came after it. The log so
    far is not read if it has marks. ``owner`` names the stream; another one cannot write to the same path.
    """
    spark = rows.sparkSession
    mark, before = mark_of(spark, path, batch), last_mark(spark, path, below=batch)
    for other in filter(None, (mark, before)):
        if other["owner"] != owner:
            raise RuntimeError(f"{path} belongs to the stream {other['owner']!r}")
    first = mark["first"] if mark else before["next"] if before else last_stored(spark, path, batch) + 1
    numbered = row_index(rows, ["ts", "ticket_id"], "id", start=first)
    if mark is None:
        claim(spark, path, batch, first, numbered.count(), owner)
    as_log(numbered).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def last_stored(spark: SparkSession, path: str, batch: int) -> int:
    """The last id before ``batch`` of a log without marks, which is read for it; 0 without a log."""
    if not path_exists(spark, path):
        return 0
    others = spark.read.schema(f"id long, {BATCH} long").parquet(path).where(F.col(BATCH) < batch)
    return others.agg(F.max("id")).first()[0] or 0


def log_once(results: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Log the results at hand, numbered, and return the whole log."""
    (log_stream(results).writeStream.option("checkpointLocation", checkpoint)
     .foreachBatch(lambda rows, n: number_log(rows, path, n, checkpoint)).trigger(availableNow=True).start().awaitTermination())
    return results.sparkSession.read.schema(TRIAGE_LOG).parquet(path).select(*TRIAGE_LOG.fieldNames())


def silver_stream(tickets: DataFrame, raw_id: str, late: str = "1 day", salts: int = 16,
                  tasks: int | None = None) -> DataFrame:
    """Silver cleaning with duplicates dropped within ``late`` of arrival.

    The watermark runs on arrival, not on the ticket's own date, so no row is late and old tickets are
    kept; state holds the keys of one period only. Copies of one ticket are first reduced within ``salts``
    shares, so a ticket that makes up a third of a batch does not meet in one task.
    ``tasks`` spreads the cleaning where a batch arrives in fewer files than there are cores.
    """
    cleaned = clean(tickets.repartition(tasks) if tasks else tickets, raw_id).withColumn("arrived_at", F.current_timestamp())
    keyed = cleaned.withColumns({"__key": text_key(F.col("subject"), F.col("body")),
                                 "__salt": F.pmod(F.xxhash64(raw_id), F.lit(salts))})
    shares = keyed.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["__key", "__salt"])
    unique = shares.dropDuplicatesWithinWatermark(["__key"])
    return order_columns(ensure_columns(unique).drop("__key", "__salt", raw_id))


def drift_stream(log: DataFrame, column: str = "category") -> DataFrame:
    """Counts per day and category of a log stream."""
    return daily_counts(with_watermark(log), column)


def drift_of_days(train: DataFrame, counts: DataFrame, column: str = "category", weight: str | None = None) -> DataFrame:
    """Drift of each day against the training table."""
    days = counts.select(F.to_date("window_start").cast("string").alias("day"), column, "n")
    return drift_of_counts(train, days, "day", column, weight)
