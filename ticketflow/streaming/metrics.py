"""Request metrics over time windows. The same functions serve streams and tables.

A stream carries a watermark, so a window is written once, when no more rows are expected for it, and its
state is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "15 minutes"
SLIDE = "5 minutes"
MINUTE = "1 minute"
LATE = "10 minutes"


def with_watermark(df: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _windowed(df: DataFrame, size: str, slide: str | None, by: tuple[str, ...], **values: Column) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (df.groupBy(window, *by).agg(*[c.alias(name) for name, c in values.items()])
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
                    *values))


def request_count(df: DataFrame, size: str = WINDOW, slide: str | None = SLIDE) -> DataFrame:
    return _windowed(df, size, slide, (), requests=F.count(F.lit(1)))


def error_count(df: DataFrame, size: str = WINDOW, slide: str | None = SLIDE) -> DataFrame:
    status = F.col("status").cast("string")
    return _windowed(df, size, slide, (), client_errors=F.count_if(status.startswith("4")),
                     server_errors=F.count_if(status.startswith("5")))


def avg_latency(df: DataFrame, size: str = WINDOW, slide: str | None = SLIDE, seconds: str = "duration") -> DataFrame:
    """Milliseconds per request."""
    return _windowed(df, size, slide, (), avg_ms=F.sum(seconds) / F.count(F.lit(1)) * 1000)


def rate(df: DataFrame, by: str, size: str = MINUTE, seconds: float = 60) -> DataFrame:
    """Requests per second by handler or status."""
    return _windowed(df, size, None, (by,), per_second=F.count(F.lit(1)) / seconds)


def latency_by(df: DataFrame, by: str, size: str = MINUTE, seconds: str = "duration") -> DataFrame:
    """Seconds per request by handler."""
    return _windowed(df, size, None, (by,), avg_seconds=F.sum(seconds) / F.count(F.lit(1)))


def daily_counts(df: DataFrame, column: str = "category") -> DataFrame:
    """Counts per day and value: the input of the recurring drift check."""
    return _windowed(df, "1 day", None, (column,), n=F.count(F.lit(1)))
