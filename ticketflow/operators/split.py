"""Chronological split and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rows_at


def numeric(df: DataFrame, c: str):
    """A column as a number that sorts alike: microseconds for timestamps."""
    kind = dict(df.dtypes)[c]
    return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c)


def time_split(df: DataFrame, ts: str, tie: str, train: float = 0.70, val: float = 0.15,
               out: str = "split") -> DataFrame:
    """Oldest rows to train, then val, then test, cut at exact positions of the order ``(ts, tie)``.

    Only the two boundary rows are looked up; the split itself is a comparison per row, so wide rows are
    neither sorted nor shuffled.
    """
    fractions = [train, train + val]
    at = numeric(df, ts)
    _, bounds = rows_at(df, at, [tie], fractions, lambda n, f: int(n * f))

    def ahead(bound):
        if bound is None:
            return F.lit(True)
        return (at < bound["_lead"]) | ((at == bound["_lead"]) & (F.col(tie) < F.lit(bound[tie])))

    return df.withColumn(out, F.when(ahead(bounds[0]), "train").when(ahead(bounds[1]), "val").otherwise("test"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run and partitioning."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(draw, key).limit(n)


def split_ranges(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                                 F.count(F.lit(1)).alias("n"))


def layer_summary(df: DataFrame, vectors: bool, split: str = "split") -> DataFrame:
    """Rows per split, their total, and whether vectors were made."""
    return (df.rollup(split).count()
            .select(F.coalesce(split, F.lit("total")).alias("split"), F.col("count").alias("n"),
                    F.lit("generated" if vectors else "skipped").alias("embeddings")))
