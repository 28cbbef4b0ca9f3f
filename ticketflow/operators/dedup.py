"""One row per key, whatever the size of a key's group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage


def text_key(subject: Column, body: Column) -> Column:
    """Fixed format of the duplicate key, hashed so that long texts are not shuffled twice."""
    return F.sha2(F.concat(F.coalesce(subject, F.lit("")), F.lit("|||"), F.coalesce(body, F.lit(""))), 256)


def first_by(df: DataFrame, keys: list[Column], order: list[str], newest: bool = False) -> DataFrame:
    """The first (or newest) row of every key.

    An aggregate, not a window: each task reduces its rows to one per key before the shuffle, so a key
    that holds a third of the table sends one row per task instead of the whole group to one task.
    """
    pick = F.max_by if newest else F.min_by
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    row = pick(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*named).agg(row.alias("__row")).select("__row.*")


def dedup(df: DataFrame, order: list[str], subject: str = "subject", body: str = "body") -> DataFrame:
    """Drop rows whose subject and body repeat those of an earlier row."""
    return first_by(df, [text_key(F.col(subject), F.col(body))], order)


def latest(df: DataFrame, key: str, ts: str, as_of: str, ttl: str, tie: str | None = None) -> DataFrame:
    """Newest row per key inside ``(as_of - ttl, as_of]``."""
    at = F.lit(as_of).cast(dict(df.dtypes)[ts])
    window = (F.col(ts) <= at) & (F.col(ts) > at - F.expr(f"INTERVAL {ttl}"))
    return first_by(df.where(window), [F.col(key)], [ts] + ([tie] if tie else []), newest=True)


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """``base``, unique by ``key``, with the rows of ``updates`` added or replaced, newest ``order`` first.

    At equal ``order`` the update wins. The reduced updates are written out, so their size is known: while
    it is small, Spark broadcasts them and ``base`` is not shuffled.
    """
    newest = stage(first_by(updates, [F.col(key)], [order], newest=True), "updates")
    mine, theirs = F.struct(*base.columns), F.struct(*base.columns)
    paired = base.select(F.col(key).alias("__key"), mine.alias("__old")).join(
        newest.select(F.col(key).alias("__key"), theirs.alias("__new")), "__key", "left")
    wins = F.col("__new").isNotNull() & ~(F.col(f"__old.{order}") > F.col(f"__new.{order}"))
    kept = paired.select(F.when(wins, F.col("__new")).otherwise(F.col("__old")).alias("__row")).select("__row.*")
    present = base.select(key).join(newest.select(key), key, "left_semi")
    added = newest.join(present, key, "left_anti").select(*base.columns)
    return kept.unionByName(added)
