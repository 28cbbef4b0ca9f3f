"""Positions in a global order without a single-task sort.

A window without partitions moves all rows to one task. Here rows are range-partitioned on narrow keys,
numbered inside their block, and blocks are offset by the sizes of the blocks before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def sorted_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range-partitioned blocks with ``_block`` and ``_pos``, written out.

    Block and position are stored as data: a repeated task, or a later read with other splits, cannot
    change them.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    blocks = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .select("*", F.spark_partition_id().alias("_block"), local.alias("_pos")))
    return stage(blocks, "blocks")


def _offsets(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier blocks, per block. One row per shuffle partition, so one window task is enough."""
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("_block").agg(*[c.alias(name) for name, c in sums.items()])
    return totals.select("_block", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])


def row_index(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Dense positions ``start``, ``start + 1``, ... in the order of ``order`` (which must be unique)."""
    blocks = sorted_blocks(df, order)
    offsets = _offsets(blocks, {"_base": F.count(F.lit(1))})
    return (blocks.join(F.broadcast(offsets), "_block")
            .withColumn(out, F.col("_base") + F.col("_pos") + F.lit(start))
            .drop("_block", "_pos", "_base"))


def running_sums(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Add ``before_<value>``: the sum of ``value`` over all rows ahead in the order."""
    blocks = sorted_blocks(df, order)
    offsets = _offsets(blocks, {f"_base_{v}": F.sum(v) for v in values})
    inside = Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    return (local.join(F.broadcast(offsets), "_block")
            .select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_base_{v}")).alias(f"before_{v}") for v in values]))


def rows_at(df: DataFrame, lead: Column, ties: list[str], fractions: list[float],
            position: Callable[[int, float], int]) -> tuple[int, list]:
    """Row count, and the keys found at ``position(n, fraction)`` of the sorted table (None past its end).

    The order is ``lead``, a number, then ``ties``; a key row holds ``_lead`` and the ties. Approximate
    quantiles bracket each position, two counts prove the bracket, and only the rows inside are sorted. A
    bracket that fails the proof is widened to the whole table, so results are exact.
    """
    keys = df.select(lead.alias("_lead"), *ties)
    slack = 0.001
    wanted = [q for f in fractions for q in (max(0.0, f - slack), min(1.0, f + slack))]
    head = keys.agg(F.count(F.lit(1)).alias("n"),
                    F.percentile_approx("_lead", wanted, 10_000).alias("q")).first()
    n, quantiles = head["n"], head["q"]
    places = [position(n, f) for f in fractions]
    if n == 0:
        return 0, [None] * len(fractions)
    candidates, skipped = keys, [0] * len(places)
    if quantiles:
        brackets = [(quantiles[2 * i], quantiles[2 * i + 1]) for i in range(len(fractions))]
        inside = F.lit(False)
        for lo, hi in brackets:
            inside = inside | F.col("_lead").between(lo, hi)
        counts = keys.agg(*[c for i, (lo, hi) in enumerate(brackets) for c in (
            F.count_if(F.col("_lead") < lo).alias(f"below_{i}"),
            F.count_if(F.col("_lead") <= hi).alias(f"upto_{i}"),
            F.count_if(~inside & (F.col("_lead") < lo)).alias(f"skipped_{i}"))]).first()
        if all(place >= n or counts[f"below_{i}"] <= place < counts[f"upto_{i}"] for i, place in enumerate(places)):
            # rows ahead of a bracket and in none are left out, so positions shift by their number
            candidates = keys.where(inside)
            skipped = [counts[f"skipped_{i}"] for i in range(len(places))]
    blocks = sorted_blocks(candidates, ["_lead", *ties])
    offsets = sorted(tuple(r) for r in _offsets(blocks, {"_base": F.count(F.lit(1))}).collect())  # a row per block
    picks = []
    for place, skip in zip(places, skipped):
        if place >= n:
            picks.append(None)
            continue
        block, base = max((o for o in offsets if o[1] <= place - skip), key=lambda o: o[1])
        picks.append((block, place - skip - base))
    wanted_rows = F.lit(False)
    for block, pos in filter(None, picks):
        wanted_rows = wanted_rows | ((F.col("_block") == block) & (F.col("_pos") == pos))
    found = {(r["_block"], r["_pos"]): r for r in blocks.where(wanted_rows).collect()}  # a row per fraction
    return n, [found.get(p) if p else None for p in picks]
