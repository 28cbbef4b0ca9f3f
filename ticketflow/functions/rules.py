"""Small decision expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_PRIORITY, DRIFT_BANDS, DRIFT_WORST, PRIORITIES, SLA_BREACH, SLA_CATEGORIES, SLA_LEVELS, SLA_LOWEST,
)


def default_priority(c: Column) -> Column:
    """Valid values keep their case; anything else, null included, becomes the default."""
    return F.when(F.lower(c).isin(*PRIORITIES), c).otherwise(DEFAULT_PRIORITY)


def sla_label(category: Column, positive: tuple[str, ...] = SLA_CATEGORIES) -> Column:
    return F.coalesce(category.isin(*positive), F.lit(False)).cast("int")


def risk_level(p: Column) -> Column:
    chain = None
    for bound, level in SLA_LEVELS:
        chain = F.when(p >= bound, level) if chain is None else chain.when(p >= bound, level)
    return chain.otherwise(SLA_LOWEST)


def risk_bucket(p: Column) -> list[Column]:
    """Score, flag and level; flag and level look at the unrounded probability."""
    return [F.round(p, 4).alias("sla_risk_score"), (p >= SLA_BREACH).alias("breach_flag"),
            risk_level(p).alias("risk_level")]


def drift_band(psi: Column) -> Column:
    chain = None
    for bound, band in DRIFT_BANDS:
        chain = F.when(psi < bound, band) if chain is None else chain.when(psi < bound, band)
    return chain.otherwise(DRIFT_WORST)


def percent(c: Column) -> Column:
    """Half-even percent without decimals."""
    return F.concat(F.bround(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))
