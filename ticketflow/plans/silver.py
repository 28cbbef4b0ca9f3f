"""Bronze to Silver, in the fixed order: filter, mask, label, date, priority, team, id, dedup, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES, DEFAULT_PRIORITY, DEFAULT_TIER, MIN_BODY, SILVER_COLUMNS
from ..functions.labels import normalise_labels, route_by_category
from ..functions.rules import default_priority
from ..functions.text import PII_FLAGS, join_flags, mask_columns, not_blank, parse_created
from ..operators.dedup import dedup, text_key


def drop_blank(df: DataFrame, column: str = "body") -> DataFrame:
    return df.where(not_blank(F.col(column)))


def min_length(df: DataFrame, column: str = "body", n: int = MIN_BODY) -> DataFrame:
    return df.where(F.length(column) >= n)


def ticket_hash(source: Column, raw_id: Column) -> Column:
    """Fixed format: the first 16 upper-case hex digits of SHA-1 over ``source::raw_id``."""
    text = F.concat(F.coalesce(source, F.lit("unknown")), F.lit("::"), raw_id.cast("string"))
    return F.upper(F.substring(F.sha1(text), 1, 16))


def fill_ticket_id(df: DataFrame, raw_id: str) -> DataFrame:
    made = ticket_hash(F.col("source"), F.col(raw_id))
    if "ticket_id" not in df.columns:
        return df.withColumn("ticket_id", made)
    given = F.coalesce(not_blank(F.col("ticket_id")), F.lit(False))
    return df.withColumn("ticket_id", F.when(given, F.col("ticket_id")).otherwise(made))


def ensure_columns(df: DataFrame) -> DataFrame:
    """Defaults for columns the table lacks. Nulls in a column that exists stay."""
    defaults = {"comments": F.array().cast("array<string>"), "reopen_count": F.lit(0),
                "customer_tier": F.lit(DEFAULT_TIER)}
    for c, value in defaults.items():
        if c not in df.columns:
            df = df.withColumn(c, value)
    return df


def order_columns(df: DataFrame, first: tuple[str, ...] = SILVER_COLUMNS) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def clean(df: DataFrame, raw_id: str, label_map: dict[str, str] | None = None,
          keep_given_category: bool = False) -> DataFrame:
    """Everything but dedup: filters and expressions, no shuffle, usable on streams."""
    out = mask_columns(min_length(drop_blank(df)), ["subject", "body"], "pii_flags")
    category = normalise_labels(F.col("labels_raw"), label_map)
    if keep_given_category and "category" in df.columns:
        category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(category)
    out = out.withColumns({
        "subject": F.coalesce("subject", F.lit("")),
        "category": category,
        "created_at": parse_created(F.col("created_at")),
        "priority": default_priority(F.col("priority")) if "priority" in df.columns else F.lit(DEFAULT_PRIORITY),
        "pii_flags": join_flags(F.col("pii_flags")),
    })
    out = out.withColumn("routing_team", route_by_category(F.col("category")))
    return fill_ticket_id(out, raw_id)


def to_silver(df: DataFrame, raw_id: str, label_map: dict[str, str] | None = None,
              keep_given_category: bool = False) -> DataFrame:
    """Silver tickets. ``raw_id`` is a stable unique column; the lowest one of equal tickets stays.

    Dedup runs after masking, so tickets that differ only in personal data collapse. The only shuffle is
    the one of dedup.
    """
    kept = dedup(clean(df, raw_id, label_map, keep_given_category), [raw_id])
    return order_columns(ensure_columns(kept).drop(raw_id) if raw_id not in SILVER_COLUMNS else ensure_columns(kept))


def silver_stats(df: DataFrame) -> DataFrame:
    """Rows dropped at each stage, in one pass."""
    blank = ~F.coalesce(not_blank(F.col("body")), F.lit(False))
    short = ~blank & (F.length("body") < MIN_BODY)
    masked = mask_columns(df.select("subject", "body", blank.alias("blank"), short.alias("short")),
                          ["subject", "body"], "flags")
    kept = ~F.col("blank") & ~F.col("short")
    keyed = masked.select("blank", "short", kept.alias("kept"),
                          F.when(kept, text_key(F.col("subject"), F.col("body"))).alias("key"))
    n, final = F.count(F.lit(1)), F.count_distinct("key")
    return keyed.agg(n.alias("bronze_rows"), F.count_if("blank").alias("dropped_blank"),
                     F.count_if("short").alias("dropped_short"),
                     (F.count_if("kept") - final).alias("dropped_duplicate"), final.alias("final_rows"),
                     (n - final).alias("dropped_total"))


def pii_stats(df: DataFrame) -> DataFrame:
    """Tickets per kind of personal data, and with any.

    One aggregate: a filter or explode on the flags would be pushed below the masking and repeat it.
    """
    masked = mask_columns(min_length(drop_blank(df)).select("subject", "body"), ["subject", "body"], "flags")
    counts = [F.count_if(F.array_contains("flags", f)).alias(f) for f in PII_FLAGS]
    one = masked.agg(*counts, F.count_if(F.size("flags") > 0).alias("any"))
    rows = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("tickets")) for f in (*PII_FLAGS, "any")])
    return one.select(F.inline(rows)).where(F.col("tickets") > 0)
