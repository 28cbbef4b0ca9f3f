"""The 17 ticket features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_CREATED, FEATURES, SOURCE_CODES, TIER_CODES
from .text import SPACE, full_text, plain

TOKEN = rf"[\x21-\x7e[^{SPACE}]]"
FENCED = r"```[\s\S]*?```"
URL = r"(?i)https?://\S+"
# neither space nor lower nor title case; upper case
NOT_LOWER = rf"[\x21-\x60\x7b-\x7e[^\x00-\x7f{SPACE}\p{{IsLowercase}}\p{{Lt}}]]"
UPPER = r"[A-Z[\p{IsUppercase}]]"


def word_count(c: Column) -> Column:
    return F.when(plain(c), F.regexp_count(c, F.lit(r"\S+"))).otherwise(F.regexp_count(c, F.lit(f"{TOKEN}+")))


def caps_count(c: Column, min_length: int) -> Column:
    """Words in capitals: no lower- or title-case letter, an upper-case one, at least ``min_length`` long."""
    words = F.when(plain(c), F.split(c, r"\s+")).otherwise(F.split(c, f"[{SPACE}]+"))
    return F.size(F.filter(words, lambda w: w.rlike(rf"\A{NOT_LOWER}{{{min_length},}}\z") & w.rlike(UPPER)))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def encode(c: Column, codes: dict[str, int]) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(mapping[c], F.lit(0))


def text_features(subject: Column, body: Column, profile: str = "batch") -> dict[str, Column]:
    """Text statistics. ``agent`` and ``api`` are the two live definitions, kept for parity checks."""
    s, b = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    whole = full_text(subject, body)
    base = whole if profile == "agent" else b
    batch = profile == "batch"
    urls = {"batch": (whole, URL), "agent": (whole, "https?://"), "api": (b, "http")}[profile]
    return {
        "text_length": F.length(base),
        "word_count": word_count(base),
        "subject_length": F.length(s),
        "code_block_count": _count(base, FENCED if batch else "```"),
        "url_count": _count(*urls),
        "question_mark_count": _count(base, r"\?"),
        "exclamation_count": _count(base, "!"),
        "caps_word_count": caps_count(base, 3 if batch else 2),
    }


def time_features(created: Column, as_of: Column | str, profile: str = "batch") -> dict[str, Column]:
    """Clock features. ``as_of`` is always given, so a rerun yields the same rows.

    The live profiles read the clock instead of the ticket: there ``created`` is the request time.
    """
    at = F.coalesce(created, F.lit(DEFAULT_CREATED).cast("timestamp"))
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    hour, day = F.hour(at), F.weekday(at)
    late = hour >= 18 if profile == "batch" else hour > 18
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(3.6e9))
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "is_after_hours": ((hour < 9) | late).cast("int"),
        "ticket_age_hours": F.round(age, 2) if profile == "batch" else F.lit(0.0),
    }


def context_features(df: DataFrame, profile: str = "batch") -> dict[str, Column]:
    """Counts and codes. A column the table lacks counts as its default."""
    if profile != "batch":
        return {"reopen_count": F.lit(0), "comment_count": F.lit(0),
                "customer_tier_encoded": F.lit(1), "source_encoded": F.lit(0)}
    have = set(df.columns)
    return {
        "reopen_count": (F.coalesce(F.col("reopen_count"), F.lit(0)) if "reopen_count" in have
                         else F.lit(0)).cast("int"),
        "comment_count": (F.when(F.col("comments").isNotNull(), F.size("comments")).otherwise(0)
                          if "comments" in have else F.lit(0)),
        "customer_tier_encoded": (encode(F.col("customer_tier"), TIER_CODES) if "customer_tier" in have
                                  else F.lit(0)),
        "source_encoded": encode(F.col("source"), SOURCE_CODES),
    }


def features(df: DataFrame, as_of: str, profile: str = "batch", keep: tuple[str, ...] = ("ticket_id",)) -> DataFrame:
    """One row of features per ticket: a single projection over the scan."""
    columns = {
        **text_features(F.col("subject"), F.col("body"), profile),
        **time_features(F.col("created_at"), as_of, profile),
        **context_features(df, profile),
    }
    return df.select(*keep, *[columns[name].alias(name) for name in FEATURES])


def fill_features(df: DataFrame) -> DataFrame:
    return df.na.fill(0, [c for c in FEATURES if c in df.columns])
