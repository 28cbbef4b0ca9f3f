"""Model replies: find the JSON, check the fields, choose between two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CASCADE_CONFIDENCE, CATEGORIES, DEFAULT_CATEGORY, DEFAULT_PRIORITY, DEFAULT_TEAM, FAILED_REASONING, PARSE_ERROR,
    PRIORITIES, TEAMS,
)
from .text import strip

# Fixed value: the shortest braced run, so an object with a nested object does not parse.
# The class takes a tenth of the time of a lazy [\s\S]*?, which finds the same.
JSON_OBJECT = r"\{[^}]*\}"
# A text member that is not a string. The object is flat, so a quoted name before a colon is a member name.
NOT_TEXT = r'"(?:category|priority|routing_team)"\s*:\s*[^\s"]'
FIELD_ERROR = "invalid field type"
REPLY_FIELDS = ("category", "priority", "routing_team", "confidence", "reasoning", "error")


def extract_json(raw: Column) -> Column:
    """The first braced run of a reply, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), JSON_OBJECT, 0), F.lit(""))


def _members(text: Column) -> Column:
    """Members of a JSON object as strings; null where the text is not one."""
    return F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"})


def _word(members: Column, name: str, default: str) -> Column:
    given = strip(F.lower(F.try_element_at(members, F.lit(name))))
    return F.when(F.map_contains_key(members, name), given).otherwise(default)


def validate_reply(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add ``out``: a struct of the cleaned reply. A reply that cannot be used becomes the failure row."""
    found, m = F.col("__o"), F.col("__m")
    parsed = df.withColumn("__o", extract_json(F.col(raw))).withColumn("__m", _members(F.col("__o")))
    value = F.try_element_at(m, F.lit("confidence"))
    truth = (F.when(found.rlike(r'"confidence"\s*:\s*true'), F.lit(1.0))
             .when(found.rlike(r'"confidence"\s*:\s*false'), F.lit(0.0)))
    number = F.when(F.map_contains_key(m, "confidence"), F.coalesce(value.try_cast("double"), truth)).otherwise(0.5)
    fields = parsed.withColumn("__f", F.struct(
        _word(m, "category", DEFAULT_CATEGORY).alias("category"),
        _word(m, "priority", DEFAULT_PRIORITY).alias("priority"),
        _word(m, "routing_team", DEFAULT_TEAM).alias("team"), number.alias("number"),
        F.try_element_at(m, F.lit("reasoning")).alias("reasoning"),
        m.isNull().alias("broken"), found.rlike(NOT_TEXT).alias("bad"),
    ))
    f = F.col("__f")
    known = f["category"].isin(*CATEGORIES)
    # an unknown category overwrites the confidence before that is read as a number
    error = (F.when(f["broken"], F.lit(PARSE_ERROR))
             .when(f["bad"] | (known & f["number"].isNull()), F.lit(FIELD_ERROR)))
    checked = fields.withColumn("__e", error)
    failed = F.col("__e").isNotNull()
    reply = F.struct(
        F.when(failed | ~known, F.lit(DEFAULT_CATEGORY)).otherwise(f["category"]).alias("category"),
        F.when(~failed & f["priority"].isin(*PRIORITIES), f["priority"]).otherwise(DEFAULT_PRIORITY)
         .alias("priority"),
        F.when(~failed & f["team"].isin(*TEAMS), f["team"]).otherwise(DEFAULT_TEAM).alias("routing_team"),
        F.when(failed | ~known, F.lit(0.0))
         .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f["number"]))).alias("confidence"),
        F.when(failed, F.lit(FAILED_REASONING)).otherwise(f["reasoning"]).alias("reasoning"),
        F.col("__e").alias("error"),
    )
    return checked.withColumn(out, reply).drop("__o", "__m", "__f", "__e")


def uncertain(reply: Column, threshold: float = CASCADE_CONFIDENCE) -> Column:
    return reply["error"].isNotNull() | (reply["confidence"] < threshold)


def cascade(df: DataFrame, primary: str, fallback: str, out: str, primary_model: str = "primary",
            fallback_model: str = "fallback", threshold: float = CASCADE_CONFIDENCE) -> DataFrame:
    """Add ``out``: the primary reply, or the fallback where the primary is uncertain.

    The fallback counts if it has no error itself, or if the primary had one.
    """
    p, f = F.col(primary), F.col(fallback)
    use = uncertain(p, threshold) & (f["error"].isNull() | p["error"].isNotNull())
    chosen = F.struct(
        *[F.when(use, f[name]).otherwise(p[name]).alias(name) for name in REPLY_FIELDS],
        F.when(use, F.lit(fallback_model)).otherwise(F.lit(primary_model)).alias("model"),
        use.alias("escalated"),
    )
    return df.withColumn(out, chosen)


def parse_judgement(raw: Column) -> Column:
    """Score and reason of a grading reply. A whole-text JSON object is expected; any failure scores 0."""
    m = _members(raw)
    score = F.try_element_at(m, F.lit("score")).try_cast("double")
    failed = m.isNull() | ~raw.rlike(r"^\s*\{[\s\S]*\}\s*$") | (F.map_contains_key(m, "score") & score.isNull())
    return F.struct(
        F.when(failed, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0))).alias("score"),
        F.when(failed, F.lit("Eval failed")).otherwise(
            F.coalesce(F.try_element_at(m, F.lit("reason")), F.lit(""))).alias("reason"),
    )
