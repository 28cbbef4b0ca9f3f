"""Rows for rare categories, made from a table of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TIERS
from ..functions.labels import literal_map

CHUNK = 100_000  # rows that one task makes
LEFT_OVER = r"\{[a-z_0-9]+\}"


def draw(seed: int, name: str, size: Column) -> Column:
    """A whole number below ``size``, from a hash of seed, category, row number and the name of the choice."""
    digits = F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), "category", F.col("k").cast("string"), F.lit(name))), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), size)


def augment(templates: DataFrame, counts: DataFrame, as_of: str, fills: dict[str, tuple[str, ...]] | None = None,
            seed: int = 42) -> DataFrame:
    """``n`` tickets for each category of ``counts(category, n)``, from ``templates(template_id, category, body)``.

    ``fills`` has the values of each ``{placeholder}``; a placeholder without values is left empty. The template table and the
    counts are small by nature: a list of wordings, and a row per category. Every choice is a hash, so a rerun makes the same
    rows whatever the partitioning. A category without templates, or with a count below one, gets none.
    """
    listed = templates.where("category is not null and body is not null").groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("template_id", "body"))).alias("options"))
    chunks = counts.where("n > 0").select("category", "n", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk")).repartition("category", "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1
    made = chunks.select("category", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("k")).join(listed, "category")

    def choose(name: str, values: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), draw(seed, name, F.lit(len(values))).cast("int"))

    body = F.get("options", draw(seed, "template", F.size("options")).cast("int"))["body"]
    for name, values in (fills or {}).items():
        body = F.replace(body, F.lit("{" + name + "}"), choose(name, values))
    made = made.withColumn("body", F.regexp_replace(body, LEFT_OVER, ""))
    number = F.sha1(F.concat_ws(":", F.lit(str(seed)), "category", F.col("k").cast("string")))
    urgent = F.col("category").isin("security", "incident")
    team = F.coalesce(literal_map({"security": "security", "billing": "billing"})[F.col("category")], F.lit("support"))
    day = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=draw(seed, "age", F.lit(366)).cast("int"))
    title = F.concat(F.upper(F.substring("category", 1, 1)), F.substring("category", 2, 100))
    return made.select(
        F.concat(F.lit("SYN-"), number).alias("ticket_id"), F.lit("synthetic").alias("source"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.concat(title, F.lit(" Issue - "), F.substring("body", 1, 30), F.lit("...")).alias("subject"),
        "body", F.array().cast("array<string>").alias("comments"), F.array("category").alias("labels_raw"),
        "category", F.when(urgent, "high").otherwise("medium").alias("priority"), team.alias("routing_team"),
        choose("tier", TIERS).alias("customer_tier"))


def missing_rows(rows: DataFrame, least: int, category: str = "category") -> DataFrame:
    """``(category, n)``: how many rows each category of the table lacks to have ``least``."""
    return (rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("have"))
            .select("category", (F.lit(least) - F.col("have")).alias("n")).where("n > 0"))
