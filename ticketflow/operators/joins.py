"""Joins: labels, routing rules, distributions, word overlap, point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_TEAM, ROUTING_RULES
from ..functions.text import SPACE
from ..session import stage
from .ranking import sorted_blocks


def with_labels(features: DataFrame, tickets: DataFrame, columns: tuple[str, ...] = ("category",),
                key: str = "ticket_id") -> DataFrame:
    """Left join on the unique ticket id. Only the asked columns of ``tickets`` are read."""
    return features.join(tickets.select(key, *columns), key, "left")


def rules_df(spark) -> DataFrame:
    return spark.createDataFrame(list(ROUTING_RULES),
                                 "category string, priority string, rule_team string, rule_escalate boolean")


def route_by_rule(df: DataFrame) -> DataFrame:
    """Add ``routing_team`` and ``rule_escalate``. The rule table has twelve rows, so it is broadcast."""
    rules = F.broadcast(rules_df(df.sparkSession))
    return (df.join(rules, ["category", "priority"], "left")
            .withColumn("routing_team", F.coalesce("rule_team", F.lit(DEFAULT_TEAM)))
            .withColumn("rule_escalate", F.coalesce("rule_escalate", F.lit(False)))
            .drop("rule_team"))


def words(text) -> F.Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"),
                                     lambda w: w != ""))


def rare_first(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """``(__key, __size, __word, __pos)``: the words of each key, those that the fewest queries have first."""
    each = keys.select("__key", F.size("__words").alias("__size"), F.explode("__words").alias("__word"))
    held = asked.groupBy("__word").agg(F.count(F.lit(1)).alias("__df"))
    place = Window.partitionBy("__key").orderBy(F.coalesce("__df", F.lit(0)), "__word")  # the words of one key
    return each.join(held, "__word", "left").select("__key", "__size", "__word", (F.row_number().over(place) - 1).alias("__pos"))


SLOTS, SLOT_BITS = 8, 62  # longs for the most frequent words, and words in each


def _masks(rows: DataFrame, by: str) -> DataFrame:
    """For each ``by`` its frequent words as bits."""
    return rows.where("__slot is not null").groupBy(by).agg(*[
        F.expr(f"bit_or(CASE WHEN __slot = {n} THEN shiftleft(1L, __bit) ELSE 0L END)").alias(f"__m{n}") for n in range(SLOTS)])


def overlap_parts(queries: DataFrame, query_id: str, query_text, keys: DataFrame, key_id: str, key_text: str) -> dict[str, DataFrame]:
    """The steps of ``best_overlap``, in order; see there."""
    spark = queries.sparkSession
    sized = keys.select(F.col(key_id).alias("__key"), words(F.col(key_text)).alias("__words"))
    vocabulary = sized.select(F.explode("__words").alias("__word")).distinct()
    asked = stage(queries.select(F.col(query_id).alias("__query"), F.explode(words(query_text)).alias("__word"))
                  .join(vocabulary, "__word", "left_semi").distinct(), "asked")
    top = (asked.groupBy("__word").agg(F.count(F.lit(1)).alias("__df")).orderBy(F.desc("__df"), "__word").limit(SLOTS * SLOT_BITS).collect())
    frequent = F.broadcast(spark.createDataFrame([(r["__word"], i // SLOT_BITS, i % SLOT_BITS) for i, r in enumerate(top)],
                                                 "__word string, __slot int, __bit int"))  # SLOTS * SLOT_BITS rows
    postings = stage(rare_first(sized, asked).join(frequent, "__word", "left"), "postings")
    by_query, by_key = stage(_masks(asked.join(frequent, "__word"), "__query"), "masks"), stage(_masks(postings, "__key"), "masks")

    def scored(pairs: DataFrame) -> DataFrame:
        """``__met`` rare words that a pair shares, and the frequent ones its bits share, over the key's size."""
        both = pairs.join(by_query, "__query", "left").join(by_key.toDF("__key", *[f"__k{n}" for n in range(SLOTS)]), "__key", "left")
        bits = [F.coalesce(F.bit_count(F.col(f"__m{n}").bitwiseAND(F.col(f"__k{n}"))), F.lit(0)) for n in range(SLOTS)]
        return both.select("__query", "__key", ((F.col("__met") + sum(bits[1:], bits[0])) / F.col("__size")).alias("__score"))
    rare = asked.join(postings.where("__slot is null"), "__word")
    first = stage(scored(rare.groupBy("__query", "__key").agg(F.count(F.lit(1)).alias("__met"), F.max("__size").alias("__size"))), "rare-pairs")
    # a key that lacks the query's word at every place up to size * (1 - floor) has a smaller share than floor
    floor = first.groupBy("__query").agg(F.max("__score").alias("__floor"))
    often = asked.join(floor, "__query", "left").select("__query", F.col("__word").alias("__asked"), F.coalesce("__floor", F.lit(0.0)).alias("__floor"))
    bound = F.col("__size") * (F.lit(1.0) - F.col("__floor")) + F.lit(1e-9)
    prefix = often.join(postings.where("__slot is not null"), (F.col("__asked") == F.col("__word")) & (F.col("__pos") <= bound))
    rest = scored(prefix.groupBy("__query", "__key").agg(F.max("__size").alias("__size")).withColumn("__met", F.lit(0).cast("long")))
    return {"asked": asked, "postings": postings, "rare": rare, "first": first, "prefix": prefix, "rest": rest}


def best_overlap(queries: DataFrame, query_id: str, query_text, keys: DataFrame, key_id: str,
                 key_text: str) -> DataFrame:
    """Per query, the key with the largest share of its words in the query; ties go to the lower key, and a query without any
    overlap has the lowest key.

    Only words outside the ``SLOTS * SLOT_BITS`` most frequent ones are joined; the frequent ones are bits, which a pair that met counts at
    once. The best share so far is then a floor: a key that shares no rarer word can only reach it by a frequent word among as
    many of its first words, in order of rarity, as the floor leaves out. Few keys have one there, and these pairs are counted
    by their bits. Queries that share an id are one.
    """
    parts = overlap_parts(queries, query_id, query_text, keys, key_id, key_text)
    best = parts["first"].unionByName(parts["rest"]).groupBy("__query").agg(
        F.max_by(F.struct("__key", "__score"), F.struct(F.col("__score"), -F.col("__key"))).alias("b"))
    lowest = keys.agg(F.min(key_id)).first()[0]
    everyone = queries.select(F.col(query_id).alias("__query")).distinct()
    return everyone.join(best, "__query", "left").select(
        F.col("__query").alias(query_id), F.coalesce("b.__key", F.lit(lowest)).alias(key_id), F.coalesce("b.__score", F.lit(0.0)).alias("score"))


def as_of_join(left: DataFrame, facts: DataFrame, key: str, ts: str, values: list[str], ttl: str, tie: str | None = None) -> DataFrame:
    """Per left row, the newest fact of its key at or before its time and younger than ``ttl``: ``left`` with ``fact_<value>`` and ``fact_ts``.

    Key, time and row number of both sides are sorted together in range-partitioned blocks of about equal size, so a hot key, or
    a hot hour of one, is cut by time into as many blocks as it needs. A block carries the last fact of its last key on to the
    blocks behind it, by a table with one row per block. Whole rows are joined to the outcome once, by their numbers. Of facts with
    one time the one with the largest ``tie`` counts. Rows with a null key or time find nothing.
    """
    wide = stage(left.withColumn("__id", F.monotonically_increasing_id()), "as-of-rows")
    known = stage(facts.select(F.col(key).alias("__key"), F.col(ts).alias("fact_ts"), (F.col(tie) if tie else F.lit(0)).alias("__tie"),
                                     *[F.col(v).alias(f"fact_{v}") for v in values], F.monotonically_increasing_id().alias("__fact")), "as-of-facts")
    asked = wide.select(F.col(key).alias("__key"), F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(dict(known.dtypes)["__tie"]).alias("__tie"),
                        F.col("__id").alias("__row"))
    both = (known.select("__key", F.col("fact_ts").alias("__ts"), F.lit(0).alias("__side"), "__tie", F.col("__fact").alias("__row"))
            .unionByName(asked).where("__key is not null and __ts is not null"))
    blocks = sorted_blocks(both, ["__key", "__ts", "__side", "__tie", "__row"])
    fact = F.when(F.col("__side") == 0, F.struct("__ts", F.col("__row").alias("__fact")))
    here = Window.partitionBy("_block", "__key").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = blocks.withColumn("__here", F.last(fact, ignorenulls=True).over(here)).where("__side = 1")
    # the last key of a block is the only one that goes on behind it; a block has one row here
    last = blocks.groupBy("_block").agg(F.max_by("__key", "_pos").alias("__key"))
    ends = (blocks.where("__side = 0").join(F.broadcast(last), ["_block", "__key"]).groupBy("_block", "__key")
            .agg(F.max_by(F.struct("__ts", F.col("__row").alias("__fact")), "_pos").alias("__end")))
    starts = blocks.groupBy("_block").agg(F.min_by("__key", "_pos").alias("__key")).withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    line = Window.partitionBy("__key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.unionByName(starts).groupBy("_block", "__key").agg(F.max("__end").alias("__end"))
               .select("_block", "__key", F.last("__end", ignorenulls=True).over(line).alias("__carried")).where("__carried is not null"))
    found = seen.join(F.broadcast(carried), ["_block", "__key"], "left").select("__row", F.coalesce("__here", "__carried").alias("__f"), "__ts")
    young = found.where(F.col("__ts") - F.expr(f"INTERVAL {ttl}") < F.col("__f.__ts")).select(F.col("__row").alias("__id"), "__f.__fact")
    return (wide.join(young.join(known.select("__fact", "fact_ts", *[f"fact_{v}" for v in values]), "__fact"), "__id", "left")
            .select(*left.columns, *[f"fact_{v}" for v in values], "fact_ts"))
