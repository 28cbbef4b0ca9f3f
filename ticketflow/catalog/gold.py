"""Queries over features, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import encode, features, fill_features, text_features, time_features
from ..functions.text import embed_text, parse_created
from ..constants import FEATURES, SOURCE_CODES, TIER_CODES
from ..operators.dedup import latest
from ..operators.joins import as_of_join, with_labels
from ..operators.split import layer_summary, sample_n, split_ranges, time_split
from . import sqltext as q
from .fixtures import AS_OF, fixture, table, with_views
from .registry import query

WS = q.NOT_BLANK
CREATED = "coalesce(try_cast(created_raw AS TIMESTAMP), TIMESTAMP '2020-01-01 00:00:00')"
CAPS = (r"len(list_filter(string_split_regex(body, '[" + q.SPACE + r"]+'), "
        "lambda w: upper(w) = w AND lower(w) <> w AND length(w) > 2))")
TEXT_SQL = {
    "text_length": "length(body)",
    "word_count": f"len(regexp_extract_all(body, '{WS}+'))",
    "subject_length": "length(subject)",
    "code_block_count": r"len(regexp_extract_all(body, '```[\s\S]*?```'))",
    "url_count": r"len(regexp_extract_all(concat(subject, ' ', body), '(?i)https?://\S+'))",
    "question_mark_count": r"len(regexp_extract_all(body, '\?'))",
    "exclamation_count": "len(regexp_extract_all(body, '!'))",
    "caps_word_count": CAPS,
}
TIME_SQL = {
    "hour_of_day": f"hour({CREATED})",
    "day_of_week": f"isodow({CREATED}) - 1",
    "is_weekend": f"CAST(isodow({CREATED}) >= 6 AS INT)",
    "is_after_hours": f"CAST(hour({CREATED}) < 9 OR hour({CREATED}) >= 18 AS INT)",
    "ticket_age_hours": f"round(greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({CREATED})) / 3.6e9), 2)",
}
CONTEXT_SQL = {
    "reopen_count": "coalesce(reopen_count, 0)",
    "comment_count": "0",
    "customer_tier_encoded": "CASE customer_tier WHEN 'pro' THEN 1 WHEN 'enterprise' THEN 2 ELSE 0 END",
    "source_encoded": "CASE source WHEN 'hf_customer_support' THEN 1 WHEN 'synthetic' THEN 2 WHEN 'zendesk' THEN 3 ELSE 0 END",
}


def columns(parts):
    return ", ".join(f"CAST({sql} AS {'DOUBLE' if c == 'ticket_age_hours' else 'BIGINT'}) AS {c}"
                     for c, sql in parts.items())


def parsed(spark, sf):
    return fixture(spark, sf, "fx_tickets").withColumn("created_at", parse_created(F.col("created_raw")))


@query("text_features", with_views("fx_tickets") + f"SELECT doc_id, {columns(TEXT_SQL)} FROM fx_tickets")
def text_feature_rows(spark, sf):
    cols = text_features(F.col("subject"), F.col("body"))
    return fixture(spark, sf, "fx_tickets").select("doc_id", *[c.alias(n) for n, c in cols.items()])


LIVE_SQL = {
    "text_length": "length(whole)", "word_count": f"len(regexp_extract_all(whole, '{WS}+'))",
    "subject_length": "length(subject)", "code_block_count": "len(regexp_extract_all(whole, '```'))",
    "url_count": "len(regexp_extract_all(whole, 'https?://'))",
    "question_mark_count": r"len(regexp_extract_all(whole, '\?'))",
    "exclamation_count": "len(regexp_extract_all(whole, '!'))",
    "caps_word_count": CAPS.replace("body", "whole").replace("> 2", "> 1"),
}


@query("text_features_live", with_views("fx_tickets") + f""",
t AS (SELECT doc_id, subject, concat(subject, ' ', body) AS whole FROM fx_tickets)
SELECT doc_id, {columns(LIVE_SQL)} FROM t""")
def live_feature_rows(spark, sf):
    cols = text_features(F.col("subject"), F.col("body"), "agent")
    return fixture(spark, sf, "fx_tickets").select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("time_features", with_views("fx_tickets") + f"SELECT doc_id, {columns(TIME_SQL)} FROM fx_tickets")
def time_feature_rows(spark, sf):
    cols = time_features(F.col("created_at"), AS_OF)
    return parsed(spark, sf).select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("features_encoded", with_views("fx_tickets") + f"""
SELECT doc_id, {columns({c: CONTEXT_SQL[c] for c in ('customer_tier_encoded', 'source_encoded')})} FROM fx_tickets""")
def encoded(spark, sf):
    return fixture(spark, sf, "fx_tickets").select(
        "doc_id", encode(F.col("customer_tier"), TIER_CODES).alias("customer_tier_encoded"),
        encode(F.col("source"), SOURCE_CODES).alias("source_encoded"))


ALL_SQL = {**TEXT_SQL, **TIME_SQL, **CONTEXT_SQL}


@query("gold_features", with_views("fx_tickets") + f"SELECT ticket_id, {columns(ALL_SQL)} FROM fx_tickets")
def gold_features(spark, sf):
    return features(parsed(spark, sf), AS_OF)


@query("features_filled", with_views("fx_labelled") + """
SELECT d.doc_id, coalesce(l.quality, 0) AS question_mark_count, coalesce(l.toxic, 0) AS exclamation_count,
       d.n_chars AS text_length
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def filled(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = d.select("doc_id", F.col("n_chars").alias("text_length")).join(
        l.select("doc_id", F.col("quality").alias("question_mark_count"), F.col("toxic").alias("exclamation_count")),
        "doc_id", "left")
    return fill_features(joined)


@query("join_left", with_views("fx_tickets") + f"""
SELECT t.doc_id, {columns(CONTEXT_SQL)}, l.quality, l.toxic FROM fx_tickets t LEFT JOIN labels l ON t.doc_id = l.doc_id""")
def join_left(spark, sf):
    feats = features(parsed(spark, sf), AS_OF, keep=("doc_id",)).select("doc_id", *CONTEXT_SQL)
    return with_labels(feats, table(spark, sf, "labels"), ("quality", "toxic"), "doc_id")


SPLIT_SQL = """WITH ranked AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn,
       count(*) OVER () AS n FROM events),
s AS (SELECT event_id, ts, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
      FROM ranked)
"""


def split_events(spark, sf):
    return time_split(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")


@query("time_split", SPLIT_SQL + "SELECT event_id, split FROM s")
def split_rows(spark, sf):
    return split_events(spark, sf).select("event_id", "split")


@query("split_ranges", SPLIT_SQL + "SELECT split, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY split")
def ranges(spark, sf):
    return split_ranges(split_events(spark, sf), "ts")


@query("layer_summary", SPLIT_SQL + """
SELECT coalesce(split, 'total') AS split, count(*) AS n, 'skipped' AS embeddings FROM s GROUP BY ROLLUP (split)""")
def summary(spark, sf):
    return layer_summary(split_events(spark, sf), vectors=False)


# the split of the tickets, a third of which share the default date
@query("ticket_split", with_views("fx_tickets") + f""",
ranked AS (SELECT ticket_id, row_number() OVER (ORDER BY {CREATED}, ticket_id) - 1 AS rn, count(*) OVER () AS n FROM fx_tickets)
SELECT ticket_id, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
FROM ranked""")
def ticket_split(spark, sf):
    return time_split(parsed(spark, sf).select("ticket_id", "created_at"), "created_at", "ticket_id").select(
        "ticket_id", "split")


@query("sample_n", "SELECT event_id, event_type FROM events ORDER BY md5(concat(CAST(event_id AS VARCHAR), '42')), event_id LIMIT 500")
def sampled(spark, sf):
    return sample_n(table(spark, sf, "events").select("event_id", "event_type"), 500, "event_id")


@query("latest_features", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts
FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' AND ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY
GROUP BY user_id""")
def latest_features(spark, sf):
    facts = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return latest(facts, "user_id", "ts", "2024-01-25 00:00:00", "10 DAYS", tie="event_id")


@query("asof_features", """
WITH facts AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
asked AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
SELECT a.event_id, a.user_id, CASE WHEN f.ts > a.ts - INTERVAL 7 DAY THEN f.value END AS fact_value,
       CASE WHEN f.ts > a.ts - INTERVAL 7 DAY THEN f.ts END AS fact_ts
FROM asked a ASOF LEFT JOIN facts f ON a.user_id = f.user_id AND a.ts >= f.ts""")
def asof_features(spark, sf):
    events = table(spark, sf, "events")
    facts = events.where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id", "value")
    asked = events.where(F.col("event_type") != "purchase").select("event_id", "user_id", "ts")
    return as_of_join(asked, facts, "user_id", "ts", ["value"], "7 DAYS", tie="event_id").select(
        "event_id", "user_id", "fact_value", "fact_ts")


@query("embed_text", with_views("fx_tickets") + r"""
SELECT doc_id, substr(concat(subject, ' [SEP] ', body), 1, 2048) AS batch_text,
       CASE WHEN live = '' THEN 'empty' ELSE live END AS live_text
FROM (SELECT *, regexp_replace(regexp_replace(concat(subject, ' ', body), '[^\x00-\x7F]', '', 'g'),
                               '^[\t\n\x0b\f\r \x1c-\x1f]+|[\t\n\x0b\f\r \x1c-\x1f]+$', '', 'g') AS live FROM fx_tickets)""")
def embed_texts(spark, sf):
    s, b = F.col("subject"), F.col("body")
    return fixture(spark, sf, "fx_tickets").select("doc_id", embed_text(s, b).alias("batch_text"),
                                                   embed_text(s, b, "live").alias("live_text"))


assert set(ALL_SQL) == set(FEATURES)
