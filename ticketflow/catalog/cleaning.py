"""Queries over raw tickets: sources, cleaning, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CATEGORIES, PRIORITIES, SILVER_COLUMNS, SOURCES
from ..functions.labels import label_map_df, normalise_labels, route_by_category
from ..functions.prompts import CLASSIFY_HEAD, CLASSIFY_TAIL, classify_prompt
from ..functions.rules import default_priority
from ..functions.text import join_flags, mask_columns, norm_label, parse_created
from ..operators.dedup import dedup
from ..operators.quality import (
    expectations, in_set, min_length as length_rule, not_null, row_count, validate_requests, validate_tickets,
)
from ..plans import silver as plan
from ..session import prepare, work_path
from ..sources.adapters import (
    adapt_github, adapt_passthrough, adapt_support_a, adapt_support_b, admit, combine, distinct_values, provenance,
    source_counts,
)
from ..sources.augment import augment as augmented, missing_rows
from ..sources.readers import columns_to_rows, read_layer
from ..sources.sinks import partition_counts, write_silver
from . import sqltext as q
from .fixtures import AS_OF, bronze, fixture, table, with_views
from .registry import query

ADMIT = "coalesce(subject, '') <> '' AND length(body) >= 20"
SOURCES_SQL = with_views("fx_raw_github", "fx_raw_a", "fx_raw_b", "fx_raw_synthetic") + f""",
adapted AS (
  SELECT concat('GH-', coalesce(repo, 'unknown'), '-', CAST(issue_number AS VARCHAR)) AS ticket_id, 'github' AS source,
         created_at, title AS subject, body, labels AS labels_raw FROM fx_raw_github
  UNION ALL
  SELECT concat('HF-A-', sha1(concat(subject, chr(31), body))), 'hf_customer_support', NULL, subject, body,
         [coalesce(queue, ''), coalesce(type, '')] FROM fx_raw_a
  UNION ALL
  SELECT concat('HF-B-', sha1(concat(Ticket_Subject, chr(31), Combined_Text))), 'hf_customer_support', NULL,
         Ticket_Subject, Combined_Text, [coalesce(Ticket_Type, '')] FROM fx_raw_b
  UNION ALL
  SELECT ticket_id, source, created_at, subject, body, labels_raw FROM fx_raw_synthetic),
admitted AS (SELECT * FROM adapted WHERE {ADMIT})
"""


def sources(spark, sf):
    return combine(
        adapt_github(fixture(spark, sf, "fx_raw_github")),
        adapt_support_a(fixture(spark, sf, "fx_raw_a")),
        adapt_support_b(fixture(spark, sf, "fx_raw_b"), "Ticket_Subject", "Combined_Text", "Ticket_Type"),
        adapt_passthrough(fixture(spark, sf, "fx_raw_synthetic")),
    )


@query("scan_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_parquet(spark, sf):
    return read_layer(prepare(spark), f"{sf}/documents.parquet", ["doc_id", "lang", "source", "n_chars"])


@query("columns_to_rows", "SELECT conv_id, turn, role, text FROM conversations")
def columns_rows(spark, sf):
    """Records of parallel arrays, at most 64 turns each, back to rows."""
    part = F.floor(F.col("turn") / 64)
    records = table(spark, sf, "conversations").groupBy("conv_id", part).agg(
        F.collect_list(F.struct("turn", "role", "text")).alias("r"))
    arrays = records.select("conv_id", *[F.col(f"r.{c}").alias(c) for c in ("turn", "role", "text")])
    return columns_to_rows(arrays, ["turn", "role", "text"], ("conv_id",))


@query("adapt_sources", SOURCES_SQL + """
SELECT ticket_id, source, created_at, subject, body, array_to_string(labels_raw, '|') AS labels FROM admitted""")
def adapt_sources(spark, sf):
    return sources(spark, sf).select("ticket_id", "source", "created_at", "subject", "body",
                                     F.array_join("labels_raw", "|").alias("labels"))


@query("union_sources", SOURCES_SQL + """
SELECT source, count(*) AS n, count(created_at) AS dated, CAST(sum(length(body)) AS BIGINT) AS chars,
       count(DISTINCT ticket_id) AS ids FROM admitted GROUP BY source""")
def union_sources(spark, sf):
    return sources(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("created_at").alias("dated"),
        F.sum(F.length("body")).alias("chars"), F.count_distinct("ticket_id").alias("ids"))


@query("source_counts", SOURCES_SQL + "SELECT coalesce(source, 'total') AS source, count(*) AS n FROM admitted GROUP BY ROLLUP (source)")
def sources_counted(spark, sf):
    return source_counts(sources(spark, sf))


@query("distinct_sources", SOURCES_SQL + "SELECT DISTINCT source FROM admitted")
def distinct_sources(spark, sf):
    return distinct_values(sources(spark, sf), "source")


LICENCES = [("github", "public interface"), ("hf_customer_support", "open data"), ("synthetic", "own"),
            ("knowledge_base", "per article")]


@query("provenance", SOURCES_SQL + """
SELECT m.source, m.licence, c.n AS row_count
FROM (VALUES ('github', 'public interface'), ('hf_customer_support', 'open data'), ('synthetic', 'own'),
             ('knowledge_base', 'per article')) m(source, licence)
LEFT JOIN (SELECT source, count(*) AS n FROM admitted GROUP BY source) c ON m.source = c.source""")
def provenance_rows(spark, sf):
    return provenance(sources(spark, sf), spark.createDataFrame(LICENCES, "source string, licence string"))


@query("bronze_admit", with_views("fx_tickets") + f"SELECT doc_id, ticket_id, subject, body FROM fx_tickets WHERE {ADMIT}")
def bronze_admit(spark, sf):
    return admit(fixture(spark, sf, "fx_tickets")).select("doc_id", "ticket_id", "subject", "body")


@query("silver_filter", with_views("fx_tickets") + f"SELECT doc_id, length(body) AS chars FROM fx_tickets WHERE {q.KEPT}")
def silver_filter(spark, sf):
    kept = plan.min_length(plan.drop_blank(fixture(spark, sf, "fx_tickets")))
    return kept.select("doc_id", F.length("body").alias("chars"))


@query("priority_default", q.BRONZE + f"SELECT doc_id, {q.PRIORITY} AS priority FROM bronze")
def priority_default(spark, sf):
    return bronze(spark, sf).select("doc_id", default_priority(F.col("priority")).alias("priority"))


@query("ticket_id", q.BRONZE + f"SELECT doc_id, {q.TICKET_ID} AS ticket_id FROM bronze")
def ticket_id(spark, sf):
    return plan.fill_ticket_id(bronze(spark, sf), "doc_id").select("doc_id", "ticket_id")


@query("parse_dates", q.BRONZE + f"SELECT doc_id, {q.CREATED} AS created_at FROM bronze")
def parse_dates(spark, sf):
    return bronze(spark, sf).select(
        "doc_id", parse_created(F.col("created_at")).cast("timestamp_ntz").alias("created_at"))


@query("text_cuts", with_views("fx_tickets") + """
SELECT doc_id, substr(subject, 1, 200) AS subject_200, substr(subject, 1, 500) AS subject_500,
       substr(subject, 1, 300) AS subject_300, substr(body, 1, 2000) AS body_2000, substr(body, 1, 500) AS body_500,
       substr(body, 1, 200) AS body_200, length(body) AS chars,
       concat('Ticket Subject: ', substr(subject, 1, 500), chr(10), 'Ticket Body: ', substr(body, 1, 2000)) AS prompt_middle
FROM fx_tickets""")
def text_cuts(spark, sf):
    prompt = classify_prompt(F.col("subject"), F.col("body"))
    cuts = {"subject_200": ("subject", 200), "subject_500": ("subject", 500), "subject_300": ("subject", 300),
            "body_2000": ("body", 2000), "body_500": ("body", 500), "body_200": ("body", 200)}
    head, tail = len(CLASSIFY_HEAD), len(CLASSIFY_TAIL)
    middle = F.substring(prompt, F.lit(head + 1), F.length(prompt) - F.lit(head + tail))
    return fixture(spark, sf, "fx_tickets").select(
        "doc_id", *[F.substring(c, 1, n).alias(name) for name, (c, n) in cuts.items()],
        F.length("body").alias("chars"), middle.alias("prompt_middle"))


@query("label_map", with_views("fx_tickets") + f""",
tokens AS (SELECT lower(trim(x)) AS label FROM (SELECT unnest(labels_raw) AS x FROM fx_tickets))
SELECT label, ({q.LABELS})[label] AS category, count(*) AS n FROM tokens GROUP BY label""")
def label_map(spark, sf):
    raw = fixture(spark, sf, "fx_tickets").select(F.explode("labels_raw").alias("label"))
    tokens = raw.select(norm_label(F.col("label")).alias("label"))
    counts = tokens.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(label_map_df(spark), "label", "left").select("label", "category", "n")


@query("normalise_labels", with_views("fx_tickets") + f"SELECT doc_id, {q.CATEGORY} AS category FROM fx_tickets")
def normalised(spark, sf):
    return fixture(spark, sf, "fx_tickets").select("doc_id", normalise_labels(F.col("labels_raw")).alias("category"))


@query("route_category", with_views("fx_tickets") + f""",
c AS (SELECT doc_id, {q.CATEGORY} AS category FROM fx_tickets)
SELECT doc_id, category, {q.team('category')} AS routing_team FROM c""")
def route_category(spark, sf):
    labelled = normalised(spark, sf)
    return labelled.withColumn("routing_team", route_by_category(F.col("category")))


TICKETS_MASKED = with_views("fx_tickets") + ",\n" + q.masked("fx_tickets", "doc_id")


@query("pii_mask", TICKETS_MASKED + "SELECT doc_id, subject, body FROM masked")
def pii_mask(spark, sf):
    tickets = fixture(spark, sf, "fx_tickets").select("doc_id", "subject", "body")
    return mask_columns(tickets, ["subject", "body"], "flags").select("doc_id", "subject", "body")


@query("pii_flags", TICKETS_MASKED + "SELECT doc_id, pii_flags FROM masked")
def pii_flags(spark, sf):
    tickets = fixture(spark, sf, "fx_tickets").select("doc_id", "subject", "body")
    masked = mask_columns(tickets, ["subject", "body"], "flags")
    return masked.select("doc_id", join_flags(F.col("flags")).alias("pii_flags"))


KEPT_MASKED = (with_views("fx_tickets") + f",\nkept AS (SELECT * FROM fx_tickets WHERE {q.KEPT}),\n"
               + q.masked("kept", "doc_id"))


@query("pii_stats", KEPT_MASKED + """,
hits AS (SELECT unnest(string_split(pii_flags || ',any', ',')) AS flag FROM masked WHERE pii_flags <> '')
SELECT flag, count(*) AS tickets FROM hits GROUP BY flag""")
def pii_stats(spark, sf):
    return plan.pii_stats(fixture(spark, sf, "fx_tickets"))


@query("dedup_exact", with_views("fx_tickets") + """
SELECT doc_id, subject, body FROM (
  SELECT doc_id, subject, body, row_number() OVER (PARTITION BY subject || '|||' || body ORDER BY doc_id) AS rn
  FROM fx_tickets) WHERE rn = 1""")
def dedup_exact(spark, sf):
    return dedup(fixture(spark, sf, "fx_tickets").select("doc_id", "subject", "body"), ["doc_id"])


@query("silver_stats", with_views("fx_tickets") + f""",
kept AS (SELECT * FROM fx_tickets WHERE {q.KEPT}),
{q.masked("kept", "doc_id")},
f AS (SELECT count(DISTINCT subject || '|||' || body) AS final_rows, count(*) AS kept_rows FROM masked),
b AS (SELECT count(*) AS bronze_rows,
             count(*) FILTER (WHERE NOT regexp_matches(body, '{q.NOT_BLANK}')) AS dropped_blank,
             count(*) FILTER (WHERE regexp_matches(body, '{q.NOT_BLANK}') AND length(body) < 20) AS dropped_short
      FROM fx_tickets)
SELECT bronze_rows, dropped_blank, dropped_short, kept_rows - final_rows AS dropped_duplicate, final_rows,
       bronze_rows - final_rows AS dropped_total FROM b, f""")
def silver_stats(spark, sf):
    return plan.silver_stats(fixture(spark, sf, "fx_tickets"))


@query("silver", q.SILVER + """
SELECT ticket_id, source, created_at, subject, body, category, priority, routing_team,
       array_to_string(labels_raw, '|') AS labels_raw, pii_flags, reopen_count, customer_tier, 0 AS comments FROM silver""")
def silver(spark, sf):
    out = plan.to_silver(bronze(spark, sf), "doc_id")
    return out.withColumns({
        "created_at": F.col("created_at").cast("timestamp_ntz"),
        "labels_raw": F.array_join("labels_raw", "|"),
        "comments": F.size("comments"),
    }).select(*SILVER_COLUMNS, "comments")


@query("tickets_per_team", q.SILVER + """
SELECT category, routing_team, count(*) AS tickets, CAST(sum(length(body)) AS BIGINT) AS chars
FROM silver GROUP BY category, routing_team""")
def tickets_per_team(spark, sf):
    out = plan.to_silver(bronze(spark, sf), "doc_id")
    return out.groupBy("category", "routing_team").agg(F.count(F.lit(1)).alias("tickets"),
                                                       F.sum(F.length("body")).alias("chars"))


@query("partition_counts", q.SILVER + "SELECT source, count(*) AS n FROM silver GROUP BY source")
def partitions_counted(spark, sf):
    path = work_path(spark, "silver-by-source")
    write_silver(plan.to_silver(bronze(spark, sf), "doc_id"), path, by="source")
    return partition_counts(read_layer(spark, path), "source")


def _reasons(pairs):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END"
                                         for name, ok in pairs.items()) + ")"


@query("validate_requests", with_views("fx_tickets") + f"""
SELECT doc_id, coalesce(ticket_id, '') AS ticket_id, true AS run_rag, {_reasons({
    'subject': 'length(subject) BETWEEN 1 AND 500', 'body': 'length(body) BETWEEN 1 AND 10000'})} AS reasons
FROM fx_tickets""")
def requests_checked(spark, sf):
    asked = fixture(spark, sf, "fx_tickets").select("doc_id", "ticket_id", "subject", "body")
    return validate_requests(asked).select("doc_id", "ticket_id", "run_rag", F.array_join("reasons", ",").alias("reasons"))


@query("validate_tickets", with_views("fx_tickets") + f"""
SELECT doc_id, coalesce(customer_tier, 'free') AS customer_tier, CAST(coalesce(reopen_count, 0) AS BIGINT) AS reopen_count,
       {_reasons({
           'ticket_id': 'ticket_id IS NOT NULL', 'created_at': 'try_cast(created_raw AS TIMESTAMP) IS NOT NULL',
           'subject': 'subject IS NOT NULL', 'body': 'body IS NOT NULL',
           'source': "source IN ('github', 'zendesk', 'synthetic', 'hf_customer_support', 'kaggle_github_issues')",
           'category': "labels_raw[1] IN ('bug', 'feature', 'security', 'billing', 'performance', 'docs', 'question', "
                       "'incident', 'sla_breach', 'ui', 'test', 'dependency')",
           'priority': "priority_raw IN ('critical', 'high', 'medium', 'low')",
           'routing_team': 'false',
           'customer_tier': "coalesce(customer_tier, 'free') IN ('free', 'pro', 'enterprise')"})} AS reasons
FROM fx_tickets""")
def tickets_checked(spark, sf):
    raw = fixture(spark, sf, "fx_tickets")
    shaped = raw.select("doc_id", "ticket_id", "source", F.try_to_timestamp("created_raw").alias("created_at"),
                        "subject", "body", F.get("labels_raw", F.lit(0)).alias("category"),
                        F.col("priority_raw").alias("priority"), "labels_raw", "customer_tier", "reopen_count")
    return validate_tickets(shaped).select("doc_id", "customer_tier", "reopen_count",
                                           F.array_join("reasons", ",").alias("reasons"))


def _counted(rule, column, bad):
    return (f"SELECT '{rule}' AS rule, '{column}' AS \"column\", count(*) FILTER (WHERE {bad}) = 0 AS success, "
            f"count(*) FILTER (WHERE {bad}) AS unexpected_count FROM t")


@query("expectations", q.BRONZE + f""",
t AS (SELECT *, {q.CATEGORY} AS category FROM bronze)
SELECT 'row_count' AS rule, '*' AS "column", count(*) >= 500 AS success, greatest(500 - count(*), 0) AS unexpected_count FROM t
UNION ALL {_counted('not_null', 'ticket_id', 'ticket_id IS NULL')}
UNION ALL {_counted('not_null', 'created_at', 'created_at IS NULL')}
UNION ALL {_counted('not_null', 'body', 'body IS NULL')}
UNION ALL {_counted('in_set', 'source', "source NOT IN ('github', 'zendesk', 'synthetic', 'hf_customer_support', 'kaggle_github_issues')")}
UNION ALL {_counted('in_set', 'category', "category NOT IN ('bug', 'feature', 'security', 'billing', 'performance', 'docs', 'question', 'incident', 'sla_breach', 'ui', 'test', 'dependency')")}
UNION ALL {_counted('in_set', 'priority', "priority NOT IN ('critical', 'high', 'medium', 'low')")}
UNION ALL {_counted('min_length', 'body', 'length(body) < 20')}""")
def expectation_rows(spark, sf):
    tickets = bronze(spark, sf).withColumn("category", normalise_labels(F.col("labels_raw")))
    return expectations(tickets, [
        row_count(500), not_null("ticket_id"), not_null("created_at"), not_null("body"), in_set("source", SOURCES),
        in_set("category", CATEGORIES), in_set("priority", PRIORITIES), length_rule("body")])


FILLS = {"component": ("door", "lift", "gate"), "amount": ("5 EUR", "70 EUR")}
SEEDED = "concat('42:', category, ':', k{})"


def _drawn(name: str, size: str) -> str:
    return f"CAST('0x' || substr(sha1({SEEDED.format(f", ':{name}'")}), 1, 12) AS BIGINT) % {size}"


def _filled(body: str) -> str:
    for name, values in FILLS.items():
        listed = ", ".join(f"'{v}'" for v in values)
        body = f"replace({body}, '{{{name}}}', ([{listed}])[{_drawn(name, str(len(values)))} + 1])"
    return f"regexp_replace({body}, '\\{{[a-z_0-9]+\\}}', '', 'g')"


@query("augment", with_views("fx_tickets") + f""",
rows AS (SELECT {q.CATEGORY} AS category FROM fx_tickets),
have AS (SELECT category, count(*) AS n FROM rows GROUP BY category),
wanted AS (SELECT category, (SELECT max(n) FROM have) - n AS n FROM have),
templates AS (SELECT category, list(concat('About {{component}} for {{amount}} {{unknown}}: ', text) ORDER BY item_id) AS options
              FROM benchmark, (SELECT category, row_number() OVER (ORDER BY category) AS c FROM have) h
              WHERE item_id % (SELECT count(*) FROM have) + 1 = h.c GROUP BY category),
made AS (SELECT category, unnest(range(n)) AS k FROM wanted),
filled AS (SELECT category, k, options[{_drawn('template', 'len(options)')} + 1] AS raw FROM made JOIN templates USING (category)),
bodies AS (SELECT category, k, {_filled('raw')} AS body FROM filled)
SELECT concat('SYN-', sha1({SEEDED.format('')})) AS ticket_id, 'synthetic' AS source,
       strftime(TIMESTAMP '{AS_OF}' - to_days(CAST({_drawn('age', '366')} AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS created_at,
       concat(upper(substr(category, 1, 1)), substr(category, 2), ' Issue - ', substr(body, 1, 30), '...') AS subject, body, category,
       CASE WHEN category IN ('security', 'incident') THEN 'high' ELSE 'medium' END AS priority,
       CASE category WHEN 'security' THEN 'security' WHEN 'billing' THEN 'billing' ELSE 'support' END AS routing_team,
       (['free', 'pro', 'enterprise'])[{_drawn('tier', '3')} + 1] AS customer_tier
FROM bodies""")
def augment(spark, sf):
    """Rare categories are filled up to the size of the largest one, with the wordings of the benchmark table."""
    rows = normalised(spark, sf)
    names = rows.select("category").distinct().orderBy("category").toPandas()["category"]  # the fixed categories
    have = rows.groupBy("category").count()
    wordings = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("template_id"), F.get(F.array(*[F.lit(n) for n in names]), F.pmod("item_id", F.lit(len(names))).cast("int")).alias("category"),
        F.concat(F.lit("About {component} for {amount} {unknown}: "), "text").alias("body"))
    most = have.agg(F.max("count")).first()[0] or 0
    made = augmented(wordings, missing_rows(rows, most), AS_OF, FILLS)
    return made.drop("comments", "labels_raw")
