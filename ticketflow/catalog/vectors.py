"""Queries over vectors: index rows, nearest tickets, retrieval quality, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import answer_prompt, format_context, judge_context
from ..operators.dedup import upsert
from ..operators.evaluate import hit_rate_at_k, precision_at_k
from ..operators.joins import best_overlap
from ..operators.log import display_hits
from ..operators.vectors import approximate_top_k, attach_vectors, collect_hits, kb_rows, top_k
from ..plans.evaluation import eval_retrieval, neighbours
from ..session import work_path
from ..sources.readers import read_vectors
from ..sources.sinks import write_vectors
from . import sqltext as q
from .fixtures import fixture, table, with_views
from .registry import query

K = 5
KB = with_views("fx_kb")


def best(k: int, where: str = "true") -> str:
    """The k nearest rows of each row. Similarities tie at ten digits, then by id."""
    return KB + f""",
pairs AS (SELECT q.ticket_id AS query_id, q.category AS query_category, b.ticket_id, b.category, b.priority, b.subject,
                 round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 10) AS s
          FROM fx_kb q, fx_kb b WHERE {where}),
hits AS (SELECT query_id, query_category, rn AS rank, ticket_id, round(s, 4) AS similarity, category, priority, subject
         FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ticket_id) AS rn FROM pairs)
         WHERE rn <= {k})
"""


HITS = "SELECT query_id, rank, ticket_id, similarity, category, priority, subject FROM hits"


def kb(spark, sf):
    return kb_rows(fixture(spark, sf, "fx_kb"))


@query("scan_vectors", KB + """
SELECT ticket_id, split, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM fx_kb WHERE split <> 'val'""")
def scan_vectors(spark, sf):
    """Vectors written by split, and two of the splits read back."""
    path = work_path(spark, "vectors")
    write_vectors(kb(spark, sf), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read_vectors(spark, path, ("train", "test")).select(
        "ticket_id", "split", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


@query("kb_rows", KB + "SELECT ticket_id, split, category, priority, substr(subject, 1, 200) AS subject, len(embedding) AS dim FROM fx_kb")
def kb_metadata(spark, sf):
    return kb(spark, sf).withColumn("dim", F.size("embedding")).drop("embedding")


@query("index_size", KB + "SELECT coalesce(split, 'total') AS split, count(*) AS n FROM fx_kb GROUP BY ROLLUP (split)")
def index_size(spark, sf):
    return kb(spark, sf).rollup("split").count().select(F.coalesce("split", F.lit("total")).alias("split"),
                                                        F.col("count").alias("n"))


@query("attach_vectors", KB + """
SELECT k.ticket_id, k.category, round(list_sum(CAST(e.embedding AS DOUBLE[])), 4) AS total
FROM fx_kb k JOIN fx_kb e ON k.ticket_id = e.ticket_id""")
def vectors_attached(spark, sf):
    rows = kb(spark, sf)
    joined = attach_vectors(rows.select("ticket_id", "category"), rows)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return joined.select("ticket_id", "category", F.round(total, 4).alias("total"))


@query("vector_upsert", KB + """,
both_sides AS (
  SELECT ticket_id, embedding, split, category, subject, vec_id % 3 AS version, 0 AS new FROM fx_kb
  UNION ALL SELECT ticket_id, list_transform(embedding, lambda x: x * 2), 'val', category, 'updated', 1, 1 FROM fx_kb WHERE split = 'test'
  UNION ALL SELECT concat(ticket_id, '-N'), embedding, split, category, 'added', 1, 1 FROM fx_kb WHERE split = 'val')
SELECT ticket_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, split, category, subject, version FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY version DESC, new DESC) AS rn FROM both_sides) WHERE rn = 1""")
def vector_upsert(spark, sf):
    base = fixture(spark, sf, "fx_kb").select("ticket_id", "embedding", "split", "category", "subject",
                                              (F.col("vec_id") % 3).cast("int").alias("version"))
    doubled = F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding")
    changed = base.where("split = 'test'").select("ticket_id", doubled, F.lit("val").alias("split"), "category",
                                                  F.lit("updated").alias("subject"), F.lit(1).alias("version"))
    added = base.where("split = 'val'").select(F.concat("ticket_id", F.lit("-N")).alias("ticket_id"), "embedding", "split", "category",
                                               F.lit("added").alias("subject"), F.lit(1).alias("version"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    out = upsert(base, changed.unionByName(added), "ticket_id", "version")
    return out.select("ticket_id", F.round(total, 4).alias("total"), "split", "category", "subject", "version")


@query("topk_cosine", best(K) + HITS)
def topk_cosine(spark, sf):
    rows = kb(spark, sf)
    return top_k(rows, rows, K)


@query("topk_blocked", best(K, "q.ticket_id <> b.ticket_id") + HITS)
def topk_blocked(spark, sf):
    """Many blocks on both sides."""
    rows = kb(spark, sf)
    return top_k(rows, rows, K, exclude_self=True, block_rows=512)


@query("topk_local", best(K) + HITS)
def topk_local(spark, sf):
    """Queries are sent in blocks to the tasks that scan the base."""
    rows = kb(spark, sf)
    return top_k(rows, rows, K, strategy="local")


@query("topk_filtered", best(K, "b.category = 'security'") + HITS)
def topk_filtered(spark, sf):
    rows = kb(spark, sf)
    return top_k(rows, rows, K, category="security")


@query("display_hits", best(K) + """,
m AS (SELECT *, CAST(round(similarity * 10000) AS BIGINT) AS m FROM hits)
SELECT query_id, ticket_id, printf('%.1f%%', (m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END) / 10)
       AS similarity, category, priority, subject FROM m""")
def hits_shown(spark, sf):
    rows = kb(spark, sf)
    return display_hits(top_k(rows, rows, K))


def asked(spark, sf):
    """All rows, and some with a zero vector, which find nothing."""
    rows = fixture(spark, sf, "fx_kb").select("vec_id", "ticket_id", "category", "embedding")
    zero = rows.where("vec_id % 50 = 0").withColumns({
        "ticket_id": F.concat(F.lit("Z-"), "ticket_id"), "embedding": F.transform("embedding", lambda x: x * 0)})
    return rows.unionByName(zero).drop("vec_id")


MATCHES = """
asked AS (SELECT ticket_id AS query_id, category AS query_category FROM fx_kb
          UNION ALL SELECT concat('Z-', ticket_id), category FROM fx_kb WHERE vec_id % 50 = 0),
m AS (SELECT a.query_id, a.query_category, count(*) FILTER (WHERE h.category = a.query_category) AS matches
      FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id GROUP BY ALL)"""


@query("retrieval_hit_rate", best(K, "q.ticket_id <> b.ticket_id") + "," + MATCHES + """
SELECT count(*) AS queries, count(*) FILTER (WHERE matches > 0) AS found,
       round(avg(CASE WHEN matches > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM m""")
def retrieval_hit_rate(spark, sf):
    rows = kb(spark, sf)
    return hit_rate_at_k(neighbours(asked(spark, sf), rows, K, exclude_self=True)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("retrieval_precision", best(K) + "," + MATCHES + f"""
SELECT query_category, count(*) AS queries, round(sum(matches) / ({K} * count(*)), 6) AS precision
FROM m GROUP BY query_category""")
def retrieval_precision(spark, sf):
    return precision_at_k(neighbours(asked(spark, sf), kb(spark, sf), K), K).withColumn("precision", F.round("precision", 6))


@query("eval_retrieval", best(K) + "," + MATCHES + f"""
SELECT query_category, count(*) AS queries, round(sum(matches) / ({K} * count(*)), 6) AS precision, NULL AS hit_rate
FROM m GROUP BY query_category
UNION ALL SELECT 'all', count(*), NULL, round(avg(CASE WHEN matches > 0 THEN 1.0 ELSE 0.0 END), 6) FROM m""")
def retrieval_evaluated(spark, sf):
    rate, precision = eval_retrieval(asked(spark, sf), kb(spark, sf), K, sample=None)
    none = F.lit(None).cast("double")
    return precision.select("query_category", "queries", F.round("precision", 6).alias("precision"), none.alias("hit_rate")).union(
        rate.select(F.lit("all"), "queries", none, F.round("hit_rate", 6)))


@query("approximate_recall", KB + """
SELECT sum((SELECT least({k}, count(*)) FROM fx_kb)) AS wanted, true AS reached FROM fx_kb WHERE vec_id % 20 = 0""".replace("{k}", str(K)))
def approximate_recall(spark, sf):
    """Whether the coarse index finds nine tenths of the nearest rows, for each row whose id is divisible by 20, against all rows."""
    rows = kb(spark, sf)
    asked = rows.where(F.substring("ticket_id", 3, 12).cast("long") % 20 == 0)
    exact = top_k(asked, rows, K).select("query_id", "ticket_id")
    found = approximate_top_k(asked, rows, K).select("query_id", "ticket_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "ticket_id"], "left").agg(
        F.count(F.lit(1)).alias("wanted"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("reached"))


CONTEXT = best(3, "q.ticket_id <> b.ticket_id") + """,
context AS (SELECT query_id, string_agg(concat('[Ticket ', rank, ' | Similarity: ', CAST(trunc(similarity * 100) AS INT),
       '% | Category: ', category, ' | Priority: ', priority, ']', chr(10), 'Subject: ', subject), chr(10) || chr(10)
       ORDER BY rank) AS context,
       string_agg(concat('Historical Ticket ', ticket_id, ' [', category, ']:', chr(10), subject), chr(10) || chr(10)
       ORDER BY rank) AS judge_context FROM hits GROUP BY query_id)
"""


def contexts(spark, sf):
    rows = kb(spark, sf)
    return collect_hits(top_k(rows, rows, 3, exclude_self=True)).select(
        "query_id", format_context(F.col("hits")).alias("context"), judge_context(F.col("hits")).alias("judge_context"))


@query("rag_context", CONTEXT + "SELECT * FROM context")
def rag_context(spark, sf):
    return contexts(spark, sf)


@query("rag_prompt", CONTEXT + """
SELECT c.query_id, concat('A ticket of category <', k.category, '> and priority <', k.priority, '> says: ', substr(k.subject, 1, 300),
  ' -- ', substr(concat('body of ', k.subject), 1, 500), chr(10), chr(10), 'Tickets found for it:', chr(10), c.context, chr(10), chr(10),
  'Using the earlier tickets, state the first action, the likely cause, the steps to resolve it, and whether and to which team to escalate.') AS prompt
FROM context c JOIN fx_kb k ON c.query_id = k.ticket_id""")
def rag_prompt(spark, sf):
    rows = kb(spark, sf).drop("embedding").withColumnRenamed("ticket_id", "query_id")
    body = F.concat(F.lit("body of "), "subject")
    prompt = answer_prompt(F.col("subject"), body, F.col("category"), F.col("priority"), F.col("context"))
    return contexts(spark, sf).join(rows, "query_id").select("query_id", prompt.alias("prompt"))


SPLIT = "[" + q.SPACE + "]+"
WORDS = f"list_distinct(list_filter(string_split_regex(lower(text), '{SPLIT}'), lambda w: w <> ''))"


@query("word_overlap", f"""
WITH keys AS (SELECT item_id, unnest(w) AS word, greatest(len(w), 1) AS size FROM (SELECT item_id, {WORDS} AS w FROM benchmark)),
asked AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents),
scores AS (SELECT doc_id, item_id, count(*) / max(size) AS score FROM asked JOIN keys USING (word) GROUP BY doc_id, item_id),
top AS (SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM scores) WHERE rn = 1)
SELECT d.doc_id, coalesce(t.item_id, (SELECT min(item_id) FROM benchmark)) AS item_id, round(coalesce(t.score, 0), 6) AS score
FROM documents d LEFT JOIN top t ON d.doc_id = t.doc_id""")
def word_overlap(spark, sf):
    best_key = best_overlap(table(spark, sf, "documents"), "doc_id", F.col("text"), table(spark, sf, "benchmark"),
                            "item_id", "text")
    return best_key.withColumn("score", F.round("score", 6))
