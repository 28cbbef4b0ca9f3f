"""Queries that train models, and queries over recorded replies of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EMBED_DIM
from ..functions.features import features
from ..functions.labels import normalise_labels
from ..functions.prompts import answer_prompt, format_context
from ..functions.replies import cascade, validate_reply
from ..functions.rules import sla_label
from ..functions.text import embed_text, parse_created
from ..operators import evaluate as ev
from ..operators.models import (
    classifier_replies, embed, generate, grade, grade_summary, importances, load_model, save_model, score_sla, train_sla,
    train_text_classifier, training_rounds,
)
from ..operators.log import to_log_rows
from ..operators.split import time_split
from ..operators.vectors import collect_hits, kb_rows, top_k
from ..plans.triage import loggable, responses, triage
from ..session import stage, work_path
from . import sqltext as q
from .fixtures import AS_OF, fixture, with_views
from .registry import query
from .scoring import CASCADE, REPORT, cascaded
from .vectors import CONTEXT, best

_fitted: dict[tuple[str, str], tuple] = {}


def tickets(spark, sf):
    raw = fixture(spark, sf, "fx_tickets")
    return raw.withColumns({"created_at": parse_created(F.col("created_raw")),
                            "category": normalise_labels(F.col("labels_raw"))})


def sla_sets(spark, sf):
    rows = features(tickets(spark, sf), AS_OF, keep=("ticket_id", "created_at", "category"))
    labelled = rows.withColumn("label", sla_label(F.col("category")))
    return stage(time_split(labelled, "created_at", "ticket_id"), "sla-sets")


def sla_model(spark, sf):
    """Labelled rows and the model of 500 trees at most, fitted once per session and table, then saved and loaded."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        rows, path = sla_sets(spark, sf), work_path(spark, "sla-model")
        save_model(train_sla(rows.where("split = 'train'"), rows.where("split = 'val'")), path)
        _fitted[key] = (rows, path)
    rows, path = _fitted[key]
    return rows, load_model(path)


@query("sla_train")
def sla_training(spark, sf):
    """Metrics on the validation and test splits."""
    rows, model = sla_model(spark, sf)
    scored = stage(score_sla(rows.where("split <> 'train'"), model).withColumn("hit", F.col("breach_flag").cast("int")),
                   "sla-scored")
    parts = []
    for split in ("val", "test"):
        part = scored.where(F.col("split") == split)
        curve = ev.auc(part, "probability_breach", "label").select(F.lit(split).alias("split"), "auc")
        parts.append(curve.join(ev.binary_metrics(part, "label", "hit").withColumn("split", F.lit(split)), "split"))
    return (parts[0].unionByName(parts[1]).withColumn("rounds", F.lit(len(model.losses) - 1)).withColumn("trees", F.lit(len(model.trees))))


@query("sla_rounds")
def sla_rounds(spark, sf):
    """Validation loss of every round on orders whose label depends on their features in the same way in all months: training and
    scoring over the whole table, with the share of right answers on the months behind the training."""
    rows = stage(time_split(fixture(spark, sf, "fx_sla"), "created_at", "ticket_id"), "sla-orders")
    model = train_sla(rows.where("split = 'train'"), rows.where("split = 'val'"), patience=20)
    right = score_sla(rows.where("split = 'test'"), model).agg(F.avg((F.col("breach_flag").cast("int") == F.col("label")).cast("double"))).first()[0]
    return training_rounds(spark, model).withColumn("right", F.lit(right))


@query("sla_score")
def sla_scoring(spark, sf):
    rows, model = sla_model(spark, sf)
    return score_sla(rows, model).select("ticket_id", "split", "sla_risk_score", "breach_flag", "risk_level")


@query("sla_importance")
def sla_importance(spark, sf):
    _, model = sla_model(spark, sf)
    return importances(spark, model)


@query("embed", with_views("fx_tickets") + f"""
SELECT ticket_id, {EMBED_DIM} AS dim, CASE WHEN regexp_matches(concat(subject, ' ', body), '[A-Za-z0-9_]') THEN 1.0 ELSE 0.0 END AS norm
FROM fx_tickets""")
def embeddings(spark, sf):
    rows = fixture(spark, sf, "fx_tickets").select("ticket_id", embed_text(F.col("subject"), F.col("body")).alias("text"))
    made = embed(rows, "text")
    return made.select("ticket_id", F.size("embedding").alias("dim"),
                       F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("classify")
def classified(spark, sf):
    """A text classifier, trained on the older tickets, as primary, and a fixed reply as fallback, for all tickets."""
    rows = time_split(tickets(spark, sf).select("ticket_id", "created_at", "category", F.concat_ws(" ", "subject", "body").alias("text")),
                      "created_at", "ticket_id")
    model = train_text_classifier(rows.where("split = 'train'"), "text", "category")
    replies = classifier_replies(rows, model, "primary_raw", F.lit("medium"), F.lit("support"))
    replies = replies.withColumn("fallback_raw", F.to_json(F.struct(
        F.lit("question").alias("category"), F.lit("low").alias("priority"), F.lit("support").alias("routing_team"),
        F.lit(0.8).alias("confidence"))))
    checked = validate_reply(validate_reply(replies, "primary_raw", "p"), "fallback_raw", "f")
    return cascade(checked, "p", "f", "reply", "trained", "fixed").select("ticket_id", "split", "reply.*")


@query("eval_classifier", CASCADE + "," + with_views("fx_orders_triage").removeprefix("WITH ") + """,
pairs AS (SELECT o.category AS t, c.category AS p FROM chosen c JOIN fx_orders_triage o ON c.ticket_id = o.ticket_id),""" + REPORT)
def classifier_evaluation(spark, sf):
    """Recorded replies, checked and cascaded, against the true categories."""
    predicted = cascaded(spark, sf).select("ticket_id", F.col("reply.category").alias("category"))
    report = ev.classification_report(ev.pair_predictions(predicted, fixture(spark, sf, "fx_orders_triage").select("ticket_id", "category")))
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})


def asked(spark, sf):
    """Requests with recorded replies, each with one of the given vectors; every second one wants an answer, and none has an id."""
    vectors = fixture(spark, sf, "fx_kb").select(F.col("vec_id").alias("v"), "embedding")
    n = vectors.count()
    return (fixture(spark, sf, "fx_replies").withColumn("v", F.col("o_orderkey") % n).join(vectors, "v")
            .select(F.lit(None).cast("string").alias("ticket_id"), F.concat(F.lit("Order "), "o_orderkey").alias("subject"), F.lit("Where is it?").alias("body"),
                    (F.col("o_orderkey") % 2 == 0).alias("run_rag"), "primary_raw", "fallback_raw", "embedding"))


def echo(prompts: list[str]) -> list[str]:
    """Sends back what a model would be sent, so that the comparison sees it."""
    return list(prompts)


TRIAGE = best(3).rstrip() + "," + CASCADE.removeprefix("WITH ") + """,
kb_size AS (SELECT count(*) AS n FROM fx_kb),
near AS (SELECT query_id, ticket_id AS nearest FROM hits WHERE rank = 1),
asked AS (SELECT r.ticket_id AS reply_id, concat('Order ', r.o_orderkey) AS subject, r.o_orderkey % 2 = 0 AS run_rag,
                 concat('V-', lpad(CAST(r.o_orderkey % (SELECT n FROM kb_size) AS VARCHAR), 12, '0')) AS vector FROM fx_replies r)
"""


@query("triage", TRIAGE + """
SELECT a.subject, '' AS ticket_id, c.category, c.priority, c.confidence AS classification_confidence, c.model AS classification_model,
       n.nearest, (SELECT least(3, n) FROM kb_size) AS similar,
       CASE WHEN a.run_rag THEN concat('A ticket of category <', c.category, '> and priority <', c.priority, '> says: ', a.subject) ELSE '' END AS answer_head
FROM asked a JOIN chosen c ON a.reply_id = c.ticket_id JOIN near n ON n.query_id = a.vector""")
def triaged(spark, sf):
    _, model = sla_model(spark, sf)
    out = triage(asked(spark, sf), kb_rows(fixture(spark, sf, "fx_kb")), model, None, None, AS_OF, generator=echo)
    return out.select("subject", "ticket_id", "category", "priority", "classification_confidence", "classification_model",
                      F.get("similar_tickets", F.lit(0))["ticket_id"].alias("nearest"), F.size("similar_tickets").cast("long").alias("similar"),
                      F.substring_index("grounded_response", " -- ", 1).alias("answer_head"))


@query("triage_log", TRIAGE + f"""
SELECT TIMESTAMP '{AS_OF}' AS ts, '' AS ticket_id, a.subject, c.category, c.priority, round(c.confidence, 4) AS confidence,
       CAST(a.run_rag AS INT) AS run_rag
FROM asked a JOIN chosen c ON a.reply_id = c.ticket_id""")
def triage_log(spark, sf):
    """Requests, triaged, answered in the callers' form and turned into log rows."""
    _, model = sla_model(spark, sf)
    results = triage(asked(spark, sf), kb_rows(fixture(spark, sf, "fx_kb")), model, None, None, AS_OF)
    rows = to_log_rows(loggable(responses(results), AS_OF))
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "ticket_id", "subject", "category", "priority", "confidence", "run_rag")


@query("generate", CONTEXT + """
SELECT c.query_id, concat('A ticket of category <', k.category, '> and priority <', k.priority, '> says: ', k.subject,
  ' -- body', chr(10), chr(10), 'Tickets found for it:', chr(10), c.context) AS response_head
FROM context c JOIN fx_kb k ON c.query_id = k.ticket_id""")
def generated(spark, sf):
    """What a writer is sent for each row: the row itself, and its nearest others."""
    rows = kb_rows(fixture(spark, sf, "fx_kb"))
    hits = collect_hits(top_k(rows, rows, 3, exclude_self=True))
    joined = rows.drop("embedding").withColumnRenamed("ticket_id", "query_id").join(hits, "query_id")
    prompt = answer_prompt(F.col("subject"), F.lit("body"), F.col("category"), F.col("priority"), format_context(F.col("hits")))
    out = generate(joined.withColumn("prompt", prompt), echo)
    return out.select("query_id", F.substring_index("response", "\n\nUsing the earlier tickets", 1).alias("response_head"))


def recorded(prompts: list[str]) -> list[str]:
    """The recorded reply of a judge, which the query passes as the answer to be graded."""
    return [p.split("\nAnswer: ", 1)[1].split("\n\nAnswer with", 1)[0] for p in prompts]


@query("grade", with_views("fx_replies") + """,
v AS (SELECT CASE WHEN json_valid(judge_raw) THEN CAST(judge_raw AS JSON) END AS j FROM fx_replies),
s AS (SELECT CASE WHEN j IS NULL THEN 0.0 ELSE coalesce(try_cast(json_extract_string(j, '$.score') AS DOUBLE), 0.0) END AS score FROM v)
SELECT count(*) AS n, round(avg(score), 6) AS faithfulness, round(avg(score), 6) AS relevance FROM s""")
def graded(spark, sf):
    rows = fixture(spark, sf, "fx_replies").select(F.col("ticket_id").alias("question"), F.lit("").alias("context"), F.col("judge_raw").alias("answer"))
    return grade_summary(grade(rows, recorded)).select(
        "n", F.round("faithfulness", 6).alias("faithfulness"), F.round("relevance", 6).alias("relevance"))
