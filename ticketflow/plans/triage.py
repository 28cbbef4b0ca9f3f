"""Scoring of whole tables: classify, risk, similar tickets, route, answer."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EMBED_DIM
from ..functions.features import features
from ..functions.prompts import answer_prompt, format_context
from ..functions.replies import cascade, validate_reply
from ..functions.text import embed_text
from ..operators.models import Batch, classify, embed, generate, score_sla
from ..operators.routing import triage_route
from ..operators.vectors import collect_hits, top_k
from ..schemas import HITS
from ..session import give_back, release_path, stage, stage_at

TOP = 3
RISK = ("sla_risk_score", "breach_flag", "risk_level")


def requests_of(df: DataFrame) -> DataFrame:
    """Requests with defaults: no id is the empty id, and an answer is wanted unless the request says no."""
    wanted = F.coalesce("run_rag", F.lit(True)) if "run_rag" in df.columns else F.lit(True)
    extra = [c for c in ("primary_raw", "fallback_raw", "embedding") if c in df.columns]
    return df.select(F.coalesce("ticket_id", F.lit("")).alias("ticket_id"), "subject", "body", wanted.alias("run_rag"), *extra)


def _risk(df: DataFrame, sla: PipelineModel, as_of: str, profile: str, out: str) -> DataFrame:
    """Add the risk of a request made at ``as_of``, as a struct; a projection of the row."""
    keep = df.columns
    scored = score_sla(features(df.withColumn("created_at", F.lit(as_of).cast("timestamp")), as_of, profile, tuple(keep)), sla)
    return scored.select(*keep, F.struct(*RISK).alias(out))


def triage(df: DataFrame, kb: DataFrame, sla: PipelineModel, primary: Batch | None, fallback: Batch | None, as_of: str,
           generator: Batch | None = None, embedder=None, dim: int = EMBED_DIM) -> DataFrame:
    """One result per request of ``df(ticket_id, subject, body[, run_rag])``; ``as_of`` is the request time.

    Requests need no id, and ids need not be unique: a key of their own, stored with the first pass, carries them. That
    pass classifies, scores and embeds each request once and is written out; only ids and vectors go through the
    search, and its hits come back by the key. What the search shuffled is deleted before its hits are joined. Without ``primary``, recorded replies are taken from ``primary_raw`` and
    ``fallback_raw``; a column ``embedding`` is used as it is. ``run_rag`` says per request whether an answer is generated.
    """
    asked = requests_of(df).withColumn("request_id", F.monotonically_increasing_id())
    if primary is None:
        checked = validate_reply(validate_reply(asked, "primary_raw", "__primary"), "fallback_raw", "__fallback")
        live = cascade(checked, "__primary", "__fallback", "reply").drop("__primary", "__fallback").withColumn("classify_ms", F.lit(0.0))
    else:
        live = classify(asked, primary, fallback)
    live = _risk(_risk(live, sla, as_of, "agent", "risk"), sla, as_of, "api", "caller_risk")
    if "embedding" not in live.columns:
        live = embed(live.withColumn("__embed", embed_text(F.col("subject"), F.col("body"), "live")), "__embed", embedder, dim)
    live = stage(live.select(
        "request_id", "ticket_id", "subject", "body", "run_rag", "classify_ms", "caller_risk", "embedding",
        F.col("reply.category").alias("category"), F.col("reply.priority").alias("priority"),
        F.col("reply.confidence").alias("classification_confidence"), F.col("reply.model").alias("classification_model"),
        F.col("risk.sla_risk_score").alias("sla_breach_risk")), "requests")

    start = time.perf_counter()
    nearest, path = stage_at(top_k(live.select("request_id", "embedding"), kb, TOP, query_id="request_id"), "nearest")
    give_back(df.sparkSession)
    hits = stage(collect_hits(nearest), "hits")
    del nearest
    release_path(df.sparkSession, path)
    give_back(df.sparkSession)
    retrieve_ms = round((time.perf_counter() - start) * 1000 / max(1, live.count()), 3)
    none = F.from_json(F.lit("[]"), HITS)
    out = (live.drop("embedding").join(hits.withColumnRenamed("query_id", "request_id"), "request_id", "left")
           .withColumn("similar_tickets", F.coalesce(F.col("hits").cast(HITS), none)).drop("hits"))
    out = triage_route(out, "sla_breach_risk")
    timings = {"classify_ms": F.col("classify_ms"), "retrieve_ms": F.lit(retrieve_ms)}
    if generator is None:
        out = out.withColumn("grounded_response", F.lit(""))
    else:
        prompt = answer_prompt(F.col("subject"), F.col("body"), F.col("category"), F.col("priority"),
                               format_context(F.col("similar_tickets")))
        out = generate(out.withColumn("prompt", prompt), generator, out="grounded_response", wanted=F.col("run_rag")).drop("prompt")
        out = out.withColumn("grounded_response", F.coalesce("grounded_response", F.lit("")))
        timings["rag_ms"] = F.col("generate_ms")
    total = sum(timings.values(), F.lit(0.0))
    pairs = [x for name, ms in timings.items() for x in (F.lit(name), ms)]
    return (out.withColumn("timings", F.create_map(*pairs, F.lit("total_ms"), total)).withColumn("total_ms", total)
            .select("request_id", "ticket_id", "subject", "run_rag", "category", "priority", "classification_confidence",
                    "classification_model", "sla_breach_risk", "sla_escalated", "routing_team", "auto_escalate",
                    "escalation_reason", "similar_tickets", "grounded_response", "caller_risk", "timings", "total_ms"))


def responses(results: DataFrame) -> DataFrame:
    """Triage results in the nested form callers get, one per request.

    The reported risk is scored from the caller's own features; the risk that decided the escalation stays
    in the reason.
    """
    hit = "array<struct<ticket_id:string,similarity:double,category:string,priority:string,subject:string>>"
    similar = F.transform("similar_tickets", lambda h: F.struct(
        h["ticket_id"], h["similarity"], h["category"], h["priority"], h["subject"])).cast(hit)
    return results.select(
        "ticket_id", "subject", "run_rag",
        F.struct("category", "priority", "routing_team", F.col("classification_confidence").alias("confidence"),
                 F.col("classification_model").alias("model"), F.col("auto_escalate").alias("escalated"))
         .alias("classification"),
        F.col("caller_risk").alias("sla_prediction"), "routing_team", "auto_escalate", "escalation_reason",
        similar.alias("similar_tickets"), F.nullif("grounded_response", F.lit("")).alias("grounded_response"),
        F.col("timings").alias("timings_ms"), "total_ms")


def loggable(replies: DataFrame, ts: str) -> DataFrame:
    """Responses in the form the log takes."""
    return replies.select(
        F.lit(ts).cast("timestamp").alias("ts"), "ticket_id", "subject", "classification.category",
        "classification.priority", "routing_team", "auto_escalate", F.col("sla_prediction.sla_risk_score").alias("sla_risk"),
        "classification.confidence", F.col("timings_ms").alias("timings"), "run_rag")
