"""Triage of whole tables: one result per request, whatever its id."""

from pyspark.sql import functions as F

from tests.test_models import fallback, primary
from ticketflow.constants import FEATURES
from ticketflow.functions.prompts import ANSWER_SYSTEM, CLASSIFY_SYSTEM
from ticketflow.operators import models as m
from ticketflow.plans.flow import RAW_ID, with_raw_id
from ticketflow.plans.silver import to_silver
from ticketflow.plans.triage import loggable, responses, triage
from ticketflow.session import give_back, stage

AS_OF = "2025-01-01 00:00:00"
KB = "ticket_id string, embedding array<float>, category string, priority string, subject string"


def model(spark):
    rows = [tuple([float((i * (j + 3)) % 17) for j in range(17)] + [int((i * 3) % 17 > 12)]) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", label int")
    return m.train_sla(df, df.limit(80), trees=2)


def test_requests_without_an_id(spark):
    """As many results as requests, each text embedded once, an answer only where one is wanted."""
    seen = spark.sparkContext.accumulator(0)

    def vectors(texts):
        seen.add(len(texts))
        return [[1.0, float(len(t) % 5)] for t in texts]

    asked = spark.createDataFrame([("" if i % 2 else None, "sure" if i % 3 else "unsure", f"body {i}", None if i % 4 == 0 else i % 4 == 1)
                                   for i in range(20)], "ticket_id string, subject string, body string, run_rag boolean")
    kb = spark.createDataFrame([(f"K{i}", [1.0, float(i)], "bug", "low", "s") for i in range(6)], KB)
    out = triage(asked, kb, model(spark), primary, fallback, AS_OF, generator=lambda prompts: ["answer"] * len(prompts), embedder=vectors, dim=2)
    rows = out.collect()
    assert len(rows) == 20 and len({r["request_id"] for r in rows}) == 20 and seen.value == 20
    assert sum(r["grounded_response"] == "answer" for r in rows) == sum(r["run_rag"] for r in rows) == 10
    assert all(len(r["similar_tickets"]) == 3 and r["timings"]["retrieve_ms"] > 0 for r in rows)
    replies = responses(out)
    assert replies.count() == 20 and replies.where("grounded_response is null").count() == 10
    assert loggable(replies, AS_OF).groupBy("run_rag").count().count() == 2


def test_system_prompts_reach_the_hooks(spark):
    asked = spark.createDataFrame([("a", "s", "b")], "ticket_id string, subject string, body string")

    def told(prompts, system):
        return [system] * len(prompts)
    out = m.generate(asked.withColumn("prompt", F.lit("p")), told).first()
    assert out["response"] == ANSWER_SYSTEM
    sent = asked.select(m.call_model(told, F.lit("p"), system=CLASSIFY_SYSTEM).alias("c")).first()["c"]
    assert sent["raw"] == CLASSIFY_SYSTEM


def test_calls_are_bounded_and_halved(spark):
    sizes = []

    def fn(texts):
        sizes.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]
    assert m._answer(fn, ["a", "b", "bad", "c"])[2][:2] == (None, "no") and sizes == [4, 2, 2, 1, 1]

    def few(texts):
        assert len(texts) <= m.CALL_ROWS
        return texts
    rows = spark.range(500).coalesce(1).select(m.call_model(few, F.col("id").cast("string"), F.col("id") % 2 == 0).alias("c"))
    assert rows.where("c.raw is not null and c.failure is null").count() == 250


def test_blank_ids_become_ids_of_their_own(spark):
    rows = [(i, "zendesk", None, f"subject {n}", "long enough body number " + str(n), []) for n, i in enumerate([" ", "", None, None, "T1"])]
    schema = "ticket_id string, source string, created_at string, subject string, body string, labels_raw array<string>"
    out = to_silver(with_raw_id(spark.createDataFrame(rows, schema)), RAW_ID)
    ids = [r["ticket_id"] for r in out.collect()]
    assert len(set(ids)) == 5 and None not in ids and "T1" in ids and RAW_ID not in out.columns


def test_a_value_that_most_rows_have(spark):
    from ticketflow.operators.log import latency_stats
    rows = spark.range(10_000).select(F.when(F.col("id") < 9000, 5.0).otherwise(F.col("id") + 0.0).alias("ms"))
    got = latency_stats(rows, "ms").first()
    assert (got["n"], got["p99_ms"]) == (10_000, 9900.0)
    empty = latency_stats(rows.limit(0), "ms").first()
    assert (empty["n"], empty["avg_ms"], empty["p99_ms"]) == (0, None, None)


def shuffled(spark):
    """Bytes of shuffles on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_shuffles_of_the_search_are_gone_before_the_join(spark):
    rows = spark.range(600).select(F.lit("").alias("ticket_id"), F.lit("sure").alias("subject"), F.lit("body").alias("body"), "id")
    asked = rows.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3).cast("float") + i * 0)).drop("id")
    kb = spark.createDataFrame([(f"K{i}", [float((i * j) % 7) for j in range(64)], "bug", "low", "s") for i in range(6)], KB)
    asked, fitted = stage(asked, "asked"), model(spark)
    give_back(spark)
    before = shuffled(spark)
    out = triage(asked, kb, fitted, primary, fallback, AS_OF)
    assert shuffled(spark) - before < 40_000  # the vectors alone have 150,000
    assert out.where(F.size("similar_tickets") == 3).count() == 600
