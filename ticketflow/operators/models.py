"""Model surface: pluggable functions, and Spark ML where a trained model is needed."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..constants import EMBED_DIM, FEATURES
from ..functions.features import fill_features
from ..functions.prompts import ANSWER_SYSTEM, CLASSIFY_SYSTEM, classify_prompt, faithfulness_prompt, relevance_prompt
from ..functions.replies import cascade, parse_judgement, uncertain, validate_reply
from ..functions.rules import risk_bucket
from ..functions.text import not_blank
from .boosting import Boosted, Settings, boost

Batch = Callable[[list[str]], list[str]]
EMBED_BATCH = 128
CALL_ROWS = 64  # prompts per call
CALL = "struct<raw:string,failure:string,latency_ms:double>"


def _replies(fn: Batch, texts: list[str]) -> list[tuple]:
    """Replies of one call. A call that fails is repeated on its halves, so failures stay per row."""
    try:
        replies = list(fn(texts))
        if len(replies) != len(texts):
            raise ValueError("one reply per prompt expected")
        return [(reply, None) for reply in replies]
    except Exception as error:
        if len(texts) == 1:
            return [(None, str(error))]
        half = len(texts) // 2
        return _replies(fn, texts[:half]) + _replies(fn, texts[half:])


def _answer(fn: Batch, texts: list[str]) -> list[tuple]:
    start = time.perf_counter()
    replies = _replies(fn, texts)
    ms = (time.perf_counter() - start) * 1000 / max(1, len(texts))
    return [(reply, failure, round(ms, 1)) for reply, failure in replies]


def with_system(fn: Batch, system: str | None) -> Batch:
    """A hook that takes a second argument is given the system prompt."""
    try:
        two = len(inspect.signature(fn).parameters) > 1
    except (TypeError, ValueError):
        two = False
    return (lambda texts: fn(texts, system)) if two and system is not None else fn


def call_model(fn: Batch, prompt: Column, wanted: Column | None = None, system: str | None = None) -> Column:
    """Replies to a column of prompts, ``CALL_ROWS`` per call at most; prompts that are not wanted are not even sent to Python.

    Marked non-deterministic, so that Spark neither repeats nor reorders a call.
    """
    hook = with_system(fn, system)

    @F.pandas_udf(CALL)
    def ask(prompts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, 0.0)] * len(prompts)
        chosen = [i for i, text in enumerate(prompts) if text is not None]
        for at in range(0, len(chosen), CALL_ROWS):
            some = chosen[at:at + CALL_ROWS]
            for i, answer in zip(some, _answer(hook, [prompts.iloc[i] for i in some])):
                rows[i] = answer
        return pd.DataFrame(rows, columns=["raw", "failure", "latency_ms"])

    asked = F.coalesce(prompt, F.lit(""))
    return ask.asNondeterministic()(asked if wanted is None else F.when(wanted, asked))


def classify(df: DataFrame, primary: Batch, fallback: Batch | None = None, primary_model: str = "primary",
             fallback_model: str = "fallback") -> DataFrame:
    """Add ``reply`` and ``classify_ms``. The fallback sees only rows the primary is unsure of."""
    def judged(out: DataFrame, call: str, reply: str) -> DataFrame:
        raw = out.withColumn(f"__{reply}", F.col(f"{call}.raw"))
        checked = validate_reply(raw, f"__{reply}", reply).drop(f"__{reply}")
        return checked.withColumn(reply, F.col(reply).withField(
            "error", F.coalesce(F.col(f"{call}.failure"), F.col(f"{reply}.error"))))

    out = df.withColumn("__call_p", call_model(
        primary, classify_prompt(F.col("subject"), F.col("body")), system=CLASSIFY_SYSTEM))
    out = judged(out, "__call_p", "__primary")
    if fallback is None:
        reply = F.col("__primary").withField("model", F.lit(primary_model)).withField("escalated", F.lit(False))
        return (out.withColumn("reply", reply).withColumn("classify_ms", F.col("__call_p.latency_ms"))
                .drop("__call_p", "__primary"))
    out = out.withColumn("__call_f", call_model(fallback, classify_prompt(F.col("subject"), F.col("body")),
                                           uncertain(F.col("__primary")), CLASSIFY_SYSTEM))
    out = judged(out, "__call_f", "__fallback")
    out = cascade(out, "__primary", "__fallback", "reply", primary_model, fallback_model)
    return (out.withColumn("classify_ms", F.col("__call_p.latency_ms") + F.col("__call_f.latency_ms"))
            .drop("__call_p", "__call_f", "__primary", "__fallback"))


def generate(df: DataFrame, fn: Batch, prompt: str = "prompt", out: str = "response", wanted: Column | None = None) -> DataFrame:
    """Answers to prompts; a failure is kept as text, and rows that are not wanted have none."""
    called = df.withColumn("__c", call_model(fn, F.col(prompt), wanted, ANSWER_SYSTEM))
    text = F.when(F.col("__c.failure").isNotNull(),
                  F.concat(F.lit("[Generation failed: "), F.col("__c.failure"), F.lit("]"))).otherwise(F.col("__c.raw"))
    return called.withColumn(out, text).withColumn("generate_ms", F.col("__c.latency_ms")).drop("__c")


def grade(df: DataFrame, judge: Batch) -> DataFrame:
    """Faithfulness and relevance of ``answer`` to ``question`` given ``context``."""
    calls = {
        "faithfulness": faithfulness_prompt(F.col("question"), F.col("context"), F.col("answer")),
        "relevance": relevance_prompt(F.col("question"), F.col("answer")),
    }
    out = df
    for name, prompt in calls.items():
        out = out.withColumn(f"__{name}", call_model(judge, prompt))
        out = out.withColumn(name, parse_judgement(F.col(f"__{name}.raw")))
        failure = F.col(f"__{name}.failure")
        out = out.withColumn(name, F.col(name).withField("reason", F.when(
            failure.isNotNull(), F.concat(F.lit("Eval failed: "), failure)).otherwise(F.col(f"{name}.reason"))))
    return out.drop(*[f"__{name}" for name in calls])


def grade_summary(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count(F.lit(1)).alias("n"), F.avg("faithfulness.score").alias("faithfulness"),
                      F.avg("relevance.score").alias("relevance"))


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]] | None = None,
          dim: int = EMBED_DIM, out: str = "embedding") -> DataFrame:
    """Add a vector per text. Blank texts and failed calls get a zero vector.

    Without ``fn`` a hashed bag of words stands in, computed by Spark itself.
    """
    if fn is None:
        tokens = RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=r"\W+")
        hashed = HashingTF(inputCol="__tokens", outputCol="__counts", numFeatures=dim)
        unit = Normalizer(inputCol="__counts", outputCol="__unit")
        made = unit.transform(hashed.transform(tokens.transform(
            df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))))))
        return (made.withColumn(out, vector_to_array("__unit", "float32"))
                .drop("__text", "__tokens", "__counts", "__unit"))
    zero = [0.0] * dim

    def vectors(texts: list[str]) -> list[list[float]]:
        try:
            return [list(v) if v is not None and len(v) else zero for v in fn(texts)]
        except Exception:
            if len(texts) == 1:
                return [zero]
            return [vectors([t])[0] for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [zero] * len(pdf)
            full = [i for i, t in enumerate(pdf[text]) if t is not None and str(t).strip()]
            for start in range(0, len(full), EMBED_BATCH):
                part = full[start:start + EMBED_BATCH]
                for i, v in zip(part, vectors([pdf[text].iloc[i] for i in part])):
                    made[i] = v
            yield pdf.assign(**{out: made})

    return df.mapInPandas(run, StructType([*df.schema, StructField(out, ArrayType(FloatType()))]))


def train_sla(train: DataFrame, val: DataFrame, label: str = "label", trees: int = 500, patience: int = 50, seed: int = 42,
              **more) -> Boosted:
    """Boosted trees on the 17 features, weighted for rare positives; training ends after ``patience`` rounds without a smaller
    loss on ``val``, and the trees of the best round are kept. ``more`` goes to ``boost``."""
    return boost(_with_features(train), _with_features(val), list(FEATURES), label,
                 Settings(trees=trees, patience=patience, seed=seed), **more)


def _with_features(df: DataFrame) -> DataFrame:
    filled = fill_features(df)
    return filled.withColumns({c: F.lit(0) for c in FEATURES if c not in filled.columns})


def score_sla(df: DataFrame, model: Boosted) -> DataFrame:
    """Add the risk score, breach flag and level. A feature the table lacks counts as 0."""
    scored = _with_features(df).withColumn("probability_breach", model.probability())
    return scored.select(*df.columns, "probability_breach", *risk_bucket(F.col("probability_breach")))


def importances(spark: SparkSession, model: Boosted) -> DataFrame:
    """Feature importance, largest first: one row per feature with the number of splits that use it, and their share."""
    used = model.splits()
    total = max(1, sum(used.values()))
    return (spark.createDataFrame([(f, n, n / total) for f, n in used.items()], "feature string, splits long, importance double")
            .orderBy(F.desc("importance"), "feature"))


def training_rounds(spark: SparkSession, model: Boosted) -> DataFrame:
    """``(round, loss, kept)``: the validation loss with so many trees, from none on, and whether the model has them."""
    return spark.createDataFrame([(r, loss, r <= len(model.trees)) for r, loss in enumerate(model.losses)],
                                 "round int, loss double, kept boolean")


def save_model(model: Boosted, path: str) -> None:
    model.nodes(SparkSession.active()).write.mode("overwrite").parquet(path)


def load_model(path: str) -> Boosted:
    return Boosted.restored(SparkSession.active().read.parquet(path), list(FEATURES))


def train_text_classifier(df: DataFrame, text: str, label: str, buckets: int = 1 << 12) -> PipelineModel:
    """Stand-in classifier for use without a model service."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"\W+"),
        HashingTF(inputCol="__tokens", outputCol="__features", numFeatures=buckets),
        LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability",
                           predictionCol="__prediction", rawPredictionCol="__raw", maxIter=10, regParam=0.01),
    ]).fit(df.where(not_blank(F.col(text))))


def classifier_replies(df: DataFrame, model: PipelineModel, out: str, priority: Column, team: Column) -> DataFrame:
    """The stand-in's predictions, as JSON replies like those of a model service."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    stages = PipelineModel(model.stages[1:])
    scored = stages.transform(df)
    reply = F.to_json(F.struct(
        F.get(labels, F.col("__prediction").cast("int")).alias("category"), priority.alias("priority"),
        team.alias("routing_team"),
        F.round(F.array_max(vector_to_array("__probability")), 4).alias("confidence")))
    return scored.select(*df.columns, reply.alias(out))
