"""Quality of documents by ordinal cumulative-link regression on graded ratings.

A document's words and a few traits of its shape are hashed to weights; their sum is one score ``s`` shared by all grades,
and ordered thresholds cut it: P(grade >= k) = sigmoid(s - threshold_k). Expected grade and tail probabilities follow.

The model is fitted on at most ``SAMPLE`` rated documents, those with the smallest hashes of their id, so the features that reach the
driver are bounded. Every document is scored, in one pass without a shuffle; the weights are those of hashes that occur in
``LEAST`` rated documents, which is bounded by the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

SAMPLE, LEAST, SPACE, GRADES = 12_000, 5, 1 << 32, 3
TELLING = 60  # a hash counts if its chi-square is at least one per so many rated documents, and never under 30
ROUNDS, RATE, RIDGE = 150, 0.05, 3e-5
KEEP_AT = 0.4  # a document stays if it is of the highest grade with this probability: rather keep than lose a good one
WORD, UPPER, SIGN = re.compile(r"\w+"), re.compile("[A-Z\u00c0-\u00de]"), re.compile(r"[^\w\s.,;:'\"()-]")


def traits(text: str) -> list[str]:
    """Names of what a text looks like, in steps: they are hashed like words."""
    n = max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    words = text.split()
    steps = {"upper": len(UPPER.findall(text)) / n, "bang": text.count("!") * 5 / n, "bar": text.count("|") * 5 / n,
             "sign": 2 * len(SIGN.findall(text)) / n,
             "digit": len(re.findall("[0-9]", text)) / n, "same line": 1 - len(set(lines)) / max(1, len(lines)),
             "same word": 1 - len(set(words)) / max(1, len(words)), "stop": text.count(".") * 5 / n, "ascii": len(text.encode()) / n - 1}
    size = f"\0words {min(12, len(words).bit_length())}"
    return [size, *[f"\0{name} {min(10, int(share * 20))}" for name, share in steps.items()]]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the words (lower case) and traits of a text; null is empty."""
    text = text or ""
    names = set(WORD.findall(text.lower()))
    names.update(traits(text))
    return np.unique(np.array([xxhash.xxh64_intdigest(w) % SPACE for w in names], np.uint32))


@dataclass
class Model:
    """Sorted hashes with their weights, and the thresholds between grades."""
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, -1.0))

    def score(self, found: np.ndarray) -> float:
        if not len(self.keys):
            return 0.0
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return float(self.weights[at][self.keys[at] == found].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1, 2, ... in columns."""
        return sigmoid(np.asarray(scores)[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def association(rows, columns, counts, grades, n_grades: int) -> np.ndarray:
    """Chi-square of each hash with the grades: hashes that say nothing about them get no weight."""
    share, n = np.bincount(grades, minlength=n_grades) / len(grades), len(grades)
    total = np.zeros(len(counts))
    for g in range(n_grades):
        if 0 < share[g] < 1:
            seen = np.bincount(columns, grades[rows] == g, len(counts))
            total += (seen - counts * share[g]) ** 2 / (counts * share[g])
    return total * n / np.maximum(n - counts, 1)


def fit(samples: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with a ridge, all grades weighing alike; deterministic. Without rated documents, or with one
    grade only, no weight is learned, and every grade from the lowest seen on is expected."""
    grades = np.asarray(grades, int)
    seen = np.unique(grades)
    if len(seen) < 2:
        low = seen[0] if len(seen) else n_grades - 1
        return Model(thresholds=np.where(np.arange(1, n_grades) <= low, -5.0, 5.0))
    flat = np.concatenate(samples) if samples else np.zeros(0, np.uint32)
    keys, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
    chosen = (counts >= LEAST) & (association(rows, inverse, counts, grades, n_grades) >= max(30, len(grades) / TELLING))
    used = chosen[inverse]
    keys, columns = keys[chosen], (np.cumsum(chosen) - 1)[inverse][used]
    rows, d, k = rows[used], len(keys), n_grades - 1
    weight = 1 / np.bincount(grades, minlength=n_grades)[grades] / len(seen)
    # parameters: weights, first threshold, logs of the steps to the next ones (so they stay ordered)
    params = np.zeros(d + k)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        gaps = np.exp(params[d + 1:])
        cuts = params[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(rows, params[columns], len(samples))
        below = np.column_stack([np.zeros(len(s)), sigmoid(cuts[None, :] - s[:, None]), np.ones(len(s))])  # P(grade < k)
        lo, hi = below[np.arange(len(s)), grades], below[np.arange(len(s)), grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        dlo, dhi = lo * (1 - lo) / p, hi * (1 - hi) / p
        grad = np.zeros_like(params)
        grad[:d] = np.bincount(columns, (weight * (dhi - dlo))[rows], d) + RIDGE * params[:d]
        by_cut = np.zeros(k)
        for c in range(k):
            by_cut[c] = (weight * (dlo * (grades == c + 1) - dhi * (grades == c))).sum()
        grad[d] = by_cut.sum()
        for c in range(1, k):
            grad[d + c] = by_cut[c:].sum() * gaps[c - 1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad ** 2
        params -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return Model(keys, params[:d], params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1:]))]))


def rated(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 for toxic documents, 1 for others of low quality, 2 for good ones. Where a rating is null, it is
    taken as harmless and good; rows without any rating, or without doc_id, are left out; of several ratings, the lowest counts."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.coalesce("quality", F.lit(1)) > 0, 2).otherwise(1)
    return (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade")))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rated documents (the documented bound of everything that reaches the driver)."""
    chosen = rated(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def hashed(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"],
                                "found": [features(t).tobytes() for t in pdf["text"]]})
    few = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .join(F.broadcast(chosen), "doc_id").mapInPandas(hashed, "doc_id long, grade int, found binary"))
    rows = sorted((r["doc_id"], r["grade"], bytes(r["found"])) for r in few.collect())
    return fit([np.frombuffer(r[2], np.uint32) for r in rows], np.array([r[1] for r in rows], int))


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to 2) and ``p_at_least_1``, ``p_at_least_2``, in one pass. Null text is empty; rows that repeat
    get equal grades; columns of these names are replaced."""
    names = ["expected_grade", *[f"p_at_least_{k + 1}" for k in range(len(model.thresholds))]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def judged(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        tails = m.tails(np.array([m.score(features(t)) for t in texts]))
        return pd.DataFrame(np.column_stack([tails.sum(1), tails]), columns=names)
    plain = docs.drop(*names)
    return (plain.withColumn("_judged", judged(F.col("text").cast("string")))
            .select(*plain.columns, *[F.col(f"_judged.{n}").alias(n) for n in names]))


def good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Rows of ``docs`` that are of the highest grade with probability ``keep_at`` or more; all columns, unchanged."""
    out = graded(docs, train(docs, labels))
    return out.where(F.col(f"p_at_least_{GRADES - 1}") >= keep_at).select(*docs.columns)


@query("op3_ordinal_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probabilities, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = graded(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return out.withColumn("kept", F.col(f"p_at_least_{GRADES - 1}") >= KEEP_AT)
