"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Terms are the distinct runs of five words (fewer words: the whole text), weighted by how often they occur. For each term
``s`` and each of ``SAMPLES`` places ``k``, hashes of ``(s, k)`` give r, c ~ Gamma(2, 1) and b ~ U(0, 1), the same ones in all
documents. With weight ``w``,

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1)

and the sample of place ``k`` is the ``(s, t)`` with the smallest ``a``. Two documents agree in a place with a probability
equal to their generalised Jaccard similarity, sum of min(weights) by sum of max(weights).

``r b`` and ``r (1 - b)`` are two independent exponential numbers, so they are drawn instead: ``-ln u1`` and ``-ln u2``. Then
``a = c u2 exp(-r t)``, and most terms, which occur once, have ``t = 0`` and need neither ``r`` nor ``u1``.

A place is kept as one long, ``1 / a`` in the upper half and 32 bits that name ``(s, t)`` in the lower one, so a plain maximum, taken
in the task before the shuffle, is the sample. Only fingerprints are shuffled, not terms. With 32 places the likeness of a pair has
a standard error of 0.07 at 0.8 and 0.09 at 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import row_index
from .common import cut, give_back, table
from .registry import query

SAMPLES, WORDS = 32, 5
BLANKS = " \t\n\u000b\f\r"
LOW, BITS21 = (1 << 32) - 1, (1 << 21) - 1


def terms(content: DataFrame, text: str = "content", words: int = WORDS) -> DataFrame:
    """``content`` without ``text``, once for each distinct term ``_s`` (a hash) of the text, with its count ``_w``."""
    keys = [c for c in content.columns if c != text]
    n = F.size("_h")
    first = F.array(F.expr("aggregate(_h, 42L, (x, y) -> xxhash64(x, y))"))
    runs = F.transform(F.sequence(F.lit(1), n - (words - 1)),
                       lambda i: F.xxhash64(*[F.element_at("_h", i + j) for j in range(words)]))
    hashed = content.select(*keys, F.transform(
        F.split(F.lower(F.btrim(F.col(text), F.lit(BLANKS))), "[ \\t\\n\\x0b\\f\\r]+"), lambda w: F.xxhash64(w)).alias("_h"))
    ordered = hashed.select(*keys, F.sort_array(F.when(n < words, first).otherwise(runs)).alias("_o"))
    starts = ordered.select(*keys, "_o", F.filter(
        F.sequence(F.lit(1), F.size("_o")),
        lambda i: (i == 1) | (F.element_at("_o", i) != F.element_at("_o", F.greatest(i - 1, F.lit(1))))).alias("_at"))
    each = starts.select(*keys, "_o", "_at", F.explode(F.sequence(F.lit(1), F.size("_at"))).alias("_i"))
    end = F.when(F.col("_i") < F.size("_at"), F.element_at("_at", F.least(F.col("_i") + 1, F.size("_at")))).otherwise(F.size("_o") + 1)
    start = F.element_at("_at", F.col("_i"))
    return each.select(*keys, F.element_at("_o", start).alias("_s"), (end - start).alias("_w"))


def sample(k: int, term: Column, weight: Column, name: Column) -> Column:
    """The place ``k`` of one term: the larger, the better; see above. ``name`` is that of ``(term, 0)``."""
    def uniform(bits: Column, at: int) -> Column:
        return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(BITS21)) + F.lit(0.5)) * F.lit(1.0 / (BITS21 + 1))
    def hashed(n: int) -> Column:  # term is a hash itself, so one round over it and a number made of n is enough
        spread = n * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return F.xxhash64(term.bitwiseXOR(F.lit(spread - (1 << 64) if spread >> 63 else spread).cast("long")))
    one = hashed(2 * k + 1)
    two = uniform(one, 42)
    first = two * -F.ln(uniform(one, 0) * uniform(one, 21))
    more = -F.ln(uniform(hashed(2 * k + 2), 0))
    r = more - F.ln(two)
    t = F.floor((F.ln(weight) + more) / r)
    single = weight == 1
    a = F.when(single, first).otherwise(first * F.exp(-r * t))
    height = F.least(F.lit((1 << 31) - 1).cast("long"), F.floor(F.lit(1024.0) / a))
    return F.shiftleft(height, 32).bitwiseOR(F.when(single, name).otherwise(F.xxhash64(term, t)).bitwiseAND(F.lit(LOW)))


def fingerprints(content: DataFrame, text: str = "content", samples: int = SAMPLES) -> DataFrame:
    """One row per distinct value of the other columns: these, and ``fingerprint``, eight hex digits per place.

    The text must not be null; an empty one has one empty term. Other columns are the key.
    """
    keys = [c for c in content.columns if c != text]
    each = terms(content, text)
    each = each.withColumn("_name", F.xxhash64("_s", F.lit(0).cast("long")))
    low = each.groupBy(*keys).agg(*[F.max(sample(k, F.col("_s"), F.col("_w"), F.col("_name"))).alias(f"_{k}") for k in range(samples)])
    digits = [F.lpad(F.lower(F.hex(F.col(f"_{k}").bitwiseAND(F.lit(LOW)))), 8, "0") for k in range(samples)]
    return low.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(one: str | Column, two: str | Column, samples: int = SAMPLES) -> Column:
    """Share of places in which two fingerprints agree: an estimate of the generalised Jaccard similarity."""
    one, two = (F.col(c) if isinstance(c, str) else c for c in (one, two))
    same = [F.when(F.substring(one, 8 * k + 1, 8) == F.substring(two, 8 * k + 1, 8), 1).otherwise(0) for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as ``(id, h, text)``, and for each distinct document its successor: ``(id, h, n, next_id, next_h)``.

    ``h`` hashes the text, so rows that share an id but differ in text are documents of their own. The order falls by id, nulls
    first; the last one's successor is the first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text")).select(
        "id", F.xxhash64("text").alias("h"), "text")
    narrow = base.select("id", "h", F.length("text").cast("long").alias("n"))
    ids = row_index(narrow.groupBy("id", "h").agg(F.max("n").alias("n")), ["id", "h"], "r")
    ids = cut(ids)
    total = ids.count()
    after = ids.select(F.col("r").alias("next_r"), F.col("id").alias("next_id"), F.col("h").alias("next_h"))
    follows = ids.withColumn("next_r", F.when(F.col("r") == 0, total - 1).otherwise(F.col("r") - 1))
    return base, cut(follows.join(after, "next_r").select("id", "h", "n", "next_id", "next_h"))


def edited_texts(base: DataFrame, follows: DataFrame) -> DataFrame:
    """``(id, h, n, text, edited)``: the last third of each text replaced by the beginning of the next document.

    Both joins shuffle ``base`` by the same columns and with the same ones, so Spark does it once.
    """
    wanted = follows.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("n").alias("_n"), "next_id", "next_h")
    heads = (base.join(wanted, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("h") == F.col("next_h")))
             .select("_id", "_h", F.substring("text", F.lit(1), F.expr("cast(_n div 3 as int)")).alias("_head"))
             .groupBy("_id", "_h").agg(F.max("_head").alias("_head")))  # repeated rows give the same
    joined = base.join(heads, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    n = F.length("text")
    kept = F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int"))
    return joined.select("id", "h", n.cast("long").alias("n"), "text", F.concat(kept, F.col("_head")).alias("edited"))


@query("op4_weighted_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. Rows equal in doc_id and text give one row; null text is empty."""
    base, follows = with_next(table(spark, sf_dir, "documents"))
    texts = edited_texts(base, follows)
    versions = texts.select("id", "h", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("content"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("content"), F.sha2("edited", 256).alias("sha")))).alias("v")).select(
            "id", "h", "n", "v.version", "v.sha", "v.content")
    prints = cut(fingerprints(versions))
    give_back(spark)  # the texts' shuffles, before fingerprints are joined
    own = prints.where("version = 0").select("id", "h", F.col("n").alias("n_chars"), "fingerprint")
    edited = prints.where("version = 1").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("sha").alias("edited_sha256"),
                                                F.col("fingerprint").alias("edited_fingerprint"))
    succeeding = own.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("fingerprint").alias("_next"))
    steps = follows.select(F.col("id").alias("_of"), F.col("h").alias("_of_h"), F.col("next_id").alias("_to"), F.col("next_h").alias("_to_h"))
    out = own.join(edited, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    out = out.join(steps, F.col("id").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_of_h")))
    out = out.join(succeeding, F.col("_to").eqNullSafe(F.col("next_id")) & (F.col("_to_h") == F.col("next_h")))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                      likeness("fingerprint", "_next").alias("near_next"))
