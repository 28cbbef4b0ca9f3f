"""Personal data: patterns, and terms that give a protected entity away.

Addresses, cards and phone numbers are found by pattern. How strongly a term reveals an entity is measured over the
whole corpus: with p(x) the share of documents that hold x, a term t somewhere in a document with an entity c discloses

    PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c)

of it: 1 if c is there whenever t is, 0 if they are independent. Terms that disclose ``generalise`` or more become
``[TERM]``, those that disclose ``remove`` or more are removed. A pair counts only if seen in ``support`` different
surroundings of the entity, so neither a term that occurs once nor copies of one text prove anything. When the disclosing terms are
known, a further pass finds them in all texts, whether the entity is there or not.

Occurrences are narrow rows; texts are not shuffled to find them. All counts are aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match always begins where a run of digits does, so later digits of the run need no attempt
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]+")  # short names and identifiers, too; common ones are turned down by their frequency
REACH, SUPPORT, GENERALISE, REMOVE = 120, 3, 0.85, 0.95
FLUSH = 200_000  # distinct terms counted in a task before they are handed on
SIEVE = 22  # bits of a term's hash that the sieve looks at


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, sorted; ``kind`` is an index into ``KINDS``."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                  if all(len(p) < 4 and int(p or 0) < 256 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                      if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> int:
    """A protected value as a signed 64-bit hash: spelling variants are one entity, and no value is shuffled."""
    plain = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - (1 << 63)


def term(word: str) -> int:
    return xxhash.xxh64_intdigest(word.lower()) - (1 << 63)


def places(text: str, spans: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int]]:
    """``(entity, surroundings)`` of the spans, each pair once; surroundings are what lies within ``reach`` characters."""
    return list(dict.fromkeys((entity(kind, text[start:end]), xxhash.xxh64_intdigest(text[max(0, start - reach):end + reach]) - (1 << 63))
                              for start, kind, end in spans))


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words of ``text`` that touch none of the sorted ``spans``."""
    at, done = 0, 0  # the next span, and the furthest end of those before it
    for m in TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            done = max(done, spans[at][2])
            at += 1
        if m.start() >= done:
            yield m


def surroundings(text: str, spans: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int, int, int]]:
    """``(entity, surroundings, term, start, end)`` of each word of ``text`` in no span, with each entity of ``text``."""
    words = [(term(m[0]), *m.span()) for m in outside(text, spans)]
    return [(*place, *word) for place in places(text, spans, reach) for word in words]


def found_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``_row``, ``doc_id``, ``base`` (array of start, kind, end), ``key`` (hash of doc_id and text), ``near`` (entities with their
    surroundings) and, if there are any, ``words`` (the terms of the text, each once) of each row, written out."""
    def run(batches):
        for pdf in batches:
            base = [base_spans(t or "") for t in pdf["text"]]
            near = [places(t, s, reach) if s else [] for t, s in zip(pdf["text"], base)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": keys(pdf),
                                "base": [[{"a": a, "kind": k, "b": b} for a, k, b in s] for s in base],
                                "near": [[{"c": c, "place": p} for c, p in n] for n in near],
                                "words": [[term(w) for w in lowered(t)] if n else [] for t, n in zip(pdf["text"], near)]})
    found = numbered(docs).mapInPandas(run, "doc_id long, key long, base array<struct<a: long, kind: int, b: long>>, "
                                            "near array<struct<c: long, place: long>>, words array<long>")
    return cut(found.withColumn("_row", F.monotonically_increasing_id()))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("doc_id").cast("string").alias("name"))


def keys(pdf: pd.DataFrame) -> np.ndarray:
    """A hash of id and text: rows are known again by it in a later pass, and rows that have both in common have the same spans."""
    return np.array([xxhash.xxh64_intdigest(f"{i}:{t or ''}") for i, t in zip(pdf["name"], pdf["text"])], np.uint64).view(np.int64)


def lowered(text: str) -> set[str]:
    return {w.lower() for w in TERM.findall(text)}


class Sieve:
    """Says of a word whether it may be one of the ``t`` of a table; never denies one that is. Half a megabyte at any size of the table."""

    def __init__(self, terms: DataFrame):
        table = np.zeros(1 << (SIEVE - 6), np.int64)
        bits = (terms.select((F.col("t").bitwiseAND(F.lit((1 << SIEVE) - 1))).alias("x")).groupBy(F.expr("shiftright(x, 6)").alias("i"))
                .agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int)))").alias("bits")))
        for r in bits.collect():  # 65,536 rows at any size
            table[r["i"]] = r["bits"]
        self.table, self.known = table.astype("<i8").tobytes(), {}

    def term(self, word: str) -> int | None:
        """The term of a word in lower case, or None if it is none of the table for certain."""
        if word not in self.known:
            if len(self.known) > FLUSH:
                self.known.clear()
            t = term(word)
            x = t & ((1 << SIEVE) - 1)
            self.known[word] = t if self.table[x >> 3] >> (x & 7) & 1 else None
        return self.known[word]


def document_frequencies(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """``(t, n)``: in how many rows of ``docs`` each term that passes the sieve occurs."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pd.DataFrame({"t": np.fromiter(counts, np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})
            counts.clear()
            return out
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(t for w in lowered(text or "") if (t := sieve.term(w)) is not None)
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()
    return docs.select(F.col("text").cast("string")).mapInPandas(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """``(c, t, ratio)`` of the pairs that disclose ``least`` or more. An entity with fewer than ``support`` surroundings has no such
    pair, so its words are not counted."""
    total = found.count()
    near = found.where(F.size("near") > 0).select("_row", "words", F.explode("near").alias("x")).select("_row", "words", "x.c", "x.place")
    seen = near.select("c", "place").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("seen"))
    rows = near.select("_row", "c").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))
    entities = cut(seen.where(F.col("seen") >= support).join(rows, "c").where(F.col("n_c") < total).select("c", "n_c"))
    near = near.join(entities.select("c"), "c")
    supported = (near.select("c", "place", F.explode("words").alias("t")).distinct().groupBy("c", "t").agg(F.count(F.lit(1)).alias("places"))
                 .where(F.col("places") >= support))
    together = (near.dropDuplicates(["_row", "c"]).select("c", F.explode("words").alias("t")).groupBy("c", "t")
                .agg(F.count(F.lit(1)).alias("both")))
    known = cut(supported.join(together, ["c", "t"]).join(entities, "c"))
    ratio = (F.log(F.col("both") * F.lit(float(total)) / (F.col("n_c") * F.col("n"))) / F.log(F.lit(float(total)) / F.col("n_c")))
    return (known.join(document_frequencies(docs, Sieve(known)), "t")
            .select("c", "t", ratio.alias("ratio")).where(F.col("ratio") >= least))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(key, terms)``: where the words of ``terms`` (``t``, ``ratio``) stand in the texts, in no span of a pattern."""
    sieve = Sieve(terms)

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(keys(pdf), pdf["text"]):
                if text and any(sieve.term(w) is not None for w in lowered(text)):
                    rows += [(key, t, *m.span()) for m in outside(text, base_spans(text)) if (t := sieve.term(m[0].lower())) is not None]
            yield pd.DataFrame(rows, columns=["key", "t", "a", "b"])
    met = numbered(docs).mapInPandas(run, "key long, t long, a long, b long").join(terms, "t")
    return (met.groupBy("key", "a", "b").agg(F.max("ratio").alias("ratio"))
            .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b", "ratio"))).alias("terms")))  # within one text


def private_spans(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``(_row, doc_id, base, terms)``, one row per row of ``docs``: spans found by pattern, and disclosing words
    as (start, end, ratio), sorted; offsets are code points.

    A word that discloses some entity is found wherever it stands, in texts without the entity, too. Null text counts as
    empty. Rows with the same doc_id are searched one by one; copies count as documents, but not as further support.
    Entities that are in every document are disclosed by nothing. An empty table gives no rows.
    """
    found = found_spans(docs, reach)
    revealing = cut(disclosures(docs, found, support, generalise).groupBy("t").agg(F.max("ratio").alias("ratio")))
    empty = F.array().cast("array<struct<a: long, b: long, ratio: double>>")
    out = found.drop("near", "words")
    if revealing.isEmpty():
        return out.drop("key").withColumn("terms", empty)
    return out.join(occurrences(docs, revealing), "key", "left").drop("key").withColumn("terms", F.coalesce("terms", empty))


def sanitise(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """``docs`` with personal data generalised to ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` and disclosing terms
    generalised to ``[TERM]`` or removed; overlapping spans become the first one's label. All columns stay; ``n_chars``, where there is
    one, is the new length. Null text stays null."""
    columns = docs.columns
    mark = F.xxhash64(F.col("text").cast("string"))  # spans follow from the text alone, so a hash of it is enough to bring them back
    keyed = docs.select(mark.alias("doc_id"), "text")
    spans = private_spans(keyed, **options).where("size(base) + size(terms) > 0").dropDuplicates(["doc_id"]).select(
        F.col("doc_id").alias("_sanitise_row"), F.col("base").alias("_sanitise_base"), F.col("terms").alias("_sanitise_terms"))

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, own, more in zip(texts, base, terms):
            if text is None or own is None:
                out.append(text)
                continue
            spans = sorted([(s["a"], s["b"], f"[{KINDS[s['kind']].upper()}]") for s in own]
                           + [(s["a"], s["b"], "" if s["ratio"] >= remove else "[TERM]") for s in more])
            parts, at = [], 0
            for a, b, label in spans:
                if a >= at:
                    parts += [text[at:a], label]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, mark == F.col("_sanitise_row"), "left").withColumn("text", rewritten("text", "_sanitise_base", "_sanitise_terms"))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*columns)


@query("op7_private_terms")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans; disclosing words have kind ``term`` and stand behind the base kinds."""
    def digests(batches):
        for pdf in batches:
            rows = []
            for base, terms in zip(pdf["base"], pdf["terms"]):
                own = [(s["a"], s["kind"], s["b"]) for s in base]
                every = sorted(own + [(s["a"], len(KINDS), s["b"]) for s in terms])
                named = [",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in spans) for spans in (own, every)]
                kinds = Counter(k for _, k, _ in own)
                rows.append((*[kinds[k] for k in range(len(KINDS))], hashlib.sha256(named[0].encode()).hexdigest(), named[1]))
            out = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), out], axis=1)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return private_spans(table(spark, sf_dir, "documents")).select("doc_id", "base", "terms").mapInPandas(digests, schema)
