"""Near copies by likeness: documents that share ``LIKE`` or more of their distinct runs of ``WORDS`` words.

Documents with the same set of runs are one class. Each class has ``BANDS`` keys, each made of ``ROWS`` min-wise samples of its
set, so two classes of likeness s miss each other with (1 - s^ROWS)^BANDS: 3 in 100,000 at 0.8. Classes that meet under a key
are candidates and are compared exactly, by their sets. Under each key one class leads, and the others are compared with
it. Where a key still holds several groups, all its classes are compared with each other, in blocks, but for those that are in one group already
and those that share none of their rarest runs. So there are two rounds at any size, and no link under a key is lost. Groups of
operator 8 are known before the first round, so components are sought once for both, and again only if the second round links any.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, forget, give_back, put

WORDS, LIKE = 5, (4, 5)  # likeness 4/5, compared in whole numbers
BANDS, ROWS, SEED, CHUNK = 20, 4, 42, 1 << 12
BLOCK = 1 << 10  # classes of a key that are compared at once
COUNTED = 1 << 20  # runs looked up at once
_factors, _shifts = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_factors |= np.uint64(1)


def runs(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of all runs of ``words`` words; a shorter text is one run, one without words has none."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # as in simhash.fingerprint
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64))


def keys(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of runs; none of an empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, ((found[at:at + CHUNK, None] ^ _shifts) * _factors).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def classes_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, cls, n, keys)`` of each row of ``doc_id, h, text``: the class as a hash of its set, the size of the set, and its keys."""
    def run(batches):
        for pdf in batches:
            sets = [runs(t) for t in pdf["text"]]
            yield pdf[["doc_id", "h"]].astype({"doc_id": "Int64"}).assign(
                cls=np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
                n=[len(s) for s in sets], keys=[keys(s) for s in sets])
    return docs.mapInPandas(run, "doc_id long, h long, cls long, n int, keys array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """``(cls, runs)`` of rows with ``cls`` and ``text``; 32 bits of each run's hash, so that two of a text's 10,000 runs
    fall together in one text of a hundred."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"cls": pdf["cls"], "runs": [np.unique(runs(t).astype(np.uint32)).view(np.int32) for t in pdf["text"]]})
    return docs.select("cls", "text").mapInPandas(run, "cls long, runs array<int>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) that share ``LIKE`` or more of what either has."""
    both = pairs.join(sets.toDF("b", "right"), "b").join(sets.toDF("a", "left"), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("i"), (F.size("left") + F.size("right")).alias("n"))
    return shared.where(LIKE[1] * F.col("i") >= LIKE[0] * (F.col("n") - F.col("i"))).select("a", "b")


def linked(cls: np.ndarray, group: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of likeness ``LIKE`` that join rows of one ``group`` to those of another one, as few as connect all that are alike. Where ``side``
    has two values, only rows of different sides are compared.

    Sets that alike share nearly all they have share one of the rarest runs of either, a fifth of them; only such pairs are counted out.
    """
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    starts, owner = ends - n, np.repeat(np.arange(len(n)), n)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_rarity = np.argsort(often, kind="stable")
    rank = np.empty(len(often), np.int64)
    rank[by_rarity] = np.arange(len(often))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    rare = np.arange(len(token)) - starts[owner] <= (n - (LIKE[0] * n + LIKE[1] - 1) // LIKE[1])[owner]
    rare &= often[by_rarity][token] > 1
    at, have = token[rare], owner[rare]
    own = np.searchsorted(have, np.arange(len(n) + 1))  # the rare runs of each row
    order = np.argsort(at, kind="stable")
    having, bounds = have[order], np.searchsorted(at[order], np.arange(len(often) + 1))
    _, group = np.unique(group, return_inverse=True)
    out, mark, one_side = [], np.zeros(len(often), bool), side.min() == side.max()
    for i in range(len(n)):
        met = [having[bounds[t]:bounds[t + 1]] for t in at[own[i]:own[i + 1]]]
        if not met:
            continue
        j = np.unique(np.concatenate(met))
        j = j[(j > i) & (group[j] != group[i]) & (LIKE[1] * np.minimum(n[j], n[i]) >= LIKE[0] * np.maximum(n[j], n[i]))]
        j = j if one_side else j[side[j] != side[i]]
        if not len(j):
            continue
        mark[token[starts[i]:ends[i]]] = True
        sent = np.cumsum(n[j]) // COUNTED
        for some in np.split(j, np.flatnonzero(np.diff(sent)) + 1):
            first = np.cumsum(n[some]) - n[some]
            place = np.arange(n[some].sum()) + np.repeat(starts[some] - first, n[some])
            shared = np.add.reduceat(mark[token[place]].astype(np.int64), first)
            for k in some[LIKE[1] * shared >= LIKE[0] * (n[i] + n[some] - shared)]:
                if group[k] != group[i]:
                    out.append((int(cls[i]), int(cls[k])))
                    group[group == group[k]] = group[i]
        mark[token[starts[i]:ends[i]]] = False
    return out


def linked_under_keys(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links between all classes of ``rooted`` (``key``, ``cls``, ``root``) that meet under a key and have different roots. A key of many classes is dealt to
    blocks of some ``BLOCK`` of them, and each two blocks are a group of their own. Keys of two classes are left out: their leader met the other one."""
    many = (rooted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("m > 2 and lo <> hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    dealt = (rooted.join(many, "key").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "cls", "root"))

    def run(pdf):
        return pd.DataFrame(linked(*(pdf[c].to_numpy(np.int64) for c in ("cls", "root", "side")), pdf["runs"].tolist()), columns=["a", "b"])
    return dealt.join(sets, "cls").groupBy("key", "low", "high").applyInPandas(run, "a long, b long").distinct()


def groups(placed: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame | None:
    """``(node, root)`` of the classes in ``placed`` (``key``, ``cls``, ``n``) that are linked to another one, and of those that ``known`` (``a``, ``b``) links;
    None without any.

    First the smallest class of each key is compared with the others; then all classes of the keys that still hold several groups. Links that are
    known join the groups before that, and where nothing more is found, those groups are the result.
    """
    spark = placed.sparkSession
    lead = placed.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("lead"))
    near = F.least("n", "lead.n") * LIKE[1] >= F.greatest("n", "lead.n") * LIKE[0]  # else sizes alone forbid it
    pairs = (placed.join(lead, "key").where(F.col("cls") != F.col("lead.cls")).where(near)
             .select(F.col("lead.cls").alias("a"), F.col("cls").alias("b")).distinct())
    first, at_first = put(alike(pairs, sets) if known is None else alike(pairs, sets).union(known), "links")
    give_back(spark)
    roots, at_roots = put(components(first), "roots")
    rooted = placed.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    rooted, at_rooted = put(rooted, "rooted")
    more, at_more = put(linked_under_keys(rooted, sets), "links")
    give_back(spark)
    forget(spark, at_first, at_rooted)
    if more.isEmpty():
        forget(spark, at_more)
        return None if roots.isEmpty() else roots
    stars = more.union(roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    out = put(components(stars), "roots")[0]
    forget(spark, at_more, at_roots)
    return out


def marked_links(found: DataFrame, marks: DataFrame) -> DataFrame:
    """``(a, b)``: links between the classes of each group of operator 8; ``marks`` has the ``component`` of each text's hash ``h``."""
    both = found.select("h", "cls").distinct().join(marks.select("h", "component").distinct(), "h").select("component", "cls").distinct()
    low = both.groupBy("component").agg(F.min("cls").alias("a"))
    return both.join(low, "component").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()


def first_of_alike(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each group that links connect, links of likeness ``LIKE`` and those of operator 8
    (``simhash``): that with the smallest doc_id, null ids last; of several, any one.

    Null text counts as empty; texts without words are one group. Texts shorter than a run are alike if they are equal. An
    empty table gives an empty result. ``docs`` is read several times, and no text is written: rows are known by doc_id and a hash
    of their text.
    """
    spark = docs.sparkSession
    doc_id, content = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(doc_id.alias("doc_id"), F.xxhash64(content).alias("h"), content.alias("text"))
    found, at_found = put(classes_of(keyed), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")
    classes, at_classes = put(found.groupBy("cls").agg(F.min(order).alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    each = classes.select("cls", "n", F.explode("keys").alias("key"))
    met = each.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    placed, at_placed = put(each.join(met, "key"), "placed")
    asked, at_asked = put(placed.select("cls").distinct().join(classes.select("cls", "low.doc_id", "low.h"), "cls").select(
        "cls", F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "asked")  # Spark then knows its size and leaves the texts unshuffled while it is small
    wanted = keyed.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    sets, at_sets = put(sets_of(wanted).dropDuplicates(["cls"]), "sets")
    give_back(spark)
    marked, at_marked = put(marked_links(found, simhash.near_duplicates(keyed, row="h")), "links")
    give_back(spark)
    roots = groups(placed, sets, marked)
    low = classes.select("low") if roots is None else (
        classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("low").alias("low")))
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_rows"))
    firsts = low.select(F.col("low.doc_id").alias("_id"), F.col("low.h").alias("_h"))
    kept, _ = put(firsts.join(rows, firsts["_id"].eqNullSafe(rows["_id"]) & (firsts["_h"] == rows["_h"])).select(firsts["_id"], firsts["_h"], "_rows"), "kept")
    forget(spark, at_found, at_classes, at_placed, at_asked, at_sets, at_marked)
    same = doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(content) == F.col("_h"))
    out = docs.join(kept.where("_rows = 1").select("_id", "_h"), same, "left_semi")
    if not kept.where("_rows > 1").isEmpty():  # rows equal in doc_id and text: one of them
        several = docs.join(kept.where("_rows > 1").select("_id", "_h"), same, "left_semi")
        mark = F.struct(doc_id.alias("i"), F.xxhash64(content).alias("h"))
        row = F.first(F.struct(*docs.columns))
        out = out.unionByName(several.groupBy(mark.alias("_mark")).agg(row.alias("_row")).select("_row.*"))
    return out.select(*docs.columns)
