"""SimHash near-duplicates by a generalised pigeonhole.

Bits are grouped so that correlated ones share a partition. Partition ``i`` gets a threshold ``t_i`` with
``sum(t_i + 1) = radius + 1``: two fingerprints within the radius then differ by at most ``t_i`` bits in some
partition. Thresholds may differ and may be -1 (partition not probed); a dynamic programme picks those with
the smallest estimated candidate count, from bit statistics over all fingerprints. Fingerprints that meet
another one in a probe are verified exactly: two words differ in at most two bits if and only if one word is
within one bit of both, and at most 65 words are within one bit of any word, so verification never emits
the pairs of a large group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table
from .registry import query

RADIUS, BITS, SEED = 2, 64, 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit majority of the XXH64 values of all ``words``-word shingles; 0 for a text without words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z only, splits at ASCII blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)  # one hash: each of its bits is set in over half of one
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        some = zip(starts[at:at + (1 << 16)], (ends[words - 1:] - 1)[at:at + (1 << 16)].tolist())
        digests = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in some], np.uint64)
        counts += np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as a signed long, and the long column ``row`` if named; one row per row of ``docs``."""
    names = ["doc_id", *([row] if row else [])]

    def run(batches):
        for pdf in batches:
            prints = np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pdf[names].assign(fp=prints)
    return docs.select(*[F.col(c).cast("long") for c in names], F.col("text").cast("string")).mapInPandas(
        run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set (64 x 64 counts)."""
    def run(batches):
        total = np.zeros((BITS, BITS))
        for pdf in batches:
            words = pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            rows = np.unpackbits(words, axis=1, bitorder="little").astype(np.float64)
            total += rows.T @ rows
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": i, "j": j, "n": total.ravel().astype(np.int64)})
    sums = classes.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    for r in sums.collect():  # 4096 rows at any size
        both[r["i"], r["j"]] = r["n"]
    return classes.count(), both


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of even width, filled greedily so that bits join the group they correlate with."""
    if n == 0:
        return [list(range(g, BITS, m)) for g in range(m)]
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = (BITS - sum(map(len, groups))) // (m - g)
        start = max(sorted(free), key=lambda b: sum(corr[b, c] for c in free))
        group = [start]
        free.discard(start)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: sum(corr[b, c] for c in group))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def expected_pairs(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Pairs of fingerprints expected within ``t`` bits on ``bits``, from single and paired bit frequencies
    (a spanning tree of the strongest dependences)."""
    if n < 2:
        return 0.0
    p = np.diag(both) / n
    agree = p ** 2 + (1 - p) ** 2
    p11 = both / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    joint = p11 ** 2 + p10 ** 2 + p01 ** 2 + (1 - p11 - p10 - p01) ** 2
    log = sum(np.log(agree[b]) for b in bits)
    inside, rest = [bits[0]], list(bits[1:])
    while rest:
        gain, b = max((np.log(max(joint[a, b], 1e-300) / (agree[a] * agree[b])), b) for a in inside for b in rest)
        log += max(gain, 0.0)
        inside.append(b)
        rest.remove(b)
    odds, ways = [(1 - agree[b]) / agree[b] for b in bits], [1.0]
    for k in range(1, t + 1):
        ways.append(sum(np.prod(c) for c in combinations(odds, k)) if k < 3 else ways[-1] * len(bits))
    return float(n) * (n - 1) / 2 * min(1.0, np.exp(log) * sum(ways))


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions with thresholds ``[(bits, t)]``: the cheapest by estimated candidates plus probes."""
    best = None
    for m in range(2, radius + 3):
        groups = partitions(n, both, m)

        def cost(g, t):
            probes = sum(len(list(combinations(range(len(g)), k))) for k in range(t + 1))
            return 0.0 if t < 0 else expected_pairs(n, both, g, t) + n * probes
        # table[s]: smallest cost of the groups so far with sum(t + 1) = s
        sums = {0: (0.0, [])}
        for g in groups:
            new = {}
            for s, (c, ts) in sums.items():
                for t in range(-1, radius + 1):
                    if s + t + 1 <= radius + 1 and (t < 0 or t <= 1 or len(g) <= 24):
                        option = (c + cost(g, t), [*ts, t])
                        if s + t + 1 not in new or option[0] < new[s + t + 1][0]:
                            new[s + t + 1] = option
            sums = new
        if radius + 1 in sums and (best is None or sums[radius + 1][0] < best[0]):
            best = (sums[radius + 1][0], [(g, t) for g, t in zip(groups, sums[radius + 1][1]) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def candidates(classes: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """Distinct ``fp`` that come within the threshold of another one in some partition.

    The bits outside the partition differ by ``radius`` at most, so they are cut into ``radius + 1`` groups of which one
    must agree; only fingerprints that agree there too stay. Few that met by chance do.
    """
    probes, inner = [], []
    for i, (bits, t) in enumerate(plan):
        mask = _signed(sum(1 << b for b in bits))
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]
        rest = [b for b in range(BITS) if b not in bits]
        inner.append(F.when(F.col("part") == i, F.array(*[F.lit(_signed(sum(1 << b for b in rest[g::radius + 1])))
                                                          for g in range(radius + 1)])))
        own = F.col("fp").bitwiseAND(F.lit(mask))
        probes.append(classes.select(F.lit(i).alias("part"), F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"),
                                     own.alias("own"), "fp")
                      .select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "fp",
                              (F.col("flip") == 0).alias("indexed")))
    keys = probes[0]
    for more in probes[1:]:
        keys = keys.union(more)

    def met(rows, by):
        return (rows.groupBy(*by).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max("indexed").alias("hit"))
                .where("lo <> hi and hit").select(*by))
    close = keys.join(met(keys, ["part", "key"]), ["part", "key"])
    finer = close.select("*", F.explode(F.coalesce(*inner)).alias("mask")).withColumn("rest", F.col("fp").bitwiseAND(F.col("mask")))
    by = ["part", "key", "mask", "rest"]
    return finer.join(met(finer, by), by).select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the ``fp`` within two bits of each other."""
    flips = [0, *[_signed(1 << b) for b in range(BITS)]]
    near = fps.select("fp", F.explode(F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))).alias("key"))
    groups = near.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return (groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row, and ``component`` (a name of the group), and the long column ``row`` if named: documents whose fingerprints differ in at most two bits
    are linked, and ``component_id`` is the smallest doc_id that links reach.

    Null text counts as empty; texts without words have fingerprint zero and are linked like any other.
    Rows with the same doc_id stay rows of their own; a null doc_id is never the smallest one unless all of
    its component are null. An empty table gives an empty result. Other columns are ignored.
    """
    prints = cut(with_fingerprint(docs, words, row))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    n, both = bit_statistics(classes)
    roots = components(links(cut(candidates(classes, allocate(n, both)))))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    low = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = cut(grouped.join(low, "root").select("fp", "component_id", F.col("root").alias("component")))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "component", *([row] if row else []))


def first_of_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` (all columns) with one row of each group: that with the smallest doc_id, null ids last; of several, the first one."""
    marked = cut(docs.withColumn("_group_row", F.monotonically_increasing_id()))
    found = cut(near_duplicates(marked, words, "_group_row"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_group_row")
    low = found.groupBy("component").agg(F.min(order).alias("low")).select(F.col("low._group_row").alias("_group_row"))
    return marked.join(low, "_group_row", "left_semi").select(*docs.columns)


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
