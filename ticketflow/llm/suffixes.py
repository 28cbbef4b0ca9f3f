"""Repeated passages by suffix sorting, removed everywhere but in the document with the smallest id.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id.

**Who can share a string.** Of the ``anchor``-byte strings inside each window of ``length`` bytes, the one with the smallest
hash is its anchor. Equal windows have equal anchors, so documents only have to compare windows with a common anchor. Neighbouring windows
with the same anchor form a segment. Tasks send 21 bytes per segment to the bucket of its anchor: hashes of anchor and
segment, place and document; equal segments of a batch are sent once. Nothing about the text itself is shuffled yet. The number of
buckets follows from the bytes of the table, so a bucket has about the same size at any scale and any number of partitions.

**What the buckets decide.** Anchors that one document has alone are dropped, which is most of them. Of equal segments all but the
one in the smallest document are repeats. If that leaves different segments around one anchor, their bytes are fetched. From here on
a segment is a plain narrow row, so rows grow with segments alone.

**A window has a side.** Around an anchor of 18 bytes, a window of 50 has 16 bytes or more on the left or on the right. Fetched segments that share neither
side with another one cannot share a window and are left out before anything is sorted.

**Suffix sorting.** The different segments of a bucket are concatenated, suffix-sorted and turned into their Burrows-Wheeler
transform. Starting with the empty string, the interval of each string is extended backwards by every character, all intervals of a length at
once. An extension ends where the common prefix with the next suffix is as long as the string; if that end is new, the
interval stays in the queue. So common prefixes come out by increasing value, and the search stops at ``length``: suffixes
without an end between them share ``length`` bytes. The smallest document of each such class keeps the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, put, table
from .registry import query

LENGTH, ANCHOR = 50, 18
BATCH, CHUNK, SORTED = 1 << 23, 1 << 19, 1 << 20  # bytes of text at once, windows at once, bytes suffix-sorted at once
BUCKET = 1 << 22  # bytes of text whose segments make one bucket, on average
LAST = (1 << 63) - 1  # stands for a null id
U64 = np.uint64
_table = np.random.default_rng(50).integers(0, 1 << 64, 512, U64)
_R, _R2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
POSITION = U64((1 << 20) - 1)


def _powers(r: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, r, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def _inverse(r: np.uint64) -> np.uint64:
    return U64(pow(int(r), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(29))


def _doubled(first: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` of ``n`` neighbours at each place, from joins of 1, 2, 4, ... of them."""
    whole, size, part, at = None, 1, first, 0
    while True:
        if n & size:
            whole = part if whole is None else join(whole[:len(part) - at] if len(whole) > len(part) - at else whole, part[at:][:len(whole)], at, size)
            at += size
        if size * 2 > n:
            return whole
        part = join(part[:-size], part[size:], size, size)
        size *= 2


def segments(data: np.ndarray, windows: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """``(start, n, h, f)`` of all segments of ``data`` (bytes): first window, number of windows, hashes of anchor and bytes.

    ``windows`` says for each byte whether a window starts there.
    """
    out, powers = [], _powers(_R2, CHUNK + length)
    inverse, count = _powers(_inverse(_R2), CHUNK + length), length - anchor + 1
    r_power = {}

    def roll(a, b, _, size):  # hash of a, then of the next `size` bytes
        if size not in r_power:
            r_power[size] = U64(pow(int(_R), size, 1 << 64))
        m = min(len(a), len(b))
        return a[:m] * r_power[size] + b[:m]

    def smaller(a, b, *_):
        m = min(len(a), len(b))
        return np.minimum(a[:m], b[:m])

    for at in range(0, len(data) - length + 1, CHUNK):
        x = data[at:at + CHUNK + length - 1]
        own = mix(_doubled(_table[x], anchor, roll))
        key = (own & ~POSITION) | np.arange(len(own), dtype=U64)
        least = _doubled(key, count, smaller)
        starts = np.flatnonzero(windows[at:at + len(least)])
        if not len(starts):
            continue
        place = (least[starts] & POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        n = np.diff(np.r_[first, len(starts)])
        begin = starts[first]
        sums = np.zeros(len(x) + 1, U64)
        np.cumsum(_table[256 + x.astype(np.int64)] * powers[:len(x)], out=sums[1:])
        f = mix((sums[begin + n + length - 1] - sums[begin]) * inverse[begin] + n.astype(U64))
        out.append((begin + at, n, own[place[first]], f))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(c) for c in zip(*out))


SENT = ("kind byte, key long, docs binary, tags binary, doc binary, at binary, n binary, h binary, f binary, "
        "one_doc long, one_tag long, one_at int, one_n int")
DECIDED = "kind byte, doc long, tag long, at int, n int, h long"
MET, COVERED, ASKED = 0, 1, 2


def planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first: high bytes are mostly zero, and a shuffle's codec then makes nothing of them."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, at, n, h, f) -> pd.DataFrame:
    """Packed ``MET`` rows, one per value of ``key``: documents once, then the columns of their segments."""
    order = np.lexsort((at, tag, doc, key))
    key, doc, tag, at, n, h, f = (c[order] for c in (key, doc, tag, at, n, h, f))
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        new = np.r_[True, (doc[a + 1:b] != doc[a:b - 1]) | (tag[a + 1:b] != tag[a:b - 1])]
        number = np.cumsum(new) - 1
        wide = np.uint16 if number[-1] < 1 << 16 else np.uint32
        rows.append((MET, int(key[a]), planes(np.diff(doc[a:b][new].view(U64), prepend=U64(0))), tag[a:b][new].astype(np.uint32).tobytes(),
                     planes(np.diff(number, prepend=0).astype(wide)), planes(at[a:b].astype(np.uint32)), n[a:b].astype(np.uint8).tobytes(),
                     h[a:b].tobytes(), f[a:b].tobytes(), 0, 0, 0, 0))  # no nulls: a column of longs with nulls would be read as doubles
    return pd.DataFrame(rows, columns=_names(SENT))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def runs_of(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows ``at`` to ``at + n`` of documents, neighbouring ones of a document put together."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at, n = doc[order], tag[order], at[order], n[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != (at + n)[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    return doc[first], tag[first], at[first], (at + n)[last] - at[first]


def unpacked(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of packed rows put together, ``doc`` and ``tag`` per segment."""
    parts: dict[str, list] = {c: [] for c in ("doc", "tag", "at", "n", "h", "f")}
    for r in pdf.itertuples(index=False):
        docs = np.cumsum(from_planes(r.docs, U64), dtype=U64).view(np.int64)
        tags, n = np.frombuffer(r.tags, np.uint32).astype(np.int64), np.frombuffer(r.n, np.uint8)
        number = np.cumsum(from_planes(r.doc, np.uint16 if len(r.doc) == 2 * len(n) else np.uint32), dtype=np.int64)
        parts["doc"].append(docs[number])
        parts["tag"].append(tags[number])
        parts["n"].append(n.astype(np.int64))
        parts["at"].append(from_planes(r.at, np.uint32).astype(np.int64))
        parts["h"].append(np.frombuffer(r.h, U64))
        parts["f"].append(np.frombuffer(r.f, U64))
    kinds = {"doc": np.int64, "tag": np.int64, "at": np.int64, "n": np.int64, "h": U64, "f": U64}
    return {c: np.concatenate(p) if p else np.zeros(0, kinds[c]) for c, p in parts.items()}


def judge(doc, tag, h, f) -> tuple[np.ndarray, np.ndarray]:
    """For each segment: whether an equal one lies in a smaller document, and whether it has to be compared with different
    ones around the same anchor."""
    covered, asked = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.r_[True, sorted_h[1:] != sorted_h[:-1]] if len(h) else np.zeros(0, bool)
    alone = new & np.r_[new[1:], True] if len(h) else new
    some = order[~alone]
    if not len(some):
        return covered, asked
    some = some[np.lexsort((doc[some], f[some], h[some]))]
    h, f, doc = h[some], f[some], doc[some]
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_f = new_h | np.r_[True, f[1:] != f[:-1]]
    least = doc[np.flatnonzero(new_f)][np.cumsum(new_f) - 1]  # smallest document of the equal segments
    covered[some] = doc > least
    group = np.cumsum(new_h) - 1
    low, high = (ufunc.reduceat(least, np.flatnonzero(new_h))[group] for ufunc in (np.minimum, np.maximum))
    asked[some] = (doc == least) & (low < high)
    return covered, asked


def _batches(batches, size: int):
    """Documents (id, tag, bytes) in groups of about ``size`` bytes."""
    rows, held = [], 0
    for pdf in batches:
        for row in zip(pdf["_key"], pdf["_tag"], pdf["_data"]):
            if held + len(row[2]) > size and rows:
                yield zip(*rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[2])
    if rows:
        yield zip(*rows)


def sent_segments(docs: DataFrame, buckets: int, length: int, anchor: int) -> DataFrame:
    """Packed segments by bucket of their anchor (``MET``), and as plain rows those found repeated within a batch (``COVERED``)."""
    def run(batches):
        for ids, tags, texts in _batches(batches, BATCH):
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(texts), np.uint8)
            windows = np.zeros(len(data) + 1, np.int8)
            long = sizes >= length
            np.add.at(windows, (ends - sizes)[long], 1)
            np.add.at(windows, ends[long] - length + 1, -1)
            start, n, h, f = segments(data, np.cumsum(windows[:-1], dtype=np.int8).astype(bool), length, anchor)
            if not len(start):
                continue
            number = np.searchsorted(ends, start, "right")
            doc, tag = np.array(ids, np.int64)[number], np.array(tags, np.int64)[number]
            at = start - (ends - sizes)[number]
            covered, _ = judge(doc, tag, h, f)
            rest = ~covered
            yield packed((h[rest] % U64(buckets)).astype(np.int64), doc[rest], tag[rest], at[rest], n[rest], h[rest], f[rest])
            if covered.any():
                doc, tag, at, n = runs_of(doc[covered], tag[covered], at[covered], n[covered])
                none = dict.fromkeys(_names(SENT)[2:9], b"")
                yield pd.DataFrame({"kind": COVERED, "key": int(h[0] % U64(buckets)), **none, "one_doc": doc, "one_tag": tag, "one_at": at, "one_n": n})
    return docs.select("_key", "_tag", "_data").mapInPandas(run, SENT)


def _by_key(batches, columns: list[str]):
    """Rows of each run of equal ``columns`` of a sorted partition, as one frame."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        while len(pdf):
            key = tuple(pdf.iloc[0][columns])
            same = (pdf[columns] == key).all(axis=1).to_numpy()
            if rest and tuple(rest[0].iloc[0][columns]) != key:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            n = len(same) if same.all() else int(np.argmin(same))
            rest.append(pdf.iloc[:n])
            pdf = pdf.iloc[n:]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def decided(sent: DataFrame) -> DataFrame:
    """``COVERED`` segments, and ``ASKED`` ones whose bytes are needed, a row each."""
    def run(batches):
        for pdf in _by_key(batches, ["kind", "key"]):
            if pdf["kind"].iloc[0] != MET:
                yield pd.DataFrame({"kind": COVERED, "doc": pdf["one_doc"], "tag": pdf["one_tag"], "at": pdf["one_at"], "n": pdf["one_n"], "h": 0})
                continue
            s = unpacked(pdf)
            for kind, chosen in zip((COVERED, ASKED), judge(s["doc"], s["tag"], s["h"], s["f"])):
                if chosen.any():
                    yield pd.DataFrame({"kind": kind, **{c: s[c][chosen] for c in ("doc", "tag", "at", "n")}, "h": s["h"][chosen].view(np.int64)})
    return sent.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInPandas(run, DECIDED)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their next ``depth`` symbols or more, by prefix doubling; ``text`` is padded by 0."""
    n = len(text)
    padded = np.r_[text.astype(np.int64), np.zeros(4, np.int64)]
    key = ((padded[:n] << 27) | (padded[1:n + 1] << 18) | (padded[2:n + 2] << 9) | padded[3:n + 3])
    size = 4
    while True:
        order = np.argsort(key, kind="stable")
        found = key[order]
        new = np.r_[False, found[1:] != found[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if size >= depth or new[1:].all():
            return order
        after = np.full(n, -1, np.int64)
        if size < n:
            after[:-size] = rank[size:]
        key = (rank << 32) | (after + 1)
        size *= 2


def common_prefix_ends(bwt: np.ndarray, depth: int, stop: int = 0) -> np.ndarray:
    """For each place of the suffix order (and its end) whether the common prefix with the place before is below ``depth``.

    Breadth-first over intervals of strings without ``stop`` (but as last symbol): all backward extensions of all intervals of one
    length at once, by runs of equal symbols.
    """
    n = len(bwt)
    ends = np.zeros(n + 1, bool)
    ends[[0, n]] = True
    if not n:
        return ends
    order = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # the place whose suffix is one symbol longer
    back[order] = np.arange(n)
    heads = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
    tails = np.r_[heads[1:], n]
    run_of = np.cumsum(np.r_[False, bwt[1:] != bwt[:-1]])
    symbols = int(bwt.max()) + 1
    low, high = np.array([0]), np.array([n])
    for size in range(depth):
        first = run_of[low]
        count = run_of[high - 1] - first + 1
        owner = np.repeat(np.arange(len(low)), count)
        run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        a, b = np.maximum(heads[run], low[owner]), np.minimum(tails[run], high[owner])
        symbol = bwt[a].astype(np.int64)
        if size:
            use = symbol != stop
            owner, a, b, symbol = owner[use], a[use], b[use], symbol[use]
        if not len(a):
            break
        key = owner * symbols + symbol
        by = np.argsort(key, kind="stable")
        key, a, b = key[by], a[by], b[by]
        new = np.r_[True, key[1:] != key[:-1]]
        last = np.r_[new[1:], True]
        low, high = back[a[new]], back[b[last] - 1] + 1
        fresh = ~ends[high]
        low, high = low[fresh], high[fresh]
        ends[high] = True
        if not len(low):
            break
    return ends


def repeated_windows(strings: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows also lie in a string of a smaller document."""
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    text = np.zeros(int(sizes.sum() + len(sizes)), np.int16)  # bytes count from 1, and a 0 ends each string
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    order = suffix_array(text, length)
    ends = common_prefix_ends(text[order - 1], length)
    of = np.repeat(np.arange(len(strings)), sizes + 1)
    window = np.arange(len(text)) - starts[of] <= (sizes - length)[of]
    group = (np.cumsum(ends[:-1]) - 1)[window[order]]
    place = order[window[order]]
    least = np.full(group[-1] + 1 if len(group) else 0, LAST, np.int64)
    np.minimum.at(least, group, docs[of[place]])
    repeated = np.zeros(len(text), bool)
    repeated[place] = least[group] < docs[of[place]]
    return [repeated[s:s + max(0, n - length + 1)] for s, n in zip(starts, sizes)]


BYTES = "h long, doc long, tag long, at int, n int, bytes binary"
PLACE = 1 << 31  # a place and a number of windows as one long: place * PLACE + number


def per_document(rows: DataFrame, *more: str) -> DataFrame:
    """``rows`` (``doc, tag, at, n``) as arrays per document."""
    one = F.struct((F.col("at").cast("long") * F.lit(PLACE) + F.col("n")).alias("p"), *more)
    return (rows.groupBy(F.col("doc").alias("_key"), F.col("tag").alias("_tag")).agg(F.collect_list(one).alias("_s"))
            .select("_key", "_tag", *[F.col(f"_s.{c}").alias(f"_{c}") for c in ("p", *more)]))


def fetched(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """``ASKED`` segments with their bytes."""
    def run(batches):
        for pdf in batches:
            rows = [(h, doc, tag, at, n, data[at:at + n + length - 1])
                    for doc, tag, data, places, hs in zip(pdf["_key"], pdf["_tag"], pdf["_data"], pdf["_p"], pdf["_h"])
                    for at, n, h in zip((places // PLACE).tolist(), (places % PLACE).tolist(), hs.tolist())]
            yield pd.DataFrame(rows, columns=_names(BYTES))
    return docs.join(per_document(asked, "h"), ["_key", "_tag"]).select("_key", "_tag", "_data", "_p", "_h").mapInPandas(run, BYTES)


def sided(data: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Which segments of ``data`` (at ``begin``, of ``size`` bytes, around anchors of hash ``h``) share a side of their anchor with another one."""
    side = (length - anchor + 1) // 2
    powers = {}

    def roll(a, b, _, n):
        if n not in powers:
            powers[n] = U64(pow(int(_R), n, 1 << 64))
        m = min(len(a), len(b))
        return a[:m] * powers[n] + b[:m]

    own = mix(_doubled(_table[data], anchor, roll)) & ~POSITION
    place, todo = np.full(len(begin), -1), np.arange(len(begin))
    for k in range(int(size.max()) - anchor + 1):  # the anchor is the first place with its hash, within 2 * (length - anchor) steps
        todo = todo[k + anchor <= size[todo]]
        hit = own[begin[todo] + k] == (h[todo] & ~POSITION)
        place[todo[hit]] = k
        todo = todo[~hit]
        if not len(todo):
            break
    keep = place < 0  # never, unless hashes collide: then it is compared anyhow
    for left in (True, False):
        first = place - side if left else place + anchor
        has = np.flatnonzero((place >= 0) & (first >= 0) & (first + side <= size))
        key = h[has].copy()
        for k in range(side):
            key = key * _R + _table[data[begin[has] + first[has] + k]]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        keep[has[count[back] > 1]] = True
    return keep


def _anchor_batches(batches, size: int):
    """Rows sorted by ``h`` in frames of ``size`` bytes or more; all rows of an anchor are in one frame."""
    held, total = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        last = held[-2]["h"].iloc[-1] if len(held) > 1 else pdf["h"].iloc[0]
        border = last != pdf["h"].iloc[-1]
        total += int(pdf["bytes"].str.len().sum())
        if border and total >= size:
            whole = pd.concat(held, ignore_index=True)
            open_ = (whole["h"] == whole["h"].iloc[-1]).to_numpy()
            yield whole[~open_]
            held = [whole[open_]]
            total = int(held[0]["bytes"].str.len().sum())
    if held:
        yield pd.concat(held, ignore_index=True)


def compared(found: DataFrame, length: int, anchor: int, sorted_bytes: int = SORTED) -> DataFrame:
    """``COVERED`` parts of fetched segments, a row each."""
    def run(batches):
        for pdf in _anchor_batches(batches, sorted_bytes):
            sizes = pdf["n"].to_numpy(np.int64) + length - 1
            data = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
            pdf = pdf[sided(data, np.cumsum(sizes) - sizes, sizes, pdf["h"].to_numpy(np.int64).view(U64), length, anchor)]
            if not len(pdf):
                continue
            number: dict[tuple, int] = {}
            of = [number.setdefault(row, len(number)) for row in zip(pdf["doc"], pdf["bytes"])]
            repeated = repeated_windows([t for _, t in number], np.array([d for d, _ in number], np.int64), length)
            edges = [np.flatnonzero(np.diff(np.r_[False, r, False])) for r in repeated]
            out = [(COVERED, doc, tag, at + p, q - p, 0) for k, doc, tag, at in zip(of, pdf["doc"], pdf["tag"], pdf["at"])
                   for p, q in zip(edges[k][::2].tolist(), edges[k][1::2].tolist())]
            if out:
                yield pd.DataFrame(out, columns=_names(DECIDED))
    return found.repartition("h").sortWithinPartitions("h").mapInPandas(run, DECIDED)


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without characters of which some bytes stay."""
    char = np.cumsum((data & 0xC0) != 0x80)
    stays = np.zeros(char[-1] + 1 if len(char) else 0, bool)
    stays[char[~gone]] = True
    return gone & ~stays[char]


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, characters: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that stay, put together) and ``removed`` (array of start and end, in bytes).

    Null text counts as empty. Documents shorter than ``length`` lose nothing. Rows with the same doc_id do not remove from one another;
    a null doc_id counts as larger than any other, and such rows do not remove from one another. With ``characters``, a character goes only if
    all its bytes do. Strings are judged on the input. Columns named ``kept`` and ``removed`` are replaced. An empty table gives no rows.
    """
    given = docs.drop("kept", "removed")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = given.select(F.struct(*given.columns).alias("_rest"), key.alias("_key"), data.alias("_data"))
    keyed = keyed.withColumn("_tag", F.xxhash64("_data").bitwiseAND(F.lit(0xFFFFFFFF)))
    total = keyed.agg(F.sum(F.octet_length("_data"))).first()[0] or 0
    found, _ = put(decided(sent_segments(keyed, 1 + total // BUCKET, length, anchor)), "segments")
    more, _ = put(compared(fetched(keyed, found.where(F.col("kind") == ASKED), length), length, anchor), "compared")
    give_back(docs.sparkSession)
    repeats = per_document(found.where(F.col("kind") == COVERED).union(more))

    @F.pandas_udf("kept binary, removed array<struct<start: long, end: long>>")
    def remove(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        kept, removed = [], []
        for text, p in zip(texts, places):
            if text is None:
                kept.append(None)
                removed.append([])
                continue
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, p // PLACE, 1)
            np.add.at(depth, p // PLACE + p % PLACE + length - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            raw = np.frombuffer(text, np.uint8)
            if characters:
                gone = whole_characters(raw, gone)
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            kept.append(raw[~gone].tobytes())
            removed.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
        return pd.DataFrame({"kept": pd.Series(kept, dtype=object), "removed": pd.Series(removed, dtype=object)})

    out = keyed.join(repeats, ["_key", "_tag"], "left").withColumn("_out", remove(F.when(F.col("_p").isNotNull(), F.col("_data")), "_p"))
    return out.select("_rest.*", F.coalesce("_out.kept", "_data").alias("kept"), "_out.removed")


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("doc_id").cast("long"), (F.length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
