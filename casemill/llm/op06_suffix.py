"""Exact removal of long repeated substrings with a sampled, partitioned enhanced suffix array.

A repeated string of ``length`` bytes must be found wherever it starts, without sorting every suffix of
the corpus. Each window of that length has an anchor: the place of its least hashed ``GRAM``-byte string.
Equal windows have equal anchors, so that

1. one pass over the texts emits the anchors of all windows (about one in 77 bytes), each with a digest of its
   context: what a window through the anchor can reach. Contexts that a batch holds twice are settled on the spot
   and leave as one row. The others are shuffled once, by the anchor's hash: a context that occurs at
   another place is repeated as a whole, an anchor that occurs once is done, and only anchors with different
   contexts remain, one place for each context;
2. these places meet their texts in a join, and their contexts are cut;
3. contexts are grouped by anchor. A group gets a suffix array (suffixes sorted by what follows the anchor,
   with common-prefix lengths) and the same for what precedes it, read backwards. A stack scan of the
   common-prefix lengths walks the interval tree; in each interval the suffixes are split where their left
   contexts part, so that each run of at least two is a repeat with all its occurrences, which neither a
   byte to the right (interval) nor to the left (run) extends.

Every window is compared through its own anchor, hence the union of the repeats of at least ``length``
bytes is exactly the set of bytes covered by repeated windows. Contexts reach ``length`` bytes from the
anchor; longer repeats are the union of their anchors' pieces.

No group needs one task for all its contexts. Anchors that are hot in a sample are salted by the digest, which
keeps equal contexts together. A group of more than ``max_group`` contexts is cut by prefixes, as a suffix array
is cut over tasks: contexts that agree in what windows of a range of starts need form a smaller group with an interval tree of
its own, and ranges are halved until groups fit a task.

Before texts are shuffled, a bit table of at most ``FILTER_BITS`` bits (broadcast) withholds texts that surely have no
place wanted. Results don't depend on it: where it is full, all texts are shuffled, compressed, and no more than that.

Defined results: null texts are empty; matches never cross documents and may overlap; rows with equal
text are copies of each other (if long enough, removed whole), also when their ids are equal; texts shorter
than the window keep all bytes; an empty table returns no rows. Texts are told apart by 64-bit hashes. All columns of
the input are carried in one struct, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.common import U64, cut, mix64, small_batches, table

GRAM = 48
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
#: Most bits of the table that withholds texts.
FILTER_BITS = 26
#: One text in so many is looked at for hot anchors; those with more than HOT_SHARE of its rows are salted.
SAMPLE, HOT_SHARE, HOT_ROWS, SALTS = 64, 1e-5, 64, 64
#: Ranges of so many starts are not halved any more.
NARROW = 16


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + (1 << 12)
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``gram`` bytes, by differences of a running polynomial."""
    up, down = _powers()
    total = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)])])
    return mix64((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    w = 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def anchors(text: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of all windows of ``length`` bytes."""
    places, hashes = [], []
    span = length - gram + 1
    for c in range(0, max(0, len(text) - length + 1), CHUNK):
        h = gram_hashes(np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - c), c), gram)
        key = (h >> U64(32)).astype(np.uint32)
        low = _slide(key, span, np.minimum)
        pad = np.zeros(span - 1, np.uint32)
        at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), span, np.maximum) == key)
        places.append(at + c)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first].view(np.int64), p.astype(np.int64)


def stack_scan(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of every interval of the common-prefix tree; lcp[i] is between rows i-1 and i.

    Children come before their parents; -1 separates groups.
    """
    stack: list[tuple[int, int]] = []  # (depth, first row)
    for i, x in enumerate([*lcp.tolist()[1:], -1], 1):
        first = i - 1
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            yield first, i - 1, depth
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


class _Least:
    """Least value of any slice of an array, from a table of power-of-two spans."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        w = 1
        while 2 * w <= len(x):
            self.rows.append(np.minimum(self.rows[-1][:-w], self.rows[-1][w:]))
            w *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a..b, both included, b >= a."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for level in np.unique(k):
            m = k == level
            out[m] = np.minimum(self.rows[level][a[m]], self.rows[level][b[m] - (1 << level) + 1])
        return out


def _array(keys: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix lengths of the parts within each key (-1 between keys)."""
    head = keys.view(U64).astype(">u8").tobytes()
    flat = b"".join(head[8 * i : 8 * i + 8] + p.ljust(width, b"\0") for i, p in enumerate(parts))
    rows = np.frombuffer(flat, f"S{width + 8}")
    order = np.argsort(rows, kind="stable")
    m = np.frombuffer(flat, np.uint8).reshape(len(parts), width + 8)[order]
    size = np.fromiter(map(len, parts), np.int64, len(parts))[order]
    lcp = np.full(len(parts), -1, np.int64)
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width + 8) - 8
    lcp[1:] = np.where(first < 0, -1, np.minimum(first, np.minimum(size[1:], size[:-1])))
    return order, lcp


def repeats(keys: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(suffixes, best left extension of each, right extension) of every run of repeats of at least
    ``length`` bytes in any interval of the groups' common-prefix trees; left contexts are read backwards."""
    order, lcp = _array(keys, right, length)
    left_order, lcs = _array(keys, left, length)
    rank = np.empty(len(keys), np.int64)
    rank[left_order] = np.arange(len(keys))
    least = _Least(lcs)
    for first, last, depth in stack_scan(lcp):
        rows = order[first : last + 1]
        r = rank[rows]
        by_left = np.argsort(r, kind="stable") if last - first > 1 else (np.array([0, 1]) if r[0] < r[1] else np.array([1, 0]))
        rows, r = rows[by_left], r[by_left]
        shared = least(r[:-1] + 1, r[1:]) if last - first > 1 else np.array([lcs[r[0] + 1 : r[1] + 1].min()])
        near = shared + depth >= length
        if not near.any():
            continue
        # runs of suffixes that agree far enough to the left; the members' best neighbour is in the run
        best = np.full(len(rows), -1, np.int64)
        best[:-1] = np.where(near, shared, -1)
        best[1:] = np.maximum(best[1:], np.where(near, shared, -1))
        for run in np.split(np.arange(len(rows)), np.flatnonzero(~near) + 1):
            if len(run) > 1:
                yield rows[run], best[run], depth


def covers(keys: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each anchor that repeats cover: all repeats of a suffix hold its anchor, so
    that their union is one stretch. (0, 0) without any."""
    before, after = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for rows, best, depth in repeats(keys, left, right, length):
        before[rows] = np.maximum(before[rows], best)
        after[rows] = np.maximum(after[rows], depth)
    return before, after


def _digest(text: bytes, p: int, length: int) -> int:
    """64-bit digest of the context of an anchor at p."""
    return xxhash.xxh3_64_intdigest(text[p : p + length], seed=xxhash.xxh3_64_intdigest(text[max(0, p - length + GRAM) : p])) - (1 << 63)


def _anchor_rows(src: DataFrame, length: int) -> DataFrame:
    """src(cls, text) -> h, d, cls, p, multi: anchors with the digests of their contexts. ``multi`` marks the first of
    several equal contexts of a batch; the bytes that those cover come as rows with h null, from d to p."""
    back = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = dict(zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), strict=True))
            found = [(c, t, *anchors(t, length)) for c, t in texts.items() if len(t) >= length]
            if not found:
                continue
            size = [len(h) for _, _, h, _ in found]
            h, p = (np.concatenate([f[i] for f in found]) for i in (2, 3))
            cls = np.repeat(np.array([f[0] for f in found], np.int64), size)
            d = np.fromiter((_digest(t, q, length) for _, t, _, places in found for q in places.tolist()), np.int64, len(h))
            order = np.lexsort((d, h))
            same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
            again, multi = np.zeros(len(h), bool), np.zeros(len(h), bool)
            again[order[1:][same]] = True
            multi[order[:-1][same]] = True
            settled = again | multi
            s, e, c = p[settled] - back, p[settled] + length, cls[settled]
            if len(s):  # rows are in the order of texts and places: stretches that touch are joined
                start = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] > e[:-1])])
                end = np.append(np.flatnonzero(start)[1:] - 1, len(s) - 1)
                s, e, c = np.maximum(s[start], 0), e[end], c[start]
            own = ~again
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(h[own], np.zeros(len(s), np.int64)), mask=np.arange(own.sum() + len(s)) >= own.sum()), *(pa.array(np.append(x, y)) for x, y in ((d[own], s), (cls[own], c), (p[own], e), (multi[own], np.zeros(len(s), bool))))],
                names=["h", "d", "cls", "p", "multi"],
            )

    return src.mapInArrow(run, "h long, d long, cls long, p long, multi boolean")


def _met(src: DataFrame, length: int, max_group: int) -> DataFrame:
    """src(cls, text) -> what one shuffle of the anchors tells: stretches s..e of a text that are repeated, and places
    (h not null) whose contexts must be compared: cls, p, d, alone (the context occurs once), hot (in a large group)."""
    seen = _anchor_rows(src.filter(F.pmod("cls", F.lit(SAMPLE)) == 0), length).filter("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    seen = cut(seen)
    least = max(float(HOT_ROWS), HOT_SHARE * (seen.agg(F.sum("n")).first()[0] or 0))
    # at most 1 / HOT_SHARE rows
    hot = seen.filter(F.col("n") >= least).select("h", F.lit(True).alias("salted"))
    rows = _anchor_rows(src, length).join(F.broadcast(hot), "h", "left")
    rows = rows.select(F.coalesce("h", "cls").alias("k"), F.when(F.col("salted"), F.pmod("d", F.lit(SALTS))).otherwise(-1).cast("int").alias("salt"), "h", "d", "cls", "p", "multi").repartition("k", "salt")
    group, equal = Window.partitionBy("k", "salt"), Window.partitionBy("k", "salt", "d")
    x = F.xxhash64("cls", "p")
    rows = rows.withColumns({"nth": F.row_number().over(equal.orderBy("cls", "p")), "lo": F.min(x).over(equal), "hi": F.max(x).over(equal), "some": F.max("multi").over(equal)})
    rows = rows.withColumn("size", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(group))
    whole, salted = F.col("lo") != F.col("hi"), F.col("salt") >= 0
    wanted = F.col("h").isNotNull() & (F.col("nth") == 1) & ((F.col("size") > 1) | salted)
    stretch = F.col("h").isNull() | whole
    out = rows.filter(stretch | wanted).select(
        "cls",
        F.when(F.col("h").isNull(), F.col("d")).when(whole, F.greatest(F.lit(0), F.col("p") - (length - GRAM))).alias("s"),
        F.when(F.col("h").isNull(), F.col("p")).when(whole, F.col("p") + length).alias("e"),
        *(F.when(wanted, F.col(c)).alias(c) for c in ("h", "p", "d")),
        (wanted & ~whole & ~F.col("some")).alias("alone"),
        ((F.col("size") > max_group) | salted).alias("hot"),
    )
    return cut(out)


class _Filter:
    """Membership of 64-bit keys in a bit table: never denies a member, may admit others. At most FILTER_BITS bits."""

    def __init__(self, keys: DataFrame, col: str):
        n = keys.count()
        self.bits = bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))
        place = lambda k: F.shiftrightunsigned(F.col(col), k).bitwiseAND(F.lit((1 << bits) - 1))
        at = keys.select(F.explode(F.array(*[place(k) for k in (0, 19, 38)])).alias("at"))
        words = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        t = words.toArrow()  # at most one row for each word of the table
        self.table = np.zeros(1 << (bits - 6), U64)
        self.table[t.column("w").to_numpy()] = t.column("b").to_numpy().view(U64)

    def admits(self, keys: np.ndarray) -> np.ndarray:
        k, out = keys.view(U64), np.ones(len(keys), bool)
        for shift in (0, 19, 38):
            at = (k >> U64(shift)) & U64((1 << self.bits) - 1)
            out &= (self.table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
        return out


def _contexts(src: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """src(cls, text), wanted(cls, p, h, d, alone, hot) -> these with l, what stands before the anchor, read backwards, and r, what follows."""
    places = wanted.groupBy("cls").agg(F.collect_list(F.struct("p", "h", "d", "alone", "hot")).alias("places"))
    admit = src.sparkSession.sparkContext.broadcast(_Filter(wanted.select("cls").distinct(), "cls"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(admit.value.admits(b.column("cls").to_numpy())))
            texts = dict(zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array([z.compress(t) for t in texts.values()], pa.binary())], names=["cls", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        names = ("cls", "p", "h", "d", "alone", "hot", "l", "r")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
        for b in batches:
            out = []
            for c, packed, own in zip(b.column("cls").to_pylist(), b.column("z").to_pylist(), b.column("places").to_pylist(), strict=True):
                t = z.decompress(packed)
                for x in own:
                    p = x["p"]
                    if _digest(t, p, length) == x["d"]:
                        out.append((c, p, x["h"], x["d"], x["alone"], x["hot"], t[max(0, p - length + GRAM) : p][::-1], t[p : p + length]))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=names)

    texts = src.mapInArrow(pack, "cls long, z binary").dropDuplicates(["cls"])
    return texts.join(places, "cls").mapInArrow(run, "cls long, p long, h long, d long, alone boolean, hot boolean, l binary, r binary")


def _covered(groups: DataFrame, length: int, rows: int = 30_000) -> DataFrame:
    """groups(k, cls, p, alone, l, r), each in one partition and sorted by k there -> cls, s, e: what the interval trees
    of the groups find repeated around places whose context occurs once."""

    def settle(t: pa.Table) -> pa.RecordBatch:
        k, p = t.column("k").to_numpy(), t.column("p").to_numpy()
        before, after = covers(k, t.column("l").to_pylist(), t.column("r").to_pylist(), length)
        hit = (after > 0) & t.column("alone").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(t.column("cls").to_numpy()[hit]), pa.array((p - before)[hit]), pa.array((p + after)[hit])], names=["cls", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(x.num_rows for x in held) >= rows:
                t = pa.concat_tables(held)
                k = t.column("k").to_numpy()
                end = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
                if end:
                    yield settle(t.slice(0, end))
                held = [t.slice(end)]
        if held and sum(x.num_rows for x in held):
            yield settle(pa.concat_tables(held))

    return groups.mapInArrow(run, "cls long, s long, e long")


def _split(hot: DataFrame, length: int, max_group: int) -> Iterator[DataFrame]:
    """hot(h, cls, p, alone, l, r) -> the same as _covered for groups of any size.

    Windows that start between a and b bytes before the anchor need the same a bytes before it and the same length - b bytes behind
    it: contexts that agree in both are a group for this range. Ranges are halved until groups are small or at most
    ``NARROW`` starts wide; of those every window is counted by its hash.
    """
    own = ["h", "cls", "p", "alone", "l", "r"]
    level = hot.select(*own, F.lit(0).alias("a"), F.lit(length - GRAM).alias("b"))
    hashes = lambda *ends: {"k": F.xxhash64("h", *ends), "k2": F.xxhash64(*reversed(ends), "h", F.lit(1))}
    ends = lambda a, b: (F.expr(f"substring(l, 1, {a})"), F.expr(f"substring(r, 1, {length} - {b})"))
    while True:
        level = level.filter((F.length("l") >= F.col("a")) & (F.length("r") >= length - F.col("b"))).withColumns(hashes(*ends("a", "b"), F.col("a"), F.col("b")))
        size = cut(level.groupBy("k", "k2").agg(F.count("*").alias("n")).filter("n > 1"))
        level = cut(level.join(size, ["k", "k2"]))
        yield _covered(level.filter(F.col("n") <= max_group).select("k", "cls", "p", "alone", "l", "r").repartition("k").sortWithinPartitions("k"), length)
        large = level.filter(F.col("n") > max_group)
        width = F.col("b") - F.col("a") + 1
        windows = large.filter(width <= NARROW).withColumn("o", F.explode(F.sequence("a", "b"))).filter((F.length("l") >= F.col("o")) & (F.length("r") >= length - F.col("o")))
        windows = windows.withColumns(hashes(*ends("o", "o"), F.col("o"))).select("k", "k2", "cls", "p", "alone", "o")
        often = cut(windows.groupBy("k", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k", "k2"))
        found = windows.filter("alone").join(often, ["k", "k2"], "left_semi").groupBy("cls", "p").agg(F.max("o").alias("first"), F.min("o").alias("last"))
        yield found.select("cls", (F.col("p") - F.col("first")).alias("s"), (F.col("p") + length - F.col("last")).alias("e"))
        large = large.filter(width > NARROW)
        if large.isEmpty():
            return
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b")))
        level = large.withColumn("part", F.explode(halves)).select(*own, "part.*")


def repeated(src: DataFrame, *, length: int = 200, max_group: int = 50_000) -> DataFrame:
    """src(cls, text), a row for each document -> cls, spans: the stretches [s, e) of a text that are repeated (they may
    overlap and reach over its end)."""
    copies = src.groupBy("cls").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("e")).filter((F.col("n") > 1) & (F.col("e") >= length))
    met = _met(src, length, max_group)
    ctx = cut(_contexts(src, met.filter("h is not null").select("cls", "p", "h", "d", "alone", "hot"), length))
    small = ctx.filter("not hot").select(F.col("h").alias("k"), "cls", "p", "alone", "l", "r")
    found = [_covered(small.repartition("k").sortWithinPartitions("k"), length)]
    hot = ctx.filter("hot")
    if not hot.isEmpty():
        found += _split(hot, length, max_group)
    spans = met.filter("s is not null").select("cls", "s", "e").union(copies.select("cls", F.lit(0).cast("long"), "e"))
    for f in found:
        spans = spans.union(f)
    return cut(spans.groupBy("cls").agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = 200, max_group: int = 50_000) -> DataFrame:
    """One row per input row: row (all its columns, as a struct), n_bytes, n_removed, n_spans, kept_sha256, and where something
    was removed kept (the remaining bytes), kept_text (the same as text, without characters cut in two) and spans (what was
    removed, [start, end) in bytes)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).withColumn("cls", F.xxhash64("text"))
    spans = repeated(rows.select("cls", "text"), length=length, max_group=max_group)
    held = docs.sparkSession.sparkContext.broadcast(_Filter(spans, "cls"))

    @F.pandas_udf("boolean")
    def admitted(cls):
        import pandas as pd

        return pd.Series(held.value.admits(cls.to_numpy()))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        for b in batches:
            out = []
            for t, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                merged: list[dict] = []
                for s, e in sorted((x["s"], min(x["e"], len(t))) for x in found or ()):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(e, merged[-1]["end"])
                    else:
                        merged.append({"start": s, "end": e})
                kept = b"".join(t[a:z] for a, z in zip([0, *(x["end"] for x in merged)], [*(x["start"] for x in merged), len(t)], strict=True))
                less = len(merged) > 0
                out.append((len(t) - len(kept), hashlib.sha256(kept).hexdigest(), kept if less else None, kept.decode("utf-8", "ignore") if less else None, merged if less else None))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(t) for t in b.column("text").to_pylist()], pa.int64()), *(pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True))], names=["row", "n_bytes", "n_removed", "kept_sha256", "kept", "kept_text", "spans"])

    found = rows.withColumn("admitted", admitted("cls"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, kept_sha256 string, kept binary, kept_text string, spans array<struct<start:bigint,end:bigint>>"
    changed = found.filter("admitted").drop("admitted").join(spans, "cls", "left").select("row", "text", "spans").mapInArrow(remove, schema)
    same = found.filter("not admitted").select("row", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"), *(F.lit(None).cast(changed.schema[c].dataType).alias(c) for c in ("kept", "kept_text", "spans")))
    return changed.union(same).withColumn("n_spans", F.coalesce(F.size("spans"), F.lit(0)).cast("long"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: bytes covered by 200-byte strings that start elsewhere too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
