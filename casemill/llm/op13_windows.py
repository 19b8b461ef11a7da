"""Exact removal of repeated word windows: Rabin-Karp hashes of all windows, counted by ranges of the hash.

1. A pass over the texts hashes every window of ``width`` words: each word has two random numbers of 64 bits, and a window's
   hashes are polynomials in them, taken for all windows of a block of texts from one running sum; 80 bits are kept. Of what a block
   holds twice the first place leaves for the task that counts its range of hashes, with its document's id: eleven bytes
   a window, as places and ids are compressed differences.
2. A range is counted by sorting it. Of windows that several blocks hold the first stays (smallest id, then the smallest
   start); the others are told to their blocks, as places.
3. In its block a place is a word of a text again, and windows merge into maximal intervals, which meet their texts in a
   join and leave them.

There are as many ranges as windows need to fit a task; hashes spread windows evenly, and a window that a
third of all documents share sends one row a block, not one a document. A bit table of at most 8 MB (as in the
suffix-array operator) withholds the texts of documents that surely have no repeat; results don't depend on it.
Blocks are named by partition and number: a task that runs again must read its rows in the same order, as those over tables do.

Defined results: words are split at ASCII white space, unchanged; a null text has no words. Rows that share an id are one document:
a window is a repeat if its words start at a smaller id too, or at a smaller word number in a row with the same id; rows
without an id are one document that comes last. Rows equal in id and text lose the same words. Two windows are taken for equal
if 80 bits of their hashes are: among 10^10 windows this goes wrong once in ten thousand runs. Texts shorter than a window keep all
words; an empty table returns no rows. The columns named in ``carry`` (all of the input by default) travel in one struct,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import U64, cut, mix64, small_batches, table
from casemill.llm.op06_suffix import _Filter, _powers

#: Words in a block that is hashed together, and bytes of text whose windows make up a range (a window is two bytes of text at
#: least, and about six in most languages).
BLOCK, RANGE = 800_000, 12_000_000
#: Words whose numbers a task keeps at hand.
KNOWN = 100_000
LAST = (1 << 63) - 1
CHUNK = 1 << 20


class _Numbers:
    """Two random numbers for each word."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.table = np.empty((0, 2), U64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > KNOWN:
            self.__init__()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), U64).reshape(-1, 2)
            if len(self.place) > len(self.table):
                self.table = np.concatenate([self.table[: len(self.place) - len(new)], own, np.zeros((len(self.place), 2), U64)])
            else:
                self.table[len(self.place) - len(new) : len(self.place)] = own
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def window_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all stretches of ``width`` numbers: the running sum of numbers times powers, scaled back to the start."""
    up, down = _powers()
    out = []
    for c in range(0, max(0, len(numbers) - width + 1), CHUNK):
        x = numbers[c : c + CHUNK + width - 1]
        total = np.concatenate([np.zeros(1, U64), np.cumsum(x * up[: len(x)])])
        out.append(mix64((total[width:] - total[:-width]) * down[: len(x) - width + 1]))
    return np.concatenate(out) if out else np.empty(0, U64)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, all their first bytes first."""
    return zstandard.compress(np.ascontiguousarray(np.diff(x.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _repeats(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with equal hashes: the rows that stand behind the first place by (ids, start), and those that share the first one's place."""
    order = np.argsort(hi, kind="stable")
    same = hi[order]
    same = same[1:] == same[:-1]
    some = np.zeros(len(hi), bool)
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    rows = np.flatnonzero(some)
    del order, same, some
    if not len(rows):
        return rows, rows
    rows = rows[np.lexsort((start[rows], ids[rows], lo[rows], hi[rows]))]
    a, b = rows[:-1], rows[1:]
    head = np.concatenate([[True], (hi[a] != hi[b]) | (lo[a] != lo[b])])
    first = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
    later = (ids[rows] != ids[first]) | (start[rows] != start[first])
    return rows[later], rows[~later & ~head]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: What leaves a block: for a range, hashes (hi, lo), places among the block's windows, and ids and first places of their rows; and once for
#: a block digests, ids and first places of all rows, with the places that the block itself finds repeated.
SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("digests", pa.binary()), ("at", pa.binary()), ("ids", pa.binary()), ("bases", pa.binary())])
TOLD = pa.schema([f for f in SENT if f.name not in ("range", "hi", "lo")])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spark(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _blocks(src: DataFrame, width: int, ranges: int) -> DataFrame:
    """src(doc, digest, text) -> SENT."""

    def settle(block: int, held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[:2])
        ids, digests = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
        size = np.array([len(x[2]) - width + 1 for x in held], np.int64)
        bases = np.cumsum(size) - size
        hi = np.concatenate([window_hashes(x[2][:, 0], width) for x in held])
        lo = np.concatenate([(window_hashes(x[2][:, 1], width) >> U64(48)).astype(np.uint16) for x in held])
        row = np.repeat(np.arange(len(held), dtype=np.int32), size)
        start = np.arange(len(hi)) - bases[row]
        behind, again = _repeats(hi, lo, ids[row], start)
        keep = np.ones(len(hi), bool)
        keep[behind] = keep[again] = False
        del start
        at = ((hi >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int32)
        order = np.flatnonzero(keep)
        order = order[np.argsort(at[order], kind="stable")]
        out = [(block % ranges, block, None, None, digests.tobytes(), _pack(np.sort(behind)), _pack(ids), _pack(bases))]
        for k in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else ():
            own = np.unique(row[k])
            out.append((int(at[k[0]]), block, hi[k].tobytes(), lo[k].tobytes(), None, _pack(k), _pack(ids[own]), _pack(bases[own])))
        for c in range(0, len(out), 64):
            yield _batch(SENT, out[c : c + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block, numbers = [], 0, TaskContext.get().partitionId() << 32, _Numbers()
        for b in batches:
            for doc, digest, text in zip(*(b.column(c) for c in ("doc", "digest", "text")), strict=True):
                words = text.as_py().split()
                if len(words) < width:
                    continue
                if held and n + len(words) > BLOCK:
                    yield from settle(block, held)
                    held, n, block = [], 0, block + 1
                held.append((doc.as_py(), digest.as_py(), numbers(words)))
                n += len(words)
        if held:
            yield from settle(block, held)

    return src.mapInArrow(run, _spark(SENT))


def _counted(sent: DataFrame, ranges: int) -> DataFrame:
    """SENT -> TOLD: what blocks have sent of themselves, and for each the places that a range finds repeated."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hi = np.concatenate([np.frombuffer(r[1], U64) for r in rows])
        lo = np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows])
        ids, start, n = [], [], [len(r[2]) // 2 for r in rows]
        for _, _, _, at, doc, base in rows:
            at, doc, base = _unpack(at), _unpack(doc), _unpack(base)
            row = np.searchsorted(base, at, "right") - 1
            ids.append(doc[row])
            start.append((at - base[row]).astype(np.int32))
        behind = np.sort(_repeats(hi, lo, np.concatenate(ids), np.concatenate(start))[0])
        ends = np.cumsum(n)
        of = np.searchsorted(ends, behind, "right")
        out = []
        for k in np.split(np.arange(len(behind)), np.flatnonzero(np.diff(of)) + 1) if len(behind) else ():
            r = rows[of[k[0]]]
            out.append((r[0], None, _pack(_unpack(r[3])[behind[k] - (ends[of[k[0]]] - n[of[k[0]]])]), None, None))
        if out:
            yield _batch(TOLD, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            own = b.filter(pa.compute.is_valid(b.column("digests")))
            if own.num_rows:
                yield own.select(TOLD.names)
            b = b.filter(pa.compute.is_null(b.column("digests")))
            for k, *r in zip(*(b.column(c).to_pylist() for c in ("range", "block", "hi", "lo", "at", "ids", "bases")), strict=True):
                if held and k != last:
                    yield from settle(held)
                    held = []
                held.append(tuple(r))
                last = k
        if held:
            yield from settle(held)

    return sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(run, _spark(TOLD))


def _intervals(told: DataFrame, width: int) -> DataFrame:
    """TOLD -> doc, digest, spans: maximal intervals of words that repeated windows cover, for each row that has some."""

    def settle(digests: bytes, ids: bytes, bases: bytes, at: list[bytes]) -> Iterator[pa.RecordBatch]:
        digest, doc, base = np.frombuffer(digests, np.int64), _unpack(ids), _unpack(bases)
        place = np.sort(np.concatenate([_unpack(x) for x in at]))
        if not len(place):
            return
        row = np.searchsorted(base, place, "right") - 1
        start = place - base[row]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row) > 0) | (np.diff(start) > width)]))
        last = np.append(first[1:], len(place)) - 1
        groups = np.flatnonzero(np.concatenate([[True], np.diff(row[first]) > 0]))
        spans = pa.ListArray.from_arrays(pa.array(np.append(groups, len(first)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start[first]), pa.array(start[last] + width)], ["start", "end"]))
        own = row[first][groups]
        yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(digest[own]), spans.cast(SPANS)], names=["doc", "digest", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, at = None, None, []
        for b in batches:
            for k, digests, place, ids, bases in zip(*(b.column(c).to_pylist() for c in TOLD.names), strict=True):
                if own and k != block:
                    yield from settle(*own, at)
                    own, at = None, []
                block = k
                own = own or (digests, ids, bases)  # the row with digests comes first
                at.append(place)
        if own:
            yield from settle(*own, at)

    return told.repartition("block").sortWithinPartitions("block", F.col("digests").isNull()).mapInArrow(run, "doc long, digest long, spans array<struct<start:bigint,end:bigint>>")


def repeated_windows(src: DataFrame, *, width: int) -> DataFrame:
    """src(doc, digest, text) -> doc, digest, spans: words [start, end) that windows cover whose words start earlier too (rows equal in
    doc and digest bring theirs together, so that spans may come twice)."""
    n = src.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = max(src.sparkSession.sparkContext.defaultParallelism, -(-n // RANGE))
    found = _intervals(_counted(_blocks(src, width, ranges), ranges), width)
    return cut(found.groupBy("doc", "digest").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def remove_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: row (the columns ``carry``, as a struct), n_words, n_removed, kept_sha256 (of the kept words, joined by one
    space), and where something was removed kept_text and spans ([start, end) in words)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))
    marks = repeated_windows(rows.select("doc", "digest", "text"), width=width).withColumn("key", F.xxhash64("doc", "digest"))
    held = docs.sparkSession.sparkContext.broadcast(_Filter(marks, "key"))

    @F.pandas_udf("boolean")
    def admitted(key):
        import pandas as pd

        return pd.Series(held.value.admits(key.to_numpy()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array([z.compress(t) for t in b.column(i).to_pylist()], pa.binary()))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            packed = "spans" in b.schema.names
            marks = b.column("spans").to_pylist() if packed else [None] * b.num_rows
            for t, found in zip(b.column("text").to_pylist(), marks, strict=True):
                words = (z.decompress(t) if packed else t).split()
                keep = np.ones(len(words), bool)
                spans = sorted({(x["start"], x["end"]) for x in found or ()})
                for a, e in spans:
                    keep[a:e] = False
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)] if spans else words)
                out.append((len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if spans else None, [{"start": a, "end": e} for a, e in spans] or None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), SPANS)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True))], names=["row", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:bigint,end:bigint>>"
    found = rows.withColumn("admitted", admitted(F.xxhash64("doc", "digest")))
    texts = found.filter("admitted").select("row", "doc", "digest", "text").mapInArrow(pack, rows.select("row", "doc", "digest", "text").schema)
    changed = texts.join(marks.drop("key"), ["doc", "digest"], "left").select("row", "text", "spans").mapInArrow(remove, schema)
    return changed.union(found.filter("not admitted").select("row", "text").mapInArrow(remove, schema))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words covered by windows of 20 words that start earlier too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_windows(docs, carry=["doc_id"]).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
