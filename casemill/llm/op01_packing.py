"""Best-fit packing of tokenised documents by the sum-of-squares rule.

An item of size s goes to the open bin (or a new one) after which the sum over residual gaps g of
(number of open bins with gap g)**2 is smallest. Sizes are whole numbers up to the capacity, so items
of one size are interchangeable: the plan is made from the histogram of sizes (at most ``capacity``
numbers), and each piece then finds its place from its number among the pieces of its size. Large
histograms are planned in digits: the plan of ``counts // f`` is repeated f times, the rest is planned
alike, so that a plan never places more than ``plan_items`` items one by one.

Defined results: a null or empty text is the end token alone; a repeated row is packed once for each
repetition; a null id is packed like any other; an empty table returns no rows. Columns besides id and
text are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.common import cut, small_batches, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Entries of a worker's table of encoded units; two such generations are kept.
CACHE = 150_000
#: White space beside a space: there, units between single spaces aren't encoded alone.
_RUNS = re.compile(r"\s | \s")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _ranked(path: str):
    """The same vocabulary as ranks: a byte-level vocabulary numbers its merges by priority, so that ids are
    ranks. It encodes short units several times faster and gives the same ids."""
    import tiktoken

    t, byte = _tokenizer(path), _byte_of()
    ranks = {bytes(byte[c] for c in k): v for k, v in t.get_vocab(with_added_tokens=False).items() if all(c in byte for c in k)}
    special = {k.content for k in t.get_added_tokens_decoder().values()}
    ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in special}
    return tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Units(dict):
    """Encoded units by text, as little-endian unsigned 32-bit ids. When full, the younger half stays."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.ranked, self.old = path, _ranked(path), {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = array("I", self.ranked.encode_ordinary(unit)).tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[unit] = ids
        return ids


@cache
def _units(path: str) -> _Units:
    return _Units(path)


def encode(text: str, path: str) -> bytes:
    """Ids of a text. The vocabulary never merges across a space between two non-spaces, so that texts
    are encoded by units (a space and what follows it), most of which have been met before."""
    units = _units(path)
    if _RUNS.search(text):
        return array("I", _tokenizer(path).encode(text, add_special_tokens=False).ids).tobytes()
    first, *rest = text.split(" ")
    return (units[first] if first else b"") + b"".join([units[" " + x] for x in rest])


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32 [, ids]: whole texts, cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(b.column("text")):
                data = encode(text.as_py() or "", path) + END_ID.to_bytes(4, "little")
                n = len(data) // 4
                first = n % capacity or capacity
                for k, s in enumerate([0, *range(first, n, capacity)]):
                    e = first if k == 0 else s + capacity
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(data[4 * s : 4 * e]))
                    if with_ids:
                        ids.append(np.frombuffer(data[4 * s : 4 * e], "<u4").astype(np.int64))
            cols = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def sum_of_squares(sizes: list[int], capacity: int, thrifty: bool = False) -> Counter[tuple[int, ...]]:
    """Bins (sizes in the order placed) and how often each occurs, after placing the sizes in turn.

    thrifty: a new bin is opened only for an item that fits no open one.
    """
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and doesn't count
    held: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    closed: Counter[tuple[int, ...]] = Counter()
    for s in sizes:
        gaps = n[s:]
        change = 2 * n[: capacity + 1 - s] + 1
        change[0] = 0
        change = np.where(gaps > 0, change - (2 * gaps - 1), 1 << 60)
        if thrifty and (gaps[:-1] > 0).any():
            change[-1] = 1 << 60
        else:
            change[-1] = 2 * n[capacity - s] + 1 if s < capacity else 0  # a new bin
        g = s + int(change.argmin())  # ties: the smallest gap
        if g < capacity:
            n[g] -= 1
            at = held[g].pop()
        else:
            at = []
        at.append(s)
        if g == s:
            closed[tuple(at)] += 1
        else:
            n[g - s] += 1
            held[g - s].append(at)
    for bins in held:
        closed.update(map(tuple, bins))
    return closed


def plan(counts: dict[int, int], capacity: int, plan_items: int = 60_000) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a bin, how many such bins) that hold ``counts`` items of each size."""
    out: Counter[tuple[int, ...]] = Counter()
    left = {s: c for s, c in counts.items() if c and s < capacity}
    if counts.get(capacity):
        out[(capacity,)] = counts[capacity]
    while left:
        f = -(-sum(left.values()) // plan_items)
        now = {s: c // f for s, c in left.items() if c >= f}
        if not now:
            f, now = 1, left
        falling = [s for s in sorted(now, reverse=True) for _ in range(now[s])]
        mixed = np.random.default_rng(7).permutation(falling).tolist()
        best = min((sum_of_squares(x, capacity, t) for x in (falling, mixed) for t in (True, False)), key=lambda c: sum(c.values()))
        for bin_, m in best.items():
            out[tuple(sorted(bin_, reverse=True))] += m * f
        left = {s: c - now.get(s, 0) * f for s, c in left.items() if c > now.get(s, 0) * f}
    return sorted(out.items())


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each size the rows (first number, slots in a bin, first sequence, first offset) of its slots."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for bin_, m in planned:
        offset = 0
        for s, k in Counter(bin_).items():
            rows.setdefault(s, []).append((taken[s], k, sequence, offset))
            taken[s] += k * m
            offset += k * s
        sequence += m
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(items: DataFrame, capacity: int, *, order: list[str], plan_items: int = 60_000, bucket_rows: int = 200_000) -> DataFrame:
    """items(length, ...) -> items with sequence_id and offset.

    ``items`` should be cheap to read twice (a written table). The histogram, at most ``capacity``
    rows, is planned on the driver. Pieces are numbered within (length, hash bucket) and the buckets'
    counts are summed up, so that a length that holds a large share of all pieces is numbered by many
    tasks of about ``bucket_rows`` rows each.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    by_size = spark.sparkContext.broadcast(places(plan(counts, capacity, plan_items)))
    buckets = max(8, -(-sum(counts.values()) // bucket_rows))
    keyed = items.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "_b").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).drop("count")
    number = F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order)) - 1
    numbered = keyed.withColumn("_n", number).join(before, ["length", "_b"]).withColumn("_n", (F.col("_n") + F.col("_before")).cast("long")).drop("_b", "_before")
    names = [c for c in numbered.columns if c != "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, n = b.column("length").to_numpy(), b.column("_n").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                first, slots, seq, off = by_size.value[int(s)].T
                at = np.searchsorted(first, n[own], side="right") - 1
                copy, slot = np.divmod(n[own] - first[at], slots[at])
                sequence[own], offset[own] = seq[at] + copy, off[at] + slot * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(names).schema)
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long").select(*items.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece, with its ids on request."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pack(cut(pieces(src, capacity, path, with_ids)), capacity, order=["doc_id", "piece", "ids_crc32"])


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
