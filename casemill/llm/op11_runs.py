"""Runs of repeated words (aaaa, abababab, ...) by convolution of blocks, at dyadic scales.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that is at least
``exponent`` periods and ``least`` words long and that no neighbouring word extends. With an exponent of at least four:

1. words that occur fewer than four times between two others like that can't be in a run: they cut the
   texts of a batch into segments, and most of the words are out before any convolution;
2. at scale L = 1, 2, 4, ... segments are cut into aligned blocks of L words. A run with a period of L to 2L - 1
   holds two neighbouring blocks at least whose next occurrence, a period further on, is in the run too. For each block
   the sums of squared differences to all places L to 2L - 1 words further on are sums of squares less twice a
   correlation, taken by number-theoretic transforms of 2L words over the integers modulo ``PRIME``. Word numbers
   are dense in a segment, so that sums stay below the prime for segments up to some thousand words and
   a zero is an exact match; in longer ones a zero could be false, and the extension, which compares words, drops it;
3. zeros of one distance in neighbouring blocks are a seed; it is extended word by word, by less than a block on each side.
   Distances inside a run found at a smaller scale are multiples of its period and are left out.

Texts never leave the partition they are read in: the work is one pass, without a shuffle. The time for a
text grows with n * log(n)^2 in its words between rare ones.

Defined results: words are split at ASCII white space only, unchanged; a null or empty text has no words, no run and
an empty collapsed text; equal texts and rows with equal ids are judged one by one; an empty table
returns no rows; the columns named in ``carry`` (all of the input by default) travel in one struct, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import U64, small_batches, table

#: 15 * 2^27 + 1: transforms of up to 2^27 words; products fit 64 bits.
PRIME, GENERATOR = 2013265921, 31
#: Words in the blocks that are transformed together.
TOGETHER = 1 << 16
#: The least exponent that the seeds are complete for.
LEAST_EXPONENT = 4


@cache
def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n - 1 of a root of unity of order 2n."""
    w = pow(GENERATOR, (PRIME - 1) // (2 * n), PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(w, len(out), PRIME)) % U64(PRIME)])
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in bit-reversed order."""
    rows, n = x.shape
    p, h = U64(PRIME), n // 2
    while h:
        v = x.reshape(rows, -1, 2, h)
        a, b = v[:, :, 0], v[:, :, 1]
        x = np.stack([(a + b) % p, (a + p - b) * _roots(h, False) % p], axis=2).reshape(rows, n)
        h //= 2
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    """What ``transform`` was given."""
    rows, n = x.shape
    p, h = U64(PRIME), 1
    while h < n:
        v = x.reshape(rows, -1, 2, h)
        a, b = v[:, :, 0], v[:, :, 1] * _roots(h, True) % p
        x = np.stack([(a + b) % p, (a + p - b) % p], axis=2).reshape(rows, n)
        h *= 2
    return x * U64(pow(n, -1, PRIME)) % p


def _matches(y: np.ndarray, blocks: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every occurrence of a block of ``size`` words at distances size to 2 * size - 1
    in its segment, whose end is given for each block."""
    squares = np.concatenate([np.zeros(1, np.int64), np.cumsum(y * y)])
    reach = np.arange(2 * size)
    starts, distances = [], []
    for k in range(0, len(blocks), step := max(1, TOGETHER // size)):
        b, e = blocks[k : k + step], ends[k : k + step]
        block = np.zeros((len(b), 2 * size), U64)
        block[:, -reach[:size]] = y[b[:, None] + reach[:size]]  # backwards: the product is a correlation
        window = y[np.minimum(b[:, None] + size + reach, len(y) - 1)].astype(U64)
        cross = inverse(transform(block) * transform(window) % U64(PRIME))[:, :size].astype(np.int64)
        at = b[:, None] + size + reach[:size]
        inside = at + size <= e[:, None]
        there = np.minimum(at, len(y) - size)
        total = squares[b + size][:, None] - squares[b][:, None] + squares[there + size] - squares[there] - 2 * cross
        row, shift = np.nonzero(inside & (total % PRIME == 0))
        starts.append(b[row])
        distances.append(shift + size)
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, distances))


def _extent(y: np.ndarray, at: np.ndarray, distance: np.ndarray, limit: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many words in a row from ``at`` on (step 1: forwards, -1: backwards) equal the one at a distance; at most ``limit``."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        rest = []
        for k in range(0, len(live), chunk := max(1, (1 << 18) // width)):
            own = live[k : k + chunk]
            t = out[own][:, None] + np.arange(width)
            i = at[own][:, None] + step * np.minimum(t, limit[own][:, None] - 1)
            differ = (t >= limit[own][:, None]) | (y[i] != y[i + distance[own][:, None]])
            n = np.where(differ.any(1), differ.argmax(1), width)
            out[own] += n
            rest.append(own[n == width])
        live = np.concatenate(rest)
    return out


def find_runs(y: np.ndarray, first: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of the runs in the segments of word numbers y that begin at ``first``."""
    if len(y) == 0:
        return np.empty((0, 3), np.int64)
    ends = np.append(first[1:], len(y))
    segment = np.repeat(np.arange(len(first)), ends - first)
    found: list[np.ndarray] = []
    covered = np.zeros(len(y), np.int64)  # at its start, the furthest end of a run
    size, longest = 1, int((ends - first).max())
    while exponent * size <= longest:
        b = np.arange(0, len(y), size)
        s = segment[b]
        own = (ends[s] - b >= 2 * size) & (ends[s] - first[s] >= max(least, exponent * size))
        b, d = _matches(y, b[own], ends[s[own]], size)
        known = np.maximum.accumulate(covered)
        fresh = b + d + size > known[b]
        b, d = b[fresh], d[fresh]
        order = np.lexsort((b, d))
        b, d = b[order], d[order]
        if len(b):
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1] + size)])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(b)))
            head, n = head[n >= 2], n[n >= 2]
            a, z, q = b[head], b[head + n - 1] + size, d[head]
            s = segment[a]
            back = _extent(y, a - 1, q, a - first[s], -1, size)
            on = _extent(y, z, q, ends[s] - z - q, 1, size)
            runs = np.stack([a - back, z + on + q - a + back, q], 1)
            runs = np.unique(runs[runs[:, 1] >= np.maximum(least, exponent * q)], axis=0)
            found.append(runs)
            np.maximum.at(covered, runs[:, 0], runs[:, 0] + runs[:, 1])
        size *= 2
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def _segments(numbers: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of texts (-1: too rare for a run) -> y, first, and of each segment its text and its place there."""
    size = np.array([len(n) for n in numbers], np.int64)
    x = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    keep = x >= 0
    for _ in range(4):  # any number of rounds is right: each leaves less to convolve
        x, text, place = x[keep], text[keep], place[keep]
        if not len(x):
            break
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])
        s = np.cumsum(new) - 1
        _, number, n = np.unique(s * (int(x.max()) + 1) + x, return_inverse=True, return_counts=True)
        keep = (n[number] >= LEAST_EXPONENT) & (np.bincount(s)[s] >= least)
        if keep.all():
            first = np.flatnonzero(new)
            return number - np.minimum.reduceat(number, first)[s], first, text[first], place[first]
    if not len(x):
        return x, x, x, x
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(new)
    number = np.unique(x, return_inverse=True)[1]
    return number, first, text[first], place[first]


def runs_of(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"exponent {exponent} is less than {LEAST_EXPONENT}")
    numbers, own = [], []
    for k, words in enumerate(texts):
        often = [w for w, n in Counter(words).items() if n >= LEAST_EXPONENT] if len(words) >= least else []
        if often:
            number = dict(zip(often, range(len(often)), strict=True))
            numbers.append(np.fromiter((number.get(w, -1) for w in words), np.int64, len(words)))
            own.append(k)
    y, first, text, place = _segments(numbers, least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, n, q in find_runs(y, first, exponent, least).tolist():
        s = int(np.searchsorted(first, a, "right")) - 1
        out[own[text[s]]].append((a - int(first[s]) + int(place[s]), n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for a, n, q in runs:
        keep[a + q : a + n] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per input row: row (the columns ``carry``, as a struct), n_words, runs (start, length, period by start, then period)
    and collapsed, the words outside of the repetitions joined by one space."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.col(text_col).cast("binary").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or b"").split() for t in b.column("text").to_pylist()]  # bytes are split at ASCII white space
            runs = runs_of(texts, exponent, least)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], run_type),
                    pa.array([b" ".join(collapse(t, r)) for t, r in zip(texts, runs, strict=True)], pa.binary()),
                ],
                names=["row", "n_words", "runs", "collapsed"],
            )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    return rows.mapInArrow(work, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: str, text: str) -> Column:
    """The text, or for ids whose crc32 is divisible by ten its words with a repetition from some word to the end (without an id: the text)."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: runs of at least six words and four periods in all documents, a tenth of them with a planted repetition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted("doc_id", "text").alias("text"))
    found = periodic_runs(docs, carry=["doc_id"])
    # exact fractions: length / period of both, cross-multiplied
    first = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).when(x["length"] * y["period"] < y["length"] * x["period"], 1).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    best = F.get(F.array_sort("runs", first), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
