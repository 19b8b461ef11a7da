"""Approximate nearest neighbours by multi-index hashing.

Vectors are mapped so that the order of inner products is an order of angles (scaled by the largest norm,
with one coordinate that completes them to unit length), centred, and turned by learned rotations
(principal axes, then iterated quantisation, from four starts) into binary codes of 256 bits. Codes are split into
substrings of 16 bits and each substring has its own index: for each value, the rows that have it. By the pigeonhole
principle a code within Hamming radius r of a query agrees with it in at least one of the m substrings up to
floor(r / m) bits: probing all values within that distance in every index retrieves every code within r. Where
that would look up more values than a block has codes, the codes themselves are read instead, with the same
result. Retrieved codes are checked against r in full, and only what lies within it is reranked by exact inner products
of the original vectors, summed in one fixed order, so that equal vectors have equal scores.

The largest norm is that of all rows. Rotations and radius are fitted on a bounded sample (``sample`` rows
by a hash of the row, and the LONGEST longest); the radius is the distance within which the sample's own nearest neighbours lie for a
``recall`` share. A query that finds fewer than k within it, or whose k best lie so near to the radius that others
may lie beyond (mean and ``SAFE`` deviations of their distances), is searched again among all rows. All rows are indexed.
Rows are dealt into blocks of about ``block`` and queries into blocks too: a task meets one block of
each, and returns the best k of each query from its block.

How much is read depends on the data: vectors without structure have no near neighbours, so that the radius that
recall asks for makes probing read all codes (not vectors); clustered vectors are found by probing few values.

Defined results: vectors that are null, empty, zero, non-finite in a component, or of another than the most
frequent dimension take no part, neither as queries nor as candidates; every row is a vector of its own,
also when ids repeat; ties in the score go to the smaller id; a query returns fewer than k rows only if there are
fewer candidates, and then all of them; an empty table returns no rows. Columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.common import cut, table
from casemill.llm.vectors import matrix, numbered

BITS, TURNS, PARTS = 256, 4, 16
WORDS, WIDTH = BITS // 64, BITS // PARTS
#: Deviations by which the distances of a query's k best must stay below the radius.
SAFE = 3.0
#: Rows of greatest length in the sample.
LONGEST = 64


@cache
def _masks(distance: int) -> np.ndarray:
    """All values of a substring with at most so many bits set."""
    v = np.arange(1 << WIDTH, dtype=np.uint32)
    return v[np.bitwise_count(v) <= distance]


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances of codes (one row for each word of 64 bits) to one code."""
    out = np.bitwise_count(codes[0] ^ code[0]).astype(np.int16)
    for w in range(1, WORDS):
        out += np.bitwise_count(codes[w] ^ code[w])
    return out


@dataclass
class Coder:
    """Largest norm, centre, projection to the code's axes, and the probing radius."""

    norm: float
    centre: np.ndarray
    axes: np.ndarray
    radius: int = BITS

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        y = x / self.norm
        return np.hstack([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1)))[:, None]])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes, a row for each word of 64 bits."""
        at = self.lift(x, query)
        if not query:  # a query's inner products with centred rows have the same order
            at = at - self.centre
        return np.ascontiguousarray(np.packbits(at @ self.axes > 0, axis=1).view(np.uint64).T)


def fit(x: np.ndarray, *, norm: float, k: int, recall: float, rounds: int = 30, probes: int = 300) -> Coder:
    """Learn the rotation and the radius from a sample of vectors; no vector is longer than ``norm``."""
    norm *= 1.000001
    coder = Coder(norm, np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, BITS)))
    y = coder.lift(x, False)
    coder.centre = y.mean(0)
    rng = np.random.default_rng(3)
    _, vectors = np.linalg.eigh(np.cov((y - coder.centre).T))
    n = BITS // TURNS
    base = vectors[:, ::-1][:, :n]
    if base.shape[1] < n:  # fewer axes than bits: further random directions
        base = np.hstack([base, rng.standard_normal((len(base), n - base.shape[1])) / np.sqrt(len(base))])
    v = (y - coder.centre) @ base
    turns = []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        turns.append(base @ turn)
    coder.axes = np.hstack(turns)
    if len(x) > 20 * k:
        q = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)
        scores = x[q] @ x.T
        scores[np.arange(len(q)), q] = -np.inf
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        codes, asked = coder.codes(x), coder.codes(x[q], True)
        far = np.stack([distances(codes[:, best[i]], asked[:, i]) for i in range(len(q))])
        coder.radius = int(np.quantile(far, recall, method="higher"))
    return coder


class Block:
    """One block of rows with an index for each substring: rows in the order of their values, and where each value starts."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, x: np.ndarray, coder: Coder):
        self.rid, self.ids, self.x, self.coder = rid, ids, x, coder
        self.codes = coder.codes(x)
        self.masks = _masks(min(WIDTH, coder.radius // PARTS))
        self.index = []
        if PARTS * len(self.masks) < len(x):
            for value in self.parts(self.codes):
                self.index.append((np.argsort(value, kind="stable"), np.searchsorted(np.sort(value), np.arange((1 << WIDTH) + 1))))

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """Substrings, a row for each part."""
        return np.ascontiguousarray(codes.T).view(np.uint16).T

    def search(self, rid: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best k within the radius."""
        if self.index:
            rows = np.unique(np.concatenate([self.probe(p, int(v)) for p, v in enumerate(self.parts(code[:, None])[:, 0])]))
            rows = rows[self.far(rows, code) <= self.coder.radius]
        else:
            rows = np.flatnonzero(distances(self.codes, code) <= self.coder.radius)
        return self.best(rows, rid, q, k)

    def probe(self, part: int, value: int) -> np.ndarray:
        """Rows whose substring is within the probing distance of a value."""
        order, start = self.index[part]
        v = self.masks ^ np.uint32(value)
        a, n = start[v], start[v + 1] - start[v]
        a, n = a[n > 0], n[n > 0]
        return order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else order[:0]

    def far(self, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hamming distances of rows."""
        return distances(self.codes[:, rows], code)

    def scan(self, rid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the best k of each query among all rows."""
        for s in range(0, len(q), 128):
            score = q[s : s + 128] @ self.x.T
            least = np.partition(score, -min(k + 1, len(self.x)), axis=1)[:, -min(k + 1, len(self.x))]
            least -= 1e-9 * np.abs(score).max(1)
            for j, row in enumerate(score):
                yield self.best(np.flatnonzero(row >= least[j]), rid[s + j], q[s + j], k)

    def best(self, rows: np.ndarray, rid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.rid[rows] != rid]
        score = (self.x[rows] * q).sum(axis=1)  # row by row in one order, whatever stands beside a row
        if len(rows) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def nearest(df: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample: int = 10_000, recall: float = 0.999, block: int = 16384, query_block: int = 1024) -> DataFrame:
    """The rows of ``df`` for which ``queries`` holds, each with its k nearest found among all others:
    query_id, rank, vec_id, score. ``queries`` may use the columns id and vec."""
    spark = df.sparkSession
    rows = cut(numbered(df, id_col, vec_col).filter("ok").select("rid", "id", "vec", F.size("vec").alias("dim")))
    empty = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], empty)
    n = dims["count"]
    rows = rows.filter(F.col("dim") == dims["dim"]).select("rid", "id", "vec")
    # the longest rows are the first that inner products find: a few of them are in every sample
    long = matrix(rows.orderBy(F.desc(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)), "rid").limit(LONGEST).select("vec").toArrow().column("vec"))
    longest = float(np.linalg.norm(long, axis=1).max())
    place = F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    x = matrix(rows.filter(place < min(1.0, sample / n)).select("vec").toArrow().column("vec"))
    x = np.concatenate([x, long]) if len(x) else long
    coder = spark.sparkContext.broadcast(fit(x, norm=longest, k=k, recall=recall))
    n_blocks = -(-n // block)
    packed = lambda d, m, name: d.groupBy(F.pmod(F.xxhash64("rid"), F.lit(m)).cast("int").alias(name)).agg(F.collect_list(F.struct("rid", "id", "vec")).alias(name + "_rows"))
    asked = rows.filter(queries)
    b = packed(rows, n_blocks, "b")
    columns = ["rid", "query_id", "vec_id", "score", "far"]

    def search(asked: DataFrame, whole: bool) -> DataFrame:
        """The k best of each query, with their Hamming distances; ``whole``: among all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, index = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    if batch.column("b")[i].as_py() != held:
                        held, r = batch.column("b")[i].as_py(), batch.column("b_rows")[i].values
                        index = Block(r.field("rid").to_numpy(), r.field("id").to_numpy(zero_copy_only=False), matrix(r.field("vec")), coder.value)
                    r = batch.column("q_rows")[i].values
                    rid, ids, vec = r.field("rid").to_numpy(), r.field("id").to_numpy(zero_copy_only=False), matrix(r.field("vec"))
                    codes, out = coder.value.codes(vec, True), []
                    found = index.scan(rid, vec, k) if whole else (index.search(rid[j], vec[j], codes[:, j], k) for j in range(len(rid)))
                    for j, (at, score) in enumerate(found):
                        out.append((np.full(len(at), rid[j]), np.full(len(at), ids[j]), index.ids[at], score, index.far(at, codes[:, j]).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=columns)

        q = packed(asked, max(1, -(-asked.count() // query_block)), "q").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        found = b.join(q, "b").select("b", "b_rows", "q_rows").mapInArrow(run, "rid long, query_id long, vec_id long, score double, far long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")))
        return ranked.filter(F.col("rank") <= k)

    radius = coder.value.radius
    result = search(asked, radius >= BITS)
    if radius < BITS:
        first = cut(result)
        safe = cut(first.groupBy("rid").agg(F.count("*").alias("n"), (F.mean("far") + SAFE * F.stddev_pop("far")).alias("reach")).filter((F.col("n") >= k) & (F.col("reach") <= radius)).select("rid"))
        again = search(asked.join(safe, "rid", "left_anti").select(asked.columns), True)
        result = first.join(safe, "rid", "left_semi").select(again.columns).unionByName(again)
    return result.select("query_id", "rank", "vec_id", "score")


def op7_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
