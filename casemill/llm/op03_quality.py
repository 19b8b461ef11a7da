"""Quality by weak labels: overlapping heuristic labellers, expectation maximisation, a hashed scorer.

Eight labellers vote good, bad or nothing on a text from its whole content. How often each vote occurs
given the true class is unknown; expectation maximisation over the counts of vote patterns (at most 3**8 rows)
estimates it together with the share of good texts (bad votes on good texts are bounded by
``FALSE_ALARM``), and gives every pattern a posterior. The posteriors
are soft labels for a logistic scorer on hashed word shapes (letters, digits and runs folded; words over ``LONG``
bytes also give windows that cover all of their shape, so that texts without white space are read whole), fitted in one task
on a bounded sample (``max_docs`` documents by a hash of their ids) and applied to every text. No human label is
used.

Defined results: null and empty texts have no shape, posterior and score 0, and aren't kept; repeated rows count
and are scored as often as they occur; with fewer than two vote patterns the prior of good is 0.5 or what
the majority says; an empty table returns no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import cut, small_batches, table

ROWS = 1 << 16
LABELLERS = ("symbols", "capitals", "echoes", "variety", "bare signs", "word length", "tails", "density")
GOOD, BAD, NONE = 1, 0, 2
#: Highest rate of bad votes on good texts.
FALSE_ALARM = 0.001
#: Words of a text among which repeats are counted; longer texts are dealt into blocks of at most so many.
SPAN = 3000
#: Bytes beyond which a word gives windows of its shape too, their width and step.
LONG, WIDTH, STEP = 64, 8, 4
#: A-Z to A, a-z and non-ASCII bytes to a, digits to 0.
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))

_BARE = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
_TAIL = re.compile(rb"\S[^aA0\s]{2}(?!\S)")
_RUN = re.compile(rb"(.)\1{2,}", re.S)


def _vote(x: float, good: float, bad: float) -> int:
    """good if x is on the good side of ``good``, bad beyond ``bad``, else nothing."""
    if good < bad:
        return GOOD if x <= good else BAD if x >= bad else NONE
    return GOOD if x >= good else BAD if x <= bad else NONE


def variety(words: list[bytes]) -> float:
    """Share of distinct words within consecutive blocks."""
    step = -(-len(words) // -(-len(words) // SPAN))
    return sum(len(set(words[i : i + step])) for i in range(0, len(words), step)) / len(words)


def votes(text: bytes) -> list[int]:
    """One vote for each labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return [BAD] * len(LABELLERS)
    size = len(text)
    shape = text.translate(_SHAPE)
    upper, lower = shape.count(b"A"), shape.count(b"a")
    signs = len(shape.translate(None, b"aA0 \t\n\r\x0b\x0c"))
    bare = len(_BARE.findall(text))
    tails = len(_TAIL.findall(shape))
    echoes = sum(map(eq, words, islice(words, 1, None)))
    return [
        _vote(signs / size, 0.06, 0.12) if size >= 60 else NONE,
        _vote(upper / max(1, upper + lower), 0.15, 0.4) if size >= 60 else NONE,
        _vote(echoes / n, 0.03, 0.12),
        _vote(variety(words), 0.35, 0.15) if n >= 30 else NONE,
        _vote(bare / n, 0.02, 0.1),
        _vote(size / n - 1, 9, 14),
        _vote(tails / n, 0.03, 0.1),
        _vote(len(zlib.compress(text, 1)) / size, 0.32, 0.2) if size > 200 else NONE,
    ]


def pattern(text: bytes | None) -> int:
    """The votes as one number."""
    return sum(v * 3**i for i, v in enumerate(votes(text or b"")))


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good by pattern, accuracies (labeller x class x vote), and the share of good."""
    keys = sorted(counts)
    v = np.array([[k // 3**i % 3 for i in range(len(LABELLERS))] for k in keys], int).reshape(-1, len(LABELLERS))
    n = np.array([counts[k] for k in keys], float)
    # start: texts with no bad vote are good; no vote says nothing, here and later
    p = np.where((v == BAD).any(1), 0.05, 0.95)
    told, prior = np.ones((len(LABELLERS), 2, 3)), 0.5
    for _ in range(rounds):
        prior = float((n * p).sum() + 1) / float(n.sum() + 2)
        for c, w in ((GOOD, n * p), (BAD, n * (1 - p))):
            for x in (GOOD, BAD):
                told[:, c, x] = (w[:, None] * (v == x)).sum(0) + 0.5
            told[:, c, :2] /= told[:, c, :2].sum(1, keepdims=True)
        # labellers are made to be silent on good texts; without this bound, those that are alone in
        # what they see would be taken for noise
        told[:, GOOD, BAD] = np.minimum(told[:, GOOD, BAD], FALSE_ALARM)
        told[:, GOOD, GOOD] = 1 - told[:, GOOD, BAD]
        log = [np.log(told[np.arange(len(LABELLERS)), c, v]).sum(1) for c in (BAD, GOOD)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -50, 50)))
        done, p = np.allclose(new, p, atol=1e-9), new
        if done:
            break
    return dict(zip(keys, p.tolist(), strict=True)), told, prior


class _Rows(dict):
    """Row of a word's shape, runs of more than two equal signs folded to two."""

    def __missing__(self, shape: bytes) -> int:
        row = xxhash.xxh3_64_intdigest(_RUN.sub(rb"\1\1", shape)) >> 48
        if len(self) < 100_000 and len(shape) <= LONG:
            self[shape] = row
        return row


_rows = _Rows()


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a text's hashed shapes (square roots of their shares), and of repeats of the word before."""
    words = text.split() if text else ()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    seen: Counter[int] = Counter()
    size = len(words)
    for shape, c in Counter(text.translate(_SHAPE).split()).items():
        seen[_rows[shape]] += c
        if len(shape) > LONG:
            folded = _RUN.sub(rb"\1\1", shape)
            starts = range(0, max(1, len(folded) - WIDTH + STEP), STEP)
            size += c * len(starts)
            for w, m in Counter(folded[i : i + WIDTH] for i in starts).items():
                seen[_rows[b"\x02" + w]] += c * m
    if echoes := sum(map(eq, words, islice(words, 1, None))):
        seen[_rows[b"\x01echo"]] += echoes
    n = len(seen)
    return np.fromiter(seen, np.int64, n), np.sqrt(np.fromiter(seen.values(), float, n) / size)


def fit_scorer(texts: list[bytes], y: np.ndarray, rounds: int = 12, rate: float = 0.5) -> np.ndarray:
    """Weights of the hashed scorer (the last is the constant), by Adagrad on the soft labels."""
    w, seen = np.zeros(ROWS + 1), np.full(ROWS + 1, 1e-2)
    rows = [features(t) for t in texts]
    rng = np.random.default_rng(4)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            r, x = rows[i]
            r, x = np.append(r, ROWS), np.append(x, 1.0)
            g = (1 / (1 + np.exp(-np.clip((w[r] * x).sum(), -50, 50))) - y[i]) * x
            np.add.at(seen, r, g * g)
            np.add.at(w, r, -rate * g / np.sqrt(seen[r]))
    return w


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 6000) -> DataFrame:
    """One row per input row: doc_id, n_good, n_bad, posterior, score, kept (score of at least 0.5)."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter(pattern(t.as_py()) for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["pattern", "n"])

    counts = {r["pattern"]: r["n"] for r in src.mapInArrow(vote, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, _, prior = expectation_maximisation(counts)
    n = sum(counts.values())
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = src.filter(place < min(1.0, max_docs / max(1, n))).filter(F.length("text") > 0)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            t = t.take(pa.array(np.argsort(t.column("doc_id").to_numpy(), kind="stable")))
            texts = t.column("text").to_pylist()
            w = fit_scorer(texts, np.array([posterior.get(pattern(x), prior) for x in texts]))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    found = cut(sample.repartition(1).mapInArrow(train, "w binary")).first()
    held = spark.sparkContext.broadcast(np.frombuffer(found["w"]) if found else np.zeros(ROWS + 1))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            good, bad, post, score = [], [], [], []
            for t in b.column("text"):
                text = t.as_py()
                v = votes(text)
                rows, x = features(text)
                good.append(v.count(GOOD)), bad.append(v.count(BAD))
                post.append(posterior.get(sum(a * 3**i for i, a in enumerate(v)), prior) if len(rows) else 0.0)
                score.append(1 / (1 + np.exp(-np.clip((w[rows] * x).sum() + w[ROWS], -50, 50))) if len(rows) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(good, pa.int32()), pa.array(bad, pa.int32()), pa.array(post, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_good", "n_bad", "posterior", "score"])

    return src.mapInArrow(apply, "doc_id long, n_good int, n_bad int, posterior double, score double").withColumn("kept", F.col("score") >= 0.5)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label quality of all documents."""
    return quality(table(spark, sf_dir, "documents"))
