"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The most frequent training words are classes of
their own, every other word belongs to a class by the hash of its last three bytes, and the end of a text is a class.
P(class | history) is a log-linear model over hashed features: the previous word, the word before it and the
one before that (skips), the pair of the two previous classes and the pair of the two previous words. P(word | class) comes from all training counts with
0.1 added, and one place for unknown words in each class, so that the model sums to one over known words and unknown
classes.

Training covers every training document: word counts are aggregated exactly, and the weights are trained by
distributed gradient updates: in each of ``rounds`` rounds every task starts from the broadcast weights, makes
Adagrad steps on its share of documents (each document belongs to one round), and the tasks' weights are
averaged. Scoring runs in numpy batches of gathered weight rows. Words above a ``FREQUENT`` share of all tokens are
looked up in a broadcast table (at most 1 / FREQUENT words); the others meet their counts in a join on the word hash.

Defined results: a null or empty text is its end token alone; without training texts, N and V are 0 and every
token is unknown; repeated rows train and are scored as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import U64, bucket_of, cut, small_batches, table

SINGLE, SUFFIX = 47, 48
CLASSES = SINGLE + SUFFIX + 1
END_CLASS = CLASSES - 1
BUCKETS, PAIRS = 4096, 16_384
FEATURES = 5
#: First row of each feature in the weight table: three words back, pair of classes, pair of words.
OFFSETS = np.arange(FEATURES) * BUCKETS
ROWS = (FEATURES - 1) * BUCKETS + PAIRS
FREQUENT = 3e-6
ADD = 0.1
#: Hash that stands for the end token among words (which never contain white space).
END = xxhash.xxh3_64_intdigest(b" end ")
#: Tokens that share a gradient step; rows of classes that are worked on at once, so that they stay in the cache; bytes of text split at once.
STEP, BLOCK, PIECE = 4096, 512, 1 << 20
#: Logits within these bounds need no shift before exponentials are summed in single precision.
SAFE = 60


def suffix_classes(words: pa.Array) -> np.ndarray:
    """Classes of words that aren't classes of their own."""
    ends = pc.binary_slice(words, -3).dictionary_encode()
    return (SINGLE + word_hashes(ends.dictionary) % U64(SUFFIX)).astype(np.int64)[ends.indices.to_numpy()]


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False).tolist()), U64, len(words))


@dataclass
class Vocabulary:
    """Frequent words (sorted hashes, counts, classes) and totals, overall and by class."""

    h: np.ndarray
    c: np.ndarray
    cls: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if not frequent."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        return np.where(self.h[at] == h, at, -1)


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[pa.Array]:
    """Consecutive texts of about ``size`` bytes together; a longer text stays whole."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield texts.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text (bytes; null: none), and all words in order, A-Z as a-z."""
    # Arrow's ASCII functions take strings; the bytes are not decoded
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words = lists.flatten().view(pa.binary())
    whole = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    before = np.concatenate([[0], np.cumsum(whole)])
    return np.diff(before[lists.offsets.to_numpy()]), words.filter(pa.array(whole))


class Codes(dict):
    """What scoring needs to know of a word, as one number met words are looked up for: place among the
    frequent words (from 1; 0: not frequent), hash bucket, class. When full, only new words are worked out."""

    LIMIT = 250_000

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of the words and ends of all texts: tokens of each text, number of each token's word (an end has the last);
        of each number: the word, place or -1, bucket, class."""
        v = self.vocabulary
        n, met = split_words(texts)
        met = met.dictionary_encode()
        words = met.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        code = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        off = np.flatnonzero(code < 0)
        if len(off):
            new = met.dictionary.take(pa.array(off))
            h = word_hashes(new)
            at = v.look_up(h)
            cls = suffix_classes(new)
            if len(v.h):
                cls = np.where(at >= 0, v.cls[at], cls)
            code[off] = (at + 1) << 20 | _bucket(h) << 7 | cls
            if len(self) < self.LIMIT:
                self.update(zip((words[i] for i in off.tolist()), code[off].tolist(), strict=True))
        end = np.array([END], U64)
        code = np.append(code, (v.look_up(end) + 1) << 20 | _bucket(end) << 7 | END_CLASS)
        number = np.full(len(met) + len(n), len(words), np.int32)
        inner = np.ones(len(number), bool)
        inner[np.cumsum(n + 1) - 1] = False
        number[inner] = met.indices.to_numpy()
        return n + 1, number, words, (code >> 20) - 1, (code >> 7) & (BUCKETS - 1), code & 127


def _bucket(h: np.ndarray) -> np.ndarray:
    """Hash buckets of words; 0 stands for what is before a text."""
    return (h >> U64(24)).astype(np.int64) % (BUCKETS - 1) + 1


def history(word: np.ndarray, cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token's features; ``ends`` marks the last token of each text."""
    out = np.zeros((FEATURES, len(word)), np.int64)
    starts = np.concatenate([[True], ends])[:-1]
    gone = np.zeros(len(word), bool)
    back = []
    for k in range(3):
        gone[k:] |= starts[: len(word) - k] if k else starts
        out[k, k + 1 :] = word[: -k - 1]
        out[k][gone] = 0
        if k < 2:
            c = np.full(len(word), CLASSES, np.int64)
            c[k + 1 :] = cls[: -k - 1]
            c[gone] = CLASSES
            back.append(c)
    out[3] = (back[0] * 7919 + back[1]) * 2654435761 % BUCKETS
    out[4] = ((out[0] * BUCKETS + out[1]) * 2654435761 >> 12) % PAIRS
    return out + OFFSETS[:, None]


def _logits(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, z: np.ndarray, part: np.ndarray) -> None:
    """Logits of all classes into ``z``, less the greatest of each token where exponentials could leave their range."""
    np.take(w, rows[0], axis=0, out=z, mode="clip")
    for k in range(1, FEATURES):
        np.take(w, rows[k], axis=0, out=part, mode="clip")
        z += part
    z += bias
    if z.max() > SAFE or z.min() < -SAFE:
        z -= z.max(1, keepdims=True)


def class_log_probabilities(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) of each token's own class."""
    out, ones = np.empty(len(cls), np.float32), np.ones(CLASSES, np.float32)
    both = np.empty((2, BLOCK, CLASSES), np.float32)
    for s in range(0, len(cls), BLOCK):
        c = cls[s : s + BLOCK]
        z, part = both[:, : len(c)]
        _logits(w, bias, rows[:, s : s + BLOCK], z, part)
        own = z[np.arange(len(c)), c]
        out[s : s + BLOCK] = own - np.log(np.exp(z, out=z) @ ones)
    return out


def as_items(table: np.ndarray) -> np.ndarray:
    """Each row of ``table`` as one item, so that rows are moved whole."""
    return table.view(np.dtype((np.void, table.itemsize * table.shape[1])))[:, 0]


def sum_rows(g: np.ndarray, ids: np.ndarray, out: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct ids (below 65,536), and for each the sum of its rows of ``g`` (fewer than 32,768), as many at a time as ``out``
    has room for; ``out`` holds the sums, until the next are asked for, ``part`` has as many rows as ``g``.

    Most ids are rare: the first rows of all are taken at once, then the second rows of those that have one, and so on,
    until few ids are left, which are summed one by one. (``np.add.reduceat`` along rows takes several times as long.)
    """
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    ids = ids[order]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    size = np.diff(start, append=len(ids))
    falling = np.argsort((-size).astype(np.int16), kind="stable")
    start, size = start[falling], size[falling]
    ids = ids[start]
    longer = (len(size) - np.cumsum(np.bincount(size))).tolist()  # ids with more than j rows
    for a in range(0, len(ids), len(out)):
        at = start[a : a + len(out)]
        x = out[: len(at)]
        np.take(g, order[at], axis=0, out=x, mode="clip")
        j = 1
        while (m := min(longer[j] - a, len(at))) > 16:
            x[:m] += np.take(g, order[at[:m] + j], axis=0, out=part[:m], mode="clip")
            j += 1
        for i in range(m):
            rest = order[at[i] + j : at[i] + size[a + i]]
            x[i] += np.take(g, rest, axis=0, out=part[: len(rest)], mode="clip").sum(0)
        yield ids[a : a + len(out)], x


def gradient_steps(w: np.ndarray, seen: np.ndarray, bias: np.ndarray, rows: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """Adagrad on steps of many tokens, in place; each step touches a row of weights once."""
    all_g, part = np.empty((2, min(STEP, len(cls)), CLASSES), np.float32)
    sums, all_scale, all_y = np.empty((3, BLOCK, CLASSES), np.float32)
    ones = np.ones(CLASSES, np.float32)
    w_items, seen_items, y_items, scale_items = map(as_items, (w, seen, all_y, all_scale))
    for s in range(0, len(cls), STEP):
        r, c = rows[:, s : s + STEP], cls[s : s + STEP]
        g = all_g[: len(c)]
        for a in range(0, len(c), BLOCK):
            z = g[a : a + BLOCK]
            _logits(w, bias, r[:, a : a + BLOCK], z, part[: len(z)])
            np.exp(z, out=z)
            z *= (1 / (z @ ones))[:, None]
        g[np.arange(len(c)), c] -= 1
        for k in range(FEATURES):
            for u, x in sum_rows(g, r[k] - OFFSETS[k], sums, part):
                u += OFFSETS[k]
                scale, y = all_scale[: len(u)], all_y[: len(u)]
                np.take(seen, u, axis=0, out=scale, mode="clip")
                scale += np.multiply(x, x, out=y)
                np.put(seen_items, u, scale_items[: len(u)], mode="clip")
                x *= rate
                x /= np.sqrt(scale, out=scale)
                np.take(w, u, axis=0, out=y, mode="clip")
                y -= x
                np.put(w_items, u, y_items[: len(u)], mode="clip")


def _text_batches(batches: Iterator[pa.RecordBatch], codes: Codes, size: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature rows, classes) of about ``size`` tokens or more at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        word, c = (np.concatenate(x) for x in zip(*held, strict=True))
        return history(word, c, c == END_CLASS), c

    n = 0
    for b in batches:
        for texts in pieces(b.column("text")):
            _, number, _, _, word, c = codes.tokens(texts)
            held.append((word[number], c[number]))
            n += len(number)
            if n >= size:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def count_words(texts: DataFrame) -> DataFrame:
    """texts(text) -> h, c, cls: exact counts of all words and ends, summed by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: pa.Table, ends: int) -> pa.RecordBatch:
            words = seen["word"].combine_chunks()
            h, cls = word_hashes(words), suffix_classes(words)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, U64(END)).view(np.int64)), pa.array(np.append(seen["c"].to_numpy(), ends)), pa.array(np.append(cls, END_CLASS).astype(np.int32))], names=["h", "c", "cls"])

        def summed(held: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        held: list[pa.Table] = []
        ends = kept = fresh = 0
        for b in batches:
            for texts in pieces(b.column("text"), 4 * PIECE):
                words, c = split_words(texts)[1].value_counts().flatten()
                held.append(pa.table({"word": words, "c": c}))
                ends += len(texts)
                fresh += len(words)
                if fresh > 200_000 + kept:
                    held = [summed(held)]
                    kept, fresh = len(held[0]), 0
                    if kept > 400_000:
                        yield rows(held[0], ends)
                        held, ends, kept = [], 0, 0
        if ends:
            yield rows(summed(held), ends)

    return texts.mapInArrow(run, "h long, c long, cls int").groupBy("h").agg(F.sum("c").alias("c"), F.max("cls").alias("cls"))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals and the frequent words; collected are at most 1 / FREQUENT words and one row per class."""
    end = int(np.array([END], U64).view(np.int64)[0])
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = [r["h"] for r in counts.filter(F.col("h") != end).orderBy(F.desc("c"), "h").limit(SINGLE).collect()]
    own = counts.filter(~F.col("h").isin(top)) if top else counts
    sums, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in own.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sums[r["cls"]], kinds[r["cls"]] = r["n"], r["v"]
    # the classes' own words count even where they are not frequent by share
    f = counts.filter((F.col("c") >= F.lit(FREQUENT * total["n"])) | F.col("h").isin([*top, end])).toArrow()
    h, c, cls = f.column("h").to_numpy().view(U64), f.column("c").to_numpy(), f.column("cls").to_numpy().astype(np.int64)
    for k, x in enumerate(top):
        cls = np.where(h.view(np.int64) == x, k, cls)
        sums[k], kinds[k] = c[h.view(np.int64) == x].sum(), 1
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], cls[order], int(total["n"]), int(total["v"]), sums, kinds)


def train(texts: DataFrame, vocabulary: Vocabulary, *, rounds: int = 2, rate: float = 0.2, task_tokens: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """texts(text, round) -> weights and class biases after ``rounds`` rounds of averaged gradient steps.

    Each task trains on about ``task_tokens`` tokens or more a round and returns one table of weights of fixed size (half
    precision, by block of rows), so that tasks grow with the input and what they return stays below it. Blocks are averaged
    by groups of tasks and then by block, so that no group reads the tables of all tasks.
    """
    sc = texts.sparkSession.sparkContext
    w = np.zeros((ROWS, CLASSES), np.float32)
    bias = np.log((vocabulary.class_total + 1) / (vocabulary.total + CLASSES)).astype(np.float32)
    if not vocabulary.total:
        return w, bias
    blocks = 32
    tasks = math.ceil(vocabulary.total / rounds / task_tokens)
    groups = math.ceil(math.sqrt(tasks))
    size = len(w) // blocks
    known = sc.broadcast(vocabulary)
    for k in range(rounds):
        held = sc.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, n, part = held.value.copy(), 0, TaskContext.get().partitionId()
            seen = np.full_like(own, 1.0)
            for rows, cls in _text_batches(batches, Codes(known.value)):
                gradient_steps(own, seen, bias, rows, cls, rate)
                n += len(cls)
            if n:
                own -= held.value
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([part % groups] * blocks, pa.int32()), pa.array([n] * blocks, pa.int64()), pa.array([own[i * size : (i + 1) * size].astype(np.float16).tobytes() for i in range(blocks)], pa.binary())], names=["block", "part", "n", "w"])

        def average(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(size * CLASSES), 0
            for b in batches:
                for m, x in zip(b.column("n").to_pylist(), b.column("w"), strict=True):
                    total += m * np.frombuffer(x.as_py(), np.float16).astype(np.float64)
                    n += m
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float16).tobytes()], pa.binary())], names=["block", "n", "w"])

        own = texts.filter(F.col("round") == k).select("text").coalesce(tasks).mapInArrow(run, "block int, part int, n long, w binary")
        near = own.groupBy("block", "part").applyInArrow(average, "block int, n long, w binary")
        step = np.zeros_like(w)
        for r in near.groupBy("block").applyInArrow(average, "block int, n long, w binary").collect():
            step[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["w"], np.float16).reshape(size, CLASSES)
        w = w + step
    return w, bias


def score_texts(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, w: np.ndarray, bias: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((vocabulary, w, bias))
    base_norm = float(vocabulary.total + ADD * (vocabulary.distinct + 1))
    class_norm = vocabulary.class_total + ADD * (vocabulary.class_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, bias = held.value
        codes = Codes(v)
        log_word = np.where(v.cls < SINGLE, 0.0, np.log10((v.c + ADD) / class_norm[v.cls])) if len(v.h) else np.zeros(0)
        log_word[v.cls == END_CLASS] = 0
        log_base = np.log10((v.c + ADD) / base_norm)
        ln10 = np.log(10)
        for b in batches:
            at = 0
            for texts in pieces(b.column("text")):
                n, number, words, place, bucket, kind = codes.tokens(texts)
                first = np.cumsum(n) - n
                cls = kind[number]
                class_log = class_log_probabilities(w, bias, history(bucket[number], cls, cls == END_CLASS), cls).astype(np.float64)
                hit = place >= 0
                base, word = np.zeros((2, len(place)))
                base[hit], word[hit] = log_base[place[hit]], log_word[place[hit]]
                # words that are not frequent leave once a text, to meet their counts
                text = np.repeat(np.arange(len(n)), n)
                off = np.flatnonzero(~hit[number])
                key, times = np.unique(text[off] * len(place) + number[off], return_counts=True)
                text, number_off = np.divmod(key, len(place))
                h = np.zeros(len(place), U64)
                rare = np.flatnonzero(~hit).tolist()
                h[rare] = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) if i < len(words) else END for i in rare), U64, len(rare))
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, k)) for x, k in ((h[number_off].view(np.int64), pa.int64()), (times, pa.int32()), (kind[number_off], pa.int32()))]
                sums = [np.add.reduceat(x, first) for x in (hit[number].astype(np.int64), base[number], class_log / ln10 + word[number])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid").slice(at, len(n)), b.column("doc_id").slice(at, len(n)), pa.array(n, pa.int64()), *map(pa.array, sums), *lists],
                    names=["rid", "doc_id", "n_tokens", "known", "base", "score", "h", "n", "cls"],
                )
                at += len(n)

    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    done = cut(src.mapInArrow(run, "rid long, doc_id long, n_tokens long, known long, base double, score double, h array<long>, n array<int>, cls array<int>"))
    rare = done.select("rid", F.explode(F.arrays_zip("h", "n", "cls")).alias("x")).select("rid", "x.*")
    met = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    norms = F.element_at(F.array(*[F.lit(float(x)) for x in class_norm]), F.col("cls") + 1)
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((F.col("c") + ADD) / base_norm)).alias("b"),
        F.sum(F.col("n") * F.log10((F.col("c") + ADD) / norms)).alias("s"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return done.drop("h", "n", "cls").join(sums, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero("k")).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"),
        (F.col("score") + zero("s")).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from nine tenths of the documents, score all."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held_out = bucket_of("doc_id", 10) == 0
    own = docs.filter(~held_out).select("text", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).alias("round"))
    counts = cut(count_words(own.select("text")))
    vocabulary = learn_vocabulary(counts)
    w, bias = train(own, vocabulary, rounds=2)
    out = score_texts(docs, counts, vocabulary, w, bias)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
