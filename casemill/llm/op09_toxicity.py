"""Toxicity by a convolutional text classifier in numpy.

Words (ASCII lower-cased, cut at white space and ASCII punctuation) are hashed to rows of an embedding
table. Filters of one, two and three words run over the whole text, each keeps its largest rectified
response, and a linear layer scores those. Rows that training never touched are zero, so that an unknown
word responds like a gap. Training is Adagrad on the logistic loss; only the places of the largest
responses get gradients.

The model is fitted in one task on a bounded sample (``max_docs`` labelled documents of each class by a hash
of their ids, whole texts). Thresholds come from all of it, each third scored by a model of the other two: the language of a
text is guessed from its own words by a hashed naive Bayes table learned from the sample, and each language with at least
LEAST_TOXIC toxic rows (so at most 80) gets the threshold with the best F1 (sampled rows weigh as many as they stand for);
the others use the common one. The score is the
logistic of the distance to the threshold, so that 0.5 is the decision everywhere.

Defined results: null and empty texts have no words and get the score of a text without responses; documents
without a label are not learned from; without any labelled row of both classes every score is the share of toxic
labels (0 without labels); several labels of one id all count; repeated rows are scored as often as they occur.
All columns of the input are carried in one struct, whatever their names.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import bucket_of, cut, small_batches, table

ROWS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Parts of the sample whose thresholds come from a model of the others; toxic rows that give a language its own threshold.
FOLDS, LEAST_TOXIC = 3, 50
#: Lower-cases A-Z and turns ASCII punctuation to blanks; other bytes stay.
_FOLD = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_rows(text: bytes | None) -> np.ndarray:
    """Rows of a text's words in the embedding table."""
    words = text.translate(_FOLD).split() if text else ()
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(46)).astype(np.int64)


class Convolution:
    """Embeddings, filters by width (each taps x DIM x FILTERS), and the output layer."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((ROWS, DIM)) * 0.05).astype(np.float32)
        self.taps = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (np.abs(rng.standard_normal(FILTERS * len(WIDTHS))) * 0.3).astype(np.float32)
        self.b = np.float32(0)

    def responses(self, docs: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest rectified responses of each text (docs x filters) and, on request, their places in the
        concatenation of the padded texts."""
        pad = max(WIDTHS)
        size = np.array([len(d) + pad for d in docs])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        x = np.zeros((int(size.sum()) + pad, DIM), np.float32)
        for d, s in zip(docs, start, strict=True):
            x[s : s + len(d)] = self.emb[d]
        n, best, at = len(x) - pad, [], []
        for taps, bias in zip(self.taps, self.bias, strict=True):
            r = x[:n] @ taps[0]
            for k in range(1, len(taps)):
                r += x[k : n + k] @ taps[k]
            r += bias
            top = np.maximum.reduceat(r, start, axis=0)
            best.append(top)
            if where:
                at.append(np.stack([r[s : s + z].argmax(0) + s for s, z in zip(start, size, strict=True)]))
        return np.maximum(np.concatenate(best, 1), 0), at

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.responses(docs)[0] @ self.out + self.b

    def fit(self, docs: list[np.ndarray], y: np.ndarray, *, rounds: int = 8, batch: int = 64, rate: float = 0.05, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(2)
        touched = np.zeros(ROWS, bool)
        for d in docs:
            touched[d] = True
        self.emb[~touched] = 0
        parts = {"emb": self.emb, "out": self.out} | {f"t{i}": t for i, t in enumerate(self.taps)} | {f"c{i}": c for i, c in enumerate(self.bias)}
        seen = {k: np.full_like(v, 1e-4) for k, v in parts.items()}
        seen_b = 1e-4

        def step(name: str, g: np.ndarray, rows=slice(None)) -> None:
            seen[name][rows] += g * g
            parts[name][rows] -= rate * (g / np.sqrt(seen[name][rows]) + decay * parts[name][rows])

        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(rounds):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), batch):
                own = order[s : s + batch]
                texts = [docs[i] for i in own]
                flat = np.concatenate([np.concatenate([t, np.full(max(WIDTHS), -1)]) for t in texts] + [np.full(max(WIDTHS), -1)])
                h, at = self.responses(texts, True)
                z = h @ self.out + self.b
                g = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(own)
                gh = np.where(h > 0, g[:, None] * self.out, 0).astype(np.float32)
                step("out", (g @ h).astype(np.float32))
                seen_b += float(g.sum()) ** 2
                self.b -= np.float32(rate * g.sum() / np.sqrt(seen_b))
                rows, grads = [], []
                for i, taps in enumerate(self.taps):
                    gi, gt = gh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(taps)
                    for k in range(len(taps)):
                        ids = flat[at[i] + k]
                        e = np.where((ids >= 0)[..., None], self.emb[ids], 0)
                        gt[k] = np.einsum("df,dfe->ef", gi, e)
                        rows.append(ids.ravel())
                        grads.append((gi[..., None] * taps[k].T[None]).reshape(-1, DIM))
                    step(f"t{i}", gt)
                    step(f"c{i}", gi.sum(0))
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                live = (rows >= 0) & (grads != 0).any(1)
                u, inv = np.unique(rows[live], return_inverse=True)
                total = np.zeros((len(u), DIM), np.float32)
                np.add.at(total, inv, grads[live])
                step("emb", total, u)


def best_threshold(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut between two logits with the best weighted F1 (the middle of the widest such gap)."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    hit, false = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * hit / (hit + false + (w * y).sum())
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]) - 1.0


def train(texts: list[bytes], y: np.ndarray, w: np.ndarray, lang: list[str | None]) -> bytes:
    """Fit model, language table and thresholds; returns them packed."""
    docs = [word_rows(t) for t in texts]
    y = y.astype(np.float64)
    fold, z = np.arange(len(docs)) % FOLDS, np.zeros(len(docs))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(own) and len(rest):
            m = Convolution()
            m.fit([docs[i] for i in rest], y[rest])
            z[own] = np.concatenate([m.logits([docs[i]]) for i in own])
    m = Convolution()
    m.fit(docs, y)
    toxic = Counter(x for x, t in zip(lang, y, strict=True) if x is not None and t)
    names = sorted(x for x, c in toxic.items() if c >= LEAST_TOXIC)
    counts = np.full((ROWS, len(names)), 0.05, np.float32)
    for d, x in zip(docs, lang, strict=True):
        if x in names:
            np.add.at(counts[:, names.index(x)], d, 1)
    bayes = np.log(counts / counts.sum(0)) if names else np.zeros((ROWS, 1), np.float32)
    bayes -= bayes.mean(1, keepdims=True)
    guess = np.array([int(bayes[d].sum(0).argmax()) for d in docs], int)
    common = best_threshold(z, y, w) if y.any() else 0.0
    cuts = np.full(max(1, len(names)), common)
    for k in range(len(names)):
        own = guess == k
        if y[own].sum() >= LEAST_TOXIC:
            cuts[k] = best_threshold(z[own], y[own], w[own])
    out = io.BytesIO()
    np.savez(out, emb=m.emb, out=m.out, b=m.b, bayes=bayes.astype(np.float32), cuts=cuts, **{f"t{i}": t for i, t in enumerate(m.taps)}, **{f"c{i}": c for i, c in enumerate(m.bias)})
    return out.getvalue()


class Scorer:
    """A trained model as unpacked from ``train``."""

    def __init__(self, data: bytes):
        p = np.load(io.BytesIO(data))
        self.model = Convolution()
        self.model.emb, self.model.out, self.model.b = p["emb"], p["out"], p["b"]
        self.model.taps = [p[f"t{i}"] for i in range(len(WIDTHS))]
        self.model.bias = [p[f"c{i}"] for i in range(len(WIDTHS))]
        self.bayes, self.cuts = p["bayes"], p["cuts"]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out, held, words = [], [], 0
        for t in texts:
            held.append(word_rows(t))
            words += len(held[-1])
            if words > 40_000:
                out.append(self._some(held))
                held, words = [], 0
        if held:
            out.append(self._some(held))
        return np.concatenate(out) if out else np.zeros(0)

    def _some(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.model.logits(docs).astype(np.float64)
        guess = np.array([int(self.bayes[d].sum(0).argmax()) for d in docs], int)
        return 1 / (1 + np.exp(-np.clip(z - self.cuts[guess], -500, 500)))


def fit_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", max_docs: int = 4000) -> bytes | float:
    """Sample labelled documents and train in one task; a constant if a class is missing."""
    small_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return float(bool(n.get(1)))
    rate = {k: min(1.0, max_docs / v) for k, v in n.items()}
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    sample = own.withColumn("rate", F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).filter(place < F.col("rate"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # about 2 * max_docs ids: small enough to send everywhere
    rows = texts.join(F.broadcast(sample.select("id", "y", (1 / F.col("rate")).alias("w"))), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        order = np.argsort([xxhash.xxh3_64_intdigest(str(x)) for x in t.column("id").to_pylist()], kind="stable")
        t = t.take(pa.array(order))
        model = train(t.column("text").to_pylist(), t.column("y").to_numpy().astype(float), t.column("w").to_numpy(), t.column("lang").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = cut(rows.repartition(1).mapInArrow(run, "model binary")).first()
    return found["model"] if found else 0.0


def score(docs: DataFrame, model: bytes | float, *, text_col: str = "text") -> DataFrame:
    """row (all columns of docs, as a struct) and score (double, 0 to 1)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(held.value, float) else Scorer(held.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            s = scorer.scores(texts) if scorer else np.full(len(texts), held.value)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from labels outside the held-out fifth, score every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_model(docs, labels.filter(bucket_of("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
