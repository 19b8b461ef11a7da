"""MinHash near-duplicate groups with circulant signatures.

Two permutations make a signature of any length: the first scatters a document's shingles over a
universe of ``UNIVERSE`` places (here the top bits of a 64-bit hash), the second is one fixed random
permutation that coordinate k reads shifted by k places. The k-th coordinate is the least value that
the shifted permutation gives to the places of a document; as neighbouring coordinates read
neighbouring cells, a shingle's contribution to the whole signature is one contiguous slice.

``near_duplicates`` bands the signatures, links each bucket's members to a leader drawn anew for
each band, confirms every link by the exact Jaccard of the full shingle sets, and then compares
whatever a bucket still holds in different components, so that no bucket is expanded into all its
pairs and no link between buckets' members is lost.

Defined results: null or empty texts and texts without words have an empty set (``n_shingles`` 0) and
link with nothing; texts with fewer words than a shingle are one shingle of all their words; equal sets
are one class, whatever their number; rows with the same id are one node and each returns a row; a
null id returns a row with a null component, kept. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import U64, cut, mix64, small_batches, table
from casemill.llm.components import components

UNIVERSE = 1 << 20
SEED = 20240501


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, ASCII white space)."""
    words = text.lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=n)], U64)
    acc = np.zeros(n - width + 1, U64)
    for j in range(width):
        acc = acc * U64(0x9E3779B97F4A7C15) + h[j : n - width + 1 + j]
    return np.unique(mix64(acc))


def shifted_permutation(k: int) -> np.ndarray:
    """Row i holds what the k shifts of the second permutation give to place i (a view, not a copy)."""
    p = np.random.default_rng(SEED).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:k]]), k)


def signature(shingles: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set of hashes."""
    places = (shingles >> U64(44)).astype(np.int64)
    return np.minimum.reduce([windows[places[i : i + 2048]].min(axis=0) for i in range(0, len(places), 2048)])


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    m = sig.reshape(-1, rows).astype(U64)
    acc = np.arange(1, len(m) + 1, dtype=U64)
    for j in range(rows):
        acc = mix64(acc * U64(0x9E3779B97F4A7C15) + m[:, j])
    return acc


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, text binary) -> (doc_id, n_shingles, d1, d2, bands array): one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shifted_permutation(bands * rows)
        for b in batches:
            n, digest, keys = [], [], []
            for text in b.column("text"):
                s = shingle_hashes(text.as_py(), width)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_intdigest(s.tobytes()))
                keys.append(band_keys(signature(s, windows), rows) if len(s) else np.empty(0, U64))
            at = np.zeros(len(n) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=at[1:])
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            d = np.array([[x >> 64, x & (2**64 - 1)] for x in digest], U64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs(a, b) whose full shingle sets reach ``percent`` of Jaccard similarity."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, U64))
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                if (x := ta.as_py()) != last[0]:
                    last = (x, shingle_hashes(x, width))
                s, t = last[1], shingle_hashes(tb.as_py(), width)
                if not len(s) or not len(t) or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _rest(buckets: DataFrame, comp: DataFrame, seen: DataFrame, texts: DataFrame, width: int, percent: int, hot: int) -> DataFrame:
    """Links (a, b) between members of one bucket that its leaders left in different components.

    Buckets of at most ``hot`` members give their pairs as rows, fewer than ``hot`` a member. Larger
    buckets that share documents make a family; its documents are packed in blocks of about ``hot``
    and blocks are compared as matrices, so that rows grow with the blocks and not with the pairs.
    Members of one component are not compared with each other.
    """
    placed = buckets.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "key", "leader", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    spread = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2")
    left = cut(placed.join(spread.select("band", "key", "n"), ["band", "key"]))

    small = left.filter(F.col("n") <= hot)
    one = small.select("band", "key", F.col("doc_id").alias("a"), F.col("component").alias("ca"))
    two = small.select("band", "key", F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    pairs = one.join(two, ["band", "key"]).filter("a < b and ca <> cb").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")
    found = verified(pairs, texts, width, percent)

    large = left.filter(F.col("n") > hot)
    if large.isEmpty():
        return found
    family = components(large.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    of = cut(family.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("family", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    own = of.groupBy("family", "component").agg(F.count("*").alias("m"))
    # a component of its own size is a part; the members of lesser ones are the part ""
    part = own.withColumn("part", F.when(F.col("m") >= hot, F.col("component").cast("string")).otherwise(""))
    size = part.groupBy("family", "part").agg(F.sum("m").alias("m"))
    keyed = of.join(part.drop("m"), ["family", "component"]).join(size, ["family", "part"]).withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / hot))).drop("m")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([shingle_hashes(t.as_py(), width).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), s], names=["doc_id", "s"])

    packed = keyed.join(texts.join(of.select("doc_id"), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary"), "doc_id")
    blocks = cut(packed.groupBy("family", "part", "blk").agg(F.collect_list(F.struct("doc_id", "component", "s")).alias("docs")))
    x = blocks.select("family", F.col("part").alias("px"), F.col("blk").alias("bx"), F.col("docs").alias("x"))
    y = blocks.select("family", F.col("part").alias("py"), F.col("blk").alias("by"), F.col("docs").alias("y"))
    order = F.struct("px", "bx") <= F.struct("py", "by")
    both = x.join(y, "family").filter(order & ((F.col("px") == "") | (F.col("px") != F.col("py")))).select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(docs: list[dict], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            m = np.zeros((len(docs), len(words)), np.float32)
            for i, d in enumerate(docs):
                m[i, np.searchsorted(words, np.frombuffer(d["s"], U64))] = 1
            return m, m.sum(1), np.array([d["doc_id"] for d in docs]), np.array([d["component"] for d in docs])

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                dx, dy = batch.column("x")[i].as_py(), batch.column("y")[i].as_py()
                words = np.unique(np.concatenate([np.frombuffer(d["s"], U64) for d in dx + dy]))
                (mx, nx, ix, cx), (my, ny, iy, cy) = matrix(dx, words), matrix(dy, words)
                both = mx @ my.T
                hit = (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (cx[:, None] != cy[None, :])
                # one link for two components is as good as all
                out += {(cx[p], cy[q]): (ix[p], iy[q]) for p, q in zip(*np.nonzero(hit), strict=True)}.values()
            ab = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return found.union(both.mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, hot: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A pair at the threshold shares a band with probability 1 - (1 - 0.8**4)**32, all but 5e-8.
    Shuffled are band keys (``bands`` longs a document), links, and the texts of documents that share
    a band with another text; never pairs of a bucket. Groups of equal sets meet as one representative.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sk = cut(sketches(src, width, bands, rows))
    usable = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    rep_ids = classes.select(F.col("rep").alias("doc_id"), "d1", "d2")
    reps = usable.join(rep_ids, ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    member = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = member.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    held = cut(member.join(shared, ["band", "key"]))
    # a text that shares many buckets with many others is the likely origin of its copies and leads
    weight = held.groupBy("doc_id").agg(F.sum("n").alias("w"))
    weighed = held.join(weight, "doc_id")
    leads = weighed.groupBy("band", "key").agg(F.max_by("doc_id", F.struct("w", -F.col("doc_id"))).alias("leader"), F.min_by("doc_id", F.xxhash64("doc_id", "band")).alias("second"))
    buckets = cut(held.join(leads, ["band", "key"]).select("band", "key", "leader", "second", "doc_id"))
    ids = buckets.select("doc_id").distinct()
    # an id may hold several texts: each is compared, and a link of one is a link of the id
    texts = cut(src.filter("doc_id is not null").join(ids, "doc_id", "left_semi").withColumn("x", F.xxhash64("text")).dropDuplicates(["doc_id", "x"]).drop("x"))

    star = buckets.select("doc_id", F.explode(F.array("leader", "second")).alias("leader"))
    pairs = star.filter("leader <> doc_id").select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    seen = cut(pairs)
    links = cut(verified(seen, texts, width, percent).distinct())
    comp = cut(components(links))
    found = cut(_rest(buckets, comp, seen, texts, width, percent, hot))
    comp = components(links.union(found)) if not found.isEmpty() else comp
    joined = sk.join(classes.filter("copies > 1").select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"], "left")
    joined = joined.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = joined.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 2-word shingles, Jaccard of at least 0.8, all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
