"""Mixing sources to target weights by temperature.

Source i with a share p_i of the tokens gets the weight p_i**a / sum(p**a). The exponent a is bisected
in [0, 1] (1: natural shares, 0: equal shares) to the lowest value at which no source is repeated more
than ``max_repetition`` times, or to the highest at which the weights reach ``target_entropy`` (a part
of the greatest possible entropy); with both, repetition has the last word.

The weights are realised as block permutations under a budget of tokens: a document belongs to a block
by a hash of its id; in each epoch a source's blocks stand in a fresh order, and the source is read epoch
after epoch until its part of the budget is used. Whole epochs need no sorting; of the last, unfinished
epoch the blocks before a boundary are taken whole and the boundary block document by document. What a
row needs to know of this is a few numbers for its source, so that the documents are never shuffled.

The default budget is the least that reads every document at least once. Defined results: tokens are
words split at white space; a null or empty text has none and is carried along in whole epochs; null
sources are one source of their own; rows with equal ids stay together, rows without id go by their text; sources without
tokens keep their one epoch; an empty table returns no rows. All columns are carried in one struct, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.common import cut, table

#: Documents in a block, about.
BLOCK_ROWS = 256


def weights_at(tokens: list[int], a: float) -> list[float]:
    """Normalised shares**a (sources without tokens: 0)."""
    total = sum(tokens)
    raw = [(t / total) ** a if t else 0.0 for t in tokens]
    return [x / sum(raw) for x in raw]


def repetition(tokens: list[int], w: list[float], budget: float | None) -> float:
    """How often the most repeated source is read."""
    b = budget or max(t / x for t, x in zip(tokens, w, strict=True) if t)
    return max(b * x / t for t, x in zip(tokens, w, strict=True) if t)


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x)


def bisect_exponent(tokens: list[int], *, max_repetition: float | None, target_entropy: float | None, budget: float | None) -> float:
    """The exponent (see above), to 1e-9."""
    n = sum(t > 0 for t in tokens)

    def lowest(fits) -> float:
        if fits(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        while hi - lo > 1e-9:
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return hi

    a = 1.0
    if target_entropy is not None and n > 1:
        flat = lambda x: entropy(weights_at(tokens, x)) >= target_entropy * math.log(n)
        if not flat(1.0):
            lo, hi = 0.0, 1.0
            while hi - lo > 1e-9:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if flat(mid) else (lo, mid)
            a = lo
    elif target_entropy is None:
        a = 0.0
    if max_repetition is not None:
        a = max(a, lowest(lambda x: repetition(tokens, weights_at(tokens, x), budget) <= max_repetition))
    return a


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repetition: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """docs repeated as the weights ask: row (all columns, as a struct), epoch (from 0), block, block_order and doc_order (an epoch
    of a source is read by these two), n_tokens and weight.

    Collected are one row per source (its tokens) and one per unfinished source (its boundary).
    """
    spark = docs.sparkSession
    col = lambda c: F.col(f"`{c}`").cast("string")
    ident = F.when(col(id_col).isNull(), _hash(col(text_col), F.lit(10))).otherwise(_hash(col(id_col)))
    n_blocks = max(1, docs.count() // BLOCK_ROWS)
    tokens = F.coalesce(F.regexp_count(col(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), col(source_col)), F.lit("")).alias("key"),
        F.pmod(_hash(ident, F.lit(11)), F.lit(n_blocks)).alias("block"),
        _hash(ident, F.lit(12)).alias("h"),
        tokens.alias("n_tokens"),
    )
    slim = cut(rows.drop("row"))
    blocks = cut(slim.groupBy("key", "block").agg(F.sum("n_tokens").alias("n_tokens")))
    sources = blocks.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens")).orderBy("key").collect()
    counts = [r["n_tokens"] for r in sources]
    if not any(counts):
        a, w = 1.0, [0.0 for _ in counts]
    else:
        a = bisect_exponent(counts, max_repetition=max_repetition, target_entropy=target_entropy, budget=budget)
        w = weights_at(counts, a)
    total = budget or max((t / x for t, x in zip(counts, w, strict=True) if t), default=0.0)
    quota = []
    for r, x in zip(sources, w, strict=True):
        t = r["n_tokens"]
        epochs = int(total * x / t + 1e-9) if t else 1
        quota.append((r["key"], float(x), epochs, max(0.0, total * x - epochs * t) if t else 0.0))
    quotas = spark.createDataFrame(quota, "key string, weight double, epochs int, rest double")

    # the boundary of the unfinished epoch: first among 4096 ranges of its order, then among the blocks of one range, then
    # among the documents of one block, so that no source is sorted in one task
    ranked = blocks.join(quotas.filter("rest > 0"), "key").withColumn("o", _hash("block", "epochs", F.lit(13))).withColumn("bin", F.shiftright("o", 52))
    bins = ranked.groupBy("key", "bin").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = bins.withColumn("upto", F.sum("t").over(Window.partitionBy("key").orderBy("bin")))
    edge_bin = upto.filter("upto > rest").groupBy("key").agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("t")).alias("left"))).alias("e")).select("key", "e.*")
    upto = ranked.join(edge_bin, ["key", "bin"]).withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("key").orderBy("o", "block")))
    edge = cut(upto.filter("upto > left").groupBy("key").agg(F.min(F.struct("o", "block", (F.col("left") - F.col("upto") + F.col("n_tokens")).alias("room"), "epochs")).alias("e")).select("key", "e.*"))
    inside = slim.join(edge, ["key", "block"]).withColumn("doc_order", _hash("h", "epochs", F.lit(14)))
    inside = inside.withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("key").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, 0)))
    stop = inside.filter("sum > room").groupBy("key").agg(F.min("doc_order").alias("stop"))
    found = {r["key"]: (r["o"], r["block"], r["stop"]) for r in edge.join(stop, "key", "left").collect()}
    rules = spark.createDataFrame([(k, x, e, rest, *found.get(k, (None, None, None))) for k, x, e, rest in quota], "key string, weight double, epochs int, rest double, o long, edge long, stop long")

    own = rows.join(rules, "key")
    here = _hash("block", "epochs", F.lit(13))
    before = (here < F.col("o")) | ((here == F.col("o")) & (F.col("block") < F.col("edge")))
    within = (F.col("block") == F.col("edge")) & (F.col("stop").isNull() | (_hash("h", "epochs", F.lit(14)) < F.col("stop")))
    more = F.when((F.col("rest") > 0) & (F.col("o").isNull() | before | within), 1).otherwise(0)
    times = F.col("epochs") + more
    out = own.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    return out.select("row", "epoch", F.col("block").cast("int").alias("block"), _hash("block", "epoch", F.lit(13)).alias("block_order"), _hash("h", "epoch", F.lit(14)).alias("doc_order"), "n_tokens", "weight")


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at least once, small sources up to twice: one row for each reading of a document."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repetition=2.0)
    return out.select("row.doc_id", "row.source", "epoch", "block", "block_order", "doc_order", "n_tokens", "weight")
