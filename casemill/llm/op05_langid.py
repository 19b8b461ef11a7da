"""Language identification by bit-sliced Bloom filters of character n-grams.

All languages share one Bloom filter layout: cell j of the table holds one bit per language, so that
one look-up of an n-gram (the conjunction of its cells) returns the set of all languages that contain
it. A text's n-grams are counted per language (popcounts of the bit slices); the share h of hits is
corrected for the known rate f of false positives of that language's slice, t = (h - f) / (1 - f), and
the language with the largest t is predicted.

Training takes, for each language, about ``max_docs`` documents chosen by a hash of their ids, whole
texts; an n-gram belongs to a language if at least ``min_share`` of its documents (two at the least, one in
languages of up to a hundred documents) hold it, which bounds a language's n-grams whatever the input. Nothing but the text is read when
predicting.

Defined results: ``und`` with score 0 if a text is null, has no letter or no language was learned; score 0 if
no language contains any of its n-grams; ties go to the language that comes first by name; documents
without a language are not learned from; repeated rows are learned and predicted as often as they occur. All columns of
the input are carried in one struct, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import U64, bucket_of, mix64, small_batches, table

UNKNOWN = "und"
CELLS = 1 << 21
PROBES = 3
ORDER = 4
BLOCK = 1 << 15


@cache
def _folded() -> np.ndarray:
    """Lower-case letter of each code point; 32 for all that are no letters."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's n-grams, white space and signs folded to single separators; empty
    without any letter."""
    if not text:
        return np.empty(0, U64)
    c = _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = c == 32
    if gap.all():
        return np.empty(0, U64)
    c = c[~(gap & np.concatenate([[True], gap[:-1]]))]
    c = np.concatenate([[32], c, [32]]).astype(U64)
    while len(c) < ORDER:
        c = np.append(c, U64(32))
    acc = np.zeros(len(c) - ORDER + 1, U64)
    for j in range(ORDER):
        acc = acc * U64(0x100000001B3) + c[j : len(c) - ORDER + 1 + j]
    return mix64(acc)


def cells(g: np.ndarray, probe: int) -> np.ndarray:
    """The cell of each n-gram for one probe: 21 bits of the hash at a time."""
    return ((g >> U64(21 * probe)) & U64(CELLS - 1)).astype(np.int64)


#: Bits of each byte.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


@dataclass
class Filters:
    """Languages (bit numbers), the tables of cells, one for every eight languages, and each slice's rate of false positives."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def rates(self, g: np.ndarray) -> np.ndarray:
        """Corrected share of a text's n-grams that each language contains."""
        at = [cells(g, p) for p in range(PROBES)]
        hits = np.zeros(8 * len(self.table), np.int64)
        for i, row in enumerate(self.table):  # eight languages at a time
            mask = row[at[0]]
            for a in at[1:]:
                mask &= row[a]
            hits[8 * i : 8 * i + 8] = np.bincount(mask, minlength=256) @ _BITS
        hits = hits[: len(self.languages)]
        return np.maximum(0.0, (hits / len(g) - self.false_rate) / (1 - self.false_rate))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, min_share: float = 0.002) -> Filters:
    """Learn the filters. Collected are the languages with their numbers of documents and the table of cells in blocks:
    2 MB for every eight languages."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    n = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    languages = sorted(n)
    if not languages:
        return Filters([], np.zeros((0, CELLS), np.uint8), np.zeros(0))
    known = docs.sparkSession.createDataFrame([(v, k, min(1.0, max_docs / n[v])) for k, v in enumerate(languages)], "lang string, k int, part double")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # one row for each language of the sample, which the driver holds anyway
    sample = src.join(F.broadcast(known), "lang").filter(place < F.col("part")).select("text", "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, list[np.ndarray]] = {}
            for k, text in zip(b.column("k").to_pylist(), b.column("text"), strict=True):
                own.setdefault(k, []).append(np.unique(grams(text.as_py())))
            for k, found in own.items():
                g, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "g", "c"])

    # one document in a hundred, two at most from a hundred on, or min_share of them if that is more
    least = docs.sparkSession.createDataFrame([(k, float(max(min(2, math.ceil(n[v] / 100)), min_share * min(n[v], max_docs)))) for k, v in enumerate(languages)], "k int, least double")
    held = sample.mapInArrow(count, "k int, g long, c long").groupBy("k", "g").agg(F.sum("c").alias("c")).join(F.broadcast(least), "k").filter("c >= least")

    def blocks(key: tuple, t: pa.Table) -> pa.Table:
        cell = np.zeros(BLOCK, np.uint8)
        np.bitwise_or.at(cell, t.column("at").to_numpy(), (1 << t.column("k").to_numpy() % 8).astype(np.uint8))
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([cell.tobytes()], pa.binary())})

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column("g").to_numpy().view(U64)
            c = np.concatenate([cells(g, p) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((c // BLOCK).astype(np.int32)), pa.array((c % BLOCK).astype(np.int32)), pa.array(np.tile(b.column("k").to_numpy(), PROBES))], names=["block", "at", "k"])

    out = np.zeros((-(-len(languages) // 8), CELLS), np.uint8)
    probed = held.select("k", "g").mapInArrow(probes, "block int, at int, k int").withColumn("row", F.floor(F.col("k") / 8).cast("int"))
    for r in probed.groupBy("row", "block").applyInArrow(blocks, "row int, block int, cells binary").toLocalIterator():
        out[r["row"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["cells"], np.uint8)
    fill = np.array([((out[k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages))])
    return Filters(languages, out, fill**PROBES)


def identify(docs: DataFrame, filters: Filters, *, text_col: str = "text") -> DataFrame:
    """row (all columns of docs, as a struct), lang_pred, score (the best rate over the sum of the two best) and known (the best rate)."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(filters)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in batches:
            pred, score, known = [], [], []
            for text in b.column("text"):
                g = grams(text.as_py())
                if not len(g) or not f.languages:
                    pred.append(UNKNOWN), score.append(0.0), known.append(0.0)
                    continue
                t = f.rates(g)
                best = int(t.argmax())
                top, second = float(t[best]), float(np.partition(t, -2)[-2]) if len(t) > 1 else 0.0
                pred.append(f.languages[best]), score.append(top / (top + second) if top else 0.0), known.append(top)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=["row", "lang_pred", "score", "known"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, known double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from documents outside the held-out quarter, predict all."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 4) == 2
    filters = train(docs.filter(~held_out))
    out = identify(docs.select("doc_id", "text"), filters).select("row.doc_id", "lang_pred", "score", "known")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "known")
