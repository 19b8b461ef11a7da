"""Repeated word windows against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casemill.llm import op13_windows as W


def brute(rows, width):
    """rows (id, text) with different texts for an id -> (id, words, removed, digest), nulls last, the order of equal ids given by the rows'."""
    first = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (k, i))
    out = Counter()
    for k, (d, t) in enumerate(rows):
        w = (t or "").split()
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] != (k, i) for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def found(docs, **kwargs):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in W.remove_windows(docs, **kwargs).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.mark.parametrize(("block", "size", "width"), [(1_500_000, 16_000_000, 20), (300, 900, 20), (40, 300, 3), (50, 500, 1)])
def test_shared_passages(spark, monkeypatch, block, size, width):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "RANGE", size)
    rng = random.Random(width)
    words = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage = words(70, 1000)
    rows = []
    for i in range(150):
        a = rng.randint(0, 60)
        rows.append((i, " ".join(words(rng.randint(0, 40), 1000) + passage[a : a + rng.randint(5, 60)] * (1 + (i % 11 == 0)) + words(rng.randint(0, 40), 1000))))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, ""), (203, None), (204, "one"), (205, "a " * 90), (206, "a\tb\x0bc " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, width=width) == brute(rows, width)


def test_equal_ids_nulls_and_foreign_columns(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, one), (1, two), (None, two), (None, three), (5, three), (6, one + " " + one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "doc", "digest", "spans", "key", "n_words")}).repartition(3)
    got = W.remove_windows(docs)
    assert got.select("row.*").columns == docs.columns
    assert {(r.row.doc_id, r.row.text, r.n_removed, r.row.spans) for r in got.collect()} == {(1, one, 0, 7), (1, two, 0, 7), (None, two, 50, 7), (None, three, 50, 7), (5, three, 0, 7), (6, one + " " + one, 100, 7)}
    assert got.filter("row.doc_id = 1").count() == 3
    assert W.remove_windows(docs.limit(0)).count() == 0


def test_long_text_over_blocks_of_sums(spark):
    rng = random.Random(4)
    w = [f"{rng.randrange(10**7)}" for _ in range(1_100_000)]
    at = W.CHUNK - 30  # over the seam of two sums
    w[300:360] = w[at : at + 60]
    docs = spark.createDataFrame([(9, " ".join(w)), (12, " ".join(w[500:519])), (13, " ".join(w[600:620]))], "doc_id long, text string")
    got = {r.doc_id: r for r in W.remove_windows(docs, carry=["doc_id"]).select("row.doc_id", "n_removed", "spans").collect()}
    assert [(x.start, x.end) for x in got[9].spans] == [(at, at + 60)]
    assert (got[12].n_removed, got[13].n_removed) == (0, 20)
