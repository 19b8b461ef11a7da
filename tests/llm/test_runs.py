"""Periodic runs against a plain search over all periods, and transforms against products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import op11_runs as R
from casemill.llm.common import U64


def brute(w, exponent=4, least=6):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


@pytest.mark.parametrize("n", [2, 4, 64, 1024])
def test_transform_is_an_exact_correlation(n):
    rng = np.random.default_rng(n)
    x, y = (rng.integers(0, R.PRIME, (3, n)).astype(U64) for _ in range(2))
    assert (R.inverse(R.transform(x)) == x).all()
    got = R.inverse(R.transform(x) * R.transform(y) % U64(R.PRIME))
    for a, b, c in zip(x.tolist(), y.tolist(), got.tolist(), strict=True):
        for k in (0, 1, n - 1):
            assert c[k] == sum(a[i] * b[(k - i) % n] for i in range(n)) % R.PRIME


def test_random_texts(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        w = [f"w{rng.randrange(rng.randint(1, 4))}" for _ in range(rng.randint(0, 80))]
        a = rng.randint(0, len(w))
        unit = [f"w{rng.randrange(5)}" for _ in range(rng.randint(1, 17))]
        texts.append(w[:a] + (unit * rng.randint(1, 9))[: rng.randint(0, 150)] + w[a:])
    assert R.runs_of([[x.encode() for x in t] for t in texts]) == [brute(t) for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in R.periodic_runs(docs).select("row.doc_id", "n_words", "runs", "collapsed").collect():
        t, found = texts[r.doc_id], [tuple(x) for x in r.runs]
        assert (r.n_words, found) == (len(t), brute(t))
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(t) if i not in gone)


def test_long_texts_and_large_periods():
    rng = random.Random(6)
    unit = [b"%d" % rng.randrange(40) for _ in range(5000)]
    noise = [b"n%d" % rng.randrange(40) for _ in range(30_000)]
    got = R.runs_of([noise + unit * 5 + noise[:7], [b"a"] * 300_000, ([b"a"] * 50 + [b"b"]) * 400])
    assert (30_000, 25_000, 5000) in got[0]
    assert got[1] == [(0, 300_000, 1)]
    assert len(got[2]) == 401 and (0, 20_400, 51) in got[2]


def test_nulls_spaces_and_foreign_columns(spark):
    rows = [(1, None), (1, ""), (None, " \t a\x0ba a a\r a a \n"), (2, "           "), (2, "a b a b a b a b"), (2, "a b a b a b a b"), (3, "a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "runs", "collapsed", "n_words")})
    got = R.periodic_runs(docs)
    assert got.select("row.*").columns == docs.columns
    found = sorted(((r.row.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.row.runs) for r in got.collect()), key=repr)
    want = [(1, 0, [], "", 7), (1, 0, [], "", 7), (0, 6, [(0, 6, 1)], "a", 7), (2, 6, [(0, 6, 1)], " ", 7), (2, 8, [(0, 8, 2)], "a b", 7), (2, 8, [(0, 8, 2)], "a b", 7), (3, 5, [], "a a a a a", 7)]
    assert found == sorted(want, key=repr)
    assert R.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exponent"):
        R.runs_of([], exponent=3)


def test_planted_repetition(spark):
    import zlib

    texts = {i: [f"w{j}" for j in range(i % 37)] for i in range(200)}
    docs = spark.createDataFrame([(i, "  ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    bare = spark.createDataFrame([(None, "a  b"), (0, None)], docs.schema).select(R.planted("doc_id", "text").alias("got")).collect()
    assert [r.got for r in bare] == ["a  b", None]
    for r in docs.select("doc_id", R.planted("doc_id", "text").alias("got")).collect():
        h, w = zlib.crc32(str(r.doc_id).encode()), texts[r.doc_id]
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r.got.split() == w
