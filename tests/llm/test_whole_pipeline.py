"""A clean text that occurs again, under one id or without id, stays once."""

import random
from collections import Counter

import corpus_pipeline as cp
from casemill.llm.common import cut


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(120))
    one, two, three, four, five, near = (text() for _ in range(6))
    copy = near.split()
    copy[60] = "changed"
    rows = [(1, one), (1, one), (None, two), (None, two), (None, three), (3, three), (4, four), (4, five), (None, near), (6, " ".join(copy))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    second = cut(cp.drop_near_duplicates(spark, docs, ""))
    want = Counter([(1, one), (None, two), (3, three), (4, four), (4, five), (6, " ".join(copy))])
    assert Counter((r.doc_id, r.text) for r in second.collect()) == want
    third = cp.remove_repeated_passages(spark, second, "")
    assert third.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in third.collect()) == want
