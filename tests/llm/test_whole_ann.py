"""Nearest neighbours of queries far from all rows, and of rows longer than any in the sample."""

import numpy as np
from pyspark.sql import functions as F

from casemill.llm import op07_ann as ann


def best(x, q):
    score = x @ x[q]
    score[q] = -np.inf
    return np.argsort(-score, kind="stable")[:20].tolist()


def found(spark, x, **how):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0, block=1000, **how).orderBy("query_id", "rank").collect()
    return {q: [r.vec_id for r in got if r.query_id == q] for q in range(0, len(x), 20)}


def test_isolated_queries_get_all_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 64))
    x = centres[rng.integers(0, 20, 3000)] + 0.05 * rng.standard_normal((3000, 64))
    lone = list(range(0, 3000, 200))
    x[lone] = -3 * centres.mean(0) + rng.standard_normal((len(lone), 64))
    got = found(spark, x, sample=1000)
    assert all(len(v) == 20 for v in got.values())
    assert all(got[q] == best(x, q) for q in lone)
    assert sum(len({*got[q]} & {*best(x, q)}) for q in got) >= 0.99 * 20 * len(got)


def test_longest_rows_outside_the_sample(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x[7::300] *= 40
    got = found(spark, x, sample=500)
    assert all(len(v) == 20 for v in got.values())
    assert sum(len({*got[q]} & {*best(x, q)}) for q in got) >= 0.99 * 20 * len(got)


def test_fewer_candidates_than_k(spark):
    x = np.random.default_rng(1).standard_normal((6, 8))
    assert found(spark, x) == {0: best(x, 0)[:5]}


def test_probing_retrieves_the_ball():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    x = (centres[rng.integers(0, 40, 4000)] + 0.02 * rng.standard_normal((4000, 64)))
    coder = ann.fit(x, norm=float(np.linalg.norm(x, axis=1).max()), k=20, recall=0.9)
    for radius in (coder.radius, 15, 31):
        coder.radius = radius
        block = ann.Block(np.arange(4000), np.arange(4000), x, coder)
        codes = coder.codes(x, True)
        for i in range(0, 4000, 400):
            ball = np.flatnonzero(ann.distances(block.codes, codes[:, i]) <= radius)
            if block.index:
                found = np.unique(np.concatenate([block.probe(p, int(v)) for p, v in enumerate(block.parts(codes[:, i : i + 1])[:, 0])]))
                assert set(ball) <= set(found)
    assert block.index


def test_ties_and_scores_are_exact(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((50, 64))
    x = base[rng.integers(0, 50, 600)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 64), (740, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0, block=100, query_block=7).collect()
    score = np.array([[(x[q] * v).sum() for v in x] for q in range(0, 600, 20)])
    for i, q in enumerate(range(0, 600, 20)):
        order = sorted((j for j in range(600) if j != q), key=lambda j: (-score[i, j], j))[:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert own == [(k + 1, j, score[i, j]) for k, j in enumerate(order)]
