"""Embedding near-duplicates of labels denser than any window."""

import math

import numpy as np
import pytest

from casemill.llm import op02_embedding as near


@pytest.mark.parametrize("sending", [near.SENDING, 1])
def test_dense_group_is_linked_whole(spark, sending):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(64)
    x = centre / np.linalg.norm(centre) + math.sqrt(0.045 / 64) * rng.standard_normal((3000, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = u @ u.T
    want = (cosines >= 0.93).sum(1) - 1
    assert want.max() > 2990 and np.median(cosines) < 0.97
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near.near_vectors(df, sending=sending).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert {r.component_id for r in got.values()} == {0}
    assert (n <= want).all() and n.sum() >= 0.995 * want.sum()
    if sending == near.SENDING:
        assert (n == want).all()


def test_tables_keep_recall_as_labels_grow():
    angle = math.acos(0.93)
    assert near.tables_for(10_000, angle, 0.999) == (0, 1)
    for n in (1_000_000, 20_000_000):
        bits, tables = near.tables_for(n, angle, 0.999)
        assert bits > 0 and 1 - (1 - (1 - angle / math.pi) ** bits) ** tables >= 0.999


def test_forest_connects():
    rng = np.random.default_rng(1)
    hit = rng.random((60, 80)) < 0.01
    tree = near.forest(hit)
    assert hit[tree[:, 0], tree[:, 1]].all()

    def parts(pairs):
        own = list(range(140))
        for i, j in pairs:
            a, b = own[i], own[60 + j]
            own = [a if c == b else c for c in own]
        return [own.index(c) for c in own]

    assert parts(tree) == parts(zip(*np.nonzero(hit), strict=True))
