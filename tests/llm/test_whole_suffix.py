"""Repeats over chunks of a long text, hot anchors, and what an anchor's group shares in part."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import op06_suffix as suffix


def brute(texts, length):
    seen = Counter()
    for _, t in texts:
        seen.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = Counter()
    for i, t in texts:
        cover = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length if k + length <= len(t) else len(t)] -= 1
        on = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~on])
        out[i, len(t), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("max_group", "hot"), [(2000, False), (25, False), (2000, True)])
def test_shared_passages_of_all_lengths(spark, monkeypatch, max_group, hot):
    if hot:
        monkeypatch.setattr(suffix, "SAMPLE", 1)
        monkeypatch.setattr(suffix, "HOT_ROWS", 3)
        monkeypatch.setattr(suffix, "HOT_SHARE", 0.0)
    rng = random.Random(11)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage = text(400)
    rows = []
    for i in range(120):
        k = rng.randint(150, 400)
        at = rng.randint(0, 400 - k)
        rows.append((i, text(rng.randint(0, 300)) + passage[at : at + k] + text(rng.randint(0, 300))))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, rows[4][1] + b"x"), (502, b"z" * 900), (503, b""), (None, text(199)), (504, text(200))]
    docs = spark.createDataFrame([(i, bytearray(t), "a") for i, t in rows], "doc_id long, text binary, row string").repartition(3)
    docs = docs.withColumns({"cls": F.lit(1), "spans": F.lit(2), "kept": F.lit(3)})
    got = suffix.remove_repeats(docs, max_group=max_group).select("row.doc_id", "row.kept", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 200)
    assert {r["kept"] for r in got} == {3}


def test_text_of_three_megabytes(spark):
    data = np.random.default_rng(3).integers(97, 123, 3_000_000).astype(np.uint8)
    data[2_500_000:2_500_700] = data[1_048_000:1_048_700]  # over the seam of two chunks
    short = bytes(data[2_097_000:2_097_300])
    docs = spark.createDataFrame([(1, bytearray(data.tobytes())), (2, bytearray(short))], "doc_id long, text binary")
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).select("row.doc_id", "n_removed", "spans").collect()}
    assert [(x.start, x.end) for x in got[1].spans] == [(1_048_000, 1_048_700), (2_097_000, 2_097_300), (2_500_000, 2_500_700)]
    assert got[2].n_removed == 300
