"""The inner loops of op4 against plain forms: equal results, and less time."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import xxhash

from casemill.llm import op04_lm as lm


def plain_steps(w, seen, bias, rows, cls, rate):
    for s in range(0, len(cls), lm.STEP):
        r, c = rows[:, s : s + lm.STEP], cls[s : s + lm.STEP]
        z = sum(w[x] for x in r) + bias
        g = np.exp(z - z.max(1, keepdims=True))
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(c)), c] -= 1
        for x in r:
            order = np.argsort(x, kind="stable")
            ids, start = np.unique(x[order], return_index=True)
            total = np.add.reduceat(g[order], start, axis=0)
            seen[ids] += total * total
            w[ids] -= rate * total / np.sqrt(seen[ids])


def corpus(n):
    """Features and classes of words with few frequent and many rare ones."""
    rng = np.random.default_rng(1)
    word = np.minimum(rng.zipf(1.3, n), lm.BUCKETS - 1)
    cls = np.where(rng.random(n) < 0.01, lm.END_CLASS, word % (lm.CLASSES - 1))
    return lm.history(word, cls, cls == lm.END_CLASS), cls


def test_steps_are_those_of_the_plain_form_in_less_time():
    rows, cls = corpus(3 * lm.STEP + 1000)
    bias = np.log(np.bincount(cls, minlength=lm.CLASSES) + 1.0).astype(np.float32)
    took, weights = [], []
    for f in (plain_steps, lm.gradient_steps):
        best = 1e9
        for _ in range(4):
            w = np.zeros((lm.ROWS, lm.CLASSES), np.float32)
            seen = np.ones_like(w)
            began = time.process_time()
            f(w, seen, bias, rows, cls, 0.2)
            best = min(best, time.process_time() - began)
        took.append(best)
        weights.append(w)
    assert np.abs(weights[0]).max() > 0.1
    np.testing.assert_allclose(weights[1], weights[0], atol=1e-4)
    assert took[1] < 0.7 * took[0]


def test_large_logits_keep_their_probabilities():
    rows, cls = corpus(2000)
    rng = np.random.default_rng(2)
    bias = np.zeros(lm.CLASSES, np.float32)
    for scale in (1, 30, 1000):
        w = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32) * scale
        z = sum(w[x].astype(float) for x in rows)
        z -= z.max(1, keepdims=True)
        want = z[np.arange(len(cls)), cls] - np.log(np.exp(z).sum(1))
        np.testing.assert_allclose(lm.class_log_probabilities(w, bias, rows, cls), want, rtol=1e-4, atol=1e-3)


def test_words_are_those_of_bytes_split():
    texts = [b"", None, b" \t\n", bytes(range(256)), b"\x1c\x1d A\xc3\x84\x85b\xa0 \x0b\x0c x", b"One", b" lead", b"trail ", b"\xff\xfe x\xff x", b"A" * (2 << 20) + b" b b"]
    given = pa.array(texts, pa.binary())
    assert b"".join(x or b"" for t in lm.pieces(given) for x in t.to_pylist()) == b"".join(x or b"" for x in texts)
    empty = lm.Vocabulary(*(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64)), 0, 0, np.zeros(lm.CLASSES), np.zeros(lm.CLASSES))
    for t in [given, *lm.pieces(given)]:
        n, number, words, place, bucket, cls = lm.Codes(empty).tokens(t)
        want = [w for x in t.to_pylist() for w in [*(x or b"").lower().split(), None]]
        assert [words[i] if i < len(words) else None for i in number.tolist()] == want
        assert n.tolist() == [len((x or b"").split()) + 1 for x in t.to_pylist()]
        assert (place == -1).all() and (bucket > 0).all()
        assert cls[number].tolist() == [lm.END_CLASS if w is None else lm.SINGLE + xxhash.xxh3_64_intdigest(w[-3:]) % lm.SUFFIX for w in want]
