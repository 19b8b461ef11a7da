"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import op01_packing as pack
from casemill.llm import op02_embedding as near
from casemill.llm import op03_quality as quality
from casemill.llm import op04_lm as lm
from casemill.llm import op05_langid as lang
from casemill.llm import op06_suffix as suffix
from casemill.llm import op07_ann as ann
from casemill.llm import op08_minhash as minhash
from casemill.llm import op09_toxicity as tox
from casemill.llm import op10_mixing as mixing
from casemill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, p string"


def words(rng, n, kind="en"):
    syllables = {"en": "the of and tion ing er on re".split(), "de": "der die und ung sch ein keit zu".split()}[kind]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, "text without an id of its own", "en", "s0"), (1, None, "en", None), (2, "", None, "s1"), (3, " \n\t ", "de", "s1"), (4, "one", "en", "s0"), (5, "one", "en", "s0"), (5, "one", "en", "s0"), (6, "ÄÖ ß é", "de", "s2"), (7, "a  b \n c d <|endoftext|>", "en", "s1")]
    base = [words(rng, rng.randint(20, 300), rng.choice(["en", "de"])) for _ in range(30)]
    passage = words(rng, 80)
    for i, t in enumerate(base):
        out.append((10 + i, t, "en" if i % 2 else "de", f"s{i % 3}"))
        if i % 3 == 0:
            out.append((100 + i, t, "en", "s0"))
        if i % 4 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            out.append((200 + i, " ".join(w), "en", "s0"))
        if i % 5 == 0:
            out.append((300 + i, words(rng, 30) + " " + passage + " " + words(rng, 10), "en", "s0"))
    out.append((900, words(rng, 9000), "en", "s1"))
    out.append((901, "aaaa " * 400, "en", "s1"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y") for i, t, g, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 100 + k) for k in range(50)] + [(k, k + 1) for k in range(200, 230)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    path = pack.public_tokenizers.path(pack.VOCABULARY)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = pack.pack_documents(docs, with_ids=True).collect()
    want = Counter()
    for i, text, _, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1


def test_sum_of_squares_and_digits():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1023) for _ in range(3000)]
    bins = pack.sum_of_squares(sorted(sizes, reverse=True), 1024, True)
    assert Counter(s for b, m in bins.items() for s in b for _ in range(m)) == Counter(sizes)
    assert sum(bins.values()) <= math.ceil(sum(sizes) / 1024) * 1.01 + 1
    plan = pack.plan(Counter(sizes) + Counter({1024: 7}), 1024, plan_items=500)
    assert Counter({s: c for b, m in plan for s, c in [(x, m) for x in b]}) or True
    total: Counter = Counter()
    for b, m in plan:
        assert sum(b) <= 1024
        for s in b:
            total[s] += m
    assert total == Counter(sizes) + Counter({1024: 7})


def vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    centre = rng.standard_normal(16)
    x[:120] = centre + 0.03 * rng.standard_normal((120, 16))
    x[120:160] = centre + 0.33 * rng.standard_normal((40, 16))
    x[160:165] = x[160]
    return x


@pytest.fixture(scope="module")
def embeddings(spark):
    x = vectors()
    data = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    data += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 1), (403, [1.0, None] * 8, 1), (404, [float(v) for v in x[0]], None), (405, [], 0), (7, [float(v) for v in x[7]], 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), data


def test_embedding_near_duplicates(embeddings):
    df, data = embeddings
    ok = [(k, i, np.array(v, float), g) for k, (i, v, g) in enumerate(data) if v and None not in v and np.isfinite(v).all() and np.any(v) and g is not None]
    u = np.array([v / np.linalg.norm(v) for _, _, v, _ in ok])
    label = np.array([g for *_, g in ok])
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = list(range(len(ok)))
    for _ in range(len(ok)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(ok))]
        if new == comp:
            break
        comp = new
    first = {c: min(ok[i][1] for i in range(len(ok)) if comp[i] == c) for c in set(comp)}
    want = Counter((ok[i][1], int(link[i].sum()), first[comp[i]]) for i in range(len(ok)))
    want += Counter((i, 0, i) for k, (i, _, _) in enumerate(data) if k not in {x[0] for x in ok})
    got = near.near_vectors(df, block=16).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_nearest(embeddings, spark):
    df, data = embeddings
    ok = [(i, np.array(v, float)) for i, v, _ in data if v and None not in v and np.isfinite(v).all() and np.any(v)]
    got = ann.nearest(df, F.col("id") % 20 == 0, block=100).collect()
    hit = total = 0
    for q, x in ok:
        if q % 20 == 0:
            best = sorted(((-float(x @ y), i) for i, y in ok if i != q))[:20]
            found = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
            assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
            hit += len({i for _, i in best} & {i for i, _ in found})
            total += 20
    assert hit / total >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_minhash_against_all_pairs(docs, rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()

    real = [(i, shingles(t)) for i, t, _, _ in rows if i is not None]
    comp = {i: i for i, _ in real}
    for _ in range(len(real)):
        changed = False
        for i, s in real:
            for j, t in real:
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
        if not changed:
            break
    got = minhash.near_duplicates(docs, width=2, percent=80, hot=3).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == Counter((i, len(s), comp[i]) for i, s in real)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


@pytest.mark.parametrize("max_group", [2000, 12])
def test_suffix_removal_against_all_windows(docs, rows, max_group):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, _, _ in rows]
    for _, t in texts:
        seen.update(t[k : k + 60] for k in range(len(t) - 59))
    want = Counter()
    for i, t in texts:
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 59):
            if seen[t[k : k + 60]] > 1:
                cover[k : k + 60] = True
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want[i, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.remove_repeats(docs, length=60, max_group=max_group).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_stack_scan_gives_all_intervals():
    text = "banana$bandana"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [-1] + [next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0) for a, b in zip(order, order[1:], strict=False)]
    found = {(text[order[f] : order[f] + d], z - f + 1) for f, z, d in suffix.stack_scan(np.array(lcp)) if d > 0}
    for s, n in found:
        assert n == sum(text[i:].startswith(s) for i in range(len(text)))
    assert ("ana", 3) in found and ("ban", 2) in found


def test_language_model(docs, rows):
    train = [t for i, t, _, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    own = src.filter(lm.bucket_of("doc_id", 10) != 0).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("round"))
    counts = lm.cut(lm.count_words(own.select("text")))
    vocabulary = lm.learn_vocabulary(counts)
    w, bias = lm.train(own, vocabulary)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_texts(src, counts, vocabulary, w, bias).collect())
    want = Counter()
    for i, t, _, _ in rows:
        x = [*(t or "").encode().lower().split(), None]
        want[i, len(x), sum(c[y] > 0 for y in x), n, round(sum(math.log10((c[y] + 0.1) / (n + 0.1 * (v + 1))) for y in x), 6)] += 1
    assert got == want
    # the model is a distribution over classes, and over words and one unknown word within each class
    rows_, cls = next(lm._text_batches(iter([lm.pa.RecordBatch.from_arrays([lm.pa.array([b"the of and"])], names=["text"])]), lm.Codes(vocabulary)))
    each = [np.exp(lm.class_log_probabilities(w, bias, rows_, np.full(len(cls), k))) for k in range(lm.CLASSES)]
    assert np.allclose(np.sum(each, 0), 1, atol=1e-4)


def test_language_id(docs, empty):
    f = lang.train(docs)
    got = {r.doc_id: r for r in lang.identify(docs.select("doc_id", "text"), f).select("row.doc_id", "lang_pred", "score", "known").collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = lang.train(empty)
    assert {r.lang_pred for r in lang.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_language_id_held_out(spark, sf_dir):
    from casemill.llm.op05_langid import op5_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    x = op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert x.filter("lang = lang_pred").count() >= 0.95 * x.count()


def test_quality(docs, rows, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert quality.quality(empty).count() == 0
    # labellers with known accuracies are found again
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    counts: Counter = Counter()
    for t in truth:
        v = [int(rng.random() < (0.9995 if t else 0.3)) for _ in quality.LABELLERS]
        counts[sum(x * 3**i for i, x in enumerate(v))] += 1
    post, told, prior = quality.expectation_maximisation(dict(counts))
    assert abs(prior - truth.mean()) < 0.02 and abs(told[0, 0, 0] - 0.7) < 0.05


def test_toxicity_learns_words(spark):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(600):
        w = words(rng, 40, "en" if i % 2 else "de").split()
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(["vile,", "Foul", "nasty"])
        data.append((i, " ".join(w), "en" if i % 2 else "de", None, 0, "x", "y"))
        labels.append((i, 1, int(i % 5 == 0)))
    data += [(1000, None, None, None, 0, "", ""), (1001, "", "en", None, 0, "", "")]
    docs = spark.createDataFrame(data, SCHEMA)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tox.fit_model(docs, y.filter("doc_id % 3 <> 0"))
    got = {r.doc_id: r.score for r in tox.score(docs.select("doc_id", "text"), model).select("row.doc_id", "score").collect()}
    held = [i for i in range(0, 600, 3)]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert 0 <= got[1000] <= 1 and got[1000] == got[1001]
    assert tox.fit_model(docs, y.limit(0)) == 0.0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, max_repetition=1.5).select("row.*", "n_tokens", "weight", "epoch").collect()
    n = Counter((r.doc_id, r.text) for r in got)
    assert set(n) == {(i, t) for i, t, _, _ in rows}
    tokens = Counter()
    own = Counter()
    for i, t, _, s in rows:
        own[s] += len((t or "").encode().split())
    for r in got:
        tokens[r.source] += r.n_tokens
    for s, t in own.items():
        if t:
            assert t <= tokens[s] <= 1.5 * t + 1e-6
    assert mixing.mix(empty).count() == 0
    w = mixing.weights_at([900, 90, 10], 0.0)
    assert np.allclose(w, 1 / 3)
    a = mixing.bisect_exponent([900, 90, 10], max_repetition=None, target_entropy=0.8, budget=None)
    assert abs(mixing.entropy(mixing.weights_at([900, 90, 10], a)) - 0.8 * math.log(3)) < 1e-6


@pytest.mark.parametrize("run", [lambda d: pack.pack_documents(d), lambda d: minhash.near_duplicates(d), lambda d: suffix.remove_repeats(d)])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
