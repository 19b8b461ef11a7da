"""Foreign columns with an operator's own names, many languages, far letters, vectors of any size, ids with several texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from casemill.llm import op02_embedding as near
from casemill.llm import op05_langid as lang
from casemill.llm import op06_suffix as suffix
from casemill.llm import op08_minhash as minhash
from casemill.llm import op09_toxicity as tox
from casemill.llm import op10_mixing as mixing

OWN = ["row", "key", "block", "h", "o", "rest", "edge", "stop", "epochs", "epoch", "score", "known", "lang_pred", "cls", "kept", "spans", "weight", "n_tokens", "bin", "_row", "component_id", "k", "place", "order"]
RUNS = {
    "op5": lambda d: lang.identify(d, lang.train(d)),
    "op6": lambda d: suffix.remove_repeats(d),
    "op9": lambda d: tox.score(d, 0.25),
    "op10": lambda d: mixing.mix(d),
}


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdehiklmnorst") for _ in range(5)) for _ in range(60)), "en", f"s{i % 2}") for i in range(30)]
    rows += [(None, None, None, None), (40, "", "en", None), (2, rows[2][1], "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(OWN)}).repartition(2)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_foreign_columns_pass(clashing, name):
    got = RUNS[name](clashing).select("row.*")
    assert got.columns == clashing.columns
    assert {tuple(r[c] for c in OWN) for r in got.collect()} == {tuple(range(len(OWN)))}


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages_with_foreign_columns_and_empty(spark, clashing, stage):
    run = dict(cp.STAGES)[stage]
    got = run(spark, clashing, "")
    assert got.count() >= 30
    if stage != cp.STAGES[-1][0]:
        assert got.columns == clashing.columns
        assert {tuple(r[c] for c in OWN) for r in got.collect()} == {tuple(range(len(OWN)))}
    assert run(spark, clashing.limit(0), "").count() == 0


def test_seventy_languages_and_far_letters(spark):
    rng = random.Random(3)
    alphabets = {f"l{i:02}": "".join(chr(0x20000 + 40 * i + j) for j in range(20)) for i in range(70)}
    rows = [(k, v, "".join(rng.choice(a) for _ in range(80))) for k, (v, a) in enumerate(alphabets.items()) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, v) for i, (_, v, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = lang.identify(docs, lang.train(docs)).select("row.lang", "lang_pred").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_vectors_of_any_size(spark):
    vectors = [[1e-200, 0.0], [3e-200, 0.0], [1e200, 0.0], [5e-324, 0.0], [0.0, 1e308], [0.0, 1.7e308], [0.0, 0.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near.near_vectors(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_each_text_of_an_id_links(spark):
    rng = random.Random(4)
    words = [["w%d" % rng.randrange(10**6) for _ in range(60)] for _ in range(2)]
    near_first, near_second = ([*w[:-1], "other"] for w in words)
    rows = [(1, words[0]), (1, words[1]), (2, near_first), (3, near_second), (4, ["alone"] * 9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = minhash.near_duplicates(df, width=2).select("doc_id", "component_id").distinct().collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}
