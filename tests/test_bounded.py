"""Operators that keep large groups out of one task, against plain counts: places, tuples by number, words by letter groups, the guard."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from casemill.functions.grams import contained
from casemill.operators import facts as C
from casemill.operators import logs as L
from casemill.operators import text as T
from casemill.streaming import budget


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_places_and_guard_by_blocks(spark, width):
    rng = random.Random(width)
    ids = rng.sample(range(400), 150)
    rows = [(i, f"r{rng.randrange(3)}", "s" if i % 2 else "t") for i in ids]
    got = L.budget_guard(spark.createDataFrame(rows, "call_index long, run_id string, strategy string"), 12, 100, width).collect()
    cells, refused = {}, {}
    for n, (i, run, s) in enumerate(sorted(rows)):
        own = cells.setdefault((run, s), [0, 0])
        bad = sum(own) >= 12 or n >= 100
        own[bad] += 1
        if bad:
            refused.setdefault((run, s), i)
    assert {(r.run_id, r.strategy): [r.allowed, r.refused] for r in got} == cells
    assert {(r.run_id, r.strategy): r.first_refused for r in got if r.first_refused is not None} == refused


def test_tuples_of_any_arity(spark):
    schema = spark.createDataFrame([("one", ["A"]), ("two", ["A", "B"]), ("three", ["B", "A", "B"]), ("none", ["C"]), ("flat", [])], "name string, args array<string>")
    pools = {(1, "A"): [f"a{i:02}" for i in range(7)], (1, "B"): [f"b{i:03}" for i in range(30)], (2, "A"): ["x"], (2, "B"): ["y", "z"], (3, "A"): [f"e{i:04}" for i in range(500)]}
    domains = spark.createDataFrame([(c, t, e) for (c, t), own in pools.items() for e in own], "case_id int, type string, entity string").repartition(3)
    got = {}
    for r in C.ground_atoms(schema, domains).collect():
        got.setdefault((r.case_id, r.symbol), []).append((tuple(r.args), r.cut))
    want = {}
    for c, (name, args) in itertools.product((1, 2, 3), [("one", ["A"]), ("two", ["A", "B"]), ("three", ["B", "A", "B"])]):
        if all((c, t) in pools for t in args):
            every = list(itertools.product(*(pools[c, t] for t in args)))
            want[c, name] = [(x, len(every) > 200) for x in every[:200]]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_tokens_inside_words(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words = [(rng.randrange(3), word(rng.randint(1, 12))) for _ in range(300)]
    tokens = [(rng.randrange(3), word(rng.randint(4, 7))) for _ in range(60)] + [(0, "zzzzz")]
    got = contained(spark.createDataFrame(tokens, "g int, w string"), spark.createDataFrame(words, "g int, word string"), ["g"])
    assert {tuple(r) for r in got.collect()} == {(g, t, w) for g, t in tokens for h, w in words if g == h and t in w}


def test_snippets_by_contained_words_and_years(spark):
    text = "The overturnovers came. Nothing here. In 1999 it rained! A tribute of 2020 was due. Turnover rose."
    cases = spark.createDataFrame([(1, text), (2, "No year and no word."), (3, None)], "doc_id long, text string")
    symbols = spark.createDataFrame([("turnover_x", ""), ("turn", "a tribute"), ("nope", "x"), ("big", None)], "symbol string, description string")
    pairs = spark.createDataFrame([(i, s) for i in (1, 2, 3) for s in ("turn", "nope", "big", "turnover_x")], "doc_id long, symbol string")
    got = {}
    for r in T.evidence_snippets(cases, symbols, pairs=pairs).orderBy("rank").collect():
        got.setdefault((r.doc_id, r.symbol, r.by), []).append(r.pos)
    assert got == {(1, "turn", "keyword"): [0, 3, 4], (1, "nope", "year"): [2, 3], (1, "big", "year"): [2, 3], (1, "turnover_x", "keyword"): [0, 4]}
    assert T.evidence_snippets(cases, symbols).filter("by = 'year'").isEmpty()


def test_guard_over_a_replayed_log_with_late_calls(spark, tmp_path):
    """Files in order of time, then one that is hours late: its calls don't count, and the rest equals the batch guard."""
    begin = datetime.datetime(2024, 1, 1)
    rng = random.Random(9)
    rows = [(f"r{rng.randrange(4)}", "s", i, begin + datetime.timedelta(minutes=i)) for i in range(300)]
    schema = "run_id string, strategy string, call_index long, ts timestamp"
    late = [("r0", "s", 1000 + i, begin + datetime.timedelta(minutes=i)) for i in range(50)] + [("r9", "s", 2000 + i, begin) for i in range(99)]
    parts = [rows[:100], rows[100:200], late, rows[200:]]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:  # one trigger for each file
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            q = budget.guard(stream, 50).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = {(r.run_id, r.first_refused) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = L.budget_guard(spark.createDataFrame(rows, schema), 50, 10**6).filter("first_refused is not null").collect()
    assert got == {(r.run_id, r.first_refused) for r in want} and len(want) == 4


def test_empty_tables(spark):
    assert L.budget_guard(spark.createDataFrame([], "run_id string, strategy string, call_index long"), 1, 1).isEmpty()
    assert C.ground_atoms(spark.createDataFrame([], "name string, args array<string>"), spark.createDataFrame([], "case_id int, type string, entity string")).isEmpty()
    assert contained(spark.createDataFrame([], "w string"), spark.createDataFrame([("word",)], "word string")).isEmpty()


@pytest.mark.parametrize(("name", "description", "free", "bound", "odd"), [
    ("affiliated_with", "Affiliation between companies", False, False, True),
    ("forms_consortium_with", "", False, False, True),
    ("same_economic_group", "", True, False, False),
    ("same_as", "related", False, False, False),
    ("same_as", "related", False, True, True),
    ("likes", "", False, False, False),
])
def test_self_relations(spark, name, description, free, bound, odd):
    facts = spark.createDataFrame([(1, name, ["c", "c"]), (1, name, ["c", "d"]), (1, "legal_person", ["c"])], "case_id int, symbol string, args array<string>")
    symbols = spark.createDataFrame([(name, description, free, bound)], "name string, description string, reflexive_allowed boolean, non_reflexive boolean")
    assert C.self_relations(facts, symbols).count() == odd


def test_folded_characters(spark):
    import unicodedata

    from casemill.functions.text import ascii_fold

    text = "aé𝐀𝔹𝟘𝒞ﬁ②Ａ ß漢"
    single = lambda c: c if c.isascii() else n if len(n := unicodedata.normalize("NFKD", c)) == 1 and n.isascii() else "?"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(ascii_fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == ["".join(map(single, text)), None]
