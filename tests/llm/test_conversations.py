"""Cheapest repairs against a search over all prefixes, cut into chunks of any size."""

import hashlib
import random

import pytest

from casemill.llm import op12_conversations as V

INS = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
FULL = {"u": "user", "a": "assistant"}


def brute(rows):
    """rows (turn, role, text) in order -> counts, cost, audit, digest, by a table of the best prefix for each state."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}

    def inserted(table):
        for _ in range(2):
            for s, (c, a, o) in list(table.items()):
                who, t = INS[s]
                new = (c + 3, a + "I", (*o, f"{FULL[who]}:"))
                table[t] = min(table.get(t, new), new)
        return table

    for (_, role, text), fault in zip(rows, faults, strict=True):
        ahead = {}
        for s, (c, a, o) in inserted(best).items():
            options = [(s, (c + 4, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                k = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if k:
                    options.append((k, (c, a + "K", (*o, f"{role}:{text}"))))
                who, t = INS[s]
                options.append((t, (c + 3, a + "R", (*o, f"{FULL[who]}:{text}"))))
            for t, x in options:
                ahead[t] = min(ahead.get(t, x), x)
        best = ahead
    cost, audit, lines = min(x for s, x in inserted(best).items() if s in (0, 3))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_against_all_prefixes(spark, chunk):
    rng = random.Random(chunk)
    table = {}
    for conv in range(60):
        n = rng.choice([0, 1, 2, 5, 9, 40, 120 if conv % 9 == 0 else 7])
        turns = sorted(rng.sample(range(3 * n + 1), n))
        table[conv] = [(t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", "udo"]), rng.choice(["", " ", "no stop", "Yes.", f"Number {t}!", f"Part {t}", "Well?  "])) for t in turns]
    table[None] = [(1, "user", "Hi."), (2, "user", "Hi.")]
    table[77] = [(None, "assistant", "First."), (None, "assistant", "First."), (None, "user", "Second."), (4, "assistant", "First.")]
    rows = [(c, *r) for c, own in table.items() for r in own]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in V.summary(V.repair(turns, chunk=chunk)).collect()}
    assert got == {c: brute(own) for c, own in table.items() if own}


def test_long_conversation_over_many_passes(spark):
    """Rows that may all be kept let a chunk's costs depend on what follows for as long as they go on."""
    rows = [(0, i, "assistant" if i % 2 else "user", f"Turn {i}.") for i in range(501)] + [(1, i, "user" if i < 300 else "assistant", f"Turn {i}") for i in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in V.summary(V.repair(turns, chunk=16)).collect()}
    assert got == {c: brute([r[1:] for r in rows if r[0] == c]) for c in (0, 1)}


def test_nulls_repeats_and_empty(spark):
    schema = "conv_id string, turn long, role string, text string, g int, codes int"
    rows = [("a", 1, None, None, 1, 2), ("a", 2, "user", None, 1, 2), *[("a", 3, "user", "Same.", 1, 2)] * 1000, ("b", None, None, "x" * 3_000_000, 1, 2)]
    got = {r.conv_id: r for r in V.summary(V.repair(spark.createDataFrame(rows, schema), chunk=100)).collect()}
    assert (got["a"].blank, got["a"].duplicate, got["a"].cost) == (2, 999, 4 * 1001 + 3)
    assert got["a"].audit == "DDK" + "D" * 999 + "I"
    assert (got["b"].truncated, got["b"].audit, got["b"].cost) == (1, "D", 4)
    assert V.summary(V.repair(spark.createDataFrame([], schema))).count() == 0


def test_query_names_conversations_without_rows(spark, tmp_path):
    rows = [(i, 0, "user", "Hi.") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = V.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(r.conv_id for r in got) == list(range(60))
    empty = [r for r in got if r.audit == ""]
    assert empty and {(r.cost, r.gaps, r.repaired_sha256) for r in empty} == {(0, 0, hashlib.sha256(b"").hexdigest())}
