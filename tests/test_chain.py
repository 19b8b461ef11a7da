"""Rules of several sets: strata, deltas, alternatives, assumptions, supports and bindings."""

import json

import pytest

from casemill.operators import chain
from casemill.operators import coverage as K
from casemill.operators import infer as E
from casemill.operators import rules as D

FACTS = "set_id int, case_id int, symbol string, args array<string>, polarity boolean, value string"


def atom(p, *args, **more):
    return {"pred": p, "args": list(args), **more}


def rule_table(spark, *rules):
    return spark.createDataFrame([(s, i, json.dumps(r)) for s, i, r in rules], "set_id int, rule int, rule_json string")


def fact_table(spark, *lines):
    """(set, case, symbol, args, polarity or value)"""
    return spark.createDataFrame([(s, c, p, a.split(","), v if isinstance(v, bool) else None, None if isinstance(v, bool) else v) for s, c, p, a, v in lines], FACTS)


def rule(body, head, *variables):
    return ({"forall": [{"var": v, "type": "T"} for v in variables]} if variables else {}) | {"if": body, "then": [head]}


def concluded(closure):
    return {(r.set_id, r.case_id, r.symbol, ",".join(r.args), r.polarity, r.rule) for r in E.atoms_of(closure).filter("round > 0").collect()}


@pytest.mark.parametrize(("edges", "want"), [
    ([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8), (8, 9), (2, 10)], {1, 2, 3, 4, 5, 6}),
    ([(i, (i + 1) % 40) for i in range(40)] + [(40, 0), (5, 41)], set(range(40))),
    ([(1, 2), (2, 3)], set()),
    ([], set()),
])
def test_strong_components(spark, edges, want):
    e = spark.createDataFrame(edges, "src int, dst int")
    assert {r.target for r in D.definition_cycles(e).collect()} == want
    of = {r.node: r.component for r in D.strong_components(e).collect()}
    reach = {n: {n} for n in of}
    for _ in of:
        for a, b in edges:
            reach[a] |= reach[b]
    assert {(a, b) for a in of for b in of if of[a] == of[b]} == {(a, b) for a in of for b in of if b in reach[a] and a in reach[b]}


def test_sets_with_equal_numbers(spark):
    rules = rule_table(spark, (1, 0, rule([atom("a", "x")], atom("t", "x"))), (2, 0, rule([atom("b", "x")], atom("t", "x"))))
    facts = fact_table(spark, (1, 7, "a", "p", True), (1, 7, "b", "q", True), (2, 7, "a", "p", True), (2, 8, "b", "q", True))
    assert concluded(E.derive(facts, rules)[1]) == {(1, 7, "t", "p", True, 0), (2, 8, "t", "q", True, 0)}
    with pytest.raises(ValueError, match="several sets"):
        E.apply_rules(facts.drop("set_id"), rules)


def test_negation_waits_for_its_symbol(spark):
    """good follows from "not bad"; bad is concluded two rounds later."""
    rules = rule_table(
        spark,
        (1, 0, rule([atom("case", "x"), atom("bad", "x", negated=True)], atom("good", "x"))),
        (1, 1, rule([atom("d1", "x")], atom("d2", "x"))),
        (1, 2, rule([atom("d2", "x")], atom("bad", "x"))),
        (1, 3, rule([atom("case", "x"), {"not": atom("good", "x")}], atom("poor", "x"))),
    )
    facts = fact_table(spark, (1, 1, "case", "p", True), (1, 1, "d1", "p", True), (1, 2, "case", "p", True))
    got = concluded(E.derive(facts, rules, {"bad", "good"})[1])
    assert {x for x in got if x[2] in ("good", "poor")} == {(1, 2, "good", "p", True, 0), (1, 1, "poor", "p", True, 3)}
    looped = rule_table(spark, (1, 0, rule([atom("p", "x"), atom("q", "x", negated=True)], atom("r", "x"))), (1, 1, rule([atom("r", "x")], atom("q", "x"))))
    with pytest.raises(ValueError, match="depends on itself"):
        E.derive(facts, looped, {"q"})


def test_alternatives_grow_with_the_tree(spark):
    """Sixteen ORs of two: 33 clauses instead of 65,536 plans."""
    wide = rule([{"or": [atom(f"p{i}", "x"), atom(f"q{i}", "x")]} for i in range(16)], atom("h", "x"))
    compiled = chain.compile_rule(0, json.dumps(wide), ())
    assert len({(c["clause"], c["head"]) for c in compiled["clauses"]}) == 33
    facts = fact_table(spark, *[(1, 1, f"{'pq'[i % 2]}{i}", "a", True) for i in range(16)], *[(1, 1, f"p{i}", "b", True) for i in range(15)])
    assert concluded(E.derive(facts, rule_table(spark, (1, 0, wide)))[1]) == {(1, 1, "h", "a", True, 0)}


def test_nested_negation_constants_and_repeated_variables(spark):
    rules = rule_table(
        spark,
        (1, 0, rule([atom("edge", "x", "y"), {"not": {"or": [atom("red", "x"), {"and": [atom("blue", "y"), atom("edge", "y", "y")]}]}}], atom("ok", "x", "y"), "x", "y")),
        (1, 1, rule([atom("edge", "x", "x")], atom("loop", "x"), "x")),
        (1, 2, rule([atom("edge", "home", "y")], atom("from_home", "y"), "y")),
        (1, 3, rule([{"compare": {"left": {"func": "size", "args": ["x"]}, "op": "!=", "right": "large"}}], atom("small", "x"), "x")),
    )
    facts = fact_table(spark, (1, 1, "edge", "a,b", True), (1, 1, "edge", "b,b", True), (1, 1, "edge", "home,c", True), (1, 1, "red", "a", True), (1, 1, "blue", "c", True), (1, 1, "size", "a", "large"), (1, 1, "size", "b", "tiny"))
    got = {(x[2], x[3]) for x in concluded(E.derive(facts, rules, {"red", "blue", "edge"})[1])}
    assert got == {("ok", "b,b"), ("ok", "home,c"), ("loop", "b"), ("from_home", "c"), ("small", "b")}


def test_long_chain_and_joins_against_plain_closure(spark):
    edges = [(i, i + 1) for i in range(14)] + [(3, 20), (20, 5)]
    facts = fact_table(spark, *[(1, 1, "edge", f"{a},{b}", True) for a, b in edges])
    want = {(a, b) for a, b in edges}
    while True:
        more = want | {(a, d) for a, b in want for c, d in edges if b == c}
        if more == want:
            break
        want = more
    named = rule_table(spark, (1, 0, rule([atom("edge", "x", "y")], atom("path", "x", "y"), "x", "y")), (1, 1, rule([atom("path", "x", "y"), atom("edge", "y", "z")], atom("path", "x", "z"), "x", "y", "z")))
    got = {tuple(map(int, x[3].split(","))) for x in concluded(E.derive(facts, named)[1])}
    assert got == want


def test_assumptions(spark):
    """a -> b, b -> c, not c: a is not possible. not p -> q, not q: p is certain."""
    rules = rule_table(
        spark,
        (1, 0, rule([atom("a", "x")], atom("b", "x"), "x")),
        (1, 1, rule([atom("b", "x")], atom("c", "x"), "x")),
        (1, 2, rule([atom("p", "x", negated=True)], atom("q", "x"), "x")),
        (2, 0, rule([atom("a", "x")], atom("d", "x"), "x")),
    )
    facts = fact_table(spark, (1, 1, "c", "k", False), (1, 1, "q", "k", False), (1, 2, "a", "k", True), (2, 1, "c", "k", False), (1, 3, "a", "k", True), (1, 3, "c", "k", False), (1, 1, "seen", "k", True))
    program, closure = E.derive(facts, rules, {"seen"})
    asked = [("1", 1, 1, "a", True), ("2", 1, 1, "p", True), ("3", 1, 2, "c", True), ("4", 2, 1, "a", True), ("5", 1, 3, "b", True), ("6", 1, 1, "other", True), ("7", 1, 1, "seen", True), ("8", 1, 2, "seen", True), ("9", 1, 1, "c", True)]
    q = spark.createDataFrame([(i, s, c, p, ["k"]) for i, s, c, p, _ in asked], "q_id string, set_id int, case_id int, symbol string, args array<string>")
    got = {r.q_id: (r.label, r.possible, r.certain) for r in E.entail_assumed(program, closure, q).collect()}
    yes, no, open_ = ("entailed", True, True), ("contradicted", False, False), ("unknown", True, False)
    assert got == {"1": no, "2": yes, "3": yes, "4": open_, "5": ("inconsistent", True, False), "6": open_, "7": yes, "8": no, "9": no}


def test_support_of_three_steps_with_two_proofs(spark):
    rules = rule_table(
        spark,
        (1, 0, rule([atom("f1", "x")], atom("s1", "x"), "x")),
        (1, 1, rule([atom("s1", "x"), atom("f2", "x", "y")], atom("s2", "x"), "x", "y")),
        (1, 2, rule([atom("f3", "x"), {"compare": {"left": {"func": "n", "args": ["x"]}, "op": ">", "right": 3}}], atom("s2", "x"), "x")),
        (1, 3, rule([atom("s2", "x"), atom("gone", "x", negated=True)], atom("goal", "x"), "x")),
        (1, 4, rule([atom("goal", "x")], atom("s1", "x"), "x")),
    )
    facts = fact_table(spark, (1, 1, "f1", "k", True), (1, 1, "f2", "k,m", True), (1, 1, "f3", "k", True), (1, 1, "n", "k", "7"), (1, 1, "f3", "z", True), (1, 1, "goal", "k", False), (1, 1, "n", "z", "1"), (1, 1, "n", "z", "2"))
    _, closure = E.derive(facts, rules, {"gone"})
    q = spark.createDataFrame([(1, 1, 1, "goal", ["k"]), (2, 1, 1, "goal", ["z"])], "q_id int, set_id int, case_id int, symbol string, args array<string>")
    goal = {("fact", "f1(k)"), ("fact", "f2(k,m)"), ("fact", "f3(k)"), ("fact", "n(k) = 7"), ("rule 0", "s1(k)"), ("rule 4", "s1(k)"), ("rule 1", "s2(k)"), ("rule 2", "s2(k)"), ("closed", "not gone(k)"), ("rule 3", "goal(k)"), ("fact", "not goal(k)")}
    rows = sorted(E.answer_support(closure, q).collect(), key=lambda r: r.step)
    assert {(r.source, r.atom) for r in rows} == goal and {r.q_id for r in rows} == {1}
    assert [r.step for r in rows] == list(range(1, len(goal) + 1))
    assert [r.round or 0 for r in rows] == sorted(r.round or 0 for r in rows)
    got = {}
    for r in E.conflict_support(closure).collect():
        got.setdefault(r.conflict, set()).add((r.source, r.atom))
    assert got == {"goal(k)": goal, "n(z)": {("fact", "n(z) = 1"), ("fact", "n(z) = 2")}}


SYMBOLS = [("relation_of", "observable"), ("condition_holds", "observable"), ("other_condition", "observable"), ("helps", "helper"), ("floats", "helper"), ("legal_result", "derived"), ("pair_result", "conclusion")]


def coverage(spark, rules, facts, queries):
    table = rule_table(spark, *rules)
    symbols = spark.createDataFrame([(s, n, k, f"about {n}") for s in (1, 2) for n, k in SYMBOLS], "set_id int, name string, kind string, description string")
    q = spark.createDataFrame(queries, "q_id int, set_id int, case_id int, symbol string, args array<string>")
    return K.antecedent_coverage(q, D.rule_atoms(table), fact_table(spark, *facts), symbols, K.quantified(table)), symbols


def test_coverage_binds_through_facts(spark):
    rules = [
        (1, 0, rule([atom("relation_of", "subject", "other"), atom("condition_holds", "other")], atom("legal_result", "subject"), "subject", "other")),
        (1, 1, rule([atom("other_condition", "subject")], atom("legal_result", "subject"), "subject")),
        (2, 0, rule([atom("helps", "x"), atom("floats", "y")], atom("legal_result", "x"), "x", "y")),
        (2, 1, rule([atom("condition_holds", "x"), atom("relation_of", "y", "x", negated=True)], atom("pair_result", "y", "x"), "x", "y")),
        (2, 2, rule([atom("relation_of", "x", "x")], atom("helps", "x"), "x")),
    ]
    facts = [(1, 1, "relation_of", "alice,bob", True), (1, 1, "condition_holds", "bob", True), (2, 1, "condition_holds", "bob", False), (2, 1, "Relation_of", "Zed,bob", True)]
    queries = [(1, 1, 1, "legal_result", ["alice"]), (2, 2, 1, "legal_result", ["alice"]), (3, 2, 1, "pair_result", ["zed", "bob"]), (4, 1, 2, "legal_result", ["alice"]), (5, 1, 1, "relation_of", ["a", "b"]), (6, 2, 1, "pair_result", ["zed"])]
    cov, symbols = coverage(spark, rules, facts, queries)
    got = {(r.q_id, r.rule, r.atom): (r.status, r.satisfied) for r in cov.collect()}
    assert got == {
        (1, 0, "relation_of(alice,bob)"): ("present", True), (1, 0, "condition_holds(bob)"): ("present", True), (1, 1, "other_condition(alice)"): ("missing", False),
        (2, 0, "helps(alice)"): ("helper_defined", False), (2, 0, "floats"): ("unknown", False),
        (3, 1, "condition_holds(bob)"): ("present", False), (3, 1, "relation_of(zed,bob)"): ("present", False),
        (4, 0, "relation_of"): ("unknown", False), (4, 0, "condition_holds"): ("unknown", False), (4, 1, "other_condition(alice)"): ("missing", False),
    }
    results = spark.createDataFrame([(1, "entailed", True), (4, "unknown", False)], "q_id int, label string, certain boolean")
    after = {(r.q_id, r.rule, r.atom): r.status for r in K.downgrade_alternatives(cov, results).collect()}
    assert after[1, 1, "other_condition(alice)"] == "missing_non_blocking" and after[4, 1, "other_condition(alice)"] == "missing"
    told = K.missing_observables(K.downgrade_alternatives(cov, results), symbols).collect()
    assert [(r.q_id, r.missing, r.described) for r in told] == [(4, "other_condition", "other_condition: about other_condition")]


def test_coverage_of_empty_tables(spark):
    cov, symbols = coverage(spark, [(1, 0, rule([atom("helps", "x")], atom("legal_result", "x"), "x"))], [(1, 1, "helps", "a", True)], [(1, 1, 1, "no_such", ["a"])])
    assert cov.isEmpty() and K.missing_observables(cov, symbols).isEmpty()
    _, closure = E.derive(fact_table(spark, (1, 1, "a", "b", True)).limit(0), rule_table(spark, (1, 0, rule([atom("a", "x")], atom("b", "x"), "x"))))
    assert E.atoms_of(closure).isEmpty() and E.conflict_support(closure).isEmpty()
