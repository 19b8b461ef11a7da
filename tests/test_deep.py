"""Long chains, deep rules, alternatives, and literals on either side."""

import json

import pytest
from pyspark.sql import functions as F

from casemill.operators import infer as E
from casemill.operators import logs as L
from casemill.operators import rules as D


def test_chain_of_seventy(spark):
    edges = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = D.closure(edges, spark.createDataFrame([(0,)], "target long"))
    assert (got.count(), got.agg(F.max("depth")).first()[0]) == (71, 70)


def test_eight_levels_and_turned_literals(spark):
    node = {"compare": {"left": 5, "op": "<", "right": {"func": "f", "args": ["x"]}}}
    for i in range(8):
        node = {"not": node} if i % 2 else {"and": [node, {"pred": f"p{i}", "args": ["x"]}]}
    rules = spark.createDataFrame([(1, 0, json.dumps({"if": [node], "then": [{"pred": "q", "args": ["x"]}]}))], "set_id int, rule int, rule_json string")
    assert [(r.func, r.op, r.literal) for r in D.rule_compares(rules).collect()] == [("f", ">", 5.0)]
    assert {r.symbol for r in D.rule_atoms(rules).collect()} == {"p0", "p2", "p4", "p6", "q"}


def test_alternatives_and_unreadable_rules(spark):
    facts = spark.createDataFrame([(1, "a", ["x"], True, None), (2, "b", ["x"], True, None), (3, "f", ["x"], None, "7"), (4, "f", ["x"], None, "3")], "case_id long, symbol string, args array<string>, polarity boolean, value string")
    rule = {"if": [{"or": [{"pred": "a", "args": ["v"]}, {"pred": "b", "args": ["v"]}, {"compare": {"left": 5, "op": "<", "right": {"func": "f", "args": ["v"]}}}]}], "then": [{"pred": "q", "args": ["v"]}]}
    table = lambda *r: spark.createDataFrame([(1, i, x) for i, x in enumerate(r)], "set_id int, rule int, rule_json string")
    got = E.apply_rules(facts, table(json.dumps(rule))).filter("symbol = 'q'").collect()
    assert sorted(r.case_id for r in got) == [1, 2, 3]
    with pytest.raises(ValueError, match="can't be read"):
        E.apply_rules(facts, table(json.dumps(rule), "{"))


def test_thirty_rounds(spark):
    rules = [{"if": [{"pred": f"s{i}", "args": ["v"]}], "then": [{"pred": f"s{i + 1}", "args": ["v"]}]} for i in range(25)]
    table = spark.createDataFrame([(1, i, json.dumps(r)) for i, r in enumerate(rules)], "set_id int, rule int, rule_json string")
    facts = spark.createDataFrame([(1, "s0", ["x"], True, None)], "case_id long, symbol string, args array<string>, polarity boolean, value string")
    assert E.apply_rules(facts, table).agg(F.max("round")).first()[0] == 25


@pytest.mark.parametrize(("message", "code"), [
    ("Expected an object, got invalid JSON", "json_parse_error"),
    ("rule negating observable/background prerequisites", "unsafe_inverse_negative_legal_output"),
    ("'f' used as a Bool predicate atom but declared only under functions", "function_used_as_predicate"),
    ("the same variable twice in a between-entities relation", "suspicious_self_relation"),
    ("No derived legal outputs in the table", "missing_legal_effect_output"),
    ("years do not count as temporal support", "missing_temporal_support_symbol"),
    ("no_helper_definition_progress", "no_helper_definition_progress"),
])
def test_error_codes(spark, message, code):
    assert L.normalize_errors(spark.createDataFrame([(message,)], "message string")).first()["error_code"] == code


def test_json_of_any_depth(spark):
    from casemill.sources import readers as R

    deep = "1"
    for _ in range(9):
        deep = '{"k": [' + deep + "]}"
    got = R.flatten_json(spark.createDataFrame([(1, deep), (2, None), (3, "no json")], "id long, j string"), "j", "id").collect()
    assert [(r.id, r.path, r.value) for r in got] == [(1, ".".join(["k.0"] * 9), "1")]


def test_types_of_rules(spark):
    rule = {"forall": [{"var": "x", "type": "A"}], "if": [{"pred": "f", "args": ["x"]}, {"pred": "p", "args": ["y"]}, {"pred": "r", "args": ["x"]}, {"compare": {"left": {"func": "f", "args": ["x"]}, "op": "=", "right": "word"}}], "then": [{"pred": "p", "args": ["x", "x"]}]}
    rules = spark.createDataFrame([(1, 0, json.dumps(rule))], "set_id int, rule int, rule_json string")
    symbols = spark.createDataFrame([(1, "f", ["A"], "Int"), (1, "p", ["A"], "Bool"), (1, "r", ["B"], "Bool")], "set_id int, name string, args array<string>, returns string")
    got = {(r.side, r.path, r.arg, r.code) for r in D.rule_types(rules, symbols).collect()}
    assert got == {("if", "0", -1, "function_as_predicate"), ("if", "1", 0, "unbound"), ("if", "2", 0, "sort"), ("if", "3", -1, "unlike_sorts"), ("then", "0", -1, "arity")}
