"""Types of entities, checks of facts, queries and test sets, symbol matching: expected values by hand, nulls and empty tables."""

import itertools
import random

from casemill.operators import facts as C
from casemill.operators import gaps as G
from casemill.operators import score as S
from casemill.operators import text as T

SCHEMA = "name string, args array<string>, returns string, kind string, assertable boolean"
SYMBOLS = [
    ("consequences_apply", ["Company", "FinancialYear"], "Bool", "derived", False),
    ("company_marker", ["Company"], "Bool", "observable", True),
    ("year_marker", ["FinancialYear"], "Bool", "observable", True),
    ("employees", ["Company", "FinancialYear"], "Int", "observable", True),
]
FACTS = "case_id long, symbol string, args array<string>, polarity boolean, value string"


def test_types_from_facts_queries_and_declarations(spark):
    schema = spark.createDataFrame(SYMBOLS, SCHEMA)
    facts = spark.createDataFrame([(1, "company_marker", ["bv"], True, None), (2, "company_marker", ["x"], True, None), (2, "year_marker", ["x"], True, None), (3, "employees", ["bv", "fy"], None, "5"), (3, "employees", ["zz", "fy"], True, None), (4, None, None, None, None), (4, "company_marker", ["", None], True, None)], FACTS)
    queries = spark.createDataFrame([(1, "consequences_apply", ["bv", "fy25"]), (5, "gone", ["q"]), (None, None, None)], "case_id long, symbol string, args array<string>")
    declared = spark.createDataFrame([(1, "fy25", "Company"), (3, "bv", "Person"), (5, "d", "Company"), (5, "e", "Person"), (5, "e", None), (3, "fy", "FinancialYear")], "case_id long, entity string, type string")
    got = {(r.case_id, r.entity): (r.types, r.resolved, r.source, r.status) for r in C.resolve_entity_types(facts, schema, queries, declared).collect()}
    assert got == {
        (1, "bv"): ("Company", "Company", "fact_argument+query_argument", "resolved"),
        (1, "fy25"): ("FinancialYear", None, None, "conflict"),
        (2, "x"): ("Company,FinancialYear", None, None, "conflict"),
        (3, "bv"): ("Company", "Company", "fact_argument", "resolved"),
        (3, "fy"): ("FinancialYear", "FinancialYear", "fact_argument", "resolved"),
        (5, "d"): ("", "Company", "declared", "resolved"),
        (5, "e"): ("", None, None, "unmapped"),
    }
    known = spark.createDataFrame([("Person",)], "type string")
    assert {r.entity: r.status for r in C.resolve_entity_types(facts, schema, None, declared, known).filter("case_id = 3").collect()} == {"bv": "conflict", "fy": "resolved"}
    assert C.resolve_entity_types(facts.limit(0), schema, queries.limit(0), declared.limit(0)).isEmpty()


def test_signatures_and_queries(spark):
    schema = spark.createDataFrame(SYMBOLS, SCHEMA)
    facts = spark.createDataFrame([(1, "company_marker", ["bv"], True, None), (1, "employees", ["bv", "bv"], None, "5"), (1, "consequences_apply", ["bv", "fy"], True, None), (1, "year_marker", [], True, None), (1, "year_marker", None, True, None), (1, None, ["a"], True, None), (1, "employees", ["bv", "fy"], True, None), (1, "company_marker", [None], True, None)], FACTS)
    types = spark.createDataFrame([(1, "bv", "Company"), (1, "fy", "FinancialYear")], "case_id long, entity string, resolved string")
    got = sorted(((r.symbol or "", r.code, r.pos, r.expected, r.found) for r in C.validate_signatures(facts, schema, types).collect()), key=lambda g: g[:3])
    assert [g[:3] for g in got] == [("", "unknown_symbol", -1), ("company_marker", "wrong_argument_type", 0), ("consequences_apply", "not_assertable", -1), ("employees", "truth_for_function", -1), ("employees", "wrong_argument_type", 1), ("year_marker", "wrong_arity", -1), ("year_marker", "wrong_arity", -1)]
    assert got[4][3:] == ("FinancialYear", "Company") and got[1][3:] == ("Company", None)
    q = [(1, "company_marker", ["bv"]), (2, "company_marker", ["This company"]), (3, "company_marker", ["Company"]), (4, "company_marker", ["other"]), (5, "year_marker", ["y25"]), (6, "company_marker", []), (7, "gone", ["bv"]), (8, "company_marker", [None]), (9, "company_marker", None), (10, "company_marker", ["?"])]
    queries = spark.createDataFrame([(i, 1, s, a) for i, s, a in q], "q_id long, case_id long, symbol string, args array<string>")
    domains = spark.createDataFrame([(1, "Company", "bv")], "case_id long, type string, entity string")
    run = lambda strict: {r.q_id: (r.code, r.pos) for r in C.validate_queries(queries, schema, domains, strict).collect()}
    loose = {2: ("placeholder", 0), 3: ("placeholder", 0), 4: ("not_in_domain", 0), 6: ("wrong_arity", -1), 7: ("unknown_symbol", -1), 8: ("placeholder", 0), 9: ("wrong_arity", -1), 10: ("placeholder", 0)}
    assert run(False) == loose and run(True) == loose | {5: ("not_in_domain", 0)}


def test_order_of_arguments_against_all_permutations(spark):
    rng = random.Random(24)
    kinds = {(c, f"e{i}"): sorted({rng.choice("ABC") for _ in range(rng.randint(0, 2))}) for c in range(3) for i in range(6)}
    domains = spark.createDataFrame([(c, t, e) for (c, e), own in kinds.items() for t in own], "case_id long, type string, entity string")
    rows = []
    for q in range(120):
        types = [rng.choice("ABC") for _ in range(rng.randint(0, 6))]
        rows.append((q, rng.randrange(3), [rng.choice(["e0", "e1", "e2", "e3", "e4", "e5", "unknown", None]) for _ in range(rng.randint(0, len(types)))], types))
    rows += [(900, 0, ["e1", "e2"], ["A"]), (901, 0, None, ["A", "B"]), (902, 0, ["e1"], None), (903, None, ["e1", "a"], ["A", "B"])]
    got = {r.q_id: r.args for r in G.assign_arguments(spark.createDataFrame(rows, "q_id long, case_id long, args array<string>, types array<string>"), domains).collect()}
    assert len(got) == len(rows)
    for q, c, args, types in rows[:120]:
        if not args:
            assert got[q] == args
            continue
        full = [a if a and a != "unknown" and a.upper() not in types else "" for a in args] + [""] * (len(types) - len(args))
        if 2 <= len(types) <= 5:
            fit = lambda p: sum(types[j] in kinds.get((c, full[e]), []) for j, e in enumerate(p))
            best = max(enumerate(itertools.permutations(range(len(types)))), key=lambda x: (fit(x[1]), sum(j == e for j, e in enumerate(x[1])), -x[0]))[1]
            full = [full[e] for e in best]
        assert got[q] == full, (q, args, types)
    assert got[900] == ["e1", "e2"] and got[901] is None and got[902] == ["e1"] and got[903] == ["e1", ""]


def test_match_by_name_question_and_kind(spark):
    symbols = spark.createDataFrame([("has_right", "derived", False, True), ("prior_year", "observable", True, False), ("owns_land", "observable", False, False), ("landOwner", "helper", False, False), (None, "derived", False, False), ("", "derived", False, False)], "name string, kind string, background boolean, effect boolean")
    hints = spark.createDataFrame([(1, "OWNS-land", None), (2, "land", "Who owns it?"), (3, None, None), (4, "prior year", "Do consequences apply in the prior year?"), (5, "", "the right of way"), (6, "zz", "what land?")], "hint_id long, hint string, question string")
    got = {r.hint_id: (r.name, r.score) for r in T.lexical_match(hints, symbols).collect()}
    # a question token loses its final s, a name token keeps it
    assert got == {1: ("owns_land", 1.0), 2: ("landOwner", 0.666667), 4: ("has_right", 0.35), 5: ("has_right", 0.35), 6: ("landOwner", 0.35)}
    got = {r.hint_id: (r.name, r.score) for r in T.lexical_match(hints, symbols, prefer_derived=True).collect()}
    assert got == {1: ("owns_land", 1.0), 2: ("landOwner", 0.666667), 3: ("has_right", 0.25), 4: ("has_right", 0.6), 5: ("has_right", 0.6), 6: ("landOwner", 0.35)}
    assert T.lexical_match(hints, symbols.limit(0)).isEmpty() and T.lexical_match(hints.limit(0), symbols).isEmpty()


def test_replacement_roles_and_scores(spark):
    cols = "set_id long, name string, kind string, description string, returns string, legal_output boolean, category string, directly_observable boolean, case_input boolean, asked boolean, stated boolean"
    row = lambda n, k, ret="Bool", d="", direct=None, out=None: (1, n, k, d, ret, out, None, direct, None, None, None)
    symbols = spark.createDataFrame([row("annual_turnover", "observable", "Int"), row("criterion_count", "helper", "Int"), row("pays_tax", "observable"), row("must_pay", "observable", out=True), row("exceeds_limit", "observable"), row("exceeds_turnover", "observable", direct=True), row("big", "derived"), row(None, None, None)], cols)
    roles = C.replacement_roles(symbols)
    assert {r.name: r.role for r in roles.collect()} == {"annual_turnover": "function", "pays_tax": "predicate", "exceeds_turnover": "threshold"}
    rejected = spark.createDataFrame([(1, "exceeds_annual_limit", "computed_composite", 7), (1, "exceeds_annual_limit", "computed_composite", None), (1, "odd", "x", 8), (2, "odd", None, 7), (1, None, None, None)], "set_id long, name string, code string, case_id long")
    cases = spark.createDataFrame([(7, "annual turnover"), (8, None)], "case_id long, text string")
    got = {(r.rejected, r.case_id, r.suggested): (r["rank"], r.score, r.reasons) for r in C.suggest_replacements(rejected, roles, cases=cases).collect()}
    jac, told = round(2.5 * 1 / 4 + 0.45, 6), round(2.5 * 1 / 4 + 0.45 + 1.8, 6)
    assert got == {
        ("exceeds_annual_limit", 7, "annual_turnover"): (1, told, "name,case_text,numeric_function"),
        ("exceeds_annual_limit", 7, "exceeds_turnover"): (2, round(2.5 / 4 + 1.8 / 3 + 0.4, 6), "name,case_text,observable"),
        ("exceeds_annual_limit", None, "annual_turnover"): (1, jac, "name,numeric_function"),
        ("exceeds_annual_limit", None, "exceeds_turnover"): (2, round(2.5 / 4 + 0.4, 6), "name,observable"),
        ("odd", 8, "exceeds_turnover"): (1, 0.4, "observable"),
    }


def test_test_set_faults(spark):
    runs = spark.createDataFrame([("run_001",), ("run_002",)], "run_id string")
    listed = [("run_001", "inheritance", "core", "basic", ["legal_effect"])]
    cols = "run_id string, law_domain string, evaluation_group string, difficulty string, phenomena array<string>"
    e = "struct<mode:string,value:string,reason:string>"
    questions = spark.createDataFrame([("run_001", "q1", "ask?", ("boolean", "true", "why")), ("run_002", "q1", "ask?", ("explanation", None, "why"))], f"run_id string, q_id string, q_text string, expected {e}")
    files = spark.createDataFrame([("run_001/run.json",), ("run_002/run.json",)], "path string")
    faults = lambda m, q=questions, f=files: sorted((r.run_id or "", r.error) for r in S.validate_runs(runs, spark.createDataFrame(m, cols), q, f).collect())
    both = [*listed, ("run_002", "company", "stress", "hard", ["temporal", "open_world"])]
    assert faults(both) == []
    assert faults(listed) == [("run_002", "not_in_manifest")]
    assert faults([*both, ("run_003", "company", "core", "extreme", ["temporal"])]) == [("run_003", "listed_but_missing"), ("run_003", "missing_file"), ("run_003", "unknown_difficulty")]
    assert faults([*both, both[0], (None, None, None, None, None)]) == [("", "missing_id"), ("run_001", "duplicate_listing")]
    bad = spark.createDataFrame([("run_001", "q1", "ask?", ("boolean", None, None)), ("run_002", None, None, None)], questions.schema)
    assert faults(both, bad) == [("run_001", "missing_reason"), ("run_001", "missing_value"), ("run_002", "no_questions")]
    made = files.union(spark.createDataFrame([("run_001/score.json",), ("run_002/work/x",), ("other/score.json",), ("score.json",), (None,)], "path string"))
    assert faults(both, questions, made) == [("run_001", "generated_file"), ("run_002", "generated_folder")]
    assert S.validate_runs(runs.limit(0), spark.createDataFrame([], cols), questions.limit(0), files.limit(0)).isEmpty()


def test_scores_of_intents_and_atoms(spark):
    atoms = "array<struct<predicate:string,args:array<string>>>"
    rows = [(1, "ok", True, True, "deduction", None, None, [("p", ["A"])], [], True), (2, "ok", None, None, "propagation", "p", [" a"], [("p", ["A "])], [], True), (3, "ok", None, None, "propagation", "p", ["a"], [("p", ["A"])], [], False), (4, "ok", None, None, "propagation", "p", ["a"], None, None, False), (5, "ok", None, None, "propagation", None, None, [], [], False), (6, "Error", True, True, "get_range", None, None, [], [], True), (7, "", False, True, "explain", None, None, [], [], True), (8, "ok", True, True, None, None, None, None, None, None)]
    x = spark.createDataFrame(rows, f"q_id long, status string, certain boolean, possible boolean, intent string, target_predicate string, target_args array<string>, certain_true {atoms}, certain_false {atoms}, expected_value boolean")
    got = {r.q_id: r.outcome for r in S.score_boolean(S.credence(x)).collect()}
    assert {k: v for k, v in got.items() if k not in (2, 3, 4)} == {1: "correct", 5: "unscored_intent", 6: "status_error", 7: "unscored_intent", 8: "not_scored"}
    assert [got[k] for k in (2, 3, 4)] == ["correct", "incorrect", "inconclusive"]
    member = {r.q_id: r.outcome for r in S.score_membership(x).collect()}
    assert [member[k] for k in (2, 3, 4, 8)] == ["correct", "incorrect", "inconclusive", "not_scored"]


def test_period_phrases_and_support(spark):
    rows = [(1, "Effects apply from the following year. In the NEXT  year, the following year.", "Two consecutive years?", None, None), (2, "the following year", None, True, None), (3, "consequences apply", "", None, None), (4, "consequences apply next year", None, False, False), (5, None, None, True, True), (6, "consequences apply next year", None, False, None)]
    got = {r.id: (r.terms, r.legal_effect, r.needs_support) for r in T.temporal_support(spark.createDataFrame(rows, "id int, law_text string, question string, asks_effect boolean, has_effect boolean")).collect()}
    assert got[1][0] == ["following year", "next  year", "from the following", "consecutive years", "two consecutive years"]
    assert {k: v[1:] for k, v in got.items() if k > 1} == {2: (True, True), 3: (True, False), 4: (False, False), 5: (True, False), 6: (True, True)}


def test_names_in_questions(spark):
    asked = ["Is Anna an heir?", "  Krijgt Els iets?", "what applies to it", None, "Does A pay?", "about Filip and for Jan"]
    x = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "id int, q string")
    assert [r.n for r in x.orderBy("id").select(C.named_in_question(x.q).alias("n")).collect()] == ["anna", "els", None, None, None, "filip"]
