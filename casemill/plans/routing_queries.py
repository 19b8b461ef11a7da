"""Queries of routing, symbol classes and gaps, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.text import CLASS_CATEGORIES, EFFECT_CATEGORIES, EFFECT_PATTERNS, EFFECT_TOKENS, STEP_MARKERS
from casemill.operators import coverage as K
from casemill.operators import routing as R
from casemill.operators import rules as D
from casemill.plans.facts_queries import _COV, _coverage, _facts, _queries, _schema
from casemill.plans.fixtures import table


def _questions(spark, d):
    k = F.col("q_id") % 11
    return table(spark, d, "fx_questions").select(
        "q_id",
        F.col("q_text").alias("text"),
        F.when(k == 0, "get_range").alias("expected_intent"),
        F.when(k == 1, "boolean").when(k == 2, "set").alias("expected_mode"),
        F.when(k.isin(3, 4), "intent").when(k.isin(5, 6, 7), "predicate").alias("query_type"),
        F.when(k == 3, "explain").when(k == 4, "no_such").alias("query_intent"),
        F.when(k == 5, "set").alias("query_mode"),
        (k == 6).alias("query_explain"),
    )


def b14_route_question(spark, d):
    return R.route_question(_questions(spark, d)).select("q_id", "type", "intent", "fallback", "scorable", "reason")


def b24_classify_symbols(spark, d):
    return R.classify_symbols(table(spark, d, "fx_named")).select("p_partkey", "symbol_class", "status_like", "computed")


def c12_assertable(spark, d):
    return R.assertable(table(spark, d, "fx_named")).select("p_partkey", "allowed", "code")


def c14_schema_env(spark, d):
    return R.schema_env(table(spark, d, "fx_named"))


def c25_case_input_candidates(spark, d):
    return R.case_input_candidates(table(spark, d, "fx_named"), _uses(spark, d)).distinct()


def c27_rejection_report(spark, d):
    orders = table(spark, d, "orders")
    named = R.assertable(table(spark, d, "fx_named")).filter("code is not null").select("p_partkey", F.col("name").alias("symbol"), "code")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rejects = lines.select(F.col("o_custkey").alias("case_id"), F.col("l_partkey").alias("p_partkey")).join(named, "p_partkey")
    instead = named.filter("p_partkey % 2 = 0").select("symbol", F.concat(F.lit("use_"), F.col("p_partkey") % 5).alias("replacement"))
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").contains("99").alias("has_numbers"), (F.col("c_custkey") % 4).alias("n_facts"))
    return R.rejection_report(rejects, instead, cases)


def _uses(spark, d):
    """Two atoms of each order line's rule: its part is used, and every sixth part is defined."""
    named = table(spark, d, "fx_named").select("p_partkey", "set_id", F.col("name").alias("symbol"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("rule"), (F.col("l_linenumber") % 2 == 0).alias("negated"), F.array(F.concat(F.lit("v"), F.col("l_suppkey") % 3)).alias("args"))
    side = F.when(F.col("p_partkey") % 6 == 0, "then").otherwise("if")
    return lines.join(named, "p_partkey").select("set_id", "rule", "symbol", side.alias("side"), "negated", "args")


def d7_unsafe_negative_rules(spark, d):
    return D.unsafe_negative_rules(_uses(spark, d), table(spark, d, "fx_named").select("set_id", "name", "kind").distinct())


def d8_unsafe_composites(spark, d):
    return R.unsafe_composites(_uses(spark, d), table(spark, d, "fx_named")).distinct()


def d16_role_conflicts(spark, d):
    return R.role_conflicts(_uses(spark, d), table(spark, d, "fx_named"))


def d17_output_coverage(spark, d):
    texts = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("set_id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, F.lit(" This takes effect from the next year.")).otherwise("")).alias("text"))
    return R.output_coverage(texts, table(spark, d, "fx_named").filter("p_partkey % 13 in (0, 3, 4, 9)"))


def _gap_rows(spark, d):
    rules = table(spark, d, "fx_rules")
    one = lambda df: df.withColumn("set_id", F.lit(1))
    return K.proof_gap_rows(_coverage(spark, d), one(_queries(spark, d)), _schema(spark, d), one(_facts(spark, d)), D.rule_atoms(rules), D.rule_compares(rules)).drop("set_id")


def e16_proof_gap_rows(spark, d):
    return _gap_rows(spark, d)


def e17_classify_gap(spark, d):
    k = F.col("case_id") % 6
    q = _queries(spark, d)
    results = q.select("q_id", F.when(k == 0, "error").otherwise("ok").alias("status"), F.when(k == 1, "unknown").otherwise("entailed").alias("label"), (k == 2).alias("certain"), (k >= 3).alias("has_numbers"))
    return R.classify_gap(_gap_rows(spark, d), q.filter(k == 4).select("q_id"), results)


QUERIES = {f.__name__: f for f in (b14_route_question, b24_classify_symbols, c12_assertable, c14_schema_env, c25_case_input_candidates, c27_rejection_report, d7_unsafe_negative_rules, d8_unsafe_composites, d16_role_conflicts, d17_output_coverage, e16_proof_gap_rows, e17_classify_gap)}


def _has(text, *patterns):
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){p}')" for p in patterns) + ")"


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


_TYPES = "CASE " + " ".join(f"WHEN {_has('q_text', *p)} THEN '{k}'" for k, p in R.QUESTION_PATTERNS.items()) + " END"
_ROUTE = f"""WITH q AS (SELECT q_id, q_text, q_id % 11 AS k, {_TYPES} AS said FROM fx_questions),
 t AS (SELECT q_id, q_text, CASE WHEN k = 0 THEN 'range_value' WHEN k = 1 THEN 'boolean' WHEN k = 2 THEN 'possible_list' WHEN k = 3 THEN 'explanation' WHEN said IS NOT NULL THEN said WHEN k = 5 THEN 'possible_list' WHEN k = 6 THEN 'explanation' WHEN k = 7 THEN 'boolean' ELSE 'unknown' END AS type,
  CASE WHEN k = 1 THEN 'expected.mode=boolean' WHEN k IN (0, 2) THEN 'expected_answer_shape' WHEN k = 3 THEN 'extracted_intent_query' WHEN said IS NOT NULL THEN 'question_text_patterns' WHEN k IN (5, 6, 7) THEN 'extracted_query_hint' ELSE 'no_clear_signals' END AS reason FROM q),
 i AS (SELECT *, CASE type WHEN 'consistency' THEN 'satisfiable' WHEN 'explanation' THEN 'explain' WHEN 'range_value' THEN CASE WHEN {_has('q_text', *R.EXTREME_PATTERNS)} THEN 'optimization' ELSE 'get_range' END WHEN 'possible_list' THEN 'model_expansion' WHEN 'boolean' THEN 'deduction' ELSE 'unknown' END AS intent FROM t)
 SELECT q_id, type, intent, CASE WHEN type = 'explanation' THEN 'relevance' WHEN intent = 'optimization' THEN 'get_range' WHEN intent = 'get_range' THEN 'optimization' WHEN type = 'possible_list' THEN 'deduction_set' WHEN type = 'unknown' THEN 'deduction' END AS fallback, intent NOT IN ('unknown', 'explain') AS scorable, reason FROM i"""
_WORDS = "(?:^|[^a-z0-9_])(?:" + "|".join(R.THRESHOLD_WORDS) + ")(?:$|[^a-z0-9_])"
_BOTH = "concat(coalesce(name, ''), ' ', coalesce(description, ''))"
_CLASSED = f"""SELECT *, CASE WHEN {_has(_BOTH, *R.FACTUAL)} THEN 'factual' WHEN {_has(_BOTH, *R.CONCLUSION)} THEN 'conclusion' WHEN {_has(_BOTH, _WORDS)} OR {_has('name', *R.THRESHOLD_NAMES)} THEN 'threshold' ELSE 'none' END AS symbol_class,
 {_has('name', *R.STATUS_NAMES)} OR regexp_matches(lower({_BOTH}), '{R.STATUS_WORDS}') AS status_like,
 CASE WHEN legal_output THEN 'effect' WHEN NOT legal_output THEN 'classification' WHEN category IN ({_in(EFFECT_CATEGORIES)}) THEN 'effect' WHEN category IN ({_in(CLASS_CATEGORIES)}) THEN 'classification' WHEN kind = 'helper' THEN 'intermediate'
  WHEN kind IN ('derived', 'conclusion') AND ({' OR '.join(f"contains(name, '{m}')" for m in STEP_MARKERS)}) THEN 'intermediate' WHEN kind IN ('derived', 'conclusion') AND list_has_any(regexp_split_to_array(name, '[^a-z0-9]+'), [{_in(EFFECT_TOKENS)}]) THEN 'effect'
  WHEN starts_with(name, 'is_') OR starts_with(name, 'has_') THEN 'classification' ELSE 'none' END AS output FROM fx_named"""
_ASSERT = f"""SELECT *, CASE WHEN asked THEN 'query_predicate' WHEN directly_observable OR case_input OR kind = 'background' THEN NULL
 WHEN kind = 'observable' THEN CASE WHEN legal_output THEN 'legal_output' WHEN symbol_class IN ('conclusion', 'threshold') AND NOT stated THEN 'computed_composite' END
 WHEN output = 'effect' THEN 'legal_output' WHEN output = 'classification' THEN 'classification_output' WHEN kind IN ('helper', 'derived', 'conclusion') THEN CASE WHEN NOT stated THEN 'derived_or_helper' END
 WHEN symbol_class IN ('conclusion', 'threshold') THEN CASE WHEN NOT stated THEN 'computed_composite' END ELSE 'unsupported_kind' END AS code FROM ({_CLASSED})"""
_USES = "SELECT set_id, l_orderkey AS rule, name AS symbol, CASE WHEN p_partkey % 6 = 0 THEN 'then' ELSE 'if' END AS side, l_linenumber % 2 = 0 AS negated, concat('v', l_suppkey % 3) AS arg FROM lineitem JOIN fx_named ON l_partkey = p_partkey"
_GAPS = f"""SELECT q_id, symbol, atom, CASE WHEN status = 'present' THEN 'directly_present' WHEN status = 'helper_defined' OR symbol IN ('big_order', 'is_priority_customer') THEN 'derivable_from_rules' ELSE 'missing_entirely' END AS gap_status, CASE symbol WHEN 'big_order' THEN '0' WHEN 'is_priority_customer' THEN '1' ELSE '' END AS rules FROM ({_COV})
 UNION ALL SELECT concat(k, c_custkey), 'total_price', 'total_price(...)', CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'directly_present' ELSE 'blocked_by_missing_numeric' END, '0' FROM customer, (VALUES ('p'), ('d')) AS t(k)"""

SQL = {
    "b14_route_question": _ROUTE,
    "b24_classify_symbols": f"SELECT p_partkey, symbol_class, status_like, symbol_class IN ('conclusion', 'threshold') AS computed FROM ({_CLASSED})",
    "c12_assertable": f"SELECT p_partkey, code IS NULL AS allowed, code FROM ({_ASSERT})",
    "c14_schema_env": f"""SELECT set_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (code IS NULL), '') AS assertable, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (output IN ('effect', 'classification')), '') AS outputs,
 coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (regexp_matches(name, '(^|[^a-z0-9])(year|period|following|next|consecutive|duration)([^a-z0-9]|$)')), '') AS temporal FROM ({_ASSERT}) GROUP BY set_id""",
    "c25_case_input_candidates": f"SELECT DISTINCT set_id, name FROM ({_CLASSED}) WHERE symbol_class = 'threshold' AND NOT status_like AND kind = 'helper' AND output NOT IN ('effect', 'classification') AND (set_id, name) IN (SELECT (set_id, symbol) FROM ({_USES}) WHERE side = 'if')",
    "c27_rejection_report": f"""WITH a AS (SELECT p_partkey, name AS symbol, code FROM ({_ASSERT}) WHERE code IS NOT NULL), s AS (SELECT symbol, string_agg(DISTINCT concat('use_', p_partkey % 5), ',' ORDER BY concat('use_', p_partkey % 5)) AS suggestions FROM a WHERE p_partkey % 2 = 0 GROUP BY symbol),
 r AS (SELECT o_custkey AS case_id, symbol, code, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a ON l_partkey = p_partkey GROUP BY 1, 2, 3)
 SELECT case_id, r.symbol, code, n, coalesce(suggestions, '') AS suggestions, coalesce(contains(c_name, '99'), false) AS has_numbers, coalesce(c_custkey % 4, 0) = 0 AS empty_after, code IN ('computed_composite', 'derived_or_helper') AS decompose FROM r LEFT JOIN s ON r.symbol = s.symbol LEFT JOIN customer ON case_id = c_custkey""",
    "d7_unsafe_negative_rules": f"""WITH u AS ({_USES}) SELECT set_id, rule, count(*) AS n_negated FROM u WHERE side = 'if' AND negated AND (set_id, symbol) IN (SELECT (set_id, name) FROM fx_named WHERE kind = 'observable') AND (set_id, rule) IN (SELECT (set_id, rule) FROM u WHERE side = 'then' AND negated) GROUP BY set_id, rule""",
    "d8_unsafe_composites": f"""WITH u AS ({_USES}), c AS (SELECT DISTINCT set_id, name AS symbol, CASE WHEN kind = 'observable' AND symbol_class IN ('conclusion', 'threshold') THEN 'computed_observable' WHEN kind = 'helper' THEN 'undefined_helper' WHEN kind IN ('derived', 'conclusion') THEN 'undefined_derived' END AS code FROM ({_CLASSED}) WHERE NOT directly_observable AND NOT case_input)
 SELECT u.set_id, rule, u.symbol, bool_or(negated) AS negated, code FROM u JOIN c ON u.set_id = c.set_id AND u.symbol = c.symbol WHERE side = 'if' AND code IS NOT NULL AND (u.set_id, u.symbol) NOT IN (SELECT (set_id, symbol) FROM u WHERE side = 'then') GROUP BY ALL""",
    "d16_role_conflicts": f"""WITH h AS (SELECT set_id, name AS symbol, CASE WHEN {_has('name', R.DEAD, R.ALIVE)} THEN {_has('name', R.DEAD)} ELSE {_has('description', R.DEAD)} END AS dead, CASE WHEN {_has('name', R.DEAD, R.ALIVE)} THEN {_has('name', R.ALIVE)} ELSE {_has('description', R.ALIVE)} END AS alive FROM fx_named)
 SELECT u.set_id, rule, arg AS variable FROM ({_USES}) u JOIN h ON u.set_id = h.set_id AND u.symbol = h.symbol GROUP BY ALL HAVING bool_or(dead) AND bool_or(alive)""",
    "d17_output_coverage": f"""WITH t AS (SELECT doc_id % 50 AS set_id, sum(len(regexp_extract_all(lower(concat(coalesce(text, ''), CASE WHEN doc_id % 7 = 0 THEN ' This takes effect from the next year.' ELSE '' END)), '{'|'.join(f'(?:{p})' for p in EFFECT_PATTERNS)}'))) AS n_cues FROM documents GROUP BY 1),
 s AS (SELECT set_id, count(*) AS n_derived, bool_or(output = 'effect') AS effect FROM ({_CLASSED}) WHERE kind IN ('derived', 'conclusion') AND p_partkey % 13 IN (0, 3, 4, 9) GROUP BY set_id)
 SELECT t.set_id, CAST(n_cues AS BIGINT) AS n_cues, coalesce(n_derived, 0) AS n_derived FROM t LEFT JOIN s ON t.set_id = s.set_id WHERE n_cues > 0 AND NOT coalesce(effect, false)""",
    "e16_proof_gap_rows": _GAPS,
    "e17_classify_gap": f"""WITH g AS (SELECT q_id, bool_or(gap_status = 'missing_entirely') AS miss, bool_or(gap_status = 'blocked_by_missing_numeric') AS num, bool_or(gap_status = 'derivable_from_rules') AS der FROM ({_GAPS}) GROUP BY q_id), x AS (SELECT *, CAST(substr(q_id, 2) AS BIGINT) % 6 AS k FROM g),
 p AS (SELECT *, CASE WHEN k = 0 THEN 'renderer_solver_issue' WHEN num AND k < 3 AND der THEN 'extraction_gap' WHEN num AND k < 3 THEN 'genuinely_under_specified_case' WHEN miss OR num THEN 'extraction_gap' WHEN k = 4 THEN 'query_argument_issue' WHEN k = 1 THEN 'extraction_gap' ELSE 'genuinely_under_specified_case' END AS primary_cause FROM x)
 SELECT q_id, primary_cause, CASE WHEN k = 0 THEN '' ELSE array_to_string(list_sort(list_filter([CASE WHEN num AND k < 3 AND der THEN 'genuinely_under_specified_case' END, CASE WHEN k = 4 THEN 'query_argument_issue' END, CASE WHEN primary_cause = 'genuinely_under_specified_case' AND miss THEN 'extraction_gap' END], lambda z: z IS NOT NULL)), ',') END AS secondary FROM p""",
}
