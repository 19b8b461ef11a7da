"""Queries of call-log and repair-log analytics, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import logs as L
from casemill.plans.fixtures import table

_PRICED = """SELECT c.*, CASE WHEN usd_in IS NOT NULL AND (prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL) THEN round(coalesce(prompt_tokens * usd_in, 0) + coalesce(completion_tokens * usd_out, 0)) / 1e6 END AS cost_usd
 FROM fx_calls c LEFT JOIN (SELECT model, arg_min(usd_in, pos) AS usd_in, arg_min(usd_out, pos) AS usd_out FROM (SELECT DISTINCT model FROM fx_calls) m JOIN fx_prices p ON contains(m.model, p.model_key) GROUP BY model) p ON c.model = p.model"""
_CODED = """SELECT *, CASE event_index % 5 WHEN 0 THEN 'missing_helper_definition' WHEN 1 THEN 'unknown_symbol' WHEN 2 THEN 'type_mismatch' WHEN 3 THEN 'unknown_validation_error' ELSE 'idp_render_error' END AS error_code,
 CASE event_index % 5 WHEN 0 THEN concat('other::helper predicate ''h', event_index % 3, ''' has no defining rule') WHEN 1 THEN 'unknown_symbol::rules[3].if: unknown predicate foo' WHEN 2 THEN 'type_mismatch::p::arg0::Company::Year'
 WHEN 3 THEN 'other::number does not appear in the scoped law text' ELSE 'other::idp failed to parse compiled kb' END AS error_signature FROM fx_errors"""
_CODED = _CODED.replace("'unknown_validation_error' ELSE", "'numeric_threshold_not_in_law_text' ELSE")


def _priced(spark, d):
    return L.estimate_cost(table(spark, d, "fx_calls"), table(spark, d, "fx_prices"))


def _coded(spark, d):
    return L.normalize_errors(table(spark, d, "fx_errors"))


def g1_usage_summary(spark, d):
    return L.usage_summary(_priced(spark, d))


def g2_top_calls(spark, d):
    return L.top_calls(table(spark, d, "fx_calls")).select("call_index", "stage", "model", "total_tokens")


def g3_estimate_cost(spark, d):
    return _priced(spark, d).select("call_index", "cost_usd")


def g4_approx_tokens(spark, d):
    return L.approx_tokens(table(spark, d, "conversations"))


def g5_run_strategy_usage(spark, d):
    return L.run_strategy_usage(table(spark, d, "fx_calls"))


def g6_budget_guard(spark, d):
    return L.budget_guard(table(spark, d, "fx_calls"), 5, 800)


def g8_normalize_errors(spark, d):
    return _coded(spark, d).select("event_index", "error_code", "error_signature")


def g9_repeated_errors(spark, d):
    return L.repeated_errors(_coded(spark, d))


def g10_repair_rollup(spark, d):
    return L.repair_rollup(_coded(spark, d))


def g11_repair_progress(spark, d):
    return L.repair_progress(_coded(spark, d))


def g12_evidence_fingerprint(spark, d):
    return L.evidence_fingerprint(_coded(spark, d), "run_id", "error_code", "error_signature")


def g13_route_repair(spark, d):
    return L.route_repair(_coded(spark, d), 2)


def _messages(spark, d):
    return L.normalize_errors(table(spark, d, "fx_messages"))


def g8_error_signatures(spark, d):
    return _messages(spark, d).select("event_index", "error_signature")


def g13_route_messages(spark, d):
    return L.route_messages(_messages(spark, d), 30)


QUERIES = {f.__name__: f for f in (g1_usage_summary, g2_top_calls, g3_estimate_cost, g4_approx_tokens, g5_run_strategy_usage, g6_budget_guard, g8_normalize_errors, g9_repeated_errors, g10_repair_rollup, g11_repair_progress, g12_evidence_fingerprint, g13_route_repair, g8_error_signatures, g13_route_messages)}

_SIGNED = """SELECT run_id, event_index, kind, CASE kind WHEN 0 THEN 'schema::floating_helper_pred::h1' WHEN 1 THEN 'schema::json_ir_schema_design_error: derived predicates never appear in any rule then' WHEN 2 THEN 'rule::circular::d' WHEN 3 THEN 'rule::missing_helper::h2' WHEN 4 THEN 'rule::circular::?'
 WHEN 5 THEN 'type_mismatch::f::arg1::Company::Year' WHEN 6 THEN 'unbound::x' WHEN 7 THEN concat('unknown_symbol::unknown predicate p', event_index % 3) WHEN 9 THEN 'rule_shape::empty_then' WHEN 10 THEN 'arity::arity mismatch of q' WHEN 11 THEN 'other::rules[N] is tautological' ELSE concat('other::', lower(message)) END AS sig FROM fx_messages"""

SQL = {
    "g1_usage_summary": f"""WITH p AS ({_PRICED}), e AS (SELECT 'stage' AS dimension, stage AS value, * FROM p UNION ALL SELECT 'model', model, * FROM p UNION ALL SELECT 'run_id', run_id, * FROM p UNION ALL SELECT 'strategy', strategy, * FROM p UNION ALL SELECT 'all', 'all', * FROM p)
 SELECT dimension, value, count(*) AS n_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 4) AS cost_usd FROM e GROUP BY dimension, value""",
    "g2_top_calls": "SELECT call_index, stage, model, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS total_tokens FROM fx_calls ORDER BY total_tokens DESC, call_index LIMIT 10",
    "g3_estimate_cost": f"SELECT call_index, cost_usd FROM ({_PRICED})",
    "g4_approx_tokens": "SELECT conv_id, CAST(floor(sum(length(coalesce(text, ''))) / 4) AS BIGINT) AS approx_tokens, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "g5_run_strategy_usage": "SELECT run_id, strategy, count(*) AS n_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM fx_calls GROUP BY run_id, strategy",
    "g6_budget_guard": """WITH p AS (SELECT *, row_number() OVER (ORDER BY call_index) AS place, row_number() OVER (PARTITION BY run_id, strategy ORDER BY call_index) AS own FROM fx_calls)
 SELECT run_id, strategy, count(*) FILTER (own <= 5 AND place <= 800) AS allowed, count(*) FILTER (own > 5 OR place > 800) AS refused, min(call_index) FILTER (own > 5 OR place > 800) AS first_refused FROM p GROUP BY run_id, strategy""",
    "g8_normalize_errors": f"SELECT event_index, error_code, error_signature FROM ({_CODED})",
    "g9_repeated_errors": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY run_id, error_signature ORDER BY event_index) AS nth FROM ({_CODED}))
 SELECT run_id, error_signature, count(*) AS times, min(event_index) FILTER (nth = 2) AS stalled_at FROM s GROUP BY run_id, error_signature HAVING count(*) >= 2""",
    "g10_repair_rollup": f"""WITH f AS (SELECT run_id, error_code, min(event_index) AS first_at, max(event_index) AS last, count(*) AS n FROM ({_CODED}) GROUP BY run_id, error_code)
 SELECT run_id, CAST(sum(n) AS BIGINT) AS attempts, arg_max(error_code, last) AS final_code, count(*) AS distinct_codes, string_agg(error_code, '>' ORDER BY first_at) AS codes_in_order FROM f GROUP BY run_id""",
    "g11_repair_progress": f"""WITH w AS (SELECT run_id, event_index, error_code, error_signature, lag(error_code) OVER o AS c, lag(error_signature) OVER o AS s FROM ({_CODED}) WINDOW o AS (PARTITION BY run_id ORDER BY event_index))
 SELECT run_id, event_index, error_code, CASE WHEN c IS NULL THEN 'first' WHEN s = error_signature THEN 'same' WHEN c = error_code THEN 'same_code' ELSE 'changed' END AS progress FROM w""",
    "g12_evidence_fingerprint": f"""SELECT run_id, substr(sha256(string_agg(e, ';' ORDER BY e)), 1, 16) AS fingerprint, count(*) AS n_evidence FROM (SELECT DISTINCT run_id, concat(error_code, '|', error_signature) AS e FROM ({_CODED})) GROUP BY run_id""",
    "g13_route_repair": f"""WITH w AS (SELECT run_id, event_index, error_code, row_number() OVER (PARTITION BY run_id, error_code ORDER BY event_index) AS nth, CASE error_code WHEN 'unknown_symbol' THEN 'symbols' WHEN 'idp_render_error' THEN 'parse' ELSE 'rules' END AS base FROM ({_CODED}))
 SELECT run_id, event_index, error_code, CASE WHEN nth > 4 THEN 'stop' WHEN nth > 2 AND base = 'rules' THEN 'symbols' WHEN nth > 2 AND base = 'parse' THEN 'rules' ELSE base END AS layer FROM w""",
    "g8_error_signatures": f"SELECT event_index, sig AS error_signature FROM ({_SIGNED})",
    "g13_route_messages": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_index) - 1 AS before, row_number() OVER (PARTITION BY run_id, sig ORDER BY event_index) - 1 AS same, count(*) FILTER (kind = 7) OVER (PARTITION BY run_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unknown FROM ({_SIGNED}))
 SELECT run_id, event_index, CASE WHEN kind IN (0, 4, 8) OR (kind IN (5, 7, 10) AND before >= 30) OR (kind = 5 AND same > 0) OR (kind = 7 AND unknown > 0) THEN 'symbols' ELSE 'rules' END AS layer FROM m""",
}
