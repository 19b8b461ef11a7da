"""Queries of answer scoring and evaluation aggregates, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import score as S
from casemill.plans.fixtures import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

_METRICS = """count(*) AS total_cells, count(*) FILTER (scored) AS scored_cells,
 CAST(coalesce(sum(total) FILTER (scored), 0) AS BIGINT) AS total_questions,
 CAST(coalesce(sum(correct_decisive) FILTER (scored), 0) AS BIGINT) AS decisive_correct,
 CAST(coalesce(sum(incorrect_decisive) FILTER (scored), 0) AS BIGINT) AS decisive_wrong,
 CAST(coalesce(sum(inconclusive) FILTER (scored), 0) AS BIGINT) AS inconclusive,
 count(*) FILTER (failure_category = 'law_compilation') AS law_compilation_failures,
 count(*) FILTER (failure_category IN ('case_extraction', 'translation')) AS extraction_failures,
 count(*) FILTER (failure_category IN ('reasoning_symbol_mismatch', 'case_query_validation', 'kb_compile_validation', 'kb_idp_parse', 'kb_semantic', 'kb_lint')) AS symbolic_failures"""
_RATES = """decisive_correct + decisive_wrong AS decisive_answers, law_compilation_failures / nullif(total_cells, 0) AS compile_failure_rate,
 inconclusive / nullif(total_questions, 0) AS inconclusive_rate, decisive_wrong / nullif(decisive_correct + decisive_wrong, 0) AS decisive_wrong_rate,
 decisive_correct / nullif(total_cells, 0) AS strict_accuracy, decisive_correct / nullif(total_questions, 0) AS strict_scored_accuracy,
 decisive_correct / nullif(decisive_correct + decisive_wrong, 0) AS decisive_precision, scored_cells / nullif(total_cells, 0) AS coverage,
 (decisive_correct + decisive_wrong) / nullif(total_questions, 0) AS decisive_coverage"""
_LABEL = """CASE WHEN status <> 'ok' THEN 'unknown' WHEN certain THEN 'entailed' WHEN NOT possible THEN 'contradicted' ELSE 'unknown' END"""
_OUTCOME = f"""SELECT *, CASE WHEN status <> 'ok' THEN 'status_' || status WHEN label = 'entailed' AND expected_value THEN 'correct'
 WHEN label = 'contradicted' AND NOT expected_value THEN 'correct' WHEN label IN ('entailed', 'contradicted') THEN 'incorrect' ELSE 'inconclusive' END AS outcome
 FROM (SELECT *, {_LABEL} AS label FROM fx_answers)"""


def _labelled(spark, d):
    return S.credence(table(spark, d, "fx_answers"))


def _outcomes(spark, d):
    return S.score_boolean(_labelled(spark, d))


def _words(spark, d):
    w = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 3 == 0, " yes ").otherwise("Entailed")).otherwise(F.when(F.col("doc_id") % 3 == 0, "no").when(F.col("doc_id") % 3 == 1, "Not entailed").otherwise("maybe"))
    return table(spark, d, "labels").select("doc_id", w.alias("word"), F.when(F.col("toxic") == 1, "FALSE").otherwise("TRUE").alias("gold"))


_WORDS = """SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN ' yes ' ELSE 'Entailed' END ELSE CASE WHEN doc_id % 3 = 0 THEN 'no' WHEN doc_id % 3 = 1 THEN 'Not entailed' ELSE 'maybe' END END AS word,
 CASE WHEN toxic = 1 THEN 'FALSE' ELSE 'TRUE' END AS gold FROM labels"""
_NORM = """CASE WHEN upper(trim(word)) IN ('YES','Y','TRUE','T','ENTAILS','ENTAILED') THEN 'TRUE' WHEN upper(trim(word)) IN ('NO','N','FALSE','F','NOT ENTAILED') THEN 'FALSE' WHEN upper(trim(word)) IN ('UNKNOWN','INCONCLUSIVE','UNDETERMINED','UNSUPPORTED','UNSURE') THEN 'UNKNOWN' END"""


def f1_normalize_label(spark, d):
    return _words(spark, d).select("doc_id", S.normalize_label(F.col("word")).alias("label"))


def f2_parse_answer(spark, d):
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.col("text"), F.lit(" Final answer: true."))).when(F.col("turn") % 4 == 1, " unknown ").when(F.col("turn") % 4 == 2, "I say FALSE").otherwise(F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.min("text").alias("text")).select("conv_id", S.parse_answer(said).alias("label"))


def f3_score_answer(spark, d):
    return _words(spark, d).select("doc_id", S.score_answer(S.normalize_label(F.col("word")), F.col("gold")).alias("outcome"))


def f4_score_boolean(spark, d):
    return _outcomes(spark, d).select("q_id", "label", "outcome")


def _intents(spark, d):
    """Answers with intents, targets and propagated atoms; some of sets of rules that contradict, some that aren't supported."""
    q = F.col("q_id")
    x = table(spark, d, "fx_answers").withColumn("status", F.when(q % 15 == 0, "Inconsistent").when(q % 16 == 0, " unsupported ").otherwise(F.col("status")))
    atom = lambda p: F.array(F.struct(F.lit(p).alias("predicate"), F.array(F.lit(" Anna"), q.cast("string")).alias("args")))
    x = S.credence(x).withColumns({
        "intent": F.when(q % 6 == 0, "get_range").when(q % 6 < 3, "propagation").otherwise("deduction"),
        "target_predicate": F.when(q % 6 == 2, "owes"),
        "target_args": F.array(F.lit("anna"), q.cast("string")),
        "certain_true": F.when(q % 4 == 0, atom("owes")).otherwise(atom("owned")),
        "certain_false": F.when(q % 4 == 2, atom("owes")),
        "target": F.when(q % 7 < 3, "Tax_due"),
        "expected_target": F.when(q % 7 == 0, "tax_due").when(q % 7 < 4, "right"),
    })
    return x


def f4_score_intents(spark, d):
    return S.score_boolean(_intents(spark, d)).select("q_id", "outcome")


def f6_score_membership(spark, d):
    return S.score_membership(_intents(spark, d)).select("q_id", "outcome")


def f5_score_range(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.floor("o_totalprice").cast("string"), F.lit(" euro")).alias("value"), F.concat(F.floor(F.col("o_totalprice") + F.col("o_orderkey") % 9).cast("string"), F.lit("")).alias("expected"))
    return S.score_range(o, "value", "expected").select("o_orderkey", "match")


def f6_score_set(spark, d):
    words = F.split("p_name", " ")
    p = table(spark, d, "part").select("p_partkey", words.alias("v"), F.when(F.col("p_partkey") % 2 == 0, F.reverse(F.transform(words, lambda x: F.upper(x)))).otherwise(F.slice(words, 1, 1)).alias("e"))
    return S.score_set(p, "v", "e").select("p_partkey", "match")


def f7_score_belief(spark, d):
    return S.score_boolean(_labelled(spark, d), threshold=0.5).select("q_id", "outcome")


def f8_run_score(spark, d):
    return S.run_score(_outcomes(spark, d), "model")


def f9_warning_counts(spark, d):
    w = F.array(F.concat(F.lit("score "), F.col("status")), F.when(F.col("certain"), "Missing antecedent x").otherwise("observable target used"))
    return S.warning_counts(table(spark, d, "fx_answers").select(w.alias("warnings")))


def _logs(spark, d):
    text = F.when(F.col("page_id") % 7 == 0, "IDP failed to parse the KB").when(F.col("page_id") % 7 == 1, "Case extraction failed").when(F.col("page_id") % 7 == 2, "Validation failed here (error)").when(F.col("page_id") % 7 == 3, "").otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", (F.col("page_id") % 3).cast("int").alias("exit_code"), F.lit(True).alias("ok"), text.alias("log"))


def f10_classify_log(spark, d):
    p = F.col("page_id")
    score = F.when(p % 5 == 0, "[1").when(p % 5 == 1, F.lit(None)).when(p % 5 == 2, '{"correct": 1}').otherwise(F.concat(F.lit('{"total": '), p, F.lit("}")))
    cells = _logs(spark, d).withColumns({"score": score, "question_error": p % 4 == 0, "symbolic_error": p % 4 == 1, "budget_guard": p % 13 == 0})
    return S.classify_log(cells).select("page_id", "failure_category")


def f13_status_summary(spark, d):
    return S.status_summary(table(spark, d, "fx_cells"))


def f14_grouped_metrics(spark, d):
    return S.grouped_metrics(table(spark, d, "fx_cells"), table(spark, d, "fx_manifest"))


def f15_phenomenon_metrics(spark, d):
    return S.phenomenon_metrics(table(spark, d, "fx_cells"), table(spark, d, "fx_manifest"))


def f16_model_ranking(spark, d):
    cells = table(spark, d, "fx_cells").withColumn("model", F.concat(F.lit("model_"), F.col("o_custkey") % 11))
    usage = table(spark, d, "fx_calls").groupBy(F.concat(F.lit("model_"), F.col("call_index") % 11).alias("model")).agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.round(F.sum("prompt_tokens") / 1e6, 4).alias("cost_usd"))
    return S.model_ranking(cells, usage)


def f17_baseline_summary(spark, d):
    label = S.normalize_label(F.col("word"))
    w = _words(spark, d).withColumn("label", label).select(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("model"), "label", S.score_answer(F.col("label"), F.col("gold")).alias("outcome"))
    return S.baseline_summary(w)


def f18_system_summary(spark, d):
    return S.system_summary(_outcomes(spark, d).withColumnRenamed("model", "run_id"))


def f19_accuracy_matrix(spark, d):
    return S.accuracy_matrix(table(spark, d, "fx_cells"), PRIORITIES)


def f20_timing_summary(spark, d):
    return S.timing_summary(table(spark, d, "fx_cells"), "strategy").select("strategy", "n_cells", "elapsed_sec", "elapsed_text")


def f21_validate_runs(spark, d):
    runs = table(spark, d, "orders").filter("o_orderkey % 50 <> 0").select(F.concat(F.lit("run_"), F.col("o_custkey")).alias("run_id"))
    fixed = {"law_domain": F.lit("company"), "evaluation_group": F.lit("core"), "difficulty": F.lit("basic")}
    listed = table(spark, d, "customer").select(F.concat(F.lit("run_"), F.col("c_custkey")).alias("run_id"), F.when(F.col("c_nationkey") % 4 == 3, None).otherwise(F.lit("temporal")).alias("phenomena")).withColumns(fixed)
    return S.validate_runs(runs, listed).select("run_id", "error")


def f21_test_set(spark, d):
    """All checks: every order is a question of its customer's run, every customer is listed."""
    run = lambda c: F.concat(F.lit("run_"), F.col(c))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    orders = table(spark, d, "orders")
    runs = orders.select(run("o_custkey").alias("run_id")).distinct()
    listed = table(spark, d, "customer").select(
        F.when(c % 17 == 0, " ").otherwise(run("c_custkey")).alias("run_id"),
        F.when(c % 13 == 0, F.concat(run("c_custkey"), F.lit("\\case.json"))).alias("path"),
        F.when(c % 5 == 1, "tax").when(c % 5 > 1, "company").alias("law_domain"),
        F.when(c % 7 == 0, "odd").otherwise("core").alias("evaluation_group"),
        F.when(c % 11 == 0, "extreme").otherwise("hard").alias("difficulty"),
        F.when(c % 4 == 3, None).when(c % 3 == 0, F.array(F.lit("temporal"), F.lit("noise"))).otherwise(F.array(F.lit("temporal"))).alias("phenomena"),
    )
    mode = F.when(k % 4 == 0, "boolean").when(k % 4 == 1, "explanation").when(k % 4 == 2, "essay").otherwise("range")
    expected = F.struct(mode.alias("mode"), F.when(k % 8 < 4, "true").alias("value"), F.when(k % 9 == 0, " ").otherwise("because").alias("reason"))
    questions = orders.select(run("o_custkey").alias("run_id"), F.when(k % 10 == 0, " ").otherwise(k.cast("string")).alias("q_id"), F.when(k % 14 != 0, F.col("o_orderpriority")).alias("q_text"), F.when(k % 6 != 0, expected).alias("expected"))
    n = F.col("o_custkey")
    at = lambda p: F.concat(run("o_custkey"), F.lit(p))
    paths = F.array(at("/run.json"), F.when(n % 5 == 0, at("/score.json")), F.when(n % 7 == 0, at("/deep/kb.fo")), F.when(n % 9 == 0, at("/work/a.txt")), F.when(n % 9 == 0, at("/work/b.txt")), F.when(n % 26 == 0, at("/case.json")))
    files = orders.select(F.explode(F.array_compact(paths)).alias("path"))
    return S.validate_runs(runs, listed, questions, files)


def f22_manifest_counts(spark, d):
    return S.manifest_counts(table(spark, d, "fx_manifest"))


def f24_compare_profiles(spark, d):
    cells = table(spark, d, "fx_cells").withColumns({"run_key": F.col("o_custkey"), "profile": F.when(F.col("strategy") < "3", "cheap").otherwise("balanced")})
    return S.compare_profiles(cells, ["cheap", "balanced"])


def f25_dedupe_models(spark, d):
    line = F.concat(F.lit(" vendor/m "), F.col("s_nationkey"), F.lit("# note "), F.col("s_name"))
    return S.dedupe_models(table(spark, d, "supplier").select(line.alias("line"), F.col("s_suppkey").alias("pos")))


def f12_build_cells(spark, d):
    runs = table(spark, d, "fx_calls").select("run_id", "strategy")
    scores = _outcomes(spark, d).select(F.concat(F.lit("run_"), F.lpad((F.col("q_id") % 37).cast("string"), 3, "0")).alias("run_id"), F.concat(F.lit("strategy_"), F.col("q_id") % 4).alias("strategy"), "outcome")
    return S.build_cells(runs, scores, table(spark, d, "fx_calls")).drop("cost_usd", "exit_code", "duration_sec", "ok")


def f12_cells_of_logs(spark, d):
    """Cells with logs: a seventh of the runs failed, the call budget stopped some, some scores report symbolic errors."""
    calls = table(spark, d, "fx_calls").withColumns({"cost_usd": F.col("prompt_tokens") * 2 / 1_000_000, "error": F.lit(None).cast("string")})
    q = F.col("q_id")
    scores = _outcomes(spark, d).filter(q % 37 != 5).select(F.concat(F.lit("run_"), F.lpad((q % 37).cast("string"), 3, "0")).alias("run_id"), F.concat(F.lit("strategy_"), q % 4).alias("strategy"), "outcome", F.when(q % 37 == 8, "Error").alias("symbolic_status"), F.when(q % 37 == 9, "timeout").alias("error"))
    n = F.substring("run_id", 5, 3).cast("int")
    logs = calls.groupBy("run_id", "strategy").agg(F.round(F.sum(F.col("call_index") % 100) / 10, 1).alias("duration_sec")).withColumns({"exit_code": F.when(n % 7 == 0, 2).otherwise(0), "log": F.when(n % 2 == 0, "Case extraction failed").otherwise(""), "budget_guard": n % 11 == 3})
    return S.build_cells(calls, scores, calls, logs.filter(n != 20))


def f23_review_table(spark, d):
    results = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("source")).alias("answer"))
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("gold"))
    return S.review_table(results, gold)


def f11_missing_score_reason(spark, d):
    k = F.col("page_id")
    log = F.when(k % 5 == 0, "Translation failed").when(k % 5 == 1, "wrote: out/score.json").when(k % 5 == 2, "Law compilation failed").otherwise(F.col("url"))
    cells = table(spark, d, "pages").select("page_id", (k % 4).alias("n_questions"), F.when(k % 3 > 0, k % 3 - 1).alias("n_results"), (k % 2 == 0).alias("has_score"), F.when(k % 11 == 0, 1).otherwise(0).alias("n_errors"), log.alias("log"))
    return S.missing_score_reason(cells).select("page_id", "reason")


QUERIES = {f.__name__: f for f in (f11_missing_score_reason, f12_build_cells, f12_cells_of_logs, f4_score_intents, f6_score_membership, f21_test_set, f23_review_table, f1_normalize_label, f2_parse_answer, f3_score_answer, f4_score_boolean, f5_score_range, f6_score_set, f7_score_belief, f8_run_score, f9_warning_counts, f10_classify_log, f13_status_summary, f14_grouped_metrics, f15_phenomenon_metrics, f16_model_ranking, f17_baseline_summary, f18_system_summary, f19_accuracy_matrix, f20_timing_summary, f21_validate_runs, f22_manifest_counts, f24_compare_profiles, f25_dedupe_models)}

_SAID = "upper(trim(said, chr(32) || chr(9) || chr(10) || chr(13)))"

SQL = {
    "f11_missing_score_reason": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'no_questions_found' WHEN page_id % 3 = 2 AND page_id % 2 <> 0 THEN 'scoring_skipped' WHEN page_id % 11 = 0 THEN 'question_pipeline_error_before_score'
 WHEN page_id % 5 = 0 THEN 'translation_failed' WHEN page_id % 5 = 1 THEN 'score_file_missing_after_reported_write' WHEN page_id % 5 = 2 THEN 'law_compilation_failed' WHEN page_id % 3 = 0 THEN 'main_exited_before_scoring' ELSE 'unknown' END AS reason FROM pages""",
    "f12_build_cells": f"""WITH r AS (SELECT DISTINCT run_id, strategy FROM fx_calls), s AS (SELECT concat('run_', lpad(CAST(q_id % 37 AS VARCHAR), 3, '0')) AS run_id, concat('strategy_', q_id % 4) AS strategy, count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct_decisive, count(*) FILTER (outcome = 'incorrect') AS incorrect_decisive, count(*) FILTER (outcome = 'inconclusive') AS inconclusive FROM ({_OUTCOME}) GROUP BY 1, 2),
 u AS (SELECT run_id, strategy, count(*) AS n_calls, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS total_tokens, count(error) AS n_errors FROM fx_calls GROUP BY 1, 2)
 SELECT r.run_id, r.strategy, total, correct_decisive, incorrect_decisive, inconclusive, n_calls, total_tokens, total IS NOT NULL AS scored, CASE WHEN total IS NULL THEN 'evaluation_no_score' WHEN n_errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS failure_category FROM r LEFT JOIN s ON r.run_id = s.run_id AND r.strategy = s.strategy LEFT JOIN u ON r.run_id = u.run_id AND r.strategy = u.strategy""",
    "f12_cells_of_logs": f"""WITH s AS (SELECT concat('run_', lpad(CAST(q_id % 37 AS VARCHAR), 3, '0')) AS run_id, concat('strategy_', q_id % 4) AS strategy, count(*) AS t, count(*) FILTER (outcome = 'correct') AS c, count(*) FILTER (outcome = 'incorrect') AS i, count(*) FILTER (outcome = 'inconclusive') AS o FROM ({_OUTCOME}) WHERE q_id % 37 <> 5 GROUP BY 1, 2),
 u AS (SELECT run_id, strategy, CAST(substr(run_id, 5, 3) AS INT) AS n, count(*) AS n_calls, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS total_tokens, round(CAST(sum(prompt_tokens) AS BIGINT) * 2 / 1000000, 6) AS cost_usd, round(CAST(sum(call_index % 100) AS BIGINT) / 10, 1) AS secs FROM fx_calls GROUP BY 1, 2),
 x AS (SELECT u.*, t, c, i, o, n <> 20 AND n % 11 = 3 AS guard, n <> 20 AND n % 7 = 0 AS broke FROM u LEFT JOIN s ON u.run_id = s.run_id AND u.strategy = s.strategy),
 y AS (SELECT *, NOT guard AND NOT broke AND t IS NOT NULL AS scored, CASE WHEN guard THEN 'llm_budget_guard' WHEN broke AND n % 2 = 0 THEN 'case_extraction' WHEN broke THEN 'process_error' WHEN t IS NULL THEN 'evaluation_no_score' WHEN n = 9 THEN 'completed_with_errors' WHEN n = 8 THEN 'completed_with_symbolic_errors' ELSE 'completed' END AS failure_category FROM x)
 SELECT run_id, strategy, CASE WHEN scored THEN t END AS total, CASE WHEN scored THEN c END AS correct_decisive, CASE WHEN scored THEN i END AS incorrect_decisive, CASE WHEN scored THEN o END AS inconclusive, n_calls, total_tokens, cost_usd, CASE WHEN broke THEN 2 WHEN guard THEN 1 ELSE 0 END AS exit_code,
  CASE WHEN n <> 20 THEN secs END AS duration_sec, scored, failure_category, scored AND failure_category = 'completed' AS ok FROM y""",
    "f23_review_table": """SELECT d.doc_id AS id, CASE WHEN d.doc_id % 6 = 0 THEN ' ' ELSE source END AS answer, CAST(quality AS VARCHAR) AS gold, CASE WHEN d.doc_id % 6 = 0 THEN 'no_answer' WHEN quality IS NULL THEN 'no_gold' ELSE 'to_review' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "f1_normalize_label": f"SELECT doc_id, {_NORM} AS label FROM ({_WORDS})",
    "f2_parse_answer": f"""WITH c AS (SELECT conv_id, max(turn) AS turn, min(text) AS text FROM conversations GROUP BY conv_id),
 s AS (SELECT conv_id, CASE turn % 4 WHEN 0 THEN text || ' Final answer: true.' WHEN 1 THEN ' unknown ' WHEN 2 THEN 'I say FALSE' ELSE text END AS said FROM c),
 u AS (SELECT conv_id, {_SAID} AS t FROM s),
 v AS (SELECT *, regexp_extract(t, '\\bFINAL\\s+ANSWER\\s*:\\s*(TRUE|FALSE|UNKNOWN)\\b', 1) AS stated, list_distinct(regexp_extract_all(t, '\\b(TRUE|FALSE|UNKNOWN)\\b', 1)) AS named FROM u)
 SELECT conv_id, CASE WHEN t IN ('TRUE','FALSE','UNKNOWN') THEN t WHEN stated <> '' THEN stated WHEN len(named) = 1 AND length(t) <= 80 THEN named[1] END AS label FROM v""",
    "f3_score_answer": f"SELECT doc_id, CASE WHEN p IS NULL OR p = 'UNKNOWN' THEN 'inconclusive' WHEN p = gold THEN 'correct' ELSE 'wrong' END AS outcome FROM (SELECT doc_id, gold, {_NORM} AS p FROM ({_WORDS}))",
    "f4_score_boolean": f"SELECT q_id, label, outcome FROM ({_OUTCOME})",
    "f4_score_intents": f"""SELECT q_id, CASE WHEN q_id % 15 = 0 THEN 'status_inconsistent' WHEN q_id % 16 = 0 THEN 'status_unsupported' WHEN status <> 'ok' THEN 'status_' || status
 WHEN q_id % 6 = 2 THEN CASE WHEN q_id % 4 = 0 THEN CASE WHEN expected_value THEN 'correct' ELSE 'incorrect' END WHEN q_id % 4 = 2 THEN CASE WHEN expected_value THEN 'incorrect' ELSE 'correct' END ELSE 'inconclusive' END
 WHEN q_id % 6 < 2 THEN 'unscored_intent' WHEN label <> 'unknown' AND q_id % 7 IN (1, 2) THEN 'target_mismatch' ELSE outcome END AS outcome FROM ({_OUTCOME})""",
    "f6_score_membership": """SELECT q_id, CASE WHEN q_id % 6 <> 2 OR q_id % 4 NOT IN (0, 2) THEN 'inconclusive' WHEN (q_id % 4 = 0) = expected_value THEN 'correct' ELSE 'incorrect' END AS outcome FROM fx_answers""",
    "f5_score_range": "SELECT o_orderkey, abs(floor(o_totalprice) - floor(o_totalprice + o_orderkey % 9)) <= 5 AS match FROM orders",
    "f6_score_set": """SELECT p_partkey, list_sort(list_distinct(list_transform(v, lambda x: lower(x)))) = list_sort(list_distinct(list_transform(e, lambda x: lower(x)))) AS match
 FROM (SELECT p_partkey, v, CASE WHEN p_partkey % 2 = 0 THEN list_transform(v, lambda x: upper(x)) ELSE v[1:1] END AS e FROM (SELECT p_partkey, string_split(p_name, ' ') AS v FROM part))""",
    "f7_score_belief": f"SELECT q_id, CASE WHEN outcome = 'inconclusive' THEN 'correct_by_belief' ELSE outcome END AS outcome FROM ({_OUTCOME})",
    "f8_run_score": f"""SELECT model, total, correct, incorrect, inconclusive, correct / total AS accuracy, correct / nullif(correct + incorrect, 0) AS accuracy_decisive FROM (
 SELECT model, count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome NOT IN ('correct', 'incorrect')) AS inconclusive FROM ({_OUTCOME}) GROUP BY model)""",
    "f9_warning_counts": """SELECT warning_class, count(*) AS n FROM (SELECT 'other' AS warning_class FROM fx_answers UNION ALL SELECT CASE WHEN certain THEN 'antecedent' ELSE 'observable_target' END FROM fx_answers) GROUP BY warning_class""",
    "f10_classify_log": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 5 = 0 THEN 'evaluation_bad_score' WHEN page_id % 5 < 3 THEN 'evaluation_no_score' WHEN page_id % 4 = 0 THEN 'completed_with_errors' WHEN page_id % 4 = 1 THEN 'completed_with_symbolic_errors' ELSE 'completed' END
 WHEN page_id % 13 = 0 THEN 'llm_budget_guard' WHEN page_id % 7 = 0 THEN 'kb_idp_parse' WHEN page_id % 7 = 1 THEN 'case_extraction' WHEN page_id % 7 = 2 THEN 'kb_compile_validation' ELSE 'process_error' END AS failure_category FROM pages""",
    "f13_status_summary": """SELECT count(*) AS cells_total, count(*) FILTER (scored) AS scored_cells, count(*) FILTER (NOT scored AND failure_category = 'evaluation_no_score') AS evaluation_no_score_cells,
 count(*) FILTER (NOT scored AND failure_category = 'evaluation_bad_score') AS evaluation_bad_score_cells, count(*) FILTER (NOT scored AND failure_category = 'law_compilation') AS law_compilation_cells,
 count(*) FILTER (NOT scored AND failure_category IN ('case_extraction', 'kb_idp_parse')) AS other_failure_cells,
 sum(correct_decisive) FILTER (scored) / nullif(sum(correct_decisive + incorrect_decisive) FILTER (scored), 0) AS accuracy_decisive_over_scored FROM fx_cells""",
    "f14_grouped_metrics": f"""WITH k AS (SELECT c.*, coalesce(evaluation_group, 'unknown') AS evaluation_group, coalesce(difficulty, 'unknown') AS difficulty, coalesce(law_domain, 'unknown') AS law_domain FROM fx_cells c LEFT JOIN fx_manifest m ON c.run_id = m.run_id),
 e AS (SELECT 'strategy' AS dimension, strategy AS value, * FROM k UNION ALL SELECT 'evaluation_group', evaluation_group, * FROM k UNION ALL SELECT 'difficulty', difficulty, * FROM k UNION ALL SELECT 'law_domain', law_domain, * FROM k),
 a AS (SELECT dimension, value, {_METRICS} FROM e GROUP BY dimension, value) SELECT *, {_RATES} FROM a""",
    "f15_phenomenon_metrics": f"""WITH k AS (SELECT c.*, unnest(string_split(coalesce(phenomena, 'unknown'), ',')) AS phenomenon FROM fx_cells c LEFT JOIN fx_manifest m ON c.run_id = m.run_id),
 a AS (SELECT phenomenon, {_METRICS} FROM k GROUP BY phenomenon) SELECT *, {_RATES} FROM a""",
    "f16_model_ranking": f"""WITH a AS (SELECT concat('model_', o_custkey % 11) AS model, {_METRICS} FROM fx_cells GROUP BY ALL), b AS (SELECT *, {_RATES} FROM a),
 u AS (SELECT concat('model_', call_index % 11) AS model, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(sum(prompt_tokens) / 1e6, 4) AS cost_usd FROM fx_calls GROUP BY ALL)
 SELECT CAST(row_number() OVER (ORDER BY coalesce(strict_accuracy, -1) DESC, coalesce(decisive_precision, -1) DESC, coalesce(coverage, -1) DESC, coalesce(cost_usd, 1e18), coalesce(total_tokens, 1000000000000000000), b.model) AS INT) AS rank,
 b.model, total_cells, scored_cells, decisive_correct, decisive_wrong, strict_accuracy, coverage, decisive_precision, total_tokens, cost_usd FROM b LEFT JOIN u ON b.model = u.model""",
    "f17_baseline_summary": f"""WITH w AS (SELECT concat('m', doc_id % 5) AS model, label, CASE WHEN label IS NULL OR label = 'UNKNOWN' THEN 'inconclusive' WHEN label = gold THEN 'correct' ELSE 'wrong' END AS outcome FROM (SELECT doc_id, gold, {_NORM} AS label FROM ({_WORDS})))
 SELECT model, count(*) AS total, count(label) AS valid, count(*) - count(label) AS invalid, count(*) FILTER (label = 'TRUE') AS n_true, count(*) FILTER (label = 'FALSE') AS n_false, count(*) FILTER (label = 'UNKNOWN') AS n_unknown,
 count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'correct') / count(*) AS accuracy, count(*) FILTER (outcome = 'wrong') / count(*) AS wrong_rate FROM w GROUP BY model""",
    "f18_system_summary": f"""SELECT *, correct_decisive / total AS strict_accuracy, scored / total AS coverage, correct_decisive / nullif(correct_decisive + wrong_decisive, 0) AS decisive_precision, wrong_decisive / total AS decisive_wrong_rate FROM (
 SELECT count(DISTINCT model) AS total_runs, count(*) AS total, count(*) FILTER (outcome IN ('correct', 'incorrect', 'inconclusive')) AS scored, count(*) FILTER (outcome = 'correct') AS correct_decisive, count(*) FILTER (outcome = 'incorrect') AS wrong_decisive, count(*) FILTER (outcome = 'inconclusive') AS inconclusive FROM ({_OUTCOME}))""",
    "f19_accuracy_matrix": "SELECT run_id, " + ", ".join(f"""max(cell) FILTER (strategy = '{p}') AS "{p}\"""" for p in PRIORITIES) + """ FROM (SELECT run_id, strategy, CASE WHEN scored AND total > 0 THEN CASE WHEN correct_decisive = 1 THEN '1.00' ELSE '0.00' END ELSE failure_category END AS cell FROM fx_cells) GROUP BY run_id""",
    "f20_timing_summary": """SELECT strategy, n_cells, elapsed_sec, CASE WHEN elapsed_sec < 60 THEN format('{:.1f}s', elapsed_sec) WHEN elapsed_sec < 3600 THEN format('{:.1f}m', elapsed_sec / 60) ELSE format('{:.2f}h', elapsed_sec / 3600) END AS elapsed_text
 FROM (SELECT strategy, count(*) AS n_cells, round(sum(duration_sec), 2) AS elapsed_sec FROM fx_cells GROUP BY strategy)""",
    "f21_validate_runs": """WITH r AS (SELECT concat('run_', o_custkey) AS run_id FROM orders WHERE o_orderkey % 50 <> 0), m AS (SELECT concat('run_', c_custkey) AS run_id, c_nationkey % 4 = 3 AS untagged FROM customer)
 SELECT run_id, 'duplicate_id' AS error FROM r GROUP BY run_id HAVING count(*) > 1 UNION ALL SELECT run_id, 'listed_but_missing' FROM m WHERE run_id NOT IN (SELECT run_id FROM r)
 UNION ALL SELECT run_id, 'not_in_manifest' FROM r WHERE run_id NOT IN (SELECT run_id FROM m) UNION ALL SELECT run_id, 'no_phenomena' FROM m WHERE untagged""",
    "f21_test_set": """WITH m AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE concat('run_', c_custkey) END AS run_id, c_custkey % 17 <> 0 AS own FROM customer), r AS (SELECT DISTINCT o_custkey AS n, concat('run_', o_custkey) AS run_id FROM orders),
 q AS (SELECT concat('run_', o_custkey) AS run_id, o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR) END AS q_id FROM orders)
 SELECT run_id, 'listed_but_missing' AS error, NULL AS detail FROM m WHERE own AND run_id NOT IN (SELECT run_id FROM r) UNION ALL SELECT run_id, 'not_in_manifest', NULL FROM r WHERE run_id NOT IN (SELECT run_id FROM m)
 UNION ALL SELECT run_id, 'missing_id', NULL FROM m WHERE NOT own UNION ALL SELECT run_id, 'missing_law_domain', NULL FROM m WHERE own AND c % 5 = 0 UNION ALL SELECT run_id, 'unknown_law_domain', 'tax' FROM m WHERE own AND c % 5 = 1
 UNION ALL SELECT run_id, 'unknown_evaluation_group', 'odd' FROM m WHERE own AND c % 7 = 0 UNION ALL SELECT run_id, 'unknown_difficulty', 'extreme' FROM m WHERE own AND c % 11 = 0
 UNION ALL SELECT run_id, 'no_phenomena', NULL FROM m WHERE own AND c % 4 = 3 UNION ALL SELECT run_id, 'unknown_phenomenon', 'noise' FROM m WHERE own AND c % 4 <> 3 AND c % 3 = 0
 UNION ALL SELECT run_id, 'missing_question_id', q_id FROM q WHERE k % 10 = 0 UNION ALL SELECT run_id, 'missing_question_text', q_id FROM q WHERE k % 14 = 0 UNION ALL SELECT run_id, 'missing_expected', q_id FROM q WHERE k % 6 = 0
 UNION ALL SELECT run_id, 'unknown_mode', 'essay' FROM q WHERE k % 6 <> 0 AND k % 4 = 2 UNION ALL SELECT run_id, 'missing_value', q_id FROM q WHERE k % 6 <> 0 AND k % 4 IN (0, 3) AND k % 8 >= 4 UNION ALL SELECT run_id, 'missing_reason', q_id FROM q WHERE k % 6 <> 0 AND k % 9 = 0
 UNION ALL SELECT m.run_id, 'missing_file', m.run_id || CASE WHEN c % 13 = 0 THEN '/case.json' ELSE '/run.json' END FROM m LEFT JOIN r ON m.run_id = r.run_id WHERE own AND (r.run_id IS NULL OR c % 26 = 13)
 UNION ALL SELECT run_id, 'generated_file', 'score.json' FROM r WHERE n % 5 = 0 UNION ALL SELECT run_id, 'generated_file', 'deep/kb.fo' FROM r WHERE n % 7 = 0 UNION ALL SELECT run_id, 'generated_folder', 'work' FROM r WHERE n % 9 = 0""",
    "f22_manifest_counts": """SELECT 'evaluation_group' AS dimension, evaluation_group AS value, count(*) AS n FROM fx_manifest GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM fx_manifest GROUP BY 2
 UNION ALL SELECT 'law_domain', law_domain, count(*) FROM fx_manifest GROUP BY 2 UNION ALL SELECT 'phenomenon', p, count(*) FROM (SELECT unnest(string_split(phenomena, ',')) AS p FROM fx_manifest) GROUP BY 2""",
    "f24_compare_profiles": """SELECT o_custkey AS run_key, CAST(coalesce(sum(correct_decisive) FILTER (strategy < '3'), 0) AS BIGINT) AS cheap_correct, count(*) FILTER (strategy < '3') AS cheap_cells,
 CAST(coalesce(sum(correct_decisive) FILTER (strategy >= '3'), 0) AS BIGINT) AS balanced_correct, count(*) FILTER (strategy >= '3') AS balanced_cells FROM fx_cells GROUP BY o_custkey""",
    "f25_dedupe_models": """SELECT concat('vendor/m ', s_nationkey) AS model, min(s_suppkey) AS first_pos, concat('vendor_m_', s_nationkey) AS safe_name FROM supplier GROUP BY s_nationkey""",
}
