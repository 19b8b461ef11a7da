"""Answer scoring and evaluation aggregates: functions from DataFrames to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Answer words of each label.
LABEL_WORDS = {
    "TRUE": ("YES", "Y", "TRUE", "T", "ENTAILS", "ENTAILED"),
    "FALSE": ("NO", "N", "FALSE", "F", "NOT ENTAILED"),
    "UNKNOWN": ("UNKNOWN", "INCONCLUSIVE", "UNDETERMINED", "UNSUPPORTED", "UNSURE"),
}
#: Failure category by phrase in a log, first that fits.
LOG_PHRASES = (
    ("translation", "translation failed"),
    ("case_extraction", "case extraction failed"),
    ("kb_repair_exhausted", "kb compilation failed after"),
    ("law_compilation", "law compilation failed"),
    ("law_compilation", "kb compilation failed (llm call)"),
    ("kb_lint", "kb lint:"),
    ("kb_lint", "kb lint failed"),
    ("kb_idp_parse", "idp failed to parse"),
    ("kb_idp_parse", "failed to parse compiled kb"),
    ("kb_semantic", "kbsemanticerror"),
    ("kb_semantic", "theory is unsatisfiable"),
    ("reasoning_symbol_mismatch", "symbolic reasoning failed"),
    ("reasoning_symbol_mismatch", "symbol not in vocabulary"),
    ("case_query_validation", "validation failed (case/query)"),
)
#: Failure buckets of categories.
EXTRACTION = ("case_extraction", "translation")
SYMBOLIC = ("reasoning_symbol_mismatch", "case_query_validation", "kb_compile_validation", "kb_idp_parse", "kb_semantic", "kb_lint")


def normalize_label(col: Column) -> Column:
    """TRUE, FALSE, UNKNOWN or null for an answer word."""
    word = F.upper(F.trim(col.cast("string")))
    out = F.when(word.isin(*LABEL_WORDS["TRUE"]), "TRUE")
    return out.when(word.isin(*LABEL_WORDS["FALSE"]), "FALSE").when(word.isin(*LABEL_WORDS["UNKNOWN"]), "UNKNOWN")


def parse_answer(col: Column) -> Column:
    """exact label, else "final answer: X", else the only label named in at most 80 characters."""
    text = F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", ""))
    stated = F.regexp_extract(text, r"\bFINAL\s+ANSWER\s*:\s*(TRUE|FALSE|UNKNOWN)\b", 1)
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(TRUE|FALSE|UNKNOWN)\b"), 1))
    return F.when(text.isin("TRUE", "FALSE", "UNKNOWN"), text).when(stated != "", stated).when((F.size(named) == 1) & (F.length(text) <= 80), named[0])


def score_answer(pred: Column, gold: Column) -> Column:
    """correct, wrong or inconclusive; an unknown or missing prediction decides nothing."""
    return F.when(pred.isNull() | (pred == "UNKNOWN"), "inconclusive").when(pred == gold, "correct").otherwise("wrong")


def credence(results: DataFrame, prior: float = 0.5) -> DataFrame:
    """Label, p_yes, verdict_strength_pct and credence_yes_pct of status, certain and possible.

    Failures and missing flags are open, never contradicted.
    """
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    failed = ~status.isin("ok", "success", "") | (F.col("certain").isNull() & F.col("possible").isNull())
    open_ = failed | (~F.coalesce("certain", F.lit(False)) & F.coalesce("possible", F.lit(False)))
    # "not certain and not possible" as a status of ok is read as contradicted only with both flags given
    label = F.when(failed, "unknown").when(F.col("certain"), "entailed").when(~F.coalesce("possible", F.lit(False)), "contradicted").otherwise("unknown")
    p = F.when(label == "entailed", 1.0).when(label == "contradicted", 0.0).otherwise(F.lit(prior))
    strength = F.when(failed, 0).when(open_, F.bround(F.abs(F.lit(prior) - 0.5) * 200).cast("int")).otherwise(100)
    return results.withColumns({"label": label, "p_yes": p, "p_no": 1 - p, "verdict_strength_pct": strength, "credence_yes_pct": F.bround(p * 100).cast("int"), "symbolic_inconclusive": open_})


#: Intents whose answers aren't truth values.
OPEN_INTENTS = ("model_expansion", "get_range", "optimization", "explain", "relevance", "propagation")


def _known_atom(atoms: str) -> Column:
    """Is the target among the atoms (array of predicate and args), without regard to case and outer blanks of arguments?"""
    plain = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    same = lambda t: (t["predicate"] == F.col("target_predicate")) & (plain(t["args"]) == plain(F.col("target_args")))
    return F.coalesce(F.exists(atoms, same), F.lit(False))


def score_membership(results: DataFrame, expected: str = "expected_value") -> DataFrame:
    """outcome of results of propagation: is target_predicate(target_args) among certain_true or certain_false (arrays of structs of
    predicate and args)? In neither, or without a target: inconclusive; in both: correct; no expected value: not_scored."""
    exp, yes, no = F.col(expected), _known_atom("certain_true"), _known_atom("certain_false")
    out = F.when(exp.isNull(), "not_scored").when((exp & yes) | (~exp & no), "correct").when(yes | no, "incorrect")
    return results.withColumn("outcome", out.otherwise("inconclusive"))


def score_boolean(labelled: DataFrame, expected: str = "expected_value", threshold: float | None = None) -> DataFrame:
    """outcome of a labelled answer against a boolean; open answers count by belief only if a
    threshold is given.

    Read where the table has them: intent (answers of intents without truth values are unscored_intent; propagation is
    scored as in F6 if the table has certain_true, certain_false, target_predicate and target_args), and target with expected_target
    (target_mismatch if both are there and differ but for case). A failed status comes before both.
    """
    exp, has = F.col(expected), set(labelled.columns)
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    out = F.when(exp.isNull(), "not_scored").when(~status.isin("ok", "success", ""), F.concat(F.lit("status_"), status))
    if "intent" in has:
        intent = F.lower(F.trim(F.coalesce("intent", F.lit(""))))
        if {"certain_true", "certain_false", "target_predicate", "target_args"} <= has:
            yes, no = _known_atom("certain_true"), _known_atom("certain_false")
            named = (intent == "propagation") & (F.coalesce("target_predicate", F.lit("")) != "")
            out = out.when(named & ((exp & yes) | (~exp & no)), "correct").when(named & (yes | no), "incorrect").when(named, "inconclusive")
        out = out.when(intent.isin(*OPEN_INTENTS), "unscored_intent")
    if {"target", "expected_target"} <= has:
        asked, got = (F.lower(F.coalesce(c, F.lit(""))) for c in ("expected_target", "target"))
        decided = F.col("label").isin("entailed", "contradicted") if "symbolic_inconclusive" not in has else ~F.col("symbolic_inconclusive")
        out = out.when(decided & (asked != "") & (got != "") & (asked != got), "target_mismatch")
    out = out.when((F.col("label") == "entailed") & exp, "correct").when((F.col("label") == "contradicted") & ~exp, "correct")
    out = out.when(F.col("label").isin("entailed", "contradicted"), "incorrect")
    if threshold is not None:
        reach = F.when(exp, F.col("p_yes")).otherwise(F.col("p_no")) >= threshold
        out = out.when(reach, "correct_by_belief")
    return labelled.withColumn("outcome", out.otherwise("inconclusive"))


def score_range(results: DataFrame, value: str, expected: str, tol: float = 5) -> DataFrame:
    """numbers within a tolerance, else equal text."""
    num = lambda c: F.regexp_extract(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"^(-?[0-9]+)", 1).try_cast("double")
    a, b = num(value), num(expected)
    near = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tol).otherwise(F.lower(F.trim(F.col(value).cast("string"))) == F.lower(F.trim(F.col(expected).cast("string"))))
    return results.withColumn("match", F.coalesce(near, F.lit(False)))


def score_set(results: DataFrame, values: str, expected: str) -> DataFrame:
    """equality of sorted lower-case sets."""
    norm = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))))
    return results.withColumn("match", norm(values) == norm(expected))


def run_score(items: DataFrame, *by: str) -> DataFrame:
    """F8: totals and accuracies of outcomes, over all and over decisive items."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    out = items.groupBy(*by).agg(F.count("*").alias("total"), is_("correct").alias("correct"), is_("incorrect").alias("incorrect"), F.count_if(~F.col("outcome").isin("correct", "incorrect")).alias("inconclusive"))
    return out.withColumns({"accuracy": F.try_divide(F.col("correct"), F.col("total")), "accuracy_decisive": F.try_divide(F.col("correct"), F.col("correct") + F.col("incorrect"))})


def warning_counts(items: DataFrame, warnings: str = "warnings") -> DataFrame:
    """warnings by class: observable target, antecedent, other."""
    w = F.lower(F.col("w"))
    kind = F.when(w.contains("observable"), "observable_target").when(w.contains("antecedent"), "antecedent").otherwise("other")
    return items.select(F.explode(warnings).alias("w")).groupBy(kind.alias("warning_class")).agg(F.count("*").alias("n"))


def classify_log(cells: DataFrame) -> DataFrame:
    """failure category of cells(exit_code, log), first rule that fits.

    Read where the table has them: ok; score (text of the score file, null without one); question_error and
    symbolic_error (a question's run or the score reports one); budget_guard (the call budget stopped the run).
    """
    opt = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in cells.columns else F.lit(other)
    log = F.lower(F.coalesce("log", F.lit("")))
    ended = (F.col("exit_code") == 0) & opt("ok", True)
    out = F.when(F.lit(False), "")
    if "score" in cells.columns:
        score = F.try_parse_json("score")
        is_object = F.schema_of_variant(score).startswith("OBJECT")
        total = F.try_variant_get(score, "$.total", "string")
        out = out.when(ended & F.col("score").isNotNull() & ~F.coalesce(is_object, F.lit(False)), "evaluation_bad_score").when(ended & total.isNull(), "evaluation_no_score")
    out = out.when(ended & opt("question_error", False), "completed_with_errors").when(ended & opt("symbolic_error", False), "completed_with_symbolic_errors").when(ended, "completed")
    out = out.when(opt("budget_guard", False), "llm_budget_guard").when((F.col("exit_code") != 0) & (F.trim(log) == ""), "process_error")
    for category, phrase in LOG_PHRASES:
        out = out.when(log.contains(phrase), category)
    out = out.when(log.contains("validation failed") & log.contains("(error)"), "kb_compile_validation").when(F.col("exit_code") != 0, "process_error")
    return cells.withColumn("failure_category", out.otherwise("unknown"))


def _metrics() -> list[Column]:
    if_scored = lambda c: F.sum(F.when(F.col("scored"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)).cast("long")
    return [
        F.count("*").alias("total_cells"),
        F.count_if("scored").alias("scored_cells"),
        if_scored("total").alias("total_questions"),
        if_scored("correct_decisive").alias("decisive_correct"),
        if_scored("incorrect_decisive").alias("decisive_wrong"),
        if_scored("inconclusive").alias("inconclusive"),
        F.count_if(F.col("failure_category") == "law_compilation").alias("law_compilation_failures"),
        F.count_if(F.col("failure_category").isin(*EXTRACTION)).alias("extraction_failures"),
        F.count_if(F.col("failure_category").isin(*SYMBOLIC)).alias("symbolic_failures"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    c, r = F.col, F.try_divide
    decisive = c("decisive_correct") + c("decisive_wrong")
    return df.withColumns(
        {
            "decisive_answers": decisive,
            "compile_failure_rate": r(c("law_compilation_failures"), c("total_cells")),
            "inconclusive_rate": r(c("inconclusive"), c("total_questions")),
            "decisive_wrong_rate": r(c("decisive_wrong"), decisive),
            "strict_accuracy": r(c("decisive_correct"), c("total_cells")),
            "strict_scored_accuracy": r(c("decisive_correct"), c("total_questions")),
            "decisive_precision": r(c("decisive_correct"), decisive),
            "coverage": r(c("scored_cells"), c("total_cells")),
            "decisive_coverage": r(decisive, c("total_questions")),
        }
    )


def grouped_metrics(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """the metric set by strategy, evaluation group, difficulty and domain in one GROUPING SETS pass."""
    keys = ["strategy", "evaluation_group", "difficulty", "law_domain"]
    known = cells.join(manifest.select("run_id", *keys[1:]), "run_id", "left").withColumns({k: F.coalesce(k, F.lit("unknown")) for k in keys})
    out = known.groupingSets([[k] for k in keys], *keys).agg(*_metrics(), *[F.grouping(k).alias(f"_{k}") for k in keys])
    name, value = F.lit(None).cast("string"), F.coalesce(*keys)
    for k in keys:
        name = F.when(F.col(f"_{k}") == 0, k).otherwise(name)
    return _rates(out.withColumns({"dimension": name, "value": value})).drop(*keys, *[f"_{k}" for k in keys])


def phenomenon_metrics(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """the metric set by tag; a cell counts once in each of its tags."""
    tags = F.filter(F.split(F.coalesce("phenomena", F.lit("")), ","), lambda x: F.trim(x) != "")
    known = cells.join(manifest.select("run_id", tags.alias("tags")), "run_id", "left")
    each = known.withColumn("phenomenon", F.explode_outer(F.when(F.size("tags") > 0, F.array_distinct("tags"))))
    return _rates(each.withColumn("phenomenon", F.coalesce("phenomenon", F.lit("unknown"))).groupBy("phenomenon").agg(*_metrics()))


def status_summary(cells: DataFrame) -> DataFrame:
    """cells by outcome and decisive accuracy over scored cells."""
    c = F.col
    open_ = ~c("scored")
    right = F.sum(F.when(c("scored"), c("correct_decisive"))).alias("right")
    wrong = F.sum(F.when(c("scored"), c("incorrect_decisive"))).alias("wrong")
    named = ("evaluation_no_score", "evaluation_bad_score", "law_compilation")
    ok = c("failure_category").isin("completed", "completed_with_errors")
    out = cells.agg(
        F.count("*").alias("cells_total"),
        F.count_if("scored").alias("scored_cells"),
        *[F.count_if(open_ & (c("failure_category") == x)).alias(f"{x}_cells") for x in named],
        F.count_if(open_ & ~c("failure_category").isin(*named) & ~ok).alias("other_failure_cells"),
        right,
        wrong,
    )
    return out.withColumn("accuracy_decisive_over_scored", F.try_divide("right", c("right") + c("wrong"))).drop("right", "wrong")


def model_ranking(cells: DataFrame, usage: DataFrame) -> DataFrame:
    """F16: per model metrics ranked by strict accuracy, precision, coverage, low cost, low tokens, name."""
    m = _rates(cells.groupBy("model").agg(*_metrics())).join(usage, "model", "left")
    order = [F.coalesce("strict_accuracy", F.lit(-1.0)).desc(), F.coalesce("decisive_precision", F.lit(-1.0)).desc(), F.coalesce("coverage", F.lit(-1.0)).desc(), F.coalesce("cost_usd", F.lit(1e18)), F.coalesce("total_tokens", F.lit(10**18)), F.col("model")]
    return m.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "model", "total_cells", "scored_cells", "decisive_correct", "decisive_wrong", "strict_accuracy", "coverage", "decisive_precision", "total_tokens", "cost_usd")


def baseline_summary(preds: DataFrame) -> DataFrame:
    """valid and invalid outputs, labels, accuracy and wrong rate of preds(model, label, outcome)."""
    n = F.count_if
    out = preds.groupBy("model").agg(F.count("*").alias("total"), n(F.col("label").isNotNull()).alias("valid"), n(F.col("label").isNull()).alias("invalid"), *[n(F.col("label") == x).alias(f"n_{x.lower()}") for x in LABEL_WORDS], n(F.col("outcome") == "correct").alias("correct"), n(F.col("outcome") == "wrong").alias("wrong"))
    return out.withColumns({"accuracy": F.try_divide("correct", "total"), "wrong_rate": F.try_divide("wrong", "total")})


def system_summary(results: DataFrame) -> DataFrame:
    """outcome counts and rates of a system; the wrong rate is over all questions."""
    n = F.count_if
    out = results.agg(F.count_distinct("run_id").alias("total_runs"), F.count("*").alias("total"), n(F.col("outcome").isin("correct", "incorrect", "inconclusive")).alias("scored"), n(F.col("outcome") == "correct").alias("correct_decisive"), n(F.col("outcome") == "incorrect").alias("wrong_decisive"), n(F.col("outcome") == "inconclusive").alias("inconclusive"))
    d = F.col("correct_decisive") + F.col("wrong_decisive")
    return out.withColumns({"strict_accuracy": F.try_divide("correct_decisive", "total"), "coverage": F.try_divide("scored", "total"), "decisive_precision": F.try_divide(F.col("correct_decisive"), d), "decisive_wrong_rate": F.try_divide("wrong_decisive", "total")})


def accuracy_matrix(cells: DataFrame, strategies: list[str]) -> DataFrame:
    """run x strategy table of accuracy, or the category where there is no score."""
    text = F.when(F.col("scored") & (F.col("total") > 0), F.format_string("%.2f", F.col("correct_decisive") / F.col("total"))).otherwise(F.col("failure_category"))
    return cells.withColumn("cell", text).groupBy("run_id").pivot("strategy", strategies).agg(F.min("cell"))


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes or hours as text."""
    return F.when(seconds.isNull(), "n/a").when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.2fh", seconds / 3600))


def timing_summary(cells: DataFrame, *by: str) -> DataFrame:
    """elapsed time, cells, average and their text."""
    out = cells.groupBy(*by).agg(F.count("*").alias("n_cells"), F.round(F.sum("duration_sec"), 2).alias("elapsed_sec"), F.round(F.avg("duration_sec"), 4).alias("avg_sec"))
    return out.withColumn("elapsed_text", duration_text(F.col("elapsed_sec")))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """runs by group, difficulty, domain and tag."""
    keys = ["evaluation_group", "difficulty", "law_domain"]
    one = manifest.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    name = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys])
    one = one.select(name.alias("dimension"), F.coalesce(*keys).alias("value"), "n")
    tags = manifest.select(F.explode(F.split("phenomena", ",")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return one.unionByName(tags.select(F.lit("phenomenon").alias("dimension"), "value", "n"))


#: The words a test set may use, and what a run leaves behind.
VOCABULARY = {
    "law_domain": ("inheritance", "immigration", "company"),
    "evaluation_group": ("core", "challenge", "stress", "external_verus_lm"),
    "difficulty": ("basic", "intermediate", "hard"),
    "phenomena": ("classification", "definition", "legal_effect", "temporal", "numeric_threshold", "negative_exclusion", "structural_exclusion", "case_given_criteria", "open_world"),
    "mode": ("boolean", "set", "range", "explanation"),
}
VALUED_MODES = ("boolean", "set", "range")
GENERATED_FILES = (
    "results.json", "score.json", "run_trace.txt", "effective_config.json", "schema_environment.json", "case_entity_type_mapping.json",
    "pre_solver_domain_validation.json", "symbolic_proof_gap.json", "factual_criteria_mode_diagnostics.json", "case_factual_input_diagnostics.json",
    "case_extraction_repair.json", "threshold_exclusion_gap.json", "threshold_numeric_helper_gap.json", "llm_calls.jsonl", "llm_call_summary.json", "kb.fo", "kb_schema.json",
)
GENERATED_FOLDERS = ("translated", "json_ir_compile", "kb_strategy_compare", "work")


def _faults(df: DataFrame, checks: list[tuple[Column, str | Column, Column]]) -> DataFrame:
    """A row (run_id, error, detail) for each check whose condition holds, in one pass over the rows."""
    name = lambda e: F.lit(e) if isinstance(e, str) else e
    found = F.array_compact(F.array(*[F.when(cond, F.struct(name(e).alias("error"), detail.cast("string").alias("detail"))) for cond, e, detail in checks]))
    return df.select("run_id", F.explode(found).alias("f")).select("run_id", "f.error", "f.detail")


def question_faults(questions: DataFrame, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """faults of questions(run_id, q_id, q_text, expected struct of mode, value and reason), as A1 reads them.

    A row without id, text and expected value is a run without questions. Without an expected value no more is checked of it.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    e, none = F.col("expected"), F.col("expected").isNull()
    empty = F.col("q_id").isNull() & F.col("q_text").isNull() & none
    known = F.coalesce(e["mode"].isin(*vocabulary["mode"]), F.lit(False))
    q = F.col("q_id")
    return _faults(questions, [
        (empty, "no_questions", F.lit(None)),
        (~empty & blank("q_id"), "missing_question_id", q),
        (~empty & blank("q_text"), "missing_question_text", q),
        (~empty & none, "missing_expected", q),
        (~none & ~known, "unknown_mode", e["mode"]),
        (~none & e["mode"].isin(*VALUED_MODES) & e["value"].isNull(), "missing_value", q),
        (~none & blank(e["reason"]), "missing_reason", q),
    ])


def listing_faults(manifest: DataFrame, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """faults of the entries of a manifest(run_id, law_domain, evaluation_group, difficulty, phenomena), each checked by itself.

    phenomena is an array or a text with commas; a column that the table lacks is missing in every entry. An entry without an
    id has that fault only.
    """
    col = lambda c: F.col(c) if c in manifest.columns else F.lit(None).cast("string")
    tags = col("phenomena")
    if "phenomena" not in manifest.columns or manifest.schema["phenomena"].dataType.simpleString() == "string":
        tags = F.when(F.trim(tags) != "", F.split(tags, ","))
    own = F.trim(F.coalesce("run_id", F.lit(""))) != ""
    checks = [(~own, "missing_id", F.lit(None))]
    for c in ("law_domain", "evaluation_group", "difficulty"):
        checks += [(own & col(c).isNull(), f"missing_{c}", F.lit(None)), (own & ~col(c).isin(*vocabulary[c]), f"unknown_{c}", col(c))]
    checks.append((own & (F.coalesce(F.size(tags), F.lit(0)) <= 0), "no_phenomena", F.lit(None)))
    one = _faults(manifest, checks)
    strange = manifest.filter(own).select("run_id", F.explode(tags).alias("detail")).filter(~F.coalesce(F.col("detail").isin(*vocabulary["phenomena"]), F.lit(False)))
    return one.unionByName(strange.select("run_id", F.lit("unknown_phenomenon").alias("error"), "detail"))


def file_faults(runs: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """of files(path, below the test set): listed files that aren't there, and files and folders that a run generated in a run's folder."""
    path = F.col("path") if "path" in manifest.columns else F.lit(None).cast("string")
    listed = manifest.filter("trim(run_id) <> ''").select("run_id", F.regexp_replace(F.coalesce(path, F.concat("run_id", F.lit("/run.json"))), r"\\", "/").alias("path"))
    lost = listed.join(files.select("path").distinct(), "path", "left_anti").select("run_id", F.lit("missing_file").alias("error"), F.col("path").alias("detail"))
    part = F.split("path", "/")
    own = files.select(F.get(part, F.lit(0)).alias("run_id"), F.array_join(F.slice(part, 2, F.greatest(F.size(part), F.lit(1))), "/").alias("rest"), F.element_at(part, -1).alias("name"), F.when(F.size(part) > 2, F.get(part, F.lit(1))).alias("folder"))
    made = _faults(own, [(F.col("name").isin(*GENERATED_FILES) & (F.col("rest") != ""), "generated_file", F.col("rest")), (F.col("folder").isin(*GENERATED_FOLDERS), "generated_folder", F.col("folder"))])
    return lost.unionByName(made.join(runs.select("run_id").distinct(), "run_id", "left_semi").distinct())


def validate_runs(runs: DataFrame, manifest: DataFrame, questions: DataFrame | None = None, files: DataFrame | None = None, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """rows (run_id, error, detail), one for each fault of a test set.

    Of runs(run_id) and manifest(run_id, ...): duplicate_id, duplicate_listing, listed_but_missing, not_in_manifest, and the faults
    of entries; of questions and files, where given, theirs.
    """
    err = lambda d, e: d.select("run_id", F.lit(e).alias("error"), F.lit(None).cast("string").alias("detail"))
    twice = lambda d: d.groupBy("run_id").count().filter("count > 1")
    listed = manifest.filter("trim(run_id) <> ''")
    out = [
        err(twice(runs), "duplicate_id"),
        err(twice(listed), "duplicate_listing"),
        err(listed.select("run_id").distinct().join(runs, "run_id", "left_anti"), "listed_but_missing"),
        err(runs.join(listed, "run_id", "left_anti"), "not_in_manifest"),
        listing_faults(manifest, vocabulary),
    ]
    if questions is not None:
        out.append(question_faults(questions, vocabulary))
    if files is not None:
        out.append(file_faults(runs, manifest, files))
    return reduce(DataFrame.unionByName, out)


def compare_profiles(cells: DataFrame, profiles: list[str]) -> DataFrame:
    """the same runs under several settings, side by side."""
    wide = cells.groupBy("run_key").pivot("profile", profiles).agg(F.sum("correct_decisive").alias("correct"), F.count(F.lit(1)).alias("cells"))
    return wide.na.fill(0)


def dedupe_models(df: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """names in order, later repeats dropped, comments stripped, with names safe for files."""
    name = F.trim(F.regexp_replace(F.col(line), "#.*$", ""))
    out = df.select(name.alias("model"), F.col(pos).alias("pos")).filter("model <> ''").groupBy("model").agg(F.min("pos").alias("first_pos"))
    return out.withColumn("safe_name", F.regexp_replace("model", "[^A-Za-z0-9_.-]+", "_"))


def build_cells(runs: DataFrame, scores: DataFrame, calls: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """one row per run and strategy: counts of its scores, its calls, tokens and cost, how it ended, whether it is scored and ok.

    runs(run_id, strategy), scores(run_id, strategy, outcome), calls(run_id, strategy, prompt_tokens, ...), logs(run_id, strategy,
    exit_code, log, duration_sec, budget_guard), one row each; a run without a log has ended well. Read where the tables have them: cost_usd
    of calls, error and symbolic_status of scores. A run that the call budget stopped, or that failed, isn't scored: its counts are
    null and its category is that of F10.
    """
    keys = ["run_id", "strategy"]
    n = lambda x: F.count_if(F.col("outcome") == x)
    flag = lambda c, test: F.coalesce(F.bool_or(test), F.lit(False)) if c in scores.columns else F.first(F.lit(False))
    s = scores.groupBy(*keys).agg(
        F.count("*").alias("total"), n("correct").alias("correct_decisive"), n("incorrect").alias("incorrect_decisive"), n("inconclusive").alias("inconclusive"),
        flag("error", F.col("error").isNotNull()).alias("_error"), flag("symbolic_status", F.lower("symbolic_status") == "error").alias("_symbolic"),
    )
    cost = F.round(F.sum("cost_usd"), 6) if "cost_usd" in calls.columns else F.first(F.lit(None).cast("double"))
    u = calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("total_tokens"), cost.alias("cost_usd"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    x = runs.select(*keys).distinct().join(s, keys, "left").join(u, keys, "left")
    if logs is None:
        x = x.withColumns({"exit_code": F.lit(0), "duration_sec": F.lit(None).cast("double"), "_guard": F.lit(False), "_failure": F.lit("completed")})
    else:
        guard = F.coalesce("budget_guard", F.lit(False)) if "budget_guard" in logs.columns else F.lit(False)
        ended = classify_log(logs.select(*keys, "log", "duration_sec", F.coalesce("exit_code", F.lit(0)).alias("exit_code"), guard.alias("budget_guard")))
        x = x.join(ended.select(*keys, "exit_code", "duration_sec", F.col("budget_guard").alias("_guard"), F.col("failure_category").alias("_failure")), keys, "left")
        x = x.withColumns({"exit_code": F.coalesce("exit_code", F.lit(0)), "_guard": F.coalesce("_guard", F.lit(False))})
    failed = F.col("_guard") | (F.col("exit_code") != 0)
    category = F.when(F.col("_guard"), "llm_budget_guard").when(failed, F.col("_failure")).when(F.col("total").isNull(), "evaluation_no_score")
    category = category.when(F.col("_error") | (F.col("n_errors") > 0), "completed_with_errors").when(F.col("_symbolic"), "completed_with_symbolic_errors").otherwise("completed")
    scored = ~failed & F.col("total").isNotNull()
    counts = {c: F.when(scored, F.col(c)) for c in ("total", "correct_decisive", "incorrect_decisive", "inconclusive")}
    x = x.withColumns({"scored": scored, "failure_category": category, "n_calls": F.coalesce("n_calls", F.lit(0)), "total_tokens": F.coalesce("total_tokens", F.lit(0))})
    x = x.withColumns({**counts, "ok": F.col("scored") & (F.col("failure_category") == "completed"), "exit_code": F.when(F.col("_guard") & (F.col("exit_code") == 0), 1).otherwise(F.col("exit_code"))})
    return x.drop("n_errors", "_error", "_symbolic", "_guard", "_failure")


def review_table(results: DataFrame, gold: DataFrame) -> DataFrame:
    """answers beside the gold text with a status for reading by hand. results(id, answer), gold(id, gold)."""
    status = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "no_answer").when(F.col("gold").isNull(), "no_gold").otherwise("to_review")
    return results.join(gold, "id", "left").withColumn("status", status)


def missing_score_reason(cells: DataFrame) -> DataFrame:
    """why a finished cell has no score, first reason that fits.

    cells(n_questions, n_results, has_score, n_errors, log): n_results is null without a results file.
    """
    log = F.lower(F.coalesce("log", F.lit("")))
    out = F.when(F.coalesce("n_questions", F.lit(0)) == 0, "no_questions_found").when((F.col("n_results") > 0) & ~F.col("has_score"), "scoring_skipped").when(F.col("n_errors") > 0, "question_pipeline_error_before_score")
    for phrase, reason in (("translation failed", "translation_failed"), ("case extraction failed", "case_extraction_failed"), ("law file not found", "law_file_not_found")):
        out = out.when(log.contains(phrase), reason)
    out = out.when(log.contains("wrote:") & log.contains("score.json"), "score_file_missing_after_reported_write")
    out = out.when(log.contains("json ir compilation failed") | log.contains("law compilation failed"), "law_compilation_failed")
    return cells.withColumn("reason", out.when(F.col("n_results").isNull(), "main_exited_before_scoring").otherwise("unknown"))
