"""Routing of questions, classes of symbols, and why a proof or a fact falls short.

Symbols are rows of (set_id, name, kind, description, legal_output, category, directly_observable, case_input); symbol
tables are small beside cases, but nothing here relies on it: everything is keyed joins and expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import cue, output_category

#: Patterns of question types in the order they are tried.
QUESTION_PATTERNS = {
    "consistency": (r"\bare these facts consistent\b", r"\bis this case possible\b", r"\bcan these facts occur\b", r"\bconsistent with the law\b", r"\bconsistent under the law\b", r"\btheorie.*consistent\b", r"\bzijn deze feiten consistent\b", r"\bis deze casus mogelijk\b", r"\bkunnen deze feiten voorkomen\b"),
    "explanation": (r"\bwhy\b", r"\bexplain\b", r"\bexplanation\b", r"\bwhich facts matter\b", r"\bwhich rules are relevant\b", r"\bwhat rules (are|were) relevant\b", r"\bwaarom\b", r"\bverklaar\b", r"\bleg uit\b", r"\bwelke feiten\b.*\b(belangrijk|relevant)\b", r"\bwelke regels\b.*\brelevant\b"),
    "range_value": (r"\bfine range\b", r"\bpossible fine\b", r"\bamount can be imposed\b", r"\bhow many years\b", r"\bminimum\b", r"\bmaximum\b", r"\bmin(?:imum)?\b", r"\bmax(?:imum)?\b", r"\bwhat values are possible\b", r"\bwhat is the (?:possible )?range\b", r"\bboete.*bereik\b", r"\bminimum.*boete\b", r"\bmaximum.*boete\b", r"\bbedrag\b", r"\bjaren\b"),
    "possible_list": (r"\bwhat possible\b", r"\bwhich possible\b", r"\bwhich sanctions\b", r"\bwhich punishments\b", r"\bwhich legal consequences\b", r"\bwhich consequences\b", r"\bwhich classifications\b", r"\bwhat outcomes are possible\b", r"\bmay apply\b", r"\bcan apply\b", r"\bcould (?:this|the)\b", r"\bwelke sancties\b", r"\bwelke straffen\b", r"\bwelke mogelijke\b", r"\bwelke juridische gevolgen\b", r"\bwelke gevolgen\b", r"\bmogelijke straffen\b", r"\bmogelijke sancties\b"),
    "boolean": (r"\bis\s+.+\s+true\b", r"\bdoes\s+.+\s+apply\b", r"\bcan it be concluded\b", r"\bare the legal consequences applicable\b", r"\bis the company\b", r"\bqualifies as\b", r"\bhas the right\b", r"\bis entitled\b", r"\bapplicable\b", r"\bgeldt\b", r"\bvan toepassing\b", r"\bis er sprake van\b", r"\bkan worden geconcludeerd\b", r"\bheeft\b.+\brecht\b"),
}
#: What asks for an extreme.
EXTREME_PATTERNS = (r"\bminimum\b", r"\bmaximum\b", r"\blowest\b", r"\bhighest\b", r"\bmin(?:imum)?\b", r"\bmax(?:imum)?\b")
#: Question type of an intent a query declares.
INTENT_TYPES = {"satisfiable": "consistency", "get_range": "range_value", "optimization": "range_value", "model_expansion": "possible_list", "deduction_set": "possible_list", "explain": "explanation", "relevance": "explanation", "propagation": "explanation"}
#: Words of conditions that count or compare.
THRESHOLD_WORDS = ("carried_out", "consolidation", "consolidated", "elimination", "eliminated", "eliminations", "exceptional", "duration", "good_faith", "mainly_not", "no_longer", "exceeds", "exceed", "meets", "meet", "satisfies", "satisfy", "qualifies", "qualify", "eligible", "threshold", "criterion", "criteria", "condition", "requirement", "exception", "exempt", "consecutive", "majority", "at_least", "more_than", "less_than", "no_more_than", "count", "aggregate", "calculated", "derived", "computed", "fulfilled", "not_fulfilled", "voldoet", "overschrijdt", "voorwaarden", "criterium", "uitzondering", "drempel")
#: Parts of names that count or compare.
THRESHOLD_NAMES = (r"(exceeds?|meets?|satisf|qualif|eligible|threshold|criteri|exception)", r"_(more_than|less_than|at_least|no_more_than|threshold|criterion|criteria|condition)_", r"(consolidat|eliminat|carried_out|good_faith|exceptional|no_longer|mainly_not)")
#: What a case text can state of documents and behaviour.
FACTUAL = (r"possess(?:es|ed)?_valid_(?:passport|travel_document|document|identity(?:_document)?)", r"has_valid_(?:passport|travel_document|document|identity(?:_document)?)", r"(?:passport|travel_document|identity_document)_(?:is_)?valid", r"possess(?:es|ed)?_(?:a_)?valid_(?:passport|travel_document)", r"failed_to_comply_with(?:_measure|_order|_requirement)?", r"stated_unwillingness_to_comply(?:_with(?:_measure|_order))?", r"refused_to_comply_with(?:_measure|_order)?", r"unwillingness_to_comply(?:_with(?:_measure|_order))?", r"did_not_comply_with(?:_measure|_order)?", r"non_compliance_with(?:_measure|_order)?", r"no_residence_application_filed", r"criterion_no_residence_application", r"does_not_meet_entry_conditions")
#: Conclusions and effects.
CONCLUSION = (r"legal_consequence", r"legal_effect", r"legal_outcome", r"qualifies_for(?:_status|_classification)?", r"classification_applies", r"status_applies", r"consequence_applies", r"entitled_to", r"has_right_to", r"must_be_removed", r"shall_be_removed", r"prohibited_from", r"forbidden_to", r"applies_from", r"applicable_under", r"takes_effect", r"comes_into_force", r"liable_for", r"obligation_applies", r"sanction_applies", r"penalty_applies")
#: Names of a status, words of its description.
STATUS_NAMES = (r"^is_[a-z]", r"^has_[a-z]|(?:^|_)(?:status|national|citizen|member|resident|foreigner|eligible)(?:_|$)")
STATUS_WORDS = r"\b(?:status|classification|nationality|citizenship|residence status)\b"
#: Roles that exclude each other.
DEAD = r"(?:^|[^a-z])(deceased|decedent|dead|died|death|predeceased)(?:[^a-z]|$)|deceased[_ ]"
ALIVE = r"(?:^|[^a-z])(survivor|surviving|alive|living)(?:[^a-z]|$)"


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for any of several, case ignored."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def route_question(questions: DataFrame) -> DataFrame:
    """Type, intent, fallback, scorable and reason of each question.

    The expected shape (expected_intent, expected_mode) wins over an intent a query declares (query_type, query_intent), that
    over the text, and the text over a predicate query's hint (query_mode, query_explain, query_predicate).
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    expected = F.when(_low("expected_intent") == "satisfiable", "consistency").when(_low("expected_intent") == "get_range", "range_value").when(_low("expected_mode") == "boolean", "boolean").when(_low("expected_mode") == "set", "possible_list")
    declared = F.when(F.lit(False), "")
    for intent, kind in INTENT_TYPES.items():
        declared = declared.when(_low("query_intent") == intent, kind)
    mode = F.when(_low("query_mode") == "", "boolean").otherwise(_low("query_mode"))
    predicate = F.when(mode == "set", "possible_list").when(F.coalesce("query_explain", F.lit(False)), "explanation").otherwise("boolean")
    said = F.when(F.lit(False), "")
    for kind, patterns in QUESTION_PATTERNS.items():
        said = said.when(text.rlike(any_of(patterns)), kind)
    x = questions.withColumns({"_e": expected, "_d": F.when(_low("query_type") == "intent", declared), "_p": F.when(_low("query_type") == "predicate", predicate), "_t": said})
    kind = F.coalesce("_e", "_d", "_t", "_p", F.lit("unknown"))
    reason = F.when(F.col("_e") == "boolean", "expected.mode=boolean").when(F.col("_e").isNotNull(), "expected_answer_shape").when(F.col("_d").isNotNull(), "extracted_intent_query").when(F.col("_t").isNotNull(), "question_text_patterns").when(F.col("_p").isNotNull(), "extracted_query_hint").otherwise("no_clear_signals")
    extreme = text.rlike(any_of(EXTREME_PATTERNS))
    x = x.withColumns({"type": kind, "reason": reason})
    t = F.col("type")
    intent = F.when(t == "consistency", "satisfiable").when(t == "explanation", "explain").when((t == "range_value") & extreme, "optimization").when(t == "range_value", "get_range").when(t == "possible_list", "model_expansion").when(t == "boolean", "deduction").otherwise("unknown")
    fallback = F.when(t == "explanation", "relevance").when((t == "range_value") & extreme, "get_range").when(t == "range_value", "optimization").when(t == "possible_list", "deduction_set").when(t == "unknown", "deduction")
    return x.withColumns({"intent": intent, "fallback": fallback}).withColumn("scorable", ~F.col("intent").isin("unknown", "explain")).drop("_e", "_d", "_p", "_t")


def symbol_class(name: Column, description: Column) -> Column:
    """Factual, conclusion, threshold or none, the first that fits."""
    n, both = F.coalesce(name, F.lit("")), F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    words = r"(?i)(?:^|[^a-z0-9_])(?:" + "|".join(THRESHOLD_WORDS) + r")(?:$|[^a-z0-9_])"
    threshold = both.rlike(words) | n.rlike(any_of(THRESHOLD_NAMES))
    return F.when(both.rlike(any_of(FACTUAL)), "factual").when(both.rlike(any_of(CONCLUSION)), "conclusion").when(threshold, "threshold").otherwise("none")


def classify_symbols(symbols: DataFrame) -> DataFrame:
    """Class of each symbol, whether it is named like a status, and whether it looks computed."""
    n, d = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    status = (n != "") & (n.rlike(any_of(STATUS_NAMES)) | F.lower(F.concat(n, F.lit(" "), d)).rlike(STATUS_WORDS))
    return symbols.withColumns({"symbol_class": symbol_class(F.col("name"), F.col("description")), "status_like": status}).withColumn("computed", F.col("symbol_class").isin("conclusion", "threshold"))


def assertable(symbols: DataFrame) -> DataFrame:
    """May a symbol be a case fact; code of the first rule against it. ``asked`` marks the query's own predicate,
    ``stated`` what the case text supports."""
    x = classify_symbols(symbols).withColumn("_kind", F.when(_low("kind") == "", "unknown").otherwise(_low("kind")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    k, own = F.col("_kind"), F.col("_kind").isin("observable", "input")
    output = output_category(F.col("name"), k, F.col("legal_output"), F.col("category"))
    code = (
        F.when(F.coalesce("name", F.lit("")) == "", "unknown_symbol")
        .when(yes("asked"), "query_predicate")
        .when(yes("directly_observable") | yes("case_input") | k.isin("background", "case_input"), None)
        .when(own & yes("legal_output"), "legal_output")
        .when(own & F.col("computed") & ~yes("stated"), "computed_composite")
        .when(own, None)
        .when(output == "effect", "legal_output")
        .when(output == "classification", "classification_output")
        .when(k.isin("helper", "derived", "conclusion"), F.when(~yes("stated"), "derived_or_helper"))
        .when(F.col("computed"), F.when(~yes("stated"), "computed_composite"))
        .otherwise("unsupported_kind")
    )
    return x.withColumn("code", code).withColumn("allowed", F.col("code").isNull()).drop("_kind")


def case_input_candidates(symbols: DataFrame, atoms: DataFrame) -> DataFrame:
    """Conditions that a case may state: threshold-like helpers that some IF uses, no output and no status."""
    used = atoms.filter("side = 'if'").select("set_id", F.col("symbol").alias("name")).distinct()
    x = classify_symbols(symbols).filter("symbol_class = 'threshold' and not status_like and kind = 'helper'")
    x = x.withColumn("output", output_category(F.col("name"), F.col("kind"), F.col("legal_output"), F.col("category"))).filter("output not in ('effect', 'classification')")
    return x.join(used, ["set_id", "name"], "left_semi").select("set_id", "name")


def unsafe_composites(atoms: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols an IF uses, negated or not, that no THEN defines: computed-looking observables, helpers and derived ones."""
    own = classify_symbols(symbols).filter(~F.coalesce("directly_observable", F.lit(False)) & ~F.coalesce("case_input", F.lit(False)))
    code = F.when((F.col("kind") == "observable") & F.col("computed"), "computed_observable").when(F.col("kind") == "helper", "undefined_helper").when(F.col("kind").isin("derived", "conclusion"), "undefined_derived")
    own = own.select("set_id", F.col("name").alias("symbol"), code.alias("code")).filter("code is not null")
    used = atoms.filter("side = 'if'").groupBy("set_id", "rule", "symbol").agg(F.max("negated").alias("negated"))
    return used.join(own, ["set_id", "symbol"]).join(atoms.filter("side = 'then'").select("set_id", "symbol").distinct(), ["set_id", "symbol"], "left_anti")


def role_conflicts(atoms: DataFrame, symbols: DataFrame) -> DataFrame:
    """Variables of a rule in unary atoms of roles that exclude each other; a name's own role wins over its description's."""
    role = lambda c, p: F.coalesce(F.col(c), F.lit("")).rlike("(?i)" + p)
    named = role("name", DEAD) | role("name", ALIVE)
    pick = lambda p: F.when(named, role("name", p)).otherwise(role("description", p))
    hints = symbols.select("set_id", F.col("name").alias("symbol"), pick(DEAD).alias("dead"), pick(ALIVE).alias("alive")).filter("dead or alive")
    unary = atoms.filter(F.size("args") == 1).select("set_id", "rule", "symbol", F.element_at("args", 1).alias("variable"))
    return unary.join(hints, ["set_id", "symbol"]).groupBy("set_id", "rule", "variable").agg(F.max("dead").alias("dead"), F.max("alive").alias("alive")).filter("dead and alive").select("set_id", "rule", "variable")


def output_coverage(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sets whose text speaks of effects though no symbol is an effect output and all derived ones are classifications or
    steps."""
    out = output_category(F.col("name"), F.col("kind"), F.col("legal_output"), F.col("category"))
    have = symbols.filter(_low("kind").isin("derived", "conclusion")).groupBy("set_id").agg(F.count("*").alias("n_derived"), F.max(out == "effect").alias("effect"))
    need = texts.withColumn("n_cues", cue(F.col("text"), "effect")).groupBy("set_id").agg(F.sum("n_cues").alias("n_cues")).filter("n_cues > 0")
    return need.join(have, "set_id", "left").filter(~F.coalesce("effect", F.lit(False))).select("set_id", "n_cues", F.coalesce("n_derived", F.lit(0)).cast("long").alias("n_derived"))


def classify_gap(rows: DataFrame, period_issues: DataFrame, results: DataFrame) -> DataFrame:
    """Primary and secondary cause per query; results(q_id, status, label, certain, has_numbers)."""
    has = lambda s: F.max(F.col("gap_status") == s).alias(s)
    kinds = ("missing_entirely", "blocked_by_missing_numeric", "derivable_from_rules", "blocked_by_rule_linkage")
    flags = rows.groupBy("q_id").agg(*(has(s) for s in kinds))
    x = results.join(flags, "q_id", "left").join(period_issues.select("q_id").distinct().withColumn("issue", F.lit(True)), "q_id", "left").na.fill(False, [*kinds, "issue", "has_numbers"])
    c = F.col
    number = c("blocked_by_missing_numeric") & ~c("has_numbers")
    label = _low("label")
    primary = (
        F.when(_low("status") == "error", "renderer_solver_issue")
        .when(number & c("derivable_from_rules"), "extraction_gap")
        .when(number, "genuinely_under_specified_case")
        .when(c("missing_entirely") | c("blocked_by_missing_numeric"), "extraction_gap")
        .when(c("blocked_by_rule_linkage"), "kb_rule_linkage_gap")
        .when(c("issue"), "query_argument_issue")
        .when(label.isin("unknown", "") & (c("certain") == F.lit(False)), "extraction_gap")
        .otherwise("genuinely_under_specified_case")
    )
    x = x.withColumn("primary_cause", primary)
    failed = c("primary_cause") == "renderer_solver_issue"
    more = F.array(
        F.when(number & c("derivable_from_rules"), "genuinely_under_specified_case"),
        F.when(c("issue"), "query_argument_issue"),
        F.when((c("primary_cause") == "genuinely_under_specified_case") & c("missing_entirely"), "extraction_gap"),
    )
    return x.select("q_id", "primary_cause", F.when(failed, "").otherwise(F.array_join(F.array_sort(F.array_compact(more)), ",")).alias("secondary"))


def rejection_report(rejects: DataFrame, suggestions: DataFrame, cases: DataFrame) -> DataFrame:
    """Per rejected fact its code, what to use instead, whether the case text holds numbers, whether no fact is left.

    rejects(case_id, symbol, code), suggestions(symbol, replacement), cases(case_id, has_numbers, n_facts)."""
    instead = suggestions.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("replacement")), ",").alias("suggestions"))
    x = rejects.groupBy("case_id", "symbol", "code").agg(F.count("*").alias("n")).join(instead, "symbol", "left").join(cases, "case_id", "left")
    return x.select("case_id", "symbol", "code", "n", F.coalesce("suggestions", F.lit("")).alias("suggestions"), F.coalesce("has_numbers", F.lit(False)).alias("has_numbers"), (F.coalesce("n_facts", F.lit(0)) == 0).alias("empty_after"), F.col("code").isin("computed_composite", "derived_or_helper").alias("decompose"))


def schema_env(symbols: DataFrame) -> DataFrame:
    """C14: per rule set the assertable symbols, the output targets and the temporal symbols, each as a sorted list."""
    x = assertable(symbols)
    out = output_category(F.col("name"), F.col("kind"), F.col("legal_output"), F.col("category"))
    listed = lambda keep, name: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("name")))), ",").alias(name)
    temporal = F.arrays_overlap(F.split(F.lower("name"), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in ("year", "period", "following", "next", "consecutive", "duration")]))
    return x.groupBy("set_id").agg(listed(F.col("allowed"), "assertable"), listed(out.isin("effect", "classification"), "outputs"), listed(temporal, "temporal"))

