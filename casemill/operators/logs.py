"""Call-log and repair-log analytics in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error codes by what a message holds, first that fits; all phrases of a row must occur.
ERROR_RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("json_parse_error", (("json ir validation failed",), ("parse", "json.loads", "invalid json"))),
    ("json_parse_error", (("expected",), ("json",), ("parse", "json.loads", "invalid json"))),
    ("json_parse_error", (("openai call failed",), ("json",))),
    ("missing_helper_definition", (("helper predicate",), ("defining rule", "never defined", "no defining rule"))),
    ("missing_helper_definition", (("derived predicate",), ("without a defining rule", "no defining rule"))),
    ("missing_helper_definition", (("helper function",), ("defining rule", "never defined"))),
    ("computed_observable_unsafe", (("computed-looking observable", "looks computed/composite"),)),
    ("numeric_threshold_not_in_law_text", (("does not appear in the scoped law text", "do not invent or alter legal thresholds"),)),
    ("missing_threshold_classification_exclusion", (("cannot prove disqualification", "exclusion rule such as"),)),
    ("unsafe_inverse_negative_legal_output", (("inverse/de morgan negative rules", "negating observable/background prerequisites"),)),
    ("predicate_used_as_function", (("uses predicate",), ("as a function term",))),
    ("function_used_as_predicate", (("as a bool predicate atom",), ("only under functions",))),
    ("numeric_threshold_ambiguous", (("numeric_threshold_ambiguous",),)),
    ("suspicious_self_relation", (("suspicious self-relation",),)),
    ("suspicious_self_relation", (("same variable twice",), ("between-entities",))),
    ("no_helper_definition_progress", (("no_helper_definition_progress",),)),
    ("repeated_missing_helper_definition", (("repeated_missing_helper_definition",),)),
    ("repeated_missing_numeric_helper_definition", (("repeated_missing_numeric_helper_definition",),)),
    ("threshold_cardinality_or_singleton", (("at-most-one", "more-than-one criteria", "simple or over individual"),)),
    ("status_as_type", (("semantically identical to the status", "classification encoded as a primitive type"),)),
    ("missing_legal_effect_output", (("legal-effect or timing language", "no derived legal-output predicate", "no derived legal outputs", "symbol table contains no derived legal outputs"),)),
    ("missing_temporal_support_symbol", (("no temporal support relation", "temporal support relation/function", "do not count as temporal support"),)),
    ("derived_predicate_not_defined", (("never appear in any rule then",),)),
    ("ungrounded_variable", (("unconstrained consequent variable",),)),
    ("invalid_signature", (("conflicting signatures", "unknown return type", "unknown argument type"),)),
    ("unknown_symbol", (("unknown predicate", "undeclared symbol", "not declared"),)),
    ("type_mismatch", (("expects type",), ("got",))),
    ("idp_render_error", (("idp failed to parse", "failed to parse compiled kb"),)),
)
#: Repair layer of an error code; "stop" after too many tries.
LAYERS = {
    "missing_helper_definition": "rules",
    "unknown_symbol": "symbols",
    "type_mismatch": "rules",
    "numeric_threshold_not_in_law_text": "rules",
    "idp_render_error": "parse",
    "json_parse_error": "parse",
    "invalid_signature": "symbols",
    "status_as_type": "symbols",
}


def usage_summary(calls: DataFrame) -> DataFrame:
    """G1: calls, tokens and cost by stage, model, run, strategy and overall, in one GROUPING SETS pass."""
    keys = ["stage", "model", "run_id", "strategy"]
    own = calls.withColumns({k: F.coalesce(k, F.lit("unknown" if k in ("stage", "model") else "(none)")) for k in keys})
    out = own.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    name = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys], F.lit("all"))
    return out.select(name.alias("dimension"), F.coalesce(*keys, F.lit("all")).alias("value"), "n_calls", "prompt_tokens", "completion_tokens", "cost_usd")


def top_calls(calls: DataFrame, n: int = 10) -> DataFrame:
    """The n calls with most tokens (null as 0; ties by call index)."""
    total = F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(F.col("completion_tokens"), F.lit(0))
    return calls.withColumn("total_tokens", total).orderBy(F.desc("total_tokens"), "call_index").limit(n)


def estimate_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by the first price key that the model name contains; null without usage or price.

    Prices meet the distinct model names, not the calls: the containment join has one row per name.
    """
    names = calls.select("model").distinct()
    price = names.join(prices, names.model.contains(prices.model_key)).groupBy("model").agg(F.min_by(F.struct("usd_in", "usd_out"), "pos").alias("p"))
    # dollars per million tokens times tokens are millionths of a dollar: rounded as such
    cost = F.round(F.coalesce(F.col("prompt_tokens") * F.col("p.usd_in"), F.lit(0.0)) + F.coalesce(F.col("completion_tokens") * F.col("p.usd_out"), F.lit(0.0))) / 1e6
    known = F.col("p").isNotNull() & (F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull())
    return calls.join(price, "model", "left").withColumn("cost_usd", F.when(known, cost)).drop("p")


def approx_tokens(turns: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Characters / 4 rounded down, over the messages of a call."""
    return turns.groupBy(key).agg(F.floor(F.sum(F.length(F.coalesce(text, F.lit("")))) / 4).cast("long").alias("approx_tokens"), F.count("*").alias("n_messages"))


def run_strategy_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per run and strategy."""
    return calls.groupBy("run_id", "strategy").agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def places(calls: DataFrame, key: list[str], order: str, out: str, width: int = 10_000) -> DataFrame:
    """calls with the place (from 1) of each among those of its key by a unique whole number ``order``.

    Blocks of ``width`` numbers are counted, and blocks of blocks; a place is what stands before the block of blocks, before the block in it,
    and in the block. No window is wider than a block, but for one over blocks of blocks, a row for each width * width numbers.
    """
    block, large = F.floor(F.col(order) / width), F.floor(F.col(order) / (width * width))
    x = calls.withColumns({"_block": block, "_large": large})
    blocks = x.groupBy(*key, "_large", "_block").agg(F.count("*").alias("_n"))
    whole = blocks.groupBy(*key, "_large").agg(F.sum("_n").alias("_n"))
    before = lambda keys, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select(*key, "_large", before(key, "_large").alias("_before"))
    inside = blocks.select(*key, "_large", "_block", before([*key, "_large"], "_block").alias("_inside"))
    at = inside.join(whole, [*key, "_large"]).select(*key, "_block", (F.col("_before") + F.col("_inside")).alias("_at"))
    own = F.row_number().over(Window.partitionBy(*key, "_block").orderBy(order))
    return x.drop("_large").join(at, [*key, "_block"]).withColumn(out, own + F.col("_at")).drop("_block", "_at")


def budget_guard(calls: DataFrame, cell_limit: int, eval_limit: int, width: int = 10_000) -> DataFrame:
    """Per cell the calls allowed and refused, and the first call refused: those after ``cell_limit`` calls of the cell, or
    after ``eval_limit`` calls of all. A cell is a run and strategy; calls come in the order of their unique call_index."""
    own = calls.select("run_id", "strategy", "call_index")
    placed = places(places(own, [], "call_index", "place", width), ["run_id", "strategy"], "call_index", "own_place", width)
    refused = (F.col("own_place") > cell_limit) | (F.col("place") > eval_limit)
    return placed.groupBy("run_id", "strategy").agg(F.count_if(~refused).alias("allowed"), F.count_if(refused).alias("refused"), F.min(F.when(refused, F.col("call_index"))).alias("first_refused"))


def error_code(msg: Column) -> Column:
    """Stable code of a message."""
    low = F.lower(F.coalesce(msg, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for code, groups in ERROR_RULES:
        hit = F.lit(True)
        for any_of in groups:
            hit = hit & F.lit(False) if not any_of else hit & _any(low, any_of)
        out = out.when(hit, code)
    return out.otherwise("unknown_validation_error")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = text.contains(phrases[0])
    for p in phrases[1:]:
        out = out | text.contains(p)
    return out


#: Marks of messages on the design of symbols and of rules.
SYMBOL_TAG, RULE_TAG = "json_ir_schema_design_error", "json_ir_rule_design_error"
#: Signatures in the order in which they are tried: mark, phrases (all of them; of a group any), name, and what is named
#: after it (a pattern with one group), if anything.
SIGNATURES = (
    (SYMBOL_TAG, (("observable predicate",), ("consequent",)), "schema::observable_in_then", r"observable predicate\s+'([^']+)'"),
    (SYMBOL_TAG, (("no derived legal outputs",),), "schema::missing_legal_effect", None),
    (SYMBOL_TAG, (("no observable case-input",),), "schema::no_observable", None),
    (SYMBOL_TAG, (("boolean predicate atom",),), "schema::fn_as_pred", r"function\s+'([^']+)'"),
    (SYMBOL_TAG, (("predicate",), ("function term",)), "schema::pred_as_fn", r"predicate\s+'([^']+)'"),
    (SYMBOL_TAG, (("computed-looking observable",),), "schema::computed_observable", r"observable predicate\s+'([^']+)'"),
    (SYMBOL_TAG, (("looks computed/composite",),), "schema::computed_observable_decl", r"predicate\s+'([^']+)'"),
    (SYMBOL_TAG, (("as a bool predicate atom",), ("only under functions",)), "schema::predicate_used_as_function", r"Rules use '([^']+)'"),
    (SYMBOL_TAG, (("as a bool predicate atom",), ("lists it only under predicates",)), "schema::function_used_as_predicate", r"Rules use '([^']+)'"),
    (SYMBOL_TAG, (("legal-effect or timing language", "no derived legal-output"),), "schema::missing_legal_effect", None),
    (SYMBOL_TAG, (("semantically identical to the status",),), "schema::status_as_type", None),
    (SYMBOL_TAG, (("at-most-one", "simple or over individual"),), "schema::threshold_cardinality", None),
    (SYMBOL_TAG, (("inverse/de morgan negative rules",),), "rule::unsafe_inverse_negative", None),
    (SYMBOL_TAG, (("helper predicate",), ("never defined",)), "schema::floating_helper_pred", r"helper predicate\s+'([^']+)'"),
    (SYMBOL_TAG, (("helper function",), ("never defined",)), "schema::floating_helper_fun", r"helper function\s+'([^']+)'"),
    (RULE_TAG, (("at-most-one", "simple or over individual"),), "rule::threshold_cardinality", None),
    (RULE_TAG, (("defining rule",),), "rule::missing_helper", r"helper predicate\s+'([^']+)'"),
    (RULE_TAG, (("never appear in any rule then",),), "rule::derived_undefined", r"derived predicate\(s\)\s+([^\s]+)"),
    (RULE_TAG, (), "rule::circular", r"derived predicate\s+'([^']+)'"),
)
#: Fixed value: an argument's type in a message, of a predicate or another symbol.
MISMATCH = r"(?i)argument\s+([0-9]+)\s+to\s+(?:predicate\s+)?'([^']+)'\s+expects\s+type\s+([^,]+),\s+got\s+([^.\s]+)"


def _all(low: Column, needs: tuple[tuple[str, ...], ...]) -> Column:
    out = F.lit(True)
    for any_of in needs:
        out = out & _any(low, any_of)
    return out


def error_signature(msg: Column) -> Column:
    """Key of a message for repeats: indices removed, symbols kept."""
    text = F.trim(F.coalesce(msg, F.lit("")))
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    tail = lambda p: F.concat(F.lit("::"), F.coalesce(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")), F.lit("?")))
    for tag, needs, name, pattern in SIGNATURES:
        if tag == RULE_TAG:  # what no signature of symbols fits keeps its words
            out = out.when(low.contains(SYMBOL_TAG), F.concat(F.lit("schema::"), F.substring(low, 1, 120)))
        out = out.when(low.contains(tag) & _all(low, needs), F.concat(F.lit(name), tail(pattern)) if pattern else F.lit(name))
    part = lambda k: F.trim(F.regexp_extract(text, MISMATCH, k))
    out = out.when(part(2) != "", F.concat(F.lit("type_mismatch::"), part(2), F.lit("::arg"), part(1), F.lit("::"), part(3), F.lit("::"), part(4)))
    unbound = F.regexp_extract(text, r"(?i)unbound identifier\s+'([^']+)'", 1)
    out = out.when(unbound != "", F.concat(F.lit("unbound::"), unbound))
    short = lambda name: F.concat(F.lit(name), F.substring(low, 1, 100))
    out = out.when(_any(low, ("unknown predicate", "undeclared symbol")), short("unknown_symbol::"))
    out = out.when(_any(low, ("non-empty consequent", "empty then")), "rule_shape::empty_then").when(low.contains("unsupported expression"), "rule_shape::bad_expr")
    out = out.when(low.contains("arity mismatch") | (low.contains("expects ") & low.contains(" got ")), short("arity::"))
    return out.otherwise(F.concat(F.lit("other::"), F.substring(F.regexp_replace(low, r"rules\[[0-9]+\]", "rules[N]"), 1, 120)))


def normalize_errors(df: DataFrame, msg: str = "message") -> DataFrame:
    """Code and signature of each message."""
    return df.withColumns({"error_code": error_code(F.col(msg)), "error_signature": error_signature(F.col(msg))})


def repeated_errors(events: DataFrame, limit: int = 2) -> DataFrame:
    """Per run and signature the event at which it had occurred ``limit`` times, with all occurrences."""
    w = Window.partitionBy("run_id", "error_signature").orderBy("event_index")
    seen = events.withColumn("nth", F.row_number().over(w))
    return seen.groupBy("run_id", "error_signature").agg(F.count("*").alias("times"), F.min(F.when(F.col("nth") == limit, F.col("event_index"))).alias("stalled_at")).filter("stalled_at is not null")


def repair_rollup(events: DataFrame) -> DataFrame:
    """Per run the attempts, codes in first-seen order, final code and distinct errors."""
    first = events.groupBy("run_id", "error_code").agg(F.min("event_index").alias("at"), F.max("event_index").alias("last"), F.count("*").alias("n"))
    return first.groupBy("run_id").agg(F.sum("n").alias("attempts"), F.max_by("error_code", "last").alias("final_code"), F.count("*").alias("distinct_codes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "error_code"))), lambda x: x["error_code"]), ">").alias("codes_in_order"))


def repair_progress(events: DataFrame) -> DataFrame:
    """Did an attempt change on the one before (code, signature)."""
    w = Window.partitionBy("run_id").orderBy("event_index")
    code, sig = F.lag("error_code").over(w), F.lag("error_signature").over(w)
    state = F.when(code.isNull(), "first").when(sig == F.col("error_signature"), "same").when(code == F.col("error_code"), "same_code").otherwise("changed")
    return events.select("run_id", "event_index", "error_code", state.alias("progress"))


def evidence_fingerprint(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    """First 16 hex digits of a sha256 over a key's sorted distinct evidence."""
    item = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return rows.groupBy(key).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(item)), ";"), 256), 1, 16).alias("fingerprint"), F.count_distinct(item).alias("n_evidence"))


def route_repair(events: DataFrame, tries: int = 3) -> DataFrame:
    """Repair layer of each event; after ``tries`` of one code in a run the layer above, then stop."""
    nth = F.row_number().over(Window.partitionBy("run_id", "error_code").orderBy("event_index"))
    base = F.lit("rules")
    for code, layer in LAYERS.items():
        base = F.when(F.col("error_code") == code, layer).otherwise(base)
    layer = F.when(F.col("nth") > 2 * tries, "stop").when((F.col("nth") > tries) & (F.col("base") == "rules"), "symbols").when((F.col("nth") > tries) & (F.col("base") == "parse"), "rules").otherwise(F.col("base"))
    return events.withColumn("nth", nth).withColumn("base", base).select("run_id", "event_index", "error_code", layer.alias("layer"))


#: Which layer repairs a message, in the order in which they are tried: mark (None: any), phrases, layer.
ROUTES = (
    (SYMBOL_TAG, (("never appear in any rule then",),), "rules"),
    (SYMBOL_TAG, (), "symbols"),
    (RULE_TAG, (("circular",),), "rules"),
    (RULE_TAG, (("incompatible unary subject roles",),), "symbols"),
    (RULE_TAG, (("does not appear in the scoped law text", "do not invent or alter legal thresholds", "cannot prove disqualification", "exclusion rule such as", "at-most-one", "more-than-one criteria", "simple or over individual"),), "rules"),
    (RULE_TAG, (("threshold comparisons",), ("favorable derived",)), "rules"),
    (RULE_TAG, (("repair layer: rules", "has no defining rule"),), "rules"),
    (RULE_TAG, (("helper predicate",), ("defining rule",)), "rules"),
    (RULE_TAG, (), "symbols"),
    (None, (("observable predicate",), ("consequent", "then")), "symbols"),
    (None, (("used as a boolean predicate atom", "bool predicate atom"), ("only under functions", "lists it only under predicates")), "rules"),
    (None, (("used as a boolean predicate atom", "bool predicate atom"),), "symbols"),
    (None, (("used as a function term",), ("predicate",)), "rules"),
    (None, (("no derived legal outputs", "no observable case-input", "computed-looking observable", "looks computed/composite", "repair layer: symbols"),), "symbols"),
    (None, (("helper predicate",), ("never defined", "defining rule")), "rules"),
    (None, (("helper function",), ("never defined",)), "rules"),
    (None, (("conflicting signatures for symbol",),), "symbols"),
)
#: What goes to the symbols once the rules were tried often enough; what the rules repair else; what only symbols do.
ESCALATED = ("expects type", "unknown predicate", "undeclared symbol", "arity mismatch", "lists it only under functions")
RULE_REPAIRED = (("expects type",), ("got",)), (("unknown predicate", "unknown function", "unknown type", "undeclared symbol", "arity mismatch", "unbound identifier"),)
SYMBOL_REPAIRED = ("types cannot be empty", "predicates must be", "functions must be")


def route_messages(events: DataFrame, max_rules: int = 2) -> DataFrame:
    """events(run_id, event_index, message, error_signature) -> run_id, event_index, layer (rules or symbols) by what a message says and what
    the run has seen before.

    Messages of ``ROUTES`` have one layer. Of the others, those of ``ESCALATED`` go to the symbols once the run has had ``max_rules`` events
    before (rules_attempts, where there is such a column); so do mismatched types and designs of symbols whose signature the run had before, and
    unknown symbols after any unknown symbol. The rest is for the rules, but for empty or malformed declarations.
    """
    low = F.lower(F.trim(F.coalesce("message", F.lit(""))))
    sig = F.col("error_signature")
    unknown = sig.startswith("unknown")
    same = events.groupBy("run_id", "error_signature").agg(F.min("event_index").alias("_same"))
    like = events.filter(unknown).groupBy("run_id").agg(F.min("event_index").alias("_like"))
    x = events if "rules_attempts" in events.columns else places(events, ["run_id"], "event_index", "_place").withColumn("rules_attempts", F.col("_place") - 1)
    x = x.join(same, ["run_id", "error_signature"]).join(like, "run_id", "left")
    out = F.when(F.lit(False), F.lit(""))
    for tag, needs, layer in ROUTES:
        out = out.when((low.contains(tag) if tag else F.lit(True)) & _all(low, needs), layer)
    out = out.when((F.col("rules_attempts") >= max_rules) & _any(low, ESCALATED), "symbols")
    again = F.col("_same") < F.col("event_index")
    out = out.when(again & (sig.startswith("type_mismatch::") | sig.startswith("schema::") | unknown), "symbols")
    out = out.when((sig.startswith("unknown_symbol::") | low.contains("undeclared")) & (again | (unknown & (F.col("_like") < F.col("event_index")))), "symbols")
    out = out.when(_all(low, RULE_REPAIRED[0]) | _all(low, RULE_REPAIRED[1]), "rules").when(_any(low, SYMBOL_REPAIRED), "symbols")
    return x.select("run_id", "event_index", out.otherwise("rules").alias("layer"))
