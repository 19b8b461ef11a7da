"""Which antecedents of a rule a case holds: variables bound by the query, then by facts, atom by atom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.lineage import settle

SEP = "\x01"


def _low(c: str | Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _order(path: str) -> Column:
    return F.transform(F.split(path, r"\."), lambda p: p.cast("int"))


def quantified(rules: DataFrame) -> DataFrame:
    """rules(set_id, rule, rule_json) -> set_id, rule, vars: the quantified variables; null where a rule has no quantifier."""
    found = F.try_variant_get(F.try_parse_json("rule_json"), "$.forall", "array<struct<var:string>>")
    return rules.select("set_id", "rule", F.transform(found, lambda v: v["var"]).alias("vars"))


def _is_var(a: Column) -> Column:
    """Of rules without a quantifier every argument but a number is a variable."""
    return F.when(F.col("vars").isNull(), a.try_cast("double").isNull()).otherwise(F.array_contains("vars", a))


def _resolved(args: Column) -> Column:
    """Arguments with what their variables are bound to, null where one is open; constants in lower case."""
    return F.transform(args, lambda a: F.when(_is_var(a), F.try_element_at("b", a)).otherwise(_low(a)))


def _looked_up(facts: DataFrame, need: DataFrame) -> DataFrame:
    """The least fact for each way in which the atoms of need look one up: case, symbol, arguments at ``bound``, equal ones at ``same``."""
    ways = need.select("symbol", "n", "bound", "same").distinct()
    x = facts.filter("polarity").withColumn("n", F.size("args")).join(ways, ["symbol", "n"])
    x = x.filter(F.forall("same", lambda s: F.get("args", s["pos"]) == F.get("args", s["first"])))
    on = F.array_join(F.transform("bound", lambda i: F.get("args", i)), SEP)
    return x.groupBy("set_id", "case_id", "symbol", "n", "bound", "same", on.alias("on")).agg(F.min("args").alias("f_args"))


def _bound(need: DataFrame, facts: DataFrame) -> DataFrame:
    """need(..., atom, vars, b): b extended by the least fact that fits the atom under it."""
    args = F.col("atom.args")
    x = need.withColumns({"symbol": _low("atom.symbol"), "n": F.size(args), "r": _resolved(args)})
    positions = F.when(F.size("r") > 0, F.sequence(F.lit(0), F.size("r") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("atom.args", i)
    open_ = F.filter(positions, lambda i: F.get("r", i).isNull())
    first = lambda i: (F.array_position("atom.args", at(i)) - 1).cast("int")
    x = x.withColumns({
        "bound": F.filter(positions, lambda i: F.get("r", i).isNotNull()),
        "new": F.transform(F.filter(open_, lambda i: first(i) == i), lambda i: F.struct(at(i).alias("var"), i.alias("pos"))),
        "same": F.transform(F.filter(open_, lambda i: first(i) != i), lambda i: F.struct(i.alias("pos"), first(i).alias("first"))),
        "on": F.array_join(F.filter("r", lambda v: v.isNotNull()), SEP),
    })
    x = settle(x)
    hit = _looked_up(facts, x)
    key = ["set_id", "case_id", "symbol", "n", "bound", "same", "on"]
    names, values = F.transform("new", lambda v: v["var"]), F.transform("new", lambda v: F.get("f_args", v["pos"]))
    more = F.when(F.col("f_args").isNotNull(), F.map_concat("b", F.map_from_arrays(names, values))).otherwise(F.col("b"))
    return x.join(hit, key, "left").withColumn("b", more).drop("symbol", "n", "r", "bound", "new", "same", "on", "f_args")


def antecedent_coverage(queries: DataFrame, atoms: DataFrame, facts: DataFrame, symbols: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Per query and rule of its set that concludes it the IF atoms and where they stand.

    queries(q_id, set_id, case_id, symbol, args), atoms(set_id, rule, side, path, symbol, args, negated), facts(set_id, case_id, symbol, args,
    polarity, value), symbols(set_id, name, kind), variables(set_id, rule, vars). Only derived and conclusion symbols are covered. A
    rule's variables take the arguments of the query where its first fitting head has them; then each atom in turn, those of the
    head last, takes the least positive fact that fits what is bound so far. An atom with a variable that stays open is
    unknown; present if the case holds it or its denial (satisfied: with the sign that the rule asks for); else by its symbol's
    kind missing (observable), helper_defined or helper_floating (helper, in some THEN of the set or not), unknown. Names are
    compared in lower case. Returns q_id, set_id, case_id, rule, path, place (the atom's number in the rule), symbol, atom, status, satisfied.
    """
    key = ["set_id", "rule"]
    part = atoms.select(*key, "side", "path", "symbol", F.coalesce("args", F.array().cast("array<string>")).alias("args"), F.coalesce("negated", F.lit(False)).alias("negated"))
    given = variables if variables is not None else part.select(*key).distinct().withColumn("vars", F.lit(None).cast("array<string>"))
    item = F.struct((F.col("side") == "then").alias("then"), _order("path").alias("o"), "path", "symbol", "args", "negated")
    part = settle(part)
    body = part.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("body")).join(given, key)
    kinds = symbols.groupBy("set_id", F.col("name").alias("symbol")).agg(F.min("kind").alias("kind"))
    q = queries.filter("size(args) > 0").join(kinds.filter(F.col("kind").isin("derived", "conclusion")), ["set_id", "symbol"], "left_semi")
    q = q.select("q_id", "set_id", "case_id", _low("symbol").alias("head"), F.transform("args", lambda a: F.lower(F.trim(a))).alias("q_args"))
    heads = part.filter("side = 'then'").select(*key, _low("symbol").alias("head"), F.col("args").alias("head_args"), _order("path").alias("o")).join(given, key)
    x = q.join(heads, ["set_id", "head"]).filter(F.size("q_args") == F.size("head_args"))
    pairs = F.zip_with("head_args", "q_args", lambda h, a: F.struct(h.alias("h"), a.alias("a"), _is_var(h).alias("v")))
    x = x.withColumn("pairs", pairs)
    fits = F.forall("pairs", lambda p: p["v"] | (_low(p["h"]) == p["a"])) & F.forall("pairs", lambda p: F.forall("pairs", lambda r: (p["h"] != r["h"]) | (p["a"] == r["a"])))
    own = F.array_distinct(F.transform(F.filter("pairs", lambda p: p["v"]), lambda p: F.struct(p["h"].alias("key"), p["a"].alias("value"))))
    x = x.filter(fits).withColumn("entries", own)
    x = x.groupBy("q_id", "set_id", "case_id", "rule", "head", "q_args").agg(F.min_by("entries", "o").alias("entries")).withColumn("b", F.map_from_entries("entries")).drop("entries", "head", "q_args")
    need = settle(x.join(body, key))
    f = settle(facts.filter("value is null").select("set_id", "case_id", _low("symbol").alias("symbol"), F.transform("args", lambda a: F.lower(F.trim(a))).alias("args"), "polarity").distinct())
    longest = need.agg(F.max(F.size("body")).alias("n")).first()["n"] or 0
    done = []
    for k in range(longest):  # as many as the longest rule has atoms
        done.append(need.filter(F.size("body") == k))
        step = _bound(need.filter(F.size("body") > k).withColumn("atom", F.get("body", F.lit(k))), f).drop("atom")
        need = settle(step)
    for d in done:
        need = need.unionByName(d)
    conditions = need.select("q_id", *key, "case_id", "vars", "b", F.posexplode("body").alias("place", "a")).filter("not a.then")
    r = conditions.withColumn("r", _resolved(F.col("a.args")))
    r = r.select("q_id", *key, "case_id", F.col("a.path").alias("path"), "place", F.col("a.symbol").alias("symbol"), F.col("a.negated").alias("negated"), F.when((F.size("r") > 0) & F.forall("r", lambda v: v.isNotNull()), F.col("r")).alias("r"))
    signs = f.groupBy("set_id", "case_id", F.col("symbol").alias("low"), F.col("args").alias("r")).agg(F.bool_or("polarity").alias("yes"), F.bool_or(~F.col("polarity")).alias("no"))
    x = r.withColumn("low", _low("symbol")).join(signs, ["set_id", "case_id", "low", "r"], "left").join(kinds, ["set_id", "symbol"], "left")
    defined = part.filter("side = 'then'").select("set_id", "symbol").distinct().withColumn("defined", F.lit(True))
    x = x.join(defined, ["set_id", "symbol"], "left")
    present = F.col("yes").isNotNull()
    status = F.when(F.col("r").isNull(), "unknown").when(present, "present").when(F.col("kind") == "observable", "missing").when(F.col("kind") == "helper", F.when(F.col("defined"), "helper_defined").otherwise("helper_floating")).otherwise("unknown")
    atom = F.when(F.col("r").isNull(), F.col("symbol")).otherwise(F.concat("symbol", F.lit("("), F.array_join("r", ","), F.lit(")")))
    return x.select("q_id", "set_id", "case_id", "rule", "path", "place", "symbol", atom.alias("atom"), status.alias("status"), F.coalesce(F.when(F.col("negated"), F.col("no")).otherwise(F.col("yes")), F.lit(False)).alias("satisfied"))


def downgrade_alternatives(coverage: DataFrame, results: DataFrame) -> DataFrame:
    """Where the target is proved (label entailed, or certain) and one rule misses nothing, what other rules miss is non-blocking:
    missing_non_blocking, helper_floating_non_blocking."""
    rules = coverage.groupBy("q_id", "set_id", "rule").agg((F.count_if(F.col("status") == "missing") == 0).alias("whole"))
    proved = F.coalesce(F.lower("label") == "entailed", F.lit(False)) | F.coalesce("certain", F.lit(False))
    done = rules.groupBy("q_id").agg(F.max("whole").alias("some")).join(results.select("q_id", proved.alias("proved")).distinct(), "q_id", "left")
    x = coverage.join(rules, ["q_id", "set_id", "rule"]).join(done, "q_id")
    free = F.coalesce("proved", F.lit(False)) & F.col("some") & ~F.col("whole") & F.col("status").isin("missing", "helper_floating")
    return x.withColumn("status", F.when(free, F.concat("status", F.lit("_non_blocking"))).otherwise(F.col("status"))).select(coverage.columns)


def missing_observables(coverage: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Per query the missing symbols in first-seen order, and the same with the descriptions of symbols(set_id, name, description)."""
    first = coverage.filter("status = 'missing'").groupBy("q_id", "set_id", "symbol").agg(F.min(F.struct("rule", "place")).alias("at"))
    text = F.lit("")
    if symbols is not None:
        told = symbols.groupBy("set_id", F.col("name").alias("symbol")).agg(F.min("description").alias("description"))
        first, text = first.join(told, ["set_id", "symbol"], "left"), F.trim(F.coalesce("description", F.lit("")))
    first = first.withColumn("line", F.concat("symbol", F.when(text != "", F.concat(F.lit(": "), text)).otherwise("")))
    order = F.array_sort(F.collect_list(F.struct("at", "symbol", "line")))
    return first.groupBy("q_id").agg(order.alias("o")).select("q_id", F.array_join(F.transform("o", lambda x: x["symbol"]), ",").alias("missing"), F.array_join(F.transform("o", lambda x: x["line"]), "; ").alias("described"))


def proof_gap_rows(coverage: DataFrame, queries: DataFrame, symbols: DataFrame, facts: DataFrame, atoms: DataFrame, compares: DataFrame) -> DataFrame:
    """Per query and distinct atom of its coverage (the first one counts) where its proof stands: directly_present, derivable_from_rules,
    blocked_by_rule_linkage, missing_entirely; and for every observable function of the query's set directly_present or
    blocked_by_missing_numeric. ``rules``: those of the set that conclude the symbol, or compare the function."""
    kinds = symbols.groupBy("set_id", F.col("name").alias("symbol")).agg(F.min("kind").alias("kind"))
    status = F.when(F.col("status") == "present", "directly_present").when(F.col("status") == "helper_defined", "derivable_from_rules").when(F.col("status") == "helper_floating", "blocked_by_rule_linkage").when(F.col("kind") == "observable", "missing_entirely").otherwise("derivable_from_rules")
    numbered = lambda t: F.array_join(F.transform(F.array_sort(F.collect_set(t)), lambda r: r.cast("string")), ",")
    by = atoms.filter("side = 'then'").groupBy("set_id", "symbol").agg(numbered("rule").alias("rules"))
    rows = coverage.join(kinds, ["set_id", "symbol"], "left").withColumn("gap_status", status)
    rows = rows.groupBy("q_id", "set_id", "symbol", "atom").agg(F.min_by("gap_status", F.struct("rule", "place")).alias("gap_status")).join(by, ["set_id", "symbol"], "left")
    functions = symbols.filter("kind = 'observable' and returns <> 'Bool'").select("set_id", F.col("name").alias("symbol")).distinct()
    used = compares.filter("side = 'if'").groupBy("set_id", F.col("func").alias("symbol")).agg(numbered("rule").alias("rules"))
    told = facts.filter("value is not null").select("set_id", "case_id", "symbol").distinct().withColumn("told", F.lit(True))
    numeric = queries.select("q_id", "case_id", "set_id").join(functions, "set_id").join(told, ["set_id", "case_id", "symbol"], "left").join(used, ["set_id", "symbol"], "left")
    numeric = numeric.select("q_id", "set_id", "symbol", F.concat("symbol", F.lit("(...)")).alias("atom"), F.when(F.col("told"), "directly_present").otherwise("blocked_by_missing_numeric").alias("gap_status"), "rules")
    return rows.select("q_id", "set_id", "symbol", "atom", "gap_status", "rules").unionByName(numeric).withColumn("rules", F.coalesce("rules", F.lit("")))

