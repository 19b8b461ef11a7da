"""Rule evaluation over fact tables: forward chaining by joins, three-valued answers, explanations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators import chain


def with_sets(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts with the set of rules that holds for them: facts without a set_id belong to the only set there is."""
    if "set_id" in facts.columns:
        return facts
    sets = rules.select("set_id").distinct().limit(2).collect()
    if len(sets) > 1:
        raise ValueError("rules of several sets: facts need a set_id")
    return facts.withColumn("set_id", F.lit(sets[0][0] if sets else None).cast(rules.schema["set_id"].dataType))


def derive(facts: DataFrame, rules: DataFrame, closed: Iterable[str] = ()) -> tuple[chain.Program, chain.Closure]:
    """The program of a rule table, and for each case what the rules of its set conclude, with every derivation.

    facts(set_id, case_id, symbol, args, polarity, value); rules(set_id, rule, rule_json). Negated conjuncts of ``closed`` symbols hold where
    no fact does, once the symbol is finished; others need a denial. Rules that can't be read, variables that nothing binds and
    closed negations in a cycle raise.
    """
    program = chain.Program(rules, closed)
    return program, program.run(with_sets(facts, rules))


def atoms_of(closure: chain.Closure) -> DataFrame:
    """set_id, case_id, symbol, args, polarity, value, rule, round, without the symbols that stand for alternatives."""
    return closure.atoms.filter("symbol not like '#%'").drop("world")


def apply_rules(facts: DataFrame, rules: DataFrame, closed: Iterable[str] = ()) -> DataFrame:
    """Facts and everything the rules of their set conclude: set_id, case_id, symbol, args, polarity, value, rule, round."""
    return atoms_of(derive(facts, rules, closed)[1])


def _case(*tables: DataFrame) -> list[str]:
    """What names a case in all of the tables: set_id too, if all have it."""
    return [c for c in ("set_id", "case_id") if all(c in t.columns for t in tables)]


def _text(symbol: Column, args: Column, polarity: Column, value: Column) -> Column:
    """An atom as a line: p(a,b), not p(a), f(a) = 3."""
    atom = F.concat(symbol, F.lit("("), F.array_join(args, ","), F.lit(")"))
    return F.when(value.isNotNull(), F.concat(atom, F.lit(" = "), value)).when(polarity, atom).otherwise(F.concat(F.lit("not "), atom))


def _supported(closure: chain.Closure, roots: DataFrame) -> DataFrame:
    """roots(root, LITERAL) -> root, set_id, case_id, round, source, atom: the facts and rules that the roots rest on, in all proofs; source is
    fact, rule and number, or closed for what nothing holds."""
    found = chain.support(closure.derivations, roots).filter("symbol not like '#%'")
    known = closure.atoms.select(*chain.LITERAL, "value", "round", (F.col("round") == 0).alias("stated"))
    by = closure.derivations.groupBy(*chain.LITERAL).agg(F.collect_set("rule").alias("rules"))
    k = known.select(*(F.col(c).alias(f"k_{c}") for c in known.columns))
    same = [found[c] == k[f"k_{c}"] for c in ("set_id", "case_id", "symbol", "args")] + [found[c].eqNullSafe(k[f"k_{c}"]) for c in ("polarity", "value")]
    x = found.join(k, same, "left").join(by, chain.LITERAL, "left")
    sources = F.concat(F.when(F.col("k_stated"), F.array(F.lit("fact"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("rules", lambda r: F.concat(F.lit("rule "), r.cast("string"))), F.array().cast("array<string>")))
    sources = F.when(F.col("k_round").isNull(), F.array(F.lit("closed"))).otherwise(sources)
    return x.select("root", "set_id", "case_id", F.col("k_round").alias("round"), F.explode(sources).alias("source"), _text(F.col("symbol"), F.col("args"), F.col("polarity"), F.col("value")).alias("atom")).distinct()


def conflict_support(closure: chain.Closure) -> DataFrame:
    """For each atom that is held and denied, and each function with two values, the facts and rules behind it in the order of
    rounds: set_id, case_id, conflict, step, round, source, atom."""
    atoms = closure.atoms.filter("symbol not like '#%'")
    both = atoms.filter("value is null").groupBy("set_id", "case_id", "symbol", "args").agg(F.count_distinct("polarity").alias("n")).filter("n > 1").drop("n")
    name = F.concat("symbol", F.lit("("), F.array_join("args", ","), F.lit(")"))
    signs = both.withColumn("polarity", F.explode(F.array(F.lit(True), F.lit(False))))
    found = _supported(closure, signs.withColumn("root", name)).withColumnRenamed("root", "conflict")
    values = atoms.filter("value is not null").groupBy("set_id", "case_id", "symbol", "args").agg(F.collect_set("value").alias("values")).filter("size(values) > 1")
    stated = values.select("set_id", "case_id", name.alias("conflict"), F.explode("values").alias("value"), "symbol", "args").select("conflict", "set_id", "case_id", F.lit(0).alias("round"), F.lit("fact").alias("source"), _text(F.col("symbol"), F.col("args"), F.lit(None).cast("boolean"), F.col("value")).alias("atom"))
    step = F.row_number().over(Window.partitionBy("set_id", "case_id", "conflict").orderBy(F.coalesce("round", F.lit(0)), "atom", "source"))
    return found.unionByName(stated).withColumn("step", step)


def answer_support(closure: chain.Closure, queries: DataFrame) -> DataFrame:
    """For each query(q_id, set_id, case_id, symbol, args) that is held or denied the facts and rules of all its proofs, in the order of
    rounds: q_id, step, round, source, atom."""
    signs = queries.select(F.col("q_id").alias("root"), "set_id", "case_id", "symbol", "args").join(closure.atoms.filter("value is null").select(*chain.LITERAL), ["set_id", "case_id", "symbol", "args"])
    step = F.row_number().over(Window.partitionBy("root").orderBy(F.coalesce("round", F.lit(0)), "atom", "source"))
    return _supported(closure, signs).select(F.col("root").alias("q_id"), step.alias("step"), "round", "source", "atom")


def entail_assumed(program: chain.Program, closure: chain.Closure, queries: DataFrame) -> DataFrame:
    """queries(q_id, set_id, case_id, symbol, args) answered by two assumptions each: q_id, set_id, case_id, possible, certain, label.

    An atom is possible unless assuming it leads to a contradiction, and certain if it is possible and assuming its denial does. All
    assumptions are closed at once, each in a world of its own over the shared closure of its case; a world adds only what its
    assumption entails. Closed symbols are decided by the closure, and a world that adds to one contradicts it. Cases that are
    inconsistent without an assumption are told so.
    """
    q = queries.select("q_id", "set_id", "case_id", "symbol", "args")
    closed = F.col("symbol").isin(*program.closed) if program.closed else F.lit(False)
    worlds = q.filter(~closed).withColumn("polarity", F.explode(F.array(F.lit(True), F.lit(False))))
    worlds = worlds.withColumn("world", F.concat(F.col("q_id").cast("string"), F.when(F.col("polarity"), "+").otherwise("-")))
    added = program.assume(closure, worlds).atoms
    base = closure.atoms.filter("value is null")
    opposite = lambda t, *c: t.select(*c, "set_id", "case_id", "symbol", "args", (~F.col("polarity")).alias("polarity"))
    clash = added.join(opposite(base), chain.LITERAL, "left_semi").select("world")
    clash = clash.union(added.join(opposite(added, "world"), ["world", *chain.LITERAL], "left_semi").select("world"))
    clash = clash.union(added.filter(closed & F.col("polarity")).select("world")).distinct().withColumn("clash", F.lit(True))
    of = lambda sign: clash.filter(F.col("world").endswith(sign)).select(F.expr("substring(world, 1, length(world) - 1)").alias("q"), F.col("clash").alias(f"clash{sign}"))
    held = base.groupBy("set_id", "case_id", "symbol", "args").agg(F.bool_or("polarity").alias("held"))
    x = q.withColumn("q", F.col("q_id").cast("string")).join(of("+"), "q", "left").join(of("-"), "q", "left").join(held, ["set_id", "case_id", "symbol", "args"], "left")
    x = x.join(consistency(closure.atoms).select("set_id", "case_id", "status"), ["set_id", "case_id"], "left")
    yes, no = F.coalesce("`clash-`", F.lit(False)), F.coalesce("`clash+`", F.lit(False))
    no = F.when(closed, ~F.coalesce("held", F.lit(False))).otherwise(no)
    yes = F.when(closed, F.coalesce("held", F.lit(False))).otherwise(yes)
    label = F.when(F.col("status") == "unsat", "inconsistent").when(no, "contradicted").when(yes, "entailed").otherwise("unknown")
    return x.select("q_id", "set_id", "case_id", (label != "contradicted").alias("possible"), (label == "entailed").alias("certain"), label.alias("label"))


def consistency(closure: DataFrame) -> DataFrame:
    """Cases with an atom and its denial, or two values of one function: status and their number."""
    case = _case(closure)
    atoms = closure.filter("value is null").groupBy(*case, "symbol", "args").agg((F.bool_or("polarity") & F.bool_or(~F.col("polarity"))).alias("clash"))
    values = closure.filter("value is not null").groupBy(*case, "symbol", "args").agg((F.count_distinct("value") > 1).alias("clash"))
    n = atoms.unionByName(values).groupBy(*case).agg(F.count_if("clash").alias("n_conflicts"))
    return n.withColumn("status", F.when(F.col("n_conflicts") > 0, "unsat").otherwise("ok"))


def explain_conflict(closure: DataFrame) -> DataFrame:
    """Both sides of each inconsistent atom, with the rule or "fact" behind them."""
    both = closure.filter("value is null").groupBy("case_id", "symbol", "args").agg(F.bool_or("polarity").alias("p"), F.bool_or(~F.col("polarity")).alias("n")).filter("p and n").drop("p", "n")
    src = F.coalesce(F.concat(F.lit("rule "), F.col("rule").cast("string")), F.lit("fact"))
    return closure.join(both, ["case_id", "symbol", "args"], "left_semi").select("case_id", "symbol", F.array_join("args", ",").alias("args"), "polarity", src.alias("source")).distinct()


def entail_boolean(closure: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(q_id, case_id, symbol, args) with possible, certain and label; inconsistent cases come first."""
    case = _case(closure, queries)
    held = closure.filter("value is null").groupBy(*case, "symbol", "args").agg(F.bool_or("polarity").alias("p"), F.bool_or(~F.col("polarity")).alias("n"))
    x = queries.join(held, [*case, "symbol", "args"], "left").join(consistency(closure).select(*case, "status"), case, "left")
    label = F.when(F.col("status") == "unsat", "inconsistent").when(F.coalesce("p", F.lit(False)), "entailed").when(F.coalesce("n", F.lit(False)), "contradicted").otherwise("unknown")
    return x.select("q_id", "case_id", "symbol", (label != "contradicted").alias("possible"), (label == "entailed").alias("certain"), label.alias("label"))


def entail_set(closure: DataFrame, domains: DataFrame, symbol: str, type_: str) -> DataFrame:
    """Per case the entities of a type for which a unary symbol is entailed, contradicted (denied only) and unknown, each in order."""
    held = closure.filter((F.col("symbol") == symbol) & F.col("value").isNull()).select("case_id", F.col("args")[0].alias("entity"), "polarity")
    x = domains.filter(F.col("type") == type_).select("case_id", "entity").distinct().join(held, ["case_id", "entity"], "left")
    per = x.groupBy("case_id", "entity").agg(F.bool_or("polarity").alias("p"))
    those = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("entity"))))
    return per.groupBy("case_id").agg(those(F.col("p")).alias("entailed"), those(~F.col("p")).alias("contradicted"), those(F.col("p").isNull()).alias("unknown"))


def wildcard_query(closure: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(q_id, case_id, symbol, args) whose wildcard arguments mean "some value": does one hold?"""
    held = closure.filter("polarity and value is null").select("case_id", "symbol", F.col("args").alias("held"))
    fits = F.forall(F.zip_with("args", "held", lambda q, h: q.isin("?", "_", "*", "any") | (q == h)), lambda b: F.coalesce(b, F.lit(False)))
    yes = queries.join(held, ["case_id", "symbol"]).filter((F.size("args") == F.size("held")) & fits).select("q_id").distinct().withColumn("holds", F.lit(True))
    return queries.select("q_id").join(yes, "q_id", "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def value_range(facts: DataFrame, symbol: str, domains: DataFrame | None = None) -> DataFrame:
    """Per case and entity the values of a function: their set, least and greatest; entities of domains(case_id, entity) without a
    value are unknown. Values that are no numbers count in the set alone."""
    v = facts.filter((F.col("symbol") == symbol) & F.col("value").isNotNull()).select("case_id", F.array_join("args", ",").alias("entity"), "value", F.col("value").try_cast("double").alias("v"))
    out = v.groupBy("case_id", "entity").agg(F.array_sort(F.collect_set("value")).alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
    if domains is not None:
        out = domains.select("case_id", "entity").distinct().join(out, ["case_id", "entity"], "left")
    return out.withColumn("status", F.when(F.col("values").isNull(), "unknown").otherwise("known"))


def optimum(facts: DataFrame, symbol: str) -> DataFrame:
    """Per case the entities with the least and greatest value (ties: the first by name)."""
    v = facts.filter((F.col("symbol") == symbol) & F.col("value").isNotNull()).select("case_id", F.col("args")[0].alias("e"), F.col("value").try_cast("double").alias("v"))
    return v.groupBy("case_id").agg(F.min(F.struct("v", "e")).alias("lo"), F.min(F.struct((-F.col("v")).alias("v"), "e")).alias("hi")).select("case_id", F.col("lo.e").alias("min_entity"), F.col("lo.v").alias("min_value"), F.col("hi.e").alias("max_entity"), (-F.col("hi.v")).alias("max_value"))


def possible_outputs(ground: DataFrame, closure: DataFrame, n: int = 3) -> DataFrame:
    """ground(case_id, symbol, args) not surely false, at most n per case."""
    false = closure.filter("not polarity and value is null").select("case_id", "symbol", "args")
    left = ground.join(false, ["case_id", "symbol", "args"], "left_anti").distinct()
    r = F.row_number().over(Window.partitionBy("case_id").orderBy("symbol", "args"))
    return left.withColumn("rank", r).filter(F.col("rank") <= n).select("case_id", "symbol", F.array_join("args", ",").alias("args"), "rank")


def criteria_count(values: DataFrame, thresholds: dict[str, float], max_exceeded: int = 1) -> DataFrame:
    """How many thresholds a row exceeds; the class holds at ``max_exceeded`` and below."""
    n = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) > t).cast("int"), F.lit(0)) for c, t in thresholds.items()])
    return values.withColumn("n_exceeded", n).withColumn("class_holds", F.col("n_exceeded") <= max_exceeded)


def consecutive_effect(flags: DataFrame) -> DataFrame:
    """Exceeded in two periods in a row; the effect starts in the period after the second."""
    w = Window.partitionBy("entity").orderBy("period")
    x = flags.withColumns({"before": F.lag("exceeded").over(w), "last": F.lag("period").over(w)})
    return x.filter("exceeded and before and period - last = 1").select("entity", (F.col("period") + 1).alias("effect_period"))


def answer_text(results: DataFrame) -> DataFrame:
    """One sentence per label."""
    s = F.when(F.col("label") == "entailed", F.concat(F.lit("Yes: "), "symbol", F.lit(" holds."))).when(F.col("label") == "contradicted", F.concat(F.lit("No: "), "symbol", F.lit(" does not hold."))).when(F.col("label") == "inconsistent", "The case contradicts itself.").otherwise(F.concat(F.lit("Open: "), "symbol", F.lit(" cannot be decided.")))
    return results.select("q_id", s.alias("answer"))


def propagate(closure: DataFrame, ground: DataFrame, with_unknown: bool = False) -> DataFrame:
    """E5: ground(case_id, symbol, args) with the label of each atom; undecided ones on request only."""
    held = closure.filter("value is null").groupBy("case_id", "symbol", "args").agg(F.bool_or("polarity").alias("p"), F.bool_or(~F.col("polarity")).alias("n"))
    x = ground.distinct().join(held, ["case_id", "symbol", "args"], "left")
    label = F.when(F.col("p") & F.col("n"), "inconsistent").when(F.col("p"), "true").when(F.col("n"), "false").otherwise("unknown")
    out = x.select("case_id", "symbol", F.array_join("args", ",").alias("args"), label.alias("label"))
    return out if with_unknown else out.filter("label <> 'unknown'")


def relevance(reach: DataFrame, facts: DataFrame) -> DataFrame:
    """reach(target, node) as of a closure over symbols: the facts of each relevant symbol, counted."""
    n = facts.groupBy("symbol").agg(F.count("*").alias("n_facts"), F.count_distinct("case_id").alias("n_cases"))
    return reach.select("target", F.col("node").alias("symbol")).distinct().join(n, "symbol", "left").select("target", "symbol", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def explain(closure: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query the rules that concluded it, or that it was stated, and the round."""
    src = F.coalesce(F.concat(F.lit("rule "), F.col("rule").cast("string")), F.lit("fact"))
    known = closure.filter("value is null").select("case_id", "symbol", "args", "polarity", src.alias("source"), "round")
    x = queries.join(known, ["case_id", "symbol", "args"], "left")
    return x.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), F.min("round").alias("round"))


def unify_results(routing: DataFrame, cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per query: inconsistent wins, then unsupported intents, then errors and missing answers.

    routing(q_id, case_id, intent, supported), cases(case_id, status), answers(q_id, label, error).
    """
    x = routing.join(cases.select("case_id", F.col("status").alias("case_status")), "case_id", "left").join(answers.select("q_id", "label", "error"), "q_id", "left")
    status = F.when(F.col("case_status") == "unsat", "inconsistent").when(~F.col("supported"), "unsupported").when(F.col("error").isNotNull() | F.col("label").isNull(), "error").otherwise("ok")
    return x.select("q_id", "intent", status.alias("status"), F.when(status == "ok", F.col("label")).alias("label"), F.when(status != "ok", F.coalesce("error", status)).alias("warning"))


def bind_period(queries: DataFrame, periods: DataFrame) -> DataFrame:
    """queries(q_id, entity, q_text) get the period after the year their text follows.

    periods(entity, period); the anchor is the year after "following"; without its successor among the
    entity's periods the anchor stays, with a warning.
    """
    anchor = F.regexp_extract(F.lower("q_text"), r"(?:following|after|volgend op)\s+((?:19|20)[0-9]{2})", 1).try_cast("int")
    q = queries.withColumn("anchor", anchor).withColumn("next", F.col("anchor") + 1)
    p = periods.select(F.col("entity"), F.col("period").alias("next"), F.lit(True).alias("known")).distinct()
    x = q.join(p, ["entity", "next"], "left")
    warning = F.when(F.col("anchor").isNull(), "no_anchor").when(F.col("known").isNull(), "no_successor")
    return x.select("q_id", "anchor", F.when(F.col("known"), F.col("next")).otherwise(F.col("anchor")).alias("period"), warning.alias("warning"))
