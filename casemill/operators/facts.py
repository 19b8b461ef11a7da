"""Fact tables: parsing, schema checks, domains and entities.

A fact row is (case_id, symbol, args array, polarity boolean, value string, form). A schema row is
(name, args array of types, returns, kind). Schemas are rule-set sized and may be broadcast by Spark's own
size estimate; facts are only ever hashed by case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.text import output_category, question_tokens, safe_entity, symbol_tokens
from casemill.operators.routing import assertable

#: A fact line in one pattern: a sign, a name, arguments, and a value or a truth.
LINE = r"(?i)^(?:(not)\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\(([^()]*)\)(?:\s*=\s*(.+?)|\s+(is)\s+(true|false))?\s*\.$"
SEP = "\x01"


def parse_facts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fact lines to rows; lines of no form keep a null symbol and get a reason.

    Forms, as they are tried: bool_assign (p(a) = true.), bool_is (p(a) is false.), value (f(a) = 3.), denial (not p(a).), atom (p(a).). Each line
    is matched once.
    """
    s = F.trim(F.coalesce(F.col(line), F.lit("")))
    cut = F.regexp_replace(s, LINE, SEP.join(f"${k}" for k in range(1, 7)))
    # a generator keeps the planner from copying the match into every column that reads it
    x = lines.select("*", F.explode(F.array(cut)).alias("_cut"))
    x = x.select(*lines.columns, F.explode(F.array(F.when(F.col("_cut") != s, F.split("_cut", SEP)))).alias("_p"))
    part = lambda k: F.get("_p", F.lit(k))
    plain, said = part(0) == "", part(3) != ""
    form = F.when(part(4) != "", F.when(plain, "bool_is")).when(said & F.lower(part(3)).isin("true", "false"), F.when(plain, "bool_assign")).when(said, F.when(plain, "value")).when(~plain, "denial").when(plain, "atom")
    x = x.withColumn("form", form)
    read = F.col("form").isNotNull()
    truth = F.when(F.col("form") == "bool_assign", F.lower(part(3)) == "true").when(F.col("form") == "bool_is", F.lower(part(5)) == "true").when(F.col("form") == "denial", False).when(F.col("form") == "atom", True)
    reason = F.when(read, None).when(s == "", "empty").when(~s.endswith("."), "no_final_dot").when(s.contains("*"), "star_in_symbol").otherwise("unreadable")
    return x.withColumns({
        "symbol": F.when(read, part(1)),
        "args": F.when(read, F.transform(F.split(part(2), ","), lambda a: F.trim(a))),
        "polarity": truth,
        "value": F.when(F.col("form") == "value", part(3)),
        "reason": reason,
    }).drop("_p")


def accepted(parsed: DataFrame) -> DataFrame:
    """The rows that were read, once each."""
    return parsed.filter("symbol is not null").select("case_id", "symbol", "args", "polarity", "value").distinct()


def render_facts(facts: DataFrame) -> DataFrame:
    """Facts as lines."""
    atom = F.concat("symbol", F.lit("("), F.array_join("args", ","), F.lit(")"))
    line = F.when(F.col("value").isNotNull(), F.concat(atom, F.lit(" = "), "value")).when(F.col("polarity"), atom).otherwise(F.concat(F.lit("not "), atom))
    return facts.select("case_id", F.concat(line, F.lit(".")).alias("line")).distinct()


def canonical_symbols(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """The schema's spelling of each symbol; keys with two spellings aren't used; ``known`` tells."""
    one = schema.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("canonical"), F.count_distinct("name").alias("n")).filter("n = 1").drop("n")
    out = facts.join(one, F.lower("symbol") == F.col("k"), "left").drop("k")
    return out.withColumns({"known": F.col("canonical").isNotNull(), "symbol": F.coalesce("canonical", "symbol")}).drop("canonical")


def contradictions(facts: DataFrame) -> DataFrame:
    """C4: atoms asserted true and false in one case."""
    return facts.filter("polarity is not null").groupBy("case_id", "symbol", "args").agg(F.bool_or("polarity").alias("p"), F.bool_or(~F.col("polarity")).alias("n")).filter("p and n").select("case_id", "symbol", "args")


def exclusive_classes(facts: DataFrame, classes: list[str]) -> DataFrame:
    """Entities in two or more classes of an exclusive set."""
    own = facts.filter(F.col("symbol").isin(*classes) & F.col("polarity") & (F.size("args") == 1))
    return own.groupBy("case_id", F.col("args")[0].alias("entity")).agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("classes"), F.count_distinct("symbol").alias("n")).filter("n > 1")


def net_extension(facts: DataFrame) -> DataFrame:
    """Per case and symbol the true atoms that aren't denied, in order, as tuples (arrays of arguments); only denials: an empty set."""
    own = facts.filter("polarity is not null").groupBy("case_id", "symbol", "args").agg(F.bool_and("polarity").alias("held"))
    tuples = F.array_sort(F.collect_list(F.when(F.col("held"), F.col("args"))))
    return own.groupBy("case_id", "symbol").agg(F.count_if("held").alias("n_tuples"), F.count_if(~F.col("held")).alias("n_denied"), tuples.alias("tuples"))


def close_world(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """Observable predicates without a fact in a case (closed as empty)."""
    names = schema.filter("kind = 'observable' and returns = 'Bool'").select(F.col("name").alias("symbol"))
    cases = facts.select("case_id").distinct()
    pairs = cases.withColumn("_1", F.lit(1)).join(names.withColumn("_1", F.lit(1)), "_1").drop("_1")
    return pairs.join(facts.select("case_id", "symbol").distinct(), ["case_id", "symbol"], "left_anti")


def typed_positions(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """Each argument with the type its position asks for."""
    types = schema.select(F.col("name").alias("symbol"), F.posexplode("args").alias("pos", "type"))
    return facts.select("case_id", "symbol", F.posexplode("args").alias("pos", "entity")).join(types, ["symbol", "pos"])


def typed_domains(facts: DataFrame, schema: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Constants of each type in a case: those at typed positions and, where given, the declared(case_id, entity, type)
    of types that the schema names."""
    own = typed_positions(facts, schema).select("case_id", "type", "entity")
    if declared is not None:
        own = own.unionByName(declared.join(_types(schema), "type", "left_semi").select("case_id", "type", "entity"))
    return own.distinct()


def _types(schema: DataFrame) -> DataFrame:
    """Types that some argument has."""
    return schema.select(F.explode("args").alias("type")).distinct()


def resolve_entity_types(facts: DataFrame, schema: DataFrame, queries: DataFrame | None = None, declared: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """One type for each entity of a case, from the positions it has in facts and queries, then from its declaration.

    queries(case_id, symbol, args), declared(case_id, entity, type), types(type) are the types there are (those of arguments
    unless given). A value is evidence for functions, an atom for predicates. Several types, or one that differs from a declared type
    there is, are a conflict; without evidence a declared type there is counts; the rest are unmapped. Of several declared types the last by
    name counts. Returns case_id, entity, types (of the evidence), declared, resolved, source, status.
    """
    flag = F.col("returns") == "Bool"
    sig = schema.select(F.col("name").alias("symbol"), flag.alias("truth"), F.posexplode("args").alias("pos", "type"))
    seen = facts.select("case_id", "symbol", F.col("value").isNull().alias("truth"), F.posexplode("args").alias("pos", "entity"), F.lit("fact_argument").alias("source"))
    if queries is not None:
        seen = seen.unionByName(queries.select("case_id", "symbol", F.lit(True).alias("truth"), F.posexplode("args").alias("pos", "entity"), F.lit("query_argument").alias("source")))
    rows = seen.join(sig, ["symbol", "truth", "pos"]).select("case_id", "entity", "type", "source", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("boolean").alias("there"))
    if declared is not None:
        there = (_types(schema) if types is None else types.select("type").distinct()).withColumn("there", F.lit(True))
        told = declared.join(there, "type", "left").select("case_id", "entity", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("source"), F.col("type").alias("declared"), F.coalesce("there", F.lit(False)).alias("there"))
        rows = rows.unionByName(told)
    last = F.max(F.when(F.col("there").isNotNull(), F.struct("declared", "there")))
    x = rows.filter("entity <> ''").groupBy("case_id", "entity").agg(F.array_sort(F.collect_set("type")).alias("t"), F.array_sort(F.collect_set("source")).alias("s"), last.alias("d"))
    known = F.coalesce(F.col("d.there"), F.lit(False))
    clash = (F.size("t") > 1) | ((F.size("t") == 1) & known & (F.col("d.declared") != F.get("t", F.lit(0))))
    resolved = F.when(clash, None).when(F.size("t") == 1, F.get("t", F.lit(0))).when(known, F.col("d.declared"))
    source = F.when(resolved.isNull(), None).when(F.size("t") == 1, F.array_join("s", "+")).otherwise("declared")
    status = F.when(clash, "conflict").when(resolved.isNull(), "unmapped").otherwise("resolved")
    return x.select("case_id", "entity", F.array_join("t", ",").alias("types"), F.col("d.declared").alias("declared"), resolved.alias("resolved"), source.alias("source"), status.alias("status"))


def resolved_domains(resolved: DataFrame) -> DataFrame:
    """The entities of each type of a case, as resolved."""
    return resolved.filter("resolved is not null").select("case_id", F.col("resolved").alias("type"), "entity")


def validate_signatures(facts: DataFrame, schema: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """One row per violation. A fact has the first that applies of unknown_symbol, value_for_predicate, truth_for_function,
    not_assertable (where the schema has a column assertable) and wrong_arity; a fact without any has wrong_argument_type
    for each argument that types(case_id, entity, resolved) give another type or none. Null arguments are none.

    Returns case_id, symbol, code, args, pos (from 0, -1 for the whole fact), expected, found.
    """
    may = F.coalesce("assertable", F.lit(False)) if "assertable" in schema.columns else F.lit(True)
    s = schema.select(F.col("name").alias("symbol"), F.col("args").alias("want"), "returns", may.alias("may"))
    x = facts.join(s, "symbol", "left")
    truth = F.col("returns") == "Bool"
    code = F.when(F.col("want").isNull(), "unknown_symbol").when(truth & F.col("value").isNotNull(), "value_for_predicate").when(~truth & F.col("value").isNull(), "truth_for_function")
    x = x.withColumn("code", code.when(~F.col("may"), "not_assertable").when(F.coalesce(F.size("args"), F.lit(0)) != F.size("want"), "wrong_arity"))
    said = F.array_join("args", ",").alias("args")
    arity = lambda c: F.when(F.col("code") == "wrong_arity", F.size(c).cast("string"))
    out = x.filter("code is not null").select("case_id", "symbol", "code", said, F.lit(-1).alias("pos"), arity("want").alias("expected"), arity("args").alias("found"))
    if types is None:
        return out
    own = x.filter("code is null").select("case_id", "symbol", said, "want", F.posexplode("args").alias("pos", "entity")).withColumn("expected", F.get("want", "pos"))
    own = own.join(types.select("case_id", "entity", F.col("resolved").alias("found")), ["case_id", "entity"], "left").filter(~F.col("expected").eqNullSafe(F.col("found")))
    return out.unionByName(own.select("case_id", "symbol", F.lit("wrong_argument_type").alias("code"), "args", "pos", "expected", "found"))


#: Arguments that stand for no entity.
PLACEHOLDERS = (
    "", "?", "unknown", "none", "null", "this", "this_company", "the_company", "this_entity", "this_person", "this_year", "company", "person",
    "financialyear", "financial_year", "fy", "estate", "decision",
)


def validate_queries(queries: DataFrame, schema: DataFrame, domains: DataFrame, strict: bool = True) -> DataFrame:
    """C11: violations of queries(q_id, case_id, symbol, args): unknown_symbol, wrong_arity (pos -1), and for each argument placeholder (a
    word that names nothing, or the type itself) or not_in_domain: no entity of its type in domains(case_id, type, entity).

    With ``strict`` off a type of which the case has no entity takes any argument. A null argument is a placeholder.
    """
    known = schema.select(F.col("name").alias("symbol"), F.col("args").alias("types"))
    x = queries.join(known, "symbol", "left")
    code = F.when(F.col("types").isNull(), "unknown_symbol").when(F.coalesce(F.size("args"), F.lit(0)) != F.size("types"), "wrong_arity")
    x = x.withColumn("code", code)
    args = x.filter("code is null").select("q_id", "case_id", "types", F.posexplode("args").alias("pos", "entity")).withColumn("type", F.get("types", "pos"))
    entity = safe_entity(F.col("entity"))
    empty = entity.isin(*PLACEHOLDERS) | (entity == safe_entity(F.col("type"))) | F.trim(F.coalesce("entity", F.lit(""))).isin(*PLACEHOLDERS)
    args = args.withColumn("empty", F.coalesce(empty, F.lit(True)))
    missing = args.filter("not empty").join(domains, ["case_id", "type", "entity"], "left_anti")
    if not strict:
        missing = missing.join(domains.select("case_id", "type").distinct(), ["case_id", "type"], "left_semi")
    out = x.filter("code is not null").select("q_id", "code", F.lit(-1).alias("pos"))
    out = out.unionByName(args.filter("empty").select("q_id", F.lit("placeholder").alias("code"), "pos"))
    return out.unionByName(missing.select("q_id", F.lit("not_in_domain").alias("code"), "pos"))


def ground_atoms(schema: DataFrame, domains: DataFrame, cap: int = 200) -> DataFrame:
    """Argument tuples of symbols of any arity over the domains of each case, the first ``cap`` in the order of entities, with a flag.

    schema(name, args), domains(case_id, type, entity). A case's entities of a type are numbered, and tuple n is read off its number, digit by
    digit with the domains' sizes as bases: only the tuples that stay are ever made. A case without entities of some
    argument's type has no tuples. Returns case_id, symbol, args, cut.
    """
    w = Window.partitionBy("case_id", "type").orderBy("entity")
    own = domains.select("case_id", "type", "entity").distinct()
    first = own.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).groupBy("case_id", "type").agg(F.array_sort(F.collect_list("entity")).alias("pool"))
    pools = first.join(own.groupBy("case_id", "type").agg(F.count("*").alias("size")), ["case_id", "type"])
    asked = schema.filter(F.size("args") > 0).select(F.col("name").alias("symbol"), F.size("args").alias("arity"), F.posexplode("args").alias("pos", "type")).distinct()
    x = asked.join(pools, "type").groupBy("case_id", "symbol", "arity").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "pool"))).alias("digits")).filter(F.size("digits") == F.col("arity"))
    # as large as it needs to be told from cap
    total = F.aggregate("digits", F.lit(1).cast("long"), lambda n, d: F.least(n * F.least(d["size"], F.lit(cap + 1)), F.lit(cap + 1).cast("long")))
    x = x.withColumn("total", total).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("total", F.lit(cap)) - 1)))
    start = F.struct(F.col("n").alias("rest"), F.array().cast("array<string>").alias("args"))
    step = lambda s, d: F.struct(F.call_function("div", s["rest"], d["size"]).alias("rest"), F.concat(F.array(F.get(d["pool"], (s["rest"] % d["size"]).cast("int"))), s["args"]).alias("args"))
    args = F.aggregate(F.reverse("digits"), start, step, lambda s: s["args"])
    return x.select("case_id", "symbol", args.alias("args"), (F.col("total") > cap).alias("cut"))


#: Where a question names someone.
NAMED = (r"\b(?:Is|Are|Does|Did|Was|Were)\s+([A-Z][a-zA-Z]+)\b", r"\b(?:for|about)\s+([A-Z][a-zA-Z]+)\b", r"^\s*(?:Heeft|Verkrijgt|Krijgt|Is|Kan|Moet)\s+([A-Z][a-zA-Z]+)\b")


def named_in_question(question: Column) -> Column:
    """C17: the name, lower-case, that a question gives; null if it names no one."""
    text = F.trim(F.coalesce(question, F.lit("")))
    found = [F.lower(F.regexp_extract(text, p, 1)) for p in NAMED]
    return F.coalesce(*[F.when(F.length(n) >= 2, n) for n in found])


def fill_singletons(queries: DataFrame, domains: DataFrame) -> DataFrame:
    """C17: an empty argument (queries(q_id, case_id, type, arg, with question if there is one)) takes the case's only entity of the
    type, unless the question names someone."""
    one = domains.groupBy("case_id", "type").agg(F.count("*").alias("n"), F.min("entity").alias("only")).filter("n = 1")
    free = named_in_question(F.col("question")).isNull() if "question" in queries.columns else F.lit(True)
    own = F.when(F.col("arg") != "", F.col("arg"))
    return queries.join(one, ["case_id", "type"], "left").select("q_id", "case_id", F.coalesce(own, F.when(free, F.col("only"))).alias("arg"), (F.coalesce(F.col("arg"), F.lit("")) == "").alias("was_empty"))


#: What tells a relation between two entities by its name or description, or by its name alone.
BETWEEN_MARKERS = ("affiliated", "associated", "related", "connected", "belongs_to", "member_of", "forms_consortium", "consortium", "controls", "owns", "participates", "partner", "parent", "subsidiary", "daughter", "child_company", "linked_to", "group_with", "with_other", "with_another", "between", "spouse", "married", "successor", "predecessor")
BETWEEN_NAME = r"(?i)(?:_with$|_to$|_of$|related|affiliat|consortium|subsidiary|parent)"
#: What tells a relation that an entity may have to itself.
REFLEXIVE_MARKERS = ("same", "identical", "equal", "equals", "self", "itself", "is_same", "identity", "reflexive", "symmetric_identity")


def self_relations(facts: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """C20: facts R(x, x) of a relation between entities that isn't reflexive.

    symbols(name, and where there are such columns set_id, description, reflexive_allowed, non_reflexive): a mark wins over words, which are
    sought in name and description with other characters than letters and digits as spaces. Without symbols, names alone decide.
    """
    own = facts.filter((F.size("args") == 2) & (F.col("args")[0] == F.col("args")[1]))
    told = {"description": F.lit(""), "reflexive_allowed": F.lit(False), "non_reflexive": F.lit(False)}
    if symbols is None:
        x = own.withColumns(told)
    else:
        key = [c for c in ("set_id",) if c in symbols.columns and c in facts.columns] + ["symbol"]
        s = symbols.withColumn("symbol", F.col("name")).groupBy(*key).agg(*(F.max(c if c in symbols.columns else told[c]).alias(c) for c in told))
        x = own.join(s, key, "left")
    words = F.regexp_replace(F.lower(F.concat_ws(" ", "symbol", F.coalesce("description", F.lit("")))), "[^a-z0-9]+", " ")
    some = lambda marks: F.lit(False) if not marks else reduce(lambda a, b: a | b, [words.contains(m) for m in marks])
    between = some(BETWEEN_MARKERS) | F.col("symbol").rlike(BETWEEN_NAME)
    free = F.coalesce("reflexive_allowed", F.lit(False)) | some(REFLEXIVE_MARKERS)
    odd = between & (F.coalesce("non_reflexive", F.lit(False)) | ~free)
    return x.filter(odd).select("case_id", "symbol", F.col("args")[0].alias("entity"))


def signature_conflicts(symbols: DataFrame) -> DataFrame:
    """Names with two signatures in a rule set."""
    sig = F.concat(F.array_join("args", ","), F.lit("->"), "returns")
    return symbols.groupBy("set_id", "name").agg(F.count_distinct(sig).alias("n")).filter("n > 1")


def undeclared_symbols(usages: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols called but not declared, the first ``limit`` by name and the number of all."""
    names = usages.select("set_id", "symbol").distinct().join(symbols.select("set_id", F.col("name").alias("symbol")), ["set_id", "symbol"], "left_anti")
    w = Window.partitionBy("set_id")
    return names.withColumn("n_undeclared", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("symbol"))).filter(F.col("r") <= limit).drop("r")


#: Codes of rejections that call for a decomposition.
COMPOSITE_CODES = ("derived_or_helper", "computed_composite", "classification_output")


def replacement_roles(symbols: DataFrame) -> DataFrame:
    """Symbols as C12 reads them, with returns: those a case may state instead of a rejected one, by role: function (a
    number that isn't derived), predicate (an atomic observable one), threshold (a composite one marked as observable)."""
    low = lambda c, other="": F.lower(F.trim(F.coalesce(F.col(c), F.lit(other))))
    direct = F.coalesce("directly_observable", F.lit(False))
    x = assertable(symbols).withColumn("_output", output_category(F.col("name"), F.col("kind"), F.col("legal_output"), F.col("category")))
    exempt = direct | F.coalesce("case_input", F.lit(False)) | low("kind").isin("background", "case_input")
    stated = exempt | (low("kind").isin("observable", "input", "function") & ~(F.col("computed") & (low("kind") != "observable")))
    function = F.trim("returns").isin("Int", "Real", "Float") & ~low("kind").isin("helper", "derived") & stated
    truth = low("returns", "Bool") == "bool"
    composite = F.col("symbol_class").isin("conclusion", "threshold")
    atomic = low("kind").isin("observable", "input") & ~F.coalesce("legal_output", F.lit(False)) & ~F.col("_output").isin("effect", "classification") & ~composite
    role = F.when(function, "function").when(truth & F.col("allowed") & atomic, "predicate").when(truth & F.col("allowed") & direct & composite, "threshold")
    return x.withColumn("role", role).filter("role is not null").select(*symbols.columns, "role")


def suggest_replacements(rejected: DataFrame, symbols: DataFrame, k: int = 12, least: float = 0.04, cases: DataFrame | None = None) -> DataFrame:
    """For rejected(set_id, name, with description, code and case_id where there are any) the symbols(set_id, name, with description,
    role and directly_observable) of the set that a case may state instead, at most k, by falling score, then name.

    The score is 2.5 times the Jaccard similarity of the tokens of names and descriptions, 1.8 times that of the
    symbol's and the text's of cases(case_id, text), 0.45 for a function and 0.25 for an observable symbol where the code calls for a
    decomposition, and 0.4 for thresholds. Scores below ``least`` are left out. Symbols without a role count as predicates.
    """
    tokens = lambda df: F.array_distinct(F.concat(symbol_tokens(F.col("name")), symbol_tokens(F.col("description") if "description" in df.columns else F.lit(""))))
    opt = lambda df, c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    case_type = cases.schema["case_id"].dataType.simpleString() if cases is not None else "string"
    composite = F.coalesce(opt(rejected, "code", "string").isin(*COMPOSITE_CODES), F.lit(False)).cast("int")
    r = rejected.select("set_id", opt(rejected, "case_id", case_type).alias("case_id"), F.col("name").alias("rejected"), composite.alias("comp"), tokens(rejected).alias("t")).distinct()
    role = F.coalesce(opt(symbols, "role", "string"), F.lit("predicate"))
    seen = (F.coalesce(opt(symbols, "directly_observable", "boolean"), F.lit(False)) | (role == "threshold")).cast("int")
    function, threshold = (role == "function").cast("int"), (role == "threshold").cast("int")
    s = symbols.select("set_id", F.col("name").alias("suggested"), function.alias("function"), threshold.alias("threshold"), seen.alias("seen"), tokens(symbols).alias("u"), F.explode(F.array(F.lit(0), F.lit(1))).alias("comp"))
    extra = F.col("comp") * (0.45 * F.col("function") + 0.25 * F.col("seen")) + F.col("threshold") * F.when(F.col("comp") == 1, 0.15).otherwise(0.4)
    s = s.withColumn("extra", F.round(extra, 6)).distinct()
    keys = ["set_id", "case_id", "rejected", "comp"]
    # words bring names together; of what shares none only the best of a set can be among the first k
    words = s.select("set_id", "comp", "suggested", F.explode("u").alias("w"))
    near = r.select(*keys, F.explode("t").alias("w")).join(words, ["set_id", "comp", "w"]).select(*keys, "suggested")
    if cases is not None:
        texts = cases.select("case_id", F.array_union(question_tokens(F.col("text")), F.array_distinct(symbol_tokens(F.col("text")))).alias("c")).withColumn("c", F.when(F.size("c") > 0, F.col("c")))
        r = r.join(texts, "case_id", "left")
        told = r.select("set_id", "case_id", "comp", "c").distinct().select("set_id", "case_id", "comp", F.explode("c").alias("w")).join(words, ["set_id", "comp", "w"]).select("set_id", "case_id", "comp", "suggested").distinct()
        near = near.unionByName(r.select(*keys).join(told, ["set_id", "case_id", "comp"]))
    else:
        r = r.withColumn("c", F.lit(None).cast("array<string>"))
    best = F.row_number().over(Window.partitionBy("set_id", "comp").orderBy(F.desc("extra"), "suggested"))
    plain = s.filter("extra > 0").withColumn("r", best).filter(F.col("r") <= k + 1).select("set_id", "comp", "suggested")
    pairs = near.unionByName(r.select(*keys).join(plain, ["set_id", "comp"])).distinct().filter(F.col("rejected") != F.col("suggested"))
    like = pairs.columns
    joined = pairs.alias("p").join(r.alias("r"), (F.col("p.set_id") == F.col("r.set_id")) & F.col("p.case_id").eqNullSafe(F.col("r.case_id")) & (F.col("p.rejected") == F.col("r.rejected")) & (F.col("p.comp") == F.col("r.comp")))
    x = joined.select(*[F.col(f"p.{c}").alias(c) for c in like], "t", "c").join(s, ["set_id", "comp", "suggested"])
    share = lambda v: F.coalesce(F.try_divide(F.size(F.array_intersect(v, "u")), F.size(F.array_union(v, "u"))), F.lit(0.0))
    name, text = share(F.col("t")), F.when(F.col("c").isNull(), 0.0).otherwise(share(F.col("c")))
    x = x.withColumns({"score": F.round(2.5 * name + 1.8 * text + F.col("extra"), 6), "_name": name > 0, "_text": text > 0})
    on = lambda c: F.col(c) == 1
    reasons = F.array_compact(F.array(F.when(F.col("_name"), "name"), F.when(F.col("_text"), "case_text"), F.when(on("comp") & on("function"), "numeric_function"), F.when(on("seen") & (on("comp") | on("threshold")), "observable")))
    x = x.filter((F.col("score") >= least) | (on("comp") & on("function")))
    rank = F.row_number().over(Window.partitionBy("set_id", "case_id", "rejected", "comp").orderBy(F.desc("score"), "suggested"))
    out = x.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("set_id", "case_id", "rejected", "rank", "suggested", "score", F.array_join(reasons, ",").alias("reasons"))
