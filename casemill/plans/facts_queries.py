"""Queries of fact tables, rule tables and rule evaluation, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.lineage import settle
from casemill.operators import coverage as K
from casemill.operators import facts as C
from casemill.operators import infer as E
from casemill.operators import rules as D
from casemill.plans.fixtures import table

CLOSED = {"placed_by", "urgent", "open"}


def _schema(spark, d):
    return table(spark, d, "fx_symbols").withColumn("args", F.split("args_csv", ",")).drop("args_csv")


def _parsed(spark, d):
    return C.parse_facts(table(spark, d, "fx_facts"))


def _facts(spark, d):
    return C.accepted(_parsed(spark, d))


def _joined(df):
    return df.withColumn("args", F.array_join("args", ","))


def c1_parse_facts(spark, d):
    return _joined(_parsed(spark, d)).select("case_id", "line", "form", "symbol", "args", "polarity", "value", "reason")


def c2_render_facts(spark, d):
    return C.render_facts(_facts(spark, d))


def c3_canonical_symbols(spark, d):
    f = _facts(spark, d).withColumn("symbol", F.when(F.col("case_id") % 2 == 0, F.upper("symbol")).otherwise(F.concat("symbol", F.lit("_x"))))
    return C.canonical_symbols(f, _schema(spark, d)).groupBy("symbol", "known").agg(F.count("*").alias("n"))


def c4_contradictions(spark, d):
    return _joined(C.contradictions(_facts(spark, d)))


def c5_exclusive_classes(spark, d):
    return C.exclusive_classes(_facts(spark, d), ["urgent", "open"])


def c6_net_extension(spark, d):
    lines = F.array_join(F.transform("tuples", lambda t: F.array_join(t, ",")), ";")
    return C.net_extension(_facts(spark, d)).withColumn("tuples", lines)


def c7_close_world(spark, d):
    return C.close_world(_facts(spark, d), _schema(spark, d))


def c8_typed_domains(spark, d):
    """Every ninth customer is declared in its case, every tenth of them as something the schema doesn't know."""
    k = F.col("c_custkey")
    declared = table(spark, d, "customer").filter(k % 9 == 0).select(k.alias("case_id"), F.concat(F.lit("c"), k).alias("entity"), F.when(k % 10 == 0, "Court").otherwise("Customer").alias("type"))
    return C.typed_domains(_facts(spark, d), _schema(spark, d), declared)


def c9_resolve_entity_types(spark, d):
    odd = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("case_id"), F.lit("urgent").alias("symbol"), F.array(F.concat(F.lit("c"), F.col("o_custkey"))).alias("args"), F.lit(True).alias("polarity"), F.lit(None).cast("string").alias("value"))
    k = F.col("c_custkey")
    name = F.when(k % 7 < 2, "c").when(k % 7 == 2, "x").otherwise("y")
    declared = table(spark, d, "customer").filter(k % 7 < 4).select(k.alias("case_id"), F.concat(name, k).alias("entity"), F.when(k % 7 == 0, "Order").when(k % 7 == 2, "Customer").otherwise("Court").alias("type"))
    asked = _queries(spark, d).select("case_id", "symbol", "args")
    return C.resolve_entity_types(_facts(spark, d).unionByName(odd), _schema(spark, d), asked, declared)


def c10_validate_signatures(spark, d):
    k = F.col("o_orderkey") % 4
    odd = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.when(k == 0, "urgnt").when(k == 1, "total_price").otherwise("urgent").alias("symbol"), F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("o"), F.col("o_orderkey")))).alias("args"), F.lit(True).alias("polarity"), F.when(k == 3, "5").alias("value"))
    return C.validate_signatures(odd, _schema(spark, d))


def c10_argument_types(spark, d):
    """Arguments of every third order in the wrong order, an answer given as a fact, an entity that no other fact names."""
    k, o, c = F.col("o_orderkey"), F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    pair = F.struct(F.lit("placed_by").alias("symbol"), F.when(k % 3 == 0, F.array(c, o)).otherwise(F.array(o, c)).alias("args"), F.lit(None).cast("string").alias("value"))
    given = F.when(k % 5 == 0, F.struct(F.lit("is_priority_customer").alias("symbol"), F.array(c).alias("args"), F.lit(None).cast("string").alias("value")))
    lost = F.when(k % 7 == 0, F.struct(F.lit("total_price").alias("symbol"), F.array(F.concat(F.lit("z"), k)).alias("args"), F.lit("5").alias("value")))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.explode(F.array_compact(F.array(pair, given, lost))).alias("f")).select("case_id", "f.*")
    schema = _schema(spark, d)
    may = schema.withColumn("assertable", F.col("kind") == "observable")
    return C.validate_signatures(facts, may, C.resolve_entity_types(_facts(spark, d), schema))


def _queries(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.array(F.concat(F.lit("c"), F.col("c_custkey"))).alias("args"))
    one = c.select(F.concat(F.lit("p"), F.col("case_id")).alias("q_id"), "case_id", F.lit("is_priority_customer").alias("symbol"), "args")
    return one.unionByName(c.select(F.concat(F.lit("d"), F.col("case_id")).alias("q_id"), "case_id", F.lit("right_to_discount").alias("symbol"), "args"))


def c11_validate_queries(spark, d):
    q = _queries(spark, d).withColumn("symbol", F.when(F.col("case_id") % 13 == 0, "no_such").otherwise(F.col("symbol")))
    k = F.col("case_id")
    q = q.withColumn("args", F.when(k % 17 == 0, F.concat("args", "args")).when(k % 11 == 0, F.array(F.lit("The company"))).when(k % 19 == 0, F.array(F.lit("customer"))).when(k % 23 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("args")))
    return C.validate_queries(q, _schema(spark, d), C.typed_domains(_facts(spark, d), _schema(spark, d)))


def c16_ground_atoms(spark, d):
    """Symbols of one, two and three arguments."""
    pair = _schema(spark, d).filter("name in ('placed_by', 'urgent')").select("name", "args")
    triple = pair.filter("name = 'placed_by'").select(F.lit("moved").alias("name"), F.concat("args", F.array(F.lit("Order"))).alias("args"))
    return _joined(C.ground_atoms(pair.unionByName(triple), C.typed_domains(_facts(spark, d), _schema(spark, d))))


def c17_fill_singletons(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), F.col("c_custkey").alias("case_id"), F.lit("Order").alias("type"), F.lit("").alias("arg"))
    return C.fill_singletons(q, C.typed_domains(_facts(spark, d), _schema(spark, d)))


def c17_named_questions(spark, d):
    """Empty arguments of questions of which some name someone."""
    k = F.col("c_custkey")
    question = F.when(k % 5 == 0, "Does Anna have the right?").when(k % 5 == 1, "does it hold for Els").when(k % 5 == 2, "Heeft Filip recht?").when(k % 5 == 3, "Does the order count?")
    q = table(spark, d, "customer").select(k.alias("q_id"), k.alias("case_id"), F.lit("Order").alias("type"), F.when(k % 7 == 0, "o1").alias("arg"), question.alias("question"))
    return C.fill_singletons(q, C.typed_domains(_facts(spark, d), _schema(spark, d)))


def c20_self_relations(spark, d):
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "affiliated_with").when(k == 1, "same_group_as").when(k == 2, "owns").when(k == 3, "knows").when(k == 4, "linked_same").otherwise("heir_of")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), name.alias("symbol"), F.array((F.col("o_orderkey") % 7).cast("string"), (F.col("o_custkey") % 7).cast("string")).alias("args"))
    marks = spark.createDataFrame([("affiliated_with", "", False, False), ("knows", "a link between persons", False, False), ("linked_same", "related", False, True), ("heir_of", "", True, False)], "name string, description string, reflexive_allowed boolean, non_reflexive boolean")
    return C.self_relations(r, marks)


def c21_signature_conflicts(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("set_id"), F.element_at(F.split("p_name", " "), 1).alias("name"), F.array("p_brand").alias("args"), F.lit("Bool").alias("returns"))
    return C.signature_conflicts(p)


def c22_undeclared_symbols(spark, d):
    p = table(spark, d, "part")
    used = p.select((F.col("p_partkey") % 50).alias("set_id"), F.element_at(F.split("p_name", " "), 1).alias("symbol"))
    return C.undeclared_symbols(used, p.filter("p_partkey % 3 = 0").select((F.col("p_partkey") % 50).alias("set_id"), F.element_at(F.split("p_name", " "), 1).alias("name")), 3)


def d1_rule_atoms(spark, d):
    return _joined(D.rule_atoms(_rules(spark, d)))


def _rules(spark, d):
    """The rule set once for each part, so that the checks run over many sets."""
    r = table(spark, d, "fx_rules").drop("set_id")
    return table(spark, d, "part").select(F.col("p_partkey").alias("set_id")).withColumn("_1", F.lit(1)).join(r.withColumn("_1", F.lit(1)), "_1").drop("_1")


def _symbols(spark, d):
    s = _schema(spark, d).drop("set_id").filter("name <> 'never'")
    return table(spark, d, "part").select(F.col("p_partkey").alias("set_id")).withColumn("_1", F.lit(1)).join(s.withColumn("_1", F.lit(1)), "_1").drop("_1").filter("not (set_id % 3 = 0 and name = 'urgent')")


def _atoms(spark, d):
    """Atoms without the definitions that every fifth set lacks."""
    return D.rule_atoms(_rules(spark, d)).filter("not (set_id % 5 = 0 and rule = 0)")


def d2_rule_compares(spark, d):
    return _joined(D.rule_compares(_rules(spark, d)).withColumn("args", F.array("func"))).drop("args")


def _edges(spark, d):
    """A chain of parts: each uses the part at half its number."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")).filter("dst > 0")


def d3_derivation_closure(spark, d):
    return D.closure(_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("target")))


def d4_floating_helpers(spark, d):
    return D.floating_helpers(_atoms(spark, d), _symbols(spark, d))


def d5_undefined_derived(spark, d):
    return D.floating_helpers(_atoms(spark, d).filter("not (set_id % 7 = 0 and rule = 1 and side = 'then')"), _symbols(spark, d), ("derived",))


def d6_definition_cycles(spark, d):
    """Ten parts in a row use one another: in a ring if the tens are even, else in a chain."""
    ten, one = F.floor(F.col("p_partkey") / 10), F.col("p_partkey") % 10
    name = lambda i: F.concat(ten, F.lit("-"), i)
    return D.definition_cycles(table(spark, d, "part").select(name(one).alias("src"), name(F.when(ten % 2 == 0, (one + 1) % 10).otherwise(one + 1)).alias("dst")))


def d9_threshold_provenance(spark, d):
    numbers = table(spark, d, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("set_id"), F.when(F.col("p_partkey") % 4 == 1, 250000.0).otherwise(7.0).alias("value"))
    return D.threshold_provenance(D.rule_compares(_rules(spark, d)), numbers).select("set_id", "rule", "literal")


def d13_rule_arity(spark, d):
    return D.rule_arity(_atoms(spark, d), _symbols(spark, d))


def d13_rule_types(spark, d):
    """Every third set lacks a symbol, every fifth quantifies orders as bills, every seventh compares with a predicate."""
    r = _rules(spark, d)
    r = r.withColumn("rule_json", F.when(F.col("set_id") % 5 == 0, F.replace("rule_json", F.lit('"type":"Order"'), F.lit('"type":"Bill"'))).otherwise(F.col("rule_json")))
    r = r.withColumn("rule_json", F.when((F.col("set_id") % 7 == 0) & (F.col("rule") == 0), F.replace("rule_json", F.lit("total_price"), F.lit("open"))).otherwise(F.col("rule_json")))
    r = r.withColumn("rule_json", F.when((F.col("set_id") % 11 == 0) & (F.col("rule") == 1), F.replace("rule_json", F.lit('"var":"c"'), F.lit('"var":"k"'))).otherwise(F.col("rule_json")))
    return D.rule_types(r, _symbols(spark, d))


def d19_quarantine_rules(spark, d):
    return D.quarantine_rules(_rules(spark, d), d13_rule_arity(spark, d))


def _closure(spark, d):
    return E.apply_rules(_facts(spark, d), table(spark, d, "fx_rules"), CLOSED).drop("set_id")


def e1_apply_rules(spark, d):
    return _joined(_closure(spark, d).filter("round > 0")).select("case_id", "symbol", "args", "polarity", "rule")


def e2_entail_boolean(spark, d):
    return E.entail_boolean(_closure(spark, d), _queries(spark, d))


def e3_entail_set(spark, d):
    found = E.entail_set(_closure(spark, d), C.typed_domains(_facts(spark, d), _schema(spark, d)), "open", "Order")
    return found.select("case_id", *(F.array_join(c, ",").alias(c) for c in ("entailed", "contradicted", "unknown")))


def e4_wildcard_query(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), F.col("c_custkey").alias("case_id"), F.lit("urgent").alias("symbol"), F.array(F.lit("?")).alias("args"))
    return E.wildcard_query(_closure(spark, d), q)


def e6_consistency(spark, d):
    return E.consistency(_closure(spark, d))


def e7_explain_conflict(spark, d):
    return E.explain_conflict(_closure(spark, d))


def e8_value_range(spark, d):
    orders = C.typed_domains(_facts(spark, d), _schema(spark, d)).filter("type in ('Order', 'Customer')")
    return E.value_range(_facts(spark, d), "total_price", orders).withColumn("values", F.array_join("values", ","))


def e9_optimum(spark, d):
    return E.optimum(_facts(spark, d), "total_price")


def e12_possible_outputs(spark, d):
    g = C.typed_domains(_facts(spark, d), _schema(spark, d)).filter("type = 'Order'").select("case_id", F.lit("open").alias("symbol"), F.array("entity").alias("args"))
    return E.possible_outputs(g, _closure(spark, d))


def _one_set(df):
    return df.withColumn("set_id", F.lit(1))


def _coverage(spark, d):
    rules = table(spark, d, "fx_rules")
    return settle(K.antecedent_coverage(_one_set(_queries(spark, d)), D.rule_atoms(rules), _one_set(_facts(spark, d)), _schema(spark, d), K.quantified(rules)))


def e13_antecedent_coverage(spark, d):
    return _coverage(spark, d).select("q_id", "rule", "path", "symbol", "atom", "status", "satisfied")


def e14_downgrade_alternatives(spark, d):
    return K.downgrade_alternatives(_coverage(spark, d), e2_entail_boolean(spark, d)).select("q_id", "rule", "path", "symbol", "status")


def e15_missing_observables(spark, d):
    return K.missing_observables(_coverage(spark, d)).select("q_id", "missing")


def _docket(spark, d):
    """Facts of each case under each of its rule sets."""
    return _facts(spark, d).join(table(spark, d, "fx_docket"), "case_id")


def _ruled(spark, d):
    return E.derive(_docket(spark, d), table(spark, d, "fx_rulebook"), {"placed_by", "urgent", "key_customer"})


def _set_queries(spark, d):
    """Key and ordinary customers are asked for in set 1; prime ones, and whether their least order by name is served, in set 2."""
    x = table(spark, d, "fx_docket").withColumn("c", F.concat(F.lit("c"), F.col("case_id")))
    least = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.min(F.concat(F.lit("o"), F.col("o_orderkey"))).alias("o"))
    q = lambda t, name, n, *args: t.filter(F.col("set_id") == n).select(F.concat(F.lit(name[0]), F.col("case_id")).alias("q_id"), "set_id", "case_id", F.lit(name).alias("symbol"), F.array(*args).alias("args"))
    return q(x, "key_customer", 1, "c").unionByName(q(x, "ordinary", 1, "c")).unionByName(q(x, "prime_customer", 2, "c")).unionByName(q(x.join(least, "case_id"), "served", 2, "o", "c"))


def e1_rule_sets(spark, d):
    return _joined(E.atoms_of(_ruled(spark, d)[1]).filter("round > 0")).select("set_id", "case_id", "symbol", "args", "polarity", "rule")


def e2_under_assumption(spark, d):
    program, closure = _ruled(spark, d)
    return E.entail_assumed(program, closure, _set_queries(spark, d).filter("symbol in ('key_customer', 'prime_customer')"))


def e7_conflict_support(spark, d):
    return E.conflict_support(_ruled(spark, d)[1]).select("set_id", "case_id", "conflict", "source", "atom")


def e11_answer_support(spark, d):
    return E.answer_support(_ruled(spark, d)[1], _set_queries(spark, d).filter("symbol = 'key_customer'")).select("q_id", "source", "atom")


def _terms(spark, d):
    return table(spark, d, "fx_terms").withColumn("args", F.split("args_csv", ",")).drop("args_csv")


def _set_coverage(spark, d):
    rules = table(spark, d, "fx_rulebook")
    return settle(K.antecedent_coverage(_set_queries(spark, d), D.rule_atoms(rules), _docket(spark, d), _terms(spark, d), K.quantified(rules)))


def e13_bound_coverage(spark, d):
    return _set_coverage(spark, d).select("q_id", "set_id", "rule", "path", "symbol", "atom", "status", "satisfied")


def e14_rule_sets(spark, d):
    results = _set_queries(spark, d).select("q_id", F.when(F.col("case_id") % 2 == 0, "entailed").otherwise("unknown").alias("label"), (F.col("case_id") % 7 == 0).alias("certain"))
    return K.downgrade_alternatives(_set_coverage(spark, d), results).select("q_id", "set_id", "rule", "path", "atom", "status")


def e15_described(spark, d):
    return K.missing_observables(_set_coverage(spark, d), _terms(spark, d))


def e18_credence(spark, d):
    from casemill.operators.score import credence

    return credence(table(spark, d, "fx_answers"), 0.7).select("q_id", "label", "p_yes", "verdict_strength_pct", "credence_yes_pct", "symbolic_inconclusive")


def _criteria(spark, d):
    return E.criteria_count(table(spark, d, "fx_years"), {"turnover": 200000.0, "n_orders": 2, "largest": 150000.0})


def e19_criteria_count(spark, d):
    return _criteria(spark, d).select("entity", "period", "n_exceeded", "class_holds")


def e20_consecutive_effect(spark, d):
    return E.consecutive_effect(_criteria(spark, d).select("entity", "period", (~F.col("class_holds")).alias("exceeded")))


def e21_answer_text(spark, d):
    return E.answer_text(e2_entail_boolean(spark, d))


def c13_suggest_replacements(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("set_id"), F.regexp_replace("p_name", " ", "_").alias("name"), "p_partkey")
    return C.suggest_replacements(p.filter("p_partkey % 3 = 0"), p.filter("p_partkey % 3 <> 0"), 4).drop("case_id", "reasons")


def c13_case_replacements(spark, d):
    """The names of each set, some rejected with a code and the set's own case; roles and descriptions of the others."""
    k = F.col("k")
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % 20).alias("set_id"), F.regexp_replace("p_name", " ", "_").alias("name")).agg(F.min("p_partkey").alias("k"), F.lower(F.min_by("p_type", "p_partkey")).alias("description"))
    cases = p.groupBy(F.col("set_id").alias("case_id")).agg(F.concat(F.lit("A "), F.regexp_replace(F.min("name"), "_", " "), F.lit(" costs 50.000")).alias("text"))
    rejected = p.filter(k % 3 == 0).select("set_id", F.when(k % 5 != 0, F.col("set_id")).alias("case_id"), "name", "description", F.when(k % 2 == 0, "computed_composite").otherwise("legal_output").alias("code"))
    role = F.when(k % 3 == 1, "function").when(k % 5 == 0, "threshold").otherwise("predicate")
    symbols = p.filter(k % 3 != 0).select("set_id", "name", "description", role.alias("role"), (k % 4 == 0).alias("directly_observable"))
    return C.suggest_replacements(rejected, symbols, cases=cases)


def c19_bind_period(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 5 == 0, "Which year applies?").otherwise(F.concat(F.lit("What applies in the year following "), F.col("c_custkey") % 7 + 1992, F.lit("?"))).alias("q_text"))
    return E.bind_period(q, table(spark, d, "fx_years"))


def d14_coerce_literals(spark, d):
    return D.coerce_literals(D.rule_compares(_rules(spark, d)), _symbols(spark, d))


def e5_propagate(spark, d):
    g = C.typed_domains(_facts(spark, d), _schema(spark, d)).filter("type = 'Order'").select("case_id", F.explode(F.array(F.lit("open"), F.lit("big_order"))).alias("symbol"), F.array("entity").alias("args"))
    return E.propagate(_closure(spark, d), g)


def e10_relevance(spark, d):
    edges = D.dependency_edges(D.rule_atoms(table(spark, d, "fx_rules"))).select(F.col("defined").alias("src"), F.col("used").alias("dst"))
    targets = table(spark, d, "fx_symbols").filter("kind = 'derived'").select(F.col("name").alias("target"))
    return E.relevance(D.closure(edges, targets), _facts(spark, d))


def e11_explain(spark, d):
    return E.explain(_closure(spark, d), _queries(spark, d))


def e22_unify_results(spark, d):
    answers = e2_entail_boolean(spark, d).withColumn("error", F.when(F.col("case_id") % 11 == 0, "timeout"))
    routing = answers.select("q_id", "case_id", F.lit("deduction").alias("intent"), (F.col("case_id") % 7 != 0).alias("supported"))
    return E.unify_results(routing, E.consistency(_closure(spark, d)), answers)


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "cde" and k[1:2].isdigit()}

_F = """SELECT DISTINCT o_custkey AS case_id, * FROM (
 SELECT o_custkey, 'placed_by' AS symbol, concat('o', o_orderkey, ',c', o_custkey) AS args, true AS polarity, NULL AS value FROM orders
 UNION ALL SELECT o_custkey, 'urgent', concat('o', o_orderkey), true, NULL FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT o_custkey, 'open', concat('o', o_orderkey), false, NULL FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_custkey, 'open', concat('o', o_orderkey), true, NULL FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 97 = 0
 UNION ALL SELECT o_custkey, 'total_price', concat('o', o_orderkey), NULL, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders)"""
_F = f"SELECT case_id, symbol, args, polarity, value FROM ({_F})"
_DOM = """SELECT DISTINCT o_custkey AS case_id, 'Order' AS type, concat('o', o_orderkey) AS entity FROM orders UNION SELECT o_custkey, 'Customer', concat('c', o_custkey) FROM orders"""
_BIG = "floor(o_totalprice) > 250000"
_PRI = f"SELECT DISTINCT o_custkey FROM orders WHERE {_BIG} AND o_orderpriority = '1-URGENT'"
_DIS = f"SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN ({_PRI})"
_BAD = "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 97 = 0 AND o_orderstatus = 'F'"
_E2 = f"""SELECT q_id, case_id, symbol, CASE WHEN case_id IN ({_BAD}) THEN 'inconsistent' WHEN yes THEN 'entailed' ELSE 'unknown' END AS label FROM (
 SELECT concat('p', c_custkey) AS q_id, c_custkey AS case_id, 'is_priority_customer' AS symbol, c_custkey IN ({_PRI}) AS yes FROM customer
 UNION ALL SELECT concat('d', c_custkey), c_custkey, 'right_to_discount', c_custkey IN ({_DIS}) FROM customer)"""
_LAB = "CASE WHEN status <> 'ok' THEN 'unknown' WHEN certain THEN 'entailed' WHEN NOT possible THEN 'contradicted' ELSE 'unknown' END"
_SETS = "(SELECT p_partkey AS set_id FROM part)"
_ATOMS = f"""SELECT set_id, a.* FROM {_SETS}, (VALUES (0, 'then', '0', 'big_order', 'o', false), (1, 'if', '0.0', 'placed_by', 'o,c', false), (1, 'if', '0.1', 'big_order', 'o', false), (1, 'if', '0.2', 'urgent', 'o', false), (1, 'then', '0', 'is_priority_customer', 'c', false),
 (2, 'if', '0.0', 'placed_by', 'o,c', false), (2, 'if', '0.1', 'is_priority_customer', 'c', false), (2, 'if', '0.2', 'open', 'o', true), (2, 'then', '0', 'right_to_discount', 'c', false)) a(rule, side, path, symbol, args, negated)"""
_ARITY = f"SELECT set_id, 1 AS rule, '0.2' AS path, 'urgent' AS symbol, 'undeclared' AS code FROM {_SETS} WHERE set_id % 3 = 0"
_YEARS = "SELECT entity, period, CAST(turnover > 200000 AS INT) + CAST(n_orders > 2 AS INT) + CAST(largest > 150000 AS INT) AS n_exceeded FROM fx_years"
_FIRST = "SELECT o_custkey AS c, min(concat('o', o_orderkey)) AS o1, arg_min(o_orderpriority = '1-URGENT', concat('o', o_orderkey)) AS u1, arg_min(o_orderstatus = 'F', concat('o', o_orderkey)) AS f1 FROM orders GROUP BY o_custkey"
_ATOM = "CASE WHEN args = '?' OR o1 IS NULL AND args LIKE '%O%' THEN symbol ELSE concat(symbol, '(', replace(replace(args, 'O', coalesce(o1, '')), 'C', concat('c', c_custkey)), ')') END"
_COV = f"""SELECT concat(k, c_custkey) AS q_id, c_custkey, o1, rule, path, symbol, {_ATOM} AS atom, CASE WHEN symbol = 'is_priority_customer' OR o1 IS NULL THEN 'unknown' WHEN symbol = 'big_order' THEN 'helper_defined' WHEN symbol = 'urgent' AND NOT u1 THEN 'missing' ELSE 'present' END AS status,
 CASE WHEN o1 IS NULL OR symbol IN ('is_priority_customer', 'big_order') THEN false WHEN symbol = 'urgent' THEN u1 WHEN symbol = 'open' THEN f1 ELSE true END AS satisfied
 FROM customer LEFT JOIN ({_FIRST}) f ON c = c_custkey, (VALUES ('p', 1, '0.0', 'placed_by', 'O,C'), ('p', 1, '0.1', 'big_order', 'O'), ('p', 1, '0.2', 'urgent', 'O'), ('d', 2, '0.0', 'placed_by', 'O,C'), ('d', 2, '0.1', 'is_priority_customer', 'C'), ('d', 2, '0.2', 'open', 'O')) x(k, rule, path, symbol, args)"""
_RULED = """o AS (SELECT set_id AS s, o_custkey AS c, concat('o', o_orderkey) AS o, concat('c', o_custkey) AS k, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderpriority = '1-URGENT' AS u, o_orderstatus = 'F' AS f, o_orderstatus <> 'F' OR o_orderkey % 97 = 0 AS op FROM orders JOIN fx_docket ON o_custkey = case_id),
 notable AS (SELECT * FROM o WHERE u OR (s = 1 AND v > 250000)),
 ordinary AS (SELECT DISTINCT c, k FROM o WHERE s = 1 AND c NOT IN (SELECT c FROM notable WHERE s = 1)),
 torn AS (SELECT * FROM ordinary WHERE c IN (SELECT c FROM o WHERE v > 200000)),
 prime AS (SELECT DISTINCT c, k FROM notable WHERE s = 2),
 refused AS (SELECT DISTINCT c, k FROM o WHERE s = 2 AND v > 300000)"""
_SETCOV = f"""SELECT concat(q, c_custkey) AS q_id, set_id, c_custkey, rule, path, symbol, {_ATOM} AS atom, CASE WHEN symbol = 'notable' OR symbol NOT IN ('placed_by', 'urgent') OR o1 IS NULL THEN 'unknown' WHEN symbol = 'urgent' AND NOT u1 THEN 'missing' ELSE 'present' END AS status,
 symbol = 'placed_by' AND o1 IS NOT NULL OR symbol = 'urgent' AND coalesce(u1, false) AS satisfied
 FROM fx_docket JOIN customer ON case_id = c_custkey LEFT JOIN ({_FIRST}) f ON c = c_custkey JOIN (VALUES ('k', 1, 2, '0', 'notable', 'O,C'), ('k', 1, 2, '1', 'placed_by', 'O,C'), ('o', 1, 3, '0', 'placed_by', 'O,C'), ('o', 1, 3, '1.0', 'key_customer', 'C'), ('o', 1, 4, '0', 'ordinary', 'C'), ('o', 1, 4, '1', 'placed_by', 'O,C'),
  ('p', 2, 2, '0', 'notable', '?'), ('p', 2, 3, '1', 'placed_by', 'O,C'), ('s', 2, 4, '0', 'prime_customer', 'C'), ('s', 2, 4, '1', 'placed_by', 'O,C'), ('s', 2, 6, '0', 'urgent', 'O'), ('s', 2, 6, '1', 'placed_by', 'O,C')) x(q, s, rule, path, symbol, args) ON s = set_id WHERE (q <> 's' OR o1 IS NOT NULL)"""

SQL = {
    "c1_parse_facts": f"""SELECT o_custkey AS case_id, concat('placed_by(o', o_orderkey, ',c', o_custkey, ').') AS line, 'atom' AS form, 'placed_by' AS symbol, concat('o', o_orderkey, ',c', o_custkey) AS args, true AS polarity, NULL AS value, NULL AS reason FROM orders
 UNION ALL SELECT o_custkey, concat('urgent(o', o_orderkey, ').'), 'atom', 'urgent', concat('o', o_orderkey), true, NULL, NULL FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT o_custkey, concat('not open(o', o_orderkey, ').'), 'denial', 'open', concat('o', o_orderkey), false, NULL, NULL FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_custkey, concat('open(o', o_orderkey, ') is true.'), 'bool_is', 'open', concat('o', o_orderkey), true, NULL, NULL FROM orders WHERE o_orderstatus <> 'F'
 UNION ALL SELECT o_custkey, concat('open(o', o_orderkey, ').'), 'atom', 'open', concat('o', o_orderkey), true, NULL, NULL FROM orders WHERE o_orderkey % 97 = 0
 UNION ALL SELECT o_custkey, concat('total_price(o', o_orderkey, ') = ', CAST(floor(o_totalprice) AS BIGINT), '.'), 'value', 'total_price', concat('o', o_orderkey), NULL, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), NULL FROM orders
 UNION ALL SELECT o_custkey, concat('bad*(o', o_orderkey, ')'), NULL, NULL, NULL, NULL, NULL, 'no_final_dot' FROM orders WHERE o_orderkey % 101 = 0""",
    "c2_render_facts": f"SELECT case_id, concat(CASE WHEN value IS NOT NULL THEN concat(symbol, '(', args, ') = ', value) WHEN polarity THEN concat(symbol, '(', args, ')') ELSE concat('not ', symbol, '(', args, ')') END, '.') AS line FROM ({_F})",
    "c3_canonical_symbols": f"SELECT CASE WHEN case_id % 2 = 0 THEN symbol ELSE concat(symbol, '_x') END AS symbol, case_id % 2 = 0 AS known, count(*) AS n FROM ({_F}) GROUP BY 1, 2",
    "c4_contradictions": "SELECT o_custkey AS case_id, 'open' AS symbol, concat('o', o_orderkey) AS args FROM orders WHERE o_orderkey % 97 = 0 AND o_orderstatus = 'F'",
    "c5_exclusive_classes": "SELECT o_custkey AS case_id, concat('o', o_orderkey) AS entity, 'open,urgent' AS classes, 2 AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderstatus <> 'F' OR o_orderkey % 97 = 0)",
    "c6_net_extension": f"SELECT case_id, symbol, count(*) FILTER (held) AS n_tuples, count(*) FILTER (NOT held) AS n_denied, coalesce(string_agg(args, ';' ORDER BY string_split(args, ',')) FILTER (held), '') AS tuples FROM (SELECT case_id, symbol, args, bool_and(polarity) AS held FROM ({_F}) WHERE polarity IS NOT NULL GROUP BY case_id, symbol, args) GROUP BY case_id, symbol",
    "c7_close_world": "SELECT DISTINCT o_custkey AS case_id, 'urgent' AS symbol FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "c8_typed_domains": f"{_DOM} UNION SELECT c_custkey, 'Customer', concat('c', c_custkey) FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 10 <> 0",
    "c9_resolve_entity_types": f"""WITH e AS (SELECT case_id, type, entity, 'fact_argument' AS source FROM ({_DOM}) UNION SELECT o_custkey, 'Order', concat('c', o_custkey), 'fact_argument' FROM orders WHERE o_orderkey % 10 = 0
  UNION SELECT c_custkey, 'Customer', concat('c', c_custkey), 'query_argument' FROM customer),
 g AS (SELECT case_id, entity, list_sort(list_distinct(list(type))) AS t, array_to_string(list_sort(list_distinct(list(source))), '+') AS s FROM e GROUP BY case_id, entity),
 dc AS (SELECT c_custkey AS case_id, concat(CASE WHEN c_custkey % 7 < 2 THEN 'c' WHEN c_custkey % 7 = 2 THEN 'x' ELSE 'y' END, c_custkey) AS entity, CASE c_custkey % 7 WHEN 0 THEN 'Order' WHEN 2 THEN 'Customer' ELSE 'Court' END AS declared FROM customer WHERE c_custkey % 7 < 4),
 j AS (SELECT case_id, entity, coalesce(t, []) AS t, s, declared, coalesce(declared <> 'Court', false) AS known FROM g FULL JOIN dc USING (case_id, entity)),
 k AS (SELECT *, len(t) > 1 OR (len(t) = 1 AND known AND declared <> t[1]) AS clash FROM j)
 SELECT case_id, entity, array_to_string(t, ',') AS types, declared, CASE WHEN clash THEN NULL WHEN len(t) = 1 THEN t[1] WHEN known THEN declared END AS resolved,
  CASE WHEN clash THEN NULL WHEN len(t) = 1 THEN s WHEN known THEN 'declared' END AS source, CASE WHEN clash THEN 'conflict' WHEN len(t) = 1 OR known THEN 'resolved' ELSE 'unmapped' END AS status FROM k""",
    "c10_validate_signatures": """SELECT o_custkey AS case_id, CASE o_orderkey % 4 WHEN 0 THEN 'urgnt' WHEN 1 THEN 'total_price' ELSE 'urgent' END AS symbol, CASE o_orderkey % 4 WHEN 0 THEN 'unknown_symbol' WHEN 1 THEN 'truth_for_function' WHEN 2 THEN 'wrong_arity' ELSE 'value_for_predicate' END AS code,
 CASE WHEN o_orderkey % 4 = 2 THEN 'a,b' ELSE concat('o', o_orderkey) END AS args, -1 AS pos, CASE WHEN o_orderkey % 4 = 2 THEN '1' END AS expected, CASE WHEN o_orderkey % 4 = 2 THEN '2' END AS found FROM orders""",
    "c10_argument_types": """SELECT o_custkey AS case_id, 'placed_by' AS symbol, 'wrong_argument_type' AS code, concat('c', o_custkey, ',o', o_orderkey) AS args, pos, CASE pos WHEN 0 THEN 'Order' ELSE 'Customer' END AS expected, CASE pos WHEN 0 THEN 'Customer' ELSE 'Order' END AS found FROM orders, (VALUES (0), (1)) t(pos) WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_custkey, 'is_priority_customer', 'not_assertable', concat('c', o_custkey), -1, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0
 UNION ALL SELECT o_custkey, 'total_price', 'wrong_argument_type', concat('z', o_orderkey), 0, 'Order', NULL FROM orders WHERE o_orderkey % 7 = 0""",
    "c11_validate_queries": """SELECT q_id, code, CASE WHEN code IN ('unknown_symbol', 'wrong_arity') THEN -1 ELSE 0 END AS pos FROM (SELECT concat(k, c_custkey) AS q_id, CASE WHEN c_custkey % 13 = 0 THEN 'unknown_symbol' WHEN c_custkey % 17 = 0 THEN 'wrong_arity'
 WHEN c_custkey % 11 = 0 OR c_custkey % 19 = 0 OR c_custkey % 23 = 0 THEN 'placeholder' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'not_in_domain' END AS code FROM customer, (VALUES ('p'), ('d')) t(k)) WHERE code IS NOT NULL""",
    "c16_ground_atoms": """WITH o AS (SELECT o_custkey AS c, concat('o', o_orderkey) AS x FROM orders), t AS (SELECT c, 'urgent' AS symbol, x AS args, x AS a, '' AS b FROM o UNION ALL SELECT c, 'placed_by', concat(x, ',c', c), x, '' FROM o
 UNION ALL SELECT o.c, 'moved', concat(o.x, ',c', o.c, ',', p.x), o.x, p.x FROM o JOIN o p ON o.c = p.c), r AS (SELECT *, count(*) OVER (PARTITION BY c, symbol) AS n, row_number() OVER (PARTITION BY c, symbol ORDER BY a, b) AS r FROM t)
 SELECT c AS case_id, symbol, args, n > 200 AS cut FROM r WHERE r <= 200""",
    "c17_named_questions": """SELECT c_custkey AS q_id, c_custkey AS case_id, CASE WHEN c_custkey % 7 = 0 THEN 'o1' WHEN c_custkey % 5 > 2 THEN e END AS arg, c_custkey % 7 <> 0 AS was_empty FROM customer LEFT JOIN (SELECT o_custkey, min(concat('o', o_orderkey)) AS e FROM orders GROUP BY o_custkey HAVING count(*) = 1) o ON c_custkey = o_custkey""",
    "c17_fill_singletons": """SELECT c_custkey AS q_id, c_custkey AS case_id, e AS arg, true AS was_empty FROM customer LEFT JOIN (SELECT o_custkey, min(concat('o', o_orderkey)) AS e FROM orders GROUP BY o_custkey HAVING count(*) = 1) o ON c_custkey = o_custkey""",
    "c20_self_relations": "SELECT o_custkey AS case_id, CASE o_orderkey % 6 WHEN 0 THEN 'affiliated_with' WHEN 2 THEN 'owns' WHEN 3 THEN 'knows' ELSE 'linked_same' END AS symbol, CAST(o_custkey % 7 AS VARCHAR) AS entity FROM orders WHERE o_orderkey % 7 = o_custkey % 7 AND o_orderkey % 6 IN (0, 2, 3, 4)",
    "c21_signature_conflicts": "SELECT p_partkey % 50 AS set_id, string_split(p_name, ' ')[1] AS name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) > 1",
    "c22_undeclared_symbols": """WITH u AS (SELECT DISTINCT p_partkey % 50 AS set_id, string_split(p_name, ' ')[1] AS symbol FROM part), s AS (SELECT DISTINCT p_partkey % 50 AS set_id, string_split(p_name, ' ')[1] AS symbol FROM part WHERE p_partkey % 3 = 0),
 m AS (SELECT * FROM u EXCEPT SELECT * FROM s) SELECT set_id, symbol, n_undeclared FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS n_undeclared, row_number() OVER (PARTITION BY set_id ORDER BY symbol) AS r FROM m) WHERE r <= 3""",
    "d1_rule_atoms": _ATOMS,
    "d2_rule_compares": f"SELECT set_id, 0 AS rule, 'if' AS side, '0' AS path, 'total_price' AS func, '>' AS op, 250000.0 AS literal FROM {_SETS}",
    "d3_derivation_closure": """WITH RECURSIVE c AS (SELECT p_partkey AS target, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT target, node // 2, depth + 1 FROM c WHERE node // 2 > 0) SELECT * FROM c""",
    "d4_floating_helpers": f"SELECT set_id, 'big_order' AS symbol, 1 AS n_rules FROM {_SETS} WHERE set_id % 5 = 0",
    "d5_undefined_derived": f"SELECT set_id, 'is_priority_customer' AS symbol, 1 AS n_rules FROM {_SETS} WHERE set_id % 7 = 0",
    "d6_definition_cycles": "SELECT concat(p_partkey // 10, '-', p_partkey % 10) AS target FROM part WHERE p_partkey // 10 % 2 = 0 AND p_partkey // 10 IN (SELECT p_partkey // 10 FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 10)",
    "d9_threshold_provenance": f"SELECT set_id, 0 AS rule, 250000.0 AS literal FROM {_SETS} WHERE set_id % 4 IN (2, 3)",
    "d13_rule_arity": _ARITY,
    "d13_rule_types": f"""WITH leaf AS (SELECT * FROM (VALUES (0, 'if', '0', 'total_price', ['o']), (0, 'then', '0', 'big_order', ['o']), (1, 'if', '0.0', 'placed_by', ['o', 'c']), (1, 'if', '0.1', 'big_order', ['o']), (1, 'if', '0.2', 'urgent', ['o']),
 (1, 'then', '0', 'is_priority_customer', ['c']), (2, 'if', '0.0', 'placed_by', ['o', 'c']), (2, 'if', '0.1', 'is_priority_customer', ['c']), (2, 'if', '0.2', 'open', ['o']), (2, 'then', '0', 'right_to_discount', ['c'])) t(rule, side, path, own, args)),
 own AS (SELECT set_id, rule, side, path, CASE WHEN own = 'total_price' AND set_id % 7 = 0 THEN 'open' ELSE own END AS symbol, args FROM {_SETS}, leaf),
 arg AS (SELECT set_id, rule, side, path, symbol, unnest(range(len(args))) AS arg, unnest(args) AS name FROM own)
 SELECT set_id, rule, side, path, symbol, CAST(-1 AS INT) AS arg, CASE WHEN symbol = 'urgent' THEN 'undeclared' ELSE 'predicate_as_function' END AS code FROM own WHERE (symbol = 'urgent' AND set_id % 3 = 0) OR (symbol = 'open' AND rule = 0)
 UNION ALL SELECT set_id, rule, side, path, symbol, CAST(arg AS INT), 'sort' FROM arg WHERE name = 'o' AND set_id % 5 = 0 AND NOT (symbol = 'urgent' AND set_id % 3 = 0)
 UNION ALL SELECT set_id, rule, side, path, symbol, CAST(arg AS INT), 'unbound' FROM arg WHERE name = 'c' AND rule = 1 AND set_id % 11 = 0""",
    "d19_quarantine_rules": f"""SELECT s.set_id, r.rule, CASE WHEN r.rule = 1 AND s.set_id % 3 = 0 THEN 'undeclared' END AS code, CASE WHEN r.rule = 1 AND s.set_id % 3 = 0 THEN 'quarantined' ELSE 'valid' END AS status FROM {_SETS} s, (VALUES (0), (1), (2)) r(rule)""",
    "e1_apply_rules": f"""SELECT o_custkey AS case_id, 'big_order' AS symbol, concat('o', o_orderkey) AS args, true AS polarity, 0 AS rule FROM orders WHERE {_BIG}
 UNION ALL SELECT o_custkey, 'is_priority_customer', concat('c', o_custkey), true, 1 FROM ({_PRI}) UNION ALL SELECT o_custkey, 'right_to_discount', concat('c', o_custkey), true, 2 FROM ({_DIS})""",
    "e2_entail_boolean": f"SELECT q_id, case_id, symbol, true AS possible, label = 'entailed' AS certain, label FROM ({_E2})",
    "e3_entail_set": """WITH o AS (SELECT o_custkey, concat('o', o_orderkey) AS e, o_orderstatus <> 'F' OR o_orderkey % 97 = 0 AS yes FROM orders) SELECT o_custkey AS case_id, coalesce(string_agg(e, ',' ORDER BY e) FILTER (yes), '') AS entailed, coalesce(string_agg(e, ',' ORDER BY e) FILTER (NOT yes), '') AS contradicted, '' AS unknown FROM o GROUP BY o_custkey""",
    "e4_wildcard_query": "SELECT c_custkey AS q_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS holds FROM customer",
    "e6_consistency": "SELECT o_custkey AS case_id, count(*) FILTER (o_orderkey % 97 = 0 AND o_orderstatus = 'F') AS n_conflicts, CASE WHEN count(*) FILTER (o_orderkey % 97 = 0 AND o_orderstatus = 'F') > 0 THEN 'unsat' ELSE 'ok' END AS status FROM orders GROUP BY o_custkey",
    "e7_explain_conflict": "SELECT o_custkey AS case_id, 'open' AS symbol, concat('o', o_orderkey) AS args, p AS polarity, 'fact' AS source FROM orders, (VALUES (true), (false)) t(p) WHERE o_orderkey % 97 = 0 AND o_orderstatus = 'F'",
    "e8_value_range": """SELECT o_custkey AS case_id, concat('o', o_orderkey) AS entity, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS values, floor(o_totalprice) AS low, floor(o_totalprice) AS high, 'known' AS status FROM orders UNION ALL SELECT DISTINCT o_custkey, concat('c', o_custkey), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'unknown' FROM orders""",
    "e9_optimum": """WITH v AS (SELECT o_custkey AS case_id, concat('o', o_orderkey) AS e, floor(o_totalprice) AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY v, e) AS lo, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, e) AS hi FROM v)
 SELECT case_id, max(e) FILTER (lo = 1) AS min_entity, max(v) FILTER (lo = 1) AS min_value, max(e) FILTER (hi = 1) AS max_entity, max(v) FILTER (hi = 1) AS max_value FROM r GROUP BY case_id""",
    "e12_possible_outputs": "SELECT case_id, 'open' AS symbol, args, rank FROM (SELECT o_custkey AS case_id, concat('o', o_orderkey) AS args, row_number() OVER (PARTITION BY o_custkey ORDER BY concat('o', o_orderkey)) AS rank FROM orders WHERE o_orderstatus <> 'F') WHERE rank <= 3",
    "e13_antecedent_coverage": f"SELECT q_id, rule, path, symbol, atom, status, satisfied FROM ({_COV})",
    "e14_downgrade_alternatives": f"SELECT q_id, rule, path, symbol, status FROM ({_COV})",
    "e15_missing_observables": f"SELECT q_id, string_agg(symbol, ',' ORDER BY path) AS missing FROM ({_COV}) WHERE status = 'missing' GROUP BY q_id",
    "e18_credence": f"""SELECT q_id, label, CASE label WHEN 'entailed' THEN 1.0 WHEN 'contradicted' THEN 0.0 ELSE 0.7 END AS p_yes, CASE WHEN status <> 'ok' THEN 0 WHEN label = 'unknown' THEN 40 ELSE 100 END AS verdict_strength_pct, CASE label WHEN 'entailed' THEN 100 WHEN 'contradicted' THEN 0 ELSE 70 END AS credence_yes_pct, label = 'unknown' AS symbolic_inconclusive FROM (SELECT *, {_LAB} AS label FROM fx_answers)""",
    "e19_criteria_count": f"SELECT entity, period, n_exceeded, n_exceeded <= 1 AS class_holds FROM ({_YEARS})",
    "e20_consecutive_effect": f"""WITH y AS (SELECT entity, period FROM ({_YEARS}) WHERE n_exceeded > 1) SELECT b.entity, b.period + 1 AS effect_period FROM y a JOIN y b ON a.entity = b.entity AND b.period = a.period + 1""",
    "c13_case_replacements": """WITH g AS (SELECT p_partkey % 20 AS set_id, replace(p_name, ' ', '_') AS name, min(p_partkey) AS k, lower(arg_min(p_type, p_partkey)) AS d FROM part GROUP BY 1, 2),
 t AS (SELECT *, list_distinct(string_split(lower(name), '_') || [d]) AS t FROM g), w AS (SELECT set_id, string_split(lower(min(name)), '_') AS w FROM g GROUP BY set_id),
 cs AS (SELECT set_id, list_distinct(['a', 'costs', '50.000', 'cost', '000'] || w || list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: CASE WHEN suffix(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END)) AS c FROM w),
 r AS (SELECT t.set_id, CASE WHEN k % 5 <> 0 THEN t.set_id END AS case_id, name AS rejected, t, k % 2 = 0 AS comp, CASE WHEN k % 5 <> 0 THEN c END AS c FROM t JOIN cs ON t.set_id = cs.set_id WHERE k % 3 = 0),
 s AS (SELECT set_id, name AS suggested, t AS u, k % 3 = 1 AS func, k % 3 = 2 AND k % 5 = 0 AS thr, k % 4 = 0 OR (k % 3 = 2 AND k % 5 = 0) AS seen FROM t WHERE k % 3 <> 0),
 j AS (SELECT r.set_id, case_id, rejected, suggested, comp, func, seen, thr, len(list_intersect(t, u)) AS a, coalesce(len(list_intersect(c, u)), 0) AS b, len(t) AS nt, coalesce(len(c), 0) AS nc, len(u) AS nu FROM r JOIN s ON r.set_id = s.set_id),
 x AS (SELECT *, round(2.5 * a / (nt + nu - a) + 1.8 * b / (nc + nu - b) + CASE WHEN comp AND func THEN CAST(0.45 AS DOUBLE) ELSE 0 END + CASE WHEN comp AND seen THEN CAST(0.25 AS DOUBLE) ELSE 0 END + CASE WHEN thr THEN CASE WHEN comp THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END ELSE 0 END, 6) AS score FROM j)
 SELECT set_id, case_id, rejected, rank, suggested, score, concat_ws(',', CASE WHEN a > 0 THEN 'name' END, CASE WHEN b > 0 THEN 'case_text' END, CASE WHEN comp AND func THEN 'numeric_function' END, CASE WHEN seen AND (comp OR thr) THEN 'observable' END) AS reasons
 FROM (SELECT *, row_number() OVER (PARTITION BY set_id, rejected ORDER BY score DESC, suggested) AS rank FROM x WHERE score >= 0.04) WHERE rank <= 12""",
    "c13_suggest_replacements": """WITH p AS (SELECT DISTINCT p_partkey % 20 AS set_id, p_partkey % 3 = 0 AS bad, replace(p_name, ' ', '_') AS name, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part),
 j AS (SELECT a.set_id, a.name AS rejected, b.name AS suggested, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS m FROM p a JOIN p b ON a.set_id = b.set_id AND a.bad AND NOT b.bad AND a.name <> b.name),
 s AS (SELECT *, round(2.5 * n / (m - n), 6) AS score FROM j WHERE n > 0)
 SELECT set_id, rejected, rank, suggested, score FROM (SELECT *, row_number() OVER (PARTITION BY set_id, rejected ORDER BY score DESC, suggested) AS rank FROM s WHERE score >= 0.04) WHERE rank <= 4""",
    "c19_bind_period": """WITH q AS (SELECT c_custkey AS q_id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 7 + 1992 AS INT) END AS anchor FROM customer)
 SELECT q_id, anchor, CASE WHEN y.entity IS NOT NULL THEN anchor + 1 ELSE anchor END AS period, CASE WHEN anchor IS NULL THEN 'no_anchor' WHEN y.entity IS NULL THEN 'no_successor' END AS warning FROM q LEFT JOIN fx_years y ON y.entity = q_id AND y.period = anchor + 1""",
    "d14_coerce_literals": f"SELECT set_id, 0 AS rule, 'total_price' AS func, '250000' AS coerced, false AS lossy FROM {_SETS}",
    "e5_propagate": f"""SELECT o_custkey AS case_id, 'open' AS symbol, concat('o', o_orderkey) AS args, CASE WHEN o_orderstatus <> 'F' THEN 'true' WHEN o_orderkey % 97 = 0 THEN 'inconsistent' ELSE 'false' END AS label FROM orders
 UNION ALL SELECT o_custkey, 'big_order', concat('o', o_orderkey), 'true' FROM orders WHERE {_BIG}""",
    "e10_relevance": f"""WITH r AS (SELECT * FROM (VALUES ('is_priority_customer', 'is_priority_customer'), ('is_priority_customer', 'placed_by'), ('is_priority_customer', 'big_order'), ('is_priority_customer', 'urgent'),
 ('right_to_discount', 'right_to_discount'), ('right_to_discount', 'placed_by'), ('right_to_discount', 'is_priority_customer'), ('right_to_discount', 'open'), ('right_to_discount', 'big_order'), ('right_to_discount', 'urgent')) t(target, symbol)),
 n AS (SELECT symbol, count(*) AS n_facts, count(DISTINCT case_id) AS n_cases FROM ({_F}) GROUP BY symbol) SELECT target, r.symbol, coalesce(n_facts, 0) AS n_facts, coalesce(n_cases, 0) AS n_cases FROM r LEFT JOIN n ON r.symbol = n.symbol""",
    "e11_explain": f"""SELECT q_id, CASE WHEN label THEN CASE WHEN symbol = 'is_priority_customer' THEN 'rule 1' ELSE 'rule 2' END ELSE '' END AS sources, CASE WHEN label THEN CASE WHEN symbol = 'is_priority_customer' THEN 2 ELSE 3 END END AS round FROM (
 SELECT concat('p', c_custkey) AS q_id, 'is_priority_customer' AS symbol, c_custkey IN ({_PRI}) AS label FROM customer UNION ALL SELECT concat('d', c_custkey), 'right_to_discount', c_custkey IN ({_DIS}) FROM customer)""",
    "e22_unify_results": f"""WITH s AS (SELECT *, CASE WHEN label = 'inconsistent' THEN 'inconsistent' WHEN case_id % 7 = 0 THEN 'unsupported' WHEN case_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status FROM ({_E2}))
 SELECT q_id, 'deduction' AS intent, status, CASE WHEN status = 'ok' THEN label END AS label, CASE WHEN status <> 'ok' THEN CASE WHEN case_id % 11 = 0 THEN 'timeout' ELSE status END END AS warning FROM s""",
    "e21_answer_text": f"SELECT q_id, CASE label WHEN 'entailed' THEN concat('Yes: ', symbol, ' holds.') WHEN 'inconsistent' THEN 'The case contradicts itself.' ELSE concat('Open: ', symbol, ' cannot be decided.') END AS answer FROM ({_E2})",
    "e1_rule_sets": f"""WITH {_RULED}
 SELECT s AS set_id, c AS case_id, 'big_order' AS symbol, o AS args, true AS polarity, 0 AS rule FROM o WHERE CASE WHEN s = 1 THEN v > 250000 ELSE u END
 UNION ALL SELECT s, c, 'notable', concat(o, ',', k), true, 1 FROM notable
 UNION ALL SELECT DISTINCT 1, c, 'key_customer', k, true, 2 FROM notable WHERE s = 1
 UNION ALL SELECT 1, c, 'ordinary', k, true, 3 FROM ordinary UNION ALL SELECT 1, c, 'ordinary', k, false, 4 FROM torn
 UNION ALL SELECT 2, c, 'prime_customer', k, true, 2 FROM prime UNION ALL SELECT 2, c, 'prime_customer', k, false, 3 FROM refused
 UNION ALL SELECT 2, c, 'served', concat(o, ',', k), true, CASE WHEN u THEN 6 ELSE 4 END FROM o WHERE s = 2 AND c IN (SELECT c FROM prime)
 UNION ALL SELECT 2, c, 'open', o, true, 5 FROM o WHERE s = 2 AND NOT op AND c IN (SELECT c FROM refused)""",
    "e2_under_assumption": f"""WITH {_RULED}, x AS (SELECT set_id, case_id, coalesce(bool_or(f AND op), false) AS clash, coalesce(bool_or(u), false) AS u, coalesce(bool_or(v > 300000), false) AS p, coalesce(bool_or(f), false) AS f FROM fx_docket LEFT JOIN o ON s = set_id AND c = case_id GROUP BY set_id, case_id),
 l AS (SELECT set_id, case_id, CASE WHEN clash OR (set_id = 1 AND case_id IN (SELECT c FROM torn)) OR (set_id = 2 AND p AND (u OR f)) THEN 'inconsistent' WHEN set_id = 1 AND case_id IN (SELECT c FROM notable WHERE s = 1) THEN 'entailed' WHEN set_id = 1 THEN 'contradicted'
  WHEN u THEN 'entailed' WHEN p THEN 'contradicted' WHEN f THEN 'entailed' ELSE 'unknown' END AS label FROM x)
 SELECT concat(CASE set_id WHEN 1 THEN 'k' ELSE 'p' END, case_id) AS q_id, set_id, case_id, label <> 'contradicted' AS possible, label = 'entailed' AS certain, label FROM l""",
    "e7_conflict_support": f"""WITH {_RULED}, w AS (SELECT o.s, o.c, concat('open(', o.o, ')') AS conflict, o.o, o.k, o.op FROM o WHERE s = 2 AND f AND c IN (SELECT c FROM refused)),
 z AS (SELECT c, k FROM prime WHERE c IN (SELECT c FROM refused))
 SELECT DISTINCT s AS set_id, c AS case_id, conflict, source, atom FROM (
 SELECT s, c, concat('open(', o, ')') AS conflict, 'fact' AS source, concat(n, 'open(', o, ')') AS atom FROM o, (VALUES (''), ('not ')) t(n) WHERE f AND op
 UNION ALL SELECT 1, c, concat('ordinary(', k, ')'), source, concat(atom, '(', k, ')') FROM torn, (VALUES ('rule 3', 'ordinary'), ('rule 4', 'not ordinary'), ('closed', 'not key_customer')) t(source, atom)
 UNION ALL SELECT 1, c, concat('ordinary(', k, ')'), 'fact', concat('placed_by(', o, ',', k, ')') FROM o WHERE s = 1 AND c IN (SELECT c FROM torn)
 UNION ALL SELECT 1, c, concat('ordinary(', k, ')'), 'fact', concat('total_price(', o, ') = ', v) FROM o WHERE s = 1 AND v > 200000 AND c IN (SELECT c FROM torn)
 UNION ALL SELECT 2, c, concat('prime_customer(', k, ')'), source, concat(atom, '(', k, ')') FROM z, (VALUES ('rule 2', 'prime_customer'), ('rule 3', 'not prime_customer')) t(source, atom)
 UNION ALL SELECT 2, c, concat('prime_customer(', k, ')'), source, concat(atom, '(', o, tail, ')') FROM (SELECT c, k, o, concat(',', k) AS ck FROM o WHERE s = 2 AND u AND c IN (SELECT c FROM z)), (VALUES ('rule 1', 'notable', true), ('fact', 'placed_by', true), ('rule 0', 'big_order', false), ('fact', 'urgent', false)) t(source, atom, wide), LATERAL (SELECT CASE WHEN wide THEN ck ELSE '' END AS tail)
 UNION ALL SELECT 2, c, concat('prime_customer(', k, ')'), 'fact', unnest([concat('total_price(', o, ') = ', v), concat('placed_by(', o, ',', k, ')')]) FROM o WHERE s = 2 AND v > 300000 AND c IN (SELECT c FROM z)
 UNION ALL SELECT s, c, conflict, 'fact', unnest([concat('not open(', o, ')'), concat('placed_by(', o, ',', k, ')')]) FROM w
 UNION ALL SELECT s, c, conflict, 'fact', conflict FROM w WHERE op
 UNION ALL SELECT s, c, conflict, 'rule 5', conflict FROM w UNION ALL SELECT s, c, conflict, 'rule 3', concat('not prime_customer(', k, ')') FROM w
 UNION ALL SELECT w.s, w.c, conflict, 'fact', unnest([concat('total_price(', o.o, ') = ', o.v), concat('placed_by(', o.o, ',', o.k, ')')]) FROM w JOIN o ON o.s = 2 AND o.c = w.c AND o.v > 300000)""",
    "e11_answer_support": f"""WITH {_RULED}, n AS (SELECT * FROM notable WHERE s = 1)
 SELECT DISTINCT concat('k', c) AS q_id, source, atom FROM (SELECT c, 'rule 2' AS source, concat('key_customer(', k, ')') AS atom FROM n UNION ALL SELECT c, 'rule 1', concat('notable(', o, ',', k, ')') FROM n UNION ALL SELECT c, 'fact', concat('placed_by(', o, ',', k, ')') FROM n
 UNION ALL SELECT c, 'fact', concat('urgent(', o, ')') FROM n WHERE u UNION ALL SELECT c, 'rule 0', concat('big_order(', o, ')') FROM n WHERE v > 250000 UNION ALL SELECT c, 'fact', concat('total_price(', o, ') = ', v) FROM n WHERE v > 250000)""",
    "e13_bound_coverage": f"SELECT q_id, set_id, rule, path, symbol, atom, status, satisfied FROM ({_SETCOV})",
    "e14_rule_sets": f"""SELECT q_id, set_id, rule, path, atom, CASE WHEN status = 'missing' AND (c_custkey % 2 = 0 OR c_custkey % 7 = 0) THEN 'missing_non_blocking' ELSE status END AS status FROM ({_SETCOV})""",
    "e15_described": f"SELECT q_id, 'urgent' AS missing, 'urgent: has to be quick' AS described FROM ({_SETCOV}) WHERE status = 'missing'",
}
