"""Queries of thresholds, temporal and status symbols, targets and normal forms, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.text import CUES, QUESTION_EFFECT_PATTERNS, QUESTION_STOP
from casemill.operators import facts as C
from casemill.operators import gaps as G
from casemill.operators import rules as D
from casemill.plans.facts_queries import _DOM, _facts, _schema
from casemill.plans.fixtures import table
from casemill.plans.routing_queries import _CLASSED, _USES, _in, _uses

FUNCTION_NAMES = ("micro_employee_limit", "small_employee_threshold", "employee_cap", "micro_turnover_limit", "small_turnover_limit", "turnover_cap", "micro_balance_limit", "balance_limit", "duration_limit")
TYPE_NAMES = ("EligibleApplicant", "Company", "ResidentRecord", "Owner", "Vehicle", "SmallFirm")
PREDICATE_NAMES = ("is_eligible_applicant", "is_company", "is_owner", "has_vehicle", "is_small", "is_resident")


def _pick(key: str, names: tuple[str, ...]):
    return F.get(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names)).cast("int"))


def b27_temporal_symbols(spark, d):
    named = table(spark, d, "fx_periods")
    used = table(spark, d, "lineitem").join(named, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") % 50).alias("set_id"), F.col("name").alias("func"))
    return G.temporal_symbols(named, used)


def _shaped(spark, d):
    rules = table(spark, d, "fx_shapes")
    symbols = table(spark, d, "part").select(F.col("p_partkey").alias("set_id"), F.lit("is_small").alias("name"), F.when(F.col("p_partkey") % 5 == 0, "helper").otherwise("derived").alias("kind"))
    k = F.col("p_partkey")
    flags = table(spark, d, "part").select(k.alias("set_id"), (k % 3 != 0).alias("at_most_one"), (k % 11 == 0).alias("any_one"), (k % 13 == 0).alias("has_threshold"))
    return D.or_shapes(rules), D.rule_atoms(rules), D.rule_compares(rules), symbols, flags


def d10_threshold_or_shape(spark, d):
    shapes, atoms, _, symbols, flags = _shaped(spark, d)
    return G.threshold_or_shape(shapes, atoms, symbols, flags)


def d11_threshold_negative_support(spark, d):
    shapes, atoms, compares, symbols, flags = _shaped(spark, d)
    return G.threshold_negative_support(atoms, compares, shapes, symbols, flags)


def d12_suggest_thresholds(spark, d):
    functions = table(spark, d, "part").select(F.col("p_partkey").alias("set_id"), _pick("p_partkey", FUNCTION_NAMES).alias("name"))
    return G.suggest_thresholds(functions, table(spark, d, "fx_limits"))


def d15_status_as_type(spark, d):
    p = table(spark, d, "part").withColumn("set_id", F.col("p_partkey"))
    types = p.select("set_id", _pick("p_partkey", TYPE_NAMES).alias("name"), "p_name").withColumn("description", F.concat(F.lit("sort of "), "p_name")).drop("p_name")
    kind = F.when(F.col("p_partkey") % 4 == 0, "derived").when(F.col("p_partkey") % 4 == 1, "helper").otherwise("observable")
    predicates = p.select("set_id", "p_partkey", F.explode(F.array(*[F.lit(n) for n in PREDICATE_NAMES])).alias("name")).select("set_id", "name", kind.alias("kind"), F.array(_pick("p_partkey", TYPE_NAMES), F.lit("Year")).alias("args"))
    return G.status_as_type(types, predicates)


def d18_missing_helper_evidence(spark, d):
    return G.missing_helper_evidence(_uses(spark, d), table(spark, d, "fx_named"))


def c15_case_given_bridge(spark, d):
    facts = _facts(spark, d).withColumn("stated", F.col("case_id") % 3 != 0)
    targets = table(spark, d, "fx_symbols").filter("name in ('urgent', 'open')").select(F.col("name").alias("symbol"))
    return G.case_given_bridge(facts, targets).withColumn("args", F.array_join("args", ","))


def c18_select_target(spark, d):
    q = table(spark, d, "fx_questions").join(table(spark, d, "fx_periods").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("q_id"), F.col("name").alias("hint")), "q_id", "left")
    more = F.when(F.col("q_id") % 4 == 0, " Is it a valid passport status?").when(F.col("q_id") % 4 == 1, " What means surviving spouse turnover?").when(F.col("q_id") % 4 == 2, " Does the right to claim apply from next year?").otherwise(" owns member")
    return G.select_target(q.select("q_id", (F.col("q_id") % 50).alias("set_id"), F.concat("q_text", more).alias("text"), "hint"), table(spark, d, "fx_periods"))


def _flagged(spark, d):
    none = F.lit(None)
    return _schema(spark, d).withColumns({"description": none.cast("string"), "legal_output": none.cast("boolean"), "category": none.cast("string"), "directly_observable": F.lit(False), "case_input": F.lit(False)})


def c23_normalize_cases(spark, d):
    k = F.col("o_orderkey") % 8
    o, c = F.concat(F.lit("O"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    orders = table(spark, d, "orders")
    names = ("Urgent", "is_open", "placed-by", "nothing", "big_order", "right_to_discount", "total_price", "urgent")
    args = F.when(k == 2, F.array(o, c)).when(k == 5, F.array(c)).when(k == 7, F.array(o, c)).otherwise(F.array(o))
    said = orders.select(F.col("o_orderkey").alias("a_id"), F.col("o_custkey").alias("case_id"), _pick("o_orderkey", names).alias("symbol"), args.alias("args"), (F.col("o_orderkey") % 3 == 0).alias("negated"), F.when(k == 6, "5").alias("value"), F.lit(False).alias("asked"), (F.col("o_orderkey") % 16 == 4).alias("stated"))
    declared = orders.filter(k == 0).select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 3 == 0, "Vehicle").otherwise("Order").alias("type"), F.concat(F.lit("X "), "o_orderkey").alias("entity"))
    return G.normalize_cases(said, _flagged(spark, d), declared)


def c24_normalize_queries(spark, d):
    k = F.col("c_custkey") % 12
    text = lambda *pairs: F.coalesce(*[F.when(k == n, v) for n, v in pairs], F.lit(""))
    intent = text((0, "Satisfiable"), (2, "deduction"), (3, "deduction_set"), (4, "no_such"), (5, "optimization"), (6, "explain"), (7, "model_expansion"))
    hint = text((3, "is_priority_customer"), (5, "total_price"), (8, "priority customer"), (9, "big order"), (10, "right-to-discount"), (11, "zzz"))
    args = F.when(k == 5, F.array(F.lit("O 5"))).when(k == 10, F.array(F.lit("nobody"))).otherwise(F.array().cast("array<string>"))
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), F.col("c_custkey").alias("case_id"), F.when(k < 8, "intent").otherwise("predicate").alias("kind"), intent.alias("intent"), hint.alias("hint"), F.lit(None).cast("string").alias("mode"), args.alias("args"), F.lit("").alias("direction"), F.lit(None).cast("int").alias("max_models"))
    return G.normalize_queries(q, _schema(spark, d), C.typed_domains(_facts(spark, d), _schema(spark, d)))


def c24_assigned_arguments(spark, d):
    """Who placed an order: arguments in the wrong order, missing, named by their type or unknown."""
    k, o, c = F.col("o_orderkey"), F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    args = F.when(k % 5 == 0, F.array(c, o)).when(k % 5 == 1, F.array(o, c)).when(k % 5 == 2, F.array(c)).when(k % 5 == 3, F.array(F.lit("Customer"), o)).otherwise(F.array(F.lit("unknown"), F.lit("nobody")))
    none = F.lit(None).cast("string")
    q = table(spark, d, "orders").select(k.alias("q_id"), F.col("o_custkey").alias("case_id"), F.lit("predicate").alias("kind"), none.alias("intent"), F.lit("Placed-By").alias("hint"), none.alias("mode"), args.alias("args"), none.alias("direction"), F.lit(None).cast("int").alias("max_models"), F.lit("Who placed it?").alias("question"))
    return G.normalize_queries(q, _schema(spark, d), C.typed_domains(_facts(spark, d), _schema(spark, d))).select("q_id", "symbol", "args", "code")


def c24_finalize_queries(spark, d):
    """Ten kinds of queries about an order, right and wrong ones."""
    k, o, c = F.col("o_orderkey"), F.concat(F.lit("O"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    n = k % 10
    text = lambda *pairs: F.coalesce(*[F.when(n == i, v) for i, v in pairs])
    args = F.when(n.isin(0, 1, 3), F.array(o)).when(n == 2, F.array(o, o)).when(n == 7, F.array(F.lit("nobody"))).when(n == 8, F.array(o, F.lit("?")))
    q = table(spark, d, "orders").select(
        k.alias("q_id"), F.col("o_custkey").alias("case_id"), F.when(n.isin(5, 6, 7, 8), "predicate").otherwise("intent").alias("type"),
        text((0, "get_range"), (1, "get_range"), (2, "optimization"), (3, "optimization"), (4, "model_expansion"), (9, "explain")).alias("intent"), F.when(n.isin(5, 6), "set").alias("mode"),
        text((0, "total_price"), (1, "nothing"), (2, "TotalPrice"), (3, "total_price"), (5, "is_priority_customer"), (6, "placed_by"), (7, "urgent"), (8, "PlacedBy"), (9, "urgent")).alias("symbol"), args.alias("args"), text((2, "min"), (3, "up"), (4, "9")).alias("option"),
    )
    return G.finalize_queries(q, _schema(spark, d), C.typed_domains(_facts(spark, d), _schema(spark, d))).withColumn("args", F.array_join("args", ","))


def c26_asserted_criteria(spark, d):
    names = ("has_valid_passport", "owns", "failed_to_comply_with_order")
    docs = table(spark, d, "documents")
    quote = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.substring("text", 5, 40), " ", "- ")).otherwise(F.concat(F.substring("text", 5, 20), F.lit(" zz")))
    facts = docs.select(F.col("doc_id").alias("case_id"), _pick("doc_id", names).alias("symbol"), F.array(F.concat(F.lit("d"), "doc_id")).alias("args"), quote.alias("quote"))
    symbols = facts.select(F.col("symbol").alias("name"), F.lit("").alias("description")).distinct()
    return G.asserted_criteria(facts, symbols, docs.select(F.col("doc_id").alias("case_id"), "text"))


QUERIES = {f.__name__: f for f in (b27_temporal_symbols, c15_case_given_bridge, c18_select_target, c23_normalize_cases, c24_normalize_queries, c24_assigned_arguments, c24_finalize_queries, c26_asserted_criteria, d10_threshold_or_shape, d11_threshold_negative_support, d12_suggest_thresholds, d15_status_as_type, d18_missing_helper_evidence)}


def _case(key: str, names: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _some(test: str, column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{test}({column}, '{p}')" for p in parts) + ")"


_PERIODS = _CLASSED.replace("FROM fx_named", "FROM fx_periods")
_STARTS = _some("starts_with", "name", G.RELATION_STARTS)
_RELATION = f"({_STARTS} AND output <> 'effect')"
_DEFINED = "(kind IN ('derived', 'conclusion') OR coalesce(legal_output, false))"
_BARE = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), '^(is|has)(.)', '\\2')"
_WORDS = f"list_distinct(list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({_in(G.EMPTY_WORDS)})))"
_SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[_-]', ' ', 'g')), '\\s+'), lambda x: x <> ''))"
_ASKED = f"list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ ]+', ' ', 'g'), ' +'), lambda x: length(x) >= 3 AND x NOT IN ({_in(QUESTION_STOP)})), lambda x: CASE WHEN suffix(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END))"
_FOLDED = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '[\\s_–—-]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"

SQL = {
    "b27_temporal_symbols": f"""WITH c AS ({_PERIODS}), r AS (SELECT DISTINCT set_id, name, CASE WHEN {_RELATION} AND {_DEFINED} THEN 'derived_relation' WHEN {_RELATION} THEN 'relation' WHEN output = 'effect' AND {_some('contains', 'name', G.BORROWED_PARTS)} THEN 'masquerading' END AS role FROM c)
 SELECT * FROM r WHERE role IS NOT NULL UNION ALL SELECT DISTINCT l_suppkey % 50, name, 'undeclared' FROM lineitem JOIN c ON l_partkey = p_partkey WHERE {_some('contains', 'name', G.RELATION_PARTS)} AND l_suppkey % 50 <> set_id""",
    "c15_case_given_bridge": """WITH f AS (SELECT o_custkey AS case_id, 'placed_by' AS symbol, concat('o', o_orderkey, ',c', o_custkey) AS args, true AS polarity FROM orders UNION SELECT o_custkey, 'urgent', concat('o', o_orderkey), true FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION SELECT o_custkey, 'open', concat('o', o_orderkey), o_orderstatus <> 'F' FROM orders UNION SELECT o_custkey, 'open', concat('o', o_orderkey), true FROM orders WHERE o_orderkey % 97 = 0 UNION SELECT o_custkey, 'total_price', concat('o', o_orderkey), NULL FROM orders)
 SELECT case_id, symbol, args, polarity, CASE WHEN symbol NOT IN ('urgent', 'open') THEN 'fact' WHEN case_id % 3 = 0 THEN 'leak' ELSE 'implied' END AS role FROM f UNION ALL SELECT case_id, concat('case_given_', symbol), args, polarity, 'given' FROM f WHERE symbol IN ('urgent', 'open') AND case_id % 3 <> 0""",
    "c18_select_target": f"""WITH p AS (SELECT *, {_SPLIT.format('name')} AS nt, {_SPLIT.format('description')} AS dt FROM ({_PERIODS}) WHERE NOT ({_RELATION} AND NOT {_DEFINED}) AND kind <> 'background' AND NOT case_input),
 t AS (SELECT q_id, q_id % 50 AS set_id, concat(q_text, CASE q_id % 4 WHEN 0 THEN ' Is it a valid passport status?' WHEN 1 THEN ' What means surviving spouse turnover?' WHEN 2 THEN ' Does the right to claim apply from next year?' ELSE ' owns member' END) AS text, name AS hint FROM fx_questions LEFT JOIN (SELECT p_partkey, name FROM fx_periods WHERE p_partkey % 5 = 0) ON p_partkey = q_id),
 q AS (SELECT *, {_ASKED} AS qt, regexp_matches(lower(text), '{'|'.join(f'(?:{e})' for e in QUESTION_EFFECT_PATTERNS)}') AS effect_q, regexp_matches(lower(text), '{CUES['definition']}') AS def_q, regexp_matches(text, '{G.CLASS_QUESTION}') AS class_like FROM t),
 x AS (SELECT q_id, name, output, category, effect_q, def_q, NOT effect_q AND (def_q OR class_like) AS class_q, len(nt) AS n, len(dt) AS m, len(qt) AS k, len(list_intersect(qt, nt)) AS h, len(list_intersect(qt, dt)) AS g, hint FROM q JOIN p ON q.set_id = p.set_id),
 s AS (SELECT q_id, name, round(1.12 * h / n + 0.5 * g / m + CASE WHEN k > 0 THEN 0.35 * h / k ELSE 0 END + 0.035 * least(n, 14) + CASE WHEN output = 'effect' THEN 0.4 ELSE 0 END + CASE WHEN effect_q AND output = 'effect' THEN 0.8 WHEN effect_q AND output = 'classification' THEN -0.65 ELSE 0 END
  - CASE WHEN def_q AND output = 'classification' THEN 0.25 ELSE 0 END + CASE WHEN NOT class_q THEN 0 WHEN output = 'classification' OR coalesce(category, '') IN ('classification', 'status') THEN 1 WHEN output = 'effect' THEN -1 ELSE 0 END + CASE WHEN hint = name THEN 0.15 ELSE 0 END, 6) AS score FROM x)
 SELECT * FROM (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name) AS INT) AS rank, name, score FROM s) WHERE rank <= 3""",
    "c23_normalize_cases": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 8 AS m, concat('o', o_orderkey) AS o FROM orders), n AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'not ' ELSE '' END AS neg FROM o)
 SELECT c AS case_id, 'fact' AS kind, 'urgent' AS name, concat(neg, 'urgent(', o, ').') AS text FROM n WHERE m = 0 UNION SELECT c, 'fact', 'open', concat(neg, 'open(', o, ').') FROM n WHERE m = 1 UNION SELECT c, 'fact', 'placed_by', concat(neg, 'placed_by(', o, ',c', c, ').') FROM n WHERE m = 2
 UNION SELECT c, 'fact', 'big_order', concat(neg, 'big_order(', o, ').') FROM n WHERE k % 16 = 4 UNION SELECT c, 'fact', 'total_price', concat('total_price(', o, ') = 5.') FROM n WHERE m = 6
 UNION SELECT c, 'entity', 'Order', o FROM n WHERE m IN (0, 1, 2, 6) OR k % 16 = 4 UNION SELECT c, 'entity', 'Customer', concat('c', c) FROM n WHERE m = 2 UNION SELECT c, 'entity', 'Order', concat('x_', k) FROM n WHERE m = 0 AND k % 3 <> 0
 UNION SELECT c, 'reject', 'nothing', 'unresolved' FROM n WHERE m = 3 UNION SELECT c, 'reject', 'big_order', 'derived_or_helper' FROM n WHERE k % 16 = 12 UNION SELECT c, 'reject', 'right_to_discount', 'legal_output' FROM n WHERE m = 5 UNION SELECT c, 'reject', 'urgent', 'wrong_arity' FROM n WHERE m = 7""",
    "c24_normalize_queries": """WITH c AS (SELECT c_custkey AS q_id, c_custkey % 12 AS k, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer)
 SELECT q_id, CASE WHEN k IN (3, 8, 9, 10, 11) THEN 'predicate' ELSE 'intent' END AS type, CASE k WHEN 0 THEN 'satisfiable' WHEN 1 THEN '' WHEN 2 THEN 'deduction' WHEN 4 THEN 'no_such' WHEN 5 THEN 'optimization' WHEN 6 THEN 'explain' WHEN 7 THEN 'model_expansion' END AS intent,
  CASE k WHEN 3 THEN 'is_priority_customer' WHEN 5 THEN 'total_price' WHEN 6 THEN '' WHEN 8 THEN 'is_priority_customer' WHEN 9 THEN 'big_order' WHEN 10 THEN 'right_to_discount' WHEN 11 THEN 'is_priority_customer' END AS symbol, CASE WHEN k = 3 THEN 'set' WHEN k >= 8 THEN 'boolean' END AS mode,
  CASE WHEN k = 5 THEN 'o_5' WHEN k IN (8, 11) AND known THEN concat('c', q_id) WHEN k = 10 THEN 'nobody' ELSE '' END AS args, CASE k WHEN 5 THEN 'min' WHEN 7 THEN '1' END AS option,
  CASE WHEN k = 1 THEN 'empty_intent' WHEN k = 2 THEN 'internal_intent' WHEN k = 4 THEN 'unsupported_intent' WHEN k = 6 THEN 'no_target' WHEN k IN (8, 11) AND NOT known THEN 'wrong_arity' WHEN k = 9 THEN 'helper' WHEN k = 10 THEN 'not_in_domain' END AS code FROM c""",
    "c24_assigned_arguments": """SELECT q_id, 'placed_by' AS symbol, CASE WHEN k IN (0, 1, 3) OR (k = 2 AND one) THEN concat('o', q_id, ',c', c) WHEN k = 2 THEN concat('c', c) WHEN one THEN concat('o', q_id, ',nobody') ELSE 'nobody' END AS args,
 CASE WHEN k IN (2, 4) AND NOT one THEN 'wrong_arity' WHEN k = 4 THEN 'not_in_domain' END AS code FROM (SELECT o_orderkey AS q_id, o_custkey AS c, o_orderkey % 5 AS k, count(*) OVER (PARTITION BY o_custkey) = 1 AS one FROM orders)""",
    "c24_finalize_queries": """SELECT o_orderkey AS q_id, CASE n WHEN 0 THEN 'get_range' WHEN 5 THEN 'deduction_set' WHEN 8 THEN 'deduction' END AS internal, CASE WHEN n IN (0, 2, 3) THEN 'total_price' WHEN n = 1 THEN 'nothing' WHEN n = 5 THEN 'is_priority_customer' WHEN n IN (6, 8) THEN 'placed_by' WHEN n IN (7, 9) THEN 'urgent' END AS symbol,
 CASE WHEN n IN (0, 1, 3) THEN concat('o', o_orderkey) WHEN n = 2 THEN concat('o', o_orderkey, ',o', o_orderkey) WHEN n IN (5, 6) THEN '?' WHEN n = 7 THEN 'nobody' WHEN n = 8 THEN concat('o', o_orderkey, ',?') ELSE '' END AS args,
 CASE n WHEN 1 THEN 'unknown_function' WHEN 2 THEN 'wrong_arity' WHEN 3 THEN 'bad_direction' WHEN 4 THEN 'bad_max_models' WHEN 6 THEN 'not_unary' WHEN 7 THEN 'not_in_domain' WHEN 9 THEN 'wrong_arity' END AS code FROM (SELECT *, o_orderkey % 10 AS n FROM orders)""",
    "c26_asserted_criteria": f"""WITH q AS (SELECT doc_id, {_case('doc_id', ('has_valid_passport', 'owns', 'failed_to_comply_with_order'))} AS symbol, lower(text) AS t, CASE WHEN doc_id % 2 = 0 THEN replace(substr(text, 5, 40), ' ', '- ') ELSE substr(text, 5, 20) || ' zz' END AS quote FROM documents),
 f AS (SELECT *, {_FOLDED.format('t')} AS ft, {_FOLDED.format('lower(quote)')} AS fq FROM q), r AS (SELECT *, CASE WHEN symbol = 'owns' THEN 'not_factual_criteria_candidate' WHEN NOT (fq <> '' AND contains(ft, fq)) THEN 'unsupported_by_case_text' END AS reason FROM f)
 SELECT doc_id AS case_id, symbol, concat('d', doc_id) AS args, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NULL THEN quote END AS evidence FROM r""",
    "d10_threshold_or_shape": """SELECT p_partkey AS set_id, 0 AS rule, CASE WHEN p_partkey % 7 = 4 THEN '0.1' ELSE '0' END AS path, CASE WHEN p_partkey % 7 = 1 THEN 'within' ELSE 'exceeded' END AS code FROM part WHERE p_partkey % 7 IN (0, 1, 4) AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 11 <> 0""",
    "d11_threshold_negative_support": """SELECT p_partkey AS set_id, 'is_small' AS symbol, 'at_least_two_exceeded => not is_small' AS pattern FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 <> 0 AND (p_partkey % 7 <> 6 OR p_partkey % 13 = 0)""",
    "d12_suggest_thresholds": f"""WITH f AS (SELECT p_partkey AS set_id, {_case('p_partkey', FUNCTION_NAMES)} AS name FROM part), x AS (SELECT f.set_id, name, value, CASE name WHEN 'micro_employee_limit' THEN value = 10 WHEN 'small_employee_threshold' THEN value = 50 WHEN 'employee_cap' THEN value = 50 WHEN 'micro_turnover_limit' THEN value = 900000 WHEN 'small_turnover_limit' THEN value = 11250000 WHEN 'turnover_cap' THEN value >= 900000 WHEN 'micro_balance_limit' THEN value = 450000 WHEN 'balance_limit' THEN value >= 450000 ELSE false END AS fits FROM f LEFT JOIN (SELECT * FROM fx_limits WHERE value > 10) l ON f.set_id = l.set_id),
 g AS (SELECT set_id, name, count(value) AS n_candidates, count(*) FILTER (fits) AS n_fit, min(value) FILTER (fits) AS fit, min(value) AS lone FROM x GROUP BY set_id, name), h AS (SELECT *, CASE WHEN name = 'duration_limit' THEN NULL WHEN n_fit = 1 THEN fit WHEN n_fit = 0 AND n_candidates = 1 THEN lone END AS likely FROM g)
 SELECT set_id, name, n_candidates, likely, likely IS NULL AND n_candidates > 1 AS ambiguous FROM h""",
    "d15_status_as_type": f"""WITH x AS (SELECT p_partkey AS set_id, {_case('p_partkey', TYPE_NAMES)} AS type, unnest([{_in(PREDICATE_NAMES)}]) AS predicate, p_partkey % 4 < 2 AS concludes, p_name FROM part), y AS (SELECT *, {_BARE.format('type')} AS t, {_BARE.format('predicate')} AS p, lower(concat(type, ' sort of ', p_name)) AS words FROM x)
 SELECT set_id, type, predicate, CASE WHEN concludes THEN 'concluded_over_itself' ELSE 'status_encoded_as_type' END AS code FROM y WHERE starts_with(predicate, 'is') AND (starts_with(t, p) OR starts_with(p, t)) AND t <> 'company' AND NOT {_some('contains', 'words', G.RECORD_WORDS)} AND (concludes OR {_some('contains', 'words', G.STATUS_LEXICON)})""",
    "d18_missing_helper_evidence": f"""WITH u AS ({_USES}), d AS (SELECT DISTINCT set_id, symbol FROM u WHERE side = 'then'), n AS (SELECT set_id, name, max(CASE WHEN kind = 'helper' AND (set_id, name) IN (SELECT (set_id, symbol) FROM d) THEN 3 WHEN kind = 'observable' THEN 2 WHEN kind IN ('derived', 'conclusion') THEN 1 ELSE 0 END) AS base FROM fx_named GROUP BY set_id, name),
 h AS (SELECT a.set_id, a.symbol AS helper, count(DISTINCT a.rule) AS n_rules, coalesce(string_agg(DISTINCT b.symbol, ',' ORDER BY b.symbol), '') AS feeds FROM u a LEFT JOIN u b ON a.set_id = b.set_id AND a.rule = b.rule AND b.side = 'then' WHERE a.side = 'if' AND (a.set_id, a.symbol) IN (SELECT (set_id, name) FROM fx_named WHERE kind = 'helper') AND (a.set_id, a.symbol) NOT IN (SELECT (set_id, symbol) FROM d) GROUP BY 1, 2),
 s AS (SELECT h.set_id, helper, name, base + 2 * len(list_intersect({_WORDS.format('helper')}, {_WORDS.format('name')})) AS score FROM h JOIN n ON h.set_id = n.set_id AND helper <> name), r AS (SELECT *, row_number() OVER (PARTITION BY set_id, helper ORDER BY score DESC, name) AS rank FROM s WHERE score > 0)
 SELECT h.set_id, h.helper, n_rules, feeds, coalesce(candidates, '') AS candidates FROM h LEFT JOIN (SELECT set_id, helper, string_agg(name, ',' ORDER BY rank) AS candidates FROM r WHERE rank <= 12 GROUP BY 1, 2) c ON h.set_id = c.set_id AND h.helper = c.helper""",
}
