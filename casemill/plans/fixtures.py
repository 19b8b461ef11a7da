"""Views over the given tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_laws": """
SELECT doc_id AS law_id, lang,
 concat('Article 1:', CAST(doc_id % 40 + 1 AS STRING), '.', chr(10),
  '§ 1. ', substr(flat, 1, quarter), chr(10),
  '1° ', substr(flat, quarter + 1, quarter), chr(10),
  '2° ', substr(flat, 2 * quarter + 1, quarter), chr(10),
  '§ 2. When not more than one of the criteria in paragraph 1 exceeds ',
  CAST(doc_id % 9 + 1 AS STRING), '50.000 the consequences apply from the following year.', chr(10),
  'Article 3.', chr(10), substr(flat, 3 * quarter + 1)) AS law_text
FROM (SELECT doc_id, lang, replace(text, chr(10), ' ') AS flat, CAST(floor(length(text) / 4) AS INT) AS quarter FROM documents)""",
    "fx_questions": """
SELECT doc_id AS q_id, doc_id AS law_id, CASE CAST(doc_id % 4 AS INT)
 WHEN 0 THEN concat('Does article 1:', CAST(doc_id % 40 + 1 AS STRING), ', paragraph 2 apply to Anna?')
 WHEN 1 THEN concat('Heeft Els recht volgens artikel 1:', CAST(doc_id % 40 + 1 AS STRING), ', eerste lid, 2°?')
 WHEN 2 THEN concat('What is the minimum amount under art. 1:', CAST(doc_id % 40 + 1 AS STRING), ' § 1?')
 ELSE 'Which consequences may apply?' END AS q_text
FROM documents""",
    "fx_answers": """
SELECT d.doc_id AS q_id, d.source AS model, l.quality = 1 AS expected_value,
 CASE WHEN d.n_chars % 17 = 0 THEN 'error' ELSE 'ok' END AS status,
 d.n_chars % 3 = 0 AS certain, d.n_chars % 3 <> 1 AS possible
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_calls": """
SELECT event_id AS call_index, ts, concat('run_', lpad(CAST(user_id % 37 AS STRING), 3, '0')) AS run_id,
 concat('strategy_', CAST(user_id % 4 AS STRING)) AS strategy,
 CASE event_type WHEN 'click' THEN 'kb_rules' WHEN 'view' THEN 'kb_symbols'
  WHEN 'purchase' THEN 'case_extraction' WHEN 'signup' THEN 'query_extraction' ELSE 'other' END AS stage,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'openai/gpt-4.1-mini' WHEN 1 THEN 'openai/gpt-4.1'
  WHEN 2 THEN 'openai/gpt-4o' ELSE 'other/model' END AS model,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS prompt_tokens,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 2) AS BIGINT) END AS completion_tokens,
 CASE WHEN event_type = 'error' THEN 'timeout' ELSE NULL END AS error
FROM events""",
    "fx_prices": """
SELECT pos, model_key, CAST(usd_in AS DOUBLE) AS usd_in, CAST(usd_out AS DOUBLE) AS usd_out
FROM (VALUES (0, 'gpt-4.1-mini', 0.40, 1.60), (1, 'gpt-4.1', 2.00, 8.00),
 (2, 'gpt-4o-mini', 0.15, 0.60), (3, 'gpt-4o', 2.50, 10.00)) AS t(pos, model_key, usd_in, usd_out)""",
    "fx_cells": """
SELECT concat('run_', CAST(o_orderkey AS STRING)) AS run_id, o_custkey, o_orderpriority AS strategy,
 o_orderstatus <> 'F' AS scored,
 CASE WHEN o_orderstatus = 'P' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'completed_with_errors'
  WHEN o_orderkey % 3 = 0 THEN 'law_compilation' WHEN o_orderkey % 3 = 1 THEN 'case_extraction'
  ELSE 'kb_idp_parse' END AS failure_category,
 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 5 < 3 THEN 1 ELSE 0 END AS correct_decisive,
 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 5 = 3 THEN 1 ELSE 0 END AS incorrect_decisive,
 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 5 = 4 THEN 1 ELSE 0 END AS inconclusive,
 CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE NULL END AS total,
 floor(o_totalprice / 10) / 100 AS duration_sec
FROM orders""",
    "fx_manifest": """
SELECT concat('run_', CAST(o.o_orderkey AS STRING)) AS run_id, r.r_name AS law_domain,
 CASE CAST(n.n_nationkey % 3 AS INT) WHEN 0 THEN 'core' WHEN 1 THEN 'challenge' ELSE 'stress' END AS evaluation_group,
 c.c_mktsegment AS difficulty,
 CASE CAST(n.n_nationkey % 4 AS INT) WHEN 0 THEN 'temporal,definition' WHEN 1 THEN 'classification'
  WHEN 2 THEN 'legal_effect,numeric_threshold' ELSE NULL END AS phenomena
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_facts": """
SELECT o_custkey AS case_id, concat('placed_by(o', CAST(o_orderkey AS STRING), ',c', CAST(o_custkey AS STRING), ').') AS line FROM orders
UNION ALL SELECT o_custkey, concat('urgent(o', CAST(o_orderkey AS STRING), ').') FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_custkey, concat('not open(o', CAST(o_orderkey AS STRING), ').') FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey, concat('open(o', CAST(o_orderkey AS STRING), ') is true.') FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_custkey, concat('open(o', CAST(o_orderkey AS STRING), ').') FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT o_custkey, concat('total_price(o', CAST(o_orderkey AS STRING), ') = ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.') FROM orders
UNION ALL SELECT o_custkey, concat('bad*(o', CAST(o_orderkey AS STRING), ')') FROM orders WHERE o_orderkey % 101 = 0""",
    "fx_symbols": """
SELECT * FROM (VALUES (1, 'placed_by', 'Order,Customer', 'Bool', 'observable'), (1, 'urgent', 'Order', 'Bool', 'observable'),
 (1, 'open', 'Order', 'Bool', 'observable'), (1, 'total_price', 'Order', 'Int', 'observable'),
 (1, 'big_order', 'Order', 'Bool', 'helper'), (1, 'is_priority_customer', 'Customer', 'Bool', 'derived'),
 (1, 'right_to_discount', 'Customer', 'Bool', 'derived')) AS t(set_id, name, args_csv, returns, kind)""",
    "fx_rules": """
SELECT * FROM (VALUES
 (1, 0, '{"forall":[{"var":"o","type":"Order"}],"if":[{"compare":{"left":{"func":"total_price","args":["o"]},"op":">","right":250000}}],"then":[{"pred":"big_order","args":["o"]}]}'),
 (1, 1, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"and":[{"pred":"placed_by","args":["o","c"]},{"pred":"big_order","args":["o"]},{"pred":"urgent","args":["o"]}]}],"then":[{"pred":"is_priority_customer","args":["c"]}]}'),
 (1, 2, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"and":[{"pred":"placed_by","args":["o","c"]},{"pred":"is_priority_customer","args":["c"]},{"pred":"open","args":["o"],"negated":true}]}],"then":[{"pred":"right_to_discount","args":["c"]}]}')
) AS t(set_id, rule, rule_json)""",
    "fx_rulebook": """
SELECT * FROM (VALUES
 (1, 0, '{"forall":[{"var":"o","type":"Order"}],"if":[{"compare":{"left":{"func":"total_price","args":["o"]},"op":">","right":250000}}],"then":[{"pred":"big_order","args":["o"]}]}'),
 (1, 1, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"placed_by","args":["o","c"]},{"or":[{"pred":"big_order","args":["o"]},{"pred":"urgent","args":["o"]}]}],"then":[{"pred":"notable","args":["o","c"]}]}'),
 (1, 2, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"notable","args":["o","c"]},{"pred":"placed_by","args":["o","c"]}],"then":[{"pred":"key_customer","args":["c"]}]}'),
 (1, 3, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"placed_by","args":["o","c"]},{"not":{"pred":"key_customer","args":["c"]}}],"then":[{"pred":"ordinary","args":["c"]}]}'),
 (1, 4, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"ordinary","args":["c"]},{"pred":"placed_by","args":["o","c"]},{"compare":{"left":200000,"op":"<","right":{"func":"total_price","args":["o"]}}}],"then":[{"not":{"pred":"ordinary","args":["c"]}}]}'),
 (2, 0, '{"forall":[{"var":"o","type":"Order"}],"if":[{"pred":"urgent","args":["o"]}],"then":[{"pred":"big_order","args":["o"]}]}'),
 (2, 1, '{"forall":[{"var":"x","type":"Order"},{"var":"y","type":"Customer"}],"if":[{"pred":"placed_by","args":["x","y"]},{"pred":"big_order","args":["x"]}],"then":[{"pred":"notable","args":["x","y"]}]}'),
 (2, 2, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"notable","args":["o","c"]}],"then":[{"pred":"prime_customer","args":["c"]}]}'),
 (2, 3, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"compare":{"left":{"func":"total_price","args":["o"]},"op":">","right":300000}},{"pred":"placed_by","args":["o","c"]}],"then":[{"pred":"prime_customer","args":["c"],"negated":true}]}'),
 (2, 4, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"prime_customer","args":["c"]},{"pred":"placed_by","args":["o","c"]}],"then":[{"pred":"served","args":["o","c"]}]}'),
 (2, 5, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"prime_customer","args":["c"],"negated":true},{"pred":"placed_by","args":["o","c"]}],"then":[{"pred":"open","args":["o"]}]}'),
 (2, 6, '{"forall":[{"var":"o","type":"Order"},{"var":"c","type":"Customer"}],"if":[{"pred":"urgent","args":["o"]},{"pred":"placed_by","args":["o","c"]}],"then":[{"pred":"served","args":["o","c"]}]}')
) AS t(set_id, rule, rule_json)""",
    "fx_docket": """
SELECT c_custkey AS case_id, 1 AS set_id FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0""",
    "fx_terms": """
SELECT * FROM (VALUES (1, 'placed_by', 'Order,Customer', 'Bool', 'observable', 'who placed the order'), (1, 'urgent', 'Order', 'Bool', 'observable', ''),
 (1, 'total_price', 'Order', 'Int', 'observable', 'price'), (1, 'big_order', 'Order', 'Bool', 'helper', ''), (1, 'notable', 'Order,Customer', 'Bool', 'derived', ''),
 (1, 'key_customer', 'Customer', 'Bool', 'derived', ''), (1, 'ordinary', 'Customer', 'Bool', 'conclusion', ''),
 (2, 'placed_by', 'Order,Customer', 'Bool', 'observable', 'whose order it is'), (2, 'urgent', 'Order', 'Bool', 'observable', 'has to be quick'), (2, 'big_order', 'Order', 'Bool', 'helper', ''),
 (2, 'notable', 'Order,Customer', 'Bool', 'helper', ''), (2, 'prime_customer', 'Customer', 'Bool', 'derived', ''), (2, 'served', 'Order,Customer', 'Bool', 'conclusion', '')
) AS t(set_id, name, args_csv, returns, kind, description)""",
    "fx_named": """
SELECT p_partkey % 50 AS set_id, p_partkey,
 concat(CASE CAST(p_partkey % 13 AS INT) WHEN 0 THEN 'exceeds_limit' WHEN 1 THEN 'has_valid_passport' WHEN 2 THEN 'legal_effect_of' WHEN 3 THEN 'is_member'
  WHEN 4 THEN 'deceased_owner' WHEN 5 THEN 'surviving_spouse' WHEN 6 THEN 'applies_from_next_year' WHEN 7 THEN 'turnover' WHEN 8 THEN 'right_to_claim'
  WHEN 9 THEN 'meets_two_criteria' WHEN 10 THEN 'owns' WHEN 11 THEN 'entitled_to_refund' ELSE 'lives_at' END, '_', lower(replace(p_brand, '#', ''))) AS name,
 CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'observable' WHEN 1 THEN 'helper' WHEN 2 THEN 'derived' WHEN 3 THEN 'observable' WHEN 4 THEN 'background' WHEN 5 THEN 'conclusion' ELSE 'function' END AS kind,
 CASE WHEN p_partkey % 17 = 0 THEN 'the deceased person' WHEN p_partkey % 19 = 0 THEN 'a residence status' ELSE p_name END AS description,
 CASE WHEN p_partkey % 23 = 0 THEN true WHEN p_partkey % 29 = 0 THEN false ELSE NULL END AS legal_output,
 CASE WHEN p_partkey % 31 = 0 THEN 'classification' ELSE NULL END AS category,
 p_partkey % 11 = 0 AS directly_observable, p_partkey % 37 = 0 AS case_input, p_partkey % 41 = 0 AS asked, p_partkey % 3 = 0 AS stated
FROM part""",
    "fx_shapes": """
SELECT p_partkey AS set_id, 0 AS rule, concat('{"if":[', CASE CAST(p_partkey % 7 AS INT)
 WHEN 0 THEN '{"or":[{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}}]}'
 WHEN 1 THEN '{"or":[{"compare":{"left":{"func":"turnover","args":["x"]},"op":"<=","right":900000}},{"compare":{"left":50,"op":">","right":{"func":"staff","args":["x"]}}}]}'
 WHEN 2 THEN '{"or":[{"and":[{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}}]},{"and":[{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}},{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"pred":"at_least_two_exceeded","args":["x"]}]}]}'
 WHEN 3 THEN '{"not":{"or":[{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}}]}}'
 WHEN 4 THEN '{"and":[{"pred":"listed","args":["x"]},{"or":[{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}},{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}}]}]}'
 WHEN 5 THEN '{"or":[{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"compare":{"left":50,"op":">","right":{"func":"staff","args":["x"]}}}]}'
 ELSE '{"pred":"at_least_two_exceeded","args":["x"]}' END, '],"then":[{"pred":"is_small","args":["x"]}]}') AS rule_json FROM part
UNION ALL SELECT p_partkey, 1, concat('{"if":[', CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '{"pred":"at_least_two_exceeded","args":["x"]}' WHEN 1 THEN '{"or":[{"and":[{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}}]},{"and":[{"compare":{"left":{"func":"staff","args":["x"]},"op":">=","right":50}},{"compare":{"left":{"func":"turnover","args":["x"]},"op":">","right":900000}},{"pred":"at_least_two_exceeded","args":["x"]}]}]}' ELSE '{"pred":"listed","args":["x"]}' END,
 '],"then":[{"pred":"is_small","args":["x"],"negated":true}]}') FROM part WHERE p_partkey % 4 = 0""",
    "fx_periods": """
SELECT p_partkey, set_id, concat(CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'prior_' WHEN 1 THEN 'consecutive_' WHEN 2 THEN 'year_following_' WHEN 3 THEN '' ELSE 'next_' END, name, '_', CAST(p_partkey AS STRING)) AS name,
 kind, description, legal_output, category, case_input
FROM fx_named""",
    "fx_limits": """
SELECT p_partkey AS set_id, CAST(10 AS DOUBLE) AS value FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, CAST(50 AS DOUBLE) FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, CAST(900000 AS DOUBLE) FROM part WHERE p_partkey % 5 < 2
UNION ALL SELECT p_partkey, CAST(450000 AS DOUBLE) FROM part WHERE p_partkey % 7 < 3
UNION ALL SELECT p_partkey, CAST(11250000 AS DOUBLE) FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, CAST(3 AS DOUBLE) FROM part""",
    "fx_years": """
SELECT o_custkey AS entity, year(o_orderdate) AS period, sum(o_totalprice) AS turnover,
 count(*) AS n_orders, max(o_totalprice) AS largest
FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "fx_messages": """
SELECT concat('run_', CAST(user_id % 37 AS STRING)) AS run_id, event_id AS event_index, event_id % 13 AS kind,
 CASE CAST(event_id % 13 AS INT)
  WHEN 0 THEN 'JSON_IR_SCHEMA_DESIGN_ERROR: helper predicate ''h1'' is never defined'
  WHEN 1 THEN 'JSON_IR_SCHEMA_DESIGN_ERROR: derived predicates never appear in any rule THEN'
  WHEN 2 THEN 'JSON_IR_RULE_DESIGN_ERROR: derived predicate ''d'' is circular'
  WHEN 3 THEN 'JSON_IR_RULE_DESIGN_ERROR: helper predicate ''h2'' has no defining rule'
  WHEN 4 THEN 'JSON_IR_RULE_DESIGN_ERROR: incompatible unary subject roles'
  WHEN 5 THEN concat('rules[', CAST(event_id % 4 AS STRING), '].if: argument 1 to ''f'' expects type Company, got Year.')
  WHEN 6 THEN concat('rules[', CAST(event_id % 4 AS STRING), '].if: unbound identifier ''x'' here')
  WHEN 7 THEN concat('unknown predicate p', CAST(event_id % 3 AS STRING))
  WHEN 8 THEN 'types cannot be empty'
  WHEN 9 THEN 'non-empty consequent needed'
  WHEN 10 THEN 'arity mismatch of q'
  WHEN 11 THEN concat('rules[', CAST(event_id % 4 AS STRING), '] is tautological')
  ELSE 'used as a Boolean predicate atom but only under functions' END AS message
FROM events""",
    "fx_errors": """
SELECT concat('run_', CAST(user_id % 37 AS STRING)) AS run_id, event_id AS event_index,
 CASE CAST(event_id % 5 AS INT)
  WHEN 0 THEN concat('Helper predicate ''h', CAST(event_id % 3 AS STRING), ''' has no defining rule')
  WHEN 1 THEN 'rules[3].if: unknown predicate foo'
  WHEN 2 THEN 'argument 0 to predicate ''p'' expects type Company, got Year'
  WHEN 3 THEN 'number does not appear in the scoped law text'
  ELSE 'IDP failed to parse compiled KB' END AS message
FROM events WHERE event_type = 'error'""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql.replace("{", "{{").replace("}", "}}")), **used) if used else spark.sql(sql)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it uses in front."""
    named = lambda text: {v for v in VIEWS if re.search(rf"\b{v}\b", text)}
    direct = named(sql)
    used = [v for v in VIEWS if v in direct.union(*(named(VIEWS[u]) for u in direct))]
    views = [f"{v} AS ({VIEWS[v]})" for v in used]
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if own:
        recursive = "RECURSIVE " if own[1] else ""
        return f"WITH {recursive}{', '.join(views)}{',' if views else ''} {sql[own.end() :]}"
    return f"WITH {', '.join(views)} {sql}" if views else sql
