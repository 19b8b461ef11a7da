"""Queries of the text operators, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import text as C
from casemill.operators import text as T
from casemill.plans.fixtures import table


def _docs(spark, d):
    return table(spark, d, "documents")


def _sql_in(words):
    return ", ".join(f"'{w}'" for w in words)


def _sql_any(text, phrases):
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def b1_chunk_documents(spark, d):
    return T.chunk_documents(table(spark, d, "fx_laws"))


def b2_normalize_article(spark, d):
    raw = F.concat(F.lit(" 1"), F.when(F.col("doc_id") % 2 == 0, ",").otherwise(":"), F.col("doc_id") % 40, F.when(F.col("doc_id") % 3 == 0, ".5").otherwise(""))
    return _docs(spark, d).select("doc_id", C.normalize_article(raw).alias("article"))


def b3_extract_citations(spark, d):
    return T.extract_citations(table(spark, d, "fx_questions"))


def b4_primary_citation(spark, d):
    return T.primary_citation(T.extract_citations(table(spark, d, "fx_questions"))).select("q_id", "article", "paragraph", "point")


def _cited(spark, d):
    return T.cite_join(b4_primary_citation(spark, d), T.chunk_documents(table(spark, d, "fx_laws")), table(spark, d, "fx_questions"))


def b5_cite_join(spark, d):
    return _cited(spark, d)


def b6_expand_cross_refs(spark, d):
    chunks = T.chunk_documents(table(spark, d, "fx_laws"))
    selected = _cited(spark, d).join(table(spark, d, "fx_questions").select("q_id", "law_id"), "q_id").select("q_id", "law_id", "chunk_id")
    return T.expand_cross_refs(selected, chunks)


def _asked(spark, d):
    """Questions with the distinct words of their case in place of its text: retrieval asks for no more, and less is shuffled."""
    return table(spark, d, "fx_questions").join(_docs(spark, d).select(F.col("doc_id").alias("q_id"), F.array_join(T.key_words(F.col("text")), " ").alias("case_text")), "q_id")


def b7_keyword_topk(spark, d):
    return T.keyword_topk(_asked(spark, d), T.chunk_documents(table(spark, d, "fx_laws")))


def b9_extract_numbers(spark, d):
    return T.extract_numbers(_docs(spark, d))


def b10_numbers_summary(spark, d):
    return _docs(spark, d).select("doc_id", C.numbers_summary(C.numbers(F.col("text"))).alias("summary"))


def b11_tag_cues(spark, d):
    t = F.col("law_text")
    return table(spark, d, "fx_laws").select("law_id", *[C.cue(t, c).alias(c) for c in C.CUES])


def b12_temporal_phrases(spark, d):
    return T.temporal_phrases(table(spark, d, "fx_laws"), "law_text", "law_id")


def b12_temporal_support(spark, d):
    """Laws with their questions; where every third law's scope says that nothing asks for an effect."""
    laws = table(spark, d, "fx_laws").join(table(spark, d, "fx_questions").select("law_id", F.col("q_text").alias("question")), "law_id")
    none = F.when(F.col("law_id") % 3 == 0, F.lit(False))
    x = T.temporal_support(laws.withColumns({"asks_effect": none, "has_effect": none}))
    return x.select("law_id", F.array_join(F.array_sort("terms"), "|").alias("terms"), "legal_effect", "needs_support")


def b13_cardinality_language(spark, d):
    t = F.col("law_text")
    return table(spark, d, "fx_laws").select("law_id", C.at_most_one(t).alias("at_most_one"), C.any_one(t).alias("any_one"))


def b15_evidence_snippets(spark, d):
    symbols = table(spark, d, "labels").select(F.lit("worthless_clown").alias("symbol")).union(table(spark, d, "labels").select(F.lit("thatIdiotWith"))).distinct()
    docs = _docs(spark, d)
    pairs = docs.select("doc_id", F.explode(F.array(F.lit("worthless_clown"), F.lit("thatIdiotWith"))).alias("symbol"))
    return T.evidence_snippets(docs, symbols, pairs=pairs)


def b16_evidence_supported(spark, d):
    claims = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.substring("text", 5, 40), " ", "- ")).otherwise(F.concat(F.substring("text", 5, 20), F.lit(" zz"))).alias("quote"))
    return T.evidence_supported(claims, _docs(spark, d), "doc_id", "quote", "text").select("doc_id", "supported")


def b18_has_numeric_evidence(spark, d):
    return _docs(spark, d).select("doc_id", C.has_numeric_evidence(F.col("text")).alias("numeric"))


def b19_invented_values(spark, d):
    claims = _docs(spark, d).select("doc_id", (F.col("doc_id") % 40 + 60).cast("double").alias("value"))
    return T.invented_values(claims, _docs(spark, d), "doc_id", "value", "text")


def b20_seed_entities(spark, d):
    return T.seed_entities(_docs(spark, d))


def b21_question_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(C.question_tokens(F.col("text"))).alias("n"), F.array_join(F.slice(F.array_sort(C.question_tokens(F.col("text"))), 1, 5), " ").alias("first_five"))


def b22_canonical_ids(spark, d):
    return table(spark, d, "pages").select("page_id", C.safe_entity(F.col("url")).alias("entity"), C.safe_value(F.col("page_id").cast("string")).alias("value"))


def b23_ascii_fold(spark, d):
    # every third text begins with letters of mathematics and a ligature
    docs = _docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("𝐀𝔹𝒞②ﬁ"), "text")).otherwise(F.col("text")))
    f = C.ascii_fold(F.col("text"))
    return docs.groupBy("source").agg(F.count_if(f != F.col("text")).alias("changed"), F.sum(F.length(F.regexp_replace(f, r"[^?]", ""))).alias("marks"))


def b25_lexical_match(spark, d):
    hints = table(spark, d, "part").select(F.col("p_partkey").alias("hint_id"), F.regexp_replace("p_name", " ", "_").alias("hint"))
    names = table(spark, d, "part").select(F.regexp_replace("p_name", " ", "_").alias("name"))
    return T.lexical_match(hints, names)


def b25_symbol_match(spark, d):
    """Hints of one word of a name and a word of its type, questions with the other word, every second for consequences."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    asked = F.concat(F.lit("Which "), F.element_at(w, -1), F.when(k % 2 == 0, " if consequences apply?").otherwise(" is it?"))
    hints = table(spark, d, "part").select(k.alias("hint_id"), F.when(k % 9 == 0, "").otherwise(F.concat(w[0], F.lit("_"), F.lower("p_type"))).alias("hint"), F.when(k % 7 != 0, asked).alias("question"))
    n = F.length("p_name")
    names = table(spark, d, "part").select(F.regexp_replace("p_name", " ", "_").alias("name"), F.when(n % 3 == 0, "derived").when(n % 3 == 1, "observable").otherwise("helper").alias("kind"), (n % 5 == 0).alias("background"), (n % 4 == 0).alias("effect")).distinct()
    return T.lexical_match(hints, names, prefer_derived=True)


def b8_scope_text(spark, d):
    """Retrieval only for the questions that cite no chunk: ``scope_text`` asks for no others."""
    cited, chunks = _cited(spark, d), T.chunk_documents(table(spark, d, "fx_laws"))
    open_ = _asked(spark, d).join(cited.select("q_id").distinct(), "q_id", "left_anti")
    return T.scope_text(cited, T.keyword_topk(open_, chunks), chunks, table(spark, d, "fx_questions"))


def b17_evidence_overlap(spark, d):
    return T.evidence_overlap(_docs(spark, d).select("doc_id", F.substring("text", 50, 60).alias("claim")), _docs(spark, d))


def b26_output_category(spark, d):
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "is_").when(k % 4 == 1, "exceeds_threshold_").when(k % 4 == 2, "right_to_").otherwise("x_")
    kind = F.when(k % 3 == 0, "derived").when(k % 3 == 1, "helper").otherwise("observable")
    flag = F.when(k % 10 == 0, True).when(k % 10 == 1, False)
    category = F.when(k % 7 == 0, "Timing ").when(k % 7 == 1, "status").otherwise("")
    return table(spark, d, "part").select("p_partkey", C.output_category(F.concat(head, F.regexp_replace("p_name", " ", "_")), kind, flag, category).alias("category"))


QUERIES = {f.__name__: f for f in (b26_output_category, b8_scope_text, b17_evidence_overlap, b1_chunk_documents, b2_normalize_article, b3_extract_citations, b4_primary_citation, b5_cite_join, b6_expand_cross_refs, b7_keyword_topk, b9_extract_numbers, b10_numbers_summary, b11_tag_cues, b12_temporal_phrases, b12_temporal_support, b13_cardinality_language, b15_evidence_snippets, b16_evidence_supported, b18_has_numeric_evidence, b19_invented_values, b20_seed_entities, b21_question_tokens, b22_canonical_ids, b23_ascii_fold, b25_lexical_match, b25_symbol_match)}

_PARSED = """CASE WHEN contains(t, ',') AND contains(t, '.') THEN CASE WHEN regexp_extract(t, '([.,])[0-9]*$', 1) = ',' THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
 WHEN contains(t, ',') THEN CASE WHEN regexp_matches(t, '^[0-9]+(,[0-9]{3})+$') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END
 WHEN contains(t, '.') THEN CASE WHEN regexp_matches(t, '^[0-9]+\\.[0-9]{1,2}$') THEN t ELSE replace(t, '.', '') END ELSE t END"""
_P1, _P2, _P3 = (p.replace("(?:", "(?:") for p in C.NUMBER_PASSES)
_NUMBERS = f"""SELECT DISTINCT doc_id, CAST(p AS DOUBLE) AS value FROM (SELECT doc_id, {_PARSED} AS p FROM (
 SELECT doc_id, unnest(regexp_extract_all(x, '{_P1}') || regexp_extract_all(x, '{_P2}') || regexp_extract_all(x, '{_P3}')
  || regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(x, '{_P1}', ' ', 'g'), '{_P2}', ' ', 'g'), '{_P3}', ' ', 'g'), '\\b[0-9]{{2,3}}\\b')) AS t
 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\b[0-9]+(?:[:/][0-9]+)+\\b', ' ', 'g') AS x FROM documents))) WHERE regexp_matches(p, '^[0-9]+(\\.[0-9]+)?$')"""
_CIT = """SELECT q_id, concat('1:', q_id % 40 + 1) AS article, CASE q_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS paragraph, CASE WHEN q_id % 4 = 1 THEN 2 END AS point FROM fx_questions WHERE q_id % 4 <> 3"""
_FOLD = [x.replace("'", "''") for x in C.fold_table()]

SQL = {
    "b26_output_category": """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'effect' WHEN p_partkey % 10 = 1 THEN 'classification' WHEN p_partkey % 7 = 0 THEN 'effect' WHEN p_partkey % 7 = 1 THEN 'classification' WHEN p_partkey % 3 = 1 THEN 'intermediate'
 WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 1 THEN 'intermediate' WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 2 THEN 'effect' WHEN p_partkey % 4 = 0 THEN 'classification' ELSE 'none' END AS category FROM part""",
    "b2_normalize_article": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('1.', doc_id % 40, CASE WHEN doc_id % 3 = 0 THEN '.5' ELSE '' END) ELSE concat('1:', doc_id % 40, CASE WHEN doc_id % 3 = 0 THEN ':5' ELSE '' END) END AS article FROM documents""",
    "b3_extract_citations": """WITH c AS (SELECT q_id, concat('1:', q_id % 40 + 1) AS article, CASE q_id % 4 WHEN 0 THEN 2 ELSE 1 END AS paragraph, CASE WHEN q_id % 4 = 1 THEN 2 END AS point, CASE q_id % 4 WHEN 1 THEN 0.95 ELSE 0.9 END AS confidence FROM fx_questions WHERE q_id % 4 <> 3
 UNION ALL SELECT q_id, concat('1:', q_id % 40 + 1), NULL, NULL, 0.75 FROM fx_questions WHERE q_id % 4 <> 3 UNION ALL SELECT q_id, concat('1:', q_id % 40 + 1), 1, NULL, 0.88 FROM fx_questions WHERE q_id % 4 = 1),
 s AS (SELECT *, CASE WHEN point IS NOT NULL THEN 3 WHEN paragraph IS NOT NULL THEN 2 ELSE 1 END AS specificity FROM c)
 SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY specificity DESC, confidence DESC) AS INT) AS rank FROM s""",
    "b4_primary_citation": _CIT,
    "b5_cite_join": f"""SELECT q_id, concat(article, CASE WHEN x = 0 THEN CASE WHEN q_id % 4 = 0 THEN '/p2' ELSE '/p1' END ELSE concat('/p1/pt', x) END) AS chunk_id, CASE WHEN point IS NOT NULL THEN 'point' ELSE 'paragraph' END AS granularity
 FROM ({_CIT}), (VALUES (0), (1), (2)) v(x) WHERE x = 0 OR (q_id % 4 = 1 AND x = 2) OR (q_id % 4 = 2)""",
    "b9_extract_numbers": _NUMBERS,
    "b10_numbers_summary": f"""WITH n AS ({_NUMBERS}), w AS (SELECT doc_id, list_sort(list(CAST(value AS BIGINT))) AS l FROM n WHERE value = floor(value) GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN l IS NULL THEN '(none found)' WHEN len(l) > 12 THEN concat(array_to_string(l[1:12], ', '), ', ...') ELSE array_to_string(l, ', ') END AS summary FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id""",
    "b11_tag_cues": "SELECT law_id, " + ", ".join(f"len(regexp_extract_all(lower(law_text), '{p}')) AS {c}" for c, p in C.CUES.items()) + " FROM fx_laws",
    "b12_temporal_support": f"""WITH q AS (SELECT l.law_id, lower(law_text) AS t, lower(q_text) AS q FROM fx_laws l JOIN fx_questions f ON l.law_id = f.law_id),
 x AS (SELECT law_id, list_sort(list_distinct(flatten([{', '.join(f"regexp_extract_all(t, '{p}') || regexp_extract_all(q, '{p}')" for p in T.PERIOD_PHRASES)}]))) AS terms, law_id % 3 <> 0 AND regexp_matches(t, '{C.CUES["effect"]}') AS e FROM q)
 SELECT law_id, array_to_string(terms, '|') AS terms, e AS legal_effect, e AND len(terms) > 0 AS needs_support FROM x""",
    "b13_cardinality_language": f"""SELECT law_id, a AS at_most_one, b AND NOT a AS any_one FROM (SELECT law_id, {_sql_any("t", C.AT_MOST_ONE)} AS a, {_sql_any("t", C.ANY_ONE)} AS b FROM (SELECT law_id, regexp_replace(lower(law_text), '\\s+', ' ', 'g') AS t FROM fx_laws))""",
    "b16_evidence_supported": """WITH n AS (SELECT doc_id, lower(text) AS t, CASE WHEN doc_id % 2 = 0 THEN lower(replace(substr(text, 5, 40), ' ', '- ')) ELSE lower(substr(text, 5, 20) || ' zz') END AS q FROM documents),
 f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[\\s_–—-]+', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(regexp_replace(q, '[\\s_–—-]+', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS q FROM n)
 SELECT doc_id, q <> '' AND contains(t, q) AS supported FROM f""",
    "b18_has_numeric_evidence": """SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '[0-9]+(?::[0-9]+)+', ' ', 'g'), '\\b[0-9]+(?:[.,][0-9]+)?\\b'), lambda x: NOT regexp_matches(x, '^((19|20)[0-9]{2}|[0-9]{1,2})$'))) > 0 AS numeric FROM documents""",
    "b19_invented_values": f"""SELECT doc_id, CAST(doc_id % 40 + 60 AS DOUBLE) AS value FROM documents d WHERE NOT EXISTS (SELECT 1 FROM ({_NUMBERS}) n WHERE n.doc_id = d.doc_id AND n.value = d.doc_id % 40 + 60)""",
    "b20_seed_entities": f"""WITH w AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 AS pos FROM documents),
 s AS (SELECT doc_id, pos, trim(w, '.,;:!?()[]{{}}"''') AS w FROM w)
 SELECT doc_id, lower(w) AS entity, CAST(min(pos) AS INT) AS first_pos FROM s WHERE regexp_matches(w, '^[A-Z][a-z]+$') AND lower(w) NOT IN ({_sql_in(C.NO_ENTITY)}) GROUP BY doc_id, lower(w)""",
    "b21_question_tokens": f"""WITH t AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ ]+', ' ', 'g'), ' +'), lambda x: length(x) >= 3 AND x NOT IN ({_sql_in(C.QUESTION_STOP)})), lambda x: CASE WHEN suffix(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END)) AS l FROM documents)
 SELECT doc_id, len(l) AS n, array_to_string(list_sort(l)[1:5], ' ') AS first_five FROM t""",
    "b22_canonical_ids": """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)
 SELECT page_id, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'e_' || s ELSE s END AS entity, CAST(page_id AS VARCHAR) AS value FROM s""",
    "b23_ascii_fold": f"""WITH d AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN concat('𝐀𝔹𝒞②ﬁ', text) ELSE text END AS text FROM documents), f AS (SELECT source, text, regexp_replace(translate(text, '{_FOLD[0]}', '{_FOLD[1]}'), '[^\\x00-\\x7F]', '?', 'g') AS f FROM d)
 SELECT source, count(*) FILTER (f <> text) AS changed, CAST(sum(length(regexp_replace(f, '[^?]', '', 'g'))) AS BIGINT) AS marks FROM f GROUP BY source""",
    "b25_symbol_match": f"""WITH h0 AS (SELECT p_partkey AS hint_id, string_split(p_name, ' ') AS w, CASE WHEN p_partkey % 9 = 0 THEN [] ELSE list_distinct([string_split(lower(p_name), ' ')[1], lower(p_type)]) END AS t FROM part),
 h AS (SELECT hint_id, t, hint_id % 2 = 0 AND hint_id % 7 <> 0 AS asks, CASE WHEN hint_id % 7 = 0 THEN [] ELSE list_transform(list_filter(list_distinct([lower(w[-1])] || CASE WHEN hint_id % 2 = 0 THEN ['consequences', 'apply'] ELSE [] END), lambda x: length(x) >= 3 AND x NOT IN ({_sql_in(C.QUESTION_STOP)})), lambda x: CASE WHEN suffix(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END) END AS q FROM h0),
 s AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name, list_distinct(string_split(lower(p_name), ' ')) AS t, CASE length(p_name) % 3 WHEN 0 THEN 0.25 WHEN 1 THEN -0.15 ELSE 0 END AS own, CASE WHEN length(p_name) % 5 = 0 THEN -2 WHEN length(p_name) % 4 = 0 THEN 0.35 ELSE 0 END AS asked FROM part),
 c AS (SELECT hint_id, name, round(CASE WHEN len(h.t) > 0 THEN 2.0 * len(list_intersect(h.t, s.t)) / (len(h.t) + len(s.t)) ELSE 0 END + CAST(0.7 AS DOUBLE) * len(list_intersect(h.q, s.t)) / len(s.t) + CAST(own AS DOUBLE) + CASE WHEN asks THEN CAST(asked AS DOUBLE) ELSE 0 END, 6) AS score FROM h, s)
 SELECT hint_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, name) AS r FROM c WHERE score > 0) WHERE r = 1""",
    "b25_lexical_match": """WITH h AS (SELECT p_partkey AS hint_id, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part), s AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part),
 x AS (SELECT hint_id, len(t) AS nh, unnest(t) AS w FROM h), y AS (SELECT name, len(t) AS ns, unnest(t) AS w FROM s),
 c AS (SELECT hint_id, name, round(2 * count(*) / (nh + ns), 6) AS score FROM x JOIN y USING (w) GROUP BY hint_id, name, nh, ns)
 SELECT hint_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, name) AS r FROM c) WHERE r = 1""",
}
