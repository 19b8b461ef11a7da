"""Every contract query on a given table: its columns, types and what holds of each row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from casemill.llm.common import table
from casemill.llm.queries import QUERIES

COLUMNS = {
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op4_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_approximate_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_quality_classifier": "doc_id bigint, score double, kept boolean",
    "op10_temperature_mixing": "doc_id bigint, source string, epoch int, block int",
}


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return {r.doc_id: (r.text or "", r.lang) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, given, name):
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        column, kind = c.split(" ")
        assert kinds[column] == kind, c
    rows = df.collect()
    if "doc_id" in kinds:
        assert {r.doc_id for r in rows} == set(given)
    if "held_out" in kinds:
        mod, at = {"op4_lm_scoring": (10, 0), "op5_language_id": (4, 2), "op9_toxicity": (5, 0)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == at) for r in rows)
    if name == "op5_language_id":
        held = [r for r in rows if r.held_out and given[r.doc_id][1] and r.lang_pred != "und"]
        assert sum(r.lang_pred == given[r.doc_id][1] for r in held) >= 0.95 * len(held)
    if name == "op6_suffix_array_dedup":
        assert all(r.kept_sha256 == hashlib.sha256(given[r.doc_id][0].encode()).hexdigest() for r in rows if not r.n_removed)
    if name == "op4_lm_scoring":
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    if name == "op1_best_fit_packing":
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 1024
    if name == "op7_approximate_nearest_neighbours":
        x = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull()).collect()}
        for r in rows[:200]:
            assert abs(r.score - sum(float(a) * float(b) for a, b in zip(x[r.query_id], x[r.vec_id], strict=True))) < 1e-12
