"""Queries of this subpackage by name, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casemill.llm import sql
from casemill.llm.op01_packing import op1_best_fit_packing
from casemill.llm.op02_embedding import op2_embedding_near_dedup
from casemill.llm.op03_quality import op3_quality_classifier
from casemill.llm.op04_lm import op4_lm_scoring
from casemill.llm.op05_langid import op5_language_id
from casemill.llm.op06_suffix import op6_suffix_array_dedup
from casemill.llm.op07_ann import op7_approximate_nearest_neighbours
from casemill.llm.op08_minhash import op8_minhash_near_dedup
from casemill.llm.op09_toxicity import op9_toxicity
from casemill.llm.op10_mixing import op10_temperature_mixing
from casemill.llm.op11_runs import op11_periodic_runs
from casemill.llm.op12_conversations import op12_conversation_repair
from casemill.llm.op13_windows import op13_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_embedding_near_dedup,
        op3_quality_classifier,
        op4_lm_scoring,
        op5_language_id,
        op6_suffix_array_dedup,
        op7_approximate_nearest_neighbours,
        op8_minhash_near_dedup,
        op9_toxicity,
        op10_temperature_mixing,
        op11_periodic_runs,
        op12_conversation_repair,
        op13_substring_dedup,
    )
}

#: Other exact comparisons are quadratic in plain SQL or, like tokenisation, models and signatures, not in SQL's reach
#: on whole tables: those queries are tested against brute force on small fixtures instead.
ORACLE_SQL: dict[str, str] = {"op11_periodic_runs": sql.OP11, "op12_conversation_repair": sql.OP12, "op13_substring_dedup": sql.OP13}
