"""A corpus pipeline: language ID, near and exact deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a
table with the columns of ``documents`` (the last returns packed pieces). Null ids and texts are carried
by each operator as its module defines; near duplicates are found among rows, whatever their ids; a document
without text is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import op01_packing, op05_langid, op06_suffix, op08_minhash, op10_mixing
from casemill.llm.common import cut, table

#: Share of a text's n-grams that its language must contain.
LEAST_KNOWN = 0.3
#: How often the smallest sources may be read.
MAX_REPETITION = 2.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    del spark, sf_dir
    filters = op05_langid.train(docs)
    found = op05_langid.identify(docs, filters)
    return found.filter((F.col("lang_pred") != op05_langid.UNKNOWN) & (F.col("known") >= LEAST_KNOWN)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (5-word shingles, Jaccard of at least 0.8)."""
    del spark, sf_dir
    rows = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")))
    texts = rows.select("key", F.col("row.text").alias("text"))
    groups = op08_minhash.near_duplicates(texts, id_col="key", width=5, percent=80).select(F.col("doc_id").alias("key"), "component_id")
    # the least id stays; rows without one come last, and the text decides before the place in the table does
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row.text"), "key")
    kept = groups.join(rows.select("key", order.alias("order")), "key").groupBy("component_id").agg(F.min_by("key", "order").alias("key")).select("key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings leave the texts; what is left empty goes."""
    del spark, sf_dir
    found = op06_suffix.remove_repeats(docs).select("row", "kept_text")
    text = F.coalesce("kept_text", "row.text")
    size = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    changed = {"text": text, "n_chars": size}
    return found.filter(text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) != "")).select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again up to the limit of repetition."""
    del spark, sf_dir
    return op10_mixing.mix(docs, max_repetition=MAX_REPETITION).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences."""
    del spark, sf_dir
    return op01_packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("temperature_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither tokenisation nor the language model: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
