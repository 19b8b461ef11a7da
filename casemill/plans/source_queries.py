"""Queries of sources and streams on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.functions.lineage import shared_dir
from casemill.plans.fixtures import table
from casemill.sources import readers as R
from casemill.streaming import budget


def _files(spark, rows, bucket, name, wrap="{}"):
    """Rows as JSON files of the shared folder, an array (in ``wrap``) for each bucket of some hundred rows."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    many = rows.groupBy(bucket.alias("bucket")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    head, tail = wrap.split("{}")
    many.withColumn("value", F.concat(F.lit(head), "value", F.lit(tail))).repartition("bucket").write.partitionBy("bucket").text(at)
    return at


def a1_read_runs(spark, d):
    """Documents as case files with two questions each, none for every eleventh; written, and read back."""
    k = F.col("doc_id")
    expected = F.struct(F.lit("boolean").alias("mode"), (k % 2 == 0).cast("string").alias("value"), F.concat(F.lit("because of "), "source").alias("reason"))
    ask = lambda i, e: F.struct(F.concat(F.lit(f"q{i}_"), k).alias("id"), F.concat(F.lit("Does "), F.coalesce("lang", F.lit("it")), F.lit(f" apply {i}?")).alias("text"), e.alias("expected"))
    questions = F.when(k % 11 != 0, F.array(ask(1, expected), ask(2, F.when(k % 3 == 0, expected))))
    law = F.struct(F.concat(F.lit("page_"), k % 400).alias("path"), F.when(k % 4 == 0, F.col("source")).alias("text"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("run_"), k).alias("id"), law.alias("law"), F.struct("text").alias("case"), questions.alias("questions"))
    at = _files(spark, rows, F.expr("int(substring(id, 5)) div 200"), "runs")
    x = R.read_runs(spark, f"{at}/*/*")
    return x.select("run_id", "law_text", "law_path", F.md5(F.coalesce("case_text", F.lit(""))).alias("case_md5"), "q_id", "q_text", "expected.mode", "expected.value", "expected.reason")


def a7_read_manifest(spark, d):
    """The list of runs as files, read back."""
    tags = F.split("phenomena", ",")
    rows = table(spark, d, "fx_manifest").select(F.col("run_id").alias("id"), F.concat("run_id", F.lit("/run.json")).alias("path"), "law_domain", "evaluation_group", "difficulty", tags.alias("phenomena"))
    at = _files(spark, rows, F.expr("int(substring(id, 5)) div 500"), "manifest", '{"runs":{}}')
    return R.read_manifest(spark, f"{at}/*/*").withColumn("phenomena", F.array_join("phenomena", "+"))


def a8_write_reports(spark, d):
    """Matrix, timings and cells written as reports and read back, as rows of (report, key, value)."""
    cells = table(spark, d, "fx_cells")
    matrix = cells.groupBy("strategy").pivot("failure_category", ["completed", "law_compilation"]).agg(F.count(F.lit(1)))
    timings = cells.groupBy("strategy").agg(F.round(F.sum("duration_sec"), 2).cast("decimal(18,2)").alias("elapsed_sec"))
    at = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    R.write_reports(matrix, timings, cells, at)
    csv = lambda name, value: spark.read.option("header", True).csv(f"{at}/{name}").select(F.lit(name).alias("report"), F.col("strategy").alias("key"), F.col(value).alias("value"))
    kept = spark.read.schema("run_id string, strategy string, total long").json(f"{at}/cells").groupBy("strategy").agg(F.concat(F.count("*"), F.lit("/"), F.coalesce(F.sum("total"), F.lit(0))).alias("n"))
    return csv("matrix", "completed").unionByName(csv("timings", "elapsed_sec")).unionByName(kept.select(F.lit("cells").alias("report"), F.col("strategy").alias("key"), F.col("n").alias("value")))


def a2_resolve_law_text(spark, d):
    runs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(" ").alias("law_text"), F.concat(F.lit("page_"), F.col("doc_id") % 400).alias("law_path"))
    laws = table(spark, d, "pages").select(F.concat(F.lit("page_"), "page_id").alias("path"), F.col("html").cast("string").alias("text"))
    return R.resolve_law_text(runs, laws).select("doc_id", "law_text", "law_source")


def a4_flatten_json(spark, d):
    return R.flatten_json(table(spark, d, "events"), "props", "event_id")


def a5_parse_model_json(spark, d):
    said = F.concat(F.lit("Here:\n```json\n"), F.expr("left(props, length(props) - 1)"), F.when(F.col("event_id") % 5 == 0, "").otherwise(",}"), F.lit("\n```"))
    good, bad = R.parse_model_json(table(spark, d, "events").select("event_id", said.alias("said")), "said", "map<string,string>")
    return good.select("event_id", F.lit("good").alias("kind")).unionByName(bad.select("event_id", F.lit("reject").alias("kind")))


def a6_call_stages(spark, d):
    return table(spark, d, "fx_calls").select("call_index", R.stage_of(F.col("stage")).alias("stage"))


def a9_to_prompt_corpus(spark, d):
    return R.to_prompt_corpus(table(spark, d, "conversations"))


def a10_message_text(spark, d):
    t = F.col("text")
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))))
    content = F.when(F.col("turn") % 3 == 0, parts).when(F.col("turn") % 3 == 1, F.lit(None)).otherwise("[]")
    return table(spark, d, "conversations").select("conv_id", "turn", R.message_text(content, F.when(F.col("turn") % 3 == 1, "refused")).alias("text"))


def g7_budget_guard_stream(spark, d):
    """The guard over the given call log as a stream, run to its end into files of the shared folder."""
    given = table(spark, d, "events")
    stream = spark.readStream.schema(given.schema).parquet(f"{d}/events.parquet*")
    cell = (F.concat(F.lit("run_"), F.col("user_id") % 37).alias("run_id"), F.concat(F.lit("strategy_"), F.col("user_id") % 4).alias("strategy"))
    calls = stream.select(*cell, F.col("event_id").alias("call_index"), "ts")
    at, key = f"{shared_dir(spark)}/guard-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        refused = budget.guard(calls, 20, idle_ms=400 * 86_400_000)
        refused.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(refused.schema).parquet(f"{at}/out").select("run_id", "strategy", "first_refused")


def g7_running_usage(spark, d):
    """Running counts over the given call log, as files: each cell's last count."""
    given = table(spark, d, "events")
    stream = spark.readStream.schema(given.schema).parquet(f"{d}/events.parquet*")
    calls = stream.select(F.concat(F.lit("run_"), F.col("user_id") % 37).alias("run_id"), F.concat(F.lit("strategy_"), F.col("user_id") % 4).alias("strategy"))
    at = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/{n}")
    budget.running_usage(calls, 80).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return rows.groupBy("run_id", "strategy").agg(F.max_by("n_calls", "batch").alias("n_calls"), F.max_by("over_limit", "batch").alias("over_limit"))


QUERIES = {f.__name__: f for f in (a1_read_runs, a7_read_manifest, a8_write_reports, a2_resolve_law_text, a4_flatten_json, a5_parse_model_json, a6_call_stages, a9_to_prompt_corpus, a10_message_text, g7_budget_guard_stream, g7_running_usage)}

SQL = {
    "a1_read_runs": """WITH q AS (SELECT *, unnest([1, 2]) AS i FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT *, NULL FROM documents WHERE doc_id % 11 = 0), x AS (SELECT *, i = 1 OR (i = 2 AND doc_id % 3 = 0) AS answered FROM q)
 SELECT concat('run_', doc_id) AS run_id, CASE WHEN doc_id % 4 = 0 THEN source END AS law_text, concat('page_', doc_id % 400) AS law_path, md5(coalesce(text, '')) AS case_md5, 'q' || i || '_' || doc_id AS q_id, 'Does ' || coalesce(lang, 'it') || ' apply ' || i || '?' AS q_text,
  CASE WHEN answered THEN 'boolean' END AS mode, CASE WHEN answered THEN CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END END AS value, CASE WHEN answered THEN 'because of ' || source END AS reason FROM x""",
    "a7_read_manifest": "SELECT run_id, run_id || '/run.json' AS path, law_domain, evaluation_group, difficulty, replace(phenomena, ',', '+') AS phenomena FROM fx_manifest",
    "a8_write_reports": """SELECT 'matrix' AS report, strategy AS key, CAST(count(*) AS VARCHAR) AS value FROM fx_cells WHERE failure_category = 'completed' GROUP BY 2
 UNION ALL SELECT 'timings', strategy, CAST(CAST(round(sum(duration_sec), 2) AS DECIMAL(18, 2)) AS VARCHAR) FROM fx_cells GROUP BY 2 UNION ALL SELECT 'cells', strategy, concat(count(*), '/', CAST(coalesce(sum(total), 0) AS BIGINT)) FROM fx_cells GROUP BY 2""",
    "a2_resolve_law_text": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN text ELSE html END AS law_text,
 CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN 'embedded' WHEN page_id IS NOT NULL THEN 'path' ELSE 'missing' END AS law_source FROM documents LEFT JOIN pages ON page_id = doc_id % 400""",
    "a4_flatten_json": """SELECT event_id, k AS path, json_extract_string(props, k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
    "a5_parse_model_json": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'reject' ELSE 'good' END AS kind FROM events",
    "a6_call_stages": "SELECT call_index, CASE WHEN stage = 'other' THEN 'unknown' ELSE stage END AS stage FROM fx_calls",
    "a9_to_prompt_corpus": """SELECT conv_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) FILTER (role <> 'assistant'), '') AS kb_text, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS expected FROM conversations GROUP BY conv_id""",
    "a10_message_text": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'refused' ELSE '' END AS text FROM conversations",
    "g7_running_usage": "SELECT concat('run_', user_id % 37) AS run_id, concat('strategy_', user_id % 4) AS strategy, count(*) AS n_calls, count(*) > 80 AS over_limit FROM events GROUP BY 1, 2",
    "g7_budget_guard_stream": "SELECT run_id, strategy, first_refused FROM (SELECT concat('run_', user_id % 37) AS run_id, concat('strategy_', user_id % 4) AS strategy, event_id AS first_refused, row_number() OVER (PARTITION BY user_id % 37, user_id % 4 ORDER BY event_id) AS k FROM events) WHERE k = 21",
}
