"""File sources and sinks, the windowed stream, and plans."""

import json

import pytest
from pyspark.sql import functions as F

from casemill.plans.fixtures import table
from casemill.plans.registry import QUERIES
from casemill.sources import readers as R
from casemill.streaming import budget


def test_runs_and_manifest(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    for i in (1, 2):
        run = {"id": f"r{i}", "law": {"text": "law" if i == 1 else "", "path": "p.txt"}, "case": {"text": "c"}, "questions": [{"id": "q1", "text": "a?", "expected": {"mode": "bool", "value": "true"}}, {"id": "q2", "text": "b?"}]}
        (tmp_path / "runs" / f"{i}.json").write_text(json.dumps(run, indent=1))
    runs = R.read_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 4 and R.read_runs(spark, str(tmp_path / "runs"), ["r1"]).count() == 2
    with pytest.raises(ValueError, match="r9"):
        R.read_runs(spark, str(tmp_path / "runs"), ["r9"])
    laws = spark.createDataFrame([("p.txt", "from the path")], "path string, text string")
    got = {(r.run_id, r.law_source, r.law_text) for r in R.resolve_law_text(runs, laws).collect()}
    assert got == {("r1", "embedded", "law"), ("r2", "path", "from the path")}
    (tmp_path / "m.json").write_text(json.dumps({"runs": [{"id": "r1", "law_domain": "tax", "phenomena": ["a", "b"]}]}))
    assert R.read_manifest(spark, str(tmp_path / "m.json")).first().phenomena == ["a", "b"]


def test_text_runs(spark, tmp_path):
    d = tmp_path / "x" / "run1"
    d.mkdir(parents=True)
    for n, t in (("law", "L"), ("case", "C"), ("questions", "one?\n\n two?\n")):
        (d / f"{n}.txt").write_text(t)
    assert [(r.run_id, r.law_text, r.q_text) for r in R.read_text_runs(spark, str(tmp_path / "x")).orderBy("pos").collect()] == [("run1", "L", "one?"), ("run1", "L", "two?")]


def test_call_log_and_reports(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"call_index": 1, "stage": "kb_rules"}\n{"call_index": 2, "stage": "mystery"}\n')
    assert [r.stage for r in R.read_call_log(spark, str(tmp_path / "log.json")).orderBy("call_index").collect()] == ["kb_rules", "unknown"]
    cells = spark.createDataFrame([("r", "s1", 1.5)], "run_id string, strategy string, duration_sec double")
    R.write_reports(cells, cells, cells, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/cells")).first().strategy == "s1"


def test_find_string(spark):
    flat = R.flatten_json(spark.createDataFrame([(1, '{"a": {"my_text": "x", "text": "y"}, "b": [1, {"c": "z"}]}')], "id long, j string"), "j", "id")
    assert {(r.path, r.value) for r in flat.collect()} == {("a.my_text", "x"), ("a.text", "y"), ("b.0", "1"), ("b.1.c", "z")}
    assert R.find_string(flat, "id", ["text"]).first().value == "y"


def test_windowed_stream_drops_nothing_in_order(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("run_id", F.concat(F.lit("run_"), F.col("user_id") % 37))
    q = budget.windowed_usage(s).writeStream.outputMode("append").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), F.concat(F.lit("run_"), F.col("user_id") % 37).alias("run_id")).agg(F.count("*").alias("n_calls")).select(F.col("w.start").alias("start"), "run_id", "n_calls")
    out = spark.table("windowed")
    assert out.count() > 0 and out.exceptAll(batch).isEmpty()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["g5_run_strategy_usage"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x or "FileScan" in x)
    assert "props" not in scan.split("ReadSchema")[-1]
