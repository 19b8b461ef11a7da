"""Sources and sinks: case files, manifests, call logs, semi-structured columns, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.lineage import settle

RUN = "id string, law struct<path:string,text:string>, case struct<text:string>, questions array<struct<id:string,text:string,expected:struct<mode:string,value:string,reason:string>>>"
CALL = "timestamp timestamp, call_index long, stage string, run_id string, strategy string, provider string, model string, prompt_tokens long, completion_tokens long, total_tokens long, cost_usd double, error string"
MANIFEST = "runs array<struct<id:string,path:string,law_domain:string,evaluation_group:string,difficulty:string,phenomena:array<string>>>"
#: Stages of a call log; others are read as unknown.
STAGES = ("kb_symbols", "kb_rules", "case_extraction", "query_extraction", "translation", "rendering")


def read_runs(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """A1: case files to one row per question; an id that no file has is an error."""
    raw = spark.read.schema(RUN).json(path, multiLine=True)
    if ids is not None:
        wanted = spark.createDataFrame([(i,) for i in ids], "id string")
        missing = [r["id"] for r in wanted.join(raw.select("id"), "id", "left_anti").limit(20).collect()]
        if missing:
            raise ValueError(f"unknown run ids: {', '.join(sorted(missing))}")
        raw = raw.join(wanted, "id", "left_semi")
    q = raw.select(F.col("id").alias("run_id"), F.col("law.text").alias("law_text"), F.col("law.path").alias("law_path"), F.col("case.text").alias("case_text"), F.explode_outer("questions").alias("q"))
    return q.select("run_id", "law_text", "law_path", "case_text", F.col("q.id").alias("q_id"), F.col("q.text").alias("q_text"), F.col("q.expected").alias("expected"))


def resolve_law_text(runs: DataFrame, laws: DataFrame) -> DataFrame:
    """A2: the embedded text, else the text at the path (laws(path, text)), else none; a path is no text."""
    x = runs.join(laws.select(F.col("path").alias("law_path"), F.col("text").alias("_t")), "law_path", "left")
    own = F.when(F.trim("law_text") != "", F.col("law_text"))
    source = F.when(own.isNotNull(), "embedded").when(F.col("_t").isNotNull(), "path").otherwise("missing")
    return x.withColumns({"law_source": source, "law_text": F.coalesce(own, "_t")}).drop("_t")


def read_text_runs(spark: SparkSession, path: str) -> DataFrame:
    """A3: folders with law.txt, case.txt and questions.txt to one row per non-empty question line."""
    f = spark.read.text(f"{path}/*/*.txt", wholetext=True).withColumn("f", F.input_file_name())
    f = f.withColumns({"run_id": F.regexp_extract("f", r"([^/]+)/[^/]+$", 1), "part": F.regexp_extract("f", r"([^/]+)\.txt$", 1)})
    w = f.groupBy("run_id").agg(*[F.max(F.when(F.col("part") == p, F.col("value"))).alias(p) for p in ("law", "case", "questions")])
    q = w.select("run_id", F.col("law").alias("law_text"), F.col("case").alias("case_text"), F.posexplode(F.split("questions", r"\r?\n")).alias("pos", "line"))
    return q.filter(F.trim("line") != "").select("run_id", "law_text", "case_text", "pos", F.trim("line").alias("q_text"))


def flatten_json(df: DataFrame, col: str, key: str) -> DataFrame:
    """A4: every key path of a JSON column with its value, one level a round until nothing is nested; null where it isn't JSON."""
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(col).alias("v"))
    leaves = []
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    while True:
        level.createOrReplaceTempView("_flatten_level")
        kids = df.sparkSession.sql(f"SELECT {key}, path, pos, key AS k, value AS v FROM _flatten_level, LATERAL variant_explode(v)")
        level = kids.select(key, F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.coalesce("k", F.col("pos").cast("string"))).alias("path"), "v")
        leaves.append(level.filter(~nested).select(key, "path", F.col("v").cast("string").alias("value")))
        level = settle(level.filter(nested))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def find_string(flat: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A4: per row the first value wanted: a last path segment before a path that only contains a name."""
    last = F.element_at(F.split(F.lower("path"), r"\."), -1)
    exact = F.array_position(F.array(*[F.lit(n) for n in names]), last)
    fuzzy = reduce(lambda a, b: a | b, [F.lower("path").contains(n) for n in names])
    rank = F.when(exact > 0, exact).when(fuzzy, 1000)
    return flat.withColumn("r", rank).filter("r is not null and value is not null").groupBy(key).agg(F.min(F.struct("r", "path", "value")).alias("m")).select(key, "m.path", "m.value")


def json_text(col: Column) -> Column:
    """A5: the JSON object in a model's answer: code fence and talk dropped, trailing commas removed."""
    body = F.regexp_extract(F.coalesce(col, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def parse_model_json(df: DataFrame, col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A5: rows whose answer parses with ``schema`` (column parsed), and the others."""
    own = df.withColumn("_ok", F.try_parse_json(json_text(F.col(col))).isNotNull() & (json_text(F.col(col)) != ""))
    good = own.filter("_ok").withColumn("parsed", F.from_json(json_text(F.col(col)), schema)).drop("_ok")
    return good, own.filter("not _ok").drop("_ok")


def stage_of(col: Column) -> Column:
    """A known stage, or unknown."""
    return F.when(col.isin(*STAGES), col).otherwise("unknown")


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """Call records, one JSON object a line."""
    return spark.read.schema(CALL).json(path).withColumn("stage", stage_of(F.col("stage")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed run."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("runs").alias("r")).select(F.col("r.id").alias("run_id"), "r.path", "r.law_domain", "r.evaluation_group", "r.difficulty", "r.phenomena")


def write_reports(matrix: DataFrame, timings: DataFrame, cells: DataFrame, path: str) -> None:
    """Wide CSV of the matrix, CSV of timings, JSON of cells by strategy."""
    matrix.write.mode("overwrite").option("header", True).csv(f"{path}/matrix")
    timings.write.mode("overwrite").option("header", True).csv(f"{path}/timings")
    cells.write.mode("overwrite").partitionBy("strategy").json(f"{path}/cells")


def to_prompt_corpus(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One text per run from its turns in order, and the expected answer apart from it."""
    own = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    ask = F.filter("t", lambda x: x["role"] != "assistant")
    said = F.filter("t", lambda x: x["role"] == "assistant")
    return own.select(key, F.array_join(F.transform(ask, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("kb_text"), F.coalesce(F.try_element_at(F.transform(said, lambda x: x["text"]), F.lit(-1)), F.lit("")).alias("expected"))


def message_text(content: Column, refusal: Column) -> Column:
    """A10: text of a message whose content is a JSON string, a list of parts, or empty with a refusal."""
    v = F.try_parse_json(content)
    parts = F.try_variant_get(v, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    return F.coalesce(F.when(parts.isNotNull(), joined), F.try_variant_get(v, "$", "string"), refusal, F.lit(""))
