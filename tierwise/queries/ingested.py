"""Queries of the normalisers of raw outputs, over tables shaped like them, and of files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files, ingest
from .tables import t

def k():
    return F.col("event_id")


def said(n, name, *words):
    """A word by the event's number; null for the last."""
    out = F.element_at(F.array(*[F.lit(w) for w in words]), (k() % n + 1).cast("int"))
    return F.when(k() % n < len(words), out).alias(name)


def events(s, d):
    return t(s, d, "events")


_PICK = lambda n, *words: f"CASE WHEN event_id % {n} < {len(words)} THEN [{', '.join(repr(w) for w in words)}][event_id % {n} + 1] END"
_FAMILY = "CASE WHEN regexp_matches(lower({0}), 'gpt|claude|gemini|llama-3.3-70b|llama_llama') THEN 'LLM' ELSE 'SLM' END"


def _sql(task, example, dataset, model, prediction, reference, metric, valid, latency, text, source="events"):
    return f"SELECT {example} AS example_id, '{task}' AS task, {dataset} AS dataset, {model} AS model_name, {_FAMILY.format(model)} AS model_family, {prediction} AS prediction, {reference} AS reference, round(coalesce({metric}, 0), 6) AS primary_metric, CAST({valid} AS INT) AS valid_output, round({latency}, 6) AS latency_sec, {text} AS input_text FROM {source}"


def shown(df):
    return df.withColumns({"primary_metric": F.round("primary_metric", 6), "latency_sec": F.round("latency_sec", 6)})


def classification(s, d):
    raw = events(s, d).select(k().alias("_pos"), F.lit("ag").alias("dataset"), F.col("props").alias("text"), said(3, "true_label", "a", "b"), said(4, "prediction", "a", "b", "c"), F.col("value").alias("latency"), F.when(k() % 5 != 0, k() % 2 == 0).alias("is_valid"))
    return shown(ingest.classification(raw, "gpt-x"))


def text_generation(s, d):
    metrics = F.struct(F.struct(F.col("value").alias("total_time")).alias("operational"), F.struct(F.struct(F.when(k() % 3 != 0, k() % 10 / 10).alias("constraint_satisfaction_rate")).alias("instruction_following")).alias("framework"))
    raw = events(s, d).select(k().alias("_pos"), F.when(k() % 4 != 0, k().cast("int")).alias("task_id"), F.col("event_type").alias("task_type"), F.col("props").alias("response"), F.lit("ref").alias("reference"), F.col("event_type").alias("prompt"), metrics.alias("metrics"))
    return shown(ingest.text_generation(raw, "qwen"))


def summarization(s, d):
    raw = events(s, d).select(k().cast("string").alias("sample_id"), F.col("props").alias("generated_summary"), F.col("event_type").alias("reference_summary"), F.col("props").alias("article"), F.col("value").alias("latency_seconds"), F.when(k() % 3 != 0, k() % 10 / 10).alias("rouge_1_f1"), F.when(k() % 4 != 0, (k() % 2).cast("int")).alias("length_violation_flag"))
    return shown(ingest.summarization(raw, "Claude"))


def instruction_following(s, d):
    row = F.struct(F.col("props").alias("instruction"), F.col("event_type").alias("response"), (k() % 4).cast("int").alias("constraints_satisfied"), (k() % 6).cast("int").alias("total_constraints"), F.col("value").alias("latency_sec"), k().alias("k"))
    raw = events(s, d).groupBy((F.col("user_id") % 40).alias("g")).agg(F.sort_array(F.collect_list(F.struct(k(), row.alias("r")))).alias("rs"))
    raw = raw.select(F.concat(F.lit("m"), F.col("g").cast("string")).alias("model"), F.transform("rs", lambda x: x["r"]).alias("responses"))
    return shown(ingest.instruction_following(raw))


def code_generation(s, d):
    raw = events(s, d).select(F.col("event_type").alias("model_name"), F.lit("he").alias("dataset"), k().cast("string").alias("task_id"), F.col("props").alias("generated_code"), F.col("props").alias("prompt"), said(2, "entry_point", "f"), F.when(k() % 3 != 0, k() % 2 == 0).alias("passed"), F.when(k() % 5 != 0, k() % 2 == 1).alias("format_compliant"), F.col("value").alias("latency_seconds"))
    return shown(ingest.code_generation(raw))


def maths(s, d):
    base = F.struct(F.when(k() % 3 != 0, k().cast("string")).alias("request_id"), said(3, "status", "success", "error"), F.col("value").alias("latency"), F.col("event_type").alias("prediction"), said(2, "gold", "view"), F.when(k() % 4 != 0, k() % 2 == 0).alias("correct"))
    rows = events(s, d).groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct(k(), F.struct(F.col("props").alias("question"), base.alias("base")).alias("r")))).alias("rs"))
    raw = rows.select(F.array(F.struct(F.col("event_type").alias("model"), F.lit("gsm").alias("dataset"), F.transform("rs", lambda x: x["r"]).alias("records"))).alias("experiments"))
    return shown(ingest.maths(raw))


def retrieval(s, d):
    row = F.struct(F.when(k() % 3 != 0, k().cast("string")).alias("id"), said(3, "prediction", " Yes", "no"), said(2, "reference", "yes "), F.col("props").alias("context"), F.col("value").alias("latency_sec"))
    rows = events(s, d).groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct(k(), row.alias("r")))).alias("rs"))
    raw = rows.select(F.create_map("event_type", F.transform("rs", lambda x: x["r"])).alias("runs"))
    return shown(ingest.retrieval(raw))


def information_extraction(s, d):
    pair = lambda a, b: F.map_from_arrays(F.array(F.lit("date"), F.lit("total")), F.array(a, b))
    text = lambda c: c.cast("string")
    raw = events(s, d).select(F.lit("gemini").alias("model"), text(k()).alias("doc_id"), F.lit("test").alias("split"), F.col("props").alias("text"), pair(text(k() % 2), F.when(k() % 5 != 0, text(k() % 3))).alias("prediction"), pair(text(k() % 2), F.when(k() % 7 != 0, text(k() % 3))).alias("reference_fields"), F.when(k() % 4 != 0, k() % 2 == 0).alias("schema_valid"), F.col("value").alias("latency_seconds"), F.array(F.lit("date"), F.lit("total")).alias("required_fields"))
    return shown(ingest.information_extraction(raw).withColumns({"prediction": F.md5("prediction"), "reference": F.md5("reference")}))


_IN = lambda by: f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY event_id) - 1 AS i FROM events)"
_KV = lambda n: f"'{{\"date\":\"' || (event_id % 2) || '\"' || ',\"total\":' || CASE WHEN event_id % {n} <> 0 THEN '\"' || (event_id % 3) || '\"' ELSE 'null' END || '}}'"


def csv_back(s, d):
    at = files.scratch(s)
    files.write_csv(t(s, d, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))), at, ["c_custkey", "c_name", "c_acctbal"])
    return files.read_csv(s, at, "c_custkey long, c_name string, c_acctbal double")


def jsonl_back(s, d):
    at = files.scratch(s)
    files.write_jsonl(t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(1).alias("_hidden")), at, ["c_nationkey"])
    return files.read_jsonl(s, at, "c_custkey long, c_name string, c_nationkey int").select("c_custkey", "c_name")


def lenient(s, d):
    at = files.scratch(s)
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("{broken")).when(F.col("o_orderkey") % 3 == 1, F.lit("")).otherwise(F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    t(s, d, "orders").select(line.alias("value")).write.text(at)
    return files.read_jsonl(s, at, "o_orderkey long, o_orderstatus string", strict=False).where("o_orderkey is not null")


def splits_back(s, d):
    at = files.scratch(s)
    e = events(s, d).select("event_id", F.col("event_type").alias("a"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("b"))
    # Folders named as the tasks and models, one file each.
    pairs = [(a, b) for a in ("view", "click") for b in ("m0", "m1", "m2")]
    for a, b in pairs:
        e.where(f"a = '{a}' and b = '{b}'").select(F.to_json(F.struct("event_id")).alias("value")).coalesce(1).write.text(f"{at}/raw/{a}/{b}")
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(at).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for a, b in pairs:
        part = next(f.getPath() for f in system.listStatus(path(f"{at}/raw/{a}/{b}")) if f.getPath().getName().startswith("part-"))
        system.mkdirs(path(f"{at}/in/{a}/{b}"))
        system.rename(part, path(f"{at}/in/{a}/{b}/train.jsonl"))
    out = system.create(path(f"{at}/in/view/split_query_ids.json"))
    out.writeBytes("{}")
    out.close()
    rows = files.read_splits(s, f"{at}/in", "event_id long", exclude=("m2",))
    return files.with_file(rows, f"{at}/in", "split_query_ids.json")


def first_text(s, d):
    p = t(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("text"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("query"), "p_size")
    return p.select("p_partkey", files.first_text(p.select("text", "query", "p_size")).alias("x"))


QUERIES = {
    "ingest_classification": (classification, _sql("classification", "'cls_' || event_id", "'ag'", "'gpt-x'", _PICK(4, "a", "b", "c"), _PICK(3, "a", "b"), f"({_PICK(4, 'a', 'b', 'c')} = {_PICK(3, 'a', 'b')})::INT", "CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 0 ELSE true END", "value", "props")),
    "ingest_text_generation": (text_generation, _sql("text_generation", "CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR ELSE 'tg_' || event_id END", "event_type", "'qwen'", "props", "'ref'", "CASE WHEN event_id % 3 <> 0 THEN event_id % 10 / 10 END", "1", "value", "event_type")),
    "ingest_summarization": (summarization, _sql("summarization", "event_id::VARCHAR", "NULL::VARCHAR", "'Claude'", "props", "event_type", "CASE WHEN event_id % 3 <> 0 THEN event_id % 10 / 10 END", "CASE WHEN event_id % 4 <> 0 THEN event_id % 2 = 0 ELSE true END", "value", "props")),
    "ingest_instruction_following": (instruction_following, _sql("instruction_following", "'if_' || i", "NULL::VARCHAR", "'m' || (user_id % 40)", "event_type", "NULL::VARCHAR", "(event_id % 4) / greatest(1, event_id % 6)", "1", "value", "props", _IN("user_id % 40"))),
    "ingest_code_generation": (code_generation, _sql("code_generation", "event_id::VARCHAR", "'he'", "event_type", "props", _PICK(2, "f"), "CASE WHEN event_id % 3 <> 0 THEN (event_id % 2 = 0)::INT END", "CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 1 ELSE false END", "value", "props")),
    "ingest_maths": (maths, _sql("maths", "CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR ELSE 'math_' || i END", "'gsm'", "event_type", "event_type", _PICK(2, "view"), "CASE WHEN event_id % 4 <> 0 THEN (event_id % 2 = 0)::INT END", f"{_PICK(3, 'success', 'error')} = 'success'", "value", "props", _IN("event_type"))),
    "ingest_retrieval": (retrieval, _sql("retrieval_grounded", "CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR ELSE 'rag_' || i END", "NULL::VARCHAR", "event_type", _PICK(3, " Yes", "no"), _PICK(2, "yes "), f"(lower(trim({_PICK(3, ' Yes', 'no')})) = lower(trim({_PICK(2, 'yes ')})))::INT", "1", "value", "props", _IN("event_type"))),
    "ingest_information_extraction": (information_extraction, _sql("information_extraction", "event_id::VARCHAR", "'test'", "'gemini'", f"md5({_KV(5)})", f"md5({_KV(7)})", "((event_id % 5 = 0 AND event_id % 7 = 0) OR (event_id % 5 <> 0 AND event_id % 7 <> 0))::INT", "CASE WHEN event_id % 4 <> 0 THEN event_id % 2 = 0 ELSE false END", "value", "props")),
    "csv_round_trip": (csv_back, "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, c_acctbal FROM customer"),
    "jsonl_round_trip": (jsonl_back, "SELECT c_custkey, c_name FROM customer"),
    "jsonl_lenient": (lenient, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 2"),
    "split_files": (splits_back, "SELECT event_id, event_type AS task, 'm' || (user_id % 3) AS model, 'train' AS split FROM events WHERE event_type = 'view' AND user_id % 3 < 2"),
    "first_text_field": (first_text, "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN trim(p_name) WHEN p_partkey % 2 = 0 THEN trim(p_brand) ELSE concat_ws(' ', '  ', p_size::VARCHAR) END AS x FROM part"),
    "use_case_rows": (lambda s, d: files.use_case_rows(t(s, d, "documents").withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("  ")), "text", "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND trim(text, ' ') <> '' ORDER BY doc_id LIMIT 500"),
    "canonical_ids": (lambda s, d: events(s, d).select("event_id", X.canonical_id(F.col("event_type"), F.when(k() % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("q_00"), k().cast("string"))), True).alias("a"), X.canonical_id(F.col("event_type"), F.concat(F.lit("q_00"), k().cast("string")), False).alias("b"), X.model_family(F.concat(F.when(k() % 2 == 0, "GPT-").otherwise("qwen-"), k().cast("string"))).alias("family"), X.dominant_dimension(F.when(k() % 2 == 0, "maths").otherwise("other")).alias("dim")), "SELECT event_id, event_type || ':' || CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'q_' || event_id END AS a, event_type || ':' || event_id AS b, CASE WHEN event_id % 2 = 0 THEN 'LLM' ELSE 'SLM' END AS family, CASE WHEN event_id % 2 = 0 THEN 'R_hat' ELSE 'n_in' END AS dim FROM events"),
}
