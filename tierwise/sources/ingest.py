"""Normalisers from raw model outputs to one canonical table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_family

COLUMNS = ("example_id", "task", "dataset", "model_name", "model_family", "prediction", "reference", "primary_metric", "valid_output", "latency_sec", "input_text")


def canonical(df: DataFrame, task: str, **cols: Column) -> DataFrame:
    """Fills in what a source lacks: null texts, metric 0.0, valid 1."""
    name = cols.get("model_name", F.lit(None).cast("string"))
    base = {c: F.lit(None).cast("string") for c in COLUMNS} | {"task": F.lit(task), "model_family": model_family(name), "valid_output": F.lit(1), "latency_sec": F.lit(None).cast("double")}
    base |= cols | {"primary_metric": F.coalesce(cols["primary_metric"].cast("double"), F.lit(0.0))}
    return df.select(*[base[c].alias(c) for c in COLUMNS])


def flag(c: Column, default: bool) -> Column:
    return F.coalesce(c, F.lit(default)).cast("int")


def classification(df: DataFrame, model: str) -> DataFrame:
    hit = (F.col("prediction") == F.col("true_label")).cast("double")
    return canonical(df, "classification", example_id=F.concat(F.lit("cls_"), F.col("_pos").cast("string")), dataset=F.col("dataset"), model_name=F.lit(model), prediction=F.col("prediction"), reference=F.col("true_label"), primary_metric=hit, valid_output=flag(F.col("is_valid"), True), latency_sec=F.col("latency"), input_text=F.col("text"))


def text_generation(df: DataFrame, model: str) -> DataFrame:
    m = F.col("metrics")
    return canonical(df, "text_generation", example_id=F.coalesce(F.col("task_id").cast("string"), F.concat(F.lit("tg_"), F.col("_pos").cast("string"))), dataset=F.col("task_type"), model_name=F.lit(model), prediction=F.col("response"), reference=F.col("reference"), primary_metric=m["framework"]["instruction_following"]["constraint_satisfaction_rate"], latency_sec=m["operational"]["total_time"], input_text=F.col("prompt"))


def summarization(df: DataFrame, model: str) -> DataFrame:
    valid = (F.coalesce("length_violation_flag", F.lit(0)) == 0).cast("int")
    return canonical(df, "summarization", example_id=F.col("sample_id"), model_name=F.lit(model), prediction=F.col("generated_summary"), reference=F.col("reference_summary"), primary_metric=F.col("rouge_1_f1"), valid_output=valid, latency_sec=F.col("latency_seconds"), input_text=F.col("article"))


def instruction_following(df: DataFrame) -> DataFrame:
    r = df.select("model", F.posexplode("responses").alias("i", "r"))
    score = F.col("r.constraints_satisfied") / F.greatest(F.lit(1), F.col("r.total_constraints"))
    return canonical(r, "instruction_following", example_id=F.concat(F.lit("if_"), F.col("i").cast("string")), model_name=F.col("model"), prediction=F.col("r.response"), primary_metric=score, latency_sec=F.col("r.latency_sec"), input_text=F.col("r.instruction"))


def code_generation(df: DataFrame) -> DataFrame:
    return canonical(df, "code_generation", example_id=F.col("task_id"), dataset=F.col("dataset"), model_name=F.col("model_name"), prediction=F.col("generated_code"), reference=F.col("entry_point"), primary_metric=F.col("passed").cast("double"), valid_output=flag(F.col("format_compliant"), False), latency_sec=F.col("latency_seconds"), input_text=F.col("prompt"))


def maths(df: DataFrame) -> DataFrame:
    e = df.select(F.explode("experiments").alias("e")).select("e.model", "e.dataset", F.posexplode("e.records").alias("i", "r"))
    b = F.col("r.base")
    return canonical(e, "maths", example_id=F.coalesce(b["request_id"], F.concat(F.lit("math_"), F.col("i").cast("string"))), dataset=F.col("dataset"), model_name=F.col("model"), prediction=b["prediction"], reference=b["gold"], primary_metric=b["correct"].cast("double"), valid_output=(b["status"] == "success").cast("int"), latency_sec=b["latency"], input_text=F.col("r.question"))


def retrieval(df: DataFrame) -> DataFrame:
    m = df.select(F.explode("runs").alias("model", "rows")).select("model", F.posexplode("rows").alias("i", "r"))
    hit = (F.lower(F.trim("r.prediction")) == F.lower(F.trim("r.reference"))).cast("double")
    return canonical(m, "retrieval_grounded", example_id=F.coalesce(F.col("r.id"), F.concat(F.lit("rag_"), F.col("i").cast("string"))), model_name=F.col("model"), prediction=F.col("r.prediction"), reference=F.col("r.reference"), primary_metric=hit, latency_sec=F.col("r.latency_sec"), input_text=F.col("r.context"))


def information_extraction(df: DataFrame) -> DataFrame:
    # In a column of its own: inside the final select a lambda would take the name for the new string column.
    same = F.forall("required_fields", lambda f: F.try_element_at("prediction", f).eqNullSafe(F.try_element_at("reference_fields", f)))
    d = df.withColumn("_same", same)
    return canonical(d, "information_extraction", example_id=F.col("doc_id"), dataset=F.col("split"), model_name=F.col("model"), prediction=F.to_json("prediction"), reference=F.to_json("reference_fields"), primary_metric=F.col("_same").cast("double"), valid_output=flag(F.col("schema_valid"), False), latency_sec=F.col("latency_seconds"), input_text=F.col("text"))
