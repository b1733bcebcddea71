"""End-to-end plan: documents to failure scores, routes, ratios and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..operators.routing import FAMILIES, consensus, route, tau_of

MODELS = ("qwen_0.5b", "qwen_3b", "qwen_7b")


def scored_documents(docs: DataFrame) -> DataFrame:
    """A row per document and model: family by id, difficulty by min-max length within the family."""
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.pmod("doc_id", F.lit(len(FAMILIES))) + 1).cast("int"))
    d = docs.select("doc_id", family.alias("task"), token_count(F.col("text")).alias("n_in"))
    bounds = d.groupBy("task").agg(F.min("n_in").alias("lo"), F.max("n_in").alias("hi"))
    d = d.join(F.broadcast(bounds), "task")  # a row per task family: eight at most
    score = F.when(F.col("hi") <= F.col("lo"), 0.5).otherwise((F.col("n_in") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k / 10.0).alias("ease")) for k, m in enumerate(MODELS)])).alias("m")
    return d.select("doc_id", "task", "n_in", score.alias("score"), models).select("doc_id", "task", "n_in", F.col("m.model").alias("model"), F.greatest(F.lit(0.0), F.col("score") - F.col("m.ease")).alias("p_fail"))


def consensus_plan(docs: DataFrame) -> DataFrame:
    routed = scored_documents(docs).withColumn("route", route(F.col("p_fail"), tau_of(F.col("task")) / 8.0))
    return consensus(routed, "task", "model", "route")
