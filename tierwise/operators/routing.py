"""Routing decisions, ratios, consensus tiers and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import clamp01, num

# Thresholds by task family.
FROZEN_TAU = {
    "classification": 0.6667, "code_generation": 0.6667, "information_extraction": 1.0, "instruction_following": 1.0,
    "maths": 0.3333, "retrieval_grounded": 1.0, "summarization": 0.2972, "text_generation": 0.9333,
}
FAMILIES = sorted(FROZEN_TAU)


def tau_of(task: Column, table: dict[str, float] = FROZEN_TAU) -> Column:
    """Threshold of a family; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), task)


def route(p_fail: Column, tau: Column, inclusive: bool = False) -> Column:
    """SLM below the threshold (or at it, where inclusive), else LLM."""
    return F.when(p_fail <= tau if inclusive else p_fail < tau, "SLM").otherwise("LLM")


def ratio(routes: Column) -> Column:
    return F.coalesce(F.avg(F.when(routes == "SLM", 1.0).otherwise(0.0)), F.lit(0.0))


def tier(rho: Column, slm: float = 0.5, llm: float = 0.3, inclusive_llm: bool = False) -> Column:
    return F.when(rho >= slm, "SLM").when(rho <= llm if inclusive_llm else rho < llm, "LLM").otherwise("HYBRID")


def consensus(df: DataFrame, task: str, model: str, route_col: str) -> DataFrame:
    """Ratio by model, then the unweighted mean over a task's models, and its tier."""
    per = df.groupBy(task, model).agg(ratio(F.col(route_col)).alias("rho"), F.count("*").alias("n"))
    out = per.groupBy(task).agg(F.avg("rho").alias("rho_bar"), F.count("*").alias("n_models"), F.sum("n").alias("n_queries"))
    return out.withColumn("tier", tier(F.col("rho_bar")))


def sweep(entities: DataFrame, rho: str, grid: list[float]) -> DataFrame:
    """Tiers of each entity for each pair llm < slm of a grid of fixed size, expanded in the row."""
    pairs = [F.struct(F.lit(i).alias("ord"), F.lit(s).alias("slm"), F.lit(l).alias("llm")) for i, (s, l) in enumerate((s, l) for s in grid for l in grid if l < s)]  # noqa: E741
    g = entities.withColumn("_g", F.explode(F.array(*pairs))).select("*", "_g.*").drop("_g")
    t = F.when(F.col(rho) >= F.col("slm"), "SLM").when(F.col(rho) <= F.col("llm"), "LLM").otherwise("HYBRID")
    return g.withColumn("tier", t)


def frozen_taus(families: DataFrame, validation: DataFrame, tests: DataFrame) -> DataFrame:
    """A threshold for each family, from 0 to 1: (task, tau).

    Mean over validation rows that are strict-feasible and pass the calibration gate, else over test runs, else over
    all validation rows, else 0.5. families: task; validation: task, tau, source, passed; tests: task, tau.
    Rows without a number count for nothing.
    """
    strict = (F.lower(F.col("passed").cast("string")) == "true") & (F.col("source") == "strict_feasible_max")
    v = validation.select(F.trim("task").alias("task"), num(F.col("tau")).alias("x"), strict.alias("s"))
    v = v.groupBy("task").agg(F.avg(F.when(F.col("s"), F.col("x"))).alias("_strict"), F.avg("x").alias("_all"))
    r = tests.select(F.trim("task").alias("task"), num(F.col("tau")).alias("x")).groupBy("task").agg(F.avg("x").alias("_test"))
    tau = F.coalesce("_strict", "_test", "_all", F.lit(0.5))
    return families.select("task").join(v, "task", "left").join(r, "task", "left").select("task", clamp01(tau).alias("tau"))
