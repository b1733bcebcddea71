"""Joins that bring scores, thresholds, overrides and policies of a run together."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import num, safe_div
from .governance import DIMENSIONS, policy_override


def routing_signal(rows: DataFrame, baseline: str) -> DataFrame:
    """By (task, model): ids shared with the baseline and those it gets right where the model does not. rows: task, model, sample_id, correct (null: false); one row an id and model."""
    r = rows.withColumn("correct", F.coalesce("correct", F.lit(False)))
    base = r.where(F.col("model") == baseline).select("task", "sample_id", F.col("correct").alias("_base"))
    j = r.where(F.col("model") != baseline).join(base, ["task", "sample_id"])
    g = j.groupBy("task", "model").agg(F.count("*").alias("n_common"), F.count_if(~F.col("correct") & F.col("_base")).alias("n_signal"))
    every = r.where(F.col("model") != baseline).select("task", "model").distinct()
    out = every.join(g, ["task", "model"], "left").na.fill(0, ["n_common", "n_signal"])
    return out.withColumn("signal_rate", safe_div(F.col("n_signal"), F.col("n_common")))


def resolved_limits(artifacts: DataFrame, report: DataFrame, overrides: DataFrame) -> DataFrame:
    """tau_cap and tau_risk of each artifact: from the validation report, else the override, else its own tau.

    artifacts: task, model, seed, tau; report: task, model, seed, tau_cap, tau_risk; overrides: task, model, tau_cap, tau_risk.
    """
    r = report.select("task", "model", "seed", num(F.col("tau_cap")).alias("_rc"), num(F.col("tau_risk")).alias("_rr"))
    o = overrides.select("task", "model", num(F.col("tau_cap")).alias("_oc"), num(F.col("tau_risk")).alias("_or"))
    j = artifacts.join(r, ["task", "model", "seed"], "left").join(o, ["task", "model"], "left")
    return j.withColumns({"tau_cap": F.coalesce("_rc", "_oc", "tau"), "tau_risk": F.coalesce("_rr", "_or", "tau")}).drop("_rc", "_rr", "_oc", "_or")


def with_default(rows: DataFrame, table: DataFrame, columns: list[str], required: bool = True) -> DataFrame:
    """Rows with the columns of their task's entry, else of the entry ``*``. A task without either is an error, or null where not required.

    table: task and columns, a row a task.
    """
    exact = table.where(F.col("task") != "*").select("task", F.struct(*columns).alias("_e"))
    star = table.where(F.col("task") == "*").agg(F.first(F.struct(*columns)).alias("_s"))  # one row
    j = rows.join(exact, "task", "left").crossJoin(F.broadcast(star))
    entry = F.coalesce("_e", "_s")
    if required:
        error = F.raise_error(F.concat(F.lit("no entry and no default for task "), F.coalesce("task", F.lit("null"))))
        # Checked in a column of the result, so that Spark cannot prune it.
        j = j.withColumn("_e", F.when(entry.isNull(), error.cast(j.schema["_e"].dataType)).otherwise(entry))
        entry = F.col("_e")
    return j.select(*rows.columns, *[entry[c].alias(c) for c in columns])


def tier_limits(rows: DataFrame, table: DataFrame, tau1: float = 3.2, tau2: float = 4.0) -> DataFrame:
    """Adds tau1 and tau2 of a row's task, of ``*``, or the defaults; a limit below the other is an error. table: task, tau1, tau2."""
    j = with_default(rows, table, ["tau1", "tau2"], required=False)
    j = j.withColumns({"tau1": F.coalesce("tau1", F.lit(tau1)), "tau2": F.coalesce("tau2", F.lit(tau2))})
    wrong = F.raise_error(F.concat(F.lit("tau2 below tau1 for task "), F.col("task"))).cast("double")
    return j.withColumn("tau2", F.when(F.col("tau2") < F.col("tau1"), wrong).otherwise(F.col("tau2")))


def governed(decisions: DataFrame, policy: DataFrame) -> DataFrame:
    """Decisions under a policy that may only make a tier stricter. decisions: task, tier, gate_reason; policy: task (or ``*``), requested."""
    j = with_default(decisions, policy, ["requested"], required=False)
    out = policy_override(F.col("tier"), F.col("requested"), F.col("gate_reason"))
    return j.select(*[c for c in decisions.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def threshold_rows(thresholds: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the model that a threshold names, by its display name or else its key. thresholds: key, display_name, tau; rows: model_name, and others."""
    t = thresholds.select(F.coalesce("display_name", "key").alias("model_name"), "key", "tau")
    return rows.join(t, "model_name")


def cross_model(artifacts: DataFrame, tests: DataFrame) -> DataFrame:
    """Each artifact with the test rows of the other models of its task. artifacts: task, source_model; tests: task, target_model.

    A join on the task that leaves out one model of few; it grows with models, not with rows squared.
    """
    return tests.join(artifacts, "task").where(F.col("source_model") != F.col("target_model"))


def parameter_grid(spark, grids: dict[str, list], limit: int | None = None) -> DataFrame:
    """All combinations of parameters in order, numbered from 0; ``limit`` takes the first."""
    rows = [(i, *v) for i, v in enumerate(product(*grids.values()))][:limit]
    kind = lambda v: "string" if isinstance(v[0], str) else "double" if any(isinstance(x, float) for x in v) else "long"
    ddl = ", ".join(["run long", *[f"{k} {kind(v)}" for k, v in grids.items()]])
    return spark.createDataFrame([tuple(float(x) if k and "double" == kind(list(grids.values())[k - 1]) else x for k, x in enumerate(r)) for r in rows], ddl)


def default_profile(scores: DataFrame) -> DataFrame:
    """One row with the mean of each dimension, rounded half to even; 3 without any row."""
    return scores.agg(*[F.coalesce(F.bround(F.avg(d), 0).cast("int"), F.lit(3)).alias(d) for d in DIMENSIONS])


def task_config(scores: DataFrame, include_default: bool = True) -> DataFrame:
    """Scores by task, with their mean profile as task ``*``. scores: task and the six dimensions."""
    rows = scores.select("task", *[F.col(d).cast("int").alias(d) for d in DIMENSIONS])
    return default_profile(scores).select(F.lit("*").alias("task"), *DIMENSIONS).unionByName(rows) if include_default else rows


def lane(disqualified: Column, tier: Column) -> Column:
    """What a decision means for operations."""
    return F.when(disqualified, "Stop: disqualified").when(tier == "pure_slm", "SLM primary").when(tier == "hybrid", "Hybrid escalation").when(tier == "llm_only", "LLM only").otherwise("Review required")
