"""Risk of single samples, and threshold searches over grids, bins and single scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import clamp01, num
from .carried import isotonic
from .curves import adaptive_tau, fixed_tau, prefix_curve, width_curve

# Risk by task, factors by category of failure, and capability of the baseline by task.
TASK_RISK = {"classification": 0.56, "maths": 0.855, "code_generation": 0.9025, "instruction_following": 0.525, "information_extraction": 0.60, "retrieval_grounded": 0.68, "summarization": 0.2475, "text_generation": 0.18}
CATEGORY_FACTOR = {
    "logic_error": 1.00, "arithmetic_error": 1.10, "runtime_error": 1.15, "constraint_violation": 0.95, "wrong_label": 0.90, "answer_mismatch": 0.90,
    "missing_field": 0.85, "low_relevance": 0.80, "incomplete_output": 0.75,
}


def looked_up(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def severity(*scores: Column) -> Column:
    """The first number among the scores, in fifths where over 1, from 0 to 1; 1 without any."""
    first = F.coalesce(*[num(c) for c in scores])
    return F.when(first.isNull(), 1.0).otherwise(clamp01(F.when(first > 1, first / 5).otherwise(first)))


def sample_metrics(samples: DataFrame) -> DataFrame:
    """Adds capability (1 or 0) and risk (0 where right) to samples: task, slm_correct, severity_score, risk_weight, severity, failure_category, failure_type."""
    category = F.lower(F.trim(F.coalesce(F.when(F.col("failure_category") != "", F.col("failure_category")), F.col("failure_type"), F.lit(""))))
    risk = looked_up(TASK_RISK, F.col("task"), 0.5) * severity(F.col("severity_score"), F.col("risk_weight"), F.col("severity")) * looked_up(CATEGORY_FACTOR, category, 1.0)
    right = F.coalesce(F.col("slm_correct"), F.lit(False))
    return samples.withColumns({"capability": right.cast("double"), "risk": F.when(right, 0.0).otherwise(clamp01(risk))})


def baselines(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of the large model and mean risk, by group. metrics: llm_correct (null: false), risk."""
    return metrics.groupBy(*by).agg(F.avg(F.coalesce(F.col("llm_correct"), F.lit(False)).cast("double")).alias("baseline_cap"), F.avg("risk").alias("baseline_risk"))


def scored_by_id(samples: DataFrame, scores: DataFrame, key: str = "sample_id", default: float = 0.5) -> DataFrame:
    """Samples with the score of their id, or the default."""
    return samples.join(scores.select(key, "score"), key, "left").withColumn("score", F.coalesce("score", F.lit(default)))


def smoothed_curve(df: DataFrame, by: list[str], d: str, correct: str, risk: str, bins: int = 10) -> DataFrame:
    """Capability (rising) and risk (falling) by bins of equal width, pooled to be monotonic: bin, center, cap, risk, mean_risk."""
    cap = width_curve(df, by, d, correct, bins)
    bad = width_curve(df, by, d, risk, bins).select(*by, "bin", F.col("cap").alias("risk"))
    up = isotonic(cap.select(*by, F.col("bin").cast("double").alias("bin"), "cap"), by, "bin", "cap").select(*by, "bin", F.col("fitted").alias("cap"))
    down = isotonic(bad.select(*by, F.col("bin").cast("double").alias("bin"), "risk"), by, "bin", "risk", increasing=False).select(*by, "bin", F.col("fitted").alias("risk"))
    mean = df.groupBy(*by).agg(F.avg(F.col(risk).cast("double")).alias("mean_risk"))
    return up.join(down, [*by, "bin"]).join(mean, by).withColumn("center", (F.col("bin") + 0.5) / bins)


def grid_tau(curve: DataFrame, by: list[str], base: float = 0.85, margin_cap: float = 0.05, margin_risk: float = 0.05, points: int = 1000) -> DataFrame:
    """The greatest feasible point of an even grid over 0 to 1, else the first of the least violation.

    curve: by, center, cap, risk, mean_risk, a few bins a group, which are gathered into one row and evaluated at all points of the grid there.
    Between centers the curve is linear, beyond them flat. Returns by, tau, provenance, n_feasible, cap_at_tau, risk_at_tau.
    """
    rows = curve.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("center", "cap", "risk"))).alias("c"), F.first("mean_risk").alias("mr"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(i == points - 1, 1.0).otherwise(i * F.lit(1.0 / (points - 1))))

    def at(d: Column, name: str) -> Column:
        left = F.filter("c", lambda x: x["center"] < d)
        right = F.filter("c", lambda x: x["center"] >= d)
        a, b = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
        w = (d - a["center"]) / F.greatest(F.lit(1e-6), b["center"] - a["center"])
        return F.when(a.isNull(), b[name]).when(b.isNull(), a[name]).otherwise((1 - w) * a[name] + w * b[name])

    points_of = rows.select(*by, "mr", F.explode(F.transform(grid, lambda d: F.struct(d.alias("d"), at(d, "cap").alias("cap"), at(d, "risk").alias("risk")))).alias("p"))
    p = points_of.select(*by, "mr", "p.*")
    limit = F.col("mr") + margin_risk
    ok = (F.col("cap") >= base - margin_cap) & (F.col("risk") <= limit)
    miss = F.greatest(F.lit(0.0), (base - margin_cap) - F.col("cap")) + F.greatest(F.lit(0.0), F.col("risk") - limit)
    point = F.struct("d", "cap", "risk")
    best = p.groupBy(*by).agg(F.max_by(F.when(ok, point), F.when(ok, F.col("d"))).alias("strict"), F.min_by(point, F.struct(miss, F.col("d"))).alias("nearest"), F.count_if(ok).alias("n_feasible"))
    chosen = F.coalesce("strict", "nearest")
    return best.select(*by, chosen["d"].alias("tau"), F.when(F.col("strict").isNotNull(), "strict_feasible_max").otherwise("fallback_min_violation").alias("provenance"), "n_feasible", chosen["cap"].alias("cap_at_tau"), chosen["risk"].alias("risk_at_tau"))


def consensus_tau(taus: DataFrame, task: str = "task") -> DataFrame:
    """Mean threshold over the models of a task."""
    return taus.groupBy(task).agg(F.avg("tau").alias("tau_consensus"), F.count("*").alias("n_models"))


def operational_zone(curve: DataFrame, by: list[str], cap_static: float = 0.65, risk_static: float = 0.3, margin_cap: float = 0.05, margin_risk: float = 0.05, coverage_max: float = 0.7) -> DataFrame:
    """The last bin within all limits, else the one of least violation, then risk, then the fullest and last.

    curve: by, bin, cap, risk, n, baseline_cap, baseline_risk. A bin with over ``coverage_max`` of all rows is never within the limits.
    """
    limits = {
        "cap_dyn": F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.least(F.lit(cap_static), F.col("baseline_cap") - margin_cap))),
        "risk_dyn": clamp01(F.greatest(F.lit(risk_static), F.col("baseline_risk") + margin_risk)),
    }
    total = curve.groupBy(*by).agg(F.sum("n").alias("_total"))
    c = curve.withColumns(limits).join(total, by).withColumn("_share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_total")), F.lit(0.0)))
    ok = (F.col("cap") >= F.col("cap_dyn")) & (F.col("risk") <= F.col("risk_dyn")) & (F.col("_share") <= coverage_max)
    miss = F.greatest(F.lit(0.0), F.col("cap_dyn") - F.col("cap")) + F.greatest(F.lit(0.0), F.col("risk") - F.col("risk_dyn"))
    out = c.groupBy(*by).agg(
        F.max("cap_dyn").alias("cap_dyn"),
        F.max("risk_dyn").alias("risk_dyn"),
        F.array_sort(F.collect_list(F.when(ok, F.col("bin")))).alias("feasible_set"),
        F.max(F.when(ok, F.col("bin"))).alias("strict_tau"),
        F.min_by("bin", F.struct(miss, F.col("risk"), -F.col("n"), -F.col("bin"))).alias("_near"),
    )
    chosen = F.coalesce("strict_tau", "_near")
    return out.select(*by, "cap_dyn", "risk_dyn", "feasible_set", "strict_tau", chosen.alias("selected_tau"), F.when(F.col("strict_tau").isNotNull(), "strict_feasible_max").otherwise("fallback_min_violation").alias("tau_source"))


def continuous_tau(df: DataFrame, by: list[str], d: str, correct: str, risk: str, base: float = 0.9, margin_cap: float = 0.05, margin_risk: float = 0.05, spread: float = 0.5, size: float = 0.5) -> DataFrame:
    """Threshold among all scores: the greatest feasible one, else the least of violation + spread * its deviation + size * tau.

    Returns by, tau, tau_source, capability, risk and coverage at it, n and the targets.
    """
    curve = prefix_curve(df, by, d, correct, risk)
    limits = df.groupBy(*by).agg(F.count("*").alias("n"), clamp01(F.avg(F.col(risk).cast("double")) + margin_risk).alias("r_dyn")).withColumn("c_dyn", clamp01(F.lit(base - margin_cap)))
    c = curve.join(limits, by)
    ok = (F.col("cap") >= F.col("c_dyn")) & (F.col("risk") <= F.col("r_dyn"))
    c = c.withColumn("_miss", F.greatest(F.lit(0.0), F.col("c_dyn") - F.col("cap")) + F.greatest(F.lit(0.0), F.col("risk") - F.col("r_dyn")))
    point = F.struct("tau", "cap", "risk", "coverage")
    # The deviation is the same for all of a group's scores, so it cannot change which is least.
    goal = F.struct(F.col("_miss") + size * F.col("tau"), F.col("tau"))
    g = c.groupBy(*by).agg(F.max_by(F.when(ok, point), F.when(ok, F.col("tau"))).alias("s"), F.min_by(point, goal).alias("f"), F.stddev_pop("_miss").alias("_sd"), F.min(F.col("_miss") + size * F.col("tau")).alias("_g"), F.first("n").alias("n"), F.first("c_dyn").alias("c_dyn"), F.first("r_dyn").alias("r_dyn"))
    best, strict = F.coalesce("s", "f"), F.col("s").isNotNull()
    objective = F.when(~strict, F.col("_g") + spread * F.coalesce("_sd", F.lit(0.0)))
    return g.select(*by, "n", "c_dyn", "r_dyn", best["tau"].alias("tau"), F.when(strict, "strict_feasible_max").otherwise("fallback_min_violation_robust").alias("tau_source"), best["cap"].alias("capability"), best["risk"].alias("risk"), best["coverage"].alias("coverage"), objective.alias("objective"))


def run_validation(df: DataFrame, by: list[str], d: str, correct: str, risk: str, base_cap: str, mode: str = "fixed") -> DataFrame:
    """Thresholds by group in one of the modes: fixed, adaptive or continuous targets."""
    if mode == "fixed":
        return fixed_tau(df, by, d, correct, risk, base_cap)
    if mode == "adaptive":
        return adaptive_tau(df, by, d, correct, risk)
    if mode == "continuous":
        return continuous_tau(df, by, d, correct, risk)
    raise ValueError(f"unknown mode: {mode}")
