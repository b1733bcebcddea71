"""Deployment roll-ups, sweep optima and policy recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tier_distribution(df: DataFrame, tier: str, rho: str) -> DataFrame:
    """Use cases and mean routing ratio by tier."""
    return df.groupBy(tier).agg(F.count("*").alias("n"), F.avg(rho).alias("mean_rho"))


def leading_row(df: DataFrame, by: list[str], disqualified: str, tier: str, tau: str) -> DataFrame:
    """First row of a task: qualified before disqualified, then by tier, then the greatest threshold."""
    first = F.struct(F.col(disqualified).alias("a"), F.col(tier).alias("b"), (-F.col(tau)).alias("c"))
    return df.groupBy(*by).agg(F.min(first).alias("_f")).select(*by, F.col("_f.a").alias(disqualified), F.col("_f.b").alias(tier), (-F.col("_f.c")).alias(tau))


def weighted_tier_accuracy(df: DataFrame, grid: list[str], tier: str, slm: str, llm: str) -> DataFrame:
    """Sum over tiers of mean task accuracy times the tier's share of tasks, by grid point."""
    acc = (F.col(slm) + F.col(llm)) / 2.0
    t = df.groupBy(*grid, tier).agg(F.avg(acc).alias("_a"), F.count("*").alias("_n"))
    return t.groupBy(*grid).agg((F.sum(F.col("_a") * F.col("_n")) / F.sum("_n")).alias("overall_weighted_accuracy"))


def sweep_best(df: DataFrame, score: str, order: list[str]) -> DataFrame:
    """The row with the greatest score, the first in grid order among equals; one partial maximum by task."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), *[-F.col(c) for c in order]))
    return df.agg(best.alias("_b")).where("_b is not null").select("_b.*")


def calibration_summary(df: DataFrame, passed: str, tau: str) -> DataFrame:
    return df.agg(F.count_if(F.col(passed)).alias("n_pass"), F.count_if(~F.coalesce(F.col(passed), F.lit(False))).alias("n_fail"), F.count_distinct(tau).alias("n_tau"), F.min(tau).alias("min_tau"), F.max(tau).alias("max_tau"))


def recommend_tiers(runs: DataFrame, task: str, fail: str, f1: str, ece: str, base: dict[str, tuple[float, float]], default: tuple[float, float] = (3.2, 4.0), low: float = 2.0, high: float = 4.5) -> DataFrame:
    """New tier limits by task from mean failure rate, F1 and calibration error; missing values count as 0, runs without a task are left out."""
    means = [F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(a) for a, c in (("fail", fail), ("f1", f1), ("ece", ece))]
    m = runs.where(F.coalesce(F.trim(F.col(task)), F.lit("")) != "").groupBy(F.trim(F.col(task)).alias("task")).agg(*means)
    over = lambda c, limit, gain: F.greatest(F.lit(0.0), c - limit) * gain
    under = lambda c, limit, gain: F.greatest(F.lit(0.0), limit - c) * gain
    pressure = over(F.col("fail"), 0.35, 2.2) + under(F.col("f1"), 0.70, 1.4) + over(F.col("ece"), 0.20, 1.0)
    relief = over(F.col("f1"), 0.85, 0.8) + under(F.col("fail"), 0.20, 0.6)

    def start(i: int):
        out = F.lit(float(default[i]))
        for name, pair in base.items():
            out = F.when(F.col("task") == name, float(pair[i])).otherwise(out)
        return out

    m = m.withColumn("delta", pressure - relief)
    m = m.withColumn("tau1", F.greatest(F.lit(low), F.least(F.lit(high - 0.5), start(0) - F.col("delta"))))
    m = m.withColumn("tau2", F.greatest(F.col("tau1") + 0.4, F.least(F.lit(high), start(1) - F.col("delta"))))
    return m.select("task", *[F.bround(c, 3).alias(c) for c in ("tau1", "tau2")], *[F.bround(c, 4).alias(c) for c in ("fail", "f1", "ece", "delta")])


def recommend_scores(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Stakes and complexity to raise, by task. runs: task, tau_cap, tau_risk (null: 9); scores: task, s3. Tasks without runs have a mean of 0."""
    t = runs.groupBy("task").agg(F.avg(F.least(F.coalesce("tau_cap", F.lit(9.0)), F.coalesce("tau_risk", F.lit(9.0)))).alias("_t"))
    t = scores.join(t, "task", "left").withColumn("_t", F.coalesce("_t", F.lit(0.0)))
    level = F.when(F.col("_t") <= 0.2, 4).when(F.col("_t") <= 0.5, 3).when(F.col("s3") < 2.2, 2)
    return t.select("task", level.alias("SK"), level.alias("TC")).where("SK is not null")


def recalibrated_policy(tests: DataFrame, runs: DataFrame, scores: DataFrame, base: dict[str, tuple[float, float]]) -> DataFrame:
    """New tier limits and scores by task, from test reports and validation runs: (task, tau1, tau2, SK, TC), null where nothing is recommended.

    tests: task, positive_rate, f1, ece; runs: task, tau_cap, tau_risk; scores: task, s3.
    """
    limits = recommend_tiers(tests, "task", "positive_rate", "f1", "ece", base).select("task", "tau1", "tau2")
    return limits.join(recommend_scores(runs, scores), "task", "full_outer")


def sanitise_features(train: DataFrame, features: list[str], variance: float = 1e-12, correlation: float = 0.95) -> dict[str, list[str]]:
    """Features to keep and to drop, judged on the training rows: any null, low variance, high correlation with one kept before.

    One aggregate gives counts and variances, a second the correlations of what is left; the driver holds two rows of numbers.
    """
    got = train.agg(
        *[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f"n_{i}") for i, f in enumerate(features)],
        *[F.var_pop(f).alias(f"v_{i}") for i, f in enumerate(features)],
    ).first()
    nulls = [f for i, f in enumerate(features) if got[f"n_{i}"]]
    flat = [f for i, f in enumerate(features) if f not in nulls and not (got[f"v_{i}"] or 0.0) > variance]
    left = [f for f in features if f not in nulls and f not in flat]
    pairs = [(a, b) for i, a in enumerate(left) for b in left[:i]]
    close = {}
    if pairs:
        row = train.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)]).first()
        close = {p: abs(row[i] or 0.0) for i, p in enumerate(pairs)}
    keep, same = [], []
    for f in left:
        (same if any(close[f, k] > correlation for k in keep) else keep).append(f)
    if not keep:
        raise ValueError("no feature is left")
    return {"keep": keep, "null": nulls, "low_variance": flat, "high_correlation": same}
