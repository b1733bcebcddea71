"""Capability and risk curves over difficulty, and the search for feasible thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .ordered import following, matched, percentiles, running


def edges(bins: int = 10) -> list[float]:
    """Bin edges as k times the step, with its float error."""
    return [k * (1.0 / bins) for k in range(bins)]


def width_curve(df: DataFrame, by: list[str], d: str, correct: str, bins: int = 10) -> DataFrame:
    """Mean of ``correct`` in bins of equal width over 0 to 1; empty bins have 0.5 and no rows."""
    b = F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(e) for e in edges(bins)]), lambda e: e <= F.col(d))) - 1)
    got = df.withColumn("bin", b).groupBy(*by, "bin").agg(F.avg(F.col(correct).cast("double")).alias("cap"), F.count("*").alias("n"))
    frame = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(got, [*by, "bin"], "left").select(*by, "bin", F.coalesce("cap", F.lit(0.5)).alias("cap"), F.coalesce("n", F.lit(0)).alias("n"))


def count_curve(df: DataFrame, by: list[str], d: str, position: str, correct: str, bins: int = 10) -> DataFrame:
    """Slices of equal count in order of difficulty and then position; the last takes the remainder.

    Rows of one difficulty that fall into one slice are summed before they are ordered; only those that an edge parts are ordered by position.
    """
    hit = F.col(correct).cast("double")
    size = F.greatest(F.lit(1), F.floor(F.col("all_n") / bins))
    bin_of = lambda rank: F.least(F.floor(rank / size), F.lit(bins - 1)).cast("int")
    values = running(df, by, d, n=F.lit(1), hits=hit)
    values = values.withColumns({"bin": bin_of(F.col("below_n")), "_last": bin_of(F.col("below_n") + F.col("n") - 1)})
    whole = values.where("bin = _last").select(*by, "bin", (F.col(d) * F.col("n")).alias("_d"), "hits", "n")
    parted = values.where("bin < _last").select(*by, d, F.col("below_n").alias("_below"), "all_n")
    ties = running(matched(df.select(*by, d, position, correct), parted, [*by, d], "left_semi"), [*by, d], position, n=F.lit(1), hits=hit).drop("all_n")
    ties = matched(ties, parted, [*by, d]).withColumn("bin", bin_of(F.col("_below") + F.col("below_n")))
    every = whole.union(ties.select(*by, "bin", (F.col(d) * F.col("n")).alias("_d"), "hits", "n"))
    return every.groupBy(*by, "bin").agg((F.sum("_d") / F.sum("n")).alias("center"), (F.sum("hits") / F.sum("n")).alias("cap"), F.sum("n").alias("n"))


def prefix_curve(df: DataFrame, by: list[str], d: str, correct: str, risk: str) -> DataFrame:
    """Capability, risk and share of all rows with a score up to each distinct score."""
    g = running(df, by, d, c=F.col(correct).cast("double"), r=F.col(risk).cast("double"), n=F.lit(1))
    upto = {a: F.col(f"below_{a}") + F.col(a) for a in ("c", "r", "n")}
    return g.select(*by, F.col(d).alias("tau"), (upto["c"] / upto["n"]).alias("cap"), (upto["r"] / upto["n"]).alias("risk"), (upto["n"] / F.col("all_n")).alias("coverage"))


def feasible_tau(curve: DataFrame, by: list[str], cap_target: str, risk_target: str) -> DataFrame:
    """The greatest feasible threshold, else the one with the least violation, risk, then most capability and tau."""
    ok = (F.col("cap") >= F.col(cap_target)) & (F.col("risk") <= F.col(risk_target))
    miss = F.greatest(F.lit(0.0), F.col(cap_target) - F.col("cap")) + F.greatest(F.lit(0.0), F.col("risk") - F.col(risk_target))
    out = curve.groupBy(*by).agg(
        F.max(F.when(ok, F.col("tau"))).alias("feasible"),
        F.min_by("tau", F.struct(miss, F.col("risk"), -F.col("cap"), -F.col("tau"))).alias("nearest"),
        F.count_if(ok).alias("n_feasible"),
    )
    return out.select(*by, F.coalesce("feasible", "nearest").alias("tau"), "n_feasible", F.col("feasible").isNotNull().alias("strict"))


def adaptive_tau(df: DataFrame, by: list[str], d: str, correct: str, risk: str) -> DataFrame:
    """Targets from the candidates themselves: median capability and upper quartile of risk."""
    c = written(prefix_curve(df, by, d, correct, risk))
    t = matched(percentiles(c, by, "cap", {"cap_t": 0.5}), percentiles(c, by, "risk", {"risk_t": 0.75}), by)
    return feasible_tau(matched(c, t, by), by, "cap_t", "risk_t")


def fixed_tau(df: DataFrame, by: list[str], d: str, correct: str, risk: str, base_cap: str, cap: float = 0.65, max_risk: float = 0.3, margin: float = 0.05) -> DataFrame:
    """Targets from static limits and baselines: within .40 to 1 for capability, 0 to 1 for risk."""
    base = df.groupBy(*by).agg(F.avg(F.col(base_cap).cast("double")).alias("bc"), F.avg(F.col(risk).cast("double")).alias("br"))
    base = base.select(*by, F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.least(F.lit(cap), F.col("bc") - margin))).alias("cap_t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(max_risk), F.col("br") + margin))).alias("risk_t"))
    return feasible_tau(prefix_curve(df, by, d, correct, risk).join(base, by), by, "cap_t", "risk_t")


def interpolate(curve: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """Piecewise linear values of (center, cap) at fixed points, clamped at the ends."""
    seg = following(curve.select(*by, "center", "cap"), by, "center", ["center", "cap"]).withColumnsRenamed({"next_center": "c2", "next_cap": "v2"})
    inside = lambda x: ((x >= F.col("center")) & (F.col("c2").isNull() | (x < F.col("c2")))) | (F.col("first") & (x < F.col("center")))
    points = seg.withColumn("d", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in at]), inside)))
    slope = F.col("cap") + (F.col("v2") - F.col("cap")) * (F.col("d") - F.col("center")) / (F.col("c2") - F.col("center"))
    return points.select(*by, "d", F.when(F.col("c2").isNull() | (F.col("d") < F.col("center")), F.col("cap")).otherwise(slope).alias("value"))
