"""Local smoothing of outcomes over difficulty, resampled intervals, and zones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import blocks, matched, ranked


#: Bandwidths to either side that the kernel reaches, and terms of its series: what is left out of a weight is below 1e-17 either way.
REACH, TERMS = 9, 28


def kernel_smooth(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Gaussian smoothing of ``y`` at each distinct ``x``: (by, x, n, value).

    Bandwidth h: 1.06 times the population deviation (1 where it is 0) times n^-0.2. Groups under three rows keep their means. Rows with a null are left out.

    The rows of a bucket of width h are summed to ``TERMS`` moments about its middle, as exp(-(u - v)^2 / 2) = exp(-u^2 / 2) exp(-v^2 / 2) sum (u v)^k / k!.
    A value reads the moments of the buckets within ``REACH`` of its own, so the work grows with the distinct values and no group is joined to itself.
    Weights beyond, below exp(-REACH^2 / 2) = 3e-18 each, are left out: the value moves by at most N 6e-18 times the largest |y|, N rows in its group.
    """
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count("*").alias("n"))
    mean = F.sum(F.col(x) * F.col("n")) / F.sum("n")
    stats = g.groupBy(*by).agg(F.sum("n").alias("_n"), mean.alias("_m"))
    spread = matched(g, stats, by).groupBy(*by, "_n", "_m").agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col(x) - F.col("_m"), F.lit(2.0))) / F.first("_n")).alias("_sd"))
    spread = spread.select(*by, "_n", "_m", (1.06 * F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0) * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h"))
    z = (F.col(x) - F.col("_m")) / F.col("_h")
    put = matched(g, spread, by).withColumn("_b", F.round(z).cast("long")).withColumn("_v", z - F.col("_b"))

    # Both sums share the powers of v; a moment is sum(weight exp(-v^2 / 2) v^k / k!).
    power = lambda k: F.exp(-0.5 * F.col("_v") * F.col("_v")) * F.pow("_v", F.lit(float(k))) / F.lit(float(math.factorial(k)))
    made = [F.sum(F.col(c) * power(k)).alias(f"{a}{k}") for a, c in (("_p", "_s"), ("_q", "n")) for k in range(TERMS)]
    moments = put.groupBy(*by, "_b").agg(*made)
    packed = moments.select(*by, F.col("_b").alias("_from"), *[F.array(*[f"{a}{k}" for k in range(TERMS)]).alias(a) for a in ("_p", "_q")])
    near = packed.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-REACH), F.lit(REACH)), lambda i: F.col("_from") + i)))
    around = near.groupBy(*by, "_b").agg(F.collect_list(F.struct("_from", "_p", "_q")).alias("_around"))  # 2 REACH + 1 buckets at most

    def total(name: str) -> Column:
        def of(bucket: Column) -> Column:
            u = F.col("_v") + (F.col("_b") - bucket["_from"])
            series = F.aggregate(F.reverse(bucket[name]), F.lit(0.0), lambda s, m: s * u + m)
            return F.exp(-0.5 * u * u) * series

        return F.aggregate("_around", F.lit(0.0), lambda s, bucket: s + of(bucket))

    smooth = matched(put, around, [*by, "_b"])
    return smooth.select(*by, x, "n", F.when(F.col("_n") < 3, F.col("_s") / F.col("n")).otherwise(total("_p") / total("_q")).alias("value"))


def nearest_mean(df: DataFrame, by: list[str], x: str, position: str, values: dict[str, str], k: int = 15) -> DataFrame:
    """Means of the ``k`` rows nearest in ``x`` to each row, itself included: a window of 2k+1 rows within blocks of ranks that overlap by k.

    Ties in distance go to the row fewer places away, then to the earlier one. Groups under k rows take all.
    """
    held = blocks(ranked(df, by, x, position, "_r"), "_r", k)
    row = F.struct("_r", F.col(x).cast("double").alias("_x"), *[F.col(c).cast("double").alias(a) for a, c in values.items()])
    held = held.withColumn("_row", row)
    near = Window.partitionBy(*by, "_block").orderBy("_r").rowsBetween(-k, k)
    held = held.withColumn("_near", F.collect_list("_row").over(near)).where("_own")
    key = lambda e: F.struct(F.abs(e["_x"] - F.col("_row._x")).alias("_d"), F.abs(e["_r"] - F.col("_row._r")).alias("_o"), e["_r"].alias("_r"), *[e[a].alias(a) for a in values])
    held = held.withColumn("_near", F.slice(F.array_sort(F.transform("_near", key)), 1, k))
    mean = lambda a: F.aggregate("_near", F.lit(0.0), lambda s, e: s + e[a]) / F.size("_near")
    return held.select(*by, position, x, *[mean(a).alias(a) for a in values])


def greatest_feasible(df: DataFrame, by: list[str], x: str, cap: str, risk: str, cap_target: float, risk_target: float) -> DataFrame:
    """Greatest ``x`` with enough capability and little enough risk; null without any."""
    return df.groupBy(*by).agg(F.max(F.when((F.col(cap) >= cap_target) & (F.col(risk) <= risk_target), F.col(x))).alias("tau"))


def bootstrap_mean(df: DataFrame, by: list[str], y: str, key: str, draws: int = 400, alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """Percentile interval of a mean: (by, lo, hi).

    Each row counts Poisson(1) times in each draw, so a draw needs no index of all rows: one pass of Arrow batches gives partial sums of ``draws``
    numbers by task and group, then one row by group. Counts follow from the row's key, the draw and the seed. Null values are left out.
    """
    probs, total = [], 0.0
    p = 0.36787944117144233
    for i in range(1, 8):
        total += p
        probs.append(total)
        p /= i
    keyed = df.select(*by, F.col(y).cast("double").alias("_y"), F.xxhash64(F.col(key), F.lit(seed)).alias("_i")).where("_y is not null")
    kinds = ", ".join(f"`{k}` {keyed.schema[k].dataType.simpleString()}" for k in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two numbers a draw for each group of a task, however many rows it has.
        held: dict[tuple, np.ndarray] = {}
        marks = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            names = list(zip(*[b.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * b.num_rows
            group: dict[tuple, list[int]] = {}
            for at, name in enumerate(names):
                group.setdefault(name, []).append(at)
            ys, ids = b.column(len(by)).to_numpy(), b.column(len(by) + 1).to_numpy().view(np.uint64)
            for name, at in group.items():
                total = held.setdefault(name, np.zeros((2, draws)))
                for i in range(0, len(at), 1024):
                    rows = at[i : i + 1024]
                    h = ids[rows][:, None] ^ marks[None, :]
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                    u = (h ^ (h >> np.uint64(31))) / 2.0**64
                    times = np.searchsorted(probs, u, "right").astype(np.float64)
                    total[0] += times.T @ ys[rows]
                    total[1] += times.sum(axis=0)
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * draws) for v in name], pa.array(range(draws), pa.int32()), pa.array(total[0]), pa.array(total[1])], [*by, "_b", "_s", "_n"])

    part = keyed.mapInArrow(run, f"{kinds}{', ' if by else ''}_b int, _s double, _n double")
    sums = part.groupBy(*by, "_b").agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0.0))).alias("_m"))
    return sums.groupBy(*by).agg(F.percentile("_m", F.lit(alpha / 2)).alias("lo"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("hi"))


def quadrant(cap: Column, risk: Column, tau_cap: float, tau_risk: float) -> Column:
    """Zone1: capable and safe; Zone2: capable, risky; Zone3: neither capable nor risky; Zone4: incapable and risky."""
    able, safe = cap >= tau_cap, risk <= tau_risk
    return F.when(able & safe, "Zone1").when(able, "Zone2").when(safe, "Zone3").otherwise("Zone4")


def zone_threshold(taus: Column, strategy: str) -> Column:
    """Aggregate over the models' thresholds: conservative, balanced or aggressive."""
    return {"conservative": F.min, "balanced": F.avg, "aggressive": F.max}[strategy](taus)


def size_class(billions: Column) -> Column:
    return F.when(billions < 1.5, "small").when(billions < 3, "medium").otherwise("large")
