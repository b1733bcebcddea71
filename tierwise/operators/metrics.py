"""Classification, calibration and significance metrics as aggregates by group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import safe_div
from .ordered import cuts, matched, running, scan


def confusion(df: DataFrame, by: list[str], actual: Column, predicted: Column) -> DataFrame:
    """precision, recall, f1, accuracy; 0 where undefined."""
    c = df.groupBy(*by).agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumns({"precision": p, "recall": r, "accuracy": safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    return c.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brier(y: Column, p: Column) -> Column:
    return F.coalesce(F.avg(F.pow(p - y.cast("double"), F.lit(2.0))), F.lit(0.0))


def linspace(bins: int) -> list[float]:
    """Inner edges of an even grid over 0 to 1, with the float error of a step added up by multiplication."""
    return [k * (1.0 / bins) for k in range(1, bins)]


def calibration_error(df: DataFrame, by: list[str], y: str, p: str, bins: int) -> DataFrame:
    """Expected calibration error over half-open bins of equal width, the last closed. An edge is k times the step with its float error, so 0.3 falls below the third one."""
    b = F.size(F.filter(F.array(*[F.lit(edge) for edge in linspace(bins)]), lambda edge: edge <= F.col(p)))
    df = df.where(F.col(p).between(0.0, 1.0))
    per = df.withColumn("_b", b).groupBy(*by, "_b").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(p).alias("conf"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def _by_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Positives and negatives of each distinct score, below it and in all."""
    return running(df, by, p, pos=F.col(y).cast("long"), neg=1 - F.col(y).cast("long"))


def roc_auc(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Exact area by rank sums, ties at half; null with one class."""
    g = _by_score(df, by, y, p).withColumn("_c", F.col("pos") * (F.col("below_neg") + 0.5 * F.col("neg")))
    return g.groupBy(*by).agg(F.try_divide(F.sum("_c"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def pr_auc(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Average precision: steps of recall times precision over distinct scores; null with one class."""
    tp, fp = F.col("all_pos") - F.col("below_pos"), F.col("all_neg") - F.col("below_neg")
    g = _by_score(df, by, y, p).withColumn("_c", F.col("pos") * tp / (tp + fp))
    total = g.groupBy(*by).agg(F.sum("_c").alias("c"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("c") / F.col("pos")).alias("pr_auc"))


GRID19 = [0.05 * k for k in range(1, 20)]


def best_f1_threshold(df: DataFrame, by: list[str], y: str, p: str, grid: list[float] = GRID19) -> DataFrame:
    """The first grid value with the greatest F1 of p >= t. The grid is expanded in the row, so no join is needed."""
    g = df.select(*by, y, p, F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("ord", "t"))
    c = confusion(g, [*by, "ord", "t"], F.col(y) == 1, F.col(p) >= F.col("t"))
    return c.groupBy(*by).agg(F.max_by("t", F.struct("f1", -F.col("ord"))).alias("tau"), F.max("f1").alias("f1"))


def mean_ci95(df: DataFrame, by: list[str], value: str) -> DataFrame:
    half = F.when(F.count(value) > 1, 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).when(F.count(value) == 1, 0.0).otherwise(F.lit(float("nan")))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), half.alias("ci95"), F.count(value).alias("n"))


def mcnemar(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Continuity-corrected chi square of discordant pairs, and its p value (Arrow UDF on the aggregate)."""
    c = df.groupBy(*by).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    d = (F.col("b") + F.col("c")).cast("double")
    chi = F.coalesce(F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2.0)), d), F.lit(0.0))

    @F.pandas_udf("double")
    def tail(x):
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return c.withColumn("chi2", chi).withColumn("p_value", F.when(d == 0, 1.0).otherwise(tail("chi2")))


def holm(df: DataFrame, family: list[str], p: str, order_by: list[str] = ()) -> DataFrame:
    """Holm step-down: running maximum of p (m - rank), at most 1. Of equal p values the first has the greatest product, so the order among them
    (``order_by``) changes nothing, and the work is done on distinct ones."""
    at = cuts(df, p)
    table = scan(df.groupBy(*family, p).agg(F.count("*").alias("_k")), family, p, at, ["_k"])
    table = table.withColumn("_raw", F.col(p) * (F.col("all__k") - F.col("below__k"))).select(*family, p, "_raw")
    held = scan(table, family, p, at, most=["_raw"])
    held = held.select(*family, p, F.least(F.greatest("_raw", "below__raw"), F.lit(1.0)).alias("p_holm"))
    return matched(df, held, [*family, p])


def correlation(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; 0 where a side hardly varies, which the built-in one divides by."""
    flat = (F.stddev_pop(x) < 1e-9) | (F.stddev_pop(y) < 1e-9)
    return F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def guarded_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson r; 0 where a side hardly varies."""
    return df.groupBy(*by).agg(correlation(F.col(x), F.col(y)).alias("r"))
