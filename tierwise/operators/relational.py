"""Relational operators with the reference semantics of missing keys, order and binning.

Order-sensitive operators take ``order_by``; nothing depends on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import mean0, notna, num, present, sum0, true
from .ordered import order_statistics, percentiles


def select(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in the order asked for; missing ones are null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(true(condition))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def merge(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_y") -> DataFrame:
    """Inner join on keys among which null equals null; a right column of a known name gets the suffix.

    Null-safe equality stays an equi-join, so Catalyst may hash or sort by it.
    """
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on])
    more = [F.col(f"b.{c}").alias(c + suffix if c in left.columns else c) for c in right.columns if c not in on]
    return a.join(b, same).select("a.*", *more)


def group_agg(df: DataFrame, by: str, **what: tuple[str, str]) -> DataFrame:
    """name=(column, "mean" | "sum"), with 0 for groups without numbers."""
    ops = {"mean": mean0, "sum": sum0}
    return df.groupBy(by).agg(*[ops[op](F.col(c)).alias(name) for name, (c, op) in what.items()])


def drop_duplicates(df: DataFrame, subset: list[str], order_by: list[Column | str]) -> DataFrame:
    """The first row of each combination of values."""
    w = Window.partitionBy(*subset).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, key: str, at: str, position: str) -> DataFrame:
    """The row of each key with the greatest time as text; missing counts as empty, the last of ties wins."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(at).cast("string"), F.lit("")).desc(), F.col(position).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unique(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct values with the position at which each first occurs."""
    return df.groupBy(column).agg(F.min(position).alias("first_pos"))


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_per_group(df: DataFrame, by: list[str], order_by: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def common_ids(df: DataFrame, group: str, member: str, key: str) -> DataFrame:
    """(group, key) that every member of the group has, for groups of two members or more."""
    members = df.groupBy(group).agg(F.count_distinct(member).alias("_m")).where("_m >= 2")
    held = df.groupBy(group, key).agg(F.count_distinct(member).alias("_n"))
    return held.join(members, group).where("_n = _m").select(group, key)


def rolling_mean(value: Column, by: list[str], order_by: list[Column | str], window: int, min_periods: int | None = None) -> Column:
    """Trailing mean that skips missing values; null below ``min_periods`` of them."""
    w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(-(window - 1), 0)
    v = present(value)
    return F.when(F.count(v).over(w) >= (window if min_periods is None else min_periods), F.avg(v).over(w))


def centred_mean(value: Column, by: list[str], order_by: list[Column | str], window: int, min_periods: int = 1) -> Column:
    """Centred mean; the left edge keeps a window of full width, the right edge shrinks."""
    half, v = window // 2, present(value)
    base = Window.partitionBy(*by).orderBy(*order_by)

    def mean(frame) -> Column:
        return F.when(F.count(v).over(frame) >= min_periods, F.avg(v).over(frame))

    rn, out = F.row_number().over(base), mean(base.rowsBetween(-half, window - 1 - half))
    # The k-th row of the left edge sees the first ``window`` rows too: frames of a fixed size, whatever the group's.
    for k in range(1, half + 1):
        out = F.when(rn == k, mean(base.rowsBetween(1 - k, window - k))).otherwise(out)
    return out


def qcut(df: DataFrame, value: str, q: int, by: list[str], out: str = "bin") -> DataFrame:
    """Bin = number of linear quantiles k/q strictly below the value; null stays null."""
    x, names = F.col(value), {f"_q{k}": k / q for k in range(1, q)}
    if not names:
        return df.withColumn(out, F.when(x.isNotNull(), F.lit(0)))
    found = percentiles(df, by, value, names).select(*by, F.array(*names).alias("_cuts"))
    joined = merge(df, found, by)
    return joined.withColumn(out, F.when(x.isNotNull(), F.size(F.filter("_cuts", lambda t: x > t)))).drop("_cuts")


def cut(df: DataFrame, value: str, bins: int, by: list[str], out: str = "bin") -> DataFrame:
    """Equal widths; the maximum falls into the last bin, equal values into bin 0."""
    x, w = F.col(value), Window.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    at = F.least(F.floor((x - lo) / ((hi - lo) / F.lit(float(bins)))), F.lit(bins - 1)).cast("int")
    return df.withColumn(out, F.when(x.isNull(), F.lit(None)).when(lo == hi, F.lit(0)).otherwise(at))


def nearest_rank_bounds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p05 and p95 by nearest rank; p95 is p05 + 1 where they meet. Groups without a value are left out."""
    at = lambda p: F.least((F.lit(p) * F.col("n")).cast("int"), F.col("n") - 1)
    out = order_statistics(df, by, value, {"p05": at(0.05), "p95": at(0.95)}).where("n > 0").drop("n")
    return out.withColumn("p95", F.when(F.col("p95") <= F.col("p05"), F.col("p05") + 1.0).otherwise(F.col("p95")))


def assign(df: DataFrame, name: str, value, position: str | None = None) -> DataFrame:
    """A new column: one value for all rows, an expression, or a short list by the row's position (0, 1, ...), null beyond it."""
    if isinstance(value, (list, tuple)):
        return df.withColumn(name, F.get(F.array(*[F.lit(v) for v in value]), F.col(position).cast("int")))
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def get(df: DataFrame, name: str, default=None) -> Column:
    """A column, or the default where the table has none of this name."""
    return F.col(name) if name in df.columns else F.lit(default)


def fill_missing(df: DataFrame, column: str, value) -> DataFrame:
    """Null and NaN replaced."""
    return df.withColumn(column, F.when(notna(F.col(column)), F.col(column)).otherwise(F.lit(value)))


def as_type(c: Column, name: str) -> Column:
    """As Int64 or int, bool (missing: false) or float; what is no number is null, other names change nothing."""
    if name in ("Int64", "int"):
        return num(c).cast("long")
    if name == "bool":
        return true(c)
    return num(c) if name == "float" else c


def row_apply(df: DataFrame, each: Callable[[dict], dict], schema: str) -> DataFrame:
    """A Python function of each row, by Arrow batches; for what no expression can say."""
    import pyarrow as pa

    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        for b in batches:
            rows = [each(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names})

    return df.mapInArrow(run, schema)


def row_at(df: DataFrame, position: str, i: int) -> DataFrame:
    """The row at a position from 0 in the order of ``position``; negative ones count from the end."""
    key = F.col(position) if i >= 0 else F.col(position).desc()
    return df.orderBy(key).offset(i if i >= 0 else -i - 1).limit(1)


def difficulty_bins(df: DataFrame, score: str, by: list[str], n_bins: int = 5, method: str = "quantile", out: str = "difficulty_bin") -> DataFrame:
    """Bins by quantiles or of equal width; without a single score all bins are null. A missing column or an unknown method is an error."""
    if score not in df.columns:
        raise ValueError(f"missing score column: {score}")
    if method not in ("quantile", "uniform"):
        raise ValueError("method must be 'quantile' or 'uniform'")
    return (qcut if method == "quantile" else cut)(df, score, n_bins, by, out)


def bin_proxy(bin_: Column, default: float = 5.0, last: float = 9.0) -> Column:
    """Difficulty that a bin stands for, as its share of the last one; without a bin that of the default."""
    return F.coalesce(num(bin_), F.lit(default)) / last


def bin_of_difficulty(difficulty: Column, bins: int = 4) -> Column:
    """Bin of a difficulty from 0 to 1, cut towards 0; 1 itself is a bin of its own, and null stays null."""
    return (num(difficulty) * bins).cast("int")
