"""Order statistics, running sums, ranks and neighbours within groups of any size, without a window over a whole group.

The values of all groups are cut into ``SLICES`` slices by the quantiles of a mergeable sketch, so a large group is spread over many tasks. Sums by group and
slice, at most ``SLICES`` rows a group, give what comes before a slice; a window runs within a slice of a group only. Where the cuts lie changes no result, so
an approximate sketch will do. Rows of equal value are summed first, so a value that a third of all rows hold is one row.

Nulls come before and NaN after all other values, as Spark sorts them. Groups may be null.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

#: Slices of the values of all groups, and the accuracy of the sketch that places them.
SLICES, ACCURACY = 256, 10_000

#: Ranks in a block of blocks().
BLOCK = 1 << 16


def as_number(df: DataFrame, value: str) -> Column | None:
    """A double that never falls where the value rises; None for kinds without one, which are not sliced."""
    kind, c = df.schema[value].dataType, F.col(value)
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("double")
    return c.cast("double") if isinstance(kind, (NumericType, BooleanType)) else None


def cuts(df: DataFrame, value: str) -> list[float]:
    """Cut points between slices; the sketch's size is fixed, whatever the number of rows."""
    number = as_number(df, value)
    if number is None:
        return []
    found = df.where(number.isNotNull() & ~F.isnan(number)).agg(F.percentile_approx(number, F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)]), F.lit(ACCURACY))).first()[0]
    return sorted({x for x in found or () if abs(x) != float("inf")})


def sliced(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """With _slice, which rises with the value."""
    if not at:
        return df.withColumn("_slice", F.when(F.col(value).isNull(), -1.0).otherwise(0.0))
    to = Bucketizer(splits=[-float("inf"), *at, float("inf")], inputCol="_number", outputCol="_slice", handleInvalid="keep")
    put = to.transform(df.withColumn("_number", as_number(df, value)))
    return put.withColumn("_slice", F.when(F.col(value).isNull(), -1.0).otherwise(F.col("_slice"))).drop("_number")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the right side's keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys]) if how != "left_semi" else left.join(named, on, how)


def scan(table: DataFrame, by: list[str], value: str, at: list[float], sums: list[str] = (), most: list[str] = ()) -> DataFrame:
    """A table of distinct values with, for each column of ``sums``, below_ (its sum over smaller values) and all_ (over the group), and for each of ``most``
    below_ (its maximum over smaller values, or null)."""
    put = sliced(table, value, at)
    per = put.groupBy(*by, "_slice").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])
    group, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*by, "_slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s_{c}") for c in sums], *[F.sum(c).over(group).alias(f"all_{c}") for c in sums], *[F.max(c).over(before).alias(f"_m_{c}") for c in most])
    here = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = put.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_hs_{c}") for c in sums], *[F.max(c).over(here).alias(f"_hm_{c}") for c in most])
    out = matched(local, carried, [*by, "_slice"])
    below = {f"below_{c}": F.col(f"_s_{c}") + F.col(f"_hs_{c}") for c in sums} | {f"below_{c}": F.greatest(f"_m_{c}", f"_hm_{c}") for c in most}
    return out.withColumns(below).select(*table.columns, *below, *[f"all_{c}" for c in sums])


def running(df: DataFrame, by: list[str], value: str, **sums: Column) -> DataFrame:
    """(by, value, sums, below_ and all_ of each): sums of the rows of each distinct value, and of all smaller ones."""
    table = df.groupBy(*by, value).agg(*[F.sum(c).alias(a) for a, c in sums.items()])
    return scan(table, by, value, cuts(df, value), list(sums))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, the value at each rank): ranks are from 0, as expressions of the group's number of values ``n``; nulls are left out and groups without values have nulls.

    A first pass counts by slice; only the slices that hold a wanted rank are read in order, in a second one.
    """
    at, rows = cuts(df, value), df.select(*by, value).where(F.col(value).isNotNull())
    put = sliced(rows, value, at)
    sizes = put.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_slice", "_c", before.alias("_b"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(a).alias("name"), r.cast("long").alias("rank")) for a, r in ranks.items()])
    inside = lambda w: (w["rank"] >= F.col("_b")) & (w["rank"] < F.col("_b") + F.col("_c"))
    sought = sizes.withColumn("_want", F.filter(wanted, inside)).where(F.size("_want") > 0)
    near = matched(put, sought.select(*by, "_slice"), [*by, "_slice"], "left_semi").groupBy(*by, "_slice", value).agg(F.count("*").alias("_k"))
    here = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = matched(near.withColumn("_h", F.coalesce(F.sum("_k").over(here), F.lit(0))), sought, [*by, "_slice"])
    first = F.col("_b") + F.col("_h")
    is_at = lambda a: F.max(F.when(F.exists("_want", lambda w: (w["name"] == a) & (w["rank"] >= first) & (w["rank"] < first + F.col("_k"))), F.col(value))).alias(a)
    found = placed.groupBy(*by).agg(F.max("n").alias("n"), *[is_at(a) for a in ranks])
    groups = df.select(*by).distinct()
    return matched(groups, found, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, the exact percentile of each share), linear between the two values beside it; null for groups without values."""
    place = {a: (F.col("n") - 1) * F.lit(float(p)) for a, p in at.items()}
    ranks = {f"_lo_{a}": F.floor(c) for a, c in place.items()} | {f"_hi_{a}": F.ceil(c) for a, c in place.items()}
    found = order_statistics(df, by, value, ranks)

    def between(a: str) -> Column:
        lo, hi = F.col(f"_lo_{a}").cast("double"), F.col(f"_hi_{a}").cast("double")
        return F.when(lo == hi, lo).otherwise((F.ceil(place[a]) - place[a]) * lo + (place[a] - F.floor(place[a])) * hi).alias(a)

    return found.select(*by, *[between(a) for a in at])


def ranked(df: DataFrame, by: list[str], value: str, position: str | list[str], out: str = "_rank") -> DataFrame:
    """Rows with their rank from 0 by value and then position (one column or more), in their group; rows equal in all share the first one's rank."""
    columns, rows, rank = [value, *([position] if isinstance(position, str) else position)], df, F.lit(0)
    for i, c in enumerate(columns):
        keys = [*by, *columns[:i]]
        below = running(df, keys, c, _n=F.lit(1)).select(*keys, c, F.col("below__n").alias(f"_b{i}"))
        rows, rank = matched(rows, below, [*keys, c]), rank + F.col(f"_b{i}")
    return rows.withColumn(out, rank).drop(*[f"_b{i}" for i in range(len(columns))])


def blocks(rows: DataFrame, rank: str, reach: int) -> DataFrame:
    """Ranked rows with _block and _own: each is in the block of its rank, and also in the next or last one where it lies within ``reach`` of it."""
    block, within = F.floor(F.col(rank) / BLOCK), F.col(rank) % BLOCK
    to = F.array(block, F.when((within < reach) & (block > 0), block - 1), F.when(within >= BLOCK - reach, block + 1))
    return rows.withColumn("_block", F.explode(F.array_compact(to))).withColumn("_own", F.col("_block") == block)


def following(table: DataFrame, by: list[str], value: str, names: list[str]) -> DataFrame:
    """A table of distinct values with next_ of each column: what the next greater value of the group has. first: whether no value is smaller."""
    at = cuts(table, value)
    put = sliced(table, value, at)
    row = F.struct(value, *[F.col(c).alias(f"_c_{c}") for c in names])
    per = put.groupBy(*by, "_slice").agg(F.min(row).alias("_head"))
    w = Window.partitionBy(*by).orderBy("_slice")
    heads = per.select(*by, "_slice", F.lead("_head").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_start"))
    here = Window.partitionBy(*by, "_slice").orderBy(value)
    local = put.withColumns({"_local": F.lead(row).over(here), "_i": F.row_number().over(here)})
    out = matched(local, heads, [*by, "_slice"]).withColumn("_n", F.coalesce("_local", "_next"))
    return out.select(*table.columns, *[F.col("_n")[f"_c_{c}"].alias(f"next_{c}") for c in names], (F.col("_start") & (F.col("_i") == 1)).alias("first"))
