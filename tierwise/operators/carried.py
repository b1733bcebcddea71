"""Series whose rows depend on all rows before them, split over tasks: parts are worked out alone, and what one part hands to the next is carried after.

The rows lie in ranges of key and order, so a long key spans many tasks and no key is gathered in one. They are written once to the folder that all executors
share, as the second pass must see the parts of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import written
from .ordered import cuts, following, matched, scan


def _keys(b: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in names], strict=True)) if names else [()] * b.num_rows


def ewm_mean(df: DataFrame, by: list[str], order_by: list[str], value: str, alpha: float, out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean, seeded by the first number; missing values repeat the state.

    A part of a key is worked out twice at once: as if it began the key, and as the step ``a s + b`` from a state s that comes before it. A step for
    each part, of which a key has at most one a task, is put together in the order of the parts and gives the state that each part starts from.
    """
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_i", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, here = TaskContext.get().partitionId(), 0, object()
        s, a, b = None, 1.0, 0.0
        for batch in batches:
            got = []
            for k, x in zip(_keys(batch, by), batch.column(batch.schema.get_field_index(value)).to_pylist(), strict=True):
                if k != here:
                    here, s, a, b = k, None, 1.0, 0.0
                if x is not None and x == x:
                    x = float(x)
                    s, a, b = x if s is None else alpha * x + (1 - alpha) * s, (1 - alpha) * a, alpha * x + (1 - alpha) * b
                got.append((part, i, s, a, b))
                i += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)] if got else []
            if columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_part", "_i", "_s", "_a", "_b"])

    rows = written(df.repartitionByRange(*by, *order_by).sortWithinPartitions(*by, *order_by).mapInArrow(run, schema))
    parts = rows.groupBy(*by, "_part").agg(F.max_by(F.struct("_s", "_a", "_b"), "_i").alias("_end"))
    chain = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "_end"))).alias("_chain")).where(F.size("_chain") > 1)
    before = lambda n: F.aggregate(
        F.slice("_chain", 1, n), F.lit(None).cast("double"), lambda s, p: F.when(s.isNull(), p["_end"]["_s"]).otherwise(p["_end"]["_a"] * s + p["_end"]["_b"])
    )
    carried = chain.select(*by, F.explode(F.transform("_chain", lambda p, i: F.struct(p["_part"].alias("_part"), before(i).alias("_from")))).alias("_c")).select(*by, "_c.*")
    joined = matched(rows, carried, [*by, "_part"], "left")
    return joined.select(*df.columns, F.when(F.col("_from").isNull(), F.col("_s")).otherwise(F.col("_a") * F.col("_from") + F.col("_b")).alias(out))


#: Blocks that one task pools in the last round.
PART = 1 << 17


def _pooled(blocks: DataFrame, by: list[str], parts: int) -> DataFrame:
    """(by, _lo, _total, _n) with adjacent violators pooled within ``parts`` ranges of key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, schema = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [[k] * len(held) for k in here] + [list(c) for c in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            schema = b.schema
            for k, lo, total, n in zip(_keys(b, by), *[b.column(i).to_pylist() for i in range(len(by), len(by) + 3)], strict=True):
                if k != here:
                    yield from out()
                    here, held = k, []
                while held and held[-1][1] * n > total * held[-1][2]:
                    lo, total, n = held[-1][0], held[-1][1] + total, held[-1][2] + n
                    held.pop()
                held.append((lo, total, n))
        yield from out()

    rows = blocks.select(*by, "_lo", "_total", "_n")
    dealt = rows.repartitionByRange(parts, *by, "_lo") if parts > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions(*by, "_lo").mapInArrow(run, rows.schema)


def isotonic(curve: DataFrame, by: list[str], x: str, y: str, increasing: bool = True) -> DataFrame:
    """Least-squares monotonic values by pooling adjacent violators: (by, x, y, fitted), a row each. Rows of equal x are one point of their number's weight.

    Violators may be pooled in any order with the same result. So tasks pool ranges of places, each block kept as its first place, sum and number, and rounds
    over the blocks that are left follow, cut at other places, until no neighbours are out of order; at most ``PART`` blocks are settled by one task.
    Rows with a null or NaN in x or y are left out.
    """
    sign = 1.0 if increasing else -1.0
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = curve.select(*by, x, y).where(there(x) & there(y))
    points = written(rows.groupBy(*by, x).agg((sign * F.sum(F.col(y).cast("double"))).alias("_total"), F.count("*").cast("double").alias("_n")))
    blocks, turn = points.withColumnRenamed(x, "_lo"), 0
    while True:
        parts = -(-blocks.count() // PART)
        blocks = written(_pooled(blocks, by, max(1, parts + turn % 2 if parts > 1 else parts)))
        turn += 1
        if parts <= 1:
            break
        means = blocks.select(*by, "_lo", (F.col("_total") / F.col("_n")).alias("_mean"))
        if following(means, by, "_lo", ["_mean"]).where("next__mean < _mean").isEmpty():
            break
    fitted = blocks.select(*by, "_lo", (sign * F.col("_total") / F.col("_n")).alias("fitted"))
    starts = matched(points.select(*by, x), fitted.select(*by, F.col("_lo").alias(x), F.col("_lo").alias("_start")), [*by, x], "left")
    held = scan(starts, by, x, cuts(points, x), most=["_start"]).withColumn("_lo", F.coalesce("_start", "below__start"))
    of_point = matched(held, fitted, [*by, "_lo"]).select(*by, x, "fitted")
    return matched(rows, of_point, [*by, x])
