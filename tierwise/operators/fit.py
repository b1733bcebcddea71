"""Logistic regression for failure prediction, and scoring with stored weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import written
from .metrics import best_f1_threshold, correlation
from .ordered import matched
from .simplex import learn_weights, simplex_weights  # noqa: F401


def fit_logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0) -> dict:
    """L2 logistic regression on raw features; weights, bias and features of one model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = df.count()
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features, F.col(label).cast("double").alias("_y")))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    return {"features": features, "weights": [float(w) for w in m.coefficients], "bias": float(m.intercept)}


def fit_balanced(df: DataFrame, features: list[str], label: str) -> dict:
    """As fit_logistic on population-standardised features with balanced class weights; keeps the scaler."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    agg = df.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean, scale = [agg[f"m_{f}"] for f in features], [agg[f"s_{f}"] or 1.0 for f in features]
    y = F.col(label).cast("double")
    weight = F.when(y == 1, agg["n"] / (2 * max(1, agg["p"]))).otherwise(agg["n"] / (2 * max(1, agg["n"] - agg["p"])))
    z = df.select(*[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, scale, strict=True)], y.alias("_y"), weight.alias("_w"))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(z)
    m = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / max(1, agg["n"]), standardization=False, maxIter=200).fit(rows)
    return {"features": features, "weights": [float(w) for w in m.coefficients], "bias": float(m.intercept), "mean": mean, "scale": scale}


#: How a scale divides: the divisor, or None where the feature counts for nothing.
ZERO_SCALE = {
    "zero_is_one": lambda s: s or 1.0,
    "tiny_is_one": lambda s: 1.0 if abs(s) <= 1e-12 else s,
    "add_tiny": lambda s: s + 1e-8,
    "drop": lambda s: s if s > 0 else None,
    "clip_tiny": lambda s: max(s, 1e-10),
}


def linear_score(weights: dict[str, float], bias: float, mean: dict[str, float] | None = None, scale: dict[str, float] | None = None, zero_scale: str = "tiny_is_one") -> Column:
    """p(fail) of stored weights. zero_scale: one of five ways in which a scale divides (ZERO_SCALE). Missing features are null."""
    z = F.lit(float(bias))
    for name, w in weights.items():
        s = ZERO_SCALE[zero_scale]((scale or {}).get(name, 1.0))
        if s is not None:
            z = z + w * (F.col(name) - (mean or {}).get(name, 0.0)) / s
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def select_by_correlation(df: DataFrame, by: list[str], features: list[str], target: str, least: float = 0.03) -> DataFrame:
    """(by, feature, r, active): features whose population correlation with the target reaches ``least``, or the two greatest if fewer do.

    A feature or target that hardly varies has r = 0. Missing values count as 0.
    """
    x = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    one = df.groupBy(*by).agg(*[correlation(x(f), x(target)).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).alias("r")) for i, f in enumerate(features)])
    ranked = one.select(*by, F.array_sort(F.transform(pairs, lambda p: F.struct((-F.abs(p["r"])).alias("k"), p["i"].alias("i"), p["feature"].alias("feature"), p["r"].alias("r")))).alias("_p"))
    enough = F.size(F.filter("_p", lambda p: -p["k"] >= least)) >= 2
    rows = ranked.select(*by, enough.alias("_e"), F.posexplode("_p").alias("_n", "_q"))
    return rows.select(*by, F.col("_q.feature").alias("feature"), F.col("_q.r").alias("r"), F.when(F.col("_e"), -F.col("_q.k") >= least).otherwise(F.col("_n") < 2).alias("active"))


#: Newton steps at most, and the largest change of a weight at which they end.
STEPS, SETTLED = 40, 1e-9


def fit_groups(df: DataFrame, by: list[str], features: list[str], label: str, strengths: tuple[float, ...] = (1.0,), balanced: bool = False) -> DataFrame:
    """L2 logistic regressions of all groups and strengths at once: (by, c, weights, bias, mean, scale).

    Each Newton step is one pass over the rows: gradients and curvatures are sums by group and strength, solved a row each. Equal to fit_logistic for each
    group and strength c, or with ``balanced`` to fit_balanced: features standardised by the group's population mean and deviation, both labels of equal weight.
    The bias is not penalised; a group of one label has weights near 0 and a bias that grows until the steps end. Rows with a missing feature or label are left out.
    """
    d = len(features)
    x = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    rows = df.select(*by, F.array(*x).alias("_x"), y.alias("_y")).where(F.col("_y").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    moments = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"), *[F.avg(F.col("_x")[i]).alias(f"_m{i}") for i in range(d)], *[F.stddev_pop(F.col("_x")[i]).alias(f"_s{i}") for i in range(d)])
    if balanced:
        mean, scale = F.array(*[F.col(f"_m{i}") for i in range(d)]), F.array(*[F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i in range(d)])
        weight = F.array(*[F.col("_n") / (2 * F.greatest(F.lit(1.0), n)) for n in (F.col("_n") - F.col("_p"), F.col("_p"))])
    else:
        mean, scale, weight = F.array(*[F.lit(0.0)] * d), F.array(*[F.lit(1.0)] * d), F.array(F.lit(1.0), F.lit(1.0))
    start = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.array(*[F.lit(0.0)] * (d + 1)).alias("w")) for c in strengths])
    models = written(moments.select(*by, mean.alias("mean"), scale.alias("scale"), weight.alias("_lw"), F.explode(start).alias("_s")).select(*by, "mean", "scale", "_lw", "_s.c", "_s.w", F.lit(1.0).alias("_step")))
    pairs = [(i, j) for i in range(d + 1) for j in range(i + 1)]
    packed = T.StructType([*models.schema.fields[: len(by) + 3], *[T.StructField("c", T.DoubleType()), T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("_step", T.DoubleType())]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("c", "w", "_g", "_h")}
            new, steps = [], []
            for c, w, g, h in zip(at["c"], at["w"], at["_g"], at["_h"], strict=True):
                w, ridge = np.array(w), np.r_[np.full(d, 1.0 / c), 0.0]
                curve = np.zeros((d + 1, d + 1))
                for (i, j), v in zip(pairs, h, strict=True):
                    curve[i, j] = curve[j, i] = v
                step = np.linalg.solve(curve + np.diag(ridge + 1e-12), np.array(g) + ridge * w)
                step *= min(1.0, 10.0 / max(1e-300, np.abs(step).max()))
                new.append((w - step).tolist())
                steps.append(float(np.abs(step).max()))
            kept = [b.column(b.schema.get_field_index(f.name)) for f in packed.fields[: len(by) + 4]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(new, pa.list_(pa.float64())), pa.array(steps, pa.float64())], [f.name for f in packed.fields])

    for _ in range(STEPS):
        held = models.groupBy(*by).agg(F.first("mean").alias("mean"), F.first("scale").alias("scale"), F.first("_lw").alias("_lw"), F.collect_list(F.struct("c", "w")).alias("_all"))
        z = F.concat(F.transform(F.arrays_zip("_x", "mean", "scale"), lambda t: (t["_x"] - t["mean"]) / t["scale"]), F.array(F.lit(1.0)))
        put = matched(rows, held, by).withColumn("_z", z).withColumn("_m", F.explode("_all"))
        score = F.aggregate(F.zip_with("_z", F.col("_m.w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        put = put.withColumn("_q", 1.0 / (1.0 + F.exp(-score))).withColumn("_u", F.col("_lw")[F.col("_y").cast("int")])
        slope, bend = (F.col("_q") - F.col("_y")) * F.col("_u"), F.col("_q") * (1 - F.col("_q")) * F.col("_u")
        sums = put.groupBy(*by, F.col("_m.c").alias("c")).agg(
            F.array(*[F.sum(slope * F.col("_z")[i]) for i in range(d + 1)]).alias("_g"), F.array(*[F.sum(bend * F.col("_z")[i] * F.col("_z")[j]) for i, j in pairs]).alias("_h")
        )
        models = written(matched(models, sums, [*by, "c"]).mapInArrow(solve, packed))
        if models.where(F.col("_step") > SETTLED).isEmpty():
            break
    return models.select(*by, "c", F.slice("w", 1, d).alias("weights"), F.col("w")[d].alias("bias"), "mean", "scale")


def train_grid(train: DataFrame, val: DataFrame, by: list[str], features: list[str], label: str, strengths: tuple[float, ...] = (0.1, 1.0, 10.0), balanced: bool = False) -> DataFrame:
    """(by, c, weights, bias, mean, scale, f1, tau): for each group the model of the grid of strengths with the best F1 on the validation rows, the first of equal
    ones; its threshold comes from there as well. A group without validation rows has the first strength, an F1 of 0 and a threshold of 0.5."""
    models = fit_groups(train, by, features, label, strengths, balanced)
    held = models.groupBy(*by).agg(F.collect_list(F.struct("c", "weights", "bias", "mean", "scale")).alias("_all"))
    rows = matched(val.select(*by, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.col(label).cast("int").alias("_y")), held, by).withColumn("_m", F.explode("_all"))
    term = F.zip_with(F.zip_with(F.zip_with("_x", F.col("_m.mean"), lambda a, b: a - b), F.col("_m.scale"), lambda a, b: a / b), F.col("_m.weights"), lambda a, b: a * b)
    score = F.aggregate(term, F.col("_m.bias"), lambda s, v: s + v)
    judged = rows.select(*by, F.col("_m.c").alias("c"), "_y", (1.0 / (1.0 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), score))))).alias("_p"))
    found = matched(models, best_f1_threshold(judged, [*by, "c"], "_y", "_p"), [*by, "c"], "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    place = F.array_position(F.array(*[F.lit(float(c)) for c in strengths]), F.col("c"))
    best = found.groupBy(*by).agg(F.max_by(F.struct("c", "weights", "bias", "mean", "scale", "f1", F.coalesce("tau", F.lit(0.5)).alias("tau")), F.struct(F.col("f1"), -place)).alias("_b"))
    return best.select(*by, "_b.*")
