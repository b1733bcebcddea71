"""Order statistics, running sums and carried series against plain versions, with slices, parts and blocks small enough to be crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierwise.operators import carried, curves, metrics, ordered, relational, smoothing


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ordered, "SLICES", 7)
    monkeypatch.setattr(ordered, "BLOCK", 16)
    monkeypatch.setattr(carried, "PART", 9)


def made(n=400):
    """One hot group of two, a value that a third of its rows hold, nulls, NaN and a null group."""
    rng = np.random.default_rng(4)
    g = ["hot" if i % 10 else ["cold", None][i % 20 == 0] for i in range(n)]
    v = [None if i % 17 == 3 else 5.0 if i % 3 == 0 else float(np.round(rng.normal() * 10, 1)) for i in range(n)]
    return [(a, b, i, bool(rng.integers(2)), float(rng.integers(4)) / 4) for i, (a, b) in enumerate(zip(g, v))]


SCHEMA = "g string, v double, id long, ok boolean, risk double"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


def by_group(rows=None):
    out = {}
    for r in rows or made():
        out.setdefault(r[0], []).append(r)
    return out


def test_percentiles_are_exact(small, frame):
    got = {r.g: (r.a, r.b, r.c) for r in ordered.percentiles(frame, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g, rows in by_group().items():
        assert got[g] == pytest.approx(tuple(np.percentile([r[1] for r in rows if r[1] is not None], [0, 37, 100])))


def test_percentiles_of_groups_without_values(small, spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    assert sorted((r.g, r.p) for r in ordered.percentiles(df, ["g"], "v", {"p": 0.5}).collect()) == [("a", None), ("b", 2.0)]
    assert ordered.percentiles(df.where("false"), ["g"], "v", {"p": 0.5}).collect() == []


def test_running_sums_equal_a_window(small, frame):
    got = {(r.g, r.v): (r.n, r.below_n, r.all_n) for r in ordered.running(frame, ["g"], "v", n=F.lit(1)).collect()}
    for g, rows in by_group().items():
        for v in {r[1] for r in rows}:
            below = sum(v is not None and (r[1] is None or r[1] < v) for r in rows)
            assert got[g, v] == (sum(r[1] == v for r in rows), below, len(rows))


def test_ranks_and_nearest_means(small, frame):
    rows = {r.id: r._rank for r in ordered.ranked(frame, ["g"], "v", "id").collect()}
    for own in by_group().values():
        order = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [rows[r[2]] for r in order] == list(range(len(order)))
    got = {r.id: r.m for r in smoothing.nearest_mean(frame.where("v is not null"), ["g"], "v", "id", {"m": "risk"}, k=5).collect()}
    for own in by_group([r for r in made() if r[1] is not None]).values():
        order = sorted(own, key=lambda r: (r[1], r[2]))
        for i, r in enumerate(order):
            near = sorted(range(max(0, i - 5), min(len(order), i + 6)), key=lambda j: (abs(order[j][1] - r[1]), abs(j - i), j))[:5]
            assert got[r[2]] == pytest.approx(np.mean([order[j][4] for j in near]))


def test_slices_of_equal_count_part_ties_by_position(small, frame):
    got = {(r.g, r.bin): (r.center, r.cap, r.n) for r in curves.count_curve(frame.where("v is not null"), ["g"], "v", "id", "ok").collect()}
    for g, own in by_group([r for r in made() if r[1] is not None]).items():
        order, size = sorted(own, key=lambda r: (r[1], r[2])), max(1, len(own) // 10)
        for b in range(10):
            part = [r for i, r in enumerate(order) if min(i // size, 9) == b]
            if part:
                assert got[g, b] == pytest.approx((np.mean([r[1] for r in part]), np.mean([r[3] for r in part]), len(part)))


def test_holm_and_areas(small, frame):
    df = frame.where("v is not null").withColumn("p", F.abs("v") / 1000)
    got = {r.id: r.p_holm for r in metrics.holm(df, ["g"], "p", ["id"]).collect()}
    areas = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"], "ok", "p").collect()}
    for g, own in by_group([r for r in made() if r[1] is not None]).items():
        run = 0.0
        for i, r in enumerate(sorted(own, key=lambda r: (abs(r[1]), r[2]))):
            run = max(run, abs(r[1]) / 1000 * (len(own) - i))
            assert got[r[2]] == pytest.approx(min(1.0, run))
        pos, neg = ([abs(r[1]) for r in own if r[3] == k] for k in (True, False))
        assert areas[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))


def test_interpolation_over_slices(small, spark):
    df = spark.createDataFrame([("g", float(i), float(i * i)) for i in range(40)], "g string, center double, cap double")
    got = {r.d: r.value for r in curves.interpolate(df, ["g"], [-3.0, 0.5, 17.25, 38.5, 99.0]).collect()}
    assert got == {d: pytest.approx(np.interp(d, np.arange(40), np.arange(40) ** 2)) for d in got} and len(got) == 5


def test_ewm_of_one_key_over_many_parts(spark):
    rng = np.random.default_rng(9)
    values = [None if i in (0, 1, 7) or rng.random() < 0.1 else float(rng.normal()) for i in range(500)]
    rows = [("one", i, x) for i, x in enumerate(values)] + [("few", 0, 2.0), (None, 0, None), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = carried.ewm_mean(df, ["k"], ["i"], "x", 0.3)
        got = {(r.k, r.i): r.ewm for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = None
    for i, x in enumerate(values):
        if x is not None:
            state = x if state is None else 0.3 * x + 0.7 * state
        assert got["one", i] == pytest.approx(state) if state is not None else got["one", i] is None
    assert got["few", 0] == 2.0 and got[None, 0] is None and got[None, 1] == 4.0


def plain_pool(y):
    held = []
    for v in y:
        held.append([float(v), 1])
        while len(held) > 1 and held[-2][0] / held[-2][1] > held[-1][0] / held[-1][1]:
            s, n = held.pop()
            held[-1][0] += s
            held[-1][1] += n
    return [s / n for s, n in held for _ in range(n)]


@pytest.mark.parametrize("kind", ["noise", "falling", "late"])
def test_isotonic_over_many_parts(small, spark, kind):
    rng = np.random.default_rng(1)
    y = {"noise": np.arange(200) / 50 + rng.normal(size=200), "falling": -np.arange(200.0), "late": np.r_[np.arange(199.0), -5000.0]}[kind]
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": np.arange(200.0), "y": y})).unionByName(spark.createDataFrame([("b", 1.0, 3.0), ("b", 2.0, 1.0), ("b", None, 1.0)], "g string, x double, y double"))
    up = {(r.g, r.x): r.fitted for r in carried.isotonic(df, ["g"], "x", "y").collect()}
    assert [up["a", float(i)] for i in range(200)] == pytest.approx(plain_pool(y))
    assert up["b", 1.0] == up["b", 2.0] == 2.0 and len(up) == 202
    down = {(r.g, r.x): r.fitted for r in carried.isotonic(df, ["g"], "x", "y", increasing=False).collect()}
    assert [down["a", float(i)] for i in range(200)] == pytest.approx([-v for v in plain_pool(-y)])


def test_isotonic_of_a_million_points(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") / 1e5 + F.sin(F.col("id") * 12.9898) * 3).alias("y"))
    got = carried.isotonic(df, ["g"], "x", "y").orderBy("x").select("y", "fitted").toPandas()
    assert np.allclose(got["fitted"], plain_pool(got["y"]), atol=1e-9)


def test_qcut_with_nulls(small, frame):
    got = relational.qcut(frame, "v", 4, ["g"]).collect()
    for g, own in by_group().items():
        edges = np.percentile([r[1] for r in own if r[1] is not None], [25, 50, 75])
        assert all(r.bin == (None if r.v is None else int((r.v > edges).sum())) for r in got if r.g == g)
