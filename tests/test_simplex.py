"""Weights from sums of blocks against those of whole groups."""

import numpy as np
import pytest

from tierwise.operators import simplex as SX


def test_sums_of_blocks_give_the_weights_of_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(SX, "BLOCK_ROWS", 16)
    monkeypatch.setattr(SX, "BETWEEN", 3)
    rng = np.random.default_rng(4)
    rows = []
    for g, share in (("a", 0.5), (None, 0.15), ("rare", 0.05)):
        for i in range(90):
            y = float(rng.random() < share)
            rows.append((g, i % 9, i // 9, y + float(rng.normal()), float(rng.normal() * 3 - y), 7.0, float(rng.normal()) if i % 11 else None, y))
    rows += [("small", 0, i, float(i), 1.0, 7.0, 0.0, float(i % 2)) for i in range(5)]
    d = spark.createDataFrame(rows, "g string, i int, j int, p double, q double, flat double, noise double, y double").repartition(3)
    descent = SX.Descent(steps=7, rate=0.5, grid=(1e-3, 0.1))
    run = lambda whole: {r.g: r for r in SX.learn_weights(d, ["g"], ["p", "q", "flat", "noise"], "y", ["i", "j"], descent, whole).collect()}
    want, got = run(1000), run(0)
    assert set(got) == set(want) == {"a", None, "rare", "small"}
    for g, r in want.items():
        assert got[g].weights == pytest.approx(r.weights, abs=1e-9) and got[g].entropy_reg == r.entropy_reg


def test_no_rows(spark):
    assert SX.learn_weights(spark.createDataFrame([], "g int, i int, x double, y double"), ["g"], ["x"], "y", ["i"]).collect() == []


def test_equal_rows_of_a_large_group_are_counted_and_fitted_in_one_task(spark, monkeypatch):
    """A group of many rows but few different ones takes no pass a step."""
    monkeypatch.setattr(SX, "BETWEEN", 1)
    rng = np.random.default_rng(5)
    kinds = [(float(a), float(b), float(rng.random() < 0.3 + 0.1 * a)) for a in range(4) for b in range(3)]
    d = spark.createDataFrame([(g, i, *kinds[(i * i + i // 5) % 12]) for g in ("a", None) for i in range(150)], "g string, i int, p double, q double, y double").repartition(3)
    descent = SX.Descent(steps=40, rate=0.5, grid=(1e-3, 0.1))
    steps = []
    per_step = SX.written
    monkeypatch.setattr(SX, "written", lambda table: (steps.append(1), per_step(table))[1])
    run = lambda whole: {r.g: r for r in SX.learn_weights(d, ["g"], ["p", "q"], "y", ["i"], descent, whole).collect()}
    want, got = run(1000), run(20)
    assert set(got) == {"a", None} and len(steps) < 8
    for g, r in want.items():
        assert got[g].weights == pytest.approx(r.weights, abs=1e-9) and got[g].entropy_reg == r.entropy_reg
