"""Grouped fits against single ones, row-local BM25 and the series of the kernel."""

import math

import numpy as np
import pytest

from tierwise.functions import lexical
from tierwise.operators import fit, smoothing
from tierwise.sources import files


@pytest.fixture
def labelled(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g, slope in (("a", 2.0), ("b", -1.0), (None, 0.5)):
        for i in range(150):
            x, z = float(rng.normal()), float(rng.normal() * 5)
            rows.append((g, i, x, z, bool(rng.random() < 1 / (1 + math.exp(-slope * x - 0.1 * z)))))
    return spark.createDataFrame([*rows, ("a", 999, None, 1.0, True)], "g string, i long, x double, z double, y boolean").repartition(3)


def test_grouped_fits_equal_single_ones(labelled):
    got = {(r.g, r.c): r for r in fit.fit_groups(labelled, ["g"], ["x", "z"], "y", (0.1, 10.0)).collect()}
    assert len(got) == 6
    for (g, c), r in got.items():
        mine = labelled.where("x is not null").where("g is null" if g is None else f"g = '{g}'")
        one = fit.fit_logistic(mine, ["x", "z"], "y", c)
        assert [*r.weights, r.bias] == pytest.approx([*one["weights"], one["bias"]], abs=2e-4)


def test_balanced_grouped_fits_equal_single_ones(labelled):
    for r in fit.fit_groups(labelled, ["g"], ["x", "z"], "y", balanced=True).collect():
        mine = labelled.where("x is not null").where("g is null" if r.g is None else f"g = '{r.g}'")
        one = fit.fit_balanced(mine, ["x", "z"], "y")
        assert [*r.weights, r.bias, *r.mean, *r.scale] == pytest.approx([*one["weights"], one["bias"], *one["mean"], *one["scale"]], abs=2e-3)


def test_grid_of_groups_without_validation_rows(labelled):
    got = {r.g: r for r in fit.train_grid(labelled, labelled.where("g = 'a'"), ["g"], ["x", "z"], "y", (1.0, 5.0)).collect()}
    assert (got["b"].c, got["b"].f1, got["b"].tau) == (1.0, 0.0, 0.5) and got["a"].f1 > 0.7 and got[None].c == 1.0


def test_bm25_by_the_formula(spark):
    rows = [(1, "The cat sat. A dog ran! The cat ran.", "cat cat ran"), (2, "One.", ""), (3, None, None), (3, "x y. x z. x.", "x z"), (4, "... !", "a")]
    got = [(r.k, r.bm25_max, r.bm25_mean) for r in lexical.bm25(spark.createDataFrame(rows, "k int, c string, q string"), "k", "c", "q").collect()]

    def plain(sentences, query):
        n, avg = len(sentences), sum(map(len, sentences)) / len(sentences)
        terms = {t for s in sentences for t in s}
        idf = {t: math.log((n - sum(t in s for s in sentences) + 0.5) / (sum(t in s for s in sentences) + 0.5)) for t in terms}
        idf = {t: v if v >= 0 else 0.25 * sum(idf.values()) / len(idf) for t, v in idf.items()}
        scores = [sum(idf.get(t, 0) * s.count(t) * 2.5 / (s.count(t) + 1.5 * (0.25 + 0.75 * len(s) / avg)) for t in query) for s in sentences]
        return max(scores), sum(scores) / n

    want = [(1, *plain([["the", "cat", "sat"], ["a", "dog", "ran"], ["the", "cat", "ran"]], ["cat", "cat", "ran"])), (2, 0, 0), (3, 0, 0), (3, *plain([["x", "y"], ["x", "z"], ["x"]], ["x", "z"])), (4, 0, 0)]
    assert sorted(got) == [pytest.approx(w) for w in sorted(want)]


def test_kernel_series_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=300), 40.0, 1e6, 1e6]
    y = rng.normal(size=len(x))
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("two", 1.0, 3.0), ("two", 2.0, 5.0), ("a", None, 1.0), ("one", 4.0, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0), ("flat", 2.0, 5.0)]
    got = {(r.g, r.x): r.value for r in smoothing.kernel_smooth(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    h = 1.06 * x.std() * len(x) ** -0.2
    for a in np.unique(x):
        w = np.exp(-0.5 * ((x - a) / h) ** 2)
        assert got["a", float(a)] == pytest.approx((w * y).sum() / w.sum(), abs=1e-9)
    assert (got["two", 1.0], got["two", 2.0], got["one", 4.0], got["flat", 2.0]) == (3.0, 5.0, 1.0, 3.0)


def test_a_report_has_all_rows(spark):
    lines = files.markdown_report(spark.range(1500), "All").splitlines()
    assert len(lines) == 1504 and lines[:3] == ["# All", "", "| id |"] and lines[-1] == "| 1499 |"
