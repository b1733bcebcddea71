"""Archive, served features and ablations against plain versions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwise.functions import served as V
from tierwise.operators import fit, splits
from tierwise.plans.archive import archived, write_archive


def test_archive_bins_by_quantiles_of_each_task(spark, tmp_path):
    words = lambda n: " ".join(f"w{j}" for j in range(n))
    rows = [("many", i, words(i + 1), None) for i in range(20)] + [("three", i, words(3 * i), None) for i in range(3)] + [("one", 0, "x", "y"), ("none", 0, None, None)]
    d = spark.createDataFrame(rows, "task string, id int, text string, context string")
    got = {(r.task, r.id): (r.difficulty_dim, r.difficulty_score, r.difficulty_bin) for r in archived(d, "task", "text", "context").collect()}
    assert len(got) == 25 and all(dim == "n_in" for dim, _, _ in got.values())
    score = np.arange(1, 21)
    edges = np.quantile(score, np.linspace(0, 1, 6))
    assert [got["many", i][2] for i in range(20)] == [max(0, int(np.searchsorted(edges, s, "left")) - 1) for s in score]
    assert [got["three", i][2] for i in range(3)] == [0, 1, 2] and got["one", 0][1] == 1.0
    out = {r.task: r for r in write_archive(d, "task", "text", "context", str(tmp_path / "a")).collect()}
    assert {t: r.row_count for t, r in out.items()} == {"many": 20, "three": 3, "one": 1, "none": 1}
    assert spark.read.json(out["many"].archive_path).count() == 20
    assert archived(d.limit(0), "task", "text", "context").count() == 0


def plain(text, reference):
    x = f"{text or ''} {reference or ''}"
    w, s = x.split(), [p for p in x.split(".") if p.strip()]
    n, low = max(1, len(w)), x.lower()
    good, bad = (sum(low.count(v) for v in words) for words in (V.NICE, V.NASTY))
    out = {
        "token_count": len(w), "sentence_count": len(s), "avg_word_length": sum(map(len, w)) / n, "type_token_ratio": len(set(w)) / n,
        "stopword_ratio": sum(v.lower() in V.MORE_STOP_WORDS for v in w) / n, "entity_count": sum(v[0].isupper() and len(v) > 1 for v in w),
        "flesch_kincaid_grade": max(0, 0.39 * len(w) / len(s) + 11.8 * len(re.findall("[aeiou]", x)) / len(w) - 15.59) if w and s else 0,
        "gunning_fog": 0.4 * (len(w) / len(s) + 100 * sum(len(v) > 6 for v in w) / len(w)) if w and s else 0,
        "sentiment_lexicon_score": good / (good + bad) if good + bad else 0.5, "digit_ratio": sum(any(c.isdigit() for c in v) for v in w) / n,
        "question_mark_density": x.count("?") / max(1, len(s)),
    }
    return out | {k: sum(v in low for v in words) / (n if of == "words" else max(1, len(s))) for k, (of, words) in V.MARKERS.items()}


def test_served_features_by_the_formulas(spark):
    rows = [("Solve 3x + 4 = 10. Then CHECK the step? Good, goodness!", "bad A Bc"), ("", None), (None, None), ("...", "."), ("Zürich. \n . Élan must not\tcount", "number"), ("word " * 5000, "x")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, reference string")
    got = {r.i: r.f for r in d.select("i", V.served_features(F.col("text"), F.col("reference")).alias("f")).collect()}
    for i, r in enumerate(rows):
        for name, value in plain(*r).items():
            assert got[i][name] == pytest.approx(value), (i, name)


def test_query_features_by_family_and_context(spark):
    rows = [("maths", "add 1 + 2", "1 and 2"), ("code_generation", "Sort the tree()", None), ("instruction_following", "You must do it. Never stop", ""), (None, None, "c"), ("maths", "", "A a")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, task string, text string, context string")
    f = {r.i: r.f for r in d.select("i", V.query_features(F.col("task"), F.col("text"), F.col("context")).alias("f")).collect()}
    assert (f[0].digit_ratio, f[0].math_symbol_density, f[0].context_token_count, f[0].context_query_overlap_ratio, f[0].bm25_query_context_max) == (0.5, 0.25, 3, pytest.approx(2 / 3), 0.5)
    assert f[0].bm25_query_context_mean == pytest.approx(0.35) and f[0].code_symbol_density is None
    assert (f[1].code_symbol_density, f[1].algorithm_keyword_density, f[1].context_token_count) == (pytest.approx(1 / 3), pytest.approx(2 / 3), None)
    assert (f[2].imperative_root_ratio, f[2].constraint_keyword_density, f[2].bm25_query_context_max) == (1.0, pytest.approx(2 / 6), None)
    assert (f[3].token_count, f[3].context_token_count, f[4].context_query_overlap_ratio, f[4].bm25_query_context_max, f[4].digit_ratio) == (0, 1, 0, 0, 0)


def test_ablations_equal_fits_without_the_features(spark):
    rng = np.random.default_rng(2)
    names = ["token_count", "noun_ratio", "bm25_max", "embedding_query_context_cosine"]
    rows = [(*map(float, v), bool(rng.random() < 1 / (1 + math.exp(-v[0] + v[2])))) for v in rng.normal(size=(120, 4))]
    d = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y boolean").repartition(3)
    got = {r.ablation: r for r in splits.ablation_models(d, d, [], names, "y").collect()}
    assert set(got) == set(splits.ABLATIONS)
    for a, r in got.items():
        kept = splits.ablated(names, a)
        one = fit.fit_balanced(d, kept, "y")
        weights = dict(zip(names, r.weights, strict=True))
        assert [weights[f] for f in kept] == pytest.approx(one["weights"], abs=2e-3) and all(weights[f] == 0 for f in names if f not in kept)


def test_ablations_write_their_features_once(spark, monkeypatch):
    """The fits read written rows, not the features' expressions, in each of their passes."""
    kept, held = [], splits.written
    monkeypatch.setattr(splits, "written", lambda x: kept.append(x.columns) or held(x))
    seen = []
    monkeypatch.setattr(splits, "train_grid", lambda train, val, *rest, **more: seen.extend([train, val]))
    d = spark.range(8).select(F.length(F.sha2(F.col("id").cast("string"), 256)).alias("token_count"), F.col("id").alias("unused"), (F.col("id") > 3).alias("y"))
    splits.ablation_models(d, d, [], ["token_count"], "y")
    assert kept == [["token_count", "y"]] * 2 and all("sha2" not in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)
