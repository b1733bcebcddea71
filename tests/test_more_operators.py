"""Operators without SQL against plain versions, and edge cases of the newer ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwise.functions import lexical as L
from tierwise.functions import text as X
from tierwise.operators import bridge as B
from tierwise.operators import fit as T
from tierwise.operators import frozen as Z
from tierwise.operators import governance as G
from tierwise.operators import metrics as M
from tierwise.operators import profiles as P
from tierwise.operators import relational as R
from tierwise.operators import search as S
from tierwise.operators import smoothing as W
from tierwise.operators import splits as SP
from tierwise.sources import files


def plain_weights(rows, target, steps, rate, slope, ent):
    """One descent on the simplex in plain loops."""
    d, n = len(rows[0]), len(rows)
    pos = sum(t > 0.5 for t in target)
    w = [1 / d] * d
    for _ in range(steps):
        grad = [0.0] * d
        for x, t in zip(rows, target):
            weight = n / (2 * max(1, pos)) if t > 0.5 else n / (2 * max(1, n - pos))
            err = (1 / (1 + math.exp(-slope * (sum(a * b for a, b in zip(w, x)) - 0.5))) - t) * weight
            for k in range(d):
                grad[k] += err * slope * x[k]
        w = [max(0.0, max(1e-9, w[k]) - rate * (grad[k] / n - ent * (math.log(max(1e-9, w[k])) + 1))) for k in range(d)]
        w = [max(1e-9, v / sum(w)) for v in w] if sum(w) > 0 else [1 / d] * d
        w = [v / sum(w) for v in w]
    return w


def test_simplex_weights():
    rng = np.random.default_rng(0)
    y = (rng.random(60) < 0.4).astype(float)
    x = np.c_[y * 0.8 + rng.random(60) * 0.3, rng.random(60), np.full(60, 3.0), y * 0.3 + rng.random(60)]
    got, ent = T.simplex_weights(x, y, steps=30, grid=(0.01,))
    assert ent == 0.01 and got.sum() == pytest.approx(1) and got[2] < 1e-8
    low, high = np.sort(x[:48], axis=0)[2], np.sort(x[:48], axis=0)[45]
    active = [k for k in range(4) if got[k] > 1e-8]
    z = np.clip((x - low) / np.where(high <= low, 1, high - low), 0, 1)[:, active]
    want = plain_weights(z.tolist(), y.tolist(), 30, 0.05, 8.0, 0.01)
    assert got[active] == pytest.approx(want, abs=1e-6)
    assert T.simplex_weights(x[:5], y[:5], steps=3)[0].sum() == pytest.approx(1)


def test_learned_weights_by_group(spark):
    rows = [(g, i, float(i % 2) + 0.01 * (i % 7), float(i % 5), float(i % 2)) for g in ("a", "b") for i in range(40)]
    d = spark.createDataFrame(rows, "g string, i int, good double, noise double, y double")
    for r in T.learn_weights(d, ["g"], ["good", "noise"], "y", ["i"]).collect():
        assert r["weights"][0] > r["weights"][1] and sum(r["weights"]) == pytest.approx(1)


def test_repair_of_training_rows(spark):
    rows = [("t", f"s{i}", "train" if i < 4 else "val" if i < 6 else "test", m, k, bool(bad)) for k, (m, fails) in enumerate({"a": {5}, "b": {0, 7}, "c": set()}.items()) for i in range(8) for bad in [i in fails]]
    d = spark.createDataFrame(rows, "task string, sample string, split string, model string, model_order int, failed boolean")
    got = {r["sample"]: r["split"] for r in SP.repair_train(d).collect()}
    # Model a lacks a failure in train: s5 goes in, s3 (the last that did not fail) goes to val; b has both; c never fails.
    assert got == {"s0": "train", "s1": "train", "s2": "train", "s3": "val", "s4": "val", "s5": "train", "s6": "test", "s7": "test"}


def test_ablations():
    names = ["token_count", "noun_ratio", "bm25_max", "embedding_query_context_cosine"]
    assert SP.ablated(names, "all_features") == names and SP.ablated(names, "no_embedding") == names[:3]
    assert SP.ablated(names, "lexical_surface") == names[:2] and SP.ablated(["x"], "syntax_entities") == ["x"]


def test_bootstrap_covers_the_mean_alike_at_any_partitioning(spark):
    d = spark.range(2000).select(F.col("id"), (F.col("id") % 4).cast("string").alias("g"), (F.col("id") % 10).cast("double").alias("y"))
    one = {r["g"]: (r["lo"], r["hi"]) for r in W.bootstrap_mean(d, ["g"], "y", "id").collect()}
    many = {r["g"]: (r["lo"], r["hi"]) for r in W.bootstrap_mean(d.repartition(7), ["g"], "y", "id").collect()}
    for g, (lo, hi) in one.items():
        ys = [i % 10 for i in range(2000) if i % 4 == int(g)]
        se = np.std(ys) / math.sqrt(len(ys))
        assert many[g] == pytest.approx((lo, hi)) and lo < np.mean(ys) < hi
        assert hi - lo == pytest.approx(2 * 1.645 * se, rel=0.25)
    assert W.bootstrap_mean(d.where("false"), ["g"], "y", "id").count() == 0


def test_smoothed_curve_is_pooled(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random() < 0.5, rng.random()) for _ in range(300)]
    got = sorted(S.smoothed_curve(spark.createDataFrame([("m", *r) for r in rows], "m string, d double, ok boolean, risk double"), ["m"], "d", "ok", "risk").collect(), key=lambda r: r["bin"])

    def pooled(values):
        """Least squares by the max-min formula."""
        n = len(values)
        mean = lambda a, b: sum(values[a : b + 1]) / (b - a + 1)
        return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]

    bins = [[r for r in rows if math.floor(r[0] * 10) == k] for k in range(10)]
    assert [r["cap"] for r in got] == pytest.approx(pooled([sum(r[1] for r in b) / len(b) for b in bins]))
    assert [r["risk"] for r in got] == pytest.approx([-v for v in pooled([-sum(r[2] for r in b) / len(b) for b in bins])])


def test_annotated_fields_come_first(spark):
    arcs = [(1, 4), (6, 2)]
    rows = [([1, 2, 3], None, 0.9, 0.4, 0.2, arcs, "Because it rains, then stop"), (None, -2.0, None, 0.4, 0.7, None, "plain"), (None, None, None, None, None, [], "if a then b, that is because")]
    d = spark.createDataFrame(rows, "facts array<int>, hops double, rag double, alone double, given double, arcs array<struct<head:int,dep:int>>, text string")
    t = F.col("text")
    got = d.select(X.reasoning_steps(t, (F.col("facts"),), (F.col("hops"),), 0.5).alias("a"), X.parametric_dependence(t, F.col("rag"), F.col("alone"), F.col("given")).alias("b"), X.dependency_distance(t, F.col("arcs")).alias("c"), X.reasoning_proxy(t, 0.5).alias("p"), X.knowledge_dependence(t).alias("k"), X.clause_distance(t).alias("q")).collect()
    assert (got[0]["a"], got[0]["b"], got[0]["c"]) == (3.0, pytest.approx(0.5), 3.5)
    assert (got[1]["a"], got[1]["b"], got[1]["c"]) == (0.0, 0.7, got[1]["q"])
    assert (got[2]["a"], got[2]["b"], got[2]["c"]) == (got[2]["p"], got[2]["k"], got[2]["q"])


def test_entropy_and_interactions(spark):
    texts = ["a b a b", "one", "", None, "x x x y", "Same same SAME"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for t, r in zip(texts, d.select(X.text_entropy(F.col("text")).alias("h")).collect()):
        w = (t or "").lower().split()
        want = -sum(w.count(v) / len(w) * math.log2(w.count(v) / len(w)) for v in set(w))
        assert r["h"] == pytest.approx(abs(want))
    r = d.limit(1).select(*[c.alias(n) for n, c in X.interactions(F.lit(2), F.lit(3), F.lit(5), F.lit(0.5), F.lit(0.1)).items()]).first()
    assert tuple(r) == (6, 2.5, pytest.approx(0.2))


def test_centred_mean_edges(spark):
    values = [1.0, None, 3.0, float("nan"), 5.0, 6.0]
    d = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r["m"] for r in d.select("i", R.centred_mean(F.col("v"), [], ["i"], 5).alias("m")).orderBy("i").collect()]
    there = lambda a, b: np.mean([v for v in values[max(0, a) : b] if v is not None and v == v])
    assert got == pytest.approx([there(0, 5), there(0, 5), there(0, 5), there(1, 6), there(2, 6), there(3, 6)])
    assert spark.createDataFrame([], "i int, v double").select(R.centred_mean(F.col("v"), [], ["i"], 5)).count() == 0


def test_calibration_edges(spark):
    p = [0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0]
    y = [0, 1, 1, 0, 1, 1, 1]
    d = spark.createDataFrame([("m", a, b) for a, b in zip(p, y)], "m string, p double, y int")
    edges, want = np.linspace(0, 1, 11), 0.0
    for k in range(10):
        inside = [j for j, v in enumerate(p) if edges[k] <= v and (v < edges[k + 1] or (k == 9 and v <= 1))]
        if inside:
            want += len(inside) / len(p) * abs(np.mean([y[j] for j in inside]) - np.mean([p[j] for j in inside]))
    assert M.calibration_error(d, ["m"], "y", "p", 10).first()["ece"] == pytest.approx(want)


def test_flat_columns_have_no_correlation(spark):
    d = spark.createDataFrame([("g", 1.0, float(i)) for i in range(4)], "g string, x double, y double")
    assert M.guarded_correlation(d, ["g"], "x", "y").first()["r"] == 0.0


def test_defaults_and_errors(spark):
    table = spark.createDataFrame([("a", 1.0, 2.0), ("*", 3.0, 4.0)], "task string, tau1 double, tau2 double")
    rows = spark.createDataFrame([("a",), ("b",)], "task string")
    assert sorted(map(tuple, B.with_default(rows, table, ["tau1", "tau2"]).collect())) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    no_star = table.where("task <> '*'")
    with pytest.raises(Exception, match="no default for task b"):
        B.with_default(rows, no_star, ["tau1"]).collect()
    assert sorted(map(tuple, B.tier_limits(rows, no_star).collect())) == [("a", 1.0, 2.0), ("b", 3.2, 4.0)]
    with pytest.raises(Exception, match="tau2 below tau1"):
        B.tier_limits(rows, spark.createDataFrame([("a", 5.0, 2.0)], "task string, tau1 double, tau2 double")).collect()
    with pytest.raises(Exception, match="leakage guard failed: missing_report_rows"):
        spark.range(1).select(P.assert_no_leakage(P.leakage(F.lit("train"), F.lit(True), F.lit(1), F.lit(1), F.lit(0)))).collect()
    with pytest.raises(ValueError, match="weights need"):
        G.weighted_score({d: F.lit(1) for d in G.DIMENSIONS}, G.WEIGHTS | {"SK": 1})
    with pytest.raises(ValueError, match="missing score column"):
        R.difficulty_bins(rows, "score", [])
    with pytest.raises(ValueError, match="unknown mode"):
        S.run_validation(rows, [], "d", "ok", "risk", "ok", "other")
    assert B.default_profile(spark.createDataFrame([], ", ".join(f"{d} int" for d in G.DIMENSIONS))).first()["TC"] == 3


def test_frozen_summaries_on_odd_rows(spark):
    s = spark.createDataFrame([("maths", "m", None, None, None), ("maths", "m", 0.1, True, None), ("unknown", "m", 0.1, True, True)], "task string, model string, p_fail double, slm_correct boolean, llm_correct boolean")
    models = Z.frozen_test_models(s).collect()
    assert [(r["task"], r["n"], r["slm_routed"], r["accuracy_on_slm_routes"], r["accuracy_on_llm_routes"]) for r in models] == [("maths", 2, 1, 1.0, 0.0)]
    none = Z.frozen_validation(s, s.where("false").withColumns({"query_id": F.lit(1), "pos": F.lit(1)}), "pos").first()
    assert (none["total_queries"], none["slm_accuracy"], none["tier"]) == (0, 0.0, "SLM")
    assert Z.summary_of_test(Z.frozen_test(Z.frozen_test_models(s.where("false")))).first()["overall_failure_rate"] == 0.0


def test_empty_reports(spark):
    empty = spark.createDataFrame([], "task string, model string, slm_routed long, llm_routed long")
    assert tuple(P.impact_overall(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert P.impact_by_task(empty).count() == 0 and P.objective_rankings(spark.createDataFrame([], "ord int, slm double, llm double, hybrid_ratio double, slm_coverage double, gap double")).count() == 0


def test_lexical_edges(spark):
    d = spark.createDataFrame([(1, None, "maths"), (2, "", "maths"), (3, "One sentence only", "maths"), (4, "Text. Query: ", "maths"), (5, "Read. Summary: short", "summarization")], "i int, x string, task string")
    got = {r["i"]: (r["context"], r["query"]) for r in L.split_query(d, "x", "task").collect()}
    assert got == {1: ("", ""), 2: ("", ""), 3: ("One sentence only", ""), 4: ("Text.", "Query:"), 5: ("Read.", "Summary: short")}
    f = {r["i"]: r for r in L.lexical_features(d, "x", "task").collect()}
    assert f[1]["token_count"] == 0 and f[3]["type_token_ratio"] == 1.0 and f[1]["bm25" if "bm25" in f[1] else "context_query_overlap_ratio"] == 0
    b = {r["i"]: (r["bm25_max"], r["bm25_mean"]) for r in L.bm25(d.select("i", F.col("x").alias("c"), F.lit("query").alias("q")), "i", "c", "q").collect()}
    assert b[1] == b[2] == (0.0, 0.0) and len(b) == 5


def test_files(spark, tmp_path):
    raw = tmp_path / "bench" / "run1" / "raw"
    raw.mkdir(parents=True)
    (raw / "a.json").write_text('{"mode": "dry_run"}')
    (raw / "b.json").write_text('{"rows": 3}')
    (tmp_path / "bench" / "run1" / "c.json").write_text("{}")
    got = sorted((r["benchmark"], r["overall_status"], r["notes"]) for r in files.audit_history(spark, str(tmp_path)).collect())
    assert got == [("bench", "complete", []), ("bench", "partial", ["dry_run detected"])]
    rows = files.records(spark, [[1], {"b": "x"}, [2, "y"]], "a int, b string")
    assert list(files.to_records(rows)) == [{"a": 1, "b": None}, {"a": None, "b": "x"}, {"a": 2, "b": "y"}]
    files.write_json(rows, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").count() == 3
    assert files.setup_report("t", None).endswith("Seed: unknown") and "Task: t" in files.setup_report("t", 3)


def test_clean_splits_and_grid(spark):
    rows = [("t", m, f"q{i}" if i < 60 else None, "train" if i % 2 else "val", i, (i + k) % 3 == 0) for k, m in enumerate("ab") for i in range(62)]
    rows += [("t", "a", "q1", "val", 99, True), ("t", "b", "only_b", "val", 1, True)]
    d = spark.createDataFrame(rows, "task string, model string, canonical_id string, file string, line int, failed boolean")
    split, counts = SP.build_clean_splits(d, {"train": 0, "val": 1}, cap=50)
    got = split.collect()
    assert len(got) == 50 and "only_b" not in {r["sample"] for r in got} and {r["split"] for r in got} == {"train", "val", "test"}
    assert sum(r["fail_0"] + r["fail_1"] for r in counts.collect()) == 100
    train = spark.createDataFrame([(g, i / 40 + 0.1 * (i % 3), int(i > 20)) for g in "xy" for i in range(40)], "g string, f double, y int")
    models = [r.asDict() for r in T.train_grid(train, train, ["g"], ["f"], "y", (0.1, 10.0)).collect()]
    assert [m["g"] for m in models] == ["x", "y"] and all(m["f1"] > 0.8 and m["weights"][0] > 0 for m in models)


def test_recalibrated_policy(spark):
    from tierwise.operators.rollups import recalibrated_policy

    tests = spark.createDataFrame([("maths", 0.6, 0.5, 0.1), (None, 0.5, 0.5, 0.5)], "task string, positive_rate double, f1 double, ece double")
    runs = spark.createDataFrame([("maths", 0.1, None), ("other", 0.9, 0.9)], "task string, tau_cap double, tau_risk double")
    scores = spark.createDataFrame([("maths", 3.0), ("other", 1.0)], "task string, s3 double")
    got = {r["task"]: r for r in recalibrated_policy(tests, runs, scores, {}).collect()}
    assert got["maths"]["SK"] == 4 and got["maths"]["tau1"] == pytest.approx(3.2 - (0.25 * 2.2 + 0.2 * 1.4), abs=1e-3)
    assert got["other"]["TC"] == 2 and got["other"]["tau1"] is None


def test_annotation(spark):
    d = spark.createDataFrame([("classification", "a b a", "c"), ("retrieval_grounded", "who", "when or where"), ("maths", "If x then compute", None), ("retrieval_grounded", "who", ""), ("information_extraction", "must", None)], "task string, x string, c string")
    got = [(r["difficulty_dim"], r["difficulty_score"], r["difficulty_feature_n_in"]) for r in X.annotate(d, "task", "x", "c").collect()]
    assert got[0] == ("H", pytest.approx(0.918296, abs=1e-5), 3.0) and got[1] == ("n_in", 4.0, 4.0) and got[3][1] == 1.0
    assert got[2][0] == "R_hat" and got[2][1] == pytest.approx(1.8) and got[4][:2] == ("|Gamma|", 1.0)


def test_use_case_features(spark):
    d = spark.createDataFrame([("good",), (None,), ("It is not good, never bad. Happy!",)], "x string")
    rows = d.select(*[c.alias(n) for n, c in X.use_case_features(F.col("x")).items()]).collect()
    assert set(rows[0]) == set(rows[1]) == {0.0}
    assert (rows[2]["negation_count"], rows[2]["sentence_count"], rows[2]["token_count"]) == (2.0, 2.0, 10.0) and rows[2]["sentiment_lexicon_score"] == pytest.approx(1 / 7)


def test_interpolation_isotonic_and_mcnemar_queries(spark):
    from tierwise.queries import queries

    sf = "/root/testdata/sf0.01"
    q = queries()
    curves = {}
    for r in q["count_curve"](spark, sf).collect():
        curves.setdefault(r["model"], []).append((r["center"], r["cap"]))
    for r in q["curve_interpolation"](spark, sf).collect():
        x, y = zip(*sorted(curves[r["model"]]))
        assert r["value"] == pytest.approx(np.interp(r["d"], x, y), abs=1e-4)
    fitted = {}
    for r in q["isotonic_curve"](spark, sf).collect():
        fitted.setdefault(r["model"], []).append((r["center"], r["cap"], r["fitted"]))
    for rows in fitted.values():
        rows.sort()
        caps = [c for _, c, _ in rows]
        mean = lambda a, b: sum(caps[a : b + 1]) / (b - a + 1)  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(k, len(caps))) for a in range(k + 1)) for k in range(len(caps))]
        assert [f for _, _, f in rows] == pytest.approx(want, abs=1e-5)
    chi = {r["model"]: r["chi2"] for r in q["mcnemar_chi2"](spark, sf).collect()}
    for r in q["mcnemar_p"](spark, sf).collect():
        assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(chi[r["model"]] / 2)), abs=1e-4)


def test_stated_constraints(spark):
    texts = ["You must include exactly three bullet points and a json table", "nothing", None, "Do not exceed 100 words; cite a source at most once"]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(X.constraint_count(F.col("x")).alias("n")).collect()]
    import re

    for t, n in zip(texts, got):
        assert n == sum(len(re.findall(p, f" {(t or '').lower()} ")) for p in X.CONSTRAINT_PATTERNS)
    listed = spark.createDataFrame([("must", ["a", "b"], None)], "x string, p array<string>, q array<string>")
    assert listed.select(X.constraint_count(F.col("x"), F.col("p"), F.col("q")).alias("n")).first()["n"] == 2


def test_early_patterns_count_as_the_plain_ones(spark):
    """Odd letters of the same case class, word ends beyond ASCII, and white space and line terminators of all kinds."""
    texts = ["Step ſtep STEP éstep stepé step_ 1step; (first) do not don't DON'T doNot words Word(s) at least atmost Kor or", "nör nor ör or_ or, OR 1999 1850ß é1999 a1999 2024", "", None, "must́ must, ́must no more than format|JSON", "that Which, while;or AND"]
    d = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = [X.CONTRAST, X.HEDGES, X.NEGATION, X.PROHIBITIONS, X.STEPS, X.CONFLICTS, X.YEARS, r"\bor\b", *X.CONSTRAINT_PATTERNS, r"\b(first|second|third|step|ordered|sorted)\b"]
    assert all(X.early(p) != p for p in plain)
    for r in d.select(*[F.struct(X.pattern_count(F.col("x"), p), F.regexp_count("x", F.lit(f"(?iU){p}"))) for p in plain], F.struct(X.stated_constraints(F.col("x")), X.total([F.coalesce(F.regexp_count("x", F.lit(f"(?iU){p}")), F.lit(0)) for p in X.CONSTRAINT_PATTERNS]))).collect():
        for p, (got, want) in zip([*plain, "all"], r, strict=True):
            assert got == want, p


def test_texts_are_read_once(spark):
    """What words tell is one call of a query; no plan lower-cases a text for each cue or finds tokens for each feature."""
    from tierwise.queries import queries

    plan = lambda n: queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for n, calls in (("difficulty_proxies", 1), ("difficulty_annotation", 2), ("annotated_proxies", 1)):
        assert 0 < plan(n).count("_word_facts(") <= calls, n
    assert plan("use_case_features").count("regexp_extract_all(lower(") + plan("use_case_features").count("\\p{N}\\p{M}_]+|") <= 2
    assert 0 < plan("governance_scores").count("lower(") <= 8


def test_names_behind_terminators_and_all_white_space(spark):
    rows = ["A Big Dog. Then Cat", "x\u0085 Big", "x.\u0085 Big", "x   Big", " First word", "a\x0bBig b Big", None]
    d = spark.createDataFrame([(x,) for x in rows], "x string")
    assert [r[0] for r in d.select(X.word_facts(F.col("x"))["names"]).collect()] == [3.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
