"""Reference semantics on inline fixtures: missing values, ties, edges, governance rules."""

import pytest
from pyspark.sql import functions as F

from tierwise.functions import nullsafe as N
from tierwise.operators import curves as C
from tierwise.operators import economics as E
from tierwise.operators import governance as G
from tierwise.operators import metrics as M
from tierwise.operators import relational as R
from tierwise.operators import routing as T
from tierwise.operators import rollups as P
from tierwise.operators import smoothing as S
from tierwise.operators.fit import fit_logistic
from tierwise.operators.carried import ewm_mean, isotonic
from tierwise.sources import files, ingest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_merge_matches_null_keys_and_suffixes_right_only(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    got = R.merge(a, b, ["k"])
    assert got.columns == ["k", "v", "v_y"]
    assert rows(got, "v") == [(1, "a", "x"), (None, "b", "y"), (None, "c", "y")]


def test_missing_values_in_aggregates(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", float("nan"))], "g string, x double")
    got = dict((r["g"], (r["m"], r["s"])) for r in R.group_agg(d, "g", m=("x", "mean"), s=("x", "sum")).collect())
    assert got["a"] == (1.0, 1.0) and got["b"] == (0.0, 0.0) and got["c"][1] == 0.0 and got["c"][0] != got["c"][0]


def test_safe_div_round_and_logic(spark):
    r = spark.range(1).select(
        N.safe_div(F.lit(1), F.lit(0)).alias("a"), N.safe_div(F.lit(None).cast("int"), F.lit(2)).alias("b"), N.one_to_five(F.lit(2.5)).alias("c"),
        N.both(F.lit(None).cast("boolean"), F.lit(True)).alias("d"), N.clip(F.lit(None).cast("int"), 1, 2).alias("e"),
    ).first()
    assert tuple(r) == (0.0, 0.0, 2, False, None)


def test_latest_takes_the_last_of_ties(spark):
    d = spark.createDataFrame([("k", "t", 1), ("k", "t", 2), ("k", None, 3)], "k string, ts string, pos int")
    assert R.latest(d, "k", "ts", "pos").first()["pos"] == 2


@pytest.mark.parametrize("window", [4, 5])
def test_centred_mean_keeps_full_width_at_the_left(spark, window):
    xs = [1.0, None, 4.0, 8.0, 16.0, 32.0, 64.0]
    d = spark.createDataFrame(list(enumerate(xs)), "pos int, x double").withColumn("g", F.lit(1))
    got = [r[0] for r in d.select("pos", R.centred_mean(F.col("x"), ["g"], ["pos"], window).alias("m")).orderBy("pos").select("m").collect()]
    want = []
    for i in range(len(xs)):
        a = max(0, i - window // 2)
        v = [x for x in xs[a : min(len(xs), a + window)] if x is not None]
        want.append(sum(v) / len(v))
    assert got == pytest.approx(want)


def test_ewm_seeds_and_repeats(spark):
    d = spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, 4.0)], "pos int, x double").withColumn("g", F.lit(1))
    assert [r["ewm"] for r in ewm_mean(d, ["g"], ["pos"], "x", 0.5).orderBy("pos").collect()] == [None, 2.0, 2.0, 3.0]


def test_bins_with_ties_and_constants(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None)], "g int, x double")
    assert [r["bin"] for r in R.cut(d, "x", 3, ["g"]).orderBy(F.col("x").asc_nulls_last()).collect()] == [0, 0, None]
    assert [r["bin"] for r in R.qcut(d, "x", 3, ["g"]).orderBy(F.col("x").asc_nulls_last()).collect()] == [0, 0, None]


def test_routes_and_tiers_at_the_boundaries(spark):
    r = spark.range(1).select(
        T.route(F.lit(0.5), F.lit(0.5)), T.route(F.lit(0.5), F.lit(0.5), inclusive=True), T.tier(F.lit(0.5)), T.tier(F.lit(0.3)), T.tier(F.lit(0.3), inclusive_llm=True), T.tau_of(F.lit("nope"))
    ).first()
    assert tuple(r) == ("LLM", "SLM", "SLM", "HYBRID", "LLM", None)


def test_governance_gates(spark):
    r = spark.range(1).select(G.gate(F.lit(5), F.lit(4)), G.gate(F.lit(1), F.lit(4)), G.governance_tier(F.lit(1.0), F.lit("hybrid")), G.enforce(F.lit("hybrid"), F.lit("odd"), F.lit(True)), G.enforce(F.lit("pure_slm"), F.lit("BASELINE"), F.lit(False))).first()
    assert tuple(r) == ("disqualified", "hybrid", "hybrid", "BASELINE", "SLM")
    with pytest.raises(ValueError):
        G.weighted_score({}, {"TC": 5, "OS": 1, "SK": 1, "DS": 1, "LT": 1, "VL": 1})


def test_fixed_targets(spark):
    d = spark.createDataFrame([(1, i / 10, i < 5, 0.02) for i in range(10)], "g int, d double, ok boolean, r double").withColumn("base", F.lit(0.95))
    got = C.fixed_tau(d, ["g"], "d", "ok", "r", "base").first()
    assert got["tau"] == pytest.approx(0.6) and got["strict"]


def test_isotonic_and_interpolation(spark):
    c = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 2.0)], "g int, center double, cap double")
    assert [r["fitted"] for r in isotonic(c, ["g"], "center", "cap").orderBy("center").collect()] == [1.0, 2.5, 2.5]
    assert [r["value"] for r in C.interpolate(c, ["g"], [-1.0, 0.5, 9.0]).orderBy("d").collect()] == [1.0, 2.0, 2.0]


def test_single_class_has_no_area(spark):
    d = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.4)], "g int, y int, p double")
    assert M.roc_auc(d, ["g"], "y", "p").first()["roc_auc"] is None and M.pr_auc(d, ["g"], "y", "p").first()["pr_auc"] is None


def test_pareto_keeps_equals(spark):
    d = spark.createDataFrame([("a", 0.9, 0.1, 1.0, 1.0), ("b", 0.9, 0.1, 1.0, 1.0), ("c", 0.8, 0.1, 1.0, 1.0)], "m string, cap double, risk double, lat double, cost double").withColumn("g", F.lit(1))
    assert [r["m"] for r in E.pareto(d, ["g"], "cap", "risk", "lat", "cost").orderBy("m").collect()] == ["a", "b"]


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(p), "a int", strict=False).count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int", strict=False).count() == 0
    files.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "a int, b string"), "a") == [(1, None)]


def test_normalisers(spark):
    d = spark.createDataFrame([("m", [("do", "done", 1, 2, 0.5), ("x", "y", 0, 0, None)])], "model string, responses array<struct<instruction string, response string, constraints_satisfied int, total_constraints int, latency_sec double>>")
    got = ingest.instruction_following(d).orderBy("example_id").collect()
    assert [r["primary_metric"] for r in got] == [0.5, 0.0] and got[0]["example_id"] == "if_0"
    ie = spark.createDataFrame([("m", "d1", "test", "t", {"a": "1"}, {"a": "1"}, ["a", "b"], True, 0.1)], "model string, doc_id string, split string, text string, prediction map<string,string>, reference_fields map<string,string>, required_fields array<string>, schema_valid boolean, latency_seconds double")
    assert ingest.information_extraction(ie).first()["primary_metric"] == 1.0


def test_logistic_separates(spark):
    d = spark.createDataFrame([(i / 10, int(i > 5)) for i in range(12)], "x double, y int")
    assert fit_logistic(d, ["x"], "y")["weights"][0] > 0


def test_smoothing_of_few_rows_and_nearest(spark):
    d = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 1.0, 0.0), ("b", 3, 0.0, 1.0), ("b", 4, 1.0, 0.0), ("b", 5, 9.0, 0.0), ("b", 6, None, 1.0)], "g string, i int, x double, y double")
    got = {(r["g"], r["x"]): r["value"] for r in S.kernel_smooth(d, ["g"], "x", "y").collect()}
    assert got["a", 0.0] == 1.0 and got["a", 1.0] == 0.0 and 0.0 < got["b", 9.0] < 0.5 and ("b", None) not in got
    near = {r["i"]: r["m"] for r in S.nearest_mean(d.where("x is not null"), ["g"], "x", "i", {"m": "y"}, k=2).collect()}
    assert near == {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.0}


def test_policy_leaves_out_runs_without_task(spark):
    d = spark.createDataFrame([("m", 0.5, 0.6, None), (" ", 1.0, 0.0, 1.0), (None, 1.0, 0.0, 1.0)], "t string, fail double, f1 double, ece double")
    assert rows(P.recommend_tiers(d, "t", "fail", "f1", "ece", {"m": (2.5, 3.3)}), "task") == [("m", 2.03, 2.83, 0.5, 0.6, 0.0, 0.47)]
    runs = spark.createDataFrame([("m", 0.1, None), ("n", None, None)], "task string, tau_cap double, tau_risk double")
    s3 = spark.createDataFrame([("m", 3.0), ("n", 2.0), ("o", 3.0)], "task string, s3 double")
    assert rows(P.recommend_scores(runs, s3), "task") == [("m", 4, 4), ("n", 2, 2), ("o", 4, 4)]


def test_sanitised_features(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0, None), (2.0, 4.0, 1.0, 1.0), (3.0, 6.0, 1.0, 2.0)], "a double, b double, c double, d double")
    assert P.sanitise_features(d, ["a", "b", "c", "d"]) == {"keep": ["a"], "null": ["d"], "low_variance": ["c"], "high_correlation": ["b"]}
