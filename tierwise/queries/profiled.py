"""Queries of bridge joins, policies, operational profiles and reports, over events as model runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bridge as B
from ..operators import economics as E
from ..operators import frozen as Z
from ..operators import profiles as P
from ..operators import rollups as U
from ..operators import routing as G
from ..operators import splits as SP
from .analytics import _SCORED, rounded, scored
from .governed import _SCORES, scores
from .served import _RUNS, _TEST, _VALID, runs, validated
from .tables import t


def signal(s, d):
    r = runs(s, d).groupBy("task", "model", F.col("query_id").alias("sample_id")).agg(F.max("slm_correct").alias("correct"))
    return rounded(B.routing_signal(r, "view"), "signal_rate")


def limits(s, d):
    r = runs(s, d)
    artifacts = r.groupBy("task", "model").agg(F.max("p_fail").alias("tau")).withColumn("seed", F.length("model") % 2)
    report = r.groupBy("task", "model").agg(F.min("p_fail").alias("tau_cap")).select("task", "model", F.lit(1).alias("seed"), F.when(F.col("task") < "m", F.col("tau_cap")).alias("tau_cap"), F.lit(None).cast("double").alias("tau_risk"))
    over = r.groupBy("task", "model").agg(F.avg("p_fail").alias("tau_risk")).where("model <> 'view'").select("task", "model", F.lit(None).cast("double").alias("tau_cap"), "tau_risk")
    return rounded(B.resolved_limits(artifacts, report, over), "tau", "tau_cap", "tau_risk", n=9)


def profile_rows(s, d):
    """Scores by task, with a profile for all others."""
    x = scores(s, d).withColumn("task", F.element_at(F.array(*[F.lit(f) for f in G.FAMILIES]), (F.col("doc_id") % 8 + 1).cast("int")))
    return x.where("task < 'm'").groupBy("task").agg(*[F.max(c).alias(c) for c in ("TC", "OS", "SK", "DS", "LT", "VL")])


_PROFILE = f"{_SCORES}, pr AS (SELECT {'[' + ', '.join(repr(f) for f in G.FAMILIES) + ']'}[doc_id % 8 + 1] AS task, * EXCLUDE (doc_id) FROM sc), p AS (SELECT task, max(\"TC\") AS \"TC\", max(\"OS\") AS \"OS\", max(\"SK\") AS \"SK\", max(\"DS\") AS \"DS\", max(\"LT\") AS \"LT\", max(\"VL\") AS \"VL\" FROM pr WHERE task < 'm' GROUP BY 1)"
_DIMS = ("TC", "OS", "SK", "DS", "LT", "VL")
_MEAN = ", ".join(f'CAST(round_even(avg("{c}"), 0) AS INT) AS "{c}"' for c in _DIMS)


def with_star(s, d):
    table = B.task_config(profile_rows(s, d))
    return B.with_default(runs(s, d).select("task").distinct(), table, list(_DIMS))


def policy(s, d):
    x = validated(s, d).select("task", F.when(F.col("tier") == "SLM", "pure_slm").when(F.col("tier") == "LLM", "llm_only").otherwise("hybrid").alias("tier"), F.when(F.col("task") < "m", "Gate hit").alias("gate_reason"))
    table = s.createDataFrame([("*", "hybrid"), ("maths", "disqualified"), ("code_generation", "pure_slm")], "task string, requested string")
    return B.governed(x, table).withColumn("lane", B.lane(F.col("tier") == "disqualified", F.col("tier")))


def thresholds(s, d):
    r = runs(s, d).select(F.col("model").alias("model_name"), "pos")
    names = s.createDataFrame([("view", None, 0.1), ("b", "click", 0.2), ("error", "gone", 0.3)], "key string, display_name string, tau double")
    return B.threshold_rows(names, r).select("pos", "key", "model_name", "tau")


def crossed(s, d):
    r = runs(s, d)
    a = r.groupBy("task", F.col("model").alias("source_model")).agg(F.min("p_fail").alias("tau"))
    return rounded(B.cross_model(a, r.select("task", F.col("model").alias("target_model"), "p_fail")).groupBy("task", "source_model", "target_model").agg(F.avg((F.col("p_fail") > F.col("tau")).cast("double")).alias("rate"), F.count("*").alias("n")), "rate")


GRIDS = {"cap": [0.6, 0.65], "risk": [0.2, 0.3], "bins": [5, 10], "mode": ["fixed", "adaptive"]}


def calls(s, d):
    """Runs as call records with files, statuses and latencies."""
    k = F.col("event_id")
    return t(s, d, "events").select(
        F.col("event_type").alias("task"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(k % 13 != 0, F.concat(F.lit("q"), F.floor(k / 3).cast("string"))).alias("canonical_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("val", "test", "train", "outputs")]), (k % 4 + 1).cast("int")).alias("file"),
        k.alias("line"),
        F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
        F.when(k % 7 == 0, "error").otherwise("success").alias("status"),
        F.when(k % 5 != 0, k % 9 != 0).alias("valid"),
        F.when(k % 6 != 0, F.col("value") / 10).alias("latency"),
        (F.col("user_id") % 10).alias("bin"),
        F.when(k % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in ("timeout", "refusal", "truncation", "hallucination")]), (F.floor(F.col("value")) % 4 + 1).cast("int"))).alias("category"),
        (k % 10 / 10).alias("risk"),
    )


_CALLS = """k AS (SELECT event_type AS task, 'm' || (user_id % 3) AS model, CASE WHEN event_id % 13 <> 0 THEN 'q' || (event_id // 3) END AS canonical_id, ['val', 'test', 'train', 'outputs'][event_id % 4 + 1] AS file, event_id AS line, strftime(ts, '%Y-%m-%d') AS timestamp,
 CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 5 <> 0 THEN event_id % 9 <> 0 END AS valid, CASE WHEN event_id % 6 <> 0 THEN value / 10 END AS latency, user_id % 10 AS bin, CASE WHEN event_id % 3 = 0 THEN ['timeout', 'refusal', 'truncation', 'hallucination'][floor(value)::BIGINT % 4 + 1] END AS category, (event_id % 10) / 10.0::DOUBLE AS risk FROM events)"""
_OK = "coalesce(status = 'success', false)"
RANKS = {"train": 0, "val": 1, "test": 2, "outputs": 3}


def taxonomy(s, d):
    x = calls(s, d).withColumns({"failed": F.col("category").isNotNull(), "harm": F.col("risk") * 2})
    return rounded(P.error_taxonomy(x, ["task", "model"], "failed", "risk", "harm", "category"), "avg_risk", "avg_harm", "failure_rate")


def leaks(s, d):
    x = calls(s, d).groupBy("task", "model").agg(F.count_if("valid").alias("n_val"), F.count_if(F.col("file") == "train").alias("n_train"), F.count("*").alias("n"))
    k = F.length("task")
    codes = P.leakage(F.when(k % 2 == 0, "test").otherwise("val"), F.col("model") == "m1", F.when(F.col("model") != "m2", F.col("n_val")).otherwise(0), F.col("n_train") - F.when(k > 6, F.col("n_train")).otherwise(0), F.col("n"))
    return x.select("task", "model", F.concat_ws(",", codes).alias("codes"))


_LEAKS = f"""WITH {_CALLS}, x AS (SELECT task, model, count(*) FILTER (valid) AS n_val, count(*) FILTER (file = 'train') AS n_train, count(*) AS n FROM k GROUP BY 1, 2)
SELECT task, model, concat_ws(',', CASE WHEN length(task) % 2 = 0 AND model <> 'm1' THEN 'threshold_split_must_be_val_for_test' END, CASE WHEN model = 'm2' OR n_val <= 0 THEN 'missing_val_threshold_rows' END, CASE WHEN length(task) > 6 OR n_train <= 0 THEN 'missing_train_curve_rows' END) AS codes FROM x"""


def labelled(s, d):
    return scored(s, d).withColumn("y", F.col("ok").cast("int"))


_SPLIT = f"""WITH {_SCORED}, m AS (SELECT model, count(*) AS n, avg(ok::INT) AS pr, avg(p) AS ap, avg(power(p - ok::INT, 2)) AS br, count(*) FILTER (ok AND p >= 0.3) AS tp, count(*) FILTER (NOT ok AND p >= 0.3) AS fp, count(*) FILTER (ok AND p < 0.3) AS fn FROM e GROUP BY 1),
 g AS (SELECT model, p, count(*) FILTER (ok) AS pos, count(*) FILTER (NOT ok) AS neg FROM e GROUP BY 1, 2), u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER w AS tps, sum(pos + neg) OVER w AS ns FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
 a AS (SELECT model, sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos)::DOUBLE * sum(neg)) AS auc, sum(pos * tps / ns::DOUBLE) / sum(pos) AS ap2 FROM u GROUP BY 1),
 b AS (SELECT model, len(list_filter([{', '.join(f'{k * (1.0 / 10)!r}::DOUBLE' for k in range(1, 10))}], lambda x: x <= p)) AS b, count(*) AS n, avg(ok::INT) AS acc, avg(p) AS conf FROM e GROUP BY 1, 2), c AS (SELECT model, sum(n * abs(acc - conf)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT model, n, round(pr, 6) AS positive_rate, round(ap, 6) AS avg_p, round(br, 6) AS brier, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy, round(auc, 6) AS roc_auc, round(ap2, 6) AS pr_auc, round(ece, 6) AS ece FROM m JOIN a USING (model) JOIN c USING (model)"""


def gates(s, d):
    x = calls(s, d)
    return P.sensitivity_summary(
        x.select("model", F.when(F.col("status") == "success", "Yes").otherwise("no").alias("passed"), F.col("latency").cast("string").alias("precision"), F.lit("n/a").alias("recall"), F.col("risk").alias("f1"), "risk", F.col("risk").alias("accuracy"), F.col("latency").alias("coverage_slm"), F.lit(None).cast("double").alias("delta_utility"), F.when(F.col("valid"), F.col("risk")).alias("p_holm")), ["model"]
    )


def swept(s, d):
    rho = validated(s, d).select(F.col("task").alias("use_case"), F.bround("rho_bar", 3).alias("rho_bar"))
    return G.sweep(rho, "rho_bar", [0.3, 0.5, 0.7, 0.9])


_SWEPT = f"{_VALID}, gr AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS x), pt AS (SELECT row_number() OVER (ORDER BY a.x, b.x) - 1 AS ord, a.x AS slm, b.x AS llm FROM gr a JOIN gr b ON b.x < a.x), sw AS (SELECT ord, slm, llm, task AS use_case, round_even(rho_bar, 3) AS rho_bar, CASE WHEN round_even(rho_bar, 3) >= slm THEN 'SLM' WHEN round_even(rho_bar, 3) <= llm THEN 'LLM' ELSE 'HYBRID' END AS tier FROM v, pt)"
_ROBUST = f"""WITH {_SWEPT}, c AS (SELECT *, CASE WHEN rho_bar >= slm THEN rho_bar - slm WHEN rho_bar <= llm THEN llm - rho_bar ELSE least(slm - rho_bar, rho_bar - llm) END AS m, CASE WHEN rho_bar >= slm THEN least(100, (rho_bar - slm) / (1.0::DOUBLE - slm) * 100) WHEN rho_bar <= llm THEN least(100, (llm - rho_bar) / llm * 100) ELSE least(rho_bar - llm, slm - rho_bar) / (slm - llm) * 100 END AS c FROM sw)
SELECT ord, slm, llm, round(greatest(0, 1 - (power(count(*) FILTER (tier = 'SLM') - count(*) / 3.0::DOUBLE, 2) + power(count(*) FILTER (tier = 'HYBRID') - count(*) / 3.0::DOUBLE, 2) + power(count(*) FILTER (tier = 'LLM') - count(*) / 3.0::DOUBLE, 2)) / 3.0::DOUBLE / power(count(*) / 3.0::DOUBLE, 2)), 6) AS diversity, round(least(1.0::DOUBLE, avg(m) * 5), 6) AS robustness, round(avg(c), 6) AS mean_confidence, round(min(c), 6) AS min_confidence, arg_min(use_case, (c, use_case)) AS riskiest FROM c GROUP BY 1, 2, 3"""


def objectives(s, d):
    x = swept(s, d).groupBy("ord", "slm", "llm").agg(F.avg((F.col("tier") == "HYBRID").cast("double")).alias("hybrid_ratio"), F.avg((F.col("tier") == "SLM").cast("double")).alias("slm_coverage"))
    return P.objective_rankings(x.withColumn("gap", F.round(F.col("slm") - F.col("llm"), 6)))


_OBJECTIVES = f"""WITH {_SWEPT}, x AS (SELECT ord, slm, llm, avg((tier = 'HYBRID')::INT) AS hr, avg((tier = 'SLM')::INT) AS sc, round(slm - llm, 6) AS gap FROM sw GROUP BY 1, 2, 3),
 o AS (SELECT 'minimize_hybrid' AS objective, arg_min(ord, (hr, gap, ord)) AS ord FROM x UNION ALL SELECT 'maximize_slm', arg_min(ord, (-sc, ord)) FROM x UNION ALL SELECT 'maximize_gap', arg_min(ord, (-gap, ord)) FROM x UNION ALL SELECT 'closest_to_paper', arg_min(ord, (abs(slm - 0.7::DOUBLE) + abs(llm - 0.3::DOUBLE), ord)) FROM x)
SELECT objective, ord, slm, llm FROM o JOIN x USING (ord)"""


def blended(s, d):
    e = scored(s, d).withColumns({"bin": F.least(F.lit(9), F.floor(F.col("d") / 20)).cast("int"), "task": F.lit("t")})
    bins = e.groupBy("task", "model", "bin").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("cap"), F.avg("risk").alias("risk"))
    base = bins.where("model = 'view' and bin <> 2").select("task", "bin", "cap", "risk")
    own = e.groupBy("task", "model").agg(F.avg(F.col("ok").cast("double")).alias("slm_cap"), F.avg("risk").alias("slm_risk"), (F.avg("d") / 50).alias("slm_latency"))
    own = own.withColumns({"slm_cost": E.direct_cost(F.lit(False), F.col("slm_latency")), "limit_bin": F.when(F.col("model") != "error", F.length("model") - 4)})
    models = own.withColumns({"base_cap": F.lit(0.7), "base_risk": F.lit(0.14), "base_latency": F.lit(0.9), "base_cost": F.lit(E.BASELINE_COST)})
    out = P.blended_strategy(bins, base, models)
    return rounded(out, *out.columns[2:], n=8)


_BLENDED = f"""WITH {_SCORED}, f AS (SELECT *, least(9, floor(d / 20)::INT) AS bin FROM e), b AS (SELECT model, bin, count(*) AS n, avg(ok::INT) AS cap, avg(risk) AS risk FROM f GROUP BY 1, 2), bb AS (SELECT bin, cap AS bc, risk AS br FROM b WHERE model = 'view' AND bin <> 2),
 o AS (SELECT model, count(*) AS total, avg(d) / 50 AS lat, CASE WHEN model <> 'error' THEN length(model) - 4 END AS lim FROM f GROUP BY 1),
 g AS (SELECT b.model, sum(CASE WHEN bin <= lim THEN n / total ELSE 0 END) AS sh, sum(n / total * CASE WHEN bin <= lim THEN cap ELSE coalesce(bc, 0.7::DOUBLE) END) AS cap, sum(n / total * CASE WHEN bin <= lim THEN risk ELSE coalesce(br, 0.14::DOUBLE) END) AS risk FROM b JOIN o USING (model) LEFT JOIN bb USING (bin) GROUP BY 1),
 h AS (SELECT 't' AS task, model, lim, CASE WHEN lim IS NULL THEN 0 ELSE sh END AS sh, CASE WHEN lim IS NULL THEN 0.7::DOUBLE ELSE cap END AS cap, CASE WHEN lim IS NULL THEN 0.14::DOUBLE ELSE risk END AS risk, lat FROM g JOIN o USING (model)),
 i AS (SELECT *, sh * lat + (1 - sh) * 0.9::DOUBLE AS latency, sh * lat * 0.0002::DOUBLE + (1 - sh) * 0.0035::DOUBLE AS cost FROM h),
 j AS (SELECT *, 0.05::DOUBLE * cap - 0.2::DOUBLE * risk - 0.0001::DOUBLE * latency - cost AS ev, 0.05::DOUBLE * 0.7::DOUBLE - 0.2::DOUBLE * 0.14::DOUBLE - 0.0001::DOUBLE * 0.9::DOUBLE - 0.0035::DOUBLE AS bev FROM i)
SELECT task, model, round(sh, 8) AS route_share, round(cap, 8) AS capability, round(risk, 8) AS risk, round(latency, 8) AS latency, round(cost, 8) AS cost, round(ev, 8) AS expected_value, round(0.0035::DOUBLE - cost, 8) AS savings, round(CASE WHEN lim IS NULL THEN 0 ELSE ev - bev END, 8) AS value_delta,
 CASE WHEN lim IS NOT NULL AND risk > 0.14::DOUBLE THEN round((0.05::DOUBLE * (cap - 0.7::DOUBLE) - (cost - 0.0035::DOUBLE) - 0.0001::DOUBLE * (latency - 0.9::DOUBLE)) / (risk - 0.14::DOUBLE), 8) END AS break_even_failure_loss FROM j"""


def required(s, d):
    x = calls(s, d).withColumns({"sample_id": F.col("canonical_id"), "prompt": F.lit("p"), "raw_output": F.when(F.col("line") % 4 != 0, "o")})
    return x.select("line", F.concat_ws(",", P.missing_fields()).alias("missing"))


def normed(s, d):
    e = t(s, d, "events")
    x = P.weighted_norm({"value": 0.7, "user_id": 0.3}, {"value": (10.0, 100.0), "user_id": (0.0, 0.0)})
    return e.select("event_id", F.round(x, 6).alias("score"))


def folds(s, d):
    return t(s, d, "events").select("event_id", P.fold(F.floor("value"), ["event_id"], 3, "event_type").alias("fold"))


QUERIES = {
    "routing_signal": (signal, f"WITH {_RUNS}, q AS (SELECT task, model, query_id, bool_or(slm_correct) AS c FROM r GROUP BY 1, 2, 3) SELECT a.task, a.model, count(b.c) AS n_common, count(*) FILTER (NOT a.c AND b.c) AS n_signal, round(coalesce(count(*) FILTER (NOT a.c AND b.c) / nullif(count(b.c), 0), 0), 6) AS signal_rate FROM q a LEFT JOIN q b ON b.task = a.task AND b.query_id = a.query_id AND b.model = 'view' WHERE a.model <> 'view' GROUP BY 1, 2"),
    "resolved_limits": (limits, f"WITH {_RUNS}, a AS (SELECT task, model, max(p_fail) AS tau, min(p_fail) AS lo, avg(p_fail) AS mean, length(model) % 2 AS seed FROM r GROUP BY 1, 2) SELECT task, model, seed, round(tau, 9) AS tau, round(CASE WHEN seed = 1 AND task < 'm' THEN lo ELSE tau END, 9) AS tau_cap, round(CASE WHEN model <> 'view' THEN mean ELSE tau END, 9) AS tau_risk FROM a"),
    "task_scores_with_default": (with_star, f"WITH {_PROFILE}, s AS (SELECT {_MEAN} FROM p) SELECT k.task, " + ", ".join(f'coalesce(p."{c}", s."{c}") AS "{c}"' for c in _DIMS) + " FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in G.FAMILIES) + "]) AS task) k CROSS JOIN s LEFT JOIN p USING (task)"),
    "task_config": (lambda s, d: B.task_config(profile_rows(s, d)), f"WITH {_PROFILE} SELECT '*' AS task, {_MEAN} FROM p UNION ALL SELECT task, " + ", ".join(f'"{c}"' for c in _DIMS) + " FROM p"),
    "policy_override": (policy, f"""WITH {_VALID}, pa AS (SELECT task, CASE tier WHEN 'SLM' THEN 'pure_slm' WHEN 'LLM' THEN 'llm_only' ELSE 'hybrid' END AS tier, CASE WHEN task < 'm' THEN 'Gate hit' END AS gate_reason, CASE task WHEN 'maths' THEN 'disqualified' WHEN 'code_generation' THEN 'pure_slm' ELSE 'hybrid' END AS asked FROM v),
        pb AS (SELECT *, CASE WHEN list_position(['pure_slm', 'hybrid', 'llm_only', 'disqualified'], asked) >= list_position(['pure_slm', 'hybrid', 'llm_only', 'disqualified'], tier) THEN asked ELSE tier END AS applied FROM pa)
        SELECT task, applied AS tier, asked AS policy_tier_requested, applied AS policy_tier_applied, CASE WHEN applied <> tier THEN coalesce(gate_reason, 'Gate pass') || ' | Policy Tier Override: ' || tier || ' -> ' || applied ELSE gate_reason END AS gate_reason, CASE applied WHEN 'disqualified' THEN 'Stop: disqualified' WHEN 'pure_slm' THEN 'SLM primary' WHEN 'hybrid' THEN 'Hybrid escalation' ELSE 'LLM only' END AS lane FROM pb"""),
    "threshold_rows": (thresholds, "SELECT event_id AS pos, CASE event_type WHEN 'view' THEN 'view' ELSE 'b' END AS key, event_type AS model_name, CASE event_type WHEN 'view' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS tau FROM events WHERE event_type IN ('view', 'click')"),
    "cross_model": (crossed, f"WITH {_RUNS}, a AS (SELECT task, model AS source_model, min(p_fail) AS tau FROM r GROUP BY 1, 2) SELECT r.task, source_model, r.model AS target_model, round(avg((p_fail > tau)::INT), 6) AS rate, count(*) AS n FROM r JOIN a ON a.task = r.task AND source_model <> r.model GROUP BY 1, 2, 3"),
    "parameter_grid": (lambda s, d: B.parameter_grid(s, GRIDS, 12), "SELECT row_number() OVER (ORDER BY cap, risk, bins, mode DESC) - 1 AS run, cap, risk, bins, mode FROM (SELECT unnest([0.6::DOUBLE, 0.65::DOUBLE]) AS cap), (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE]) AS risk), (SELECT unnest([5, 10]) AS bins), (SELECT unnest(['fixed', 'adaptive']) AS mode) QUALIFY run < 12"),
    "first_clean": (lambda s, d: P.first_clean(calls(s, d).where(P.clean(F.col("status"), F.col("valid"))), RANKS).select("task", "model", "canonical_id", "line"), f"WITH {_CALLS} SELECT task, model, canonical_id, line FROM k WHERE status = 'success' AND valid AND canonical_id <> '' QUALIFY row_number() OVER (PARTITION BY task, model, canonical_id ORDER BY CASE file WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, line) = 1"),
    "missing_fields": (required, f"WITH {_CALLS} SELECT line, concat_ws(',', CASE WHEN canonical_id IS NULL THEN 'sample_id' END, CASE WHEN line % 4 = 0 THEN 'raw_output' END, CASE WHEN valid IS NULL THEN 'valid' END) AS missing FROM k"),
    "leakage_guards": (leaks, _LEAKS),
    "average_latency": (lambda s, d: rounded(P.average_latency(calls(s, d), ["task", "model"], "canonical_id", "timestamp", "line", "latency"), "avg_latency"), f"WITH {_CALLS}, l AS (SELECT task, model, canonical_id, arg_max_null(latency, (timestamp, line)) AS latency FROM k GROUP BY 1, 2, 3) SELECT task, model, round(coalesce(avg(latency), 0), 6) AS avg_latency FROM l GROUP BY 1, 2"),
    "operational_profile": (lambda s, d: rounded(P.operational_profile(calls(s, d), ["task", "model"], "latency", F.col("status") == "success"), "avg_latency", "p50", "p95", "p99", "qps", "success_rate", "error_rate"), f"WITH {_CALLS} SELECT task, model, count(*) AS n, round(avg(latency), 6) AS avg_latency, round(quantile_cont(latency, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(latency, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(latency, 0.99::DOUBLE), 6) AS p99, round(1 / avg(latency), 6) AS qps, round(avg({_OK}::INT), 6) AS success_rate, round(1 - avg({_OK}::INT), 6) AS error_rate FROM k GROUP BY 1, 2"),
    "bin_summary": (lambda s, d: rounded(P.bin_summary(calls(s, d), ["task", "bin"], "status", "valid", "latency"), "success_rate", "avg_latency", "validity_rate"), f"WITH {_CALLS} SELECT task, bin, count(*) AS n_samples, round(avg({_OK}::INT), 6) AS success_rate, round(avg(latency), 6) AS avg_latency, round(avg(coalesce(valid, false)::INT), 6) AS validity_rate FROM k GROUP BY 1, 2"),
    "coverage_report": (lambda s, d: rounded(P.coverage_report(calls(s, d).groupBy("task", "bin").agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if((F.col("status") == "success") | (F.col("bin") > 4)).alias("target")), "success", "target"), "coverage_pct"), f"WITH {_CALLS}, g AS (SELECT task, bin, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'success' OR bin > 4) AS target FROM k GROUP BY 1, 2) SELECT task, bin, success, target, round(100.0::DOUBLE * success / target, 6) AS coverage_pct, success = target AS is_complete FROM g"),
    "error_taxonomy": (taxonomy, f"""WITH {_CALLS}, g AS (SELECT task, model, count(*) AS n_rows, count(category) AS n_failures, avg(risk) AS r FROM k GROUP BY 1, 2), n AS (SELECT task, model, category, count(*) AS n, row_number() OVER (PARTITION BY task, model ORDER BY count(*) DESC, category) AS rn FROM k WHERE category IS NOT NULL GROUP BY 1, 2, 3),
        w AS (SELECT task, model, max(category) FILTER (rn = 1) AS c1, max(n) FILTER (rn = 1) AS n1, max(category) FILTER (rn = 2) AS c2, max(n) FILTER (rn = 2) AS n2, max(category) FILTER (rn = 3) AS c3, max(n) FILTER (rn = 3) AS n3 FROM n GROUP BY 1, 2)
        SELECT task, model, n_rows, n_failures, round(r, 6) AS avg_risk, round(r * 2, 6) AS avg_harm, round(n_failures / n_rows, 6) AS failure_rate, coalesce(c1, '') AS top_failure_1, coalesce(n1, 0) AS top_failure_1_count, coalesce(c2, '') AS top_failure_2, coalesce(n2, 0) AS top_failure_2_count, coalesce(c3, '') AS top_failure_3, coalesce(n3, 0) AS top_failure_3_count FROM g LEFT JOIN w USING (task, model)"""),
    "split_metrics": (lambda s, d: rounded(P.split_metrics(labelled(s, d), ["model"], "y", "p", 0.3), "positive_rate", "avg_p", "f1", "accuracy", "roc_auc", "pr_auc", "brier", "ece"), _SPLIT),
    "sensitivity_summary": (lambda s, d: rounded(gates(s, d), "pass_rate", *[f"avg_{c}" for c in ("precision", "recall", "f1", "accuracy", "coverage_slm", "delta_utility", "p_holm")]), f"WITH {_CALLS} SELECT model, count(*) AS n_rows, round(avg((status = 'success')::INT), 6) AS pass_rate, round(avg(coalesce(latency, 0)), 6) AS avg_precision, 0.0::DOUBLE AS avg_recall, round(avg(risk), 6) AS avg_f1, round(avg(risk), 6) AS avg_accuracy, round(avg(coalesce(latency, 0)), 6) AS avg_coverage_slm, 0.0::DOUBLE AS avg_delta_utility, round(avg(CASE WHEN valid THEN risk ELSE 1.0::DOUBLE END), 6) AS avg_p_holm FROM k GROUP BY 1"),
    "impact_by_task": (lambda s, d: rounded(P.impact_by_task(Z.frozen_test_models(runs(s, d)).groupBy("task").agg(F.sum("slm_routed").alias("slm_routed"), F.sum("llm_routed").alias("llm_routed"))), "slm_coverage_pct", "cost_per_query", "savings_pct", n=8), f"WITH {_TEST}, g AS (SELECT task, CAST(sum(slm_routed) AS BIGINT) AS slm_routed, CAST(sum(llm_routed) AS BIGINT) AS llm_routed FROM m GROUP BY 1), c AS (SELECT *, slm_routed + llm_routed AS total_queries, slm_routed / (slm_routed + llm_routed) AS s FROM g) SELECT task, slm_routed, llm_routed, total_queries, round(100 * s, 8) AS slm_coverage_pct, round(s * 0.0003::DOUBLE + (1 - s) * 0.0035::DOUBLE, 8) AS cost_per_query, round(100 * (1 - (s * 0.0003::DOUBLE + (1 - s) * 0.0035::DOUBLE) / 0.0035::DOUBLE), 8) AS savings_pct FROM c"),
    "impact_overall": (lambda s, d: rounded(P.impact_overall(Z.frozen_test_models(runs(s, d))), "slm_pct", "cost_per_query", "savings_pct", "savings_usd", n=7), f"WITH {_TEST}, g AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(slm_routed) / sum(n) AS s FROM m) SELECT n AS total_queries, round(100 * s, 7) AS slm_pct, round(s * 0.0003::DOUBLE + (1 - s) * 0.0035::DOUBLE, 7) AS cost_per_query, round(100 * (1 - (s * 0.0003::DOUBLE + (1 - s) * 0.0035::DOUBLE) / 0.0035::DOUBLE), 7) AS savings_pct, round((0.0035::DOUBLE - (s * 0.0003::DOUBLE + (1 - s) * 0.0035::DOUBLE)) * n, 7) AS savings_usd FROM g"),
    "weighted_ratio": (lambda s, d: rounded(P.weighted_ratio(validated(s, d).select(F.col("total_queries").alias("total_rows"), "rho_bar")), "weighted_rho_bar"), f"WITH {_VALID} SELECT round(sum(total_queries * rho_bar) / sum(total_queries), 6) AS weighted_rho_bar, CAST(sum(total_queries) AS BIGINT) AS total_rows FROM v"),
    "tier_distribution": (lambda s, d: rounded(U.tier_distribution(swept(s, d), "tier", "rho_bar"), "mean_rho"), f"WITH {_SWEPT} SELECT tier, count(*) AS n, round(avg(rho_bar), 6) AS mean_rho FROM sw GROUP BY 1"),
    "tier_robustness": (lambda s, d: rounded(P.tier_robustness(swept(s, d), ["ord", "slm", "llm"], "slm", "llm"), "diversity", "robustness", "mean_confidence", "min_confidence"), _ROBUST),
    "objective_rankings": (objectives, _OBJECTIVES),
    "bin_shares": (lambda s, d: rounded(P.bin_shares(calls(s, d), ["task"], "bin"), "share"), f"WITH {_CALLS} SELECT task, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY task), 6) AS share FROM k GROUP BY 1, 2"),
    "blended_strategy": (blended, _BLENDED),
    "label_counts": (lambda s, d: SP.label_counts(calls(s, d).withColumn("failed", F.col("status") == "error"), ["task", "model"], "failed"), f"WITH {_CALLS} SELECT task, model, count(*) FILTER (status <> 'error') AS fail_0, count(*) FILTER (status = 'error') AS fail_1 FROM k GROUP BY 1, 2"),
    "leading_row": (lambda s, d: U.leading_row(runs(s, d).withColumns({"dq": F.col("query_id") % 2 == 0, "tier": F.col("model")}), ["task"], "dq", "tier", "p_fail"), f"WITH {_RUNS} SELECT task, arg_min(query_id % 2 = 0, (query_id % 2 = 0, model, -p_fail)) AS dq, arg_min(model, (query_id % 2 = 0, model, -p_fail)) AS tier, arg_min(p_fail, (query_id % 2 = 0, model, -p_fail)) AS p_fail FROM r GROUP BY 1"),
    "minmax_normalise": (lambda s, d: t(s, d, "events").select("event_id", F.round(P.normalised(F.col("value"), "event_type"), 6).alias("score")), "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS score FROM events WINDOW w AS (PARTITION BY event_type)"),
    "stratified_folds": (folds, "SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY floor(value), event_id) - 1) % 3 AS INT) AS fold FROM events"),
    "weighted_norm": (normed, "SELECT event_id, round(0.7::DOUBLE * greatest(0, least(1, (value - 10) / 90.0::DOUBLE)), 6) AS score FROM events"),
    "log_loss": (lambda s, d: rounded(labelled(s, d).groupBy("model").agg(P.log_loss(F.col("y"), F.col("p")).alias("loss")), "loss"), f"WITH {_SCORED}, q AS (SELECT model, ok::INT AS y, greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, p)) AS q FROM e) SELECT model, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS loss FROM q GROUP BY 1"),
    "all_true": (lambda s, d: calls(s, d).groupBy("task", "model", "bin").agg(P.agreed(F.col("line") % 97 != 0).alias("every")), f"WITH {_CALLS} SELECT task, model, bin, bool_and(line % 97 <> 0) AS every FROM k GROUP BY 1, 2, 3"),
    "first_rows": (lambda s, d: t(s, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500"),
}
