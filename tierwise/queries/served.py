"""Queries of frozen thresholds, use cases and threshold searches, over events as model runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import frozen as Z
from ..operators import search as S
from ..operators.routing import FAMILIES, FROZEN_TAU
from .analytics import _SCORED, rounded, scored
from .tables import t

CASES = sorted(Z.USE_CASES)


def runs(s, d):
    """Events as runs: a family by user, a model by type, a query id that models share, and a probability of failure."""
    e, k = t(s, d, "events"), F.col("event_id")
    return e.select(
        F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("user_id") % 8 + 1).cast("int")).alias("task"),
        F.col("event_type").alias("model"),
        F.floor(k / 5).alias("query_id"),
        k.alias("pos"),
        F.least(F.lit(1.0), F.floor(F.col("value") * 10) / 1000).alias("p_fail"),
        (F.pmod(k * 7 + F.floor("value"), F.lit(10)) < 6).alias("slm_correct"),
        F.when(k % 11 != 0, k % 5 != 0).alias("llm_correct"),
    )


_FAMILY = "[" + ", ".join(f"'{f}'" for f in FAMILIES) + "][user_id % 8 + 1]"
_TAU = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in FROZEN_TAU.items()) + " END"
_RUNS = f"r AS (SELECT {_FAMILY} AS task, event_type AS model, event_id // 5 AS query_id, event_id AS pos, least(1.0::DOUBLE, floor(value * 10) / 1000) AS p_fail, (event_id * 7 + floor(value)::BIGINT) % 10 < 6 AS slm_correct, event_id % 11 <> 0 AND event_id % 5 <> 0 AS llm_correct FROM events)"
_WENT = f"{_RUNS}, w AS (SELECT *, p_fail < {_TAU} AS slm FROM r)"
_TIER = "CASE WHEN {0} >= 0.5 THEN 'SLM' WHEN {0} < 0.3 THEN 'LLM' ELSE 'HYBRID' END"
_TOLD = "CASE WHEN {0} >= 0.5 THEN 'High SLM routing confidence (rho_bar=' || printf('%.4f', {0}) || ' >= {1})' WHEN {0} < 0.3 THEN 'Low SLM routing confidence (rho_bar=' || printf('%.4f', {0}) || ' < {2})' ELSE 'Mixed routing outcomes ({2} <= rho_bar=' || printf('%.4f', {0}) || ' < {1})' END"
_VALID = f"""{_WENT}, m AS (SELECT task, model, avg(slm::INT) AS rho, count(*) FILTER (slm) AS s, count(*) FILTER (NOT slm) AS l FROM w GROUP BY 1, 2),
 b AS (SELECT task, avg(rho) AS rho_bar, count(*) AS n_models, CAST(sum(s) AS BIGINT) AS slm_routed, CAST(sum(l) AS BIGINT) AS llm_routed FROM m GROUP BY 1),
 f AS (SELECT task, query_id, arg_min(slm_correct, pos) AS sc, arg_min(llm_correct, pos) AS lc FROM r GROUP BY 1, 2),
 q AS (SELECT task, count(*) AS n, count(*) FILTER (sc) AS s, count(*) FILTER (lc) AS l FROM f GROUP BY 1),
 v AS (SELECT task, {_TAU} AS tau, n_models, slm_routed, llm_routed, rho_bar, {_TIER.format("rho_bar")} AS tier, {_TOLD.format("rho_bar", "0.50", "0.30")} AS explanation, s / n AS slm_accuracy, l / n AS llm_accuracy, n - s AS slm_failures, n AS total_queries FROM b JOIN q USING (task))"""
_TEST = f"""{_WENT}, m AS (SELECT task, model, count(*) AS n, count(*) FILTER (slm) AS slm_routed, count(*) FILTER (NOT slm) AS llm_routed, count(*) FILTER (slm_correct) AS slm_right, count(*) FILTER (llm_correct) AS llm_right, avg(slm::INT) AS rho,
   coalesce(avg(slm_correct::INT) FILTER (slm), 0) AS accuracy_on_slm_routes, coalesce(avg(llm_correct::INT) FILTER (NOT slm), 0) AS accuracy_on_llm_routes FROM w GROUP BY 1, 2),
 k AS (SELECT task, {_TAU} AS tau, avg(rho) AS consensus_rho, {_TIER.format("avg(rho)")} AS tier, CAST(sum(n) AS BIGINT) AS total_queries, sum(slm_right) / sum(n) AS slm_accuracy, sum(llm_right) / sum(n) AS llm_accuracy, CAST(sum(n) - sum(slm_right) AS BIGINT) AS slm_failures, (sum(n) - sum(slm_right)) / sum(n) AS failure_rate FROM m GROUP BY 1)"""
_CASES = ", ".join(f"('{k}', '{v}')" for k, v in Z.USE_CASES.items())


def validated(s, d):
    r = runs(s, d)
    return Z.frozen_validation(r, r, "pos")


def tested(s, d):
    return Z.frozen_test(Z.frozen_test_models(runs(s, d)))


def ensemble(s, d):
    r = runs(s, d).withColumns({"sample_id": F.col("query_id"), "difficulty": F.col("p_fail"), "correct": F.col("query_id") % 3 != 0, "error": F.pmod("query_id", F.lit(7)) / 10})
    taus = r.select("task").distinct().withColumn("tau", F.when(F.col("task") > "i", 0.05).otherwise(0.03))
    out = Z.ensemble_routing(r, taus)
    return rounded(out, *[c for c in out.columns if c not in ("task", "n", "slm_routed", "llm_routed")])


def case_queries(s, d):
    e = runs(s, d).withColumn("use_case", F.element_at(F.array(*[F.lit(c) for c in CASES]), (F.col("query_id") % 8 + 1).cast("int")))
    return e.drop("task").withColumn("task", F.element_at(F.create_map(*[F.lit(x) for kv in Z.USE_CASES.items() for x in kv]), F.col("use_case")))


_CASE = "[" + ", ".join(f"'{c}'" for c in CASES) + "]"
_OF = "CASE use_case " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Z.USE_CASES.items()) + " END"
_CASED = f"{_RUNS}, c AS (SELECT * EXCLUDE (task), {_CASE}[query_id % 8 + 1] AS use_case FROM r), w AS (SELECT *, {_OF} AS task FROM c), x AS (SELECT *, p_fail < {_TAU} AS slm FROM w)"


def one_model(s, d):
    q = case_queries(s, d).where("model = 'view'")
    out = Z.use_case_routing(q.withColumn("query_id", F.col("pos")))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return rounded(out.select("use_case", "task", "tier", "rho_bar", "slm_count", "llm_count", "total_queries", joined("slm_routes"), joined("llm_routes")), "rho_bar")


def many_models(s, d):
    out = Z.use_case_routing_multimodel(case_queries(s, d))
    per = F.concat_ws(",", F.transform(F.map_entries("per_model_rho"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))))
    return rounded(out.withColumn("per_model_rho", per), "rho_bar")


def failures(s, d):
    """Runs with what the risk of a sample depends on."""
    k = F.col("pos")
    word = F.element_at(F.array(*[F.lit(x) for x in ("logic_error", " Runtime_Error", "", "wrong_label", "other")]), (k % 5 + 1).cast("int"))
    return runs(s, d).withColumns({"severity_score": F.when(k % 3 == 0, (k % 7).cast("double")), "risk_weight": F.when(k % 4 == 0, 0.4), "severity": F.lit(None).cast("double"), "failure_category": F.when(k % 2 == 0, word), "failure_type": F.when(k % 9 == 0, "incomplete_output")})


_BASE = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in S.TASK_RISK.items()) + " ELSE 0.5::DOUBLE END"
_FACTOR = "CASE cat " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in S.CATEGORY_FACTOR.items()) + " ELSE 1.0::DOUBLE END"
_RISKS = f"""{_RUNS}, s AS (SELECT *, CASE WHEN pos % 3 = 0 THEN (pos % 7)::DOUBLE WHEN pos % 4 = 0 THEN 0.4::DOUBLE END AS sev, lower(trim(coalesce(nullif(CASE WHEN pos % 2 = 0 THEN ['logic_error', ' Runtime_Error', '', 'wrong_label', 'other'][pos % 5 + 1] END, ''), CASE WHEN pos % 9 = 0 THEN 'incomplete_output' END, ''))) AS cat FROM r),
 x AS (SELECT task, model, pos, slm_correct, llm_correct, p_fail, CASE WHEN slm_correct THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_BASE} * CASE WHEN sev IS NULL THEN 1.0::DOUBLE WHEN sev > 1 THEN least(sev / 5, 1.0::DOUBLE) ELSE sev END * {_FACTOR})) END AS risk FROM s)"""


def zone(s, d):
    m = S.sample_metrics(failures(s, d))
    c = m.withColumn("bin", F.floor(F.least(F.lit(0.999), F.col("p_fail") * 5) * 5).cast("int")).groupBy("task", "bin").agg(F.avg("capability").alias("cap"), F.avg("risk").alias("risk"), F.count("*").alias("n"))
    out = S.operational_zone(c.join(S.baselines(m, ["task"]), "task"), ["task"])
    return rounded(out.withColumn("feasible_set", F.concat_ws(",", F.transform("feasible_set", lambda x: x.cast("string")))), "cap_dyn", "risk_dyn")


def grid(s, d):
    e = scored(s, d)
    cap, bad = (C.width_curve(e, ["model"], "p", c) for c in ("ok", "risk"))
    mean = e.groupBy("model").agg(F.avg("risk").alias("mean_risk"))
    curve = cap.join(bad.select("model", "bin", F.col("cap").alias("risk")), ["model", "bin"]).join(mean, "model").withColumn("center", (F.col("bin") + 0.5) / 10)
    return S.grid_tau(curve, ["model"], base=0.62, margin_risk=0.0)


_WIDTH = f"greatest(0, len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in C.edges())}], lambda x: x <= p)) - 1)"
_CURVE = f"""{_SCORED}, h AS (SELECT model, {_WIDTH} AS bin, avg(ok::INT) AS cap, avg(risk) AS risk FROM e GROUP BY 1, 2), mr AS (SELECT model, avg(risk) + 0.0::DOUBLE AS lim FROM e GROUP BY 1),
 k AS (SELECT mr.model, lim, b AS bin, (b + 0.5::DOUBLE) / 10 AS center, coalesce(cap, 0.5) AS cap, coalesce(risk, 0.5) AS risk FROM mr CROSS JOIN range(10) g(b) LEFT JOIN h ON h.model = mr.model AND h.bin = b),
 z AS (SELECT *, lead(center) OVER v AS c2, lead(cap) OVER v AS cap2, lead(risk) OVER v AS risk2 FROM k WINDOW v AS (PARTITION BY model ORDER BY bin)),
 i AS (SELECT CASE WHEN n = 999 THEN 1.0::DOUBLE ELSE n * {1.0 / 999!r}::DOUBLE END AS d FROM range(1000) g(n)),
 y AS (SELECT model, lim, d, CASE WHEN d <= center OR c2 IS NULL THEN cap ELSE (1 - (d - center) / (c2 - center)) * cap + (d - center) / (c2 - center) * cap2 END AS cap, CASE WHEN d <= center OR c2 IS NULL THEN risk ELSE (1 - (d - center) / (c2 - center)) * risk + (d - center) / (c2 - center) * risk2 END AS risk
       FROM i JOIN z ON (d > center AND (c2 IS NULL OR d <= c2)) OR (bin = 0 AND d <= center)),
 o AS (SELECT *, cap >= 0.62::DOUBLE - 0.05::DOUBLE AND risk <= lim AS ok, greatest(0, (0.62::DOUBLE - 0.05::DOUBLE) - cap) + greatest(0, risk - lim) AS miss FROM y)"""
_GRID = f"""WITH {_CURVE}, p AS (SELECT model, coalesce(max(d) FILTER (ok), arg_min(d, (miss, d))) AS tau, count(*) FILTER (ok) AS n_feasible FROM o GROUP BY 1)
 SELECT p.model, tau, CASE WHEN n_feasible > 0 THEN 'strict_feasible_max' ELSE 'fallback_min_violation' END AS provenance, n_feasible, round(cap, 9) AS cap_at_tau, round(risk, 9) AS risk_at_tau FROM p JOIN o ON o.model = p.model AND o.d = p.tau"""
_ZONE = f"""WITH {_RISKS}, b AS (SELECT task, floor(least(0.999::DOUBLE, p_fail * 5) * 5)::INT AS bin, avg(slm_correct::INT) AS cap, avg(risk) AS risk, count(*) AS n FROM x GROUP BY 1, 2),
 l AS (SELECT task, greatest(0.4::DOUBLE, least(1.0::DOUBLE, least(0.65::DOUBLE, avg(llm_correct::INT) - 0.05::DOUBLE))) AS cap_dyn, least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.3::DOUBLE, avg(risk) + 0.05::DOUBLE))) AS risk_dyn, count(*) AS total FROM x GROUP BY 1),
 o AS (SELECT *, cap >= cap_dyn AND risk <= risk_dyn AND n / total <= 0.7 AS ok, greatest(0, cap_dyn - cap) + greatest(0, risk - risk_dyn) AS miss FROM b JOIN l USING (task))
 SELECT task, round(max(cap_dyn), 6) AS cap_dyn, round(max(risk_dyn), 6) AS risk_dyn, coalesce(string_agg(bin::VARCHAR, ',' ORDER BY bin) FILTER (ok), '') AS feasible_set, max(bin) FILTER (ok) AS strict_tau, coalesce(max(bin) FILTER (ok), arg_min(bin, (miss, risk, -n, -bin))) AS selected_tau, CASE WHEN count(*) FILTER (ok) > 0 THEN 'strict_feasible_max' ELSE 'fallback_min_violation' END AS tau_source FROM o GROUP BY 1"""
_PREFIXES = f"{_SCORED}, g AS (SELECT model, d AS tau, sum(ok::INT)::DOUBLE AS c, sum(risk) AS r, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2), c AS (SELECT model, tau, sum(c) OVER w / sum(n) OVER w AS cap, sum(r) OVER w / sum(n) OVER w AS risk, sum(n) OVER w / sum(n) OVER (PARTITION BY model) AS coverage FROM g WINDOW w AS (PARTITION BY model ORDER BY tau))"
_CONTINUOUS = f"""WITH {_PREFIXES}, l AS (SELECT model, count(*) AS n, least(1.0::DOUBLE, greatest(0.0::DOUBLE, avg(risk) + 0.05::DOUBLE)) AS r_dyn, CASE WHEN model = 'view' THEN 0.5::DOUBLE - 0.05::DOUBLE ELSE 0.9::DOUBLE - 0.05::DOUBLE END AS c_dyn FROM e GROUP BY 1),
 o AS (SELECT *, cap >= c_dyn AND risk <= r_dyn AS ok, greatest(0, c_dyn - cap) + greatest(0, risk - r_dyn) AS miss FROM c JOIN l USING (model)),
 p AS (SELECT model, max(n) AS n, max(c_dyn) AS c_dyn, max(r_dyn) AS r_dyn, count(*) FILTER (ok) > 0 AS strict, coalesce(max(tau) FILTER (ok), arg_min(tau, (miss + 0.5::DOUBLE * tau, tau))) AS tau, min(miss + 0.5::DOUBLE * tau) + 0.5::DOUBLE * stddev_pop(miss) AS goal FROM o GROUP BY 1)
 SELECT p.model, p.n, round(p.c_dyn, 6) AS c_dyn, round(p.r_dyn, 6) AS r_dyn, p.tau, CASE WHEN strict THEN 'strict_feasible_max' ELSE 'fallback_min_violation_robust' END AS tau_source, round(cap, 6) AS capability, round(risk, 6) AS risk, round(coverage, 6) AS coverage, CASE WHEN NOT strict THEN round(goal, 6) END AS objective FROM p JOIN o ON o.model = p.model AND o.tau = p.tau"""


def continuous(s, d):
    e = scored(s, d)
    one = lambda df, base: S.continuous_tau(df, ["model"], "d", "ok", "risk", base)
    out = one(e.where("model = 'view'"), 0.5).unionByName(one(e.where("model <> 'view'"), 0.9))
    return rounded(out, "c_dyn", "r_dyn", "capability", "risk", "coverage", "objective")


def lookups(s, d):
    rows = runs(s, d).select(F.col("pos").alias("sample_id"), "model")
    scores = runs(s, d).where("pos % 3 = 0").select(F.col("pos").alias("sample_id"), F.col("p_fail").alias("score"))
    return S.scored_by_id(rows, scores)


QUERIES = {
    "frozen_validation": (lambda s, d: rounded(validated(s, d), "rho_bar", "slm_accuracy", "llm_accuracy"), f"WITH {_VALID} SELECT * REPLACE (round(rho_bar, 6) AS rho_bar, round(slm_accuracy, 6) AS slm_accuracy, round(llm_accuracy, 6) AS llm_accuracy) FROM v"),
    "frozen_tier_counts": (lambda s, d: Z.tier_counts(validated(s, d)), f"WITH {_VALID} SELECT count(*) AS tasks_validated, count(*) FILTER (tier = 'SLM') AS slm_tier_count, count(*) FILTER (tier = 'HYBRID') AS hybrid_tier_count, count(*) FILTER (tier = 'LLM') AS llm_tier_count FROM v"),
    "frozen_test_models": (lambda s, d: rounded(Z.frozen_test_models(runs(s, d)), "rho", "accuracy_on_slm_routes", "accuracy_on_llm_routes"), f"WITH {_TEST} SELECT * REPLACE (round(rho, 6) AS rho, round(accuracy_on_slm_routes, 6) AS accuracy_on_slm_routes, round(accuracy_on_llm_routes, 6) AS accuracy_on_llm_routes) FROM m"),
    "frozen_test": (lambda s, d: rounded(tested(s, d), "consensus_rho", "slm_accuracy", "llm_accuracy", "failure_rate"), f"WITH {_TEST} SELECT * REPLACE (round(consensus_rho, 6) AS consensus_rho, round(slm_accuracy, 6) AS slm_accuracy, round(llm_accuracy, 6) AS llm_accuracy, round(failure_rate, 6) AS failure_rate) FROM k"),
    "frozen_test_summary": (lambda s, d: rounded(Z.summary_of_test(tested(s, d)), "overall_failure_rate"), f"WITH {_TEST} SELECT count(*) AS tasks_evaluated, count(*) FILTER (tier = 'SLM') AS slm, count(*) FILTER (tier = 'HYBRID') AS hybrid, count(*) FILTER (tier = 'LLM') AS llm, CAST(sum(total_queries) AS BIGINT) AS total_queries, CAST(sum(slm_failures) AS BIGINT) AS total_failures, round(sum(slm_failures) / sum(total_queries), 6) AS overall_failure_rate FROM k"),
    "ensemble_routing": (ensemble, f"WITH {_RUNS}, o AS (SELECT task, query_id, avg(p_fail) AS d, max((query_id % 3 <> 0)::INT) AS c, max((query_id % 7) / 10.0::DOUBLE) AS e, CASE WHEN task > 'i' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END AS tau FROM r GROUP BY 1, 2), g AS (SELECT task, tau, count(*) AS n, count(*) FILTER (d <= tau) AS slm_routed, count(*) FILTER (d > tau) AS llm_routed, coalesce(avg(c) FILTER (d <= tau), 0) AS cs, coalesce(avg(c) FILTER (d > tau), 0) AS cl, coalesce(avg(e) FILTER (d <= tau), 0) AS es, coalesce(avg(e) FILTER (d > tau), 0) AS el FROM o GROUP BY 1, 2) SELECT task, tau, n, slm_routed, llm_routed, round(cs, 6) AS capability_slm, round(cl, 6) AS capability_llm, round(es, 6) AS risk_slm, round(el, 6) AS risk_llm, round(slm_routed / n, 6) AS routing_ratio, round((cs * slm_routed + cl * llm_routed) / n, 6) AS capability_overall FROM g"),
    "use_case_routing": (one_model, f"WITH {_CASED} SELECT use_case, task, {_TIER.format('avg(slm::INT)')} AS tier, round(avg(slm::INT), 6) AS rho_bar, count(*) FILTER (slm) AS slm_count, count(*) FILTER (NOT slm) AS llm_count, count(*) AS total_queries, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (slm), '') AS slm_routes, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (NOT slm), '') AS llm_routes FROM x WHERE model = 'view' GROUP BY 1, 2"),
    "use_case_consensus": (many_models, f"WITH {_CASED}, p AS (SELECT use_case, task, model, avg(slm::INT) AS rho FROM x GROUP BY 1, 2, 3) SELECT use_case, task, round(avg(rho), 6) AS rho_bar, {_TIER.format('avg(rho)')} AS tier, string_agg(model || '=' || printf('%.4f', rho), ',' ORDER BY model) AS per_model_rho FROM p GROUP BY 1, 2"),
    "use_case_tiers": (lambda s, d: rounded(Z.assign_use_cases(Z.use_case_table(s), validated(s, d).where("task <> 'summarization'")), "rho_bar"), f"WITH {_VALID}, u(usecase_id, task) AS (VALUES {_CASES}) SELECT usecase_id, u.task, round(rho_bar, 6) AS rho_bar, CASE WHEN rho_bar IS NULL THEN 'UNKNOWN' ELSE {_TIER.format('rho_bar')} END AS tier, CASE WHEN rho_bar IS NULL THEN 'No rho_bar computed for task family: ' || u.task ELSE {_TOLD.format('rho_bar', '0.5', '0.3')} END AS explanation, rho_bar IS NULL AS error FROM u LEFT JOIN v ON v.task = u.task AND v.task <> 'summarization'"),
    "use_case_agreement": (lambda s, d: rounded(Z.agreement_report(Z.tier_agreement(Z.assign_use_cases(Z.use_case_table(s), validated(s, d)), Z.assign_use_cases(Z.use_case_table(s), tested(s, d).where("task <> 'summarization'").withColumnRenamed("consensus_rho", "rho_bar")))), "agreement"), f"WITH {_VALID}, u(usecase_id, task) AS (VALUES {_CASES}) SELECT count(*) FILTER (u.task <> 'summarization') AS n_agree, count(*) AS n, round(count(*) FILTER (u.task <> 'summarization') / count(*), 6) AS agreement FROM u JOIN v USING (task)"),
    "score_lookup": (lookups, f"WITH {_RUNS} SELECT pos AS sample_id, model, CASE WHEN pos % 3 = 0 THEN p_fail ELSE 0.5::DOUBLE END AS score FROM r"),
    "sample_risk": (lambda s, d: rounded(S.sample_metrics(failures(s, d)).select("task", "model", "pos", "capability", "risk"), "risk"), f"WITH {_RISKS} SELECT task, model, pos, slm_correct::INT::DOUBLE AS capability, round(risk, 6) AS risk FROM x"),
    "risk_baselines": (lambda s, d: rounded(S.baselines(S.sample_metrics(failures(s, d)), ["task"]), "baseline_cap", "baseline_risk"), f"WITH {_RISKS} SELECT task, round(avg(llm_correct::INT), 6) AS baseline_cap, round(avg(risk), 6) AS baseline_risk FROM x GROUP BY 1"),
    "operational_zone": (zone, _ZONE),
    "grid_tau": (lambda s, d: rounded(grid(s, d), "cap_at_tau", "risk_at_tau", n=9), _GRID),
    "grid_tau_consensus": (lambda s, d: rounded(S.consensus_tau(grid(s, d).withColumn("task", F.when(F.col("model") > "e", "b").otherwise("a"))), "tau_consensus"), f"WITH {_CURVE}, p AS (SELECT model, coalesce(max(d) FILTER (ok), arg_min(d, (miss, d))) AS tau FROM o GROUP BY 1) SELECT CASE WHEN model > 'e' THEN 'b' ELSE 'a' END AS task, round(avg(tau), 6) AS tau_consensus, count(*) AS n_models FROM p GROUP BY 1"),
    "continuous_tau": (continuous, _CONTINUOUS),
}
