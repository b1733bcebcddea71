"""Queries of smoothing, zones, roll-ups and difficulty proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rollups as P
from ..operators import routing as G
from ..operators import smoothing as S
from .analytics import _SCORED, rounded, scored
from .tables import t
from .texts import _WORDS, _cues

_BASE = {"purchase": (2.4, 3.2), "view": (2.5, 3.3)}


def proxies(s, d):
    x = F.col("text")
    return t(s, d, "documents").select("doc_id", *[F.round(c, 6).alias(a) for a, c in (("reasoning", X.reasoning_proxy(x)), ("knowledge", X.knowledge_dependence(x)), ("distance", X.clause_distance(x)))])


def runs(s, d):
    return scored(s, d).groupBy(F.col("model").alias("task"), F.floor(F.col("d") / 25).alias("b")).agg(F.avg(F.col("ok").cast("double")).alias("f1"), F.avg("risk").alias("fail"), F.avg(F.abs(F.col("p") - F.col("risk"))).alias("ece"))


_RUNS = f"{_SCORED}, r AS (SELECT model AS task, floor(d / 25) AS b, avg(ok::INT) AS f1, avg(risk) AS fail, avg(abs(p - risk)) AS ece FROM e GROUP BY 1, 2)"


def policy(s, d):
    return rounded(P.recommend_tiers(runs(s, d), "task", "fail", "f1", "ece", _BASE), "tau1", "tau2", n=3)


def zones(s, d):
    g = scored(s, d).groupBy("model", F.floor(F.col("d") / 5).cast("int").alias("bin")).agg(F.avg(F.col("ok").cast("double")).alias("cap"), F.avg("risk").alias("r"))
    return g.select("model", "bin", S.quadrant(F.col("cap"), F.col("r"), 0.6, 0.15).alias("zone"))


def strategies(s, d):
    g = scored(s, d).groupBy("model").agg(F.avg("d").alias("tau"))
    return g.agg(*[F.round(S.zone_threshold(F.col("tau"), k), 6).alias(k) for k in ("conservative", "balanced", "aggressive")])


def near_tau(s, d):
    near = S.nearest_mean(scored(s, d), ["model"], "d", "event_id", {"cap": "ok", "r": "risk"})
    return S.greatest_feasible(near, ["model"], "d", "cap", "r", 0.55, 0.2)


def tiers(s, d):
    g = runs(s, d).withColumn("tier", F.when(F.col("f1") >= 0.6, "SLM").otherwise("LLM"))
    return rounded(P.weighted_tier_accuracy(g, ["b"], "tier", "f1", "fail"), "overall_weighted_accuracy")


def sanitised(s, d):
    x = scored(s, d).select("d", F.col("p"), "risk", F.lit(1.0).alias("one"), F.when(F.col("event_id") > 5, F.col("d")).alias("gaps"))
    got = P.sanitise_features(x, ["d", "p", "risk", "one", "gaps"])
    return s.createDataFrame([(k, f) for k, fs in got.items() for f in fs], "verdict string, feature string")


def recalibrated(s, d):
    """New limits and scores of each event type, from its runs as test reports and its events as validation runs."""
    e, k = scored(s, d).withColumnRenamed("model", "task"), F.col("event_id")
    valid = e.select("task", F.when(k % 3 != 0, F.col("p")).alias("tau_cap"), F.when(k % 4 != 0, F.col("risk")).alias("tau_risk"))
    got = P.recalibrated_policy(runs(s, d).withColumnRenamed("fail", "positive_rate"), valid, e.groupBy("task").agg((F.avg("d") / 20).alias("s3")), _BASE)
    return rounded(got, "tau1", "tau2", n=3)


def frozen(s, d):
    """Frozen thresholds by event type; views have no strict validation row, so their test runs count."""
    e, k = scored(s, d).withColumnRenamed("model", "task"), F.col("event_id")
    tau = F.when(k % 5 != 0, F.col("p") * 1.5).alias("tau")
    strict = (k % 3 == 0) & (F.col("task") != "view")
    valid = e.select("task", tau, F.when(strict, "strict_feasible_max").otherwise("fallback_min_violation").alias("source"), F.when(k % 2 == 0, "True").otherwise("false").alias("passed"))
    return rounded(G.frozen_taus(e.select("task").distinct(), valid, e.select("task", F.col("risk").alias("tau"))), "tau")


_NAMES = f"len(list_filter(range(2, len(w) + 1), lambda i: regexp_matches(w[i], '^[A-Z][a-z]') AND NOT regexp_matches(w[i - 1], '[.!?]$')))"
_AT = "list_transform(list_filter(range(1, len(w) + 1), lambda i: regexp_replace(lower(w[i]), '^[,;:.]+|[,;:.]+$', '', 'g') IN (" + ", ".join(f"'{b}'" for b in X.BREAKS) + ")), lambda i: greatest(i - 1, len(w) - i))"

QUERIES = {
    "difficulty_proxies": (proxies, f"WITH x AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS w FROM documents), y AS (SELECT *, {_AT} AS brk FROM x) SELECT doc_id, round(0.6::DOUBLE * ({_cues(X.REASONING_CUES)}) + 0.25::DOUBLE * len(regexp_extract_all(lower(text), '{X.CLAUSES}')), 6) AS reasoning, round(least(1.0::DOUBLE, (({_cues(X.KNOWLEDGE_CUES)}) + least(2.0::DOUBLE, {_NAMES} / 3.0::DOUBLE) + least(1.5::DOUBLE, len(regexp_extract_all(text, '\\b(19|20)\\d{{2}}\\b')) / 2.0::DOUBLE)) / 6.0::DOUBLE), 6) AS knowledge, round(CASE WHEN len(w) < 2 THEN 0.0::DOUBLE WHEN len(brk) = 0 THEN greatest(1.0::DOUBLE, len(w) / 8.0::DOUBLE) ELSE list_avg(brk) END, 6) AS distance FROM y"),
    "tier_policy": (policy, f"WITH {_RUNS}, m AS (SELECT task, avg(fail) AS fail, avg(f1) AS f1, avg(ece) AS ece FROM r GROUP BY 1), k AS (SELECT *, greatest(0, fail - 0.35::DOUBLE) * 2.2::DOUBLE + greatest(0, 0.7::DOUBLE - f1) * 1.4::DOUBLE + greatest(0, ece - 0.2::DOUBLE) - greatest(0, f1 - 0.85::DOUBLE) * 0.8::DOUBLE - greatest(0, 0.2::DOUBLE - fail) * 0.6::DOUBLE AS delta, CASE task WHEN 'purchase' THEN 2.4::DOUBLE WHEN 'view' THEN 2.5::DOUBLE ELSE 3.2::DOUBLE END AS b1, CASE task WHEN 'purchase' THEN 3.2::DOUBLE WHEN 'view' THEN 3.3::DOUBLE ELSE 4.0::DOUBLE END AS b2 FROM m), n AS (SELECT *, greatest(2.0::DOUBLE, least(4.0::DOUBLE, b1 - delta)) AS t1 FROM k) SELECT task, round_even(t1, 3) AS tau1, round_even(greatest(t1 + 0.4::DOUBLE, least(4.5::DOUBLE, b2 - delta)), 3) AS tau2, round_even(fail, 4) AS fail, round_even(f1, 4) AS f1, round_even(ece, 4) AS ece, round_even(delta, 4) AS delta FROM n"),
    "frozen_taus": (frozen, f"WITH {_SCORED}, v AS (SELECT model AS task, CASE WHEN event_id % 5 <> 0 THEN p * 1.5::DOUBLE END AS tau, event_id % 3 = 0 AND model <> 'view' AND event_id % 2 = 0 AS strict, risk FROM e) SELECT task, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(avg(tau) FILTER (strict), avg(risk), avg(tau), 0.5::DOUBLE))), 6) AS tau FROM v GROUP BY 1"),
    "quadrant_zones": (zones, f"WITH {_SCORED}, g AS (SELECT model, floor(d / 5)::INT AS bin, avg(ok::INT) >= 0.6 AS a, avg(risk) <= 0.15 AS b FROM e GROUP BY 1, 2) SELECT model, bin, CASE WHEN a AND b THEN 'Zone1' WHEN a THEN 'Zone2' WHEN b THEN 'Zone3' ELSE 'Zone4' END AS zone FROM g"),
    "zone_strategies": (strategies, f"WITH {_SCORED}, g AS (SELECT model, avg(d) AS tau FROM e GROUP BY 1) SELECT round(min(tau), 6) AS conservative, round(avg(tau), 6) AS balanced, round(max(tau), 6) AS aggressive FROM g"),
    "kernel_smoothing": (lambda s, d: rounded(S.kernel_smooth(scored(s, d), ["model"], "d", "ok"), "value"), f"WITH {_SCORED}, f AS (SELECT model, d, ok::INT AS y FROM e), h AS (SELECT model, count(*) AS c, 1.06::DOUBLE * CASE WHEN stddev_pop(d) > 0 THEN stddev_pop(d) ELSE 1 END * pow(count(*), -0.2::DOUBLE) AS h FROM f GROUP BY 1), g AS (SELECT model, d, count(*) AS n, sum(y) AS s FROM f GROUP BY 1, 2) SELECT a.model, a.d, a.n, round(sum(b.s * exp(-0.5::DOUBLE * pow((a.d - b.d) / h, 2))) / sum(b.n * exp(-0.5::DOUBLE * pow((a.d - b.d) / h, 2))), 6) AS value FROM g a JOIN g b USING (model) JOIN h USING (model) GROUP BY 1, 2, 3"),
    "nearest_tau": (near_tau, f"WITH {_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY d, event_id) AS r FROM e), p AS (SELECT a.model, a.d, a.r, b.ok::INT::DOUBLE AS ok, b.risk, row_number() OVER (PARTITION BY a.model, a.r ORDER BY abs(a.d - b.d), abs(a.r - b.r), b.r) AS k FROM o a JOIN o b ON a.model = b.model AND b.r BETWEEN a.r - 15 AND a.r + 15), m AS (SELECT model, d, r, avg(ok) AS cap, avg(risk) AS rk FROM p WHERE k <= 15 GROUP BY 1, 2, 3) SELECT model, max(d) FILTER (round(cap, 9) >= 0.55 AND round(rk, 9) <= 0.2) AS tau FROM m GROUP BY 1"),
    "weighted_tier_accuracy": (tiers, f"WITH {_RUNS}, g AS (SELECT b, CASE WHEN f1 >= 0.6 THEN 'SLM' ELSE 'LLM' END AS tier, avg((f1 + fail) / 2) AS a, count(*) AS n FROM r GROUP BY 1, 2) SELECT b::BIGINT AS b, round(sum(a * n) / sum(n), 6) AS overall_weighted_accuracy FROM g GROUP BY 1"),
    "calibration_summary": (lambda s, d: P.calibration_summary(scored(s, d), "ok", "d"), f"WITH {_SCORED} SELECT count(*) FILTER (ok) AS n_pass, count(*) FILTER (NOT ok) AS n_fail, count(DISTINCT d) AS n_tau, min(d) AS min_tau, max(d) AS max_tau FROM e"),
    "sweep_best": (lambda s, d: P.sweep_best(runs(s, d).select("b", F.round("f1", 9).alias("f1")), "f1", ["b"]).select("b", F.round("f1", 6).alias("f1")), f"WITH {_RUNS} SELECT b::BIGINT AS b, round(f1, 6) AS f1 FROM r ORDER BY round(r.f1, 9) DESC, r.b LIMIT 1"),
    "bootstrap_interval": (lambda s, d: S.bootstrap_mean(scored(s, d), ["model"], "p", "event_id"), None),
    "sanitised_features": (sanitised, None),
}

_LIMITS = QUERIES["tier_policy"][1]
QUERIES["recalibrated_policy"] = (
    recalibrated,
    f"WITH {_SCORED}, lim AS (SELECT task, tau1, tau2 FROM ({_LIMITS})), r AS (SELECT model AS task, avg(least(coalesce(CASE WHEN event_id % 3 <> 0 THEN p END, 9.0::DOUBLE), coalesce(CASE WHEN event_id % 4 <> 0 THEN risk END, 9.0::DOUBLE))) AS t, avg(d) / 20 AS s3 FROM e GROUP BY 1), rec AS (SELECT task, CAST(CASE WHEN t <= 0.2 THEN 4 WHEN t <= 0.5 THEN 3 WHEN s3 < 2.2 THEN 2 END AS INT) AS level FROM r) SELECT task, tau1, tau2, level AS SK, level AS TC FROM lim FULL JOIN (SELECT * FROM rec WHERE level IS NOT NULL) USING (task)",
)
