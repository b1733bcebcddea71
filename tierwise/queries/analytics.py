"""Queries of curves, thresholds, metrics and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import metrics as M
from ..operators import routing as G
from ..operators.carried import isotonic
from ..operators.splits import build_splits
from ..plans.consensus import MODELS, consensus_plan
from .tables import t

_FAM = "[" + ", ".join(f"'{f}'" for f in G.FAMILIES) + "]"
_TAU = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in G.FROZEN_TAU.items()) + " END"
_DOCS = rf"""d AS (SELECT doc_id, {_FAM}[doc_id % 8 + 1] AS task, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n_in FROM documents),
s AS (SELECT *, CASE WHEN max(n_in) OVER w <= min(n_in) OVER w THEN 0.5::DOUBLE ELSE (n_in - min(n_in) OVER w) / (max(n_in) OVER w - min(n_in) OVER w)::DOUBLE END AS score FROM d WINDOW w AS (PARTITION BY task)),
m AS (SELECT doc_id, task, model, greatest(0.0::DOUBLE, score - ease) AS p_fail FROM s, (VALUES {", ".join(f"('{m}', {k / 10}::DOUBLE)" for k, m in enumerate(MODELS))}) v(model, ease))"""


def scored(s, d):
    """Events as scored samples: p in 0 to 1, correct, risk."""
    e = t(s, d, "events")
    p = F.floor(F.col("value") * 10) / 10
    return e.select("event_id", F.col("event_type").alias("model"), p.alias("d"), (F.pmod(F.col("event_id") * 7 + F.floor("value"), F.lit(10)) < 6).alias("ok"), (F.pmod("event_id", F.lit(4)) / 10).alias("risk")).withColumn("p", F.least(F.lit(1.0), F.col("d") / 100))


_SCORED = "e AS (SELECT event_id, event_type AS model, floor(value * 10) / 10 AS d, ((event_id * 7 + floor(value)::BIGINT) % 10) < 6 AS ok, (event_id % 4) / 10.0::DOUBLE AS risk, least(1.0::DOUBLE, floor(value * 10) / 10 / 100) AS p FROM events)"
_PREFIX = f"{_SCORED}, g AS (SELECT model, d AS tau, sum(ok::INT)::DOUBLE AS c, sum(risk) AS r, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2), c AS (SELECT model, tau, sum(c) OVER w / sum(n) OVER w AS cap, sum(r) OVER w / sum(n) OVER w AS risk, sum(n) OVER w / sum(n) OVER (PARTITION BY model) AS coverage FROM g WINDOW w AS (PARTITION BY model ORDER BY tau))"
_PICK = "SELECT model, coalesce(max(tau) FILTER (cap >= cap_t AND risk <= risk_t), arg_min(tau, (greatest(0, cap_t - cap) + greatest(0, risk - risk_t), risk, -cap, -tau))) AS tau, count(*) FILTER (cap >= cap_t AND risk <= risk_t) AS n_feasible, count(*) FILTER (cap >= cap_t AND risk <= risk_t) > 0 AS strict FROM c JOIN t USING (model) GROUP BY 1"
_GRID = [round(0.2 + 0.05 * k, 2) for k in range(15)]


_COUNTED = f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY d, event_id) AS rn, count(*) OVER (PARTITION BY model) AS n FROM e), curve AS (SELECT model, least((rn - 1) // greatest(1, n // 10), 9) AS bin, avg(d) AS center, avg(ok::INT) AS cap FROM r GROUP BY 1, 2)"


def pooled_sql(table: str, by: str, x: str, y: str, out: str, name: str, sign: str = "") -> str:
    """Common table expressions of a monotonic fit: at each place the greatest, over its starts, of the least mean up to an end."""
    return f"""{name}_g AS (SELECT {by}, {x}, {sign}{y} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {x}) AS k FROM {table}),
{name}_s AS (SELECT a.{by}, a.k AS ka, b.k AS kb, avg(m.v) AS v FROM {name}_g a JOIN {name}_g b ON a.{by} = b.{by} AND b.k >= a.k JOIN {name}_g m ON m.{by} = a.{by} AND m.k BETWEEN a.k AND b.k GROUP BY 1, 2, 3),
{name}_f AS (SELECT i.{by}, i.{x}, s.ka, min(s.v) AS v FROM {name}_g i JOIN {name}_s s ON s.{by} = i.{by} AND s.ka <= i.k AND s.kb >= i.k GROUP BY 1, 2, 3),
{name} AS (SELECT {by}, {x}, {sign}max(v) AS {out} FROM {name}_f GROUP BY 1, 2)"""


_AT = [0.0, 5.0, 20.0, 33.3, 1e9]


def rounded(df, *names, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in names else c for c in df.columns])


def sweep(s, d):
    g = G.sweep(consensus_plan(t(s, d, "documents")).select("task", "rho_bar"), "rho_bar", _GRID)
    return g.groupBy("slm", "llm").agg(*[F.count_if(F.col("tier") == x).alias(f"n_{x.lower()}") for x in ("SLM", "HYBRID", "LLM")])


QUERIES = {
    "routing_consensus": (lambda s, d: rounded(consensus_plan(t(s, d, "documents")), "rho_bar"), f"WITH {_DOCS}, r AS (SELECT task, model, avg(CASE WHEN p_fail < {_TAU} / 8.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rho, count(*) AS n FROM m GROUP BY 1, 2) SELECT task, round(avg(rho), 6) AS rho_bar, count(*) AS n_models, CAST(sum(n) AS BIGINT) AS n_queries, CASE WHEN avg(rho) >= 0.5 THEN 'SLM' WHEN avg(rho) < 0.3 THEN 'LLM' ELSE 'HYBRID' END AS tier FROM r GROUP BY 1"),
    "threshold_sweep": (sweep, f"WITH {_DOCS}, r AS (SELECT task, model, avg(CASE WHEN p_fail < {_TAU} / 8.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rho FROM m GROUP BY 1, 2), b AS (SELECT task, avg(rho) AS rho FROM r GROUP BY 1), g AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _GRID)}]) AS v) SELECT a.v AS slm, l.v AS llm, count(*) FILTER (rho >= a.v) AS n_slm, count(*) FILTER (rho < a.v AND rho > l.v) AS n_hybrid, count(*) FILTER (rho < a.v AND rho <= l.v) AS n_llm FROM b, g a, g l WHERE l.v < a.v GROUP BY 1, 2"),
    "prefix_curve": (lambda s, d: rounded(C.prefix_curve(scored(s, d), ["model"], "d", "ok", "risk"), "cap", "risk", "coverage", n=9), f"WITH {_PREFIX} SELECT model, tau, round(cap, 9) AS cap, round(risk, 9) AS risk, round(coverage, 9) AS coverage FROM c"),
    "tau_adaptive": (lambda s, d: C.adaptive_tau(scored(s, d), ["model"], "d", "ok", "risk"), f"WITH {_PREFIX}, t AS (SELECT model, quantile_cont(cap, 0.5::DOUBLE) AS cap_t, quantile_cont(risk, 0.75::DOUBLE) AS risk_t FROM c GROUP BY 1) {_PICK}"),
    "tau_fixed": (lambda s, d: C.fixed_tau(scored(s, d), ["model"], "d", "ok", "risk", "ok"), f"WITH {_PREFIX}, t AS (SELECT model, greatest(0.4::DOUBLE, least(1.0::DOUBLE, least(0.65::DOUBLE, avg(ok::INT) - 0.05::DOUBLE))) AS cap_t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, greatest(0.3::DOUBLE, avg(risk) + 0.05::DOUBLE))) AS risk_t FROM e GROUP BY 1) {_PICK}"),
    "width_curve": (lambda s, d: rounded(C.width_curve(scored(s, d), ["model"], "p", "ok"), "cap"), f"WITH {_SCORED}, b AS (SELECT model, greatest(0, len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in C.edges())}], lambda x: x <= p)) - 1) AS bin, avg(ok::INT) AS cap, count(*) AS n FROM e GROUP BY 1, 2) SELECT f.model, f.bin, round(coalesce(cap, 0.5), 6) AS cap, coalesce(n, 0) AS n FROM (SELECT DISTINCT model, CAST(unnest(range(10)) AS INT) AS bin FROM e) f LEFT JOIN b ON b.model = f.model AND b.bin = f.bin"),
    "count_curve": (lambda s, d: rounded(C.count_curve(scored(s, d), ["model"], "d", "event_id", "ok"), "center", "cap"), f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY d, event_id) AS rn, count(*) OVER (PARTITION BY model) AS n FROM e) SELECT model, CAST(least((rn - 1) // greatest(1, n // 10), 9) AS INT) AS bin, round(avg(d), 6) AS center, round(avg(ok::INT), 6) AS cap, count(*) AS n FROM r GROUP BY 1, 2"),
    "curve_interpolation": (lambda s, d: rounded(C.interpolate(C.count_curve(scored(s, d), ["model"], "d", "event_id", "ok"), ["model"], _AT), "value"), f"WITH {_COUNTED}, p AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _AT)}]) AS d), lo AS (SELECT p.d, model, max(center) AS a FROM p JOIN curve ON center <= p.d GROUP BY 1, 2), hi AS (SELECT p.d, model, min(center) AS b FROM p JOIN curve ON center > p.d GROUP BY 1, 2), j AS (SELECT m.model, p.d, a, b, x.cap AS va, y.cap AS vb FROM (SELECT DISTINCT model FROM curve) m CROSS JOIN p LEFT JOIN lo ON lo.d = p.d AND lo.model = m.model LEFT JOIN hi ON hi.d = p.d AND hi.model = m.model LEFT JOIN curve x ON x.model = m.model AND x.center = a LEFT JOIN curve y ON y.model = m.model AND y.center = b) SELECT model, d, round(CASE WHEN a IS NULL THEN vb WHEN b IS NULL THEN va ELSE va + (vb - va) * (d - a) / (b - a) END, 6) AS value FROM j"),
    "isotonic_curve": (lambda s, d: rounded(isotonic(C.count_curve(scored(s, d), ["model"], "d", "event_id", "ok"), ["model"], "center", "cap"), "center", "cap", "fitted"), f"WITH {_COUNTED}, {pooled_sql('curve', 'model', 'center', 'cap', 'fitted', 'pool')} SELECT model, round(center, 6) AS center, round(cap, 6) AS cap, round(fitted, 6) AS fitted FROM pool JOIN curve USING (model, center)"),
    "confusion_metrics": (lambda s, d: rounded(M.confusion(scored(s, d), ["model"], F.col("ok"), F.col("p") >= 0.3), "precision", "recall", "accuracy", "f1"), f"WITH {_SCORED}, c AS (SELECT model, count(*) FILTER (ok AND p >= 0.3) AS tp, count(*) FILTER (NOT ok AND p >= 0.3) AS fp, count(*) FILTER (ok AND p < 0.3) AS fn, count(*) FILTER (NOT ok AND p < 0.3) AS tn FROM e GROUP BY 1), m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS a, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS b FROM c) SELECT model, tp, fp, fn, tn, round(a, 6) AS precision, round(b, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS f1 FROM m"),
    "brier_score": (lambda s, d: rounded(scored(s, d).groupBy("model").agg(M.brier(F.col("ok"), F.col("p")).alias("brier")), "brier"), f"WITH {_SCORED} SELECT model, round(avg(power(p - ok::INT, 2)), 6) AS brier FROM e GROUP BY 1"),
    "calibration_error": (lambda s, d: rounded(M.calibration_error(scored(s, d), ["model"], "ok", "p", 10), "ece"), f"WITH {_SCORED}, b AS (SELECT model, len(list_filter([{', '.join(f'{k * (1.0 / 10)!r}::DOUBLE' for k in range(1, 10))}], lambda x: x <= p)) AS b, count(*) AS n, avg(ok::INT) AS acc, avg(p) AS conf FROM e GROUP BY 1, 2) SELECT model, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b GROUP BY 1"),
    "roc_auc": (lambda s, d: rounded(M.roc_auc(scored(s, d), ["model"], "ok", "p"), "roc_auc"), f"WITH {_SCORED}, g AS (SELECT model, p, count(*) FILTER (ok) AS pos, count(*) FILTER (NOT ok) AS neg FROM e GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT model, round(sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos) * sum(neg))::DOUBLE, 6) AS roc_auc FROM c GROUP BY 1"),
    "pr_auc": (lambda s, d: rounded(M.pr_auc(scored(s, d), ["model"], "ok", "p"), "pr_auc"), f"WITH {_SCORED}, g AS (SELECT model, p, count(*) FILTER (ok) AS pos, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT model, pos, sum(pos) OVER w / (sum(n) OVER w)::DOUBLE AS prec FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC)) SELECT model, round(sum(pos * prec) / sum(pos)::DOUBLE, 6) AS pr_auc FROM c GROUP BY 1"),
    "best_f1_threshold": (lambda s, d: rounded(M.best_f1_threshold(scored(s, d).withColumn("ok", F.col("ok").cast("int")), ["model"], "ok", "p"), "f1"), f"WITH {_SCORED}, g AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in M.GRID19)}]) AS t), c AS (SELECT model, t, coalesce(2 * count(*) FILTER (ok AND p >= t) / nullif(2 * count(*) FILTER (ok AND p >= t) + count(*) FILTER (NOT ok AND p >= t) + count(*) FILTER (ok AND p < t), 0)::DOUBLE, 0) AS f1 FROM e, g GROUP BY 1, 2) SELECT model, arg_max(t, (round(f1, 12), -t)) AS tau, round(max(f1), 6) AS f1 FROM c GROUP BY 1"),
    "mean_ci95": (lambda s, d: rounded(M.mean_ci95(scored(s, d), ["model"], "p"), "mean", "ci95"), f"WITH {_SCORED} SELECT model, round(avg(p), 6) AS mean, round(1.96::DOUBLE * stddev_samp(p) / sqrt(count(p)), 6) AS ci95, count(p) AS n FROM e GROUP BY 1"),
    "mcnemar_chi2": (lambda s, d: rounded(M.mcnemar(scored(s, d), ["model"], F.col("ok"), F.col("p") < 0.4), "chi2", n=4).drop("p_value"), f"WITH {_SCORED}, c AS (SELECT model, count(*) FILTER (ok AND p >= 0.4) AS b, count(*) FILTER (NOT ok AND p < 0.4) AS c FROM e GROUP BY 1) SELECT model, b, c, round(coalesce(power(abs(b - c) - 1.0::DOUBLE, 2) / nullif(b + c, 0), 0), 4) AS chi2 FROM c"),
    "mcnemar_p": (lambda s, d: M.mcnemar(scored(s, d), ["model"], F.col("ok"), F.col("p") < 0.4).select("model", "p_value"), None),
    "holm_correction": (lambda s, d: rounded(M.holm(t(s, d, "events").select("event_id", "event_type", (F.pmod(F.col("event_id") * 37, F.lit(1000)) / 20000).alias("pv")), ["event_type"], "pv", ["event_id"]).select("event_id", "p_holm"), "p_holm", n=9), "WITH p AS (SELECT event_id, event_type, (event_id * 37 % 1000) / 20000.0::DOUBLE AS pv FROM events), r AS (SELECT *, pv * (count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY pv, event_id) + 1) AS raw FROM p) SELECT event_id, round(least(1.0, max(raw) OVER (PARTITION BY event_type ORDER BY pv, event_id ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM r"),
    "guarded_correlation": (lambda s, d: rounded(M.guarded_correlation(scored(s, d), ["model"], "d", "risk"), "r"), f"WITH {_SCORED} SELECT model, round(corr(d, risk), 6) AS r FROM e GROUP BY 1"),
    "common_splits": (lambda s, d: build_splits(t(s, d, "events").select(F.lit("t").alias("task"), F.col("event_type").alias("model"), F.col("user_id").alias("sample")), "task", "model", "sample", "42"), "WITH n AS (SELECT user_id AS sample FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) ORDER BY 1 LIMIT 250), u AS (SELECT sample, ('0x' || substr(sha256('42:t:' || sample), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM n) SELECT 't' AS task, sample, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split FROM u"),
}
