"""Operational profiles, coverage and failure reports, costs and robustness of tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import num, safe_div, true
from .economics import FAILURE_LOSS, LATENCY_COST_PER_SEC, SUCCESS_VALUE
from .metrics import brier, calibration_error, confusion, pr_auc, roc_auc
from .relational import latest
from .ordered import matched, percentiles

# Dollars a query, and fields that a record must have.
SLM_COST, LLM_COST = 0.0003, 0.0035
REQUIRED = ("task", "bin", "sample_id", "model", "timestamp", "status", "prompt", "raw_output", "valid")


def clean(status: Column, valid: Column) -> Column:
    """Whether a row may be used: a success with valid output."""
    return F.coalesce((status == "success") & valid, F.lit(False))


def first_clean(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """The first row of each (task, model, canonical_id), by its file's rank and then its line. rows: task, model, canonical_id (empty or null: left out), file, line."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("file")), F.lit(len(ranks)))
    named = rows.where("canonical_id <> ''")
    first = F.min_by(F.struct(*rows.columns), F.struct(rank, F.col("line")))
    return named.groupBy("task", "model", "canonical_id").agg(first.alias("_r")).select("_r.*")


def missing_fields(names: tuple[str, ...] = REQUIRED) -> Column:
    """Names of the required columns that are null in a row."""
    return F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in names]), lambda x: x.isNotNull())


def leakage(split: Column, frozen: Column, n_val: Column, n_train: Column, n_report: Column) -> Column:
    """Codes of the rules that a report of (task, model) breaks."""
    codes = [
        F.when(split.isin("test", "evaluation", "eval") & ~frozen, "threshold_split_must_be_val_for_test"),
        F.when(split.isin("test", "val") & (n_val <= 0), "missing_val_threshold_rows"),
        F.when(n_train <= 0, "missing_train_curve_rows"),
        F.when(n_report <= 0, "missing_report_rows"),
    ]
    return F.filter(F.array(*codes), lambda x: x.isNotNull())


def assert_no_leakage(codes: Column) -> Column:
    """The codes, or an error where there are any."""
    return F.when(F.size(codes) > 0, F.raise_error(F.concat(F.lit("leakage guard failed: "), F.concat_ws(", ", codes))).cast("array<string>")).otherwise(codes)


def average_latency(rows: DataFrame, by: list[str], key: str, at: str, position: str, latency: str) -> DataFrame:
    """Mean latency of the latest row of each key, nulls left out; 0 without any."""
    last = latest(rows.withColumn("_k", F.struct(*by, key)), "_k", at, position)
    return last.groupBy(*by).agg(F.coalesce(F.avg(num(F.col(latency))), F.lit(0.0)).alias("avg_latency"))


def operational_profile(rows: DataFrame, by: list[str], latency: str, success: Column) -> DataFrame:
    """n, mean and percentiles of latency, queries a second of one worker, and rates of success and error."""
    p = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(latency).alias("avg_latency"), F.avg(success.cast("double")).alias("success_rate"))
    p = matched(p, percentiles(rows, by, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by)
    return p.select(*by, "n", "avg_latency", "p50", "p95", "p99", safe_div(F.lit(1.0), F.col("avg_latency")).alias("qps"), "success_rate", (1 - F.col("success_rate")).alias("error_rate"))


def bin_summary(rows: DataFrame, by: list[str], status: str, valid: str, latency: str) -> DataFrame:
    """By bin: n_samples, success_rate, avg_latency, validity_rate."""
    ok = F.coalesce(F.col(status) == "success", F.lit(False)).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg(ok).alias("success_rate"), F.avg(latency).alias("avg_latency"), F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("double")).alias("validity_rate"))


def coverage_report(bins: DataFrame, success: str, target: str) -> DataFrame:
    """Adds coverage_pct and is_complete."""
    pct = 100.0 * safe_div(F.col(success), F.col(target))
    return bins.withColumns({"coverage_pct": pct, "is_complete": pct == 100.0})


def error_taxonomy(rows: DataFrame, by: list[str], failed: str, risk: str, harm: str, category: str, top: int = 3) -> DataFrame:
    """By group: failures, means of risk and harm, and the most frequent categories of failure with counts (by name among equals; none: empty and 0)."""
    bad = F.coalesce(F.col(failed), F.lit(False))
    g = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_failures"), F.avg(risk).alias("avg_risk"), F.avg(harm).alias("avg_harm"))
    n = rows.where(bad & F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("_n"))
    ranked = n.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(category).alias("c")))), 1, top).alias("_t"))
    out = g.join(ranked, by, "left").withColumn("failure_rate", safe_div(F.col("n_failures"), F.col("n_rows")))
    names = {}
    for k in range(top):
        e = F.try_element_at("_t", F.lit(k + 1))
        names |= {f"top_failure_{k + 1}": F.coalesce(e["c"], F.lit("")), f"top_failure_{k + 1}_count": F.coalesce(-e["n"], F.lit(0))}
    return out.withColumns(names).drop("_t")


def split_metrics(df: DataFrame, by: list[str], y: str, p: str, threshold: float, bins: int = 10) -> DataFrame:
    """n, positive_rate, avg_p, f1, accuracy, roc_auc, pr_auc, brier and ece of failure probabilities p against labels y (0 or 1)."""
    means = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("positive_rate"), F.avg(p).alias("avg_p"), brier(F.col(y), F.col(p)).alias("brier"))
    c = confusion(df, by, F.col(y) == 1, F.col(p) >= threshold).select(*by, "f1", "accuracy")
    out = means.join(c, by)
    for more in (roc_auc(df, by, y, p), pr_auc(df, by, y, p), calibration_error(df, by, y, p, bins)):
        out = out.join(more, by, "left")
    return out


def sensitivity_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Pass rate and means over (task, model) rows of a run; what is no number counts as 0, a missing p value as 1."""
    plain = ("precision", "recall", "f1", "accuracy", "coverage_slm", "delta_utility")
    passed = F.lower(F.col("passed").cast("string")).isin("true", "1", "yes")
    return runs.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.avg(F.coalesce(passed, F.lit(False)).cast("double")).alias("pass_rate"),
        *[F.avg(F.coalesce(num(F.col(c)), F.lit(0.0))).alias(f"avg_{c}") for c in plain],
        F.avg(F.coalesce(num(F.col("p_holm")), F.lit(1.0))).alias("avg_p_holm"),
    )


def impact_by_task(routed: DataFrame) -> DataFrame:
    """Coverage and blended cost of each task that has queries. routed: task, slm_routed, llm_routed."""
    total = F.col("slm_routed") + F.col("llm_routed")
    r = routed.where(total > 0).withColumns({"total_queries": total, "_s": F.col("slm_routed") / total})
    cost = F.col("_s") * SLM_COST + (1 - F.col("_s")) * LLM_COST
    return r.withColumns({"slm_coverage_pct": 100 * F.col("_s"), "cost_per_query": cost, "savings_pct": 100 * (1 - cost / LLM_COST)}).drop("_s")


def impact_overall(routed: DataFrame) -> DataFrame:
    """One row: shares, blended cost and savings over all tasks; zeros without queries."""
    g = routed.agg(F.coalesce(F.sum("slm_routed"), F.lit(0)).alias("slm"), F.coalesce(F.sum("llm_routed"), F.lit(0)).alias("llm"))
    n = F.col("slm") + F.col("llm")
    share = safe_div(F.col("slm"), n)
    cost = F.when(n > 0, share * SLM_COST + (1 - share) * LLM_COST).otherwise(0.0)
    return g.select(n.alias("total_queries"), (100 * share).alias("slm_pct"), cost.alias("cost_per_query"), F.when(n > 0, 100 * (1 - cost / LLM_COST)).otherwise(0.0).alias("savings_pct"), ((LLM_COST - cost) * n).alias("savings_usd"))


def weighted_ratio(use_cases: DataFrame) -> DataFrame:
    """Mean ratio of use cases by their rows. use_cases: total_rows, rho_bar."""
    return use_cases.agg(safe_div(F.sum(F.col("total_rows") * F.col("rho_bar")), F.sum("total_rows")).alias("weighted_rho_bar"), F.sum("total_rows").alias("total_rows"))


def tier_robustness(swept: DataFrame, grid: list[str], slm: str, llm: str) -> DataFrame:
    """By grid point: balance of the tiers, distance of ratios to the limits, and the use case nearest to one.

    swept: grid, use_case, rho_bar, tier, and the limits. Diversity is 1 for equal shares and 0 for one tier alone or less even.
    """
    r, s, l = F.col("rho_bar"), F.col(slm), F.col(llm)  # noqa: E741
    margin = F.when(r >= s, r - s).when(r <= l, l - r).otherwise(F.least(s - r, r - l))
    inside = F.when(s > l, F.least(r - l, s - r) / (s - l) * 100).otherwise(0.0)
    confidence = F.when(r >= s, F.least(F.lit(100.0), safe_div(r - s, 1.0 - s) * 100)).when(r <= l, F.least(F.lit(100.0), safe_div(l - r, l) * 100)).otherwise(inside)
    x = swept.withColumns({"_m": margin, "_c": confidence})
    n = lambda t: F.count_if(F.col("tier") == t).cast("double")
    g = x.groupBy(*grid).agg(n("SLM").alias("_s"), n("HYBRID").alias("_h"), n("LLM").alias("_l"), F.count("*").alias("_n"), F.avg("_m").alias("_a"), F.avg("_c").alias("mean_confidence"), F.min("_c").alias("min_confidence"), F.min_by("use_case", F.struct("_c", "use_case")).alias("riskiest"))
    ideal = F.col("_n") / 3.0
    variance = sum((F.pow(F.col(c) - ideal, F.lit(2.0)) for c in ("_s", "_h", "_l")), F.lit(0.0)) / 3.0
    return g.select(*grid, F.greatest(F.lit(0.0), 1.0 - variance / F.pow(ideal, F.lit(2.0))).alias("diversity"), F.least(F.lit(1.0), F.col("_a") * 5).alias("robustness"), "mean_confidence", "min_confidence", "riskiest")


def objective_rankings(sweep: DataFrame) -> DataFrame:
    """The best grid point by each of four objectives, the first by ``ord`` among equals. sweep: ord, slm, llm, hybrid_ratio, slm_coverage, gap."""
    point = F.struct("ord", "slm", "llm")
    paper = F.abs(F.col("slm") - 0.7) + F.abs(F.col("llm") - 0.3)
    keys = {"minimize_hybrid": ("hybrid_ratio", "gap", "ord"), "maximize_slm": (-F.col("slm_coverage"), "ord"), "maximize_gap": (-F.col("gap"), "ord"), "closest_to_paper": (paper, "ord")}
    one = sweep.agg(*[F.min_by(point, F.struct(*k)).alias(n) for n, k in keys.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("objective"), F.col(n).alias("p")) for n in keys])
    return one.select(F.explode(rows).alias("r")).where("r.p is not null").select("r.objective", "r.p.*")


def bin_shares(df: DataFrame, by: list[str], bin: str) -> DataFrame:
    """Rows by bin and their share of the group; 0 where the group is empty."""
    g = df.groupBy(*by, bin).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def blended_strategy(slm_bins: DataFrame, base_bins: DataFrame, models: DataFrame) -> DataFrame:
    """Economics of the small model up to its limit bin and the baseline beyond it, by (task, model).

    slm_bins: task, model, bin, n, cap, risk; base_bins: task, bin, cap, risk; models: task, model, limit_bin, and capability, risk, latency, cost of the model
    (slm_*) and of the baseline (base_*). A bin that a curve lacks has its model's mean. No limit bin: all goes to the baseline.
    """
    total = slm_bins.groupBy("task", "model").agg(F.sum("n").alias("_n"))
    b = slm_bins.join(total, ["task", "model"]).join(models, ["task", "model"]).join(base_bins.select("task", "bin", F.col("cap").alias("_bc"), F.col("risk").alias("_br")), ["task", "bin"], "left")
    share = safe_div(F.col("n"), F.col("_n"))
    small = F.coalesce(F.col("bin") <= F.col("limit_bin"), F.lit(False))
    cap = F.when(small, F.coalesce("cap", "slm_cap")).otherwise(F.coalesce("_bc", "base_cap"))
    risk = F.when(small, F.coalesce("risk", "slm_risk")).otherwise(F.coalesce("_br", "base_risk"))
    g = b.groupBy("task", "model").agg(F.sum(F.when(small, share).otherwise(0.0)).alias("route_share"), F.sum(share * cap).alias("_cap"), F.sum(share * risk).alias("_risk"))
    j = models.join(g, ["task", "model"], "left")
    none = F.col("limit_bin").isNull() | F.col("_cap").isNull()
    j = j.withColumns({"route_share": F.when(none, 0.0).otherwise(F.col("route_share")), "capability": F.when(none, F.col("base_cap")).otherwise(F.col("_cap")), "risk": F.when(none, F.col("base_risk")).otherwise(F.col("_risk"))})
    mix = lambda a, b: F.col("route_share") * F.col(a) + (1 - F.col("route_share")) * F.col(b)
    j = j.withColumns({"latency": mix("slm_latency", "base_latency"), "cost": mix("slm_cost", "base_cost")})
    value = lambda c, r, t, d: SUCCESS_VALUE * c - FAILURE_LOSS * r - LATENCY_COST_PER_SEC * t - d
    ev = value(F.col("capability"), F.col("risk"), F.col("latency"), F.col("cost"))
    more_risk = F.col("risk") - F.col("base_risk")
    even = F.when(~none & (more_risk > 0), (SUCCESS_VALUE * (F.col("capability") - F.col("base_cap")) - (F.col("cost") - F.col("base_cost")) - LATENCY_COST_PER_SEC * (F.col("latency") - F.col("base_latency"))) / more_risk)
    base_ev = value(F.col("base_cap"), F.col("base_risk"), F.col("base_latency"), F.col("base_cost"))
    return j.select("task", "model", "route_share", "capability", "risk", "latency", "cost", ev.alias("expected_value"), (F.col("base_cost") - F.col("cost")).alias("savings"), F.when(none, 0.0).otherwise(ev - base_ev).alias("value_delta"), even.alias("break_even_failure_loss"))


def normalised(value: Column, *by: str) -> Column:
    """Value between the least and the greatest of its group; 0.5 where they are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high <= low, 0.5).otherwise((value - low) / (high - low))


def fold(target: Column, order_by: list[str], folds: int, *by: str) -> Column:
    """Fold of a row by its rank in the target, so that folds are alike."""
    return F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(target, *order_by)) - 1, F.lit(folds))


def weighted_norm(weights: dict[str, float], bounds: dict[str, tuple[float, float]]) -> Column:
    """Weighted sum of features, each between its bounds; 0 where they are equal or the feature is missing."""
    part = lambda n: F.when(F.lit(bounds[n][1] > bounds[n][0]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(F.col(n), F.lit(bounds[n][0])) - bounds[n][0]) / ((bounds[n][1] - bounds[n][0]) or 1.0)))).otherwise(0.0)
    return sum((w * part(n) for n, w in weights.items()), F.lit(0.0))


def log_loss(y: Column, p: Column, eps: float = 1e-9) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def agreed(flags: Column) -> Column:
    """Whether all values of a column are true by Python's rules; true without any."""
    return F.coalesce(F.bool_and(true(flags)), F.lit(True))
