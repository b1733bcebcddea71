"""Frozen thresholds at work: validation and test summaries, use-case routing and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import safe_div
from .routing import FROZEN_TAU, ratio, route, tau_of, tier

# The use cases and their task families.
USE_CASES = {
    "UC1": "classification", "UC2": "information_extraction", "UC3": "classification", "UC4": "classification",
    "UC5": "code_generation", "UC6": "classification", "UC7": "summarization", "UC8": "text_generation",
}


def known_families(df: DataFrame, task: str) -> DataFrame:
    """Rows of families that have a frozen threshold; the others cannot be routed and are left out of summaries."""
    return df.where(F.col(task).isin(*FROZEN_TAU))


def model_routes(samples: DataFrame) -> DataFrame:
    """Routes by (task, model): rho, slm_routed, llm_routed. samples: task, model, p_fail (null: 0.5)."""
    went = known_families(samples, "task").withColumn("_r", route(F.coalesce("p_fail", F.lit(0.5)), tau_of(F.col("task"))))
    return went.groupBy("task", "model").agg(ratio(F.col("_r")).alias("rho"), F.count_if(F.col("_r") == "SLM").alias("slm_routed"), F.count_if(F.col("_r") == "LLM").alias("llm_routed"))


def explanation(rho: Column, slm: float = 0.5, llm: float = 0.3, digits: int | None = 2) -> Column:
    """Why a ratio has its tier. digits: of the limits, or None for as many as they have."""
    a, b = (f"{x:.{digits}f}" if digits is not None else str(x) for x in (slm, llm))
    shown = F.format_string("%.4f", rho)
    high = F.concat(F.lit("High SLM routing confidence (rho_bar="), shown, F.lit(f" >= {a})"))
    low = F.concat(F.lit("Low SLM routing confidence (rho_bar="), shown, F.lit(f" < {b})"))
    mixed = F.concat(F.lit(f"Mixed routing outcomes ({b} <= rho_bar="), shown, F.lit(f" < {a})"))
    return F.when(rho >= slm, high).when(rho < llm, low).otherwise(mixed)


def frozen_validation(samples: DataFrame, results: DataFrame, position: str) -> DataFrame:
    """A row by task: tau, rho_bar, tier, explanation, and quality over its distinct queries.

    samples: task, model, p_fail. results: task, query_id, slm_correct, llm_correct (null: false); of several rows
    of a query the first by ``position`` counts. Tasks without results have 0 queries and accuracies of 0.
    """
    by_task = model_routes(samples).groupBy("task").agg(F.avg("rho").alias("rho_bar"), F.count("*").alias("n_models"), F.sum("slm_routed").alias("slm_routed"), F.sum("llm_routed").alias("llm_routed"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    first = results.groupBy("task", "query_id").agg(F.min_by(F.struct(flag("slm_correct"), flag("llm_correct")), position).alias("r"))
    quality = first.groupBy("task").agg(F.count("*").alias("total_queries"), F.count_if(F.col("r.slm_correct")).alias("_s"), F.count_if(F.col("r.llm_correct")).alias("_l"))
    out = by_task.join(quality, "task", "left").na.fill(0, ["total_queries", "_s", "_l"])
    return out.select(
        "task",
        tau_of(F.col("task")).alias("tau"),
        "n_models",
        "slm_routed",
        "llm_routed",
        "rho_bar",
        tier(F.col("rho_bar")).alias("tier"),
        explanation(F.col("rho_bar")).alias("explanation"),
        safe_div(F.col("_s"), F.col("total_queries")).alias("slm_accuracy"),
        safe_div(F.col("_l"), F.col("total_queries")).alias("llm_accuracy"),
        (F.col("total_queries") - F.col("_s")).alias("slm_failures"),
        "total_queries",
    )


def tier_counts(by_task: DataFrame) -> DataFrame:
    """One row: how many tasks were validated, and how many have each tier."""
    n = lambda t: F.count_if(F.col("tier") == t)
    return by_task.agg(F.count("*").alias("tasks_validated"), n("SLM").alias("slm_tier_count"), n("HYBRID").alias("hybrid_tier_count"), n("LLM").alias("llm_tier_count"))


def frozen_test_models(samples: DataFrame) -> DataFrame:
    """By (task, model): rho, routes, and accuracy on each route by the model that served it.

    samples: task, model, p_fail (null: 0.5), slm_correct, llm_correct (null: false).
    """
    s = known_families(samples, "task").withColumn("_slm", route(F.coalesce("p_fail", F.lit(0.5)), tau_of(F.col("task"))) == "SLM")
    right = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = s.groupBy("task", "model").agg(
        F.count("*").alias("n"),
        F.count_if("_slm").alias("slm_routed"),
        F.count_if(~F.col("_slm")).alias("llm_routed"),
        F.count_if(F.col("_slm") & right("slm_correct")).alias("_ss"),
        F.count_if(~F.col("_slm") & right("llm_correct")).alias("_ll"),
        F.count_if(right("slm_correct")).alias("slm_right"),
        F.count_if(right("llm_correct")).alias("llm_right"),
    )
    return g.withColumns(
        {
            "rho": safe_div(F.col("slm_routed"), F.col("n")),
            "accuracy_on_slm_routes": safe_div(F.col("_ss"), F.col("slm_routed")),
            "accuracy_on_llm_routes": safe_div(F.col("_ll"), F.col("llm_routed")),
        }
    ).drop("_ss", "_ll")


def frozen_test(models: DataFrame) -> DataFrame:
    """By task, over all rows of all models: consensus, tier, accuracies and failures. models: as frozen_test_models gives it."""
    g = models.groupBy("task").agg(F.avg("rho").alias("consensus_rho"), F.sum("n").alias("total_queries"), F.sum("slm_right").alias("_s"), F.sum("llm_right").alias("_l"))
    failures = F.col("total_queries") - F.col("_s")
    return g.select(
        "task",
        tau_of(F.col("task")).alias("tau"),
        "consensus_rho",
        tier(F.col("consensus_rho")).alias("tier"),
        "total_queries",
        safe_div(F.col("_s"), F.col("total_queries")).alias("slm_accuracy"),
        safe_div(F.col("_l"), F.col("total_queries")).alias("llm_accuracy"),
        failures.alias("slm_failures"),
        safe_div(failures, F.col("total_queries")).alias("failure_rate"),
    )


def summary_of_test(by_task: DataFrame) -> DataFrame:
    """One row over all tasks of frozen_test."""
    n = lambda t: F.count_if(F.col("tier") == t)
    s = by_task.agg(F.count("*").alias("tasks_evaluated"), n("SLM").alias("slm"), n("HYBRID").alias("hybrid"), n("LLM").alias("llm"), F.sum("total_queries").alias("total_queries"), F.sum("slm_failures").alias("total_failures"))
    return s.withColumn("overall_failure_rate", safe_div(F.col("total_failures"), F.col("total_queries")))


def ensemble_routing(samples: DataFrame, taus: DataFrame) -> DataFrame:
    """Test routing by the mean difficulty over a sample's models: LLM above tau, else SLM.

    samples: task, sample_id, model, difficulty, correct, error; the last two are a sample's, so the same for its models.
    taus: task, tau. Returns by task: counts, routing_ratio, capability and risk by route, and the overall capability.
    """
    one = samples.groupBy("task", "sample_id").agg(F.avg("difficulty").alias("d"), F.max(F.col("correct").cast("double")).alias("c"), F.max("error").alias("e"))
    at = one.where("d is not null").join(F.broadcast(taus), "task").withColumn("slm", F.col("d") <= F.col("tau"))
    g = at.groupBy("task", "tau").agg(
        F.count("*").alias("n"),
        F.count_if("slm").alias("slm_routed"),
        F.count_if(~F.col("slm")).alias("llm_routed"),
        *[F.coalesce(F.avg(F.when(F.col("slm") == side, F.col(c))), F.lit(0.0)).alias(f"{name}_{label}") for c, name in (("c", "capability"), ("e", "risk")) for side, label in ((True, "slm"), (False, "llm"))],
    )
    overall = safe_div(F.col("capability_slm") * F.col("slm_routed") + F.col("capability_llm") * F.col("llm_routed"), F.col("n"))
    return g.withColumns({"routing_ratio": safe_div(F.col("slm_routed"), F.col("n")), "capability_overall": overall})


def use_case_routing(queries: DataFrame) -> DataFrame:
    """By (use_case, task) of one model: tier, ratio, counts and the ids of each route in order. queries: use_case, task, query_id, p_fail.

    The id lists grow with a use case's queries, as the reference's do; drop them where only the tier is wanted, and
    Spark computes neither.
    """
    q = known_families(queries, "task").withColumn("_slm", route(F.col("p_fail"), tau_of(F.col("task"))) == "SLM")
    ids = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("query_id"))))
    g = q.groupBy("use_case", "task").agg(F.avg(F.col("_slm").cast("double")).alias("rho_bar"), F.count_if("_slm").alias("slm_count"), F.count_if(~F.col("_slm")).alias("llm_count"), F.count("*").alias("total_queries"), ids(F.col("_slm")).alias("slm_routes"), ids(~F.col("_slm")).alias("llm_routes"))
    return g.withColumn("tier", tier(F.col("rho_bar")))


def use_case_routing_multimodel(queries: DataFrame, slm: float = 0.5, llm: float = 0.3) -> DataFrame:
    """By (use_case, task): the mean of its models' ratios, the tier, and the ratios by model. queries: use_case, task, model, query_id, p_fail."""
    q = known_families(queries, "task").withColumn("_r", route(F.col("p_fail"), tau_of(F.col("task"))))
    per = q.groupBy("use_case", "task", "model").agg(ratio(F.col("_r")).alias("rho"))
    g = per.groupBy("use_case", "task").agg(F.avg("rho").alias("rho_bar"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "rho")))).alias("per_model_rho"))
    return g.withColumn("tier", tier(F.col("rho_bar"), slm, llm))


def assign_use_cases(use_cases: DataFrame, rho: DataFrame, slm: float = 0.5, llm: float = 0.3) -> DataFrame:
    """Tier of each use case by its family's ratio; without one UNKNOWN and error. use_cases: usecase_id, task; rho: task, rho_bar."""
    j = use_cases.join(rho.select("task", "rho_bar"), "task", "left")
    missing = F.col("rho_bar").isNull()
    told = F.when(missing, F.concat(F.lit("No rho_bar computed for task family: "), F.col("task"))).otherwise(explanation(F.col("rho_bar"), slm, llm, None))
    return j.select("usecase_id", "task", "rho_bar", F.when(missing, "UNKNOWN").otherwise(tier(F.col("rho_bar"), slm, llm)).alias("tier"), told.alias("explanation"), missing.alias("error"))


def use_case_table(spark) -> DataFrame:
    return spark.createDataFrame(list(USE_CASES.items()), "usecase_id string, task string")


def tier_agreement(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Use cases with both tiers side by side and whether they agree; unknown and missing tiers do not."""
    v = validation.select("usecase_id", "task", F.col("tier").alias("validation_tier"), F.col("rho_bar").alias("validation_rho"))
    t = test.select("usecase_id", F.col("tier").alias("test_tier"), F.col("rho_bar").alias("test_rho"))
    same = F.coalesce((F.col("validation_tier") == F.col("test_tier")) & (F.col("test_tier") != "UNKNOWN"), F.lit(False))
    return v.join(t, "usecase_id", "left").withColumn("agree", same)


def agreement_report(pairs: DataFrame) -> DataFrame:
    """One row: how many use cases agree, of how many, and their share."""
    g = pairs.agg(F.count_if("agree").alias("n_agree"), F.count("*").alias("n"))
    return g.withColumn("agreement", safe_div(F.col("n_agree"), F.col("n")))
