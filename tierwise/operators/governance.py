"""Governance: six scores from 1 to 5, gates, tiers and enforcement, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import one_to_five
from ..functions.text import cue_count, pattern_count, word_count

DIMENSIONS = ("TC", "OS", "SK", "DS", "LT", "VL")
# Terms of the scores and weights of the dimensions.
FORMAT_TERMS = ("json", "yaml", "xml", "csv", "table", "schema", "markdown", "bullet", "list", "columns")
CONSTRAINT_TERMS = ("must", "should", "exactly", "at least", "at most", "do not", "cannot", "required", "only")
STAKES_TERMS = ("medical", "health", "diagnosis", "clinical", "legal", "compliance", "financial", "fraud", "safety", "security", "critical")
SENSITIVE_TERMS = ("ssn", "social security", "passport", "credit card", "bank account", "patient", "hipaa", "phi", "pii", "personal data", "gdpr")
WEIGHTS = {"TC": 3, "OS": 2, "SK": 4, "DS": 2, "LT": 3, "VL": 1}
# Patterns of complexity and structure.
HARD, OPERATORS = r"\b(algorithm|proof|optimi[sz]e|derive|complexity|multi-step)\b", r"[\=\+\-\*/\^%<>]"
BRACKETS, ORDER = r"[\{\}\[\],:|]", r"\b(first|second|third|step|ordered|sorted)\b"
#: From the laxest to the strictest.
TIERS = ("pure_slm", "hybrid", "llm_only", "disqualified")


def within_five(raw: Column) -> Column:
    """one_to_five of a sum that is never null, named once."""
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.bround(raw, 0))).cast("int")


def task_complexity(task: Column, prompt: Column, constraints: tuple[str, ...] = CONSTRAINT_TERMS) -> Column:
    text = F.trim(F.coalesce(prompt, F.lit("")))
    raw = 1.0 + F.least(F.lit(2.0), word_count(text) / 120.0) + F.least(F.lit(1.0), cue_count(text, constraints) / 4.0)
    raw += F.least(F.lit(1.0), pattern_count(text, HARD) / 3.0)
    raw += F.least(F.lit(1.0), pattern_count(text, OPERATORS) / 20.0)
    prior = F.when(task.isin("maths", "code_generation", "retrieval_grounded"), 0.4).when(task.isin("classification", "summarization"), -0.2).otherwise(0.0)
    return within_five(raw + prior)


def output_structure(prompt: Column, expected: Column, formats: tuple[str, ...] = FORMAT_TERMS) -> Column:
    text = F.concat(F.coalesce(prompt, F.lit("")), F.lit(" "), F.coalesce(expected, F.lit("")))
    raw = 1.0 + F.least(F.lit(2.2), cue_count(text, formats) / 2.0) + F.least(F.lit(1.0), pattern_count(text, BRACKETS) / 40.0)
    return within_five(raw + F.least(F.lit(1.0), pattern_count(text, ORDER) / 3.0))


def stakes(task: Column, prompt: Column, critical: Column, approval: Column, terms: tuple[str, ...] = STAKES_TERMS) -> Column:
    raw = 1.0 + F.least(F.lit(2.0), cue_count(F.coalesce(prompt, F.lit("")), terms) / 2.0)
    raw += F.when(task.isin("maths", "code_generation"), 0.4).otherwise(0.0) + F.when(critical, 1.2).otherwise(0.0)
    return within_five(raw + F.when(approval, 0.6).otherwise(0.0))


def data_sensitivity(prompt: Column, level: Column, pii: Column, phi: Column, terms: tuple[str, ...] = SENSITIVE_TERMS) -> Column:
    name = F.lower(F.trim(F.coalesce(level, F.lit("internal"))))
    base = F.when(name == "public", 1.0).when(name == "confidential", 3.2).when(name == "restricted", 4.2).otherwise(2.0)
    raw = base + F.least(F.lit(1.0), cue_count(F.coalesce(prompt, F.lit("")), terms) / 2.0)
    return within_five(raw + F.when(pii, 0.8).otherwise(0.0) + F.when(phi, 1.0).otherwise(0.0))


def latency_tolerance(p99_ms: Column, real_time: Column) -> Column:
    none = F.when(real_time, 4).otherwise(3)
    return F.when(p99_ms.isNull(), none).when(p99_ms <= 300, 5).when(p99_ms <= 800, 4).when(p99_ms <= 2000, 3).when(p99_ms <= 5000, 2).otherwise(1)


def volume_load(qps: Column, daily: Column, bursty: Column) -> Column:
    def ladder(x: Column, steps: tuple[float, ...]) -> Column:
        out = F.when(x.isNull(), 0.0)
        for score, least in zip((5.0, 4.0, 3.0, 2.0), steps, strict=True):
            out = out.when(x >= least, score)
        return out.otherwise(1.0)

    signal = F.greatest(ladder(qps, (500, 100, 20, 5)), ladder(daily, (10_000_000, 1_000_000, 100_000, 10_000)))
    return one_to_five(F.when(signal == 0, 2.0).otherwise(signal) + F.when(bursty, 0.6).otherwise(0.0))


def gate(tc: Column, sk: Column) -> Column:
    """disqualified, hybrid (at least) or none."""
    return F.when((sk == 5) | ((tc == 5) & (sk >= 4)), "disqualified").when(sk >= 4, "hybrid").otherwise("none")


def valid_weights(weights: dict[str, int]) -> dict[str, int]:
    """The weights, or an error: all six dimensions, each at least 1, stakes no less than complexity."""
    if set(weights) != set(DIMENSIONS) or min(weights.values()) < 1 or weights["SK"] < weights["TC"]:
        raise ValueError("weights need all six dimensions, each at least 1, and SK >= TC")
    return weights


def weighted_score(scores: dict[str, Column], weights: dict[str, int] = WEIGHTS) -> Column:
    """5 times the weighted sum over its maximum."""
    top = float(sum(valid_weights(weights).values()) * 5)
    return sum((scores[d].cast("double") * float(weights[d]) for d in DIMENSIONS), F.lit(0.0)) / top * 5.0


def overridden(scores: dict[str, Column], overrides: Column) -> dict[str, Column]:
    """Scores with those that a map of overrides names, clipped to 1 to 5. overrides: map<string,int>, null for none."""
    given = {d: F.try_element_at(overrides, F.lit(d)) for d in scores}
    return {d: F.when(given[d].isNull(), c).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), given[d]))) for d, c in scores.items()}


def governance_tier(score: Column, gated: Column, tau1: float = 3.2, tau2: float = 4.0) -> Column:
    plain = F.when(score <= tau1, "pure_slm").when(score <= tau2, "hybrid").otherwise("llm_only")
    return F.when(gated == "disqualified", "disqualified").when((gated == "hybrid") & (plain == "pure_slm"), "hybrid").otherwise(plain)


def route_limit(gated: Column, tau_risk: Column, tau_cap: Column) -> Column:
    return F.when(gated == "disqualified", -1.0).otherwise(F.least(tau_risk, tau_cap))


def enforce(final: Column, proposed: Column, escalate: Column) -> Column:
    """Route that a tier allows; unknown proposals count as BASELINE."""
    p = F.upper(F.trim(F.coalesce(proposed, F.lit(""))))
    p = F.when(p.isin("SLM", "HYBRID_ABSTAIN", "BASELINE"), p).otherwise("BASELINE")
    pure = F.when((p == "SLM") | ~escalate, "SLM").otherwise(p)
    return F.when(final.isin("disqualified", "llm_only"), "BASELINE").when(final == "hybrid", p).otherwise(pure)


def deploy(final: Column, proposed: Column) -> Column:
    return F.when(final == "pure_slm", "SLM").when(final.isin("llm_only", "disqualified"), "LLM").otherwise(proposed)


def policy_override(final: Column, requested: Column, reason: Column) -> dict[str, Column]:
    """A policy may only make a tier stricter: tier, policy_tier_requested, policy_tier_applied, gate_reason.

    Without a request nothing changes; an unknown request is an error, an unknown tier counts as pure_slm.
    """
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in TIERS]), c)
    asked = F.trim(requested)
    asked = F.when(asked.isNull() | asked.isin(*TIERS), asked).otherwise(F.raise_error(F.concat(F.lit("invalid policy tier: "), asked)).cast("string"))
    now = F.when(final.isin(*TIERS), final).otherwise("pure_slm")
    applied = F.when(asked.isNotNull(), F.when(rank(asked) >= rank(now), asked).otherwise(now))
    changed = F.coalesce(applied != now, F.lit(False))
    told = F.concat(F.coalesce(reason, F.lit("Gate pass")), F.lit(" | Policy Tier Override: "), now, F.lit(" -> "), applied)
    return {"tier": F.when(changed, applied).otherwise(final), "policy_tier_requested": asked, "policy_tier_applied": applied, "gate_reason": F.when(changed, told).otherwise(reason)}


def decide(df: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """Scores, gate, weighted score, tier, route limit and reason of each row.

    df: task, prompt, expected_format, data_classification, business_critical, requires_human_approval, contains_pii, contains_phi, target_p99_ms, real_time, qps,
    daily_requests, bursty, overrides (map<string,int>), tau_cap, tau_risk, tau1, tau2. Two projections, so no score is computed twice.
    """
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    scores = {
        "TC": task_complexity(F.col("task"), F.col("prompt")),
        "OS": output_structure(F.col("prompt"), F.col("expected_format")),
        "SK": stakes(F.col("task"), F.col("prompt"), flag("business_critical"), flag("requires_human_approval")),
        "DS": data_sensitivity(F.col("prompt"), F.col("data_classification"), flag("contains_pii"), flag("contains_phi")),
        "LT": latency_tolerance(F.col("target_p99_ms"), flag("real_time")),
        "VL": volume_load(F.col("qps"), F.col("daily_requests"), flag("bursty")),
    }
    out = df.withColumns(overridden(scores, F.col("overrides")))
    out = out.withColumns({"gate": gate(F.col("TC"), F.col("SK")), "s3_score": weighted_score({d: F.col(d) for d in DIMENSIONS}, weights)})
    formula = F.when(F.col("s3_score") <= F.col("tau1"), "pure_slm").when(F.col("s3_score") <= F.col("tau2"), "hybrid").otherwise("llm_only")
    final = F.when(F.col("gate") == "disqualified", "disqualified").when((F.col("gate") == "hybrid") & (formula == "pure_slm"), "hybrid").otherwise(formula)
    return out.withColumns({"formula_tier": formula, "tier": final, "tau_route": route_limit(F.col("gate"), F.col("tau_risk"), F.col("tau_cap"))})
