"""Queries of governance and economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economics as E
from ..operators import governance as G
from ..operators.routing import FAMILIES
from .tables import t

CONSTRAINTS, FORMATS, STAKES, SENSITIVE = G.CONSTRAINT_TERMS, G.FORMAT_TERMS, G.STAKES_TERMS, G.SENSITIVE_TERMS


def scores(s, d):
    x, k = t(s, d, "documents"), F.col("doc_id")
    task = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (k % 8 + 1).cast("int"))
    level = F.element_at(F.array(*[F.lit(v) for v in ("public", "internal", "confidential", "restricted")]), (k % 4 + 1).cast("int"))
    text, yes = F.col("text"), lambda n: k % n == 0
    return x.select(
        "doc_id",
        G.task_complexity(task, text).alias("TC"),
        G.output_structure(text, F.lit("json")).alias("OS"),
        G.stakes(task, text, yes(3), yes(5)).alias("SK"),
        G.data_sensitivity(text, level, yes(7), yes(11)).alias("DS"),
        G.latency_tolerance(F.when(k % 6 != 0, (k % 6) * 900), yes(2)).alias("LT"),
        G.volume_load((k % 700).cast("double"), F.lit(None).cast("long"), yes(9)).alias("VL"),
    )


def decisions(s, d):
    x = scores(s, d).withColumns({"gate": G.gate(F.col("TC"), F.col("SK")), "s3": G.weighted_score({c: F.col(c) for c in G.DIMENSIONS})})
    final = G.governance_tier(F.col("s3"), F.col("gate"))
    x = x.withColumn("tier", final)
    route = G.enforce(F.col("tier"), F.element_at(F.array(F.lit("slm"), F.lit("HYBRID_ABSTAIN"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("doc_id") % 2 == 0)
    limit = G.route_limit(F.col("gate"), (F.col("doc_id") % 10) / 10, F.lit(0.5))
    return x.select("doc_id", "gate", F.round("s3", 6).alias("s3"), "tier", route.alias("route"), limit.alias("tau_route"))


def _count(pattern, text="text"):
    return f"len(regexp_extract_all({text}, '(?i){pattern}'))"


_cue = lambda cs, e="text": " + ".join(f"CAST(contains(lower({e}), '{c}') AS INT)" for c in cs)
_five = lambda x: f"CAST(least(greatest(round_even({x}, 0), 1), 5) AS INT)"
_TASK = "[" + ", ".join(f"'{f}'" for f in FAMILIES) + "][doc_id % 8 + 1]"
_SCORES = f"""sc AS (SELECT doc_id,
 {_five("1.0::DOUBLE + least(2.0::DOUBLE, len(regexp_extract_all(trim(text), '[\\p{L}\\p{N}_\\p{Mn}]+')) / 120.0::DOUBLE) + least(1.0::DOUBLE, (" + _cue(CONSTRAINTS) + ") / 4.0::DOUBLE) + least(1.0::DOUBLE, " + _count(chr(92) + "b(algorithm|proof|optimi[sz]e|derive|complexity|multi-step)" + chr(92) + "b") + " / 3.0::DOUBLE) + least(1.0::DOUBLE, " + _count(r"[\=\+\-\*/\^%<>]") + " / 20.0::DOUBLE) + CASE WHEN task IN ('maths', 'code_generation', 'retrieval_grounded') THEN 0.4::DOUBLE WHEN task IN ('classification', 'summarization') THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END")} AS "TC",
 {_five("1.0::DOUBLE + least(2.2::DOUBLE, (" + _cue(FORMATS, "text || ' json'") + ") / 2.0::DOUBLE) + least(1.0::DOUBLE, " + _count(r"[\{\}\[\],:|]", "(text || ' json')") + " / 40.0::DOUBLE) + least(1.0::DOUBLE, " + _count(chr(92) + "b(first|second|third|step|ordered|sorted)" + chr(92) + "b") + " / 3.0::DOUBLE)")} AS "OS",
 {_five("1.0::DOUBLE + least(2.0::DOUBLE, (" + _cue(STAKES) + ") / 2.0::DOUBLE) + CASE WHEN task IN ('maths', 'code_generation') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN doc_id % 3 = 0 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN doc_id % 5 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END")} AS "SK",
 {_five("[1.0::DOUBLE, 2.0::DOUBLE, 3.2::DOUBLE, 4.2::DOUBLE][doc_id % 4 + 1] + least(1.0::DOUBLE, (" + _cue(SENSITIVE) + ") / 2.0::DOUBLE) + CASE WHEN doc_id % 7 = 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN doc_id % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")} AS "DS",
 CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END WHEN doc_id % 6 * 900 <= 300 THEN 5 WHEN doc_id % 6 * 900 <= 800 THEN 4 WHEN doc_id % 6 * 900 <= 2000 THEN 3 WHEN doc_id % 6 * 900 <= 5000 THEN 2 ELSE 1 END AS "LT",
 {_five("CASE WHEN doc_id % 700 >= 500 THEN 5.0::DOUBLE WHEN doc_id % 700 >= 100 THEN 4.0::DOUBLE WHEN doc_id % 700 >= 20 THEN 3.0::DOUBLE WHEN doc_id % 700 >= 5 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN doc_id % 9 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END")} AS "VL"
 FROM (SELECT *, {_TASK} AS task FROM documents))"""


def economics(s, d):
    e = t(s, d, "events").withColumn("m", F.concat("event_type", F.lit("_"), F.pmod("user_id", F.lit(3)).cast("string")))
    m = e.groupBy("event_type", "m").agg(F.avg(F.when(F.col("value") < 40, 1.0).otherwise(0.0)).alias("cap"), F.avg(F.when(F.col("value") > 80, 1.0).otherwise(0.0)).alias("risk"), (F.avg("value") / 50).alias("latency"))
    m = m.withColumn("cost", E.direct_cost(F.col("m") == "view_0", F.col("latency")))
    return m.withColumns({"ev": E.expected_value(F.col("cap"), F.col("risk"), F.col("latency"), F.col("cost")), "loss": E.expected_loss(F.col("risk"), F.col("latency"), F.col("cost"))})


_ECON = "m AS (SELECT event_type, event_type || '_' || (user_id % 3) AS m, avg(CASE WHEN value < 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cap, avg(CASE WHEN value > 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS risk, avg(value) / 50 AS latency FROM events GROUP BY 1, 2), k AS (SELECT *, CASE WHEN m = 'view_0' THEN 0.0035::DOUBLE ELSE latency * 0.0002::DOUBLE END AS cost FROM m)"


QUERIES = {
    "governance_scores": (scores, f"WITH {_SCORES} SELECT * FROM sc"),
    "governance_decisions": (
        decisions,
        f"""WITH {_SCORES}, g AS (SELECT *, CASE WHEN "SK" = 5 OR ("TC" = 5 AND "SK" >= 4) THEN 'disqualified' WHEN "SK" >= 4 THEN 'hybrid' ELSE 'none' END AS gate, (3 * "TC" + 2 * "OS" + 4 * "SK" + 2 * "DS" + 3 * "LT" + "VL") / 75.0::DOUBLE * 5 AS s3 FROM sc),
        t AS (SELECT *, CASE WHEN gate = 'disqualified' THEN gate WHEN s3 <= 3.2::DOUBLE THEN CASE WHEN gate = 'hybrid' THEN 'hybrid' ELSE 'pure_slm' END WHEN s3 <= 4.0 THEN 'hybrid' ELSE 'llm_only' END AS tier, ['SLM', 'HYBRID_ABSTAIN', 'BASELINE'][doc_id % 3 + 1] AS p FROM g)
        SELECT doc_id, gate, round(s3, 6) AS s3, tier, CASE WHEN tier IN ('disqualified', 'llm_only') THEN 'BASELINE' WHEN tier = 'hybrid' THEN p WHEN p = 'SLM' OR doc_id % 2 = 1 THEN 'SLM' ELSE p END AS route, CASE WHEN gate = 'disqualified' THEN -1.0::DOUBLE ELSE least((doc_id % 10) / 10.0::DOUBLE, 0.5::DOUBLE) END AS tau_route FROM t""",
    ),
    "score_overrides": (
        lambda s, d: scores(s, d).select("doc_id", *[c.alias(k) for k, c in G.overridden({c: F.col(c) for c in G.DIMENSIONS}, F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("SK"), F.lit(9), F.lit("VL"), (F.col("doc_id") % 4).cast("int")))).items()]),
        f'''WITH {_SCORES} SELECT doc_id, "TC", "OS", CASE WHEN doc_id % 3 = 0 THEN 5 ELSE "SK" END AS "SK", "DS", "LT", CASE WHEN doc_id % 3 = 0 THEN CAST(greatest(1, doc_id % 4) AS INT) ELSE "VL" END AS "VL" FROM sc''',
    ),
    "model_economics": (lambda s, d: economics(s, d).select("m", *[F.round(c, 8).alias(c) for c in ("cost", "ev", "loss")]), f"WITH {_ECON} SELECT m, round(cost, 8) AS cost, round(0.05::DOUBLE * cap - 0.2::DOUBLE * risk - 0.0001::DOUBLE * latency - cost, 8) AS ev, round(0.2::DOUBLE * risk + 0.0001::DOUBLE * latency + cost, 8) AS loss FROM k"),
    "pareto_front": (lambda s, d: E.pareto(economics(s, d), ["event_type"], "cap", "risk", "latency", "cost").select("m"), f"WITH {_ECON} SELECT m FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.event_type = a.event_type AND b.cap >= a.cap AND b.risk <= a.risk AND b.latency <= a.latency AND b.cost <= a.cost AND (b.cap > a.cap OR b.risk < a.risk OR b.latency < a.latency OR b.cost < a.cost))"),
}
