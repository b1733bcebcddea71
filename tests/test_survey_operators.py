"""Operators of the survey that had no code: constraints in texts (F10), stricter-only policy (G14), frozen thresholds (C27)."""

import re

import pytest
from pyspark.sql import functions as F

from tierwise.functions import text as X
from tierwise.operators import governance as G
from tierwise.operators import routing as T
from tierwise.queries import queries


def test_constraints_of_texts_where_lists_are_empty(spark):
    d = spark.createDataFrame([("You MUST cite; must not exceed 5 words, don't", None), ("must", ["a", "b"]), ("éonly only; format json list", []), (None, None), ("", [])], "text string, rules array<string>")
    assert [r[0] for r in d.select(X.constraint_count(F.col("text"), F.col("rules"), F.col("rules"))).collect()] == [5.0, 4.0, 4.0, 0.0, 0.0]
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: sum(len(re.findall(p, f" {r['text'].lower()} ")) for p in X.CONSTRAINT_PATTERNS) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(X.CONSTRAINT_PATTERNS) == 15 and any(want.values())
    assert dict(tuple(r) for r in queries()["constraint_count"](spark, sf).collect()) == want


def test_policy_only_makes_stricter(spark):
    d = spark.createDataFrame([(0, "hybrid", "llm_only ", None), (1, "hybrid", "pure_slm", "r"), (2, "odd", "hybrid", "r"), (3, "odd", None, "r")], "i int, t string, p string, r string")
    got = [tuple(r)[1:] for r in d.select("i", *[c.alias(k) for k, c in G.policy_override(F.col("t"), F.col("p"), F.col("r")).items()]).orderBy("i").collect()]
    assert got[0] == ("llm_only", "llm_only", "llm_only", "Gate pass | Policy Tier Override: hybrid -> llm_only")
    assert got[1:] == [("hybrid", "pure_slm", "hybrid", "r"), ("hybrid", "hybrid", "hybrid", "r | Policy Tier Override: pure_slm -> hybrid"), ("odd", None, None, "r")]
    with pytest.raises(Exception, match="invalid policy tier"):
        d.select(G.policy_override(F.col("t"), F.lit("nope"), F.col("r"))["tier"]).collect()


def test_frozen_thresholds_by_preference(spark):
    families = spark.createDataFrame([(x,) for x in "abcd"], "task string")
    v = spark.createDataFrame([("a", "0.2", "strict_feasible_max", "True"), ("a", "0.4", "strict_feasible_max", "true"), ("a", "0.9", "fallback", "true"), ("b", "0.9", "strict_feasible_max", "false"), (" c", "3", "x", "true"), ("c", "", "x", "true")], "task string, tau string, source string, passed string")
    t = spark.createDataFrame([("a", 0.8), ("b", 0.1), ("b", 0.3), ("b", None)], "task string, tau double")
    assert dict(tuple(r) for r in T.frozen_taus(families, v, t).collect()) == pytest.approx({"a": 0.3, "b": 0.2, "c": 1.0, "d": 0.5})
