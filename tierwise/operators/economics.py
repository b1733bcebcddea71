"""Costs, expected values and Pareto fronts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in dollars.
SUCCESS_VALUE, FAILURE_LOSS, LATENCY_COST_PER_SEC, LOCAL_COST_PER_SEC, BASELINE_COST = 0.05, 0.2, 0.0001, 0.0002, 0.0035


def direct_cost(is_baseline: Column, latency: Column) -> Column:
    return F.when(is_baseline, BASELINE_COST).otherwise(latency * LOCAL_COST_PER_SEC)


def expected_value(cap: Column, risk: Column, latency: Column, cost: Column) -> Column:
    return SUCCESS_VALUE * cap - FAILURE_LOSS * risk - LATENCY_COST_PER_SEC * latency - cost


def expected_loss(risk: Column, latency: Column, cost: Column) -> Column:
    return FAILURE_LOSS * risk + LATENCY_COST_PER_SEC * latency + cost


def pareto(df: DataFrame, by: list[str], cap: str, risk: str, latency: str, cost: str) -> DataFrame:
    """Rows that no other of their group dominates: as good in all four, better in one. Groups hold a few models."""
    a, b = df.alias("a"), df.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    good = [F.col(f"b.{cap}") >= F.col(f"a.{cap}"), *[F.col(f"b.{c}") <= F.col(f"a.{c}") for c in (risk, latency, cost)]]
    strict = (F.col(f"b.{cap}") > F.col(f"a.{cap}")) | (F.col(f"b.{risk}") < F.col(f"a.{risk}")) | (F.col(f"b.{latency}") < F.col(f"a.{latency}")) | (F.col(f"b.{cost}") < F.col(f"a.{cost}"))
    on = strict
    for c in [*same, *good]:
        on = on & c
    return a.join(b, on, "left_anti")
