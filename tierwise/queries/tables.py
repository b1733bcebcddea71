"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nullsafe as N
from ..operators import relational as R
from ..operators.carried import ewm_mean
from ..operators.ordered import percentiles as exact
from ..streaming.routing import windowed_ratio


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _customers(s, d):
    c = t(s, d, "customer")
    return c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")))


_CUSTOMERS = "(SELECT * REPLACE (CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS c_nationkey) FROM customer)"


def merge_nullsafe(s, d):
    n = t(s, d, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("c_nationkey"), F.col("n_name").alias("c_name"))
    return R.merge(_customers(s, d).select("c_custkey", "c_nationkey", "c_name"), n, ["c_nationkey"])


def group_agg(s, d):
    o = t(s, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    g = R.group_agg(o, "o_orderpriority", mean_price=("o_totalprice", "mean"), sum_price=("o_totalprice", "sum"))
    return g.select("o_orderpriority", F.round("mean_price", 4).alias("mean_price"), F.round("sum_price", 2).alias("sum_price"))


def rolling(s, d):
    e = t(s, d, "events").withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    x = R.rolling_mean(F.col("value"), ["user_id"], ["ts", "event_id"], 4, 2)
    return e.select("event_id", F.round(x, 6).alias("rolling"))


def centred(s, d):
    x = R.centred_mean(F.col("value"), ["user_id"], ["ts", "event_id"], 5)
    return t(s, d, "events").select("event_id", F.round(x, 6).alias("centred"))


def ewm(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "ts", "value")
    return ewm_mean(e, ["user_id"], ["ts", "event_id"], "value", 0.3).select("event_id", F.round("ewm", 6).alias("ewm"))


def bins_qcut(s, d):
    return R.qcut(t(s, d, "events").select("event_id", "event_type", "value"), "value", 5, ["event_type"]).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


def bins_cut(s, d):
    return R.cut(t(s, d, "events").select("event_id", "event_type", "value"), "value", 8, ["event_type"]).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


def percentiles(s, d):
    b = R.nearest_rank_bounds(t(s, d, "events"), ["event_type"], "value")
    p = exact(t(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})
    return b.join(p, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("p05", "p95", "p50", "p99")])


def scalar_ops(s, d):
    p = t(s, d, "part")
    odd = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    return p.select("p_partkey", N.safe_div(F.col("p_retailprice"), F.col("p_size") % 4).alias("q"), N.clip(odd, 10, 20).alias("clipped"), N.equal(odd, F.lit(None).cast("int")).alias("is_none"), N.both(odd > 5, odd < 30).alias("inside"), N.either(odd > 40, odd < 3).alias("outside"), N.one_to_five(F.col("p_size") / 10).alias("five"), N.notna(odd).alias("there"))


QUERIES = {
    "merge_nullsafe": (merge_nullsafe, f"SELECT a.c_custkey, a.c_nationkey, a.c_name, n.n_name AS c_name_y FROM {_CUSTOMERS} a JOIN (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS k, n_name FROM nation) n ON a.c_nationkey IS NOT DISTINCT FROM n.k"),
    "group_agg": (group_agg, "SELECT o_orderpriority, round(avg(p), 4) AS mean_price, round(sum(p), 2) AS sum_price FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS p FROM orders) GROUP BY 1"),
    "drop_duplicates_first": (lambda s, d: R.drop_duplicates(t(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1"),
    "latest_by_key": (lambda s, d: R.latest(t(s, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), "user_id", "ts", "event_id").select("user_id", "event_id"), "SELECT user_id, arg_max(event_id, (strftime(ts, '%Y-%m-%d'), event_id)) AS event_id FROM events GROUP BY 1"),
    "unique_first_seen": (lambda s, d: R.unique(t(s, d, "events"), "event_type", "event_id"), "SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1"),
    "concat_ragged": (lambda s, d: R.concat(t(s, d, "region").select("r_regionkey", "r_name"), t(s, d, "nation").select(F.col("n_name").alias("r_name"), "n_nationkey")), "SELECT r_regionkey, r_name, NULL::INT AS n_nationkey FROM region UNION ALL SELECT NULL, n_name, n_nationkey FROM nation"),
    "project_missing_rename": (lambda s, d: R.rename(R.select(t(s, d, "region"), ["r_name", "nothing"]), {"r_name": "name", "absent": "x"}), "SELECT r_name AS name, CAST(NULL AS VARCHAR) AS nothing FROM region"),
    "filter_truthy": (lambda s, d: R.where(_customers(s, d), F.col("c_nationkey") > 10).select("c_custkey"), f"SELECT c_custkey FROM {_CUSTOMERS} WHERE c_nationkey > 10"),
    "dropna_subset": (lambda s, d: R.drop_missing(_customers(s, d), ["c_nationkey"]).select("c_custkey", "c_nationkey"), f"SELECT c_custkey, c_nationkey FROM {_CUSTOMERS} WHERE c_nationkey IS NOT NULL"),
    "rolling_mean": (rolling, "WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events) SELECT event_id, round(CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END, 6) AS rolling FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    "rolling_centred": (centred, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, round(CASE WHEN rn <= 2 THEN (SELECT avg(value) FROM r q WHERE q.user_id = r.user_id AND q.rn <= 5) ELSE avg(value) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS centred FROM r"),
    "ewm_mean": (ewm, "WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), e AS (SELECT event_id, user_id, rn, value AS y FROM r WHERE rn = 1 UNION ALL SELECT r.event_id, r.user_id, r.rn, 0.3::DOUBLE * r.value + 0.7::DOUBLE * e.y FROM e JOIN r ON r.user_id = e.user_id AND r.rn = e.rn + 1) SELECT event_id, round(y, 6) AS ewm FROM e"),
    "qcut_bins": (bins_qcut, "WITH q AS (SELECT event_type, quantile_cont(value, [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS c FROM events GROUP BY 1) SELECT event_type, CAST(len(list_filter(c, lambda x: x < value)) AS INT) AS bin, count(*) AS n FROM events JOIN q USING (event_type) GROUP BY 1, 2"),
    "cut_bins": (bins_cut, "WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 8.0::DOUBLE)), 7) AS INT) AS bin, count(*) AS n FROM events JOIN b USING (event_type) GROUP BY 1, 2"),
    "percentile_bounds": (percentiles, "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(max(value) FILTER (i = least(floor(0.05::DOUBLE * n), n - 1)), 6) AS p05, round(max(value) FILTER (i = least(floor(0.95::DOUBLE * n), n - 1)), 6) AS p95, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(value, 0.99::DOUBLE), 6) AS p99 FROM r GROUP BY 1"),
    "top_per_group": (lambda s, d: R.top_per_group(t(s, d, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), "o_orderkey"], 5).select("o_orderpriority", "o_orderkey"), "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5"),
    "common_ids": (lambda s, d: R.common_ids(t(s, d, "events").withColumn("g", F.pmod("user_id", F.lit(3))), "g", "event_type", "user_id"), "SELECT g, user_id FROM (SELECT user_id % 3 AS g, user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2) JOIN (SELECT user_id % 3 AS g, count(DISTINCT event_type) AS m FROM events GROUP BY 1) USING (g) WHERE n = m AND m >= 2"),
    "semi_join": (lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "id_intersection": (lambda s, d: t(s, d, "events").where("event_type = 'view'").select("user_id").intersect(t(s, d, "events").where("event_type = 'purchase'").select("user_id")), "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'"),
    "scalar_nullsafe": (scalar_ops, "WITH p AS (SELECT *, CASE WHEN p_size % 3 <> 0 THEN p_size END AS o FROM part) SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 4) END AS q, CASE WHEN o IS NOT NULL THEN least(greatest(o, 10), 20) END AS clipped, o IS NULL AS is_none, coalesce(o > 5, false) AND coalesce(o < 30, false) AS inside, coalesce(o > 40, false) OR coalesce(o < 3, false) AS outside, CAST(least(greatest(round_even(p_size / 10, 0), 1), 5) AS INT) AS five, o IS NOT NULL AS there FROM p"),
    "pivot_by_type": (lambda s, d: t(s, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().na.fill(0), "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1"),
    "marginal_gain": (lambda s, d: t(s, d, "events").select("event_id", F.round(F.expr("value - lag(value) over (partition by user_id order by ts, event_id)"), 6).alias("gain")), "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS gain FROM events"),
    "windowed_ratio": (lambda s, d: windowed_ratio(t(s, d, "events"), 50.0, width="1 day").select("start", "event_type", F.round("rho", 6).alias("rho"), "n"), "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, round(avg(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rho, count(*) AS n FROM events GROUP BY 1, 2"),
}
