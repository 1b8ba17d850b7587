"""Relational queries over the star schema: joins, windows, set operations, grouping sets, streams' windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.plans.registry import query, read
from vectrill.streaming.windows import sessions, tumbling


def t(spark, sf_dir, *names):
    return [read(spark, sf_dir, n) for n in names]


def r2(c, n=2):
    return F.round(c, n) + F.lit(0.0)


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    (lines,) = t(spark, sf_dir, "lineitem")
    d = lines.filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        r2(F.sum("l_quantity")).alias("sum_qty"), r2(F.sum("l_extendedprice")).alias("sum_base"), r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("sum_disc"), r2(F.avg("l_quantity"), 4).alias("avg_qty"), r2(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("top_orders", "SELECT o_orderkey, c_mktsegment, round(revenue, 2) AS revenue FROM (SELECT o_orderkey, c_mktsegment, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL) ORDER BY revenue DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    c, o, x = t(spark, sf_dir, "customer", "orders", "lineitem")
    j = c.join(o.filter("o_orderdate < TIMESTAMP '1997-01-01'"), F.col("c_custkey") == F.col("o_custkey")).join(x, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy("o_orderkey", "c_mktsegment").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "o_orderkey").limit(10).withColumn("revenue", r2(F.col("revenue")))


@query("revenue_by_nation", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def revenue_by_nation(spark, sf_dir):
    """nation and region have a fixed size (25 and 5 rows), so they are broadcast."""
    o, c, n, r = t(spark, sf_dir, "orders", "customer", "nation", "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), r2(F.sum("o_totalprice")).alias("total"))


@query("discount_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
def discount_revenue(spark, sf_dir):
    (x,) = t(spark, sf_dir, "lineitem")
    return x.filter("l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24").agg(r2(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))


@query("customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("customers_with_urgent_orders", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY 1")
def customers_with_urgent_orders(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_orderpriority LIKE '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("rollup_quantities", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantities(spark, sf_dir):
    (x,) = t(spark, sf_dir, "lineitem")
    return x.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r2(F.sum("l_quantity")).alias("qty"))


@query("cube_segments", "SELECT c_mktsegment, c_nationkey % 3 AS zone, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, zone)")
def cube_segments(spark, sf_dir):
    (c,) = t(spark, sf_dir, "customer")
    return c.withColumn("zone", F.col("c_nationkey") % 3).cube("c_mktsegment", "zone").agg(F.count("*").alias("n"))


@query("ranked_orders", "SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rn, CAST(rk AS INTEGER) AS rk, round(running, 2) AS running, round(o_totalprice - coalesce(prev, 0), 2) AS change FROM (SELECT *, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running, lag(o_totalprice) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def ranked_orders(spark, sf_dir):
    (o,) = t(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rk"), F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.lag("o_totalprice").over(w).alias("p"), "o_totalprice")
    return d.select("o_custkey", "o_orderkey", "rn", "rk", r2(F.col("s")).alias("running"), r2(F.col("o_totalprice") - F.coalesce("p", F.lit(0.0))).alias("change"))


@query("set_operations", "SELECT kind, count(*) AS n FROM ((SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))) GROUP BY kind")
def set_operations(spark, sf_dir):
    c, s, n = t(spark, sf_dir, "customer", "supplier", "nation")
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": n.select(F.col("n_nationkey").alias("k")).subtract(s.filter("s_acctbal > 5000").select("s_nationkey"))}
    out = None
    for kind, d in parts.items():
        x = d.select(F.lit(kind).alias("kind"), "k")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("as_of_purchases", "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND c.ts <= p.ts")
def as_of_purchases(spark, sf_dir):
    """Each purchase with the user's last click before it: one sort a user over both kinds, no range join."""
    (e,) = t(spark, sf_dir, "events")
    d = e.filter("event_type IN ('purchase', 'click')")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return d.filter("event_type = 'purchase'").select("event_id", "click_id")


@query("pivot_events", "SELECT user_id % 10 AS bucket, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def pivot_events(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    p = e.groupBy((F.col("user_id") % 10).alias("bucket")).pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"), F.count_distinct("user_id").alias("users"))


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    return tumbling(e, "ts", "value", keys=("event_type",)).select("window_start", "event_type", "n", r2(F.col("total"), 4).alias("total"), r2(F.col("mean"), 4).alias("mean"))


@query("user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    return sessions(e, "ts", "user_id", "6 hours")
