"""Generic relational queries over the star tables and the event stream: joins, aggregates, windows at table scale."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from postmill.plans.registry import query
from postmill.runtime import table


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::double AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def events_hourly(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_id, user_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events")
def event_gaps(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.date_trunc("second", before))
    return table(spark, sf_dir, "events").select("event_id", "user_id", gap.alias("gap"))
