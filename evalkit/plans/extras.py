"""Beyond parity: grouping sets, rankings, frames and joins that the engine gives for free, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .fixture import table


def _asof(s, d):
    """For each order the customer's previous one: a sort and a lag, no range join."""
    o = table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


def _rollup(s, d):
    li = table(s, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _ranks(s, d):
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("total"), "n_nationkey")
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    per = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return n.join(per, n.n_nationkey == per.c_nationkey).select("n_name", "total", F.row_number().over(w).alias("place"), F.ntile(2).over(w).alias("half"))


def _sessions(s, d):
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    marked = e.withColumn("new", F.when(gap.isNull() | (gap > 1800 * 1_000_000), 1).otherwise(0))
    return marked.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "ext_rollup": (_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "ext_ranks": (
        _ranks,
        """WITH per AS (SELECT c_nationkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT n_name, total, row_number() OVER w AS place, ntile(2) OVER w AS half FROM nation JOIN per ON n_nationkey = c_nationkey WINDOW w AS (PARTITION BY n_regionkey ORDER BY total DESC, n_nationkey)""",
    ),
    "ext_previous_order": (_asof, "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders"),
    "ext_sessions": (
        _sessions,
        """WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
        SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY user_id""",
    ),
    "ext_intersect": (
        lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))),
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    ),
}
