"""Relational surface over the star-schema and event tables: aggregates, grouping sets, joins, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as rel
from .registry import query

MONEY = "sum(l_extendedprice * (1 - l_discount))"


def money():
    return F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(sql=f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round({MONEY}, 2) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-01' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t):
    x = t.lineitem.where(F.col("l_shipdate") <= F.lit("2000-06-01").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(money(), 2).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query(sql=f"""SELECT n_name, round({MONEY}, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def revenue_by_nation(t):
    n = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return x.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(money(), 2).alias("revenue"))


@query(sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::BIGINT * 2 + grouping(o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query(sql="SELECT c_mktsegment, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def rollup_balance(t):
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(sql="SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())")
def grouping_sets(t):
    return t.part.groupingSets([["p_brand", "p_type"], ["p_brand"], []], "p_brand", "p_type").agg(F.count("*").alias("n"))


@query(sql="SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS qty_f, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS qty_o FROM lineitem GROUP BY l_returnflag")
def pivot_quantity(t):
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", F.col("F").alias("qty_f"), F.col("O").alias("qty_o"))


@query(sql="SELECT s_suppkey, k, v FROM (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nation FROM supplier) UNPIVOT (v FOR k IN (s_acctbal, s_nation))")
def unpivot_supplier(t):
    s = t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nation"))
    return s.unpivot("s_suppkey", ["s_acctbal", "s_nation"], "k", "v")


@query(sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(sql="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_nations(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query(sql="SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def except_parts(t):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_discount > 0.05").select("l_partkey"))


@query(sql="SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query(sql="""SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
 round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, lag(o_orderkey) OVER w AS prev, first_value(o_orderkey) OVER w AS first_key
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    lng = lambda c: c.cast("long")
    return t.orders.select(
        "o_custkey", "o_orderkey", lng(F.row_number().over(w)).alias("rn"), lng(F.rank().over(p)).alias("rk"), lng(F.dense_rank().over(p)).alias("dr"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.lag("o_orderkey").over(w).alias("prev"), F.first("o_orderkey").over(w).alias("first_key"),
    )


@query(sql="SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def topk_per_group(t):
    return rel.top_per_key(t.customer, ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], 5).select("c_mktsegment", "c_custkey", "c_acctbal")


@query(sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query(sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def keyset_page(t):
    return t.orders.where("o_orderkey > 500").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25)


@query(sql="SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY o_orderstatus")
def percentiles(t):
    return t.orders.groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("p50"), F.percentile("o_totalprice", F.lit(0.95)).alias("p95"))


@query()
def approximate_aggregates(t):
    """Sketches: distinct counts and quantiles within stated errors."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", F.lit(0.5), F.lit(10000)).alias("median"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"))


@query(sql="SELECT e.event_id, p.event_id AS view_id, p.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(t):
    """Each purchase with the user's latest view at or before it."""
    views = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return rel.asof_join(buys, views, "user_id", "ts", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query(sql="SELECT p_partkey, b.lo FROM part JOIN (SELECT i * 150.0 + 900 AS lo, i * 150.0 + 1100 AS hi FROM range(5) r(i)) b ON p_retailprice >= b.lo AND p_retailprice < b.hi")
def range_join(t):
    bands = t.spark.range(5).select((F.col("id") * 150.0 + 900).alias("lo"), (F.col("id") * 150.0 + 1100).alias("hi"))
    return rel.range_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


@query(sql="SELECT e.event_type AS a, f.event_type AS b, count(*) AS n FROM events e JOIN events f ON e.user_id = f.user_id AND e.event_id < f.event_id AND f.ts > e.ts AND f.ts < e.ts + INTERVAL 10 MINUTE GROUP BY ALL")
def interval_self_join(t):
    """Pairs of one user's events within ten minutes, by ten-minute buckets."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600)
    e = t.events.select("user_id", "event_id", "ts", F.col("event_type").alias("a"), minute.alias("m"))
    f = t.events.select("user_id", F.col("event_id").alias("id2"), F.col("ts").alias("ts2"), F.col("event_type").alias("b"), F.explode(F.array(minute, minute - 1)).alias("m"))
    x = e.join(f, ["user_id", "m"]).where((F.col("event_id") < F.col("id2")) & (F.col("ts2") > F.col("ts")) & (F.col("ts2") < F.col("ts") + F.expr("interval 10 minutes")))
    return x.groupBy("a", "b").agg(F.count("*").alias("n"))


@query(sql="SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
def lateral_scalar(t):
    return t.customer.join(t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most")), "c_custkey", "left").select("c_custkey", "most")


@query(sql="WITH RECURSIVE r(k, d) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT k * 2 + 1, d + 1 FROM r WHERE d < 8) SELECT k, d, p_name FROM r JOIN part ON p_partkey = k")
def recursive_chain(t):
    """A recursive query: keys reached by k -> 2k + 1."""
    chain = t.spark.sql("WITH RECURSIVE r(k, d) AS (SELECT 0L, 0L UNION ALL SELECT k * 2 + 1, d + 1 FROM r WHERE d < 8) SELECT k, d FROM r")
    return chain.join(t.part.select(F.col("p_partkey").alias("k"), "p_name"), "k")


@query(sql="SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count_if(l_discount > 0.05) AS discounted FROM lineitem")
def distinct_counts(t):
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query(sql="SELECT count(*) AS n FROM (SELECT * FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.03 AND 0.07 AND l_shipdate >= TIMESTAMP '1995-01-01')")
def pushed_filters(t):
    x = t.lineitem.where((F.col("l_quantity") > 45) & F.col("l_discount").between(0.03, 0.07) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return x.agg(F.count("*").alias("n"))


@query()
def dip_boundaries(t):
    """Orders of a customer whose price dips under mean - deviation, three apart or more."""
    return rel.dip_boundaries(t.orders, "o_custkey", "o_orderkey", "o_totalprice")
