"""Named queries over the given tables, one or more per operator, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cells, names
from .functions.projections import PROJECTIONS, grained
from .operators import blocks, bm25, fuse, graph, infer, profile, relate
from .plans import guard, present, route
from .sources.store import written
from .streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sum(c, name: str) -> Column:
    return F.round(F.sum(c), 2).alias(name)


# --- selection, joins, aggregates -------------------------------------------------------------------


@query("SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def flagship_revenue_by_segment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), _sum("o_totalprice", "revenue"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1995-01-01'")
def filter_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderdate >= DATE '1995-01-01'").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest, min(o_totalprice) AS smallest, round(avg(o_totalprice), 4) AS mean FROM orders")
def sum_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.agg(_sum("o_totalprice", "total"), F.max("o_totalprice").alias("largest"), F.min("o_totalprice").alias("smallest"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY spent DESC, c_custkey LIMIT 3")
def top3_customers(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(_sum("o_totalprice", "spent"))
    best = spent.orderBy(F.desc("spent"), "o_custkey").limit(3)
    customer = table(spark, sf_dir, "customer")
    return best.join(customer, best.o_custkey == customer.c_custkey).select("c_custkey", "c_name", "spent")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def monthly_trend(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"), _sum("o_totalprice", "revenue"))


@query("SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def three_table_chain(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    by_customer = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    joined = by_customer.join(c, by_customer.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(F.sum("n").alias("n_orders"), _sum("s", "revenue"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_orders_without_lines(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def semi_join_large_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query(
    """
    WITH o AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderstatus AS f, sum(o_totalprice) AS placed FROM orders GROUP BY ALL),
         l AS (SELECT date_trunc('month', l_shipdate) AS m, l_linestatus AS f, sum(l_extendedprice) AS shipped FROM lineitem GROUP BY ALL)
    SELECT CAST(m AS DATE) AS month, f AS flag, round(placed, 2) AS placed, round(shipped, 2) AS shipped FROM o JOIN l USING (m, f)
    """
)
def composite_key_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderstatus").alias("flag")).agg(_sum("o_totalprice", "placed"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month"), F.col("l_linestatus").alias("flag")).agg(_sum("l_extendedprice", "shipped"))
    return o.join(li, ["month", "flag"])


def _noisy(c: Column, k: Column) -> Column:
    spelled = F.replace(c, F.lit("#"), F.lit("_"))
    return F.when(k % 4 == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(k % 4 == 1, F.lower(c)).when(k % 4 == 2, spelled).otherwise(c)


@query(
    """
    WITH noisy AS (
        SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || c_name || ' ' WHEN 1 THEN lower(c_name) WHEN 2 THEN replace(c_name, '#', '_') ELSE c_name END AS ref, o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey
    ), k AS (SELECT regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g') AS k, c_mktsegment FROM customer)
    SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM noisy JOIN k ON regexp_replace(lower(trim(ref)), '[^a-z0-9]', '', 'g') = k GROUP BY c_mktsegment
    """
)
def noisy_key_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    noisy = o.join(c, o.o_custkey == c.c_custkey).select(_noisy(F.col("c_name"), F.col("o_orderkey")).alias("ref"), "o_totalprice")
    alnum = PROJECTIONS["alnum_only"].of
    clean = c.select(alnum(F.col("c_name")).alias("k"), "c_mktsegment")
    return noisy.join(clean, alnum(F.col("ref")) == F.col("k")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), _sum("o_totalprice", "revenue"))


@query(
    """
    WITH o AS (SELECT date_trunc('week', o_orderdate) AS w, count(*) AS placed FROM orders GROUP BY 1), l AS (SELECT date_trunc('week', l_shipdate) AS w, count(*) AS shipped FROM lineitem GROUP BY 1)
    SELECT CAST(w AS DATE) AS week, placed, shipped FROM o JOIN l USING (w)
    """
)
def granularity_join(spark, sf_dir):
    o = fuse.with_grain(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate", "week").groupBy("o_orderdate__week").agg(F.count(F.lit(1)).alias("placed"))
    li = fuse.with_grain(table(spark, sf_dir, "lineitem").select("l_shipdate"), "l_shipdate", "week").groupBy("l_shipdate__week").agg(F.count(F.lit(1)).alias("shipped"))
    return o.join(li, o.o_orderdate__week == li.l_shipdate__week).select(F.col("o_orderdate__week").cast("date").alias("week"), "placed", "shipped")


@query("SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount)), 4) AS net, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10")
def net_avg_expression(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"), F.round(F.stddev_samp("l_quantity"), 6).alias("spread"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 10").drop("n")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY event_type")
def count_distinct_by_group(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY user_id ORDER BY total DESC NULLS LAST, user_id LIMIT 10")
def superlative_nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(_sum("value", "total")).orderBy(F.desc_nulls_last("total"), "user_id").limit(10)


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def window_top_per_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice", "r")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantities(spark, sf_dir):
    level = (F.grouping("l_returnflag").cast("int") + 2 * F.grouping("l_linestatus").cast("int")).cast("long")
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT c_mktsegment, median(c_acctbal) AS middle, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest FROM customer GROUP BY c_mktsegment")
def ordered_aggregates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nations = F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",")
    return c.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("middle"), nations.alias("nations"), F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.exceptAll(c.join(s, "nation", "left_semi")).distinct().union(c.intersect(s))


@query("SELECT a.event_id, b.o_orderkey FROM events a ASOF JOIN (SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1) b ON a.user_id = b.o_custkey AND a.ts >= b.o_orderdate")
def as_of_join(spark, sf_dir):
    """The last order of the same number at or before each event: one window over both, no range join."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.union(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w)).where("side = 1 AND o_orderkey IS NOT NULL").select("event_id", "o_orderkey")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE event_type ILIKE '%C%' GROUP BY 1")
def json_and_ilike(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").ilike("%c%")).groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def pivot_statuses(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(spark, sf_dir):
    """Orders of every customer, those without any included; orders are summed before they are shuffled to customers."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(spent, c.c_custkey == spent.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query(
    """SELECT CASE WHEN s_suppkey IS NULL THEN 'customer' WHEN c_custkey IS NULL THEN 'supplier' ELSE 'both' END AS side, count(*) AS n
    FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100) GROUP BY 1"""
)
def full_join_sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 100).alias("b"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 100).alias("b"))
    side = F.when(F.col("s_suppkey").isNull(), "customer").when(F.col("c_custkey").isNull(), "supplier").otherwise("both")
    return c.join(s, ["k", "b"], "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, count(s_suppkey) AS n_suppliers FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def right_join_regions(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    joined = n.join(r, n.n_regionkey == r.r_regionkey, "right").join(s, s.s_nationkey == n.n_nationkey, "left")
    return joined.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("SELECT r_name, c_mktsegment, count(*) FILTER (WHERE n_regionkey = r_regionkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN (SELECT c_mktsegment AS m, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON m = c_mktsegment AND n_regionkey = r_regionkey GROUP BY 1, 2")
def cross_join_grid(spark, sf_dir):
    """Every region with every segment, also where it has no customer; the grid is as large as two short lists."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    counts = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    grid = table(spark, sf_dir, "region").crossJoin(c.select("c_mktsegment").distinct())
    met = grid.join(counts.withColumnRenamed("n_regionkey", "r_regionkey"), ["r_regionkey", "c_mktsegment"], "left")
    return met.select("r_name", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """WITH b AS (SELECT p_size, min(p_retailprice) * 50 AS lo, max(p_retailprice) * 60 AS hi FROM part GROUP BY p_size)
    SELECT p_size, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY p_size"""
)
def range_join_bands(spark, sf_dir):
    """Orders in overlapping bands of prices: both are dealt to steps of a price, so that the join has an equal key and no order meets all bands."""
    step = 5000.0
    bands = table(spark, sf_dir, "part").groupBy("p_size").agg((F.min("p_retailprice") * 50).alias("lo"), (F.max("p_retailprice") * 60).alias("hi"))
    dealt = bands.withColumn("step", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    o = table(spark, sf_dir, "orders").select("o_totalprice", F.floor(F.col("o_totalprice") / step).alias("step"))
    met = o.join(dealt, "step").where((F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi")))
    return met.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), _sum("o_totalprice", "total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_quantities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouping_sets_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_brand, median(p_retailprice) AS middle, quantile_cont(p_retailprice, 0.9) AS high, min(m) AS usual_size, count(*) FILTER (WHERE p_size > 25) AS n_large, arg_max(p_partkey, p_retailprice * 10000000 + p_partkey) AS dearest
    FROM part JOIN (SELECT p_brand AS b, min(p_size) AS m FROM (SELECT p_brand, p_size, count(*) AS n, max(count(*)) OVER (PARTITION BY p_brand) AS most FROM part GROUP BY 1, 2) WHERE n = most GROUP BY 1) ON b = p_brand GROUP BY 1"""
)
def order_statistics(spark, sf_dir):
    """Median, quantile, mode (the least of equals), filtered count and argument of the maximum."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(
        F.median("p_retailprice").alias("middle"),
        F.percentile("p_retailprice", F.lit(0.9)).alias("high"),
        F.mode("p_size", deterministic=True).alias("usual_size"),
        F.count_if(F.col("p_size") > 25).alias("n_large"),
        F.max_by("p_partkey", F.col("p_retailprice") * 10000000 + F.col("p_partkey")).alias("dearest"),
    )


@query(
    """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1), large AS (SELECT o_custkey FROM spent WHERE s > (SELECT avg(s) FROM spent))
    SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM large) GROUP BY 1"""
)
def cte_large_spenders(spark, sf_dir):
    """A statement with named parts, as a session checks and runs it."""
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"cte_{name}")
    text = """
        WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS s FROM cte_orders GROUP BY 1), large AS (SELECT o_custkey FROM spent WHERE s > (SELECT avg(s) FROM spent))
        SELECT c_mktsegment, count(*) AS n FROM cte_customer WHERE c_custkey IN (SELECT o_custkey FROM large) GROUP BY 1
    """
    return guard.checked(spark, text, {"cte_orders", "cte_customer"}).frame


@query("SELECT 'l_orderkey' AS column_name, TRUE AS is_near UNION ALL SELECT 'l_partkey', TRUE")
def approximate_distinct(spark, sf_dir):
    """Distinct counts by sketches, each held against the exact one."""
    li = table(spark, sf_dir, "lineitem")
    out = []
    for c in ("l_orderkey", "l_partkey"):
        # apart, as one aggregate would hold a sketch for every distinct value
        exact = li.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count(c).alias("exact"))
        both = li.agg(F.approx_count_distinct(c, 0.02).alias("near")).crossJoin(exact)
        out.append(both.select(F.lit(c).alias("column_name"), (F.abs(F.col("near") - F.col("exact")) <= 0.08 * F.col("exact")).alias("is_near")))
    return out[0].union(out[1])


@query("SELECT strftime(o_orderdate, '%Y/%m') AS month, strftime(min(o_orderdate), '%d.%m.%Y') AS first_day, count(*) AS n FROM orders GROUP BY 1")
def date_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy/MM").alias("month")).agg(F.date_format(F.min("o_orderdate"), "dd.MM.yyyy").alias("first_day"), F.count(F.lit(1)).alias("n"))


# --- discovery ---------------------------------------------------------------------------------------

KEYS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))


_KEY_SQL = " UNION ALL ".join(
    f"SELECT '{a}.{b}' AS child, '{c}.{d}' AS parent, (SELECT count(*) FROM (SELECT {b} FROM {a} INTERSECT SELECT {d} FROM {c}))::BIGINT AS shared, (SELECT count(DISTINCT {b}) FROM {a}) AS child_distinct, (SELECT count(DISTINCT {d}) FROM {c}) AS parent_distinct, (SELECT count(*) FROM {a} WHERE {b} IN (SELECT {d} FROM {c})) AS covered, (SELECT count({b}) FROM {a}) AS child_rows" for a, b, c, d in KEYS
)


#: Parents before children, as the left table of a pair is the parent where both are unique.
KEY_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")


def _key_measures(spark, sf_dir) -> DataFrame:
    """The measures of discovery for the key pairs, among all pairs of their columns."""
    columns = {t: list(dict.fromkeys(x for a, b, c, d in KEYS for u, x in ((a, b), (c, d)) if u == t)) for t in KEY_TABLES}
    _, decided = relate.measured({t: table(spark, sf_dir, t).select(*cs) for t, cs in columns.items()})
    known = F.array(*(F.lit(f"{c}.{d}<{a}.{b}") for a, b, c, d in KEYS))
    parent, child = F.concat_ws(".", "left_table", "left_column"), F.concat_ws(".", "right_table", "right_column")
    return decided.where(F.array_contains(known, F.concat(parent, F.lit("<"), child))).withColumns({"parent": parent, "child": child})


@query(f"SELECT child, parent, round(shared / least(child_distinct, parent_distinct), 6) AS containment FROM ({_KEY_SQL})")
def containment_fk_pairs(spark, sf_dir):
    return _key_measures(spark, sf_dir).select("child", "parent", F.round("containment", 6).alias("containment"))


@query(f"SELECT child, parent, round(covered / child_rows, 6) AS coverage FROM ({_KEY_SQL})")
def coverage_rows(spark, sf_dir):
    return _key_measures(spark, sf_dir).select("child", "parent", F.round("coverage", 6).alias("coverage"))


@query(
    """
    SELECT 'c_name' AS column_name, count(DISTINCT c_name) AS raw, count(DISTINCT lower(trim(c_name))) AS lower_trim, count(DISTINCT regexp_replace(c_name, '[^0-9]', '', 'g')) AS digits_only, count(DISTINCT regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g')) AS alnum_only FROM customer
    UNION ALL
    SELECT 'p_brand', count(DISTINCT p_brand), count(DISTINCT lower(trim(p_brand))), count(DISTINCT regexp_replace(p_brand, '[^0-9]', '', 'g')), count(DISTINCT regexp_replace(lower(trim(p_brand)), '[^a-z0-9]', '', 'g')) FROM part
    """
)
def projection_distincts(spark, sf_dir):
    held = relate.values({"customer": table(spark, sf_dir, "customer").select("c_name"), "part": table(spark, sf_dir, "part").select("p_brand")})
    return held.groupBy("column_name").pivot("projection", list(PROJECTIONS)).agg(F.count(F.lit(1)))


@query("SELECT 'l_orderkey+l_linenumber' AS columns, count(DISTINCT (l_orderkey, l_linenumber)) AS tuples, count(*) AS n_rows, round(count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 6) AS uniqueness FROM lineitem")
def composite_uniqueness(spark, sf_dir):
    key = ("l_orderkey", "l_linenumber")
    found = relate.tuple_measures({"lineitem": table(spark, sf_dir, "lineitem")}, [relate.Tuples("lineitem", key, "lineitem", key)])
    return found.select(F.lit("+".join(key)).alias("columns"), F.col("a").alias("tuples"), F.col("rows_a").alias("n_rows"), F.round(F.col("a") / F.col("rows_a"), 6).alias("uniqueness"))


@query(
    """WITH l AS (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders), c AS (SELECT DISTINCT l_linestatus AS s, l_returnflag AS f FROM lineitem), o AS (SELECT DISTINCT o_orderstatus AS s, left(o_orderpriority, 1) AS f FROM orders)
    SELECT (SELECT count(*) FROM c) AS left_tuples, (SELECT count(*) FROM o) AS right_tuples, (SELECT count(*) FROM (SELECT lower(s), lower(f) FROM c INTERSECT SELECT lower(s), lower(f) FROM o)) AS shared"""
)
def composite_containment(spark, sf_dir):
    """Pairs of columns of two tables as one key."""
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("first"))
    found = relate.tuple_measures({"lineitem": li, "orders": o}, [relate.Tuples("lineitem", ("l_linestatus", "l_returnflag"), "orders", ("o_orderstatus", "first"))])
    return found.select(F.col("a").alias("left_tuples"), F.col("b").alias("right_tuples"), "shared")


def _grain_sql(unit: str) -> str:
    return f"""SELECT '{unit}' AS unit, round((SELECT count(*) FROM (SELECT date_trunc('{unit}', o_orderdate) FROM orders INTERSECT SELECT date_trunc('{unit}', l_shipdate) FROM lineitem)) / least(o, l), 6) AS containment, o AS left_periods, l AS right_periods
        FROM (SELECT (SELECT count(DISTINCT date_trunc('{unit}', o_orderdate)) FROM orders) AS o, (SELECT count(DISTINCT date_trunc('{unit}', l_shipdate)) FROM lineitem) AS l)"""


@query(f"{_grain_sql('month')} UNION ALL {_grain_sql('week')}")
def grain_containment(spark, sf_dir):
    found = relate.grain_keys(table(spark, sf_dir, "orders"), "o_orderdate", table(spark, sf_dir, "lineitem"), "l_shipdate")
    return found.select("unit", F.round("containment", 6).alias("containment"), "left_periods", "right_periods")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query()
def discovery_end_to_end(spark, sf_dir):
    """Relationships of all tables, by the values of all their columns."""
    return relate.discovered({n: table(spark, sf_dir, n) for n in TABLES})


@query()
def discovery_two_tables(spark, sf_dir):
    """Relationships of a large table of facts and the table that it refers to."""
    return relate.discovered({n: table(spark, sf_dir, n) for n in ("customer", "orders")})


@query()
def discovered_components(spark, sf_dir):
    """Groups of tables that the discovered relationships join."""
    edges = discovery_end_to_end(spark, sf_dir).select(F.col("left_table").alias("a"), F.col("right_table").alias("b"))
    return graph.components(spark.createDataFrame([(n,) for n in TABLES], "node string"), edges)


@query()
def undecided_pairs(spark, sf_dir):
    """Pairs of columns that overlap by half or more and share a word, but not enough to be taken."""
    _, decided = relate.measured({n: table(spark, sf_dir, n) for n in TABLES})
    return relate.undecided(decided).select("left_table", "left_column", "right_table", "right_column", "containment", "score")


# --- profiles and catalog ----------------------------------------------------------------------------


def _profile_sql(t: str, texts: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*), 4) AS null_rate, count(DISTINCT {c}) = count(*) AS is_unique, '{kind}' AS semantic_type FROM {t}" for c, kind in texts.items()
    )


def _profiled(df: DataFrame) -> DataFrame:
    return profile.profile(df).select("column_name", "n_rows", "n_distinct", "n_null", "null_rate", "is_unique", "semantic_type")


@query(_profile_sql("customer", {"c_custkey": "id", "c_name": "id", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "category"}))
def profile_customer(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "customer"))


@query(
    _profile_sql("events", {"event_id": "id", "user_id": "id", "event_type": "category", "value": "numeric"})
    + """ UNION ALL SELECT 'ts', count(*), count(DISTINCT ts::DATE), count(*) - count(ts), round((count(*) - count(ts)) / count(*), 4), count(DISTINCT ts::DATE) = count(*), 'date' FROM events
    UNION ALL SELECT 'props', count(*), count(DISTINCT props), count(*) - count(props), round((count(*) - count(props)) / count(*), 4), count(DISTINCT props) = count(*),
        CASE WHEN count(DISTINCT props) / count(*) >= 0.9 AND count(DISTINCT props) > 1 THEN 'id' WHEN count(DISTINCT props) <= 50 OR count(DISTINCT props) / count(*) <= 0.05 THEN 'category' ELSE 'text' END FROM events"""
)
def profile_events(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "events"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, {sig} AS regex_signature FROM {t}" for t, c, sig in (("part", "p_brand", "NULL::VARCHAR"), ("customer", "c_mktsegment", "NULL::VARCHAR"), ("orders", "o_orderpriority", "NULL::VARCHAR"))
    )
)
def profile_bounds(spark, sf_dir):
    parts = [profile.profile(table(spark, sf_dir, t).select(c)) for t, c in (("part", "p_brand"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"))]
    return parts[0].union(parts[1]).union(parts[2]).select("column_name", "min_value", "max_value", "regex_signature")


_SPELLED = {"coded": "'C-' || c_custkey", "mailed": "c_custkey || '@' || lower(c_mktsegment) || '.org'", "dated": "'2024-01-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0')", "called": "lpad(c_custkey::VARCHAR, 10, '0')", "wide": "lpad(c_custkey::VARCHAR, 7, '0')", "named": "c_mktsegment || c_custkey"}
_SIGNATURE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, CASE " + " ".join(f"WHEN avg(regexp_matches(v, '{p}')::INT) >= 0.95 THEN '{p}'" for p in profile.SIGNATURES) + f" WHEN avg((regexp_matches(v, '^[0-9]+$') AND length(v) = 7)::INT) >= 0.95 THEN '^\\d{{7}}$' END AS regex_signature FROM (SELECT {e} AS v FROM customer)" for n, e in _SPELLED.items()
)


@query(_SIGNATURE_SQL)
def regex_signatures(spark, sf_dir):
    """The patterns of customers' numbers spelled in six ways."""
    key = F.col("c_custkey").cast("string")
    spelled = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C-"), key).alias("coded"),
        F.concat(key, F.lit("@"), F.lower("c_mktsegment"), F.lit(".org")).alias("mailed"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0")).alias("dated"),
        F.lpad(key, 10, "0").alias("called"),
        F.lpad(key, 7, "0").alias("wide"),
        F.concat("c_mktsegment", key).alias("named"),
    )
    return profile.profile(spelled).select("column_name", "regex_signature")


_WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 2, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, {n}::BIGINT AS n_columns" for t, n in _WIDTHS.items()))
def catalog_tables(spark, sf_dir):
    """All tables with their rows and columns of single values."""
    whole, _ = profile.catalog({n: (table(spark, sf_dir, n), f"{n}.parquet") for n in TABLES})
    return whole.select("table_name", "n_rows", "n_columns")


_COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate::DATE", "o_orderpriority"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c.removesuffix('::DATE')}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_nulls FROM {t}" for t, cs in _COLUMNS.items() for c in cs))
def catalog_columns(spark, sf_dir):
    _, columns = profile.catalog({n: (table(spark, sf_dir, n), f"{n}.parquet") for n in _COLUMNS})
    return columns.select("table_name", "column_name", "n_distinct", "n_nulls")


# --- types of text ------------------------------------------------------------------------------------


def _european(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


@query("SELECT 'bigint' AS key_type, 'double' AS price_type, TRUE AS european, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def coerce_locale_numbers(spark, sf_dir):
    """Prices spelled with decimal commas, read back."""
    text = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("key"), F.concat(_european(F.col("o_totalprice")), F.lit(" €")).alias("price"))
    plan = written(infer.inferred(text), "plan")
    kinds = plan.groupBy().pivot("column_name", ["key", "price"]).agg(F.first("target").alias("target"), F.first("european").alias("european"))
    total = infer.coerced(text, plan).agg(_sum("price", "total"), F.count("key").alias("n"))
    return kinds.crossJoin(total).select(F.col("key_target").alias("key_type"), F.col("price_target").alias("price_type"), F.col("price_european").alias("european"), "total", "n")


@query("SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS year, count(*) AS n FROM lineitem GROUP BY 1")
def coerce_dates(spark, sf_dir):
    """Day-first dates as text, read back."""
    text = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "dd/MM/yyyy").alias("shipped"))
    return infer.coerced(text).groupBy(F.date_trunc("year", "shipped").cast("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus = 'F' AS finished, count(*) AS n FROM orders GROUP BY 1")
def coerce_booleans(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("yes")).otherwise(" No").alias("finished"))
    return infer.coerced(text).groupBy("finished").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) - count(*) FILTER (WHERE c_custkey % 5 = 0) AS n, round(sum(c_acctbal) FILTER (WHERE c_custkey % 5 <> 0), 2) AS total FROM customer")
def null_tokens(spark, sf_dir):
    """Balances of which a fifth are spelled as missing, negatives in brackets."""
    spelled = F.element_at(F.array(*map(F.lit, cells.NULL_TOKENS)), (F.col("c_custkey") % len(cells.NULL_TOKENS) + 1).cast("int"))
    amount = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    text = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.upper(spelled)).otherwise(amount).alias("balance"))
    return infer.coerced(text).agg(F.count("balance").alias("n"), _sum("balance", "total"))


def _lines(spark, sf_dir) -> DataFrame:
    """Cells of the documents: lines as rows, split at bars."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.select("file", F.lit("").alias("sheet"), "row", F.posexplode(F.split("line", r"\|")).alias("col", "raw")).select("file", "sheet", "row", "col", F.trim("raw").alias("value"))


_LINES_SQL = """
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents),
    cells AS (SELECT doc_id, row, trim(unnest(string_split(line, '|'))) AS value FROM lines)
"""


@query(
    f"""WITH {_LINES_SQL} SELECT CASE WHEN value = '' THEN 'empty' WHEN regexp_matches(value, '{cells.DATE_LIKE}') THEN 'date' WHEN regexp_matches(value, '{cells.NUMERIC_LIKE}') THEN 'number' ELSE 'text' END AS kind, count(*) AS n FROM cells GROUP BY 1"""
)
def cell_kinds(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(cells.kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_LINES_SQL}, full_rows AS (SELECT DISTINCT doc_id, row FROM cells WHERE value <> ''), b AS (SELECT doc_id, row, row - row_number() OVER (PARTITION BY doc_id ORDER BY row) AS band FROM full_rows)
    SELECT CAST(doc_id AS VARCHAR) AS file, CAST(min(row) AS INTEGER) AS top, CAST(max(row) AS INTEGER) AS bottom FROM b GROUP BY doc_id, band"""
)
def row_band_islands(spark, sf_dir):
    found = blocks._islands(_lines(spark, sf_dir).where("value <> ''").withColumn("region", F.lit("")), "row")
    return found.groupBy("file", "region").agg(F.min("row").alias("top"), F.max("row").alias("bottom")).select("file", "top", "bottom")


@query()
def tables_in_documents(spark, sf_dir):
    """The tables that stand in documents: by block their header row and size."""
    return blocks.tables(_lines(spark, sf_dir)).groupBy("file", "block", "header").agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_columns"))


@query()
def forms_in_documents(spark, sf_dir):
    return blocks.form_items(_lines(spark, sf_dir)).drop("sheet")


@query(
    """
    WITH flat AS (SELECT DISTINCT url, trim(regexp_replace(lower(url), '[^0-9a-z]+', '_', 'g'), '_') AS f FROM pages),
    bare AS (SELECT url, CASE WHEN regexp_matches(f, '^[0-9]+$') THEN 'n' || f ELSE regexp_replace(f, '^[0-9_]+', '') END AS b FROM flat)
    SELECT url, CASE WHEN length(b) <= 48 THEN b WHEN regexp_extract(left(b, 48), '^(.*)_[^_]*$', 1) <> '' THEN regexp_extract(left(b, 48), '^(.*)_[^_]*$', 1) ELSE left(b, 48) END AS column_name FROM bare
    """
)
def column_name_normalizer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").distinct().select("url", names.safe_name(F.col("url"), F.lit(1)).alias("column_name"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, 1::BIGINT AS tables FROM orders")
def fuse_union_all(spark, sf_dir):
    """Orders kept apart by priority, united again."""
    o = table(spark, sf_dir, "orders")
    parts = {f"orders_{i}": o.where(F.col("o_orderpriority").startswith(str(i))) for i in range(1, 6)}
    united = fuse.fused(parts)
    (one,) = united.values()
    return one.agg(F.count(F.lit(1)).alias("n"), _sum("o_totalprice", "total")).withColumn("tables", F.lit(len(united)).cast("long"))


# --- routing and presentation -----------------------------------------------------------------------

_EXPANDED_SQL = (
    "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.ABBREVIATIONS.items()) + " ELSE CASE WHEN length(w) < 4 OR regexp_matches(w, '(ss|us|is|as|os)$') THEN w WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' "
    "WHEN regexp_matches(w, '(ches|shes|xes|zes)$') THEN left(w, length(w) - 2) WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END END"
)
_STOPPED = ", ".join(f"'{w}'" for w in bm25.STOPWORDS)
_TOKEN_SQL = f"SELECT doc_id, {_EXPANDED_SQL} AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9]*|\\d+')) AS w FROM documents) WHERE w NOT IN ({_STOPPED})"


@query(f"WITH t AS ({_TOKEN_SQL}) SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY w")
def token_stats(spark, sf_dir):
    per_doc = bm25.text_terms(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return per_doc.groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(
    f"""
    WITH t AS ({_TOKEN_SQL}), c AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS len FROM c GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) AS total),
    d AS (SELECT w, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM c, n GROUP BY w, n), f AS (SELECT avg(raw) * 0.25 AS floor FROM d),
    s AS (SELECT c.doc_id, sum((CASE WHEN raw < 0 THEN floor ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / n)))) AS score FROM c JOIN d USING (w) JOIN l USING (doc_id), n, f WHERE w IN ('license', 'public', 'version', 'token') GROUP BY 1)
    SELECT doc_id AS doc, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 4
    """
)
def bm25_documents(spark, sf_dir):
    """The documents that a question is about; terms are counted and written once."""
    docs = table(spark, sf_dir, "documents")
    counts = written(bm25.text_terms(docs, "doc_id", F.col("text")), "terms")
    found = bm25.ranked(counts, docs.count(), route.asked_terms(spark, "public license version tokens"))
    return found.select("doc", F.round("score", 6).alias("score"))


@query("SELECT 'o_totalprice' AS measure, count(*) AS n_rows, max(o_totalprice) AS highest, min(o_totalprice) AS lowest, round(sum(o_totalprice), 2) AS total FROM orders")
def facts_extremes(spark, sf_dir):
    return present.facts(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")).select("measure", "n_rows", "highest", "lowest", F.round("total", 2).alias("total"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def evidence_rows(spark, sf_dir):
    """The rows behind a figure, as a session fetches them beside it."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("evidence_orders")
    return guard.evidence(spark, "SELECT o_orderkey, o_custkey, o_totalprice FROM evidence_orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey", {"evidence_orders"})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM s GROUP BY user_id, k
    """
)
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.sessions(e)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
