"""Registered queries over the rest of the surface that a parameter table has because it is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .queries import query, table


@query("SELECT r_name, count(n_nationkey) AS nations FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0 GROUP BY r_name")
def join_right(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    return nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"))


@query("SELECT coalesce(c_nationkey, s_nationkey) AS k, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey < 15 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey > 8 GROUP BY 1) ON c_nationkey = s_nationkey")
def join_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").filter("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("s"))
    return c.join(s, "k", "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, median(value) AS median, round(var_pop(value), 4) AS variance,
  arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, count(DISTINCT user_id) AS users, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type""")
def group_statistics(spark, sf_dir):
    """First and last are by event; a median needs all of a group's values, by counts per value."""
    events = table(spark, sf_dir, "events").groupBy("event_type")
    return events.agg(
        F.round(F.mean("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.median("value").alias("median"), F.round(F.var_pop("value"), 4).alias("variance"),
        F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"), F.count_distinct("user_id").alias("users"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
    )


@query("""
SELECT event_id, CAST(sum(n) OVER w AS BIGINT) AS running, n - lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff, max(n) OVER w AS highest,
  count(*) OVER w - 1 AS before, round(avg(n) OVER w, 6) AS mean_so_far, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type
FROM (SELECT *, CAST(round(value) AS BIGINT) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def window_running(spark, sf_dir):
    """Cumulative sum, difference, expanding maximum and mean, cumulative count, shift forward."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "events").withColumn("n", F.round("value").cast("bigint"))
    return rows.select(
        "event_id", F.sum("n").over(so_far).alias("running"), (F.col("n") - F.lag("n").over(order)).alias("diff"), F.max("n").over(so_far).alias("highest"),
        (F.count("*").over(so_far) - 1).alias("before"), F.round(F.avg("n").over(so_far), 6).alias("mean_so_far"), F.lead("event_type").over(order).alias("next_type"),
    )


@query("SELECT p_partkey, word, CAST(pos AS INTEGER) AS pos FROM (SELECT p_partkey, w, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))")
def explode_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).select("p_partkey", "word", "pos")


NULLED = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders"


@query(f"SELECT o_orderkey, status IS NULL AS no_status, coalesce(status, 'none') AS status, coalesce(cust, 0) AS cust, coalesce(status, CAST(cust AS VARCHAR)) AS either FROM ({NULLED})")
def null_fill(spark, sf_dir):
    rows = _nulled(spark, sf_dir).withColumns({"no_status": F.col("status").isNull(), "either": F.coalesce("status", F.col("cust").cast("string"))})
    return rows.na.fill({"status": "none", "cust": 0}).select("o_orderkey", "no_status", "status", "cust", "either")


@query(f"SELECT o_orderkey, status, cust FROM ({NULLED}) WHERE status IS NOT NULL AND cust IS NOT NULL")
def null_drop(spark, sf_dir):
    return _nulled(spark, sf_dir).na.drop()


@query(f"SELECT count(*) AS total, count(status) AS with_status, count(cust) AS with_cust, count(*) FILTER (status IS NULL AND cust IS NULL) AS neither FROM ({NULLED})")
def null_counts(spark, sf_dir):
    return _nulled(spark, sf_dir).agg(F.count("*").alias("total"), F.count("status").alias("with_status"), F.count("cust").alias("with_cust"), F.count_if(F.col("status").isNull() & F.col("cust").isNull()).alias("neither"))


def _nulled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("cust"))


@query(r"""
SELECT page_id, contains(url, 'page=') AS paged, regexp_extract(url, '/([0-9]+)', 1) AS number, string_split(url, '/')[3] AS host, regexp_replace(url, '[?#].*$', '') AS bare, lower(upper(url)) AS lowered,
  CAST(length(url) AS INTEGER) AS size, starts_with(url, 'https') AS secure, reverse(url) AS turned, lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded, trim('  ' || url || ' ') AS trimmed FROM pages""")
def string_surface(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url.contains("page=").alias("paged"), F.regexp_extract(url, "/([0-9]+)", 1).alias("number"), F.get(F.split(url, "/"), F.lit(2)).alias("host"), F.regexp_replace(url, "[?#].*$", "").alias("bare"), F.lower(F.upper(url)).alias("lowered"),
        F.length(url).alias("size"), url.startswith("https").alias("secure"), F.reverse(url).alias("turned"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("padded"), F.trim(F.concat(F.lit("  "), url, F.lit(" "))).alias("trimmed"),
    )


@query("""
SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%d.%m.%Y') AS again FROM orders""")
def date_surface(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.dayofmonth(at).alias("d"), F.quarter(at).alias("q"), F.dayofyear(at).alias("doy"), F.weekofyear(at).alias("week"), F.date_format(at, "yyyy-MM").alias("month"),
        F.date_format(F.date_trunc("month", at), "yyyy-MM-dd").alias("month_start"), F.date_diff(at.cast("date"), F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(F.last_day(at), "yyyy-MM-dd").alias("month_end"), F.date_format(F.to_date(F.date_format(at, "yyyyMMdd"), "yyyyMMdd"), "dd.MM.yyyy").alias("again"),
    )


@query("""
SELECT l_orderkey, l_linenumber, greatest(10, least(40, l_quantity)) AS clipped, round(l_extendedprice / 1000, 0) AS thousands, CAST(CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 ELSE 3 END AS INTEGER) AS cut,
  floor(l_discount * 100 + 0.5) AS percent, sign(l_quantity - 25) AS side, CAST(l_orderkey % 7 AS INTEGER) AS m FROM lineitem""")
def math_surface(spark, sf_dir):
    quantity = F.col("l_quantity")
    cut = F.when(quantity <= 10, 1).when(quantity <= 25, 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.greatest(F.lit(10.0), F.least(F.lit(40.0), quantity)).alias("clipped"), F.round(F.col("l_extendedprice") / 1000, 0).alias("thousands"), cut.alias("cut"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("percent"), F.signum(quantity - 25).cast("tinyint").alias("side"), (F.col("l_orderkey") % 7).cast("int").alias("m"),
    )


@query("SELECT o_orderkey, CAST(1 + (r - 1) * 4 // n AS INTEGER) AS quarter FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders)")
def quantile_cut(spark, sf_dir):
    """Four classes of equal size: rows are numbered by ranges, so no task sorts all of them."""
    from .operators.manifest import numbered

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderkey").alias("place"))
    placed = numbered(rows, "place", "r")
    total = F.broadcast(rows.agg(F.count("*").alias("n")))
    return placed.crossJoin(total).select("o_orderkey", (1 + F.expr("(r - 1) * 4 div n")).cast("int").alias("quarter"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS price, round(corr(l_discount, l_tax), 6) AS tax, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem")
def correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("price"), F.round(F.corr("l_discount", "l_tax"), 6).alias("tax"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("covariance"))


@query("SELECT col, n, round(mean, 4) AS mean, round(std, 4) AS std, low, quarter, middle, upper, high FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS low, quantile_cont({c}, 0.25) AS quarter, quantile_cont({c}, 0.5) AS middle, quantile_cont({c}, 0.75) AS upper, max({c}) AS high FROM part" for c in ("p_retailprice", "CAST(p_size AS DOUBLE)")).replace("'CAST(p_size AS DOUBLE)'", "'p_size'") + ")")
def describe(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size")).unpivot([], ["p_retailprice", "p_size"], "col", "v")
    quantile = lambda q: F.percentile("v", F.lit(q))
    return rows.groupBy("col").agg(F.count("v").alias("n"), F.round(F.mean("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"), F.min("v").alias("low"), quantile(0.25).alias("quarter"), quantile(0.5).alias("middle"), quantile(0.75).alias("upper"), F.max("v").alias("high"))


@query("SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY c_mktsegment")
def value_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return rows.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).crossJoin(total).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT o_orderstatus, quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.1) AS p10 FROM orders GROUP BY o_orderstatus")
def quantiles(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.9)).alias("p90"), F.percentile("o_totalprice", F.lit(0.1)).alias("p10"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def nsmallest(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_totalprice", "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 15")
def tail(spark, sf_dir):
    """The last rows of an order are the first of its reverse."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.orderBy(F.desc("l_orderkey"), F.desc("l_linenumber")).limit(15)


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def drop_duplicates(spark, sf_dir):
    """The first row of each value by key, which ``dropDuplicates`` alone doesn't promise."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS INTEGER) AS line, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("paramscan_grouping")
    return spark.sql("SELECT l_returnflag, l_linestatus, l_linenumber AS line, count(*) AS n FROM paramscan_grouping GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
