"""Extras: operators beyond the transcript workloads, on the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantile
from ..operators.signatures import rerun_pairs
from .registry import query


@query("x10_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query("x11_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("x12_ranks", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    tile = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(tile).cast("long").alias("q"))


@query("x13_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(t):
    return t("orders").join(t("lineitem").where("l_quantity >= 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("x14_as_of_purchase", "SELECT v.event_id, max(p.ts) IS NOT NULL AS bought_before FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts <= v.ts GROUP BY v.event_id")
def _(t):
    # the last purchase up to each view: one sorted pass over both, no pairs
    seen = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return t("events").withColumn("p", seen).where("event_type = 'view'").select("event_id", F.col("p").isNotNull().alias("bought_before"))


@query("x15_intersect", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return t("customer").select("c_custkey").intersect(t("orders").select("o_custkey"))


@query("x16_exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _(t):
    e = t("events")
    median = exact_quantile(e, ("event_type",), "value", 0.5).select("event_type", F.round("quantile", 6).alias("median"))
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users")).join(median, "event_type", "left")


@query("x17_monthly_revenue", "SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x18_rerun_pairs", "WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS following FROM events) SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error' AND following = 'click') AS rerun FROM e GROUP BY user_id")
def _(t):
    return rerun_pairs(t("events"), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "click")


@query("x19_tumbling_hours", "SELECT event_type, (epoch_us(ts) // 3600000000) * 3600 AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    w = t("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.unix_timestamp("window.start").alias("hour"), "n", "total")


@query("x20_property_counts", "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("x21_range_join", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity BETWEEN p_size AND p_size + 10 GROUP BY p_partkey")
def _(t):
    near = F.col("l_quantity").between(F.col("p_size"), F.col("p_size") + 10)
    return t("part").join(t("lineitem"), (F.col("l_partkey") == F.col("p_partkey")) & near, "left").groupBy("p_partkey").agg(F.count("l_orderkey").alias("n"))


@query("x22_sliding_windows", "SELECT event_type, (epoch_us(ts) // 900000000 - k) * 900 AS start, count(*) AS n FROM events, range(0, 4) AS r(k) GROUP BY ALL")
def _(t):
    w = t("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.unix_timestamp("window.start").alias("start"), "n")


@query("x23_cross_join", "SELECT r_name, s_name, count(*) AS n FROM region, (SELECT DISTINCT o_orderstatus AS s_name FROM orders), nation WHERE n_regionkey <= r_regionkey GROUP BY ALL")
def _(t):
    # a region, a status and a nation: tables whose size does not follow the data
    status = t("orders").select(F.col("o_orderstatus").alias("s_name")).distinct()
    return t("region").crossJoin(F.broadcast(status)).join(t("nation"), F.col("n_regionkey") <= F.col("r_regionkey")).groupBy("r_name", "s_name").agg(F.count(F.lit(1)).alias("n"))


@query("x24_approximate_counts", "SELECT event_type, true AS users_near, true AS median_near FROM events GROUP BY event_type")
def _(t):
    """Sketches against exact figures: a distinct count within a tenth, a median within a twentieth of the range."""
    exact = t("events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.percentile("value", 0.5).alias("median"), (F.max("value") - F.min("value")).alias("range"),
        F.approx_count_distinct("user_id", 0.02).alias("users_about"), F.percentile_approx("value", 0.5, 1000).alias("median_about"),
    )
    near = lambda a, b, within: F.abs(F.col(a) - F.col(b)) <= within
    return exact.select("event_type", near("users", "users_about", 0.1 * F.col("users")).alias("users_near"), near("median", "median_about", 0.05 * F.col("range")).alias("median_near"))


@query("x25_decimal_sums", "SELECT l_returnflag, (sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(100 - round(l_discount * 100) AS BIGINT)) * 1)::DECIMAL(38, 2)::VARCHAR AS net FROM lineitem GROUP BY l_returnflag")
def _(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    share = (100 - F.round(F.col("l_discount") * 100)).cast("decimal(3,0)")
    return t("lineitem").groupBy("l_returnflag").agg(F.sum(price * share).cast("decimal(38,2)").cast("string").alias("net"))


@query("x26_as_of_value", "SELECT v.event_id, arg_max(p.value, (p.ts, p.event_id)) AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND (p.ts, p.event_id) < (v.ts, v.event_id) GROUP BY v.event_id")
def _(t):
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return t("events").withColumn("last_value", bought).where("event_type = 'view'").select("event_id", "last_value")


@query("x27_hinted_joins", "SELECT count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def _(t):
    joined = t("lineitem").hint("merge").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("x28_registered_functions", "SELECT item_id, lower(trim(regexp_replace(regexp_replace(text, '[*_`]', '', 'g'), '\\s+', ' ', 'g'))) AS key, i AS nth, w AS word FROM (SELECT item_id, text, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:3] AS ws FROM benchmark))")
def _(t):
    """A column function and a table function called by name from SQL."""
    from ..functions.registered import register

    b = t("benchmark")
    spark = b.sparkSession
    register(spark)
    return spark.sql("SELECT item_id, tw_quote_key(text) AS key, w.nth, w.word FROM {b} AS b, LATERAL tw_first_words(b.text, 3) AS w", b=b)


@query("x29_session_windows", "WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), n AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM n GROUP BY user_id, s")
def _(t):
    w = t("events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("x30_arm_cite_rates", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS citing, round(count(*) FILTER (doc_id % 3 = 0) / count(*)::DOUBLE, 9) AS rate FROM labels GROUP BY 1")
def _(t):
    """How many reviews of each arm cite a line of a file."""
    from ..operators.verdicts import cite_rates

    d = F.col("doc_id")
    text = F.when(d % 3 == 0, "see src/a.rs:12 there").when(d % 3 == 1, "see src/a.rs").otherwise("at 12:30")
    rows = t("labels").select(F.when(d % 2 == 0, "baseline").otherwise("treatment").alias("arm"), text.alias("text"))
    return cite_rates(rows).withColumn("rate", F.round("rate", 9))
