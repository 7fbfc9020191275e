"""Queries over events by period: kept sketches, and sessions from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as S
from ..sources.shared import new_folder, written
from .registry import query

_WEEK = "(epoch_us(ts) // 604800000000)"


def _events(t):
    at = F.col("ts").cast("timestamp")
    return t("events").withColumn("day", F.call_function("div", F.unix_seconds(at), F.lit(86_400))).withColumn("week", F.call_function("div", F.unix_seconds(at), F.lit(604_800)))


@query("x24_weekly_sketches")
def _(t):
    """Users and values of each type and week, from sketches that are kept by day."""
    daily = written(S.sketches(_events(t), ("event_type", "day", "week"), "user_id", "value"))
    return S.estimates(S.merged(daily, ("event_type", "week")), ("event_type", "week"))


_HASH = "('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT"


@query("x24_weekly_minima", f"""WITH h AS (SELECT DISTINCT event_type, {_WEEK} AS week, {_HASH} AS h FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, week ORDER BY h) AS k FROM h),
m AS (SELECT event_type, week, count(*) AS kept, 255 / (max(h) / 1152921504606846976::DOUBLE) AS about FROM r WHERE k <= 256 GROUP BY ALL)
SELECT event_type, week, kept, CASE WHEN kept = 256 THEN round(about)::BIGINT ELSE kept END AS "distinct", CASE WHEN kept = 256 THEN floor(about / (1 + 3 / sqrt(254)))::BIGINT ELSE kept END AS distinct_low,
       CASE WHEN kept = 256 THEN ceil(about / (1 - 3 / sqrt(254)))::BIGINT ELSE kept END AS distinct_high FROM m""")
def _(t):
    """The same with a sketch of minima: merged from days, it is the sketch of all the week's rows."""
    daily = written(S.minima(_events(t), ("event_type", "day", "week"), "user_id"))
    return S.minima_estimates(S.merged_minima(daily, ("event_type", "week")), ("event_type", "week"))


_GAP, _LATE = 7_200, 21_600

#: Passes: the first half of the month; the second, with some of the first; what is left of either.
_PASSES = f"""e AS (SELECT event_id, user_id, date_trunc('second', ts) AS ts, CASE WHEN event_id % 50 = 7 THEN 3 WHEN ts >= TIMESTAMP '2024-01-16' OR event_id % 10 = 3 THEN 2 ELSE 1 END AS pass FROM events),
w AS (SELECT epoch(max(ts) FILTER (pass = 1)) - {_LATE} AS second, epoch(max(ts) FILTER (pass < 3)) - {_LATE} AS third FROM e),
f AS (SELECT user_id, epoch(ts)::BIGINT AS s, (pass = 2 AND epoch(ts) <= second) OR (pass = 3 AND epoch(ts) <= third) AS late, third FROM e, w),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < {_GAP} THEN 0 ELSE 1 END AS starts FROM f WHERE NOT late),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM g)"""


@query("x33_timed_sessions", f"""WITH {_PASSES}
SELECT user_id::VARCHAR AS key, 'session' AS kind, min(s) AS start, max(s) AS last, count(*) AS n FROM n GROUP BY user_id, nth, third HAVING max(s) + {_GAP} < third
UNION ALL SELECT user_id::VARCHAR, 'late', min(s), max(s), count(*) FROM f WHERE late GROUP BY user_id""")
def _(t):
    """Sessions from a stream of three passes whose rows come out of order and late; those still open at the end are not given."""
    from ..streaming.timers import collect_sessions

    e = F.col("event_id")
    rows = t("events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    number = F.when(e % 50 == 7, 3).when((F.col("ts") >= F.lit("2024-01-16").cast("timestamp")) | (e % 10 == 3), 2).otherwise(1)
    spark = rows.sparkSession
    inbox, store, mark = (new_folder(spark, name) for name in ("inbox", "sessions", "progress"))
    for i in (1, 2, 3):
        rows.where(number == i).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        collect_sessions(spark, stream, store, mark, "user_id", "ts", f"{_LATE} seconds", _GAP * 1000).awaitTermination()
    found = spark.read.schema("key string, kind string, start long, last long, n long").parquet(store)
    late = found.where("kind = 'late'").groupBy("key", "kind").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))
    second = lambda c: F.call_function("div", F.col(c), F.lit(1000)).alias(c)
    return found.where("kind = 'session'").unionByName(late).select("key", "kind", second("start"), second("last"), "n")
