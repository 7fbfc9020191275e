"""Triage queries over events: the days before a date are the store, the rest is new."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import triage as O
from ..operators.coverage import placed
from .registry import query

_NOM = """nom AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'failure' ELSE 'success' END AS source, event_type AS class, user_id::VARCHAR AS session, event_id % 50 AS line, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events),
k AS (SELECT *, source || '|' || class || '|' || session || '|L' || line AS key FROM nom),
store AS (SELECT key, class, session, min(ts) AS ts FROM k WHERE ts < '2024-01-20' GROUP BY key, class, session),
fresh AS (SELECT key, min(source) AS source, min(class) AS class, min(session) AS session, min(line) AS line, min(ts) AS ts FROM k WHERE ts >= '2024-01-20' AND key NOT IN (SELECT key FROM store) GROUP BY key)"""


def nominations(t):
    e = F.col("event_id")
    return t("events").select(
        F.when(e % 2 == 0, "failure").otherwise("success").alias("source"), F.col("event_type").alias("class"), F.col("user_id").cast("string").alias("session"),
        (e % 50).alias("line"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
    )


def store(t):
    old = O.keyed(nominations(t).where("ts < '2024-01-20'"))
    return old.groupBy("key", "class", "session").agg(F.to_date(F.substring(F.min("ts"), 1, 10)).alias("first_seen"))


def fresh(t):
    return O.new_evidence(nominations(t).where("ts >= '2024-01-20'"), store(t), F.lit("2024-01-31").cast("date"))


@query("j04_new_evidence", f"WITH {_NOM} SELECT key, source, class, session, line, ts, DATE '2024-01-31' AS first_seen FROM fresh")
def _(t):
    return fresh(t)


@query("f35_evidence_keys", f"WITH {_NOM} SELECT DISTINCT key FROM k")
def _(t):
    return O.keyed(nominations(t)).select("key").distinct()


@query("a29_class_stats", f"WITH {_NOM} SELECT class, count(*) AS n, count(DISTINCT session) AS sessions, min(ts[:10])::DATE AS first_seen FROM store GROUP BY class")
def _(t):
    return O.class_stats(store(t))


@query("a30_new_per_class", f"WITH {_NOM}, n AS (SELECT class, count(*) AS new FROM fresh GROUP BY class), s AS (SELECT class, count(*) AS prior FROM store GROUP BY class) SELECT coalesce(n.class, s.class) AS class, coalesce(new, 0) AS new, coalesce(prior, 0) AS prior, coalesce(new, 0) + coalesce(prior, 0) AS total FROM n FULL JOIN s ON n.class = s.class")
def _(t):
    new = fresh(t).select("key", "class")
    return O.tallies(store(t).select("key", "class").unionByName(new), new)


@query("p10_week_window", "SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-30' - 7")
def _(t):
    return O.recent(t("events").withColumn("day", F.to_date("ts")), "day", F.lit("2024-01-30").cast("date")).select("event_id")


@query("x04_weekly_windows", "SELECT event_type, (epoch_us(ts) // 604800000000) * 604800 AS week, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    w = t("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "7 days")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.unix_timestamp("window.start").alias("week"), "n")


@query("t03_most_new_first", f"WITH {_NOM}, n AS (SELECT class, count(*) AS new FROM fresh GROUP BY class) SELECT class, new, row_number() OVER (ORDER BY new DESC, class) AS place FROM n")
def _(t):
    return placed(fresh(t).groupBy("class").agg(F.count(F.lit(1)).alias("new")), F.col("new").desc(), F.col("class").asc())


@query("u02_two_detectors", "SELECT 'failure' AS source, event_type AS class, count(*) AS n FROM events WHERE event_type IN ('error', 'logout') OR value < 20 GROUP BY event_type UNION ALL SELECT 'success', event_type, count(*) FROM events WHERE event_type = 'purchase' OR value > 60 GROUP BY event_type")
def _(t):
    """Nominations of two detectors with rules of their own, as one table: a row that both nominate is in it twice."""
    rows = t("events")
    failures = rows.where(F.col("event_type").isin("error", "logout") | (F.col("value") < 20)).withColumn("source", F.lit("failure"))
    successes = rows.where((F.col("event_type") == "purchase") | (F.col("value") > 60)).withColumn("source", F.lit("success"))
    return failures.unionByName(successes).groupBy("source", F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
