"""Joins by order: orders and the events of their time.

The events' month is stretched over the years of the orders, so that both
tables cover one stretch of time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as O
from .registry import query

#: Seconds: the events' first day, the orders' first day, and by how much the events' time is stretched.
_EVENTS, _ORDERS, _STRETCH = 1_704_067_200, 694_224_000, 80

_SPANS = f"""o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000000 AS opened, epoch_us(o_orderdate) // 1000000 + CASE WHEN o_orderkey % 500 = 0 THEN 2600000 ELSE 600 * (o_orderkey % 90) END AS closed FROM orders),
e AS (SELECT event_id, user_id, value, {_ORDERS} + (epoch_us(ts) // 1000000 - {_EVENTS}) * {_STRETCH} AS began, {_ORDERS} + (epoch_us(ts) // 1000000 - {_EVENTS}) * {_STRETCH} + 60 * (event_id % 7) AS ended FROM events)"""


def _orders(t):
    opened = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    length = F.when(F.col("o_orderkey") % 500 == 0, 2_600_000).otherwise(600 * (F.col("o_orderkey") % 90))
    return t("orders").select("o_orderkey", "o_custkey", opened.alias("opened"), (opened + length).alias("closed"))


def _events(t):
    began = _ORDERS + (F.unix_seconds(F.col("ts").cast("timestamp")) - _EVENTS) * _STRETCH
    return t("events").select("event_id", "user_id", "value", began.alias("began"), (began + 60 * (F.col("event_id") % 7)).alias("ended"))


@query("x31_interval_join", f"WITH {_SPANS} SELECT o_orderkey, count(*) AS n, min(event_id) AS first_event, max(least(closed, ended) - greatest(opened, began)) AS longest FROM o JOIN e ON opened <= ended AND began <= closed GROUP BY o_orderkey")
def _(t):
    """The events that fall into the time in which an order is open."""
    met = O.overlap_summaries(_orders(t), _events(t), ("opened", "closed"), ("began", "ended"), "event_id", unit=60)
    return met.groupBy("o_orderkey").agg(F.sum("n").alias("n"), F.min("first").alias("first_event"), F.max("longest").alias("longest"))


@query("x31_overlap_counts", f"WITH {_SPANS} SELECT o_orderkey, count(event_id) AS n FROM o LEFT JOIN e ON opened <= ended AND began <= closed GROUP BY o_orderkey")
def _(t):
    return O.overlap_counts(_orders(t), _events(t), "o_orderkey", ("opened", "closed"), ("began", "ended"))


@query("x32_as_of_join", f"WITH {_SPANS}, d AS (SELECT began, max(event_id) AS event_id FROM e GROUP BY began) SELECT o_orderkey, opened, d.event_id, opened - d.began AS age FROM o ASOF LEFT JOIN d ON opened >= d.began")
def _(t):
    """The last event before each order, whoever's it is."""
    found = O.as_of(_orders(t).select("o_orderkey", "opened"), _events(t).select("event_id", "began"), "opened", "began", tie="event_id")
    return found.select("o_orderkey", "opened", "event_id", (F.col("opened") - F.col("began")).alias("age"))


@query("x32_as_of_join_by_key", f"WITH {_SPANS}, d AS (SELECT user_id, began, max(event_id) AS event_id FROM e GROUP BY user_id, began) SELECT o_orderkey, opened, d.event_id, opened - d.began AS age FROM o ASOF LEFT JOIN d ON o_custkey = d.user_id AND opened > d.began")
def _(t):
    """The customer's own last event before each order."""
    found = O.as_of(_orders(t).select("o_orderkey", "o_custkey", "opened"), _events(t).select("event_id", "user_id", "began"), "opened", "began", by=(("o_custkey", "user_id"),), tie="event_id", strict=True)
    return found.select("o_orderkey", "opened", "event_id", (F.col("opened") - F.col("began")).alias("age"))
