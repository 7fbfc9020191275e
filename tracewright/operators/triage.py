"""Incremental triage: new evidence against a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_key


def keyed(nominations: DataFrame) -> DataFrame:
    """With the evidence key of source, class, whole session id and line."""
    return nominations.withColumn("key", evidence_key(F.col("source"), F.col("class"), F.col("session"), F.col("line")))


def new_evidence(nominations: DataFrame, store: DataFrame, first_seen) -> DataFrame:
    """Nominations whose key the store lacks, one for each key (the earliest), stamped."""
    fresh = keyed(nominations).join(store.select("key").distinct(), "key", "left_anti")
    one = fresh.groupBy("key").agg(F.min(F.struct("ts", "source", "class", "session", "line")).alias("x")).select("key", "x.*")
    return one.withColumn("first_seen", first_seen)


def class_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("sessions"), F.min("first_seen").alias("first_seen"))


def tallies(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per class: new rows, and those before; classes with the most new ones first when ordered by them."""
    total = store.groupBy("class").agg(F.count(F.lit(1)).alias("total"))
    new = fresh.groupBy("class").agg(F.count(F.lit(1)).alias("new"))
    both = total.join(new, "class", "full_outer").na.fill(0, ["total", "new"])
    return both.select("class", "new", (F.col("total") - F.col("new")).alias("prior"), "total")


def recent(rows: DataFrame, day: str, as_of, days: int = 7) -> DataFrame:
    """Rows of the days up to ``as_of``."""
    return rows.where(F.col(day) >= F.date_sub(as_of, days))
