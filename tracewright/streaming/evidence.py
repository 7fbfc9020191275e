"""Evidence as a stream: new keys only, across runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.triage import keyed

NOMINATION = "source string, class string, ts string, session string, line bigint"


def nominations(spark: SparkSession, where: str) -> DataFrame:
    """Nominations that arrive as JSON files."""
    return spark.readStream.schema(NOMINATION).json(where)


def collect_evidence(stream: DataFrame, store: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Append unseen keys to the store, stamped with the day; one pass over what has arrived.

    Seen keys live in the query's state, so a later run emits only new ones.
    Without a watermark the state grows with the number of distinct keys.
    """
    fresh = keyed(stream).dropDuplicates(["key"]).withColumn("first_seen", F.lit(as_of).cast("date"))
    return fresh.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def collect_against_store(stream: DataFrame, store: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """The same with the store itself as memory: each batch is held against it, so no state is kept.

    A batch has a folder of its own in the store, named by its number and the
    checkpoint's path; one that is tried again replaces what it left.
    """
    mark = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = keyed(batch).dropDuplicates(["key"]).withColumn("first_seen", F.lit(as_of).cast("date"))
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.parquet(store)
            known = (known.where(F.col("batch") != f"{mark}-{number}") if "batch" in known.columns else known).select("key")
            new = new.join(known, "key", "left_anti")
        new.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={mark}-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, late: str = "1 hour", width: str = "7 days") -> DataFrame:
    """Tumbling counts by key; rows later than ``late`` are left out."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding_counts(stream: DataFrame, ts: str, key: str, late: str = "1 hour", width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Counts by key over windows that overlap; a row counts in each window that holds it."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width, step), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def idle_sessions(stream: DataFrame, key: str, ts: str, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that a gap ends, once the watermark has passed it."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.session_window("_at", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_streaks(stream: DataFrame, key: str, failed: str) -> DataFrame:
    """(key, streak, longest) after each batch: how many failures in a row a key stands at, and the most so far.

    A custom state for each key of two numbers; rows of a batch count in the
    order of their column ``seq``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for bad in rows[failed]:
            streak = streak + 1 if bad else 0
            longest = max(longest, streak)
        state.update((int(streak), int(longest)))
        yield pd.DataFrame({"key": [str(who[0])], "streak": [streak], "longest": [longest]})

    return stream.groupBy(key).applyInPandasWithState(step, "key string, streak long, longest long", "streak long, longest long", "update", GroupStateTimeout.NoTimeout)
