"""Streams over files that arrive in parts; each part is one batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewright.streaming import evidence as V

ROWS = [
    ("a", "2024-01-01T00:00:00", True), ("a", "2024-01-01T00:10:00", True), ("b", "2024-01-01T00:50:00", False), ("a", "2024-01-01T02:00:00", False),
    ("a", "2024-01-01T02:05:00", True), ("b", "2024-01-02T00:00:00", True), ("b", "2024-01-03T00:00:00", True),
]
SCHEMA = "seq long, who string, ts string, failed boolean"


@pytest.fixture
def arrived(spark, tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    for i, (who, ts, failed) in enumerate(ROWS):
        (where / f"{i}.json").write_text(json.dumps({"seq": i, "who": who, "ts": ts, "failed": failed}))
        os.utime(where / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(where))


def closed(spark, df, tmp_path):
    """What a query has written once it has met all files."""
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_windows_of_a_stream(spark, arrived, tmp_path):
    rows = closed(spark, V.windowed_counts(arrived(), "ts", "who", width="1 hour"), tmp_path).select(F.date_format("start", "dd HH"), "who", "n").collect()
    assert sorted(map(tuple, rows)) == [("01 00", "a", 2), ("01 00", "b", 1), ("01 02", "a", 2), ("02 00", "b", 1)]


def test_windows_that_overlap(spark, arrived, tmp_path):
    rows = closed(spark, V.sliding_counts(arrived(), "ts", "who", width="1 hour", step="30 minutes"), tmp_path).where("who = 'a'").select(F.date_format("start", "dd HH:mm"), "n").collect()
    assert sorted(map(tuple, rows)) == [("01 00:00", 2), ("01 01:30", 2), ("01 02:00", 2), ("31 23:30", 2)]


def test_sessions_that_a_gap_ends(spark, arrived, tmp_path):
    rows = closed(spark, V.idle_sessions(arrived(), "who", "ts"), tmp_path).select("who", F.date_format("start", "dd HH:mm"), "n").collect()
    assert sorted(map(tuple, rows)) == [("a", "01 00:00", 2), ("a", "01 02:00", 2), ("b", "01 00:50", 1), ("b", "02 00:00", 1)]


def test_streaks_are_carried_from_batch_to_batch(spark, arrived, tmp_path):
    seen = {}

    def keep(batch, _):
        seen.update({r["key"]: (r["streak"], r["longest"]) for r in batch.collect()})

    q = V.running_streaks(arrived(), "who", "failed").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {"a": (1, 2), "b": (2, 2)}


def test_a_batch_that_is_tried_again_replaces_what_it_left(spark, tmp_path):
    where, store = tmp_path / "in", str(tmp_path / "store")
    where.mkdir()
    row = {"source": "failure", "class": "c", "ts": "t", "session": "s", "line": 1}
    (where / "0.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"line": 2}))
    for progress in ("one", "one", "two"):  # the second finds nothing new, the third meets all rows again
        V.collect_against_store(V.nominations(spark, str(where)), store, str(tmp_path / progress), "2024-01-31").awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(store).collect()) == ["failure|c|s|L1", "failure|c|s|L2"]
