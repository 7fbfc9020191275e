"""Kept sketches against exact figures, and sessions by timers over passes that come late and out of order."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tracewright.operators import sketches as S
from tracewright.streaming import timers as T


def rows(n=20_000, seed=3):
    rng = random.Random(seed)
    return [(rng.choice("aab"), rng.randint(0, 13), rng.choice([None, *[rng.randint(0, 4000)] * 20]), rng.choice([None, *[rng.gauss(50, 20)] * 20])) for _ in range(n)] + [("few", 3, 1, 1.0), ("few", 4, 1, 3.0), ("none", 1, None, None)]


def test_merged_sketches_hold_the_exact_figures(spark):
    data = rows()
    df = spark.createDataFrame(data, "kind string, day long, key long, number double")
    daily = S.sketches(df, ("kind", "day"), "key", "number")
    week = daily.withColumn("week", F.floor(F.col("day") / 7))
    for r in S.estimates(S.merged(week, ("kind", "week")), ("kind", "week"), (0.1, 0.5, 0.95)).collect():
        own = [x for x in data if x[0] == r["kind"] and x[1] // 7 == r["week"]]
        keys, numbers = {x[2] for x in own if x[2] is not None}, sorted(x[3] for x in own if x[3] is not None)
        assert r["rows"] == len(own) and r["distinct_low"] <= len(keys) <= r["distinct_high"]
        assert not keys or r["distinct_high"] - r["distinct_low"] <= 2 + 0.11 * len(keys)
        for p in (0.1, 0.5, 0.95):
            low, about, high = (r[f"p{p * 100:g}{x}"] for x in ("_low", "", "_high"))
            if numbers:
                assert low <= about <= high and numbers[0] <= low and high <= numbers[-1]
                assert len(numbers) < 100 or low <= numbers[int(p * (len(numbers) - 1))] <= high
            else:
                assert about is None


def test_minima_merge_to_the_sketch_of_all_rows(spark):
    data = rows()
    df = spark.createDataFrame(data, "kind string, day long, key long, number double")
    whole = {r["kind"]: r["minima"] for r in S.minima(df, ("kind",), "key", 64).collect()}
    parts = S.merged_minima(S.minima(df, ("kind", "day"), "key", 64), ("kind",), 64)
    assert {r["kind"]: r["minima"] for r in parts.collect()} == whole and set(whole) == {"a", "b", "few"}
    for r in S.minima_estimates(parts, ("kind",), 64).collect():
        keys = {x[2] for x in data if x[0] == r["kind"] and x[2] is not None}
        assert r["distinct_low"] <= len(keys) <= r["distinct_high"] and (r["kept"] == 64 or r["distinct"] == len(keys))
    by = {k: {x[2] for x in data if x[0] == k and x[2] is not None} for k in "ab"}
    both = parts.where("kind = 'a'").select(F.col("minima").alias("x")).crossJoin(parts.where("kind = 'b'").select(F.col("minima").alias("y")))
    assert abs(both.select(S.shared_keys(F.col("x"), F.col("y"), 64)).first()[0] - len(by["a"] & by["b"]) / len(by["a"] | by["b"])) < 0.25


def plain_sessions(passes, gap, late):
    """What the stream gives, by going through the passes: sessions that the last watermark has ended, and late rows."""
    mark, accepted, lates = 0, defaultdict(list), defaultdict(list)
    marks = []
    for batch in passes:
        marks.append(mark)
        for key, s in batch:
            (lates if s <= mark else accepted)[key].append(s)
        mark = max([mark, *(s - late for _, s in batch)])
    out = []
    for key, times in accepted.items():
        times.sort()
        group = [times[0]]
        for s in [*times[1:], None]:
            if s is None or s - group[-1] >= gap:
                if group[-1] + gap < mark:
                    out.append((key, "session", group[0], group[-1], len(group)))
                group = []
            group.append(s)
    return sorted(out), {k: len(v) for k, v in lates.items()}


def test_sessions_by_timers(spark, tmp_path):
    rng = random.Random(7)
    hour = 3600
    passes = [[(rng.choice("abc"), 10**6 + rng.randint(a, b) * 60) for _ in range(60)] for a, b in ((0, 2000), (500, 4000), (0, 6000), (7000, 7100))]
    want, late = plain_sessions(passes, 2 * hour, 6 * hour)
    inbox, store, mark = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for batch in passes:
        df = spark.createDataFrame([(k, s) for k, s in batch] + [(None, 5), ("x", None)], "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
        df.write.mode("append").parquet(inbox)
        T.collect_sessions(spark, spark.readStream.schema(df.schema).parquet(inbox), store, mark, "who", "ts", "6 hours", 2 * hour * 1000).awaitTermination()
    got = spark.read.parquet(store).collect()
    assert sorted((r["key"], r["kind"], r["start"] // 1000, r["last"] // 1000, r["n"]) for r in got if r["kind"] == "session") == want
    counted = defaultdict(int)
    for r in got:
        if r["kind"] == "late":
            counted[r["key"]] += r["n"]
    assert dict(counted) == late and late
