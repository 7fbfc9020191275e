"""Sessions of a stream by timers: state for each key, open sessions only, late rows counted aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: kind is session or late; a late row counts once, in the batch that brings it.
SESSION = "key string, kind string, start long, last long, n long"


class OpenSessions(StatefulProcessor):
    """What a key has open: (start, last, n) of sessions that may still grow, in milliseconds.

    Rows come in any order.  Two are of one session where less than ``gap``
    lies between them, directly or by way of others.  A session ends when the
    watermark reaches its last row plus the gap: a timer stands there, gives it
    away and drops it, so that a key without open sessions holds nothing.  A row
    at or before the watermark is late: its session may be gone.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start array<long>, last array<long>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        before = self._held()
        spans, late = before, []
        for frame in rows:
            ms = np.sort(frame["ms"].to_numpy())
            late.append(ms[ms <= mark])
            ms = ms[ms > mark]
            if len(ms):
                cut = np.flatnonzero(np.diff(ms) >= self.gap) + 1
                spans = self._joined(spans + [(int(p[0]), int(p[-1]), len(p)) for p in np.split(ms, cut)])
        if spans != before:
            self._hold(spans)
        late = np.concatenate(late) if late else np.zeros(0, np.int64)
        if len(late):
            yield self._told(key, [("late", int(late.min()), int(late.max()), len(late))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        spans = self._held()
        ended = [s for s in spans if s[1] + self.gap <= at or s[1] + self.gap < mark]
        if ended:  # a timer of a session that has grown since, or has gone, finds nothing
            self._hold([s for s in spans if s not in ended])
            yield self._told(key, [("session", *s) for s in ended])

    def _held(self) -> list[tuple[int, int, int]]:
        """Open sessions by their start."""
        state = self.open.get()
        return [] if state is None else [tuple(map(int, s)) for s in zip(*state, strict=True)]

    def _hold(self, spans: list[tuple[int, int, int]]) -> None:
        """Keep these, with a timer for the one that ends first."""
        if spans:
            self.open.update(tuple(map(list, zip(*spans, strict=True))))
            self.handle.registerTimer(min(last for _, last, _ in spans) + self.gap)
        else:
            self.open.clear()

    def close(self) -> None:
        pass

    def _joined(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for start, last, n in sorted(spans):
            if out and start - out[-1][1] < self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((start, last, n))
        return out

    @staticmethod
    def _told(key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), *r) for r in rows], columns=["key", "kind", "start", "last", "n"])


def timed_sessions(stream: DataFrame, key: str, ts: str, late: str = "1 hour", gap_ms: int = 1_800_000) -> DataFrame:
    """(key, kind, start, last, n): ended sessions, and counts of rows that came after the watermark; times in milliseconds.

    Rows with a null key or time are left out.
    """
    timed = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    rows = timed.select("key", F.unix_millis("at").alias("ms"))  # without the time itself: else late rows are dropped before the state sees them
    return rows.groupBy("key").transformWithStateInPandas(OpenSessions(gap_ms), SESSION, "Append", "EventTime")


def collect_sessions(spark: SparkSession, stream: DataFrame, store: str, checkpoint: str, key: str, ts: str, late: str = "1 hour", gap_ms: int = 1_800_000) -> StreamingQuery:
    """One pass over what has arrived, appended to ``store``; the next pass with this checkpoint goes on from its state and watermark.

    The state needs the RocksDB store, which the session is set to.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = timed_sessions(stream, key, ts, late, gap_ms)
    return found.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
