"""Trend alerts over a stream: a vector of weekly counts for each series as state.

A series' state is a map from week to count. When the watermark passes the end of a week, a
timer lets the series judge the weeks that end there, by the same rule as
``series.trend_alerts`` of the rows before that instant; rows that come late but before the
watermark are counted in the week of their own time. A series sets the timer of its next week
as long as any of its weeks counts; after that its state is removed, and weeks older than
a judgement needs are removed as they age. State and timers live in the checkpoint.

Keys must not be null (such rows are left out, as the batch form does); a null time is left
out. Weeks end at midnight UTC, ``week_ends`` days after 1970-01-01 modulo 7.
"""

from __future__ import annotations

import datetime as dt
import statistics
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.exprs import MAD_SCALE, SEVERITY

WEEK_MS = 7 * 86_400_000
# RocksDB keeps state that grows with the number of series outside the heap
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def judged(counts: list[int], recent_weeks: int, min_z: float, min_recent: int) -> dict | None:
    """``counts``: newest week first. What ``series.trend_alerts`` says of them."""
    total, base = sum(counts[:recent_weeks]), [float(x) for x in counts[recent_weeks:]]
    median = statistics.median(base)
    mad = statistics.median(abs(x - median) for x in base)
    raw = (total / recent_weeks - median) / max(MAD_SCALE * mad, 1.0)
    z = float(Decimal(repr(raw)).quantize(Decimal("0.01"), ROUND_HALF_UP))  # as SQL's round
    if total < min_recent or z < min_z:
        return None
    severity = next((name for bound, name in SEVERITY if z >= bound), None)
    return {"recent_total": total, "median": median, "mad": mad, "z": z, "severity": severity, "weekly": counts[::-1]}


class WeeklyTrend(StatefulProcessor):
    def __init__(self, keys: list[str], baseline_weeks: int, recent_weeks: int, min_z: float, min_recent: int, week_ends: int):
        self.keys, self.weeks_kept, self.recent_weeks, self.min_z, self.min_recent = keys, baseline_weeks + recent_weeks, recent_weeks, min_z, min_recent
        self.shift = week_ends * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "week long", "n long")
        self.next = handle.getValueState("next", "ends long")

    def end_of(self, ms: int) -> int:
        """The end of the week that an instant lies in."""
        return (ms - self.shift) // WEEK_MS * WEEK_MS + WEEK_MS + self.shift

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            if part.empty:
                continue
            ends = (part["row_ms"].astype("int64")).map(self.end_of).value_counts()
            for end, n in ends.items():
                old = self.counts.getValue((int(end),)) if self.counts.containsKey((int(end),)) else (0,)
                self.counts.updateValue((int(end),), (int(old[0]) + int(n),))
                due = self.next.get()[0] if self.next.exists() else None
                if end > mark and (due is None or end < due):
                    if due is not None:
                        self.handle.deleteTimer(due)
                    self.next.update((int(end),))
                    self.handle.registerTimer(int(end))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, mark, out = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        known = {k[0]: v[0] for k, v in self.counts.iterator()}
        while end <= mark and known:
            counts = [known.get(end - i * WEEK_MS, 0) for i in range(self.weeks_kept)]
            if found := judged(counts, self.recent_weeks, self.min_z, self.min_recent):
                out.append(dict(zip(self.keys, key)) | {"week_end": dt.datetime.fromtimestamp(end / 1000, dt.timezone.utc).date()} | found)
            end += WEEK_MS
            for week in [w for w in known if w <= end - self.weeks_kept * WEEK_MS]:
                del known[week]
                self.counts.removeKey((week,))
        if known:
            self.next.update((end,))
            self.handle.registerTimer(end)
        else:
            self.next.clear()
            self.counts.clear()
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def streamed_alerts(stream: DataFrame, keys: list[str], ts: str, late: str = "14 days", baseline_weeks: int = 8, recent_weeks: int = 2, min_z: float = 2.5, min_recent: int = 5, week_ends: int = 0) -> DataFrame:
    """``keys, week_end`` (the day after the week's last) and the alert of each series at each
    week's end, once the watermark, ``late`` behind the newest time, has passed it."""
    rows = stream.dropna(subset=[*keys, ts]).withColumn("row_time", F.col(ts).cast("timestamp")).withWatermark("row_time", late)
    rows = rows.select(*keys, "row_time", F.unix_millis("row_time").alias("row_ms"))
    found = {"week_end": T.DateType(), "recent_total": T.LongType(), "median": T.DoubleType(), "mad": T.DoubleType(), "z": T.DoubleType(), "severity": T.StringType(), "weekly": T.ArrayType(T.LongType())}
    schema = T.StructType([*(T.StructField(k, stream.schema[k].dataType) for k in keys), *(T.StructField(k, v) for k, v in found.items())])
    made = WeeklyTrend(keys, baseline_weeks, recent_weeks, min_z, min_recent, week_ends)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=made, outputStructType=schema, outputMode="Append", timeMode="EventTime")
