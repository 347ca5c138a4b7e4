"""Structured Streaming twins of the event-log operators.

Windowed and aggregating twins use built-in operators with watermarks; those that remember per key (one-hour impression
de-duplication, last-touch credit, stance reversal) use keyed state with a time-out, so state is dropped once it can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def visits(stream: DataFrame, owner: str, at: str, gap_minutes: float, late: str = "1 hour") -> DataFrame:
    """Visits by session window. A pause of exactly the gap begins a new visit, so the window's gap is a microsecond less."""
    gap = f"{int(gap_minutes * 60e6) - 1} microseconds"
    s = stream.withWatermark(at, late).groupBy(owner, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.min(at).alias("started"), F.max(at).alias("last"))
    return s.select(owner, "started", "last", "events")


def running_mean(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.avg(value).alias("weight"), F.count("*").alias("n"))


def distinct_events(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(["ts", "key"], kind="stable")


def impressions_deduped(stream: DataFrame, hours: float, late: str = "1 hour") -> DataFrame:
    """(owner, item, key) of impressions `hours` or more after the last one kept. stream: owner long, item long, ts timestamp, key long."""
    span = int(hours * 3600e6)

    def step(group, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for t, key in zip(*(lambda r: ((r["ts"].astype("int64") // 1000).tolist(), r["key"].tolist()))(_micro(_ordered(frames)))):
            if last is None or t - last >= span:
                last = t
                out.append((group[0], group[1], key))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + span // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["owner", "item", "key"])

    return stream.withWatermark("ts", late).groupBy("owner", "item").applyInPandasWithState(step, "owner long, item long, key long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def _micro(rows: pd.DataFrame) -> pd.DataFrame:
    rows["ts"] = rows["ts"].astype("datetime64[ns]")
    return rows


def last_touch(stream: DataFrame, within_hours: float, late: str = "1 hour") -> DataFrame:
    """(click, impression) as clicks arrive. stream: owner, item, ts, key, is_click (0 impression, 1 click)."""
    span = int(within_hours * 3600e6)

    def step(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None)
        rows = _micro(pd.concat(list(frames), ignore_index=True).sort_values(["ts", "is_click", "key"], kind="stable"))
        out = []
        for t, click, key in zip((rows["ts"].astype("int64") // 1000).tolist(), rows["is_click"].tolist(), rows["key"].tolist()):
            if not click:
                last = (key, t)
            elif last[0] is not None and t - last[1] <= span:
                out.append((key, last[0]))
        if last[0] is not None:
            state.update(last)
            state.setTimeoutTimestamp(max((last[1] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["click", "impression"])

    return stream.withWatermark("ts", late).groupBy("owner", "item").applyInPandasWithState(step, "click long, impression long", "key long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def stance_changes(stream: DataFrame) -> DataFrame:
    """(key, stance, was, delta) as stances arrive. stream: owner, item, ts, key, stance int."""

    def step(group, frames, state: GroupState):
        was = state.get[0] if state.exists else 0
        out = []
        for key, stance in zip(*(lambda r: (r["key"].tolist(), r["stance"].tolist()))(_ordered(frames))):
            out.append((key, stance, was, stance - was))
            was = stance
        state.update((was,))
        yield pd.DataFrame(out, columns=["key", "stance", "was", "delta"])

    return stream.groupBy("owner", "item").applyInPandasWithState(step, "key long, stance int, was int, delta int", "stance int", "append", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, path: str, keys: list[str], at: str, checkpoint: str):
    """Last write wins into a Parquet table, batch by batch; run with availableNow."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p)) if fs.exists(p) else []
        older = [v for v in versions if v < number]
        every = batch.unionByName(spark.read.parquet(f"{path}/v{older[-1]}")) if older else batch
        latest = every.groupBy(*keys).agg(F.max_by(F.struct(*every.columns), at).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
