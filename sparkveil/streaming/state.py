"""Structured Streaming forms of the keyed state.

State is per key and expires by event time, so it is bounded by the keys that were
active within the time to live.  A cap over all keys (least recently used) cannot
be kept by partitioned state and is left out.  Events of one key within a batch
apply in order of time; the watermark decides what is too late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    held = list(frames)
    return (pd.concat(held) if held else pd.DataFrame({"event_id": [], "us": []})).sort_values(["us", "event_id"])


def _events(events: DataFrame, key: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", F.col(key).alias("k"), ts.alias("ts"), F.unix_micros(ts).alias("us")).withWatermark("ts", LATE)


def session_steps(events: DataFrame, key: str = "user_id", ttl: int = 1800) -> DataFrame:
    """(event_id, k, step): a key's step restarts after more than ``ttl`` idle seconds."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, step = state.get if state.exists else (None, 0)
        rows = _ordered(frames)
        steps = []
        for us in rows["us"].tolist():
            step = 1 if last is None or us - last > ttl * 1_000_000 else step + 1
            last = us if last is None else max(last, us)
            steps.append(step)
        if last is not None:
            state.update((last, step))
            state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"].astype("int64"), "k": k[0], "step": pd.Series(steps, rows.index, dtype="int64")})

    return _events(events, key).groupBy("k").applyInPandasWithState(run, "event_id long, k long, step long", "last long, step long", "append", GroupStateTimeout.EventTimeTimeout)


def nonce_replay(events: DataFrame, key: str = "user_id", seconds: int = 60) -> DataFrame:
    """(event_id, k, accepted): rejected within ``seconds`` of the last accepted use."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor = state.get[0] if state.exists else None
        rows = _ordered(frames)
        out = []
        for us in rows["us"].tolist():
            good = anchor is None or us - anchor > seconds * 1_000_000
            anchor = us if good else anchor
            out.append(good)
        if anchor is not None:
            state.update((anchor,))
            state.setTimeoutTimestamp(max(anchor // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"].astype("int64"), "k": k[0], "accepted": pd.Series(out, rows.index, dtype="bool")})

    return _events(events, key).groupBy("k").applyInPandasWithState(run, "event_id long, k long, accepted boolean", "anchor long", "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(events: DataFrame, key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Steps by session window, without Python."""
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col(key).alias("k"), ts.alias("ts")).withWatermark("ts", LATE).groupBy("k", F.session_window("ts", gap)).agg(F.count("*").alias("steps"))


def event_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by type and time window; late data beyond the watermark is dropped."""
    ts = F.col("ts").cast("timestamp")
    return events.select("event_type", ts.alias("ts")).withWatermark("ts", LATE).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))


def fresh(requests: DataFrame, ts: str = "ts", now=None, seconds: int = 60) -> DataFrame:
    """Requests whose time is within ``seconds`` of now."""
    now = F.current_timestamp() if now is None else now
    return requests.where(F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(now)) <= seconds * 1_000_000)


def to_sink(stream: DataFrame, send, checkpoint: str):
    """Hand each micro-batch's JSON payloads to ``send`` (S14); runs until what is there has been read."""
    out = stream.select(F.to_json(F.struct("*")).alias("payload"))
    return out.writeStream.foreachBatch(lambda batch, epoch: send(batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
