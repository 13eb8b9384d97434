"""Bounded frame history per session and map, as a stateful stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from waymark.operators import history as windows
from waymark.operators.history import FRAMES, fuse_windows

STATE = StructType([StructField("event_id", LongType()), StructField("value", DoubleType())])
OUTPUT = StructType([
    StructField("session", LongType()), StructField("map_key", StringType()), StructField("event_id", LongType()),
    StructField("n_frames", LongType()), StructField("mean_value", DoubleType()), StructField("history", StringType()),
])
FRAME = Row(*OUTPUT.fieldNames())
#: These processors need this state store; it is set for the session when a stream is defined.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: What a frame without an id is called.
NO_ID = -(2**63)


class LastFrames(StatefulProcessor):
    """Keeps the last ``n`` frames of a (session, map_key) and emits one estimate per frame.

    Most keys have a few frames in a micro-batch, so rows are folded as they are: a data frame per key would cost more than its rows.
    """

    def __init__(self, n: int = 5, ttl_ms: int | None = None):
        self.n = n
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", STATE, self.ttl_ms) if self.ttl_ms else handle.getListState("recent", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [(int(r[0]), float(r[1])) for r in self.recent.get()]
        # A micro-batch is bounded by the source's rate limit; its frames are put in time order, those without a time or an id last.
        new = sorted(
            ((r["micros"], r["event_id"], r["value"]) for r in rows),
            key=lambda f: (f[0] is None, f[0] or 0, f[1] is None, f[1] or 0),
        )
        frames = kept + [(NO_ID if i is None else i, float("nan") if v is None else v) for _, i, v in new]
        names = [str(i) for i, _ in frames]
        sums = list(accumulate((v for _, v in frames), initial=0.0))
        for end in range(len(kept) + 1, len(frames) + 1):
            start = max(end - self.n, 0)
            mean = (sums[end] - sums[start]) / (end - start)
            yield FRAME(key[0], key[1], frames[end - 1][0], end - start, None if mean != mean else mean, ",".join(names[start:end]))
        self.recent.put(frames[-self.n:])

    def close(self) -> None:
        pass


POSE_STATE = StructType([
    StructField("ts", TimestampType()), StructField("event_id", LongType()), StructField("map_key", StringType()), StructField("x", DoubleType()),
    StructField("y", DoubleType()), StructField("heading", DoubleType()), StructField("weight", DoubleType()),
])
POSE_OUTPUT = StructType([
    StructField("session", LongType()), StructField("ts", TimestampType()), StructField("event_id", LongType()), StructField("map_key", StringType()),
    StructField("late", BooleanType()), StructField("n_frames", LongType()), StructField("pairs", LongType()),
    StructField("est_x", DoubleType()), StructField("est_y", DoubleType()), StructField("est_heading", DoubleType()),
])


class PoseHistory(StatefulProcessor):
    """Keeps the last ``n`` frames of a session and emits the pose fused over each frame's history on its map.

    Frames are ordered by time and id, across micro-batches too. A history begins anew where the map changes or after ``idle_s`` seconds
    without a frame; a timer on event time also frees the state of a session that stays idle. A late frame (older than a frame
    already answered, but not behind the watermark, where the engine drops it) is answered from the held frames before it and kept in its place.
    """

    def __init__(self, n: int = FRAMES, idle_s: int = 3600):
        self.n, self.idle_s = n, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("frames", POSE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in POSE_STATE.fields]
        held = pd.DataFrame([tuple(r) for r in self.recent.get()], columns=names)
        new = pd.concat(list(rows))[names]
        new = new[~new["event_id"].isin(held["event_id"])]
        frames = pd.concat([held.assign(old=True), new.assign(old=False)] if len(held) else [new.assign(old=False)])
        frames = frames.sort_values(["ts", "event_id"], ignore_index=True)
        ts = frames["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        first = np.ones(len(frames), bool)
        first[1:] = (frames["map_key"].to_numpy()[1:] != frames["map_key"].to_numpy()[:-1]) | (np.diff(ts) > self.idle_s * 1_000_000)
        run = np.cumsum(first)
        # Each frame's window: itself and the n - 1 rows before it, as far as they are of its history.
        at = np.arange(len(frames))[:, None] + np.arange(1 - self.n, 1)
        inside = (at >= 0) & (run[np.maximum(at, 0)] == run[:, None])
        cells = [np.where(inside, frames[c].to_numpy().astype(float)[np.maximum(at, 0)], np.nan) for c in ("x", "y", "heading", "weight")]
        count, x, y, heading = fuse_windows(*cells)
        out = frames.assign(session=key[0], n_frames=count, pairs=np.nansum(cells[3], axis=1).astype(np.int64), est_x=x, est_y=y, est_heading=heading)
        newest = held["ts"].max() if len(held) else None
        out["late"] = False if newest is None else out["ts"] < newest
        keep = frames[names].tail(self.n)
        self.recent.put([tuple(r) for r in keep.itertuples(index=False)])
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(ts[-1] // 1000) + self.idle_s * 1000)
        yield out.loc[~out["old"].astype(bool), [f.name for f in POSE_OUTPUT.fields]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame(columns=[f.name for f in POSE_OUTPUT.fields])

    def close(self) -> None:
        pass


def pose_history_stream(frames: DataFrame, n: int = FRAMES, idle_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """``frames``: streaming session, ts, event_id, map_key, x, y, heading, weight -> one estimate a frame (append mode).

    Frames more than ``late`` behind the newest of all are dropped by the watermark, which the engine moves between micro-batches.
    """
    frames.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return frames.withWatermark("ts", late).groupBy("session").transformWithStateInPandas(
        statefulProcessor=PoseHistory(n, idle_s), outputStructType=POSE_OUTPUT, outputMode="Append", timeMode="EventTime",
    )


def last_frames_stream(frames: DataFrame, n: int = 5, ttl_ms: int | None = None) -> DataFrame:
    """``frames``: streaming session, map_key, event_id, ts, value -> estimates (append mode)."""
    frames.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = frames.select("session", "map_key", "event_id", F.unix_micros("ts").alias("micros"), "value")
    return rows.groupBy("session", "map_key").transformWithState(
        statefulProcessor=LastFrames(n, ttl_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


# State servers start their own Python workers, which do not see files added to the
# context: the processor travels with its code instead of by module name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(windows)
