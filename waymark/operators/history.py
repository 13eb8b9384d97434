"""A pose fused over a session's last frames on one map.

Frames of a session are put in order of time and id. A frame's history begins anew where the map changes or the session was idle too long; its
estimate fuses the poses of the last frames of that history, each weighted by its number of correspondences. The fusion
works on whole arrays of windows, so batch jobs and stream state share it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.frames import ORDER
from waymark.operators.ranks import overlapped
from waymark.session import cut_lineage

FRAMES = 5
ESTIMATE = "n_frames long, pairs long, est_x double, est_y double, est_heading double"


def fuse_windows(x: np.ndarray, y: np.ndarray, heading: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Frames, weighted mean place and robust heading (degrees) of each row of ``x`` ..., whose cells outside the window are NaN.

    With three or more frames, headings 90 degrees or more from the circular median are left out; with fewer, the oldest
    frame's heading is taken. The oldest frame stands first.
    """
    inside = ~np.isnan(x)
    n = inside.sum(axis=1)
    w = np.where(inside, weight, 0.0)
    total = w.sum(axis=1)
    mx, my = np.where(inside, x * w, 0.0).sum(axis=1) / total, np.where(inside, y * w, 0.0).sum(axis=1) / total
    rad = np.radians(heading)
    s, c = np.where(inside, np.sin(rad), np.nan), np.where(inside, np.cos(rad), np.nan)
    anchor = np.arctan2(np.nanmedian(s, axis=1), np.nanmedian(c, axis=1))
    off = np.abs(np.mod(rad - anchor[:, None] + np.pi, 2 * np.pi) - np.pi)
    kept = inside & (off < np.pi / 2)
    ws, wc = np.where(kept, w * s, 0.0).sum(axis=1), np.where(kept, w * c, 0.0).sum(axis=1)
    mean = np.where(kept.any(axis=1), np.degrees(np.arctan2(ws, wc)), np.degrees(anchor))
    first = heading[np.arange(len(n)), inside.argmax(axis=1)] if len(n) else mean
    return n, mx, my, np.mod(np.where(n < 3, first, mean), 360.0)


def _estimates(rows: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """``names`` and the estimate of each row's ``window``, a list of (x, y, heading, weight), oldest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            offsets = np.asarray(lists.offsets)
            flat, size = lists.flatten(), np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)
            at = n - np.repeat(size, size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            cells = []
            for k in range(4):
                m = np.full((len(size), n), np.nan)
                m[row, at] = flat.field(k).to_numpy(zero_copy_only=False)
                cells.append(m)
            count, x, y, h = fuse_windows(*cells) if len(size) else (np.zeros(0, int), *[np.zeros(0)] * 3)
            pairs = np.nansum(cells[3], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count.astype(np.int64)), pa.array(pairs), pa.array(x), pa.array(y), pa.array(h)], names=[*names, "n_frames", "pairs", "est_x", "est_y", "est_heading"])

    kept = rows.select(*names, "window")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, {ESTIMATE}")


def pose_history(frames: DataFrame, keys: Sequence[str] = ("session",), n: int = FRAMES, idle: int | None = None, size: int = 50_000) -> DataFrame:
    """``frames`` with the estimate over the last ``n`` frames of each frame's history: n_frames, pairs, est_x, est_y, est_heading.

    ``frames``: the keys, ts, event_id, map_key, x, y, heading, weight (correspondences, positive). A history ends where the map changes or, with ``idle``,
    where more than that many seconds lie between two frames. Long sessions are cut into chunks that carry the frames they look back on.
    """
    names = list(frames.columns)
    rows = overlapped(frames, keys, ORDER, back=n, size=size)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER)
    last = F.lag("map_key").over(w)
    new = last.isNotNull() & (last != F.col("map_key"))
    if idle is not None:
        new = new | F.coalesce(F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") > idle, F.lit(False))
    rows = rows.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.collect_list(F.struct("x", "y", "heading", F.col("weight").cast("double").alias("weight"), "_run")).over(w.rowsBetween(-(n - 1), 0))
    rows = rows.withColumn("_seen", seen).filter(~F.col("_carry"))
    window = F.transform(F.filter("_seen", lambda s: s["_run"] == F.col("_run")), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["heading"].alias("heading"), s["weight"].alias("weight")))
    return _estimates(rows.select(*names, window.alias("window")), names, n)


def history_step(held: DataFrame, new: DataFrame, keys: Sequence[str] = ("session",), n: int = FRAMES, idle: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Estimates of ``new`` frames after those ``held``, and what to hold next: the last ``n`` frames of each session.

    Both have the columns of ``pose_history``. A late frame, older than frames already answered, is put in its place: its estimate uses the held frames
    before it, later estimates use it while it is among the last ``n``, and answers already given stand. A frame that is held already is not answered again.
    """
    fresh = new.join(held.select(*keys, "event_id"), [*keys, "event_id"], "left_anti")
    both = cut_lineage(held.withColumn("_old", F.lit(True)).unionByName(fresh.select(*held.columns).withColumn("_old", F.lit(False))))
    out = pose_history(both, keys, n, idle).filter(~F.col("_old")).drop("_old")
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ORDER])
    keep = both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r", "_old")
    return out, keep
