"""Ordered frame histories per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def positions(frames: DataFrame, dx: str = "dx", dy: str = "dy", keys: Sequence[str] = ("session",)) -> DataFrame:
    """Running sum of steps in frame order as x, z (a prefix scan: a session's frames spread over ranges)."""
    from waymark.operators.ranks import running

    return running(frames.withColumns({"x": F.col(dx), "z": F.col(dy)}), keys, ORDER, sums=("x", "z"))


def last_frames(frames: DataFrame, keys: Sequence[str], value: str, n: int = 5, size: int = 50_000) -> DataFrame:
    """Per frame: how many of the last ``n`` frames exist, their mean ``value`` and their ids in order."""
    from waymark.operators.ranks import overlapped

    rows = overlapped(frames, keys, ORDER, back=n - 1, size=size)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    out = rows.withColumns({
        "n_frames": F.count("*").over(w), "mean_value": F.avg(value).over(w), "history": F.collect_list("event_id").over(w),
    })
    return out.filter(~F.col("_carry")).drop("_chunk", "_carry", "_idx")


def camera_trail(frames: DataFrame, keys: Sequence[str], size: int = 50_000) -> DataFrame:
    """Segments from each frame's previous position to its own, with the frame's place in the trail.

    The trail shown at frame ``k`` is the segments numbered up to ``k``.
    """
    from waymark.operators.ranks import overlapped

    rows = overlapped(frames, keys, ORDER, back=1, size=size)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER)
    out = rows.withColumns({"from_x": F.lag("x").over(w), "from_z": F.lag("z").over(w)})
    return out.filter(~F.col("_carry") & F.col("from_x").isNotNull()).select(
        *keys, "event_id", F.col("_idx").alias("segment"), "from_x", "from_z", "x", "z"
    )
