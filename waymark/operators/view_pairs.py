"""Candidate image pairs from view names and poses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.cells import near_join

ROT = [f"r{i}" for i in range(9)]


def pose_pairs(
    views: DataFrame, near: float = 0.01, angle: float = 10.0, fov: float = 90.0, yaws: int = 18
) -> DataFrame:
    """Pairs (a < b) of views that are neighbours on one keyframe or close in pose, with overlapping view.

    ``views``: view LONG, kf, pitch, yaw, x, y, z (camera position) and r0..r8 (world to
    camera). Positions are joined once per keyframe and spot; views follow by equi-join.
    """
    c = F.col
    cols = ["view", "kf", "pitch", "yaw", "x", "y", "z", *ROT]
    a = views.select(*[c(n).alias(f"a_{n}") for n in cols])
    b = views.select(*[c(n).alias(f"b_{n}") for n in cols])
    step = 360.0 / yaws
    # Same keyframe: the group is one keyframe's slices (yaws x pitches).
    turn = F.abs(F.pmod((c("a_yaw") - c("b_yaw")) * step + 180.0, F.lit(360.0)) - 180.0)
    same = a.join(b, (c("a_kf") == c("b_kf")) & (c("a_view") < c("b_view"))).filter(
        (F.abs(c("a_pitch") - c("b_pitch")) <= 1) & (turn <= step)
    )
    spots = views.select("kf", "x", "y", "z").distinct()
    left = spots.select(*[c(n).alias(f"a_{n}") for n in ("kf", "x", "y", "z")])
    right = spots.select(*[c(n).alias(f"b_{n}") for n in ("kf", "x", "y", "z")])
    close = near_join(left, right, [], ["a_x", "a_y", "a_z"], ["b_x", "b_y", "b_z"], near).filter(c("_d") < near).drop("_d")
    at = ["kf", "x", "y", "z"]
    posed = close.join(a, [f"a_{n}" for n in at]).join(b, [f"b_{n}" for n in at]).filter(c("a_view") < c("b_view"))
    # Trace of the relative rotation.
    trace = sum((c(f"a_{r}") * c(f"b_{r}") for r in ROT[1:]), c("a_r0") * c("b_r0"))
    rel = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    posed = posed.filter(rel < angle)
    both = same.select(*a.columns, *b.columns).unionByName(posed.select(*a.columns, *b.columns))
    ahead = sum((c(f"a_r{i}") * c(f"b_r{i}") for i in (7, 8)), c("a_r6") * c("b_r6"))
    return both.filter(ahead >= math.cos(math.radians(fov / 2))).select(c("a_view").alias("a"), c("b_view").alias("b")).distinct()
