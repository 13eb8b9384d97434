"""Packed columns of a map database export (little-endian arrays) to typed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unpack(column: str, dtype: str, stride: int, keep: int):
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=[column])
            out["cells"] = [
                np.frombuffer(b, dtype=dtype).reshape(-1, stride)[:, :keep].astype("float64").tolist()
                for b in pdf[column]
            ]
            yield out

    return unpack


def unpack_rows(df: DataFrame, key: str, column: str, dtype: str, stride: int, keep: int | None = None) -> DataFrame:
    """Explode a packed array column to (key, idx, cells). One blob belongs to one keyframe."""
    keep = keep or stride
    schema = f"{key} {df.schema[key].dataType.simpleString()}, cells array<array<double>>"
    rows = df.select(key, column).mapInPandas(_unpack(column, dtype, stride, keep), schema)
    return rows.select(key, F.posexplode("cells").alias("idx", "cells"))


def keyframe_poses(df: DataFrame, layout: str = "row") -> DataFrame:
    """kf_id, pose: 16 doubles row-major, world to camera. ``layout`` says how the blob stores it."""
    cells = unpack_rows(df, "kf_id", "pose_cw", "<f8", 16).select("kf_id", F.col("cells").alias("m"))
    if layout == "row":
        return cells.select("kf_id", F.col("m").alias("pose"))
    order = [r + 4 * k for r in range(4) for k in range(4)]
    return cells.select("kf_id", F.array(*[F.col("m")[i] for i in order]).alias("pose"))


def keypoints(df: DataFrame) -> DataFrame:
    # Fixed value: seven floats per stored keypoint, the first two are x and y.
    rows = unpack_rows(df, "kf_id", "undist_keypts", "<f4", 7, 2)
    return rows.select(
        "kf_id", F.col("idx").cast("long").alias("kp_idx"), F.col("cells")[0].alias("x"), F.col("cells")[1].alias("y")
    )


def associations(df: DataFrame) -> DataFrame:
    rows = unpack_rows(df, "kf_id", "lm_ids", "<i4", 1)
    return rows.select(
        "kf_id", F.col("idx").cast("long").alias("kp_idx"), F.col("cells")[0].cast("long").alias("lm_id")
    ).filter(F.col("lm_id") >= 0)


def landmark_positions(df: DataFrame) -> DataFrame:
    rows = unpack_rows(df, "lm_id", "pos_w", "<f8", 3)
    return rows.select("lm_id", *[F.col("cells")[i].alias(n) for i, n in enumerate("xyz")])


def dense_points(df: DataFrame) -> DataFrame:
    """id, pos_w (3 doubles), color (3 bytes, blue first), ref_kf."""
    pos = unpack_rows(df, "id", "pos_w", "<f8", 3)
    col = unpack_rows(df, "id", "color", "u1", 3)
    a = pos.select("id", *[F.col("cells")[i].alias(n) for i, n in enumerate("xyz")])
    b = col.select("id", *[F.col("cells")[i].cast("short").alias(n) for i, n in enumerate("bgr")])
    return a.join(b, "id").join(df.select("id", "ref_kf"), "id")
