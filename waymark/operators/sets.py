"""Set-like operators over pairs, floors and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g


def undirected(edges: DataFrame, a: str, b: str, lo: str, hi: str) -> DataFrame:
    """Each edge once whatever its direction."""
    return edges.select(F.least(a, b).alias(lo), F.greatest(a, b).alias(hi)).distinct()


def pair_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of candidate pairs, lower image first, self pairs and repeats dropped."""
    together = reduce(DataFrame.unionByName, parts)
    return undirected(together.filter(F.col("img1") != F.col("img2")), "img1", "img2", "img1", "img2")


def pending(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have input but no output yet."""
    return inputs.select(*keys).distinct().join(outputs.select(*keys).distinct(), list(keys), "left_anti")


def table_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], atol: float = 1e-8, rtol: float = 1e-5
) -> DataFrame:
    """Keys found on one side only or whose values differ beyond ``atol + rtol * |b|``."""
    keys = list(keys)
    left = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        close = F.abs(x - y) <= atol + rtol * F.abs(y)
        same = same & (F.coalesce(close, F.lit(False)) | (x.isNull() & y.isNull()))
    state = (
        F.when(F.col("_in_a").isNull(), "right only").when(F.col("_in_b").isNull(), "left only").when(~same, "differs")
    )
    return left.join(right, keys, "full_outer").select(*keys, state.alias("state")).filter(F.col("state").isNotNull())


def slice_views(keyframes: DataFrame, yaws: int, centre: g.Vec, rotation: g.Vec) -> DataFrame:
    """Each keyframe times ``yaws`` equal yaw steps, with the slice's world-to-camera pose.

    ``rotation`` is the keyframe's world-to-camera rotation, ``centre`` its position.
    """
    k = keyframes.select(
        "*", *[v.alias(f"_r{i}") for i, v in enumerate(rotation)], *[v.alias(f"_c{i}") for i, v in enumerate(centre)]
    )
    rows = k.withColumn("yaw_idx", F.explode(F.sequence(F.lit(0), F.lit(yaws - 1))))
    turn = g.transpose(g.rot_y(F.col("yaw_idx") * (360.0 / yaws)))
    rows = rows.select("*", *[v.alias(f"_y{i}") for i, v in enumerate(turn)])
    r = g.multiply([F.col(f"_y{i}") for i in range(9)], [F.col(f"_r{i}") for i in range(9)])
    rows = rows.select("*", *[v.alias(f"r{i}") for i, v in enumerate(r)])
    t = g.apply([F.col(f"r{i}") for i in range(9)], [F.col(f"_c{i}") for i in range(3)])
    rows = rows.select("*", *[(-v).alias(n) for v, n in zip(t, ("tx", "ty", "tz"))])
    return rows.drop(*[n for n in rows.columns if n.startswith("_")])
