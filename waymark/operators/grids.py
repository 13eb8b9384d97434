"""Morphology on sparse grids: a grid is the set of its set cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def kernel(side: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic kernel of an odd side: each line reaches as far as the ellipse, rounded half to even."""
    if side < 1 or side % 2 == 0:
        raise ValueError(f"a kernel side is odd, not {side}")
    r = side // 2
    reach = {dz: round(r * math.sqrt(1 - dz * dz / (r * r))) if r else 0 for dz in range(-r, r + 1)}
    return [(dx, dz) for dz, far in reach.items() for dx in range(-far, far + 1)]


def kernel_for(res: float, metres: float = 0.2) -> int:
    """Odd kernel side for a closing distance."""
    side = int(metres / res)
    return side + 1 if side % 2 == 0 else side


def _spread(cells: DataFrame, side: int) -> DataFrame:
    moves = F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gz") + dz).alias("gz")) for dx, dz in kernel(side)])
    rest = [c for c in cells.columns if c not in ("gx", "gz")]
    return cells.select(*rest, F.explode(moves).alias("_m")).select(*rest, "_m.gx", "_m.gz")


def dilate(cells: DataFrame, side: int) -> DataFrame:
    return _spread(cells.select("gx", "gz"), side).distinct()


def erode(cells: DataFrame, side: int) -> DataFrame:
    """Cells whose whole kernel is set; beyond the rim counts as set only through padding."""
    hits = _spread(cells.select("gx", "gz"), side).groupBy("gx", "gz").agg(F.count("*").alias("_k"))
    return hits.filter(F.col("_k") == len(kernel(side))).select("gx", "gz")


def close_open(cells: DataFrame, side: int, open_side: int = 3) -> DataFrame:
    """gx, gz, kept: cells after closing, and whether they survive the following opening.

    Closed cells lie within the bounding box of the set ones, so no canvas size is needed.
    """
    closed = erode(dilate(cells, side), side)
    opened = dilate(erode(closed, open_side), open_side).withColumn("_o", F.lit(True))
    return closed.join(opened, ["gx", "gz"], "full_outer").select("gx", "gz", F.col("_o").isNotNull().alias("kept"))


def fill_colours(cells: DataFrame, closed: DataFrame, colours=("r", "g", "b"), side: int = 3) -> DataFrame:
    """Brightest neighbouring colour for every closed cell."""
    grown = _spread(cells.select("gx", "gz", *colours), side).groupBy("gx", "gz").agg(*[F.max(c).alias(c) for c in colours])
    return closed.select("gx", "gz").join(grown, ["gx", "gz"], "left").select(
        "gx", "gz", *[F.coalesce(c, F.lit(0)).alias(c) for c in colours]
    )


def stamp(centres: DataFrame, x: str, z: str, res: float, width: float = 0.9, depth: float = 0.3) -> DataFrame:
    """Cells of a fixed rectangle around each centre (grid origin at 0)."""
    half_w, half_h = int(width / res) // 2, int(depth / res) // 2
    at = centres.withColumns({"_gx": (F.col(x) / res).cast("long"), "_gz": (F.col(z) / res).cast("long")})
    cols = F.explode(F.sequence(F.col("_gx") - half_w, F.col("_gx") + half_w - 1)).alias("gx")
    lines = F.explode(F.sequence(F.col("_gz") - half_h, F.col("_gz") + half_h - 1)).alias("gz")
    return at.select("*", cols).select("*", lines).drop("_gx", "_gz")
