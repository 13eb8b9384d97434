"""Point-cloud statistics, filters and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import quantiles, with_row


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Put per-group statistics on every row. Without keys the statistics are one row."""
    if keys:
        return df.join(stats, list(keys))
    return with_row(df, stats)


def bounds(points: DataFrame, axes: Sequence[str], keys: Sequence[str] = (), pad: float = 0.0) -> DataFrame:
    aggs = []
    for a in axes:
        aggs += [(F.min(a) - pad).alias(f"{a}_min"), (F.max(a) + pad).alias(f"{a}_max")]
    return points.groupBy(*keys).agg(*aggs)


def unit_square(points: DataFrame, frame: DataFrame, x: str = "x", z: str = "z") -> DataFrame:
    """u, v in [0, 1] within the frame; 0.5 on an axis without extent."""

    def scaled(axis: str) -> Column:
        lo, hi = F.col(f"{axis}_min"), F.col(f"{axis}_max")
        return F.when(hi > lo, (F.col(axis) - lo) / (hi - lo)).otherwise(F.lit(0.5))

    return attach(points, frame).withColumns({"u": scaled(x), "v": scaled(z)})


def height_band(points: DataFrame, value: str = "y", keys: Sequence[str] = (), width: float = 2.0) -> DataFrame:
    """Points strictly within median +/- ``width`` population deviations, per group."""
    mid = quantiles(points, keys, value, {"_mid": 0.5})
    dev = points.groupBy(*keys).agg(F.stddev_pop(value).alias("_dev"))
    banded = attach(attach(points, mid, keys), dev, keys)
    gap = F.col("_dev") * width
    return banded.filter((F.col(value) > F.col("_mid") - gap) & (F.col(value) < F.col("_mid") + gap)).drop("_mid", "_dev")


def percentile_band(points: DataFrame, value: str, lo: float, hi: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points between two exact percentiles, ends included."""
    band = quantiles(points, keys, value, {"_lo": lo, "_hi": hi})
    return attach(points, band, keys).filter(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def trim_axes(points: DataFrame, axes: Sequence[str], share: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points inside the central share of every axis; all bounds come from the untrimmed cloud."""
    # All axes at once: one row per point and axis, quantiled by axis.
    long = points.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in axes])).alias("s")
    ).select(*keys, "s.axis", "s.v")
    band = quantiles(long, [*keys, "axis"], "v", {"lo": share, "hi": 1 - share}).groupBy(*keys).agg(*[
        F.max(F.when(F.col("axis") == a, F.col(side))).alias(f"_{a}{i}") for a in axes for i, side in enumerate(("lo", "hi"))
    ])
    banded = attach(points, band, keys)
    keep = F.lit(True)
    for a in axes:
        keep = keep & F.col(a).between(F.col(f"_{a}0"), F.col(f"_{a}1"))
    return banded.filter(keep).select(*points.columns)


def centroid_outliers(points: DataFrame, k: float, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points closer to the centroid than ``k`` population deviations of that distance."""
    mean = points.groupBy(*keys).agg(*[F.avg(a).alias(f"_{a}") for a in axes])
    dist = F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"_{axes[0]}")) * (F.col(axes[0]) - F.col(f"_{axes[0]}"))))
    measured = attach(points, mean, keys).withColumn("dist", dist)
    dev = measured.groupBy(*keys).agg(F.stddev_pop("dist").alias("_dev"))
    return attach(measured, dev, keys).filter(F.col("dist") < F.col("_dev") * k).select(*points.columns, "dist")


def cell(value: Column, origin: Column, res: float) -> Column:
    """Grid index, truncated towards zero."""
    return ((value - origin) / res).cast("long")


def grid_frame(points: DataFrame, res: float, pad: float = 0.5, axes: Sequence[str] = ("x", "z"), keys: Sequence[str] = ()) -> DataFrame:
    """Padded bounds with the grid's width and height in cells."""
    a, b = axes
    return bounds(points, axes, keys, pad).withColumns({
        "grid_w": ((F.col(f"{a}_max") - F.col(f"{a}_min")) / res).cast("long"),
        "grid_h": ((F.col(f"{b}_max") - F.col(f"{b}_min")) / res).cast("long"),
    })


def occupancy(points: DataFrame, frame: DataFrame, res: float, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "z"), colours: Sequence[str] = ("r", "g", "b"), clip: bool = False) -> DataFrame:
    """Occupied cells: point count and mean colour truncated to whole numbers.

    Points outside the grid are dropped, or moved to its rim with ``clip``.
    """
    a, b = axes
    placed = attach(points, frame, keys).withColumns({
        "gx": cell(F.col(a), F.col(f"{a}_min"), res), "gz": cell(F.col(b), F.col(f"{b}_min"), res),
    })
    if clip:
        placed = placed.withColumns({
            "gx": F.greatest(F.lit(0), F.least(F.col("grid_w") - 1, F.col("gx"))),
            "gz": F.greatest(F.lit(0), F.least(F.col("grid_h") - 1, F.col("gz"))),
        })
    else:
        placed = placed.filter(F.col("gx").between(0, F.col("grid_w") - 1) & F.col("gz").between(0, F.col("grid_h") - 1))
    return placed.groupBy(*keys, "gx", "gz").agg(
        F.count("*").alias("n"), *[F.avg(x).cast("long").alias(x) for x in colours]
    )


def topdown_frame(points: DataFrame, size: int, pad: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Square frame around the padded bounds: x0, z1 (top) and cell size."""
    f = bounds(points, ["x", "z"], keys)
    rx = F.greatest(F.col("x_max") - F.col("x_min"), F.lit(0.1))
    rz = F.greatest(F.col("z_max") - F.col("z_min"), F.lit(0.1))
    f = f.withColumns({
        "_x0": F.col("x_min") - rx * pad, "_x1": F.col("x_max") + rx * pad,
        "_z0": F.col("z_min") - rz * pad, "_z1": F.col("z_max") + rz * pad,
    })
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_z1") - F.col("_z0"))
    return f.select(
        *keys, ((F.col("_x0") + F.col("_x1")) / 2 - side / 2).alias("x0"),
        ((F.col("_z0") + F.col("_z1")) / 2 + side / 2).alias("z1"), (side / size).alias("res"),
    )


def topdown_raster(points: DataFrame, size: int, order: Sequence[str], colours: Sequence[str] = ("r", "g", "b"), pad: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed square canvas; the last point in ``order`` colours its pixel."""
    f = attach(points, topdown_frame(points, size, pad, keys), keys)

    def clipped(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), value.cast("long")))

    placed = f.withColumns({
        "px": clipped((F.col("x") - F.col("x0")) / F.col("res")), "pz": clipped((F.col("z1") - F.col("z")) / F.col("res")),
    })
    last = F.max_by(F.struct(*colours), F.struct(*order))
    return placed.groupBy(*keys, "px", "pz").agg(last.alias("_c")).select(*keys, "px", "pz", "_c.*")


def range_metadata(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """count, min, max and mean per axis for every group and, as null keys, the totals."""
    aggs = [F.count("*").alias("n")]
    for a in axes:
        aggs += [F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max"), F.avg(a).alias(f"{a}_mean")]
    return points.rollup(*keys).agg(*aggs)


def covariance(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sample covariance of x, y, z per group as six columns."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.covar_samp(p[0], p[1]).alias(p) for p in pairs])


def smallest_axis(batches):
    """Unit eigenvector of the smallest eigenvalue, y >= 0, for rows of six covariances."""
    import numpy as np

    for pdf in batches:
        m = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
        _, vec = np.linalg.eigh(m)
        normal = vec[:, :, 0]
        normal = np.where(normal[:, 1:2] < 0, -normal, normal)
        yield pdf.assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2])


def plane_normal(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Floor normal per group, with the rotation that turns it onto +Y (nine columns).

    Rows reach Python only after aggregation: one per group.
    """
    cov = covariance(points, keys).filter(F.col("n") >= 3)
    types = {f.name: f.dataType.simpleString() for f in cov.schema.fields}
    schema = ", ".join(f"{n} {v}" for n, v in types.items()) + ", nx double, ny double, nz double"
    out = cov.mapInPandas(smallest_axis, schema).select(*keys, "n", "nx", "ny", "nz")
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    # v = n x Y = (-nz, 0, nx); R = I + [v] + [v]^2 (1 - c) / s^2, the identity when nearly aligned.
    k = (1 - ny) / (nz * nz + nx * nx + 1e-12)
    r = [
        1 - nx * nx * k, -nx, -nx * nz * k,
        nx, 1 - (nx * nx + nz * nz) * k, nz,
        -nx * nz * k, -nz, 1 - nz * nz * k,
    ]
    return out.select("*", *[
        F.when(ny > 0.9999, F.lit(1.0 if i % 4 == 0 else 0.0)).otherwise(v).alias(f"r{i}") for i, v in enumerate(r)
    ])


def track_lengths(observations: DataFrame, least: int = 3) -> DataFrame:
    """Landmarks seen at least ``least`` times, with how often and in how many images."""
    seen = observations.filter(F.col("point_id") >= 0)
    return seen.groupBy("point_id", "image").agg(F.count("*").alias("_c")).groupBy("point_id").agg(
        F.sum("_c").alias("track"), F.count("*").alias("images")
    ).filter(F.col("track") >= least)


def distinct_landmarks(observations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Distinct positions (single precision) of all observed landmarks."""
    seen = observations.select("point_id").distinct()
    return landmarks.join(seen, "point_id", "left_semi").select(
        *[F.col(a).cast("float").alias(a) for a in ("px", "py", "pz")]
    ).distinct()


def outcome_shares(rows: DataFrame, status: str) -> DataFrame:
    """Count per outcome and its share of all rows in percent."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return attach(counts, total).select(status, "n", (F.col("n") * 100.0 / F.col("_all")).alias("share"))


def coverage(cells: DataFrame, frame: DataFrame, approximate: bool = False) -> DataFrame:
    """Occupied cells and their share of the grid."""
    if approximate:
        used = cells.agg(F.approx_count_distinct(F.struct("gx", "gz")).alias("occupied"))
    else:
        used = cells.select("gx", "gz").distinct().agg(F.count("*").alias("occupied"))
    area = F.col("grid_w") * F.col("grid_h")
    return with_row(used, frame.select("grid_w", "grid_h")).select(
        "occupied", "grid_w", "grid_h", (F.col("occupied") * 100.0 / area).alias("percent")
    )


def grid_overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of either grid with where they are set."""
    left = a.select("gx", "gz").distinct().withColumn("_a", F.lit(1))
    right = b.select("gx", "gz").distinct().withColumn("_b", F.lit(1))
    where = F.when(F.col("_b").isNull(), "a only").when(F.col("_a").isNull(), "b only").otherwise("both")
    return left.join(right, ["gx", "gz"], "full_outer").select("gx", "gz", where.alias("where_set"))


def trajectory_normalize(frames: DataFrame, keys: Sequence[str], extent: float, x: str = "x", z: str = "z") -> DataFrame:
    """Centre on the mean position and scale the farthest frame to ``extent``."""
    mean = frames.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(z).alias("_mz"))
    centred = attach(frames, mean, keys).withColumns({"cx": F.col(x) - F.col("_mx"), "cz": F.col(z) - F.col("_mz")})
    reach = centred.groupBy(*keys).agg(F.max(F.sqrt(F.col("cx") * F.col("cx") + F.col("cz") * F.col("cz"))).alias("_far"))
    factor = F.when(F.col("_far") > 0, F.lit(float(extent)) / F.col("_far")).otherwise(F.lit(1.0))
    return attach(centred, reach, keys).withColumns({"nx": F.col("cx") * factor, "nz": F.col("cz") * factor}).drop(
        "_mx", "_mz", "_far", "cx", "cz"
    )


def masked_points(points: DataFrame, keyframes: DataFrame, masks: DataFrame, mask_size: tuple[int, int]) -> DataFrame:
    """Project each point into its keyframe's floor mask and classify it.

    ``keyframes``: kf, r0..r8, tx, ty, tz. ``masks``: kf, u, v of set pixels. Statuses:
    no_keyframe, no_mask, outside_mask, floor. Pixels are far more than the rows Spark may guess they come from (an exploded
    range counts as one row), so they are joined by a shuffle and never sent whole through the driver.
    """
    from waymark.functions import geometry as g

    w, h = mask_size
    posed = points.join(keyframes, "kf", "left")
    has = masks.select("kf").distinct().withColumn("_mask", F.lit(1))
    posed = posed.join(has, "kf", "left")
    p = [F.col(a) for a in ("x", "y", "z")]
    cam = [v + F.col(t) for v, t in zip(g.apply([F.col(f"r{i}") for i in range(9)], p), ("tx", "ty", "tz"))]
    posed = posed.select("*", *[v.alias(f"_c{i}") for i, v in enumerate(cam)])
    u, v = g.to_equirect([F.col(f"_c{i}") for i in range(3)], w, h)
    placed = posed.withColumns({"u": F.bround(u, 0).cast("long"), "v": F.bround(v, 0).cast("long")})
    hit = masks.select("kf", "u", "v").distinct().withColumn("_set", F.lit(1)).hint("merge")
    status = (
        F.when(F.col("r0").isNull(), "no_keyframe").when(F.col("_mask").isNull(), "no_mask")
        .when(F.col("_set").isNull(), "outside_mask").otherwise("floor")
    )
    return placed.join(hit, ["kf", "u", "v"], "left").withColumn("status", status).select(*points.columns, "u", "v", "status")


def running_band(points: DataFrame, frame: str, value: str, width: float = 2.0, fan: int = 16, size: int = 50_000) -> DataFrame:
    """For every frame: count, median, deviation and band of all points up to it.

    Counts, sums and squares are a prefix scan over per-frame aggregates. Medians descend a tree over the ranks of the
    distinct values, ``fan`` children a node: a scan per node counts the points up to each frame under each child, and every frame
    goes on to the child that holds its middle rank. A level reads only the nodes that some frame has reached, as one row a
    (node, frame), so neither a frame with many points nor a common value makes a long scan; scans run over chunks of ``size``
    frames and add the totals of the chunks before. Null values are left out; a frame that has only those has no row.
    """
    from waymark.operators.ranks import group_index, running
    from waymark.session import cut_lineage

    c = F.col
    # A negative zero and a zero are one value; the frame gets a name that cannot clash.
    plain = points.select(c(frame).alias("_f"), (c(value).cast("double") + 0.0).alias("_v")).filter(c("_v").isNotNull() & c("_f").isNotNull())
    counts = cut_lineage(plain.groupBy("_f", "_v").agg(F.count("*").alias("_c")))
    ranks = cut_lineage(group_index(counts.select("_v").distinct(), [], ["_v"], "_r"))
    per_frame = counts.groupBy("_f").agg(
        F.sum("_c").alias("_n"), F.sum(c("_c") * c("_v")).alias("_s"), F.sum(c("_c") * c("_v") * c("_v")).alias("_q"),
        F.lit(1).cast("long").alias("_no"),
    )
    totals = running(per_frame, [], ["_f"], sums=("_n", "_s", "_q", "_no"))
    totals = cut_lineage(totals.withColumn("_chunk", F.floor((c("_no") - 1) / size).cast("long")))
    counts = cut_lineage(counts.join(ranks, "_v").join(totals.select("_f", "_chunk"), "_f").select("_f", "_chunk", "_r", "_c"))
    middle = F.array(*[
        F.struct(F.lit(i).alias("side"), f((c("_n") - 1) / 2).cast("long").alias("k")) for i, f in enumerate((F.floor, F.ceil))
    ])
    want = totals.select("_f", "_chunk", F.explode(middle).alias("_m"))
    want = cut_lineage(want.select("_f", "_chunk", "_m.side", c("_m.k").alias("_k"), F.lit(0).cast("long").alias("_node")))
    top = ranks.agg(F.max("_r")).first()[0] or 0
    levels = 1
    while fan**levels <= top:
        levels += 1
    upto = [f"_u{j}" for j in range(fan)]
    scan = Window.partitionBy("_node", "_chunk").orderBy("_f").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_node").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(levels):
        child = F.floor(c("_r") / fan ** (levels - level - 1)).cast("long")
        under = counts.withColumns({"_node": F.floor(child / fan).cast("long"), "_child": child % fan})
        under = under.join(want.select("_node").distinct(), "_node", "left_semi")
        # Frames that ask stand beside those that have points, with none of their own.
        none = F.lit(0).cast("long")
        rows = under.select("_node", "_chunk", "_f", "_child", "_c").union(want.select("_node", "_chunk", "_f", none, none)).groupBy(
            "_node", "_chunk", "_f"
        ).agg(*[F.sum(F.when(c("_child") <= j, c("_c")).otherwise(0)).alias(u) for j, u in enumerate(upto)])
        inside = rows.select("_node", "_chunk", "_f", *[F.sum(u).over(scan).alias(u) for u in upto])
        earlier = rows.groupBy("_node", "_chunk").agg(*[F.sum(u).alias(u) for u in upto]).select(
            "_node", "_chunk", F.array(*[F.coalesce(F.sum(u).over(before), F.lit(0)) for u in upto]).alias("_b")
        )
        seen = inside.join(earlier, ["_node", "_chunk"]).select(
            "_node", "_f", F.array(*[c(u) + c("_b")[j] for j, u in enumerate(upto)]).alias("_u")
        )
        # A column of its own: beside a new _k, the lambda would read that one.
        placed = want.join(seen, ["_node", "_f"]).withColumn("_step", F.size(F.filter("_u", lambda u: u <= c("_k"))))
        passed = F.when(c("_step") > 0, F.element_at("_u", c("_step"))).otherwise(0)
        want = cut_lineage(placed.select("_f", "_chunk", "side", (c("_k") - passed).alias("_k"), (c("_node") * fan + c("_step")).alias("_node")))
    mid = want.join(ranks, c("_node") == c("_r")).groupBy("_f").agg(F.avg("_v").alias("median"))
    variance = F.greatest(F.lit(0.0), c("_q") / c("_n") - (c("_s") / c("_n")) * (c("_s") / c("_n")))
    dev = F.when(c("_n") > 1, F.sqrt(variance)).otherwise(F.lit(1.0))
    return totals.join(mid, "_f").select(
        c("_f").alias(frame), c("_n").alias("n"), "median", dev.alias("deviation"),
        (c("median") - dev * width).alias("band_lo"), (c("median") + dev * width).alias("band_hi"),
    )
