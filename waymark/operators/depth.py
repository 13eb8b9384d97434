"""Depth rasters as pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.clouds import attach
from waymark.operators.ranks import quantiles


def nearest_index(i: Column, target: int, source: int) -> Column:
    """Source index a nearest-neighbour resize reads for target index ``i``."""
    return F.least(F.floor(i * (source / target)), F.lit(source - 1))


def join_nearest(gt: DataFrame, pred: DataFrame, gt_size, pred_size, min_gt: float = 0.01) -> DataFrame:
    """Ground truth pixels with the prediction pixel a nearest resize would give them."""
    left = gt.filter(F.col("gt") > min_gt).withColumns({
        "_u": nearest_index(F.col("u"), gt_size[0], pred_size[0]),
        "_v": nearest_index(F.col("v"), gt_size[1], pred_size[1]),
    })
    right = pred.withColumnsRenamed({"u": "_u", "v": "_v"})
    return left.join(right, ["img", "_u", "_v"]).drop("_u", "_v")


def median_scale(px: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """Scale ``pred`` by median(gt)/median(pred) per group; groups with too few valid pixels keep it."""
    valid = px.filter((F.col("gt") > 0.01) & (F.col("pred") > 0.01))
    both = valid.select(*keys, F.explode(F.array(
        F.struct(F.lit("gt").alias("what"), F.col("gt").alias("d")), F.struct(F.lit("pred").alias("what"), F.col("pred").alias("d"))
    )).alias("s")).select(*keys, "s.what", "s.d")
    mid = quantiles(both, [*keys, "what"], "d", {"m": 0.5})
    scale = mid.groupBy(*keys).agg(
        (F.max(F.when(F.col("what") == "gt", F.col("m"))) / F.max(F.when(F.col("what") == "pred", F.col("m")))).alias("_s")
    )
    sizes = valid.groupBy(*keys).agg(F.count("*").alias("_n"))
    factor = scale.join(sizes, keys).select(*keys, F.when(F.col("_n") >= least, F.col("_s")).otherwise(F.lit(1.0)).alias("scale"))
    out = px.join(factor, keys, "left") if keys else attach(px, factor)
    return out.withColumn("scale", F.coalesce("scale", F.lit(1.0))).withColumn("pred", F.col("pred") * F.col("scale"))


def error_metrics(px: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, AbsRel, SqRel, RMS and the three ratio accuracies, one aggregation."""
    e, gt, pred = F.abs(F.col("pred") - F.col("gt")), F.col("gt"), F.col("pred")
    ratio = F.greatest(pred / gt, gt / pred)

    def share(limit: float) -> Column:
        return F.avg(F.when(ratio < limit, 1.0).otherwise(0.0))

    # Fixed value: base of the ratio thresholds.
    base = 1.25
    return px.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(e / gt).alias("abs_rel"),
        F.avg(e * e / gt).alias("sq_rel"), F.sqrt(F.avg(e * e)).alias("rms"),
        share(base).alias("a1"), share(base**2).alias("a2"), share(base**3).alias("a3"),
    )


def normalized_difference(px: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Per slice: both rasters scaled to [0, 1] by their own range, then the absolute difference."""
    ends = px.groupBy(key).agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    x = (F.col(a) - F.col("_a0")) / (F.col("_a1") - F.col("_a0") + 1e-8)
    y = (F.col(b) - F.col("_b0")) / (F.col("_b1") - F.col("_b0") + 1e-8)
    return px.join(ends, key).select(key, F.abs(x - y).alias("diff"))


def difference_metrics(diff: DataFrame, key: str) -> DataFrame:
    """mae, rmse, max and median per slice, and their averages over slices as the null-key row."""
    mid = quantiles(diff, [key], "diff", {"median_diff": 0.5})
    per = diff.groupBy(key).agg(
        F.avg("diff").alias("mae"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse"), F.max("diff").alias("max_diff")
    ).join(mid, key)
    cols = ("mae", "rmse", "max_diff", "median_diff")
    return per.rollup(key).agg(*[F.avg(n).alias(n) for n in cols])


def robust_range(px: DataFrame, key: str, value: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Value scaled by its image's percentile range and clipped to [0, 1]."""
    band = quantiles(px, [key], value, {"_lo": lo, "_hi": hi})
    top = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1e-6).otherwise(F.col("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / (top - F.col("_lo"))
    return px.join(band, key).withColumn("normalized", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("_lo", "_hi")


def gather(sample: DataFrame, px: DataFrame, width: int, height: int, value: str = "value", mode: str = "bilinear") -> DataFrame:
    """Resample a raster. ``sample`` holds img, u, v (target) and su, sv (source coordinates).

    The raster wraps in u and clamps in v.
    """
    src = px.select("img", F.col("u").alias("_x"), F.col("v").alias("_y"), F.col(value).alias("_val"))

    def column(x: Column) -> Column:
        return F.pmod(x, F.lit(width).cast("long"))

    def line(y: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(height - 1).cast("long"), y))

    if mode == "nearest":
        at = sample.withColumns({
            "_x": column(F.bround("su", 0).cast("long")), "_y": line(F.bround("sv", 0).cast("long")),
        })
        return at.join(src, ["img", "_x", "_y"]).select("img", "u", "v", F.col("_val").alias(value))
    x0, y0 = F.floor("su"), F.floor("sv")
    fx, fy = F.col("su") - x0, F.col("sv") - y0
    corners = F.array(*[
        F.struct(
            column(x0 + dx).alias("_x"), line(y0 + dy).alias("_y"),
            ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("_w"),
        )
        for dx in (0, 1)
        for dy in (0, 1)
    ])
    taps = sample.select("img", "u", "v", F.explode(corners).alias("c")).select("img", "u", "v", "c.*")
    return taps.join(src, ["img", "_x", "_y"]).groupBy("img", "u", "v").agg(
        F.when(F.sum("_w") > 0, F.sum(F.col("_w") * F.col("_val")) / F.sum("_w")).alias(value)
    )


def mesh(px: DataFrame, width: int, depth: str = "depth", max_ratio: float = 2.0) -> DataFrame:
    """Triangles over pixel quads: all four corners valid and no depth jump; the last column meets the first."""
    ok = px.filter((F.col(depth) > 0) & (F.col(depth) < 100)).select("img", "u", "v", F.col(depth).alias("d"))
    # Every pixel offers itself to the (up to) four quads it is a corner of.
    places = F.array(*[
        F.struct(
            F.pmod(F.col("u") - du, F.lit(width).cast("long")).alias("qu"), (F.col("v") - dv).alias("qv"), F.lit(2 * dv + du).alias("k")
        )
        for dv in (0, 1)
        for du in (0, 1)
    ])
    offers = ok.select("img", "d", F.explode(places).alias("q")).select("img", "d", "q.*")
    # A quad never starts in the last column: only its neighbours wrap around.
    quads = (
        offers.filter(F.col("qu") < width - 1)
        .groupBy("img", "qu", "qv")
        .agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        .filter((F.col("n") == 4) & (F.col("hi") / (F.col("lo") + 1e-6) < max_ratio))
    )
    i00 = F.col("qv") * width + F.col("qu")
    i01 = F.col("qv") * width + F.pmod(F.col("qu") + 1, F.lit(width).cast("long"))
    i10, i11 = i00 + width, i01 + width
    tri = F.array(F.struct(i00.alias("a"), i10.alias("b"), i01.alias("c")), F.struct(i01.alias("a"), i10.alias("b"), i11.alias("c")))
    return quads.select("img", F.explode(tri).alias("t")).select("img", "t.*")
