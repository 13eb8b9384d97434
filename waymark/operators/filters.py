"""Keypoint, pixel, observation and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.ranks import group_index

# Keypoint counts between which the score threshold grows, and its rate.
FEW, MANY, GROWTH = 50, 500, 0.005


def score_threshold(n: Column, base: float = 0.2, gamma: float = GROWTH) -> Column:
    rising = (1 - F.exp(-gamma * (n - FEW))) * base
    return F.when(n <= FEW, F.lit(0.0)).when(n >= MANY, F.lit(base)).otherwise(rising)


def adaptive_keypoints(feats: DataFrame, keys: Sequence[str], score: str = "score", base: float = 0.2) -> DataFrame:
    """Keep keypoints at or above their image's threshold. Counts are pre-aggregated, not windowed."""
    limits = feats.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, score_threshold(F.col("_n"), base).alias("_limit")
    )
    return feats.join(limits, list(keys)).filter(F.col(score) >= F.col("_limit")).drop("_limit")


def valid_pixels(
    px: DataFrame,
    masks: DataFrame | None,
    height: int,
    step: int = 1,
    depth: str = "depth",
    conf: str | None = None,
    min_conf: float = 1.0,
    lo: float = 0.1,
    hi: float = 50.0,
) -> DataFrame:
    """Pixels with usable depth inside the mask. An image without a mask uses its lower half.

    ``masks`` holds img, u, v for set pixels only.
    """
    ok = (F.col("u") % step == 0) & (F.col("v") % step == 0) & (F.col(depth) > lo) & (F.col(depth) < hi)
    if conf:
        ok = ok & (F.col(conf) > min_conf)
    px = px.filter(ok)
    if masks is None:
        return px.filter(F.col("v") >= height // 2)
    masked = masks.select("img").distinct().withColumn("_has", F.lit(True))
    set_px = masks.select("img", "u", "v").distinct().withColumn("_set", F.lit(True))
    joined = px.join(masked, "img", "left").join(set_px, ["img", "u", "v"], "left")
    keep = F.when(F.col("_has").isNotNull(), F.col("_set").isNotNull()).otherwise(F.col("v") >= height // 2)
    return joined.filter(keep).drop("_has", "_set")


def with_landmark(frames: DataFrame, observations: str = "observations") -> DataFrame:
    """Keep the observations of array column ``observations`` that have a landmark; drop emptied frames."""
    kept = F.filter(F.col(observations), lambda o: o.landmark.isNotNull())
    return frames.withColumn(observations, kept).filter(F.size(observations) > 0)


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows chosen by hash order of the key: the same rows whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("#", F.col(key), F.lit(str(seed)))), F.col(key)).limit(k)


def strided_cap(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Every (n // most)-th row of each group, at most ``most`` of them."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = group_index(df, keys, order, "_i").join(sizes, list(keys))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / most))
    return rows.filter(
        (F.col("_n") <= most) | ((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < most))
    ).drop("_n")


def natural_order(df: DataFrame, name: str, pattern: str = r"image\d+\.png$") -> DataFrame:
    """Matching names with their number, globally sorted by it (a range-partitioned sort)."""
    number = F.regexp_extract(F.col(name), r"(\d+)", 1).try_cast("long")
    return df.filter(F.col(name).rlike(pattern)).withColumn("number", number).orderBy("number", name)
