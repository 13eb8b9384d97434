"""Feature and match tables (columnar files partitioned by map key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAP_KEY = ["place", "building", "floor"]


def read_features(spark: SparkSession, path: str, maps: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Feature rows; a small ``maps`` table prunes partitions at run time. Map keys stay text, also those that look like numbers."""
    fields = spark.read.parquet(path).schema.fields
    schema = StructType([StructField(f.name, StringType()) if f.name in MAP_KEY else f for f in fields])
    df = spark.read.schema(schema).parquet(path)
    if maps is not None:
        df = df.join(maps.select(*MAP_KEY).distinct(), MAP_KEY, "left_semi")
    return df.select(*columns) if columns else df


def write_features(df: DataFrame, path: str) -> None:
    """One folder per map. Rows are rebalanced by map: a small map gets one file, a large one is split over several writers."""
    df.hint("rebalance", *MAP_KEY).write.mode("overwrite").partitionBy(*MAP_KEY).parquet(path)


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, lower name first, self pairs dropped."""
    return (
        pairs.filter(F.col("img1") != F.col("img2"))
        .select(F.least("img1", "img2").alias("img1"), F.greatest("img1", "img2").alias("img2"))
        .distinct()
    )


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Sorted pair list as text; the sort is a range partitioning, so files are globally ordered."""
    canonical_pairs(pairs).orderBy("img1", "img2").select(
        F.concat_ws(" ", "img1", "img2").alias("value")
    ).write.mode("overwrite").text(path)


def write_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").partitionBy("segment").parquet(path)
