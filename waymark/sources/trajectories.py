"""Camera trajectory text: ``frame_id tx ty tz qx qy qz qw`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.lines import number_lines, read_lines

FIELDS = ("frame_id", "tx", "ty", "tz", "qx", "qy", "qz", "qw")


def read_trajectories(spark: SparkSession, root: str, pattern: str = "*.txt", by_folder: bool = False) -> DataFrame:
    """Files of any size, read in byte ranges; non-blank lines are numbered within their file (or folder of parts)."""
    return parse_lines(
        number_lines(read_lines(spark, root, pattern), F.col("line") != "", by_folder).withColumnRenamed("n", "frame_seq")
    )


def parse_trajectories(docs: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """Number the non-blank lines, then drop those without eight tokens (their index stays used)."""
    lines = F.filter(F.transform(F.split(F.col(body), "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    numbered = docs.select(F.col(source).alias("source"), F.posexplode(lines).alias("frame_seq", "line"))
    return parse_lines(numbered)


def parse_lines(numbered: DataFrame) -> DataFrame:
    """source, frame_seq, line -> typed pose columns."""
    tokens = F.split("line", r"\s+")
    split = numbered.select("source", F.col("frame_seq").cast("long"), tokens.alias("tok")).filter(F.size("tok") == 8)
    return split.select(
        "source", "frame_seq", F.col("tok")[0].alias("frame_id"),
        *[F.col("tok")[i].try_cast("double").alias(n) for i, n in enumerate(FIELDS) if i],
    )
