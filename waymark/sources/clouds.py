"""ASCII point clouds, metadata and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
POINT_LINE = rf"^\s*{NUMBER}(?:\s+{NUMBER}){{2,5}}\s*$"


def parse_point_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines -> x y z r g b. Header lines do not match the number pattern and drop out."""
    tok = F.split(F.trim(F.col(column)), r"\s+")
    rows = lines.filter(F.col(column).rlike(POINT_LINE)).select(tok.alias("t"))
    t = F.col("t")
    return rows.select(
        *[t[i].cast("double").alias(n) for i, n in enumerate("xyz")],
        *[F.get(t, i + 3).cast("short").alias(n) for i, n in enumerate("rgb")],
    )


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    return parse_point_lines(spark.read.text(path))


def point_lines(points: DataFrame) -> DataFrame:
    """x y z and b g r columns -> text lines with colours in red-green-blue order."""
    return points.select(
        F.format_string(
            "%.6f %.6f %.6f %d %d %d",
            *[F.col(n).cast("double") for n in "xyz"], *[F.col(n).cast("int") for n in "rgb"],
        ).alias("value")
    )


def write_cloud(points: DataFrame, path: str) -> None:
    """Body lines as a folder of text parts, written in parallel."""
    point_lines(points).write.mode("overwrite").text(path)


def cloud_header(count: int) -> str:
    """Header text for a body of ``count`` points."""
    fields = "".join(f"property float {n}\n" for n in "xyz") + "".join(
        f"property uchar {n}\n" for n in ("red", "green", "blue")
    )
    return f"ply\nformat ascii 1.0\nelement vertex {count}\n{fields}end_header\n"


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, rows, non-null count, numeric min and max; one aggregation per table."""
    parts = []
    for name, df in tables.items():
        numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short")}
        aggs = [F.count(F.lit(1)).alias("rows")]
        for f in df.columns:
            aggs.append(F.count(f).alias(f"n_{f}"))
            if f in numeric:
                aggs += [F.min(f).cast("double").alias(f"lo_{f}"), F.max(f).cast("double").alias(f"hi_{f}")]
        none = F.lit(None).cast("double")
        cells = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(f).alias("column_name"),
                F.lit(df.schema[f].dataType.simpleString()).alias("type"), F.col("rows"),
                F.col(f"n_{f}").alias("non_null"),
                (F.col(f"lo_{f}") if f in numeric else none).alias("lo"),
                (F.col(f"hi_{f}") if f in numeric else none).alias("hi"),
            )
            for f in df.columns
        ]
        parts.append(df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)
