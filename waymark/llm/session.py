"""What a session needs before these operators run as queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.session import ship_package

#: Whole texts are long: batches of a thousand keep what the JVM and a Python worker hold at once to a few megabytes.
BATCH = "1000"


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until none is among ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
