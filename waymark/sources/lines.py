"""Numbered lines of text files of any size, and records of two lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import running
from waymark.session import cut_lineage


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, block, line of all text files below ``path``; lines are trimmed, blank ones kept.

    Files are cut into byte ranges of at most ``spark.sql.files.maxPartitionBytes``; ``block`` is where a line's range starts in its file.
    A line belongs to the range it starts in.
    """
    text = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    )
    line = F.trim(F.regexp_replace("value", "\r$", ""))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"))


def number_lines(lines: DataFrame, keep: Column, by_folder: bool = False) -> DataFrame:
    """source, n, line: the lines that ``keep`` holds for, numbered from 0 within their source.

    A source is a file or, with ``by_folder``, a folder whose files follow each other in the order of their names (as Spark writes a
    sorted table). Lines of a byte range have consecutive ids, so only ranges are summed: no window reads a whole file.
    """
    source = F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.col("file")
    kept = cut_lineage(lines.filter(keep).withColumns({"source": source, "_id": F.monotonically_increasing_id()}))
    ranges = kept.groupBy("source", "file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return kept.join(starts, ["source", "file", "block"]).select("source", (F.col("_id") + F.col("_start")).alias("n"), "line")


def pair_lines(numbered: DataFrame) -> DataFrame:
    """source, n, head, body: records of a head line and the line after it, which may be blank or missing.

    Blank lines before a head are skipped. So a blank line always ends a record, and the lines after it
    alternate: a line's role is the parity of its distance to the last blank line, which a running maximum finds
    whichever task read that line.
    """
    n, blank = F.col("n"), F.col("line") == ""
    seen = running(numbered.withColumn("_blank", F.when(blank, n)), ["source"], ["n"], maxima=("_blank",)).filter(~blank)
    role = F.pmod(n - F.coalesce("_blank", F.lit(-1)) - 1, F.lit(2))
    return seen.withColumn("_role", role).groupBy("source", (n - F.col("_role")).alias("n")).agg(
        F.max(F.when(F.col("_role") == 0, F.col("line"))).alias("head"),
        F.coalesce(F.max(F.when(F.col("_role") == 1, F.col("line"))), F.lit("")).alias("body"),
    )
