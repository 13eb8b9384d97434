"""Text and relational forms of sparse models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.names import pair_id
from waymark.sources.lines import number_lines, pair_lines, read_lines


COMMENT = "#"


def read_cameras(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return _camera_rows(_content(spark, path, pattern))


def read_points(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return _point_rows(_content(spark, path, pattern))


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Images of text files of any size: both lines of an image are found also where byte ranges part them."""
    lines = number_lines(read_lines(spark, path, pattern), ~F.col("line").startswith(COMMENT))
    return _image_rows(pair_lines(lines))


def _content(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One-line records need no numbers, so their byte ranges are parsed where they are read."""
    lines = read_lines(spark, path, pattern).filter((F.col("line") != "") & ~F.col("line").startswith(COMMENT))
    return lines.select(F.col("file").alias("source"), "line")


def _lines(docs: DataFrame) -> DataFrame:
    """source, line number, line, without comments and blank lines."""
    lines = F.filter(F.transform(F.split("body", "\r?\n"), lambda s: F.trim(s)), lambda s: ~s.startswith("#"))
    lines = F.filter(lines, lambda s: s != "")
    return docs.select("source", F.posexplode(lines).alias("n", "line"))


def parse_cameras(docs: DataFrame) -> DataFrame:
    return _camera_rows(_lines(docs))


def _camera_rows(lines: DataFrame) -> DataFrame:
    tok = F.split("line", r"\s+")
    rows = lines.select("source", tok.alias("t")).filter(F.size("t") >= 4)
    t = F.col("t")
    return rows.select(
        "source", t[0].try_cast("long").alias("camera_id"), t[1].alias("model"), t[2].try_cast("long").alias("width"),
        t[3].try_cast("long").alias("height"),
        F.transform(F.slice("t", 5, F.size("t")), lambda s: s.try_cast("double")).alias("params"),
    )


def parse_images(docs: DataFrame) -> DataFrame:
    """Two lines per image: pose line, then X Y POINT3D_ID triples (the second may be blank)."""
    plain = F.regexp_replace(F.regexp_replace("body", "\r", ""), r"(?m)^\s*#[^\n]*\n?", "")
    # Each match is one head line with the line after it.
    pairs = docs.select(
        "source", F.explode(F.regexp_extract_all(plain, F.lit(r"([^\n]+)\n([^\n]*)"), F.lit(0))).alias("p")
    )
    return _image_rows(pairs.select(
        "source", F.split_part("p", F.lit("\n"), F.lit(1)).alias("head"), F.split_part("p", F.lit("\n"), F.lit(2)).alias("body")
    ))


def _image_rows(records: DataFrame) -> DataFrame:
    """source, head, body -> one row per image."""
    rows = records.select("source", F.split(F.trim("head"), r"\s+").alias("t"), F.col("body").alias("o"))
    t = F.col("t")
    # Triples are cut as substrings first, so no step indexes into the full token list.
    triples = F.transform(
        F.regexp_extract_all("o", F.lit(r"(\S+)\s+(\S+)\s+(\S+)"), F.lit(0)),
        lambda s, i: F.struct(
            i.cast("long").alias("kp_idx"), F.split(s, r"\s+")[0].try_cast("double").alias("x"),
            F.split(s, r"\s+")[1].try_cast("double").alias("y"), F.split(s, r"\s+")[2].try_cast("long").alias("point_id"),
        ),
    )
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    return rows.select(
        "source", t[0].try_cast("long").alias("image_id"),
        *[t[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)],
        t[8].try_cast("long").alias("camera_id"), t[9].alias("name"), triples.alias("observations"),
    )


def parse_points(docs: DataFrame) -> DataFrame:
    return _point_rows(_lines(docs))


def _point_rows(lines: DataFrame) -> DataFrame:
    tok = F.split("line", r"\s+")
    rows = lines.select("source", "line", tok.alias("t")).filter(F.size("t") >= 8)
    t = F.col("t")
    # Track entries follow the eight fixed fields as (image, keypoint) pairs.
    track = F.transform(
        F.regexp_extract_all(F.regexp_replace("line", r"^(\S+\s+){7}\S+", ""), F.lit(r"(\S+)\s+(\S+)"), F.lit(0)),
        lambda s: F.struct(
            F.split(s, r"\s+")[0].try_cast("long").alias("image_id"),
            F.split(s, r"\s+")[1].try_cast("long").alias("kp_idx"),
        ),
    )
    return rows.select(
        "source", t[0].try_cast("long").alias("point_id"),
        *[t[i].try_cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))],
        *[t[i].try_cast("short").alias(n) for i, n in ((4, "r"), (5, "g"), (6, "b"))],
        t[7].try_cast("double").alias("error"), track.alias("track"),
    )


def shift_keypoints(keypoints: DataFrame) -> DataFrame:
    """Pixel-corner to pixel-centre origin."""
    return keypoints.withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5})


def orient_matches(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Match rows of each listed pair, found under either orientation and turned to the listed one.

    The listed orientation wins when both are stored.
    """
    listed = pairs.select("img1", "img2").distinct()
    straight = matches.select("img1", "img2", "kp1", "kp2", F.lit(0).alias("flipped"))
    turned = matches.filter(F.col("img1") != F.col("img2")).select(
        F.col("img2").alias("img1"), F.col("img1").alias("img2"), F.col("kp2").alias("kp1"),
        F.col("kp1").alias("kp2"), F.lit(1).alias("flipped"),
    )
    found = straight.unionByName(turned).join(listed, ["img1", "img2"], "left_semi")
    best = found.groupBy("img1", "img2").agg(F.min("flipped").alias("flipped"))
    return found.join(best, ["img1", "img2", "flipped"], "left_semi")


def unmatched_pairs(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    stored = matches.select("img1", "img2").union(matches.select("img2", "img1")).distinct()
    return pairs.join(stored, ["img1", "img2"], "left_anti")


def load_matches(images: DataFrame, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """pair_id and keypoint columns ordered so that the first belongs to the lower image id."""
    found = orient_matches(pairs, matches)
    a = images.select(F.col("name").alias("img1"), F.col("image_id").alias("id1"))
    b = images.select(F.col("name").alias("img2"), F.col("image_id").alias("id2"))
    joined = found.join(a, "img1").join(b, "img2")
    swap = F.col("id1") > F.col("id2")
    return joined.select(
        pair_id(F.col("id1"), F.col("id2")).alias("pair_id"),
        F.when(swap, F.col("kp2")).otherwise(F.col("kp1")).alias("kp_a"),
        F.when(swap, F.col("kp1")).otherwise(F.col("kp2")).alias("kp_b"),
    )
