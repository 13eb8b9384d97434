"""View names, floor numbers and image-pair ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: largest image id of the pair-id encoding.
MAX_IMAGE_ID = 2**31 - 1


def view_name(keyframe: Column, pitch: Column, yaw: Column) -> Column:
    return F.format_string("%06d_pitch%02d_yaw%02d.png", keyframe, pitch, yaw)


def segment_view_name(stem: Column, yaw: Column, pitch: Column) -> Column:
    return F.format_string("%s_yaw%03d_pitch%+03d.png", stem, yaw, pitch)


def parse_view_name(name: Column) -> list[Column]:
    """keyframe, pitch, yaw of a view name."""
    pattern = r"^(\d+)_pitch(\d+)_yaw(\d+)"
    return [F.regexp_extract(name, pattern, i).try_cast("long") for i in (1, 2, 3)]


def is_front_view(name: Column) -> Column:
    return name.rlike(r"_yaw(00|0)(\.[a-z]+)?$")


def floor_number(floor: Column) -> Column:
    """Digits of a floor name as a number; null when there are none."""
    return F.regexp_replace(floor, r"\D", "").try_cast("long")


def floor_direction(src: Column, dst: Column) -> Column:
    a, b = floor_number(src), floor_number(dst)
    higher = F.when(a.isNotNull() & b.isNotNull(), b > a).otherwise(dst > src)
    return F.when(higher, "up").otherwise("down")


def pair_id(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("long") * MAX_IMAGE_ID + F.greatest(a, b).cast("long")


def pair_members(pair: Column) -> tuple[Column, Column]:
    second = F.pmod(pair, F.lit(MAX_IMAGE_ID))
    return ((pair - second) / MAX_IMAGE_ID).cast("long"), second.cast("long")
