"""Headings and turns. Positive turn = counter-clockwise (left); plan y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turn sectors as (largest absolute degrees, name); beyond the last is a U-turn.
SECTORS = (
    (15.0, "ahead"),
    (45.0, "very_slight"),
    (75.0, "slight"),
    (105.0, "turn"),
    (135.0, "sharp"),
    (165.0, "very_sharp"),
)
# Absolute turn from which the straight stretch ahead is closed.
LOOK_AHEAD_DEGREES = 25.0
# Bearing per orientation hint, first match wins.
HINT_BEARINGS = (("up", 90.0), ("right", 0.0), ("down", -90.0), ("left", 180.0))


def normalize(angle: Column) -> Column:
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.degrees(F.atan2(y0 - y1, x1 - x0))


def sector(turn: Column) -> Column:
    size = F.abs(turn)
    out = F.when(size <= SECTORS[0][0], SECTORS[0][1])
    for limit, name in SECTORS[1:]:
        out = out.when(size <= limit, name)
    return out.otherwise("u_turn")


def side(turn: Column) -> Column:
    return F.when(turn < 0, "right").otherwise("left")


def clock_hour(turn: Column) -> Column:
    hour = F.pmod(F.bround(-turn / 30.0, 0).cast("long"), F.lit(12))
    return F.when(hour == 0, F.lit(12)).otherwise(hour).cast("long")


def quantize15(turn: Column) -> Column:
    q = F.bround(F.abs(turn) / 15.0, 0).cast("long") * 15
    return F.least(F.lit(180).cast("long"), q)


def hint_bearing(text: Column, default: Column) -> Column:
    hint = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), default)
    for word, degrees in HINT_BEARINGS:
        out = out.when(hint.contains(word), F.lit(degrees))
    return out.otherwise(default)
