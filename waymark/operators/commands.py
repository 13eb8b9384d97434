"""Step-by-step instructions for a batch of routes.

Geometry of each step is stateless and computed in columns. What carries over between
steps (heading, the open straight stretch, its first door) is folded over the trip's
sorted steps as they stream by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import angles, names, text
from waymark.operators import sight
from waymark.operators.polygons import room_label
from waymark.session import cut_lineage, parallelism

MAP_KEY = ["place", "building", "floor"]
FLUSH = "struct<px:double,door:double,e0:int,e1:int>"
STEP_OUT = f"i int, turn double, is_turn boolean, heading double, before {FLUSH}, after {FLUSH}"
STRETCH = pa.struct([("px", pa.float64()), ("door", pa.float64()), ("e0", pa.int32()), ("e1", pa.int32())])
FOLD_SCHEMA = pa.schema([
    ("trip_id", pa.int64()), ("i", pa.int32()), ("turn", pa.float64()), ("is_turn", pa.bool_()), ("heading", pa.float64()),
    ("before", STRETCH), ("after", STRETCH),
])


def route_steps(rows: DataFrame, scales: DataFrame, floors: DataFrame) -> DataFrame:
    """Route rows -> one row per edge with both keys, length, bearing, next bearing, scale and door distance.

    ``rows``: trip_id, seq, place, building, floor (null for a start that is no node), x, y,
    description. ``floors``: map key, polys.
    """
    # A fixed partitioning by trip serves both windows and keeps the door tests spread.
    rows = rows.repartition(parallelism(rows.sparkSession), "trip_id")
    w = Window.partitionBy("trip_id").orderBy("seq")
    nxt = F.struct(*[F.col(k).alias(f"{k}1") for k in MAP_KEY], F.col("x").alias("x1"), F.col("y").alias("y1"), F.lower("description").alias("desc1"))
    s = rows.withColumn("_n", F.lead(nxt).over(w)).filter(F.col("_n").isNotNull()).select(
        "trip_id", F.col("seq").cast("int").alias("i"), *MAP_KEY, "x", "y", "_n.*"
    )
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    s = s.withColumns({
        "len": F.sqrt(dx * dx + dy * dy),
        "bearing": angles.bearing(F.col("x"), F.col("y"), F.col("x1"), F.col("y1")),
        "moved": F.coalesce(
            F.col("place").isNotNull() & F.col("place1").isNotNull()
            & ((F.col("place") != F.col("place1")) | (F.col("building") != F.col("building1")) | (F.col("floor") != F.col("floor1"))),
            F.lit(False),
        ),
    })
    wi = Window.partitionBy("trip_id").orderBy("i")
    s = s.withColumn("bearing2", F.lead("bearing").over(wi))
    far = scales.select(*[F.col(k).alias(f"{k}1") for k in MAP_KEY], F.col("m_per_px").alias("scale"))
    s = s.join(far, [f"{k}1" for k in MAP_KEY], "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return sight.first_doors(s, floors, ("x", "y", "x1", "y1"), "trip_id")


def _normalize(angle: float) -> float:
    """``angles.normalize`` to the last bit: the sign of a remainder is that of the angle."""
    r = math.fmod(angle + 180.0, 360.0)
    return (math.fmod(r + 360.0, 360.0) if r < 0 else r) - 180.0


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps sorted by (trip, i) to folded steps; only the open stretch is carried, also from batch to batch."""
    from waymark.functions import angles

    straight, look_ahead = angles.SECTORS[0][0], angles.LOOK_AHEAD_DEGREES
    first, trip = True, None
    h0 = heading = es = door = None
    px = 0.0
    for batch in batches:
        out = {n: [] for n in FOLD_SCHEMA.names}

        def put(*row):
            for n, v in zip(FOLD_SCHEMA.names, row):
                out[n].append(v)

        def stretch(last):
            return {"px": px, "door": door, "e0": es, "e1": None if es is None else last} if px > 0 else None

        for t, i, moved, length, bearing, bearing2, at, start in zip(*(col.to_pylist() for col in batch.columns)):
            if first or t != trip:
                first, trip, h0, heading, px, door, es = False, t, start, start, 0.0, None, None
            if moved:
                put(t, i, None, False, h0, stretch(i - 1), None)
                door = None if px > 0 else door
                heading, px, es = h0, 0.0, None
                continue
            turn = None if bearing is None or heading is None else _normalize(bearing - heading)
            is_turn = None if turn is None else abs(turn) > straight
            before = stretch(i - 1) if is_turn else None
            if is_turn:
                heading = bearing
                if px > 0:
                    px, door, es = 0.0, None, None
            es = i if es is None else es
            px += length
            door = at if door is None else door if at is None else min(door, at)
            ahead = bearing2 is None or heading is None or abs(_normalize(bearing2 - heading)) >= look_ahead
            after = stretch(i) if ahead else None
            put(t, i, turn, is_turn, heading, before, after)
            if ahead:
                es = None
                if px > 0:
                    px, door = 0.0, None
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([f if f.name != "trip_id" else f.with_type(batch.schema.field(0).type) for f in FOLD_SCHEMA]))


def fold_steps(steps: DataFrame, initial: str = "initial_heading") -> DataFrame:
    """Steps with turn, carried heading and the stretches closed before and after each.

    ``initial`` is a column of the trip's heading on arrival at a start or a new floor. Trips are sorted and streamed:
    time grows with the steps and memory with a batch, however long a trip is. Without a heading (null bearing or start)
    there is no turn.
    """
    steps = steps.select("trip_id", F.col("i").cast("int").alias("i"), "moved", "len", "bearing", "bearing2", F.col("door_px").alias("door"), initial)
    # Spark spills this sort; the fold sees each trip's steps in order.
    ordered = steps.repartition(parallelism(steps.sparkSession), "trip_id").sortWithinPartitions("trip_id", "i")
    key = steps.schema["trip_id"].dataType.simpleString()
    return ordered.mapInArrow(_walk, f"trip_id {key}, {STEP_OUT}")


def transition_kind(place: str = "place", place1: str = "place1") -> Column:
    """place, building or floor: the highest level that changes; null when none does or a key is missing."""
    both = F.col("place").isNotNull() & F.col("place1").isNotNull()
    return F.when(both, F.when(F.col("place") != F.col("place1"), "place").when(F.col("building") != F.col("building1"), "building").when(F.col("floor") != F.col("floor1"), "floor"))


def lift_kind(desc: Column) -> Column:
    """stair, elevator or escalator named by a connector's description."""
    return F.when(desc.contains("stair"), "stair").when(desc.contains("elevator"), "elevator").when(desc.contains("escalator"), "escalator")


FIELDS = {
    "tag": "string", "template": "string", "distance": "double", "door_distance": "double", "unit": "string", "turn": "double",
    "direction": "string", "place": "string", "building": "string", "floor": "string", "room": "string", "label": "string",
    "e0": "int", "e1": "int",
}


def command(**values: Column) -> Column:
    return F.struct(*[
        (values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()
    ])


def _forward(flush: Column, scale: Column, unit: Column) -> Column:
    door = flush["door"].isNotNull()
    tag = F.when(door, "forward_door").otherwise("forward")
    one = command(
        tag=tag, template=tag, distance=text.distance_value(flush["px"] * scale, unit),
        door_distance=text.distance_value(flush["door"] * scale, unit), unit=unit, e0=flush["e0"], e1=flush["e1"],
    )
    return F.when(flush.isNotNull(), F.array(one))


def route_commands(
    rows: DataFrame, scales: DataFrame, floors: DataFrame, unit: str = "meter", lang: str = "en",
    turn_mode: str = "default", labels: DataFrame | None = None,
) -> DataFrame:
    """trip_id, seq, tag, text and meta columns of every instruction.

    ``rows`` as for ``route_steps`` plus label and initial_heading (constant per trip).
    """
    c = F.col
    heads = rows.groupBy("trip_id").agg(F.max("initial_heading").alias("initial_heading"))
    # Steps and folded steps are each read several times below.
    steps = cut_lineage(route_steps(rows, scales, floors).join(heads, "trip_id"))
    folded = cut_lineage(fold_steps(steps))
    s = steps.join(folded, ["trip_id", "i"])
    u = F.lit(unit)
    here = {"place": c("place1"), "building": c("building1"), "floor": c("floor1"), "e0": c("i")}
    kind, lift = transition_kind(), lift_kind(c("desc1"))
    updown = names.floor_direction(c("floor"), c("floor1"))
    to_floor = command(tag=F.lit("proceed_to_floor"), template=F.lit("proceed_to_floor"), **here)
    place_cmds = F.array(
        command(tag=F.lit("transition_place"), template=F.lit("transition_place"), **here),
        command(tag=F.lit("proceed_to"), template=F.lit("proceed_to"), **here),
    )
    building_cmds = F.array(command(tag=F.lit("transition_building"), template=F.lit("transition_building"), **here), to_floor)
    near = F.concat(F.lit("approaching_"), lift)
    go = F.coalesce(F.concat(F.lit("go_up_"), lift), F.lit("proceed_to_floor"))
    floor_cmds = F.array(
        F.when(lift.isNull(), to_floor).otherwise(command(tag=near, template=near, e0=c("i"))),
        command(tag=go, template=go, direction=updown, **here),
    )
    moves = F.when(kind == "place", place_cmds).when(kind == "building", building_cmds).when(kind == "floor", floor_cmds)
    turn_template = F.lit("turn_deg" if turn_mode == "deg15" else "turn")
    turned = F.when(c("is_turn"), F.array(command(tag=F.lit("turn"), template=turn_template, turn=c("turn"), e0=c("i"))))
    none = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">>")
    parts = [_forward(c("before"), c("scale"), u), F.when(c("moved"), moves).otherwise(turned), _forward(c("after"), c("scale"), u)]
    cmds = s.select("trip_id", c("i").alias("_i"), F.posexplode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("_j", "c"))

    # Start: where the trip begins, seen from the first node's floor.
    begin = steps.filter("i = 0").select("trip_id", *[c(f"{k}1").alias(k) for k in MAP_KEY], "x", "y").join(floors.select(*MAP_KEY, "polys"), MAP_KEY, "left")
    known = c("place").isNotNull()
    room = F.coalesce(room_label(c("polys"), c("x"), c("y")), F.lit("Unknown"))
    start = F.when(known, command(tag=F.lit("start_in"), template=F.lit("start_in"), room=room, place=c("place"), building=c("building"), floor=c("floor"))).otherwise(
        command(tag=F.lit("start_nav"), template=F.lit("start_nav"))
    )
    starts = begin.select("trip_id", F.lit(-1).alias("_i"), F.lit(0).alias("_j"), start.alias("c"))

    # Arrival: the last node's orientation hint against the carried heading.
    ends = rows.groupBy("trip_id").agg(F.max_by(F.struct("label", "description"), "seq").alias("_e"), F.max("seq").alias("_n"))
    headed = folded.groupBy("trip_id").agg(F.max_by("heading", "i").alias("_h"))
    last = ends.join(headed, "trip_id", "left").join(heads, "trip_id")
    heading = F.coalesce("_h", "initial_heading")
    facing = angles.normalize(angles.hint_bearing(c("_e.description"), heading) - heading)
    arrive = command(tag=F.lit("arrive"), template=F.lit("arrive"), label=c("_e.label"), turn=facing, e0=F.greatest(F.lit(0), c("_n") - 1))
    arrivals = last.select("trip_id", F.lit(2**31 - 1).alias("_i"), F.lit(0).alias("_j"), arrive.alias("c"))

    every = cmds.unionByName(starts).unionByName(arrivals)
    w = Window.partitionBy("trip_id").orderBy("_i", "_j")
    out = every.withColumn("seq", F.row_number().over(w) - 1).select("trip_id", "seq", "c.*")
    return render(out, lang, turn_mode, labels)


def render(cmds: DataFrame, lang: str, turn_mode: str = "default", labels: DataFrame | None = None) -> DataFrame:
    """Add qual, direction, hour, deg15 and the spoken text; names are localized from ``labels`` when given."""
    c = F.col
    out = cmds.withColumns({
        "qual": F.when(c("turn").isNotNull(), angles.sector(c("turn"))),
        "direction": F.coalesce("direction", F.when(c("turn").isNotNull(), angles.side(c("turn")))),
        "hour": F.when(c("turn").isNotNull(), angles.clock_hour(c("turn"))),
        "deg15": F.when(c("turn").isNotNull(), angles.quantize15(c("turn"))),
        "place_name": c("place"), "building_name": c("building"), "floor_name": c("floor"),
    })
    if labels is not None:
        usable = labels.filter(F.trim("text") != "").groupBy("section", "key").agg(
            F.coalesce(F.max(F.when(c("lang") == lang, F.trim("text"))), F.max(F.when(c("lang") == "en", F.trim("text")))).alias("_t")
        ).filter(c("_t").isNotNull())
        for section, level, key in (("places", "place", ["place"]), ("buildings", "building", MAP_KEY[:2]), ("floors", "floor", MAP_KEY)):
            names_ = usable.filter(c("section") == section).select(c("key").alias("_key"), c("_t").alias("_name"))
            whole = F.when(c(level).isNotNull(), F.concat_ws("/", *key))
            out = out.withColumn("_key", whole).join(names_, "_key", "left").withColumn(
                f"{level}_name", F.coalesce("_name", level)
            ).drop("_key", "_name")
    lang_ = F.lit(lang)
    # Going to another building speaks the place sentence with the building's name.
    building_move = c("template") == "transition_building"
    tokens = {
        "place": F.when(building_move, c("building_name")).otherwise(c("place_name")), "building": c("building_name"), "floor": c("floor_name"),
        "room": c("room"), "label": c("label"), "qual": c("qual"), "direction": c("direction"), "hour": c("hour"), "deg": c("deg15"),
        "dist": text.unit_phrase(c("distance"), c("unit"), lang_), "door_dist": text.unit_phrase(c("door_distance"), c("unit"), lang_),
    }
    template = F.when(building_move, "transition_place").otherwise(c("template"))
    return out.withColumn("text", text.sentence(template, lang_, tokens)).drop("template", "place_name", "building_name", "floor_name")


def route_payload(edges: DataFrame, commands: DataFrame) -> DataFrame:
    """trip_id, payload: route edges and instructions of each trip as one JSON record."""
    route = edges.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*[n for n in edges.columns if n != "trip_id"]))).alias("route"))
    cols = ["seq", *[n for n in commands.columns if n not in ("trip_id", "seq")]]
    spoken = commands.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("instructions"))
    return spoken.join(route, "trip_id", "left").select(
        "trip_id", F.to_json(F.struct(F.coalesce("route", F.array().cast(route.schema["route"].dataType)).alias("route"), "instructions")).alias("payload")
    )
