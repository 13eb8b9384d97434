"""Hand-computed cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import angles, text
from waymark.functions import geometry as g
from waymark.operators import commands, filters, grids
from waymark.operators import polygons as pg
from waymark.sources import annotations as ann
from waymark.sources import lines, sparse_model, trajectories

c = F.col
SHAPES = [
    {"label": "Hall", "group_id": 0, "shape_type": "rectangle", "points": [[0, 0], [100, 60]]},
    {"label": "", "group_id": 0, "shape_type": "polygon", "points": [[100, 0], [100, 60], [200, 60], [200, 0]]},
    {"label": "Pillar", "group_id": 1, "shape_type": "rectangle", "points": [[40, 20], [60, 40]]},
    {"label": "w1", "group_id": 3, "shape_type": "point", "points": [[10, 30]]},
    {"label": "E1", "group_id": 4, "shape_type": "point", "description": "Elevator", "points": [[90, 30]]},
    {"label": "Desk", "group_id": 5, "shape_type": "point", "description": "up", "points": [[150, 30]]},
    {"label": "E1", "group_id": 6, "shape_type": "line", "points": [[85, 30], [95, 30]]},
]


def test_annotation_files(spark, tmp_path):
    for floor in ("1_floor", "2_floor"):
        d = tmp_path / "Campus" / "Main" / floor
        d.mkdir(parents=True)
        (d / "boundaries.json").write_text(json.dumps({"shapes": SHAPES}))
    (tmp_path / "Campus" / "Main" / "empty").mkdir()
    shapes = ann.read_annotations(spark, str(tmp_path))
    nodes = ann.shape_nodes(shapes)
    got = {(r.floor, r.node_id): (r.label, r.group_id, r.x) for r in nodes.collect()}
    assert got[("1_floor", 0)] == ("w1", 3, 10.0) and got[("2_floor", 2)] == ("Desk", 5, 150.0) and len(got) == 6
    ring = ann.shape_polygons(shapes).filter("label = 'Hall' and floor = '1_floor'").first().ring
    assert ring == [[0, 0], [0, 60], [100, 60], [100, 0]]
    assert {(r.floor, r.node_id) for r in ann.partner_lines(shapes, nodes).collect()} == {("1_floor", 1), ("2_floor", 1)}
    tree = ann.catalog_tree(ann.floor_catalog(ann.list_files(spark, str(tmp_path)))).first()
    assert (tree.place, tree.building, tree.floors) == ("Campus", "Main", ["1_floor", "2_floor"])


@pytest.mark.parametrize(
    "turn, qual, hour, deg",
    [
        (-165, "very_sharp", 6, 165), (-75, "slight", 2, 75), (-15.1, "very_slight", 1, 15), (-15, "ahead", 12, 15), (0, "ahead", 12, 0),
        (14.9, "ahead", 12, 15), (15, "ahead", 12, 15), (15.1, "very_slight", 11, 15), (45, "very_slight", 10, 45), (105, "turn", 8, 105),
        (135, "sharp", 8, 135), (179.9, "u_turn", 6, 180),
    ],
)
def test_turns(spark, turn, qual, hour, deg):
    t = F.lit(float(turn))
    row = spark.range(1).select(angles.sector(t).alias("q"), angles.clock_hour(t).alias("h"), angles.quantize15(t).alias("d")).first()
    assert (row.q, row.h, row.d) == (qual, hour, deg)


def test_score_threshold(spark):
    rows = spark.createDataFrame([(n,) for n in (50, 51, 499, 500)], "n int").select(filters.score_threshold(c("n"))).collect()
    want = [0.0, 0.2 * (1 - math.exp(-0.005)), 0.2 * (1 - math.exp(-0.005 * 449)), 0.2]
    assert [r[0] for r in rows] == pytest.approx(want)


def test_text(spark):
    def say(key, lang, **tokens):
        cols = {k: F.lit(v) for k, v in tokens.items()}
        return spark.range(1).select(text.sentence(F.lit(key), F.lit(lang), cols)).first()[0]

    assert say("turn", "en", qual="slight", direction="left", hour=10) == "slight left to 10 o'clock"
    assert say("turn", "zh", qual="turn", direction="left", hour=9) == "9点方向左转弯"
    assert say("turn", "fr", qual="u_turn", direction="left", hour=6) == "Make a U-turn"
    assert say("arrive", "en", label="Desk_1", qual="u_turn", direction="left", hour=6) == "Desk 1 on 6 o'clock behind"
    phrase = spark.range(1).select(text.unit_phrase(F.lit(2.5), F.lit("meter"), F.lit("en"))).first()[0]
    assert phrase == "2 meters"
    assert spark.range(1).select(text.speakable(F.lit(" a__b : c  , d "))).first()[0] == "a b c, d"


# A room with a shared wall to the next, a door gap, an obstacle, and an L-shaped annex.
PLAN = [
    (0, 0, [(0, 0), (0, 60), (100, 60), (100, 0)]),
    (1, 0, [(100, 0), (100, 60), (200, 60), (200, 0)]),
    (2, 0, [(210, 0), (210, 60), (300, 60), (300, 0)]),
    (3, 2, [(195, 25), (195, 35), (215, 35), (215, 25)]),
    (4, 1, [(40, 20), (40, 40), (60, 40), (60, 20)]),
    (5, 0, [(0, 100), (0, 200), (50, 200), (50, 150), (100, 150), (100, 100)]),
]


@pytest.mark.parametrize(
    "seg, seen",
    [
        ((10, 10, 90, 50), False), ((10, 10, 90, 12), True), ((90, 30, 110, 30), True), ((100, 10, 100, 50), True),
        ((150, 30, 250, 30), True), ((150, 10, 250, 10), False), ((10, 10, 0, 30), True), ((30, 20, 80, 20), True),
        ((10, 30, 90, 30), False), ((50, 30, 50, 90), False), ((0, 0, 0, 60), False), ((40, 20, 60, 20), False),
        ((25, 125, 25, 175), True), ((25, 175, 75, 125), True), ((25, 190, 95, 140), False),
    ],
)
def test_visibility(spark, seg, seen):
    polys = F.array(*[
        F.struct(
            F.lit(p).alias("pos"), F.lit(gid).alias("group_id"), F.lit("").alias("label"),
            F.array(*[
                F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*a, *b), ("ax", "ay", "bx", "by"))])
                for a, b in zip(ring, ring[1:] + ring[:1])
            ]).alias("edges"),
        )
        for p, gid, ring in PLAN
    ])
    rows = spark.range(1).select(*[F.lit(float(v)).alias(n) for v, n in zip(seg, ("px", "py", "qx", "qy"))], polys.alias("polys"))
    assert pg.with_visibility(rows, ("px", "py", "qx", "qy")).first().visible is seen


@pytest.mark.parametrize("q", [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (-0.5, 0.5, -0.5, 0.5), (0.1, 0.7, -0.1, 0.7)])
def test_quaternion_round_trip(spark, q):
    n = math.sqrt(sum(v * v for v in q))
    cols = [F.lit(v / n) for v in q]
    got = spark.range(1).select(*g.rot_to_quat(g.quat_to_rot(cols))).first()
    sign = next((1 if v > 0 else -1) for v in got if abs(v) > 1e-9) * next((1 if v > 0 else -1) for v in q if abs(v) > 1e-9)
    assert [v * sign for v in got] == pytest.approx([v / n for v in q], abs=1e-9)
    assert got[0] >= 0


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(float(u), float(v)) for u in (3, 100, 400) for v in (5, 128, 250)], "u double, v double")
    ray = g.equirect_bearing(c("u"), c("v"), 512, 256)
    u, v = g.to_equirect([r * 3.5 for r in ray], 512, 256)
    for r in rows.select("u", "v", u.alias("u2"), v.alias("v2")).collect():
        assert (r.u2, r.v2) == pytest.approx((r.u, r.v), abs=1e-6)
    none = spark.range(1).select(*g.to_equirect([F.lit(0.0)] * 3, 512, 256)).first()
    assert none[0] is None


def test_morphology(spark):
    ring = [(x, z) for x in range(5) for z in range(5) if (x, z) != (2, 2)]
    cells = spark.createDataFrame(ring, "gx long, gz long")
    assert (2, 2) in {(r.gx, r.gz) for r in grids.close_open(cells, 3).collect()}
    dot = spark.createDataFrame([(0, 0)], "gx long, gz long")
    assert {(r.gx, r.gz) for r in grids.close_open(dot, 5).filter("kept").collect()} == set()
    assert grids.kernel_for(0.05) == 5 and grids.kernel_for(0.1) == 3
    assert [sum(dz == k for _, dz in grids.kernel(7)) for k in range(-3, 4)] == [1, 5, 7, 7, 7, 5, 1]
    assert grids.kernel(1) == [(0, 0)] and len(grids.kernel(3)) == 5 and len(grids.kernel(5)) == 17


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0 0 1 0 0 0 1\n\nbroken line\n3 1 2 3 0 0 0 1\n")
    rows = trajectories.read_trajectories(spark, str(tmp_path)).orderBy("frame_seq").collect()
    assert [(r.frame_seq, r.frame_id, r.tz) for r in rows] == [(0, "1", 1.0), (2, "3", 3.0)]
    body = "# c\n7 1 0 0 0 0.5 0 2 1 a.png\n1.5 2.5 -1 3 4 9\n8 1 0 0 0 0 0 0 1 b.png\n\n"
    img = {r.image_id: r for r in sparse_model.parse_images(spark.createDataFrame([("f", body)], "source string, body string")).collect()}
    assert [(o.kp_idx, o.x, o.point_id) for o in img[7].observations] == [(0, 1.5, -1), (1, 3.0, 9)]
    assert img[8].name == "b.png" and not img[8].observations
    pts = sparse_model.parse_points(spark.createDataFrame([("f", "# h\n5 1 2 3 10 20 30 0.5 7 0 8 4\n")], "source string, body string")).first()
    assert (pts.point_id, pts.g, [(k.image_id, k.kp_idx) for k in pts.track]) == (5, 20, [(7, 0), (8, 4)])
    cam = sparse_model.parse_cameras(spark.createDataFrame([("f", "1 PINHOLE 640 480 500 501 320 240\n")], "source string, body string")).first()
    assert (cam.model, cam.width, cam.params) == ("PINHOLE", 640, [500.0, 501.0, 320.0, 240.0])


def test_files_read_in_byte_ranges(spark, tmp_path):
    """One file in many ranges: two-line records, blank and missing second lines, comments and carriage returns."""
    folder = tmp_path / "images"
    folder.mkdir()
    text, want = ["# head"], {}
    for i in range(700):
        obs = [(j, float(i + j), j - 1) for j in range(i % 7)]
        text.append(f"{i} 1 0 0 0 0.5 0 2 1 {i:06d}.png" + "\r" * (i % 5 == 0))
        text.append(" ".join(f"{x} 0 {p}" for _, x, p in obs))
        if i % 50 == 0:
            text += ["", "# note", ""]
        want[i] = obs
    (folder / "a.txt").write_text("\n".join(text) + "\n9000 1 0 0 0 0 0 0 1 last.png", newline="")
    (folder / "b.txt").write_text("\n8000 1 0 0 0 0 0 0 1 other.png\n1 2 3\n")
    want |= {9000: [], 8000: [(0, 1.0, 3)]}
    poses = tmp_path / "poses"
    poses.mkdir()
    (poses / "t.txt").write_text("".join(f"{i} {i}.5 0 1 0 0 0 1\n" if i % 9 != 4 else "cut short\n\n" for i in range(2000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert lines.read_lines(spark, str(folder)).rdd.getNumPartitions() > 20
        rows = sparse_model.read_images(spark, str(folder)).collect()
        frames = trajectories.read_trajectories(spark, str(poses)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == len(want)
    assert {r.image_id: [(o.kp_idx, o.x, o.point_id) for o in r.observations] for r in rows} == want
    assert sorted((r.frame_seq, r.frame_id, r.tx) for r in frames) == [(i, str(i), i + 0.5) for i in range(2000) if i % 9 != 4]


def test_long_route_is_folded_as_a_stream(spark):
    """A square spiral of 50,000 steps beside a trip of one: four steps a side, a door on every third step, far more than one batch."""
    n = 50_000
    long = [(7, i, False, 1.0, float(90 * (i // 4 % 4)), float(90 * ((i + 1) // 4 % 4)) if i + 1 < n else None, 0.5 if i % 3 == 0 else None, 0.0) for i in range(n)]
    rows = [*long, (8, 0, False, 2.0, 90.0, None, None, 0.0)]
    steps = spark.createDataFrame(
        rows, "trip_id long, i int, moved boolean, len double, bearing double, bearing2 double, door_px double, initial_heading double"
    )
    got = {(r.trip_id, r.i): r for r in commands.fold_steps(steps.orderBy(F.rand(3))).collect()}
    assert len(got) == n + 1
    for i in range(n):
        r = got[7, i]
        assert r.heading == 90.0 * (i // 4 % 4)
        assert r.is_turn == (i > 0 and i % 4 == 0) and r.before is None
        end = i % 4 == 3 or i == n - 1
        assert (r.after is not None) == end
        if end:
            assert (r.after.px, r.after.door, r.after.e0, r.after.e1) == (4.0, 0.5, i - 3, i)
    assert (got[8, 0].turn, got[8, 0].is_turn, got[8, 0].after.px) == (90.0, True, 2.0)


def test_fold_over_a_floor_change(spark):
    """The open stretch is closed before the change, the heading starts again from the initial one."""
    rows = [
        ("a", 0, False, 1.0, 0.0, 10.0, None, 0.0), ("a", 1, False, 2.0, 10.0, 0.0, None, 0.0), ("a", 2, True, 9.0, 0.0, 90.0, None, 0.0),
        ("a", 3, False, 3.0, 90.0, None, 1.0, 0.0),
    ]
    steps = spark.createDataFrame(
        rows, "trip_id string, i int, moved boolean, len double, bearing double, bearing2 double, door_px double, initial_heading double"
    )
    r = commands.fold_steps(steps).orderBy("i").collect()
    assert [x.after for x in r[:3]] == [None] * 3 and [x.before for x in r[:2]] == [None] * 2
    assert (r[2].before.px, r[2].before.e0, r[2].before.e1, r[2].turn) == (3.0, 0, 1, None)
    assert (r[3].turn, r[3].is_turn, r[3].after.px, r[3].after.door, r[3].after.e0) == (90.0, True, 3.0, 1.0, 3)
    assert commands.fold_steps(steps.limit(0)).collect() == []


def test_speech_rules_apply_wherever_one_finds_something(spark):
    said = ["", "plain words", " lead", "trail ", "trail\n", "two  gaps", "a_b", "a__b , c", "stop .", "停 。", "x@@ !", "tab\tonly", "a/b\\c", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    plain = F.col("s")
    for pattern, replacement in text.SPEECH_RULES:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(replacement))
    assert all(r.a == r.b for r in df.select(text.speakable(F.col("s")).alias("a"), plain.alias("b")).collect())


def test_payload_records_are_read_in_one_pass(spark, folder):
    from __spark_entry__ import queries

    plan = queries()["payload_fields"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
