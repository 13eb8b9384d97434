"""Sight lines, snapping and nearest edges over the grid against all edges and against the column expressions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.operators import polygons as pg
from waymark.operators import sight
from waymark.operators.polygons import MAP_KEY

c = F.col


def rooms(rng, n):
    """Rectangles on a coarse grid, so walls touch, overlap and run along each other."""
    out = []
    for k in range(n):
        x, y = rng.integers(0, 12, 2) * 10.0
        w, h = rng.integers(1, 5, 2) * 10.0
        out.append((k, int(rng.choice([0, 0, 0, 1, 2])), [(x, y), (x, y + h), (x + w, y + h), (x + w, y)]))
    return out


def polys_of(shapes):
    return [{"group_id": g, "edges": [dict(zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]} for _, g, ring in shapes]


def as_columns(spark, shapes):
    rows = [("P", "B", "F", k, g, "", [[float(x), float(y)] for x, y in ring]) for k, g, ring in shapes]
    df = spark.createDataFrame(rows, "place string, building string, floor string, pos long, group_id int, label string, ring array<array<double>>")
    return pg.floor_geometry(df)


def points(rng, n):
    coarse = rng.integers(-2, 34, (n, 2)) * 5.0
    return np.where(rng.random((n, 1)) < 0.5, coarse, rng.uniform(-10, 170, (n, 2)))


@pytest.mark.parametrize("seed", range(4))
def test_against_columns(spark, seed):
    rng = np.random.default_rng(seed)
    shapes = rooms(rng, 14)
    floors = as_columns(spark, shapes)
    plan = sight.Plan.of(polys_of(shapes))
    p, q = points(rng, 400), points(rng, 400)
    rows = spark.createDataFrame([(i, *map(float, (*a, *b)), "P", "B", "F") for i, (a, b) in enumerate(zip(p, q, strict=True))], "id long, px double, py double, qx double, qy double, place string, building string, floor string")
    both = pg.with_visibility(rows.join(floors, MAP_KEY), ("px", "py", "qx", "qy"))
    want = {r.id: r.visible for r in both.collect()}
    got = plan.visible(p[:, 0], p[:, 1], q[:, 0], q[:, 1])
    assert {i: bool(v) for i, v in enumerate(got)} == want
    door = pg.door_crossing(rows.join(floors, MAP_KEY), ("px", "py", "qx", "qy"))
    want = [r.door_px for r in door.orderBy("id").collect()]
    got = plan.first_door(p[:, 0], p[:, 1], q[:, 0], q[:, 1])
    assert [None if np.isnan(v) else round(float(v), 9) for v in got] == [None if v is None else round(v, 9) for v in want]
    line = pg.boundary_pieces(floors)
    nav = [(float(x), float(y)) for x, y in points(rng, 30)]
    spots = rows.select("id", *MAP_KEY, c("px").alias("x"), c("py").alias("y")).join(line, MAP_KEY)
    inside = pg.snap_inside(spots, "x", "y", 7.0).orderBy("id").collect()
    sx, sy = plan.snap_inside(p[:, 0].copy(), p[:, 1].copy(), 7.0)
    assert np.allclose(np.stack([sx, sy], 1), [(r.sx, r.sy) for r in inside], atol=1e-9)
    toward = pg.snap_toward(spots.withColumn("nav", F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in nav])), "x", "y").orderBy("id").collect()
    n = np.array(nav)
    sx, sy = plan.snap_toward(p[:, 0].copy(), p[:, 1].copy(), sight.Edges(n[:, 0], n[:, 1], n[:, 0], n[:, 1]), 5.0)
    assert np.allclose(np.stack([sx, sy], 1), [(r.sx, r.sy) for r in toward], atol=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_nearest_edge_against_all(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 1000, (700, 2)), rng.uniform(-30, 30, (700, 2))
    b = a + b
    grid = sight.Edges(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    x, y = rng.uniform(-400, 1400, 300), rng.uniform(-400, 1400, 300)
    edge, d, fx, fy = grid.nearest(x, y)
    every = np.array([grid.foot(np.full(700, u), np.full(700, v), np.arange(700))[0] for u, v in zip(x, y, strict=True)])
    assert np.allclose(d, every.min(axis=1))
    assert np.allclose(np.hypot(fx - x, fy - y), d) and (every[np.arange(300), edge] <= every.min(axis=1) + 1e-9).all()
    assert (sight.Edges([], [], [], []).nearest(x, y)[0] == -1).all()


def test_large_floor_tests_near_edges_only():
    """A floor of 10^5 edges: a segment is tested against the edges of its cells, a point search looks at a few rings."""
    side = 160
    x, y = np.meshgrid(np.arange(side) * 10.0, np.arange(side) * 10.0)
    x, y = x.ravel(), y.ravel()
    ax = np.concatenate([x, x, x + 8, x + 8])
    ay = np.concatenate([y, y + 8, y + 8, y])
    bx = np.concatenate([x, x + 8, x + 8, x])
    by = np.concatenate([y + 8, y + 8, y, y])
    plan = sight.Plan(ax, ay, bx, by, np.tile(np.arange(side * side), 4), np.zeros(side * side, int))
    assert len(plan.ax) > 100_000
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10 * side, (2000, 2))
    q = p + rng.uniform(-20, 20, (2000, 2))
    seg, _ = plan.near(p[:, 0], p[:, 1], q[:, 0], q[:, 1])
    assert len(seg) < 60 * 2000
    sure = (np.floor(p / 10) == np.floor(q / 10)).all(axis=1) & ((p % 10 > 0.1) & (p % 10 < 7.9) & (q % 10 > 0.1) & (q % 10 < 7.9)).all(axis=1)
    seen = plan.visible(p[:, 0], p[:, 1], q[:, 0], q[:, 1])
    assert seen[sure].all() and not seen[(np.floor(p / 10) != np.floor(q / 10)).any(axis=1)].any()
    assert (plan.nearest(p[:, 0], p[:, 1])[1] <= 5).all()


@pytest.mark.parametrize("seed", range(40))
def test_few_edges_are_met_without_the_grid(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    shapes = rooms(rng, int(rng.integers(1, 14)))
    few = sight.Plan.of(polys_of(shapes))
    monkeypatch.setattr(sight, "FEW", -1)
    grid = sight.Plan.of(polys_of(shapes))
    assert few.rings is not None and grid.rings is None
    p, q = points(rng, 400), points(rng, 400)
    ends = p[:, 0], p[:, 1], q[:, 0], q[:, 1]
    monkeypatch.setattr(few, "near", None)  # the grid is not asked
    seen = few.visible(*ends)
    assert (seen == grid.visible(*ends)).all() and (few.contains(*ends[:2]) == grid.contains(*ends[:2])).all()
    monkeypatch.setattr(sight, "TABLE", 50)
    assert (seen == few.visible(*ends)).all()


def test_small_floors_are_sent_on_together(spark):
    rows = spark.createDataFrame([("P", "B", f"F{f}", f * 10 + k) for f in range(300) for k in range(3)], "place string, building string, floor string, id long")
    sizes = sight.by_floor({"own": rows}, rows, "id", False, lambda held, part: [sight.column(part, "id")], "id long").mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches if b.num_rows), "n long"
    )
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 900 and len(got) <= 2 * spark.sparkContext.defaultParallelism


def test_one_floor_with_very_many_rows_is_dealt(spark, monkeypatch):
    """A floor with a third of all nodes: its pairs come from several blocks and equal those of all pairs."""
    monkeypatch.setattr(sight, "BLOCK", 8)
    rng = np.random.default_rng(5)
    shapes = rooms(rng, 9)
    floors = as_columns(spark, shapes)
    spots = points(rng, 90)
    nodes = spark.createDataFrame([("P", "B", "F", i, float(a), float(b), i % 3 == 0) for i, (a, b) in enumerate(spots)] + [("P", "B", "none", 1, 0.0, 0.0, False)], "place string, building string, floor string, id long, x double, y double, any boolean")
    got = sight.seen_pairs(nodes, nodes, floors, "id", "id", later=True)
    plan = sight.Plan.of(polys_of(shapes))
    i, j = np.divmod(np.arange(90 * 90), 90)
    keep = (j % 3 == 0) | (i < j)
    i, j = i[keep], j[keep]
    see = plan.visible(spots[i, 0], spots[i, 1], spots[j, 0], spots[j, 1])
    assert {(r.a, r.b) for r in got.collect()} == set(zip(i[see].tolist(), j[see].tolist(), strict=True))
    assert got.count() == see.sum() and sight.seen_pairs(nodes.limit(0), nodes, floors, "id", "id", later=True).count() == 0


def test_points_of_a_floor_without_edges_stay(spark):
    """A floor with one node has no edges: its point is not moved, and the other floors are served."""
    from waymark.operators import floor_graph as fg

    points_ = spark.createDataFrame([(1, "P", "B", "lone", 3.0, 4.0), (2, "P", "B", "two", 5.0, 1.0)], "point_id long, place string, building string, floor string, x double, y double")
    edges = spark.createDataFrame([("P", "B", "two", 0, 0.0, 0.0, 10.0, 0.0)], "place string, building string, floor string, edge_id long, ax double, ay double, bx double, by double")
    got = {r.point_id: (r.sx, r.sy, r.dist) for r in fg.snap_to_route(points_, edges, 40.0).collect()}
    assert got == {1: (3.0, 4.0, None), 2: (5.0, 0.0, 1.0)}


def test_all_candidate_links_are_given(spark):
    """Hidden pairs stay in ``visible_pairs(hidden=True)``, and pairs that cross no door in ``door_pairs``; both equal the column expressions."""
    from waymark.operators import floor_graph as fg

    rng = np.random.default_rng(11)
    shapes = rooms(rng, 12)
    floors = as_columns(spark, shapes)
    kinds = rng.choice([3, 4, 5, 6], 60).tolist()
    nodes = spark.createDataFrame([("P", "B", "F", i, float(a), float(b), k) for i, ((a, b), k) in enumerate(zip(points(rng, 60), kinds, strict=True))], "place string, building string, floor string, node_id long, x double, y double, group_id int")
    a = nodes.filter("group_id in (3, 4)").select(*MAP_KEY, c("node_id").alias("a"), c("x").alias("px"), c("y").alias("py"))
    b = nodes.filter("group_id in (3, 4, 5)").select(*MAP_KEY, c("node_id").alias("b"), c("x").alias("qx"), c("y").alias("qy"), (c("group_id") == 5).alias("any"))
    pairs = a.join(b, MAP_KEY).filter("any or a < b").join(floors, MAP_KEY)
    want = {(r.a, r.b): r.visible for r in pg.with_visibility(pairs, ("px", "py", "qx", "qy")).select("a", "b", "visible").collect()}
    got = [(r.a, r.b, r.visible) for r in fg.visible_pairs(nodes, floors, hidden=True).collect()]
    assert {(i, j): v for i, j, v in got} == want and len(got) == len(want) and set(want.values()) == {True, False}
    seen = {(r.a, r.b) for r in fg.visible_pairs(nodes, floors).collect()}
    assert seen == {k for k, v in want.items() if v}
    want = {(r.a, r.b): r.door_px and round(r.door_px, 9) for r in pg.door_crossing(pairs, ("px", "py", "qx", "qy")).select("a", "b", "door_px").collect()}
    got = [(r.a, r.b, r.door_px and round(r.door_px, 9)) for r in fg.door_pairs(nodes, floors).collect()]
    assert {(i, j): v for i, j, v in got} == want and len(got) == len(want) and None in want.values()


def test_first_doors_keeps_every_row_and_matches_the_polygon_test(spark):
    rng = np.random.default_rng(5)
    rows = [("P", "B", "F", k, *ends) for k, ends in enumerate((rng.random((300, 4)) * [40, 20, 40, 20]).tolist())]
    odd = [("P", "B", "F", 0, None, 1.0, 2.0, 3.0), (None, "B", "F", 1, 1.0, 1.0, 39.0, 1.0), ("P", "B", "none", 2, 1.0, 1.0, 39.0, 1.0), ("P", "B", "F", 3, 5.0, 5.0, 5.0, 5.0)]
    ring = [[0.0, 0.0], [40.0, 0.0], [40.0, 20.0], [0.0, 20.0]]
    door = [[18.0, 4.0], [22.0, 4.0], [22.0, 16.0], [18.0, 16.0]]
    polys = spark.createDataFrame([("P", "B", "F", 0, 0, "room", ring), ("P", "B", "F", 1, 2, "door", door)], "place string, building string, floor string, pos long, group_id int, label string, ring array<array<double>>")
    floors = pg.floor_geometry(polys)
    steps = spark.createDataFrame(rows + rows[:1] + odd, "place string, building string, floor string, k long, px double, py double, qx double, qy double")
    seg = ("px", "py", "qx", "qy")
    order = lambda df: sorted((tuple(str(v) for v in r[:8]), r.door_px and round(r.door_px, 9)) for r in df.select(*steps.columns, "door_px").collect())
    got = sight.first_doors(steps, floors, seg, "k")
    want = pg.door_crossing(steps.join(floors, MAP_KEY, "left"), seg)
    assert order(got) == order(want)
    assert got.filter("door_px IS NOT NULL").count() > 20


@pytest.mark.parametrize("size", [0, 1, 900, 1 << 40])
def test_tally_equals_unique(size):
    key = np.random.default_rng(3).integers(0, min(size, 1 << 20), 500) if size else np.zeros(0, np.int64)
    got, want = sight.tally(key, size), np.unique(key, return_counts=True)
    assert [v.tolist() for v in got] == [v.tolist() for v in want]
