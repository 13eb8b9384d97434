"""Walkable regions: containment, visibility, door crossings and snapping.

A floor's geometry travels as one array of polygons per floor (an annotation file's
worth), so every test is a narrow expression on the row that needs it.
Polygon: struct<pos, group_id, label, edges: array<struct<ax,ay,bx,by>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage, parallelism

MAP_KEY = ["place", "building", "floor"]
# Shape groups.
WALKABLE, OBSTACLE, DOOR = 0, 1, 2
# Side step of the two-sided midpoint test, in pixels.
STEP = 1e-6
SHORT = 1e-9


def floor_geometry(polygons: DataFrame) -> DataFrame:
    """Polygons (map key, pos, group_id, label, ring) -> map key, polys."""
    ring = F.col("ring")
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    edges = F.transform(
        F.arrays_zip(ring.alias("a"), after.alias("b")),
        lambda e: F.struct(
            e["a"][0].alias("ax"), e["a"][1].alias("ay"), e["b"][0].alias("bx"), e["b"][1].alias("by")
        ),
    )
    flat = polygons.select(*MAP_KEY, "pos", "group_id", "label", edges.alias("edges"))
    return flat.groupBy(*MAP_KEY).agg(
        F.array_sort(F.collect_list(F.struct("pos", "group_id", "label", "edges"))).alias("polys")
    )


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: does a ray to the right cross an odd number of edges?"""
    crossed = F.filter(
        edges,
        lambda e: ((e["ay"] > y) != (e["by"] > y))
        & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]),
    )
    return F.size(crossed) % 2 == 1


def on_edge(edges: Column, x: Column, y: Column, tol: float = 1e-9) -> Column:
    def near(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        off = (x - e["ax"]) * dy - (y - e["ay"]) * dx
        along = (x - e["ax"]) * dx + (y - e["ay"]) * dy
        return (F.abs(off) <= tol) & (along >= -tol) & (along <= dx * dx + dy * dy + tol)

    return F.exists(edges, near)


def covered(polys: Column, x: Column, y: Column) -> Column:
    """In a walkable or door polygon and in no obstacle (points off all edges)."""
    open_ = F.exists(polys, lambda p: p["group_id"].isin(WALKABLE, DOOR) & inside(p["edges"], x, y))
    blocked = F.exists(polys, lambda p: (p["group_id"] == OBSTACLE) & inside(p["edges"], x, y))
    return open_ & ~blocked


def contains_point(polys: Column, x: Column, y: Column) -> Column:
    """Strictly inside the walkable region: all four diagonal side steps are covered."""
    out = None
    for dx, dy in ((STEP, STEP), (STEP, -STEP), (-STEP, STEP), (-STEP, -STEP)):
        one = covered(polys, x + dx, y + dy)
        out = one if out is None else out & one
    return out


def room_label(polys: Column, x: Column, y: Column) -> Column:
    """Label of the first walkable polygon (file order) that strictly contains the point."""
    hits = F.filter(
        polys,
        lambda p: (p["group_id"] == WALKABLE) & inside(p["edges"], x, y) & ~on_edge(p["edges"], x, y),
    )
    label = F.when(hits[0]["label"] == "", "Unnamed Room").otherwise(hits[0]["label"])
    return F.when(F.size(hits) > 0, label).otherwise("Unknown")


def _cuts(edges: Column, px: Column, py: Column, dx: Column, dy: Column) -> Column:
    """Parameters in [0, 1] where the segment meets edges, with both ends, sorted."""
    length2 = dx * dx + dy * dy

    def meet(e):
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        wx, wy = e["ax"] - px, e["ay"] - py
        denom = dx * ey - dy * ex
        off = wx * dy - wy * dx
        parallel = F.abs(denom) <= 1e-12
        safe = F.when(parallel, F.lit(1.0)).otherwise(denom)
        t, u = (wx * ey - wy * ex) / safe, off / safe
        crossing = ~parallel & (u >= -1e-12) & (u <= 1 + 1e-12)
        l2 = F.when(length2 > 0, length2).otherwise(F.lit(1.0))
        a = (wx * dx + wy * dy) / l2
        b = (wx * dx + wy * dy + ex * dx + ey * dy) / l2
        return F.when(crossing, F.array(t)).when(parallel & (F.abs(off) <= 1e-9) & (length2 > 0), F.array(a, b)).otherwise(
            F.array().cast("array<double>")
        )

    inner = F.filter(F.flatten(F.transform(edges, meet)), lambda t: (t > 0) & (t < 1))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))


def side_states(rows: DataFrame, test, edges: Column, seg: tuple[str, str, str, str], name: str) -> DataFrame:
    """Add array ``name``: per elementary interval of the segment, how many of its two sides pass ``test``.

    ``test(x, y)`` gives a boolean Column. Intervals shorter than a nanopixel are left out.
    """
    px, py, qx, qy = (F.col(n) for n in seg)
    dx, dy = qx - px, qy - py
    length = F.sqrt(dx * dx + dy * dy)
    rows = rows.withColumns({"_dx": dx, "_dy": dy, "_len": length})
    rows = rows.withColumn("_ts", _cuts(edges, px, py, F.col("_dx"), F.col("_dy")))
    flat = F.col("_len") == 0
    # Unit normal times the side step; a zero-length segment steps along x.
    safe = F.when(flat, F.lit(1.0)).otherwise(F.col("_len"))
    nx = F.when(flat, F.lit(STEP)).otherwise(-F.col("_dy") / safe * STEP)
    ny = F.col("_dx") / safe * STEP
    rows = rows.withColumns({"_nx": nx, "_ny": ny})
    ts = F.col("_ts")
    spans = F.filter(
        F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda s: ((s["b"] - s["a"]) * F.col("_len") > SHORT) | (F.col("_len") == 0),
    )
    rows = rows.withColumn("_spans", spans)

    def sides(s):
        m = (s["a"] + s["b"]) / 2
        x, y = px + m * F.col("_dx"), py + m * F.col("_dy")
        left = test(x + F.col("_nx"), y + F.col("_ny"))
        right = test(x - F.col("_nx"), y - F.col("_ny"))
        return F.when(left, 1).otherwise(0) + F.when(right, 1).otherwise(0)

    rows = rows.withColumn(name, F.transform("_spans", sides))
    return rows.drop("_dx", "_dy", "_len", "_ts", "_nx", "_ny", "_spans")


def all_edges(polys: Column) -> Column:
    return F.flatten(F.transform(polys, lambda p: p["edges"]))


def with_visibility(rows: DataFrame, seg: tuple[str, str, str, str], name: str = "visible") -> DataFrame:
    """Boolean ``name``: does the walkable region contain the segment? Rows carry ``polys``.

    The region contains it when every interval has a covered side and some interval has
    both: touching the outer boundary is allowed, lying wholly on it is not.
    """
    polys = F.col("polys")
    out = side_states(rows, lambda x, y: covered(polys, x, y), all_edges(polys), seg, "_sides")
    found = F.concat_ws(",", F.array_sort(F.array_distinct("_sides")))
    # As generator output the flag is computed once; a later filter on it cannot be
    # pushed below and repeat the whole test.
    return out.withColumn(name, F.explode(F.array(found.isin("2", "1,2")))).drop("_sides")


def door_crossing(rows: DataFrame, seg: tuple[str, str, str, str], name: str = "door_px") -> DataFrame:
    """Distance along the segment of the first crossed door's centroid; null when none is crossed.

    A door is crossed when part of the segment runs inside it and part outside. Rows
    carry ``polys``; several doors are tried in file order.
    """
    px, py, qx, qy = (F.col(n) for n in seg)
    out = rows.withColumn("_doors", F.filter("polys", lambda p: p["group_id"] == DOOR))

    dx, dy = qx - px, qy - py
    length2 = dx * dx + dy * dy

    def crossed(p):
        ts = _cuts(p["edges"], px, py, dx, dy)
        mids = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts) - 1), lambda a, b: (a + b) / 2)
        length = F.sqrt(length2)
        nx, ny = -dy / length * STEP, dx / length * STEP

        def count(m):
            x, y = px + m * dx, py + m * dy
            left = F.when(inside(p["edges"], x + nx, y + ny), 1).otherwise(0)
            return left + F.when(inside(p["edges"], x - nx, y - ny), 1).otherwise(0)

        n = F.transform(mids, count)
        return (length2 > 0) & F.exists(n, lambda k: k == 2) & F.exists(n, lambda k: k == 0)

    def at(p):
        # Area centroid by the shoelace sums.
        def shoelace(f):
            return F.aggregate(p["edges"], F.lit(0.0), lambda s, e: s + f(e) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))

        area = shoelace(lambda e: F.lit(1.0))
        cx = shoelace(lambda e: e["ax"] + e["bx"]) / (area * 3)
        cy = shoelace(lambda e: e["ay"] + e["by"]) / (area * 3)
        t = ((cx - px) * dx + (cy - py) * dy) / length2
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * F.sqrt(length2)

    first = F.filter("_doors", crossed)
    return out.withColumn("_first", first).withColumn(
        name, F.when(F.size("_first") > 0, F.transform(F.slice("_first", 1, 1), at)[0])
    ).drop("_doors", "_first")


def nearest_on_segment(x: Column, y: Column, e) -> Column:
    """Struct (d, x, y) of the point of edge ``e`` nearest to (x, y)."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.when(l2 > 0, l2).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    nx, ny = e["ax"] + t * dx, e["ay"] + t * dy
    d = F.sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))
    return F.struct(d.alias("d"), nx.alias("x"), ny.alias("y"))


def boundary_pieces(floors: DataFrame) -> DataFrame:
    """map key, polys -> polys, boundary: edge pieces of the walkable region's outline.

    Every edge is cut where it meets the others; a piece belongs to the outline when
    exactly one of its sides is covered.
    """
    floors = cut_lineage(floors).repartition(parallelism(floors.sparkSession), *MAP_KEY)
    edges = floors.select(*MAP_KEY, "polys", F.explode(all_edges(F.col("polys"))).alias("e"))
    e = F.col("e")
    rows = edges.select(*MAP_KEY, "polys", e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rows = rows.withColumn("_ts", _cuts(all_edges(F.col("polys")), F.col("ax"), F.col("ay"), dx, dy))
    ts = F.col("_ts")
    spans = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = rows.select(*MAP_KEY, "polys", "ax", "ay", dx.alias("dx"), dy.alias("dy"), F.explode(spans).alias("s"))
    m = (F.col("s.a") + F.col("s.b")) / 2
    x, y = F.col("ax") + m * F.col("dx"), F.col("ay") + m * F.col("dy")
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    nx, ny = -F.col("dy") / length * STEP, F.col("dx") / length * STEP
    polys = F.col("polys")
    one = covered(polys, x + nx, y + ny) != covered(polys, x - nx, y - ny)
    pieces = cut.filter((length > 0) & ((F.col("s.b") - F.col("s.a")) * length > SHORT)).filter(one).select(
        *MAP_KEY,
        F.struct(
            (F.col("ax") + F.col("s.a") * F.col("dx")).alias("ax"), (F.col("ay") + F.col("s.a") * F.col("dy")).alias("ay"),
            (F.col("ax") + F.col("s.b") * F.col("dx")).alias("bx"), (F.col("ay") + F.col("s.b") * F.col("dy")).alias("by"),
        ).alias("e"),
    )
    outline = pieces.groupBy(*MAP_KEY).agg(F.array_sort(F.collect_set("e")).alias("boundary"))
    return floors.join(outline, MAP_KEY, "left")


def snap_inside(rows: DataFrame, x: str, y: str, offset: float = 20.0) -> DataFrame:
    """Add sx, sy: the point itself when inside, else pushed ``offset`` inward from the nearest outline point.

    Rows carry ``polys`` and ``boundary``.
    """
    px, py, polys = F.col(x), F.col(y), F.col("polys")
    best = F.array_min(F.transform("boundary", lambda e: nearest_on_segment(px, py, e)))
    rows = rows.withColumns({"_in": contains_point(polys, px, py), "_b": best})
    dx, dy = px - F.col("_b.x"), py - F.col("_b.y")
    size = F.sqrt(dx * dx + dy * dy)
    zero = size == 0
    # On the outline itself the push goes along -x.
    ux = F.when(zero, F.lit(1.0)).otherwise(dx / F.when(zero, F.lit(1.0)).otherwise(size))
    uy = F.when(zero, F.lit(0.0)).otherwise(dy / F.when(zero, F.lit(1.0)).otherwise(size))
    rows = rows.withColumns({"_ix": F.col("_b.x") - ux * offset, "_iy": F.col("_b.y") - uy * offset})
    ok = contains_point(polys, F.col("_ix"), F.col("_iy"))
    rows = rows.withColumn("_ok", ok)
    sx = F.when(F.col("_in"), px).when(F.col("_ok"), F.col("_ix")).otherwise(F.col("_b.x"))
    sy = F.when(F.col("_in"), py).when(F.col("_ok"), F.col("_iy")).otherwise(F.col("_b.y"))
    return rows.withColumns({"sx": F.coalesce(sx, px), "sy": F.coalesce(sy, py)}).drop("_in", "_b", "_ix", "_iy", "_ok")


def snap_toward(rows: DataFrame, x: str, y: str, nav: str = "nav", offset: float = 5.0) -> DataFrame:
    """Add sx, sy: walk from an outside point toward the nearest waypoint whose ray meets the outline.

    Rows carry ``polys``, ``boundary`` and array ``nav`` of struct<x, y> of the floor's
    waypoints. Without any meeting ray the point is snapped by ``snap_inside``.
    """
    px, py, polys = F.col(x), F.col(y), F.col("polys")

    def hits(w):
        dx, dy = w["x"] - px, w["y"] - py

        def t_of(e):
            ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
            wx, wy = e["ax"] - px, e["ay"] - py
            denom = dx * ey - dy * ex
            flat = F.abs(denom) <= 1e-12
            safe = F.when(flat, F.lit(1.0)).otherwise(denom)
            t, u = (wx * ey - wy * ex) / safe, (wx * dy - wy * dx) / safe
            return F.when(~flat & (t >= 0) & (t <= 1) & (u >= -1e-12) & (u <= 1 + 1e-12), t)

        return F.array_min(F.filter(F.transform("boundary", t_of), lambda t: t.isNotNull()))

    ranked = F.transform(
        nav,
        lambda w: F.struct(
            ((w["x"] - px) * (w["x"] - px) + (w["y"] - py) * (w["y"] - py)).alias("d"), hits(w).alias("t"), w["x"].alias("x"), w["y"].alias("y")
        ),
    )
    rows = rows.withColumn("_w", F.array_min(F.filter(ranked, lambda r: r["t"].isNotNull())))
    t = F.col("_w.t")
    ex, ey = px + t * (F.col("_w.x") - px), py + t * (F.col("_w.y") - py)
    rows = rows.withColumns({"_ex": ex, "_ey": ey})
    dx, dy = F.col("_w.x") - F.col("_ex"), F.col("_w.y") - F.col("_ey")
    size = F.sqrt(dx * dx + dy * dy)
    tiny = size < 1e-6
    safe = F.when(tiny, F.lit(1.0)).otherwise(size)
    rows = rows.withColumns({"_tiny": tiny, "_gx": F.col("_ex") + dx / safe * offset, "_gy": F.col("_ey") + dy / safe * offset})
    rows = snap_inside(rows, x, y, offset).withColumnsRenamed({"sx": "_fx", "sy": "_fy"})
    rows = rows.withColumns({"_in": contains_point(polys, px, py), "_ok": contains_point(polys, F.col("_gx"), F.col("_gy"))})

    def pick(own, entry, pushed, fallback):
        return (
            F.when(F.col("_in"), own).when(F.col("_w").isNull(), fallback)
            .when(F.col("_tiny"), entry).when(F.col("_ok"), pushed).otherwise(entry)
        )

    out = rows.withColumns({
        "sx": pick(px, F.col("_ex"), F.col("_gx"), F.col("_fx")), "sy": pick(py, F.col("_ey"), F.col("_gy"), F.col("_fy")),
    })
    return out.drop("_w", "_ex", "_ey", "_tiny", "_gx", "_gy", "_fx", "_fy", "_in", "_ok")
