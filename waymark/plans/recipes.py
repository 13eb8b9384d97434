"""Views of the driver tables as mapping entities, in DataFrame form and as SQL for the checks.

Every recipe keeps all rows. Groups that stand for one image, one floor or one
connector are cut from dense keys with integer division, so they stay small
however large the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUSTOMERS_PER_FLOOR_BLOCK = 300
SUPPLIERS_PER_FLOOR_BLOCK = 20
SUPPLIERS_PER_CONNECTOR = 100
KEYPOINTS_PER_IMAGE = 125
DEPTH_WIDTH, DEPTH_HEIGHT = 64, 32

MAP_KEY = ["place", "building", "floor"]


def c(name: str):
    return F.col(name)


# --- floors and shapes --------------------------------------------------------

NATIONS_SQL = "nat AS (SELECT n_nationkey, r_name AS place, n_name AS building FROM nation JOIN region ON n_regionkey = r_regionkey)"

POINTS_SQL = f"""{NATIONS_SQL},
pts AS (
  SELECT place, building, 'F'||(c_custkey//{CUSTOMERS_PER_FLOOR_BLOCK}) AS floor, 1000 + c_custkey AS pos,
         CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 3 END AS group_id, c_name AS label,
         ['up','right','down','left',''][CAST(c_custkey % 5 AS INT)+1] AS description,
         CAST((c_custkey*17) % 400 AS DOUBLE) AS x, CAST((c_custkey*29) % 60 AS DOUBLE) AS y
  FROM customer JOIN nat ON c_nationkey = n_nationkey
  UNION ALL
  SELECT place, building, 'F'||(s_suppkey//{SUPPLIERS_PER_FLOOR_BLOCK}), 1000000000000 + s_suppkey,
         4, 'E'||n_nationkey||'-'||(s_suppkey//{SUPPLIERS_PER_CONNECTOR}),
         ['staircase','elevator','escalator'][CAST(n_nationkey % 3 AS INT)+1],
         CAST((s_suppkey*53) % 400 AS DOUBLE), CAST((s_suppkey*31) % 60 AS DOUBLE)
  FROM supplier JOIN nat ON s_nationkey = n_nationkey),
nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY place, building, floor ORDER BY pos) - 1 AS BIGINT) AS node_id FROM pts),
floors AS (SELECT DISTINCT place, building, floor FROM pts)"""

# Fixed geometry of every floor: three joined rooms, a fourth behind a door, one obstacle.
RECTANGLES = (
    (0, 0, "Room 0", 0.0, 0.0, 100.0, 60.0),
    (1, 0, "Room 1", 100.0, 0.0, 200.0, 60.0),
    (2, 0, "", 200.0, 0.0, 300.0, 60.0),
    (3, 0, "Room 3", 310.0, 0.0, 400.0, 60.0),
    (4, 2, "Door 4", 295.0, 25.0, 315.0, 35.0),
    (5, 1, "Block 5", 140.0, 20.0, 160.0, 40.0),
)

RECTS_SQL = "rects(pos, group_id, label, x0, y0, x1, y1) AS (VALUES " + ", ".join(
    f"({p}::BIGINT, {gid}, '{lab}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)"
    for p, gid, lab, a, b, d, e in RECTANGLES
) + ")"

# Edges of the rectangles in corner order (x0,y0) (x0,y1) (x1,y1) (x1,y0).
EDGES_SQL = f"""{RECTS_SQL},
edges AS (
  SELECT pos, group_id, 0 AS k, x0 AS ax, y0 AS ay, x0 AS bx, y1 AS by FROM rects UNION ALL
  SELECT pos, group_id, 1, x0, y1, x1, y1 FROM rects UNION ALL
  SELECT pos, group_id, 2, x1, y1, x1, y0 FROM rects UNION ALL
  SELECT pos, group_id, 3, x1, y0, x0, y0 FROM rects)"""


def nations(t) -> DataFrame:
    # nation and region are fixed dimension tables (25 and 5 rows).
    return t.nation.join(F.broadcast(t.region), c("n_regionkey") == c("r_regionkey")).select(
        "n_nationkey", c("r_name").alias("place"), c("n_name").alias("building")
    )


def point_shapes(t) -> DataFrame:
    """Waypoints (3) and destinations (5) from customers, connectors (4) from suppliers."""
    nat = F.broadcast(nations(t))
    hints = F.array(*[F.lit(v) for v in ("up", "right", "down", "left", "")])
    kinds = F.array(*[F.lit(v) for v in ("staircase", "elevator", "escalator")])
    key = c("c_custkey")
    places = t.customer.join(nat, c("c_nationkey") == c("n_nationkey")).select(
        "place", "building",
        F.concat(F.lit("F"), F.floor(key / CUSTOMERS_PER_FLOOR_BLOCK)).alias("floor"),
        (key + 1000).alias("pos"),
        F.when(key % 3 == 0, 5).otherwise(3).alias("group_id"),
        c("c_name").alias("label"),
        hints[(key % 5).cast("int")].alias("description"),
        ((key * 17) % 400).cast("double").alias("x"),
        ((key * 29) % 60).cast("double").alias("y"),
    )
    s = c("s_suppkey")
    connectors = t.supplier.join(nat, c("s_nationkey") == c("n_nationkey")).select(
        "place", "building",
        F.concat(F.lit("F"), F.floor(s / SUPPLIERS_PER_FLOOR_BLOCK)).alias("floor"),
        (s + 1_000_000_000_000).alias("pos"),
        F.lit(4).alias("group_id"),
        F.concat(F.lit("E"), c("n_nationkey"), F.lit("-"), F.floor(s / SUPPLIERS_PER_CONNECTOR)).alias("label"),
        kinds[(c("n_nationkey") % 3).cast("int")].alias("description"),
        ((s * 53) % 400).cast("double").alias("x"),
        ((s * 31) % 60).cast("double").alias("y"),
    )
    return places.unionByName(connectors)


def floors(t) -> DataFrame:
    return point_shapes(t).select(*MAP_KEY).distinct()


def floor_shapes(t) -> DataFrame:
    """All shapes of all floors in the annotation layout (polygons, points, companion lines)."""
    pts = point_shapes(t)
    point_rows = pts.select(
        *MAP_KEY, "pos", F.lit("point").alias("shape_type"), "group_id", "label", "description",
        F.array(F.array("x", "y")).alias("points"),
    )
    lines = pts.filter((c("group_id") == 4) & (c("pos") % 2 == 0)).select(
        *MAP_KEY, (c("pos") + 1_000_000_000_000).alias("pos"), F.lit("line").alias("shape_type"),
        F.lit(6).alias("group_id"), "label", F.lit("").alias("description"),
        F.array(F.array(c("x") - 5, c("y")), F.array(c("x") + 5, c("y"))).alias("points"),
    )
    rects = F.array(*[
        F.struct(
            F.lit(p).cast("long").alias("pos"), F.lit(gid).alias("group_id"), F.lit(lab).alias("label"),
            F.array(F.array(F.lit(a), F.lit(b)), F.array(F.lit(d), F.lit(e))).alias("points"),
        )
        for p, gid, lab, a, b, d, e in RECTANGLES
    ])
    areas = floors(t).select(*MAP_KEY, F.explode(rects).alias("s")).select(
        *MAP_KEY, "s.pos", F.lit("rectangle").alias("shape_type"), "s.group_id", "s.label",
        F.lit("").alias("description"), "s.points",
    )
    return areas.unionByName(point_rows).unionByName(lines)


SCALES_SQL = """scales AS (SELECT place, building, floor, coalesce(CASE WHEN n_nationkey % 5 <> 4 THEN (5 + n_nationkey % 5) / 100 END, 1.0) AS m_per_px
  FROM floors JOIN nat USING (place, building))"""


def stored_scales(t) -> DataFrame:
    """Scales on file; floors of every fifth nation have none."""
    known = nations(t).filter(c("n_nationkey") % 5 != 4)
    return floors(t).join(F.broadcast(known), ["place", "building"]).select(
        *MAP_KEY, ((c("n_nationkey") % 5 + 5) / 100).alias("m_per_px")
    )


# --- frames, observations, points ------------------------------------------------

OBS_SQL = """obs AS (SELECT l_suppkey AS image, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS kp_idx,
   CAST(l_orderkey % 640 AS DOUBLE) AS x, CAST(l_partkey % 480 AS DOUBLE) AS y,
   CASE WHEN l_linenumber % 7 <> 0 THEN l_partkey ELSE -1 END AS point_id FROM lineitem)"""

LANDMARK_SQL = "landmarks AS (SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS px, p_retailprice/100 AS py, CAST(p_partkey % 97 AS DOUBLE) AS pz FROM part)"


def observations(t) -> DataFrame:
    """image, kp_idx, x, y, point_id (-1 = none). The index is the line's rank within its image."""
    from waymark.operators.ranks import group_index

    rows = t.lineitem.select(
        c("l_suppkey").alias("image"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    ranked = group_index(
        rows, ["image"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "kp_idx"
    )
    return ranked.select(
        "image", "kp_idx", (c("l_orderkey") % 640).cast("double").alias("x"),
        (c("l_partkey") % 480).cast("double").alias("y"),
        F.when(c("l_linenumber") % 7 != 0, c("l_partkey")).otherwise(F.lit(-1).cast("long")).alias("point_id"),
    )


def landmarks(t) -> DataFrame:
    return t.part.select(
        c("p_partkey").alias("point_id"), c("p_size").cast("double").alias("px"),
        (c("p_retailprice") / 100).alias("py"), (c("p_partkey") % 97).cast("double").alias("pz"),
    )


CLOUD_SQL = """cloud AS (SELECT l_suppkey AS kf, l_quantity AS x, l_discount*10 + l_tax + 0.0 AS y, l_extendedprice/1000 AS z,
  CAST(l_partkey % 256 AS DOUBLE) AS r, CAST(l_suppkey % 256 AS DOUBLE) AS g, CAST(l_orderkey % 256 AS DOUBLE) AS b,
  l_orderkey, l_linenumber, l_partkey FROM lineitem)"""


def cloud(t) -> DataFrame:
    return t.lineitem.select(
        c("l_suppkey").alias("kf"), c("l_quantity").alias("x"),
        (c("l_discount") * 10 + c("l_tax") + 0.0).alias("y"), (c("l_extendedprice") / 1000).alias("z"),
        (c("l_partkey") % 256).cast("double").alias("r"), (c("l_suppkey") % 256).cast("double").alias("g"),
        (c("l_orderkey") % 256).cast("double").alias("b"), "l_orderkey", "l_linenumber", "l_partkey",
    )


DEPTH_SQL = f"""depth AS (SELECT o_orderkey, o_orderkey // {DEPTH_WIDTH * DEPTH_HEIGHT} AS img, o_orderkey % {DEPTH_WIDTH} AS u,
  (o_orderkey // {DEPTH_WIDTH}) % {DEPTH_HEIGHT} AS v, 0.2 + o_totalprice/50000 AS gt,
  (0.2 + o_totalprice/50000) * (1 + ((o_orderkey*13) % 21 - 10)/100) AS pred, (o_orderkey % 5)/2 AS conf FROM orders)"""


def depth(t) -> DataFrame:
    k = c("o_orderkey")
    gt = c("o_totalprice") / 50000 + 0.2
    return t.orders.select(
        "o_orderkey", F.floor(k / (DEPTH_WIDTH * DEPTH_HEIGHT)).alias("img"), (k % DEPTH_WIDTH).alias("u"),
        (F.floor(k / DEPTH_WIDTH) % DEPTH_HEIGHT).alias("v"), gt.alias("gt"),
        (gt * (((k * 13) % 21 - 10) / 100 + 1)).alias("pred"), ((k % 5) / 2).alias("conf"),
    )


TRAJ_SQL = """traj AS (SELECT user_id AS session, event_type AS map_key, event_id, ts,
  CAST((event_id*37) % 11 - 5 AS DOUBLE) AS dx, CAST((event_id*53) % 11 - 5 AS DOUBLE) AS dy,
  value AS inliers, value*7.3 AS heading FROM events)"""


def trajectory(t) -> DataFrame:
    e = c("event_id")
    return t.events.select(
        c("user_id").alias("session"), c("event_type").alias("map_key"), "event_id", "ts",
        ((e * 37) % 11 - 5).cast("double").alias("dx"), ((e * 53) % 11 - 5).cast("double").alias("dy"),
        c("value").alias("inliers"), (c("value") * 7.3).alias("heading"),
    )


# --- routes over all floors ---------------------------------------------------------

# Five floors of all buildings of a place are a site. Each floor has two staircases through its building's floors of the site; every fourth supplier's
# connector leads to other buildings of the site. Sites grow in number with the data; no way leads from one to another.
FLOORS_PER_SITE = 5
ROUTE_NODES_SQL = f"""{POINTS_SQL},
sfl AS (SELECT place, building, floor, n_nationkey::BIGINT AS nk, CAST(floor[2:] AS BIGINT) AS f FROM floors JOIN nat USING (place, building)),
rnodes AS (SELECT pos AS node, place, building, floor, group_id, CASE WHEN group_id=4 AND (pos-1000000000000) % 4 = 1 THEN 'W'||place||'-'||((pos-1000000000000)//{SUPPLIERS_PER_CONNECTOR}) ELSE label END AS label, description, CASE WHEN group_id=4 THEN x+0.5 ELSE x END AS x, CASE WHEN group_id=4 THEN y+0.25 ELSE y END AS y FROM pts
  UNION ALL SELECT 2000000000000 + nk*1000000000 + f*2, place, building, floor, 4, 'S'||nk||'-'||(f//{FLOORS_PER_SITE}), 'staircase', 290.5, 50.25 FROM sfl
  UNION ALL SELECT 2000000000001 + nk*1000000000 + f*2, place, building, floor, 4, 'T'||nk||'-'||(f//{FLOORS_PER_SITE}), 'staircase', 20.5, 10.25 FROM sfl)"""


def route_points(t) -> DataFrame:
    """Nodes of all floors with an id of their own (``node``): waypoints, destinations and connectors, staircases included."""
    pts = point_shapes(t)
    s = c("pos") - 1_000_000_000_000
    walkway = F.concat(F.lit("W"), c("place"), F.lit("-"), F.floor(s / SUPPLIERS_PER_CONNECTOR))
    label = F.when((c("group_id") == 4) & (s % 4 == 1), walkway).otherwise(c("label"))
    # Connectors stand a little beside the other points, so no two nodes of a floor share a place.
    own = pts.select(
        c("pos").alias("node"), *MAP_KEY, "group_id", label.alias("label"), "description",
        *[F.when(c("group_id") == 4, c(n) + d).otherwise(c(n)).alias(n) for n, d in (("x", 0.5), ("y", 0.25))],
    )
    f = F.substring("floor", 2, 18).cast("long")
    nk = c("n_nationkey").cast("long")
    floors_ = floors(t).join(F.broadcast(nations(t)), ["place", "building"])
    stairs = F.array(*[
        F.struct((nk * 1_000_000_000 + f * 2 + 2_000_000_000_000 + k).alias("node"), F.concat(F.lit(name), nk, F.lit("-"), F.floor(f / FLOORS_PER_SITE)).alias("label"), F.lit(x).alias("x"), F.lit(y).alias("y"))
        for k, (name, x, y) in enumerate((("S", 290.5, 50.25), ("T", 20.5, 10.25)))
    ])
    stairs = floors_.select(*MAP_KEY, F.explode(stairs).alias("s")).select("s.node", *MAP_KEY, F.lit(4).alias("group_id"), "s.label", F.lit("staircase").alias("description"), "s.x", "s.y")
    return own.unionByName(stairs)


# --- a multigraph over customers, for edge lists with repeats --------------------------

SITE = 64
NET_SQL = f"""n AS (SELECT count(*) AS n FROM customer),
site AS (SELECT c_custkey AS k, c_custkey - c_custkey % {SITE} AS b, c_custkey % {SITE} AS r, least({SITE}, n - (c_custkey - c_custkey % {SITE})) AS g FROM customer, n),
net AS (SELECT k AS src, b + (r+1) % g AS dst, CAST(1+(k*31) % 9 AS DOUBLE) AS weight FROM site UNION ALL
        SELECT k, b + (r*7+1) % g, CAST(1+(k*17) % 23 AS DOUBLE) FROM site UNION ALL
        SELECT k, b + (r*13+5) % g, CAST(1+(k*11) % 23 AS DOUBLE) FROM site)"""


def site(k, n):
    """First node of a node's site and the site's size."""
    base = k - k % SITE
    return base, F.least(F.lit(SITE), n - base)


def network(t) -> DataFrame:
    from waymark.operators.ranks import with_row

    size = t.customer.agg(F.count("*").alias("n"))
    k = c("c_custkey")
    b, g = site(k, c("n"))
    r = k % SITE
    base = with_row(t.customer.select("c_custkey"), size)
    arms = F.array(
        F.struct((b + (r + 1) % g).alias("dst"), ((k * 31) % 9 + 1).cast("double").alias("weight")),
        F.struct((b + (r * 7 + 1) % g).alias("dst"), ((k * 17) % 23 + 1).cast("double").alias("weight")),
        F.struct((b + (r * 13 + 5) % g).alias("dst"), ((k * 11) % 23 + 1).cast("double").alias("weight")),
    )
    return base.select(k.alias("src"), F.explode(arms).alias("e")).select("src", "e.dst", "e.weight")
