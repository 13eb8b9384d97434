"""Rooms, visibility, doors, snapping and floor graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geometry import clean
from waymark.operators import floor_graph as fg
from waymark.operators import polygons as pg
from waymark.operators import sight
from waymark.plans import recipes as rec
from waymark.plans.lookup_queries import CONNECTOR_SQL, connector_nodes, nav_nodes
from waymark.plans.registry import query
from waymark.sources import annotations as ann

c = F.col
MAP_KEY = rec.MAP_KEY


def floor_polys(t):
    return pg.floor_geometry(ann.shape_polygons(rec.floor_shapes(t)))


# Outline of the fixed floor plan and its open interior, worked out by hand.
OUTLINE_SQL = """ol(ax,ay,bx,b_y) AS (SELECT a::DOUBLE, b::DOUBLE, c::DOUBLE, d::DOUBLE FROM (VALUES (0,0,0,60),(0,60,300,60),(300,60,300,35),(300,35,310,35),(310,35,310,60),(310,60,400,60),(400,60,400,0),
 (400,0,310,0),(310,0,310,25),(310,25,300,25),(300,25,300,0),(300,0,0,0),(140,20,140,40),(140,40,160,40),(160,40,160,20),(160,20,140,20)) v(a,b,c,d))"""


def interior_sql(x, y):
    return (
        f"((({x}>0 AND {x}<300 AND {y}>0 AND {y}<60) OR ({x}>310 AND {x}<400 AND {y}>0 AND {y}<60) OR ({x}>295 AND {x}<315 AND {y}>25 AND {y}<35))"
        f" AND NOT ({x}>=140 AND {x}<=160 AND {y}>=20 AND {y}<=40))"
    )


def visible_sql(source):
    """CTEs that decide visibility of the coordinate quads in ``source`` (px,py,qx,qy)."""
    q = "px, py, qx, qy"
    return f"""sg AS (SELECT DISTINCT {q}, qx-px AS dx, qy-py AS dy, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS len FROM {source}),
se AS (SELECT sg.*, ax-px AS wx, ay-py AS wy, bx-ax AS ex, e.by-ay AS ey, dx*(e.by-ay)-dy*(bx-ax) AS den, (ax-px)*dy-(ay-py)*dx AS off FROM sg, edges e),
ts AS (SELECT {q}, dx, dy, len, 0.0::DOUBLE AS t FROM sg UNION SELECT {q}, dx, dy, len, 1.0 FROM sg
  UNION SELECT {q}, dx, dy, len, (wx*ey-wy*ex)/den FROM se WHERE abs(den)>1e-12 AND off/den BETWEEN -1e-12 AND 1+1e-12 AND (wx*ey-wy*ex)/den BETWEEN 0 AND 1
  UNION SELECT {q}, dx, dy, len, (wx*dx+wy*dy)/(len*len) FROM se WHERE abs(den)<=1e-12 AND abs(off)<=1e-9 AND len>0 AND (wx*dx+wy*dy)/(len*len) BETWEEN 0 AND 1
  UNION SELECT {q}, dx, dy, len, (wx*dx+wy*dy+ex*dx+ey*dy)/(len*len) FROM se WHERE abs(den)<=1e-12 AND abs(off)<=1e-9 AND len>0 AND (wx*dx+wy*dy+ex*dx+ey*dy)/(len*len) BETWEEN 0 AND 1),
iv AS (SELECT *, lead(t) OVER (PARTITION BY {q} ORDER BY t) AS t1 FROM ts),
md AS (SELECT {q}, t, (t+t1)/2 AS m, dx, dy, CASE WHEN len=0 THEN 1e-6 ELSE -dy/len*1e-6 END AS nx, CASE WHEN len=0 THEN 0 ELSE dx/len*1e-6 END AS ny FROM iv WHERE t1 IS NOT NULL AND ((t1-t)*len>1e-9 OR len=0)),
sp AS (SELECT {q}, t, s, px+m*dx+s*nx AS x, py+m*dy+s*ny AS y FROM md, (VALUES (1),(-1)) k(s)),
pp AS (SELECT {q}, t, s, e.pos, e.group_id, count(*) FILTER ((ay>y)<>(e.by>y) AND x < (bx-ax)*(y-ay)/nullif(e.by-ay,0)+ax) % 2 AS ins FROM sp, edges e GROUP BY ALL),
cv AS (SELECT {q}, t, s, max(CASE WHEN group_id IN (0,2) THEN ins ELSE 0 END) > 0 AND max(CASE WHEN group_id=1 THEN ins ELSE 0 END) = 0 AS cov FROM pp GROUP BY ALL),
ci AS (SELECT {q}, t, sum(CASE WHEN cov THEN 1 ELSE 0 END) AS k FROM cv GROUP BY ALL),
vis AS (SELECT {q}, min(k)>=1 AND max(k)=2 AS visible FROM ci GROUP BY ALL)"""


PAIR_SQL = """np AS (SELECT a.place, a.building, a.floor, a.node_id AS a, b.node_id AS b, b.group_id AS bg, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy
  FROM nodes a JOIN nodes b ON a.place=b.place AND a.building=b.building AND a.floor=b.floor AND a.group_id IN (3,4) AND (b.group_id=5 OR (b.group_id IN (3,4) AND a.node_id<b.node_id)))"""
VISIBLE_SQL = f"{rec.POINTS_SQL}, {rec.EDGES_SQL}, {PAIR_SQL}, {visible_sql('np')}, vp AS (SELECT np.*, visible FROM np JOIN vis USING (px,py,qx,qy))"
GRAPH_SQL = f"""{VISIBLE_SQL}, fe AS (SELECT place, building, floor, a AS src, b AS dst, sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)) AS weight FROM vp WHERE visible UNION ALL
  SELECT place, building, floor, b, a, sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)) FROM vp WHERE visible AND bg<>5)"""


@query(
    "room_lookup",
    f"""WITH {rec.POINTS_SQL}, {rec.RECTS_SQL}
    SELECT place, building, floor, node_id, coalesce((SELECT min_by(CASE WHEN r.label='' THEN 'Unnamed Room' ELSE r.label END, r.pos) FROM rects r WHERE r.group_id=0 AND x>x0 AND x<x1 AND y>y0 AND y<y1),'Unknown') AS room FROM nodes""",
)
def room_lookup(t):
    rows = nav_nodes(t).join(floor_polys(t), MAP_KEY)
    return rows.select(*MAP_KEY, "node_id", pg.room_label(c("polys"), c("x"), c("y")).alias("room"))


@query("visibility_pairs", f"WITH {VISIBLE_SQL} SELECT place, building, floor, a, b, visible FROM vp")
def visibility_pairs(t):
    return fg.visible_pairs(nav_nodes(t), floor_polys(t), hidden=True).select(*MAP_KEY, "a", "b", "visible")


@query("visibility_counts", f"WITH {VISIBLE_SQL} SELECT place, building, floor, count(*) FILTER (visible) AS visible, count(*) FILTER (NOT visible) AS hidden FROM vp GROUP BY ALL")
def visibility_counts(t):
    """How many candidate links of each floor are seen; floors without candidates have no row."""
    out = fg.visibility_counts(nav_nodes(t), fg.visible_pairs(nav_nodes(t), floor_polys(t)))
    return out.filter(c("visible") + c("hidden") > 0)


@query("floor_graph", f"WITH {GRAPH_SQL} SELECT place, building, floor, src, dst, round(weight,6)+0.0 AS weight FROM fe")
def floor_graph(t):
    e = floor_links(t)
    return e.select(*MAP_KEY, "src", "dst", clean(c("weight")).alias("weight"))


def floor_links(t):
    return fg.floor_edges(fg.visible_pairs(nav_nodes(t), floor_polys(t)), nav_nodes(t))


@query(
    "unified_graph",
    f"""WITH {GRAPH_SQL}, {rec.SCALES_SQL}, {CONNECTOR_SQL}
    SELECT 'walk' AS kind, place AS src_place, building AS src_building, floor AS src_floor, src AS src_node, place AS dst_place, building AS dst_building, floor AS dst_floor, dst AS dst_node, round(weight*m_per_px,6)+0.0 AS weight FROM fe JOIN scales USING (place,building,floor)
    UNION ALL SELECT 'connector', ap, ab, af, an, bp, bb, bf, bn, weight FROM cedges""",
)
def unified_graph(t):
    e = fg.unified_edges(floor_links(t), rec.stored_scales(t), connector_nodes(t))
    names = [(*MAP_KEY, "node_id")[i] for i in range(4)]
    short = (*MAP_KEY, "node")
    return e.select(
        "kind", *[c(f"{end}.{a}").alias(f"{end}_{b}") for end in ("src", "dst") for a, b in zip(names, short)], clean(c("weight")).alias("weight")
    )


@query(
    "pose_links",
    f"""WITH {rec.POINTS_SQL}, {rec.EDGES_SQL},
    ps AS (SELECT pos AS pose_id, place, building, floor, x+0.37 AS sx, y+0.21 AS sy FROM pts WHERE group_id=4),
    pn AS (SELECT pose_id, place, building, floor, node_id, sx AS px, sy AS py, x AS qx, y AS qy FROM ps JOIN nodes USING (place,building,floor)), {visible_sql('pn')}
    SELECT pose_id, place, building, floor, node_id, round(sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)),6)+0.0 AS weight FROM pn JOIN vis USING (px,py,qx,qy) WHERE visible""",
)
def pose_links(t):
    poses = rec.point_shapes(t).filter(c("group_id") == 4).select(
        c("pos").alias("pose_id"), *MAP_KEY, (c("x") + 0.37).alias("sx"), (c("y") + 0.21).alias("sy")
    )
    out = fg.pose_links(poses, nav_nodes(t), floor_polys(t))
    return out.withColumn("weight", clean(c("weight")))


@query(
    "door_events",
    f"""WITH {rec.POINTS_SQL}, {PAIR_SQL},
    d AS (SELECT *, qx-px AS dx, qy-py AS dy FROM np),
    s AS (SELECT *, CASE WHEN dx=0 THEN CASE WHEN px>295 AND px<315 THEN 0.0 ELSE 2.0 END ELSE least((295-px)/dx,(315-px)/dx) END AS tx0,
      CASE WHEN dx=0 THEN CASE WHEN px>295 AND px<315 THEN 1.0 ELSE -1.0 END ELSE greatest((295-px)/dx,(315-px)/dx) END AS tx1,
      CASE WHEN dy=0 THEN CASE WHEN py>25 AND py<35 THEN 0.0 ELSE 2.0 END ELSE least((25-py)/dy,(35-py)/dy) END AS ty0,
      CASE WHEN dy=0 THEN CASE WHEN py>25 AND py<35 THEN 1.0 ELSE -1.0 END ELSE greatest((25-py)/dy,(35-py)/dy) END AS ty1 FROM d),
    x AS (SELECT *, greatest(0,tx0,ty0) < least(1,tx1,ty1)-1e-12 AND (dx<>0 OR dy<>0) AND NOT (px BETWEEN 295 AND 315 AND qx BETWEEN 295 AND 315 AND py BETWEEN 25 AND 35 AND qy BETWEEN 25 AND 35) AS hit FROM s)
    SELECT place, building, floor, a, b, CASE WHEN hit THEN round(least(1,greatest(0,((305-px)*dx+(30-py)*dy)/(dx*dx+dy*dy)))*sqrt(dx*dx+dy*dy),6)+0.0 END AS door_px FROM x""",
)
def door_events(t):
    return fg.door_pairs(nav_nodes(t), floor_polys(t)).withColumn("door_px", clean(c("door_px")))


@query(
    "snap_route",
    f"""WITH {rec.POINTS_SQL},
    eg AS (SELECT a.place, a.building, a.floor, a.node_id AS edge_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM nodes a JOIN nodes b ON a.place=b.place AND a.building=b.building AND a.floor=b.floor AND b.node_id=a.node_id+1),
    p AS (SELECT pos AS point_id, place, building, floor, x+3.3 AS x, y+2.1 AS y FROM pts),
    j AS (SELECT point_id, edge_id, p.x, p.y, ax, ay, bx-ax AS dx, b_y-ay AS dy FROM p JOIN eg USING (place,building,floor)),
    k AS (SELECT *, CASE WHEN dx*dx+dy*dy>0 THEN greatest(0,least(1,((x-ax)*dx+(y-ay)*dy)/(dx*dx+dy*dy))) ELSE 0 END AS t FROM j),
    d AS (SELECT *, ax+t*dx AS nx, ay+t*dy AS ny, sqrt((ax+t*dx-x)*(ax+t*dx-x)+(ay+t*dy-y)*(ay+t*dy-y)) AS d FROM k),
    b AS (SELECT point_id, min(d) AS d, arg_min(nx,(d,edge_id)) AS nx, arg_min(ny,(d,edge_id)) AS ny FROM d GROUP BY 1)
    SELECT point_id, place, building, floor, round(CASE WHEN d<=40 THEN nx ELSE x END,4)+0.0 AS sx, round(CASE WHEN d<=40 THEN ny ELSE y END,4)+0.0 AS sy, round(d,4)+0.0 AS dist FROM p LEFT JOIN b USING (point_id)""",
)
def snap_route(t):
    n = nav_nodes(t)
    a = n.select(*MAP_KEY, c("node_id").alias("edge_id"), c("x").alias("ax"), c("y").alias("ay"))
    b = n.select(*MAP_KEY, (c("node_id") - 1).alias("edge_id"), c("x").alias("bx"), c("y").alias("by"))
    points = rec.point_shapes(t).select(c("pos").alias("point_id"), *MAP_KEY, (c("x") + 3.3).alias("x"), (c("y") + 2.1).alias("y"))
    out = fg.snap_to_route(points, a.join(b, [*MAP_KEY, "edge_id"]), 40.0)
    return out.withColumns({n: clean(c(n), 4) for n in ("sx", "sy", "dist")})


#: The outline point nearest to each point of ``st`` (point_id, x, y).
NEAR_OUTLINE_SQL = """nb AS (SELECT point_id, x, y, ax, ay, bx-ax AS dx, ol.b_y-ay AS dy, greatest(0,least(1,((x-ax)*(bx-ax)+(y-ay)*(ol.b_y-ay))/((bx-ax)*(bx-ax)+(ol.b_y-ay)*(ol.b_y-ay)))) AS t FROM st, ol),
nd AS (SELECT point_id, x, y, ax+t*dx AS nx, ay+t*dy AS ny, sqrt((ax+t*dx-x)*(ax+t*dx-x)+(ay+t*dy-y)*(ay+t*dy-y)) AS d FROM nb),
bb AS (SELECT point_id, any_value(x) AS x, any_value(y) AS y, min(d) AS d, arg_min(nx,(d,nx,ny)) AS nx, arg_min(ny,(d,nx,ny)) AS ny FROM nd GROUP BY 1)"""
STRAY_SQL = f"""{rec.POINTS_SQL}, {OUTLINE_SQL}, st AS (SELECT pos AS point_id, place, building, floor, x*1.2-30.3 AS x, y*1.5-15.2 AS y FROM pts), {NEAR_OUTLINE_SQL}"""


def snap_in_sql(offset, name):
    gx, gy = f"(nx-CASE WHEN d=0 THEN 1 ELSE (x-nx)/d END*{offset})", f"(ny-CASE WHEN d=0 THEN 0 ELSE (y-ny)/d END*{offset})"
    return f"""{name} AS (SELECT point_id, CASE WHEN {interior_sql('x', 'y')} THEN x WHEN {interior_sql(gx, gy)} THEN {gx} ELSE nx END AS fx,
      CASE WHEN {interior_sql('x', 'y')} THEN y WHEN {interior_sql(gx, gy)} THEN {gy} ELSE ny END AS fy FROM bb)"""


def strays(t):
    return rec.point_shapes(t).select(
        c("pos").alias("point_id"), *MAP_KEY, (c("x") * 1.2 - 30.3).alias("x"), (c("y") * 1.5 - 15.2).alias("y")
    )


@query(
    "snap_walkable",
    f"WITH {STRAY_SQL}, {snap_in_sql(20.0, 'si')} SELECT point_id, round(fx,4)+0.0 AS sx, round(fy,4)+0.0 AS sy FROM si",
)
def snap_walkable(t):
    out = sight.snapped(strays(t), floor_polys(t), offset=20.0)
    return out.select("point_id", clean(c("sx"), 4).alias("sx"), clean(c("sy"), 4).alias("sy"))


#: Where each point of ``st`` goes: toward the nearest waypoint of ``wp`` (map key, wx, wy) whose ray meets the outline.
TOWARD_SQL = f"""{NEAR_OUTLINE_SQL}, {snap_in_sql(5.0, 'si')},
    h AS (SELECT point_id, st.x, st.y, wx, wy, wx-st.x AS dx, wy-st.y AS dy, ax-st.x AS ux, ay-st.y AS uy, bx-ax AS ex, ol.b_y-ay AS ey FROM st JOIN wp USING (place,building,floor), ol),
    ht AS (SELECT *, (ux*ey-uy*ex)/nullif(dx*ey-dy*ex,0) AS t, (ux*dy-uy*dx)/nullif(dx*ey-dy*ex,0) AS u FROM h WHERE abs(dx*ey-dy*ex)>1e-12),
    hw AS (SELECT point_id, x, y, wx, wy, sqrt((wx-x)*(wx-x)+(wy-y)*(wy-y)) AS d2, min(t) AS t FROM ht WHERE t BETWEEN 0 AND 1 AND u BETWEEN -1e-12 AND 1+1e-12 GROUP BY ALL),
    bw AS (SELECT point_id, arg_min(wx,(d2,t,wx,wy)) AS wx, arg_min(wy,(d2,t,wx,wy)) AS wy, arg_min(t,(d2,t,wx,wy)) AS t FROM hw GROUP BY 1),
    en AS (SELECT st.*, wx, wy, bw.point_id IS NOT NULL AS has, x+t*(wx-x) AS ex, y+t*(wy-y) AS ey FROM st LEFT JOIN bw USING (point_id)),
    nm AS (SELECT *, sqrt((wx-ex)*(wx-ex)+(wy-ey)*(wy-ey)) AS nrm FROM en),
    gg AS (SELECT *, ex+(wx-ex)/nullif(nrm,0)*5 AS gx, ey+(wy-ey)/nullif(nrm,0)*5 AS gy FROM nm),
    sn AS (SELECT point_id, CASE WHEN {interior_sql('x', 'y')} THEN x WHEN NOT has THEN fx WHEN nrm<1e-6 THEN ex WHEN {interior_sql('gx', 'gy')} THEN gx ELSE ex END AS sx,
      CASE WHEN {interior_sql('x', 'y')} THEN y WHEN NOT has THEN fy WHEN nrm<1e-6 THEN ey WHEN {interior_sql('gx', 'gy')} THEN gy ELSE ey END AS sy FROM gg JOIN si USING (point_id))"""


@query(
    "snap_waypoint",
    f"""WITH {rec.POINTS_SQL}, {OUTLINE_SQL}, st AS (SELECT pos AS point_id, place, building, floor, x*1.2-30.3 AS x, y*1.5-15.2 AS y FROM pts),
    wp AS (SELECT place, building, floor, x AS wx, y AS wy FROM nodes WHERE group_id IN (3,4)), {TOWARD_SQL} SELECT point_id, round(sx,4)+0.0 AS sx, round(sy,4)+0.0 AS sy FROM sn""",
)
def snap_waypoint(t):
    nav = nav_nodes(t).filter(c("group_id").isin(*fg.NAV_GROUPS))
    out = sight.snapped(strays(t), floor_polys(t), nav)
    return out.select("point_id", clean(c("sx"), 4).alias("sx"), clean(c("sy"), 4).alias("sy"))
