"""Point clouds, grids and trajectories (D and the cloud joins of C)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators import cells, clouds, grids
from waymark.plans import recipes as rec
from waymark.plans.registry import query

c = F.col
clean = g.clean
ID = ("l_orderkey", "l_linenumber", "l_partkey", "kf")
ID_SQL = "l_orderkey, l_linenumber, l_partkey, kf"
FULL = ("l_orderkey", "l_linenumber", "l_partkey", "kf", "x", "z", "y")


@query(
    "height_band",
    f"""WITH {rec.CLOUD_SQL}, s AS (SELECT median(z) AS m, stddev_pop(z) AS d FROM cloud)
    SELECT {ID_SQL}, x, z FROM cloud, s WHERE z > m - 1*d AND z < m + 1*d""",
)
def height_band(t):
    return clouds.height_band(rec.cloud(t), "z", width=1.0).select(*ID, "x", "z")


@query(
    "percentile_band",
    f"""WITH {rec.CLOUD_SQL}, s AS (SELECT quantile_cont(z,0.1) AS p0, quantile_cont(z,0.3) AS p1 FROM cloud),
    k AS (SELECT cloud.* FROM cloud, s WHERE z BETWEEN p0 AND p1),
    q AS (SELECT kf, quantile_cont(x,0.05) AS x0, quantile_cont(x,0.95) AS x1, quantile_cont(z,0.05) AS z0, quantile_cont(z,0.95) AS z1 FROM k GROUP BY kf)
    SELECT {ID_SQL}, x, z FROM k JOIN q USING (kf) WHERE x BETWEEN x0 AND x1 AND z BETWEEN z0 AND z1""",
)
def percentile_band(t):
    band = clouds.percentile_band(rec.cloud(t), "z", 0.1, 0.3)
    return clouds.trim_axes(band, ["x", "z"], 0.05, ["kf"]).select(*ID, "x", "z")


@query(
    "centroid_outliers",
    f"""WITH {rec.CLOUD_SQL}, m AS (SELECT kf, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud GROUP BY kf),
    d AS (SELECT cloud.*, sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) AS dist FROM cloud JOIN m USING (kf)),
    s AS (SELECT kf, stddev_pop(dist) AS sd FROM d GROUP BY kf)
    SELECT {ID_SQL}, round(dist,5)+0.0 AS dist FROM d JOIN s USING (kf) WHERE dist < 2*sd""",
)
def centroid_outliers(t):
    return clouds.centroid_outliers(rec.cloud(t), 2.0, ["kf"]).select(*ID, clean(c("dist"), 5).alias("dist"))


GRID_SQL = f"""{rec.CLOUD_SQL}, f AS (SELECT min(x)-0.5 AS x0, max(x)+0.5 AS x1, min(z)-0.5 AS z0, max(z)+0.5 AS z1 FROM cloud),
fr AS (SELECT *, CAST(trunc((x1-x0)/0.5) AS BIGINT) AS w, CAST(trunc((z1-z0)/0.5) AS BIGINT) AS h FROM f),
pc AS (SELECT cloud.*, CAST(trunc((x-x0)/0.5) AS BIGINT) AS gx, CAST(trunc((z-z0)/0.5) AS BIGINT) AS gz, w, h FROM cloud, fr),
cells AS (SELECT gx, gz, count(*) AS n, CAST(trunc(avg(r)) AS BIGINT) AS r, CAST(trunc(avg(g)) AS BIGINT) AS g, CAST(trunc(avg(b)) AS BIGINT) AS b
  FROM pc WHERE gx BETWEEN 0 AND w-1 AND gz BETWEEN 0 AND h-1 GROUP BY gx, gz)"""
RES = 0.5


def grid(t):
    pts = rec.cloud(t)
    frame = clouds.grid_frame(pts, RES)
    return clouds.occupancy(pts, frame, RES), frame


@query("occupancy_grid", f"WITH {GRID_SQL} SELECT gx, gz, n, r, g, b FROM cells")
def occupancy_grid(t):
    return grid(t)[0]


@query(
    "coverage",
    f"WITH {GRID_SQL}, o AS (SELECT count(*) AS occupied FROM cells) SELECT occupied, w AS grid_w, h AS grid_h, round(occupied*100.0/(w*h),6)+0.0 AS percent FROM o, fr",
)
def coverage(t):
    cells_, frame = grid(t)
    return clouds.coverage(cells_, frame).select("occupied", "grid_w", "grid_h", clean(c("percent")).alias("percent"))


@query(
    "topdown_raster",
    f"""WITH {rec.CLOUD_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM cloud),
    p AS (SELECT x0 - greatest(x1-x0,0.1)*0.1 AS x0, x1 + greatest(x1-x0,0.1)*0.1 AS x1, z0 - greatest(z1-z0,0.1)*0.1 AS z0, z1 + greatest(z1-z0,0.1)*0.1 AS z1 FROM b),
    s AS (SELECT (x0+x1)/2 - greatest(x1-x0,z1-z0)/2 AS x0, (z0+z1)/2 + greatest(x1-x0,z1-z0)/2 AS z1, greatest(x1-x0,z1-z0)/400 AS res FROM p),
    q AS (SELECT cloud.*, least(399,greatest(0,CAST(trunc((x-s.x0)/res) AS BIGINT))) AS px, least(399,greatest(0,CAST(trunc((s.z1-z)/res) AS BIGINT))) AS pz FROM cloud, s)
    SELECT px, pz, arg_max(r,(l_orderkey,l_linenumber,l_partkey,kf,x,z,y)) AS r, arg_max(g,(l_orderkey,l_linenumber,l_partkey,kf,x,z,y)) AS g, arg_max(b,(l_orderkey,l_linenumber,l_partkey,kf,x,z,y)) AS b FROM q GROUP BY px, pz""",
)
def topdown_raster(t):
    return clouds.topdown_raster(rec.cloud(t), 400, FULL)


@query(
    "cloud_bounds",
    f"""WITH {rec.CLOUD_SQL} SELECT kf, count(*) AS n, min(x) AS x_min, max(x) AS x_max, round(avg(x),5)+0.0 AS x_mean, min(z) AS z_min, max(z) AS z_max, round(avg(z),5)+0.0 AS z_mean
    FROM cloud GROUP BY ROLLUP(kf)""",
)
def cloud_bounds(t):
    out = clouds.range_metadata(rec.cloud(t), ["kf"], ["x", "z"])
    return out.withColumns({a: clean(c(a), 5) for a in ("x_mean", "z_mean")})


@query(
    "plane_cov",
    f"""WITH {rec.CLOUD_SQL} SELECT kf, count(*) AS n, round(covar_samp(x,x),4)+0.0 AS xx, round(covar_samp(x,y),4)+0.0 AS xy, round(covar_samp(x,z),4)+0.0 AS xz,
    round(covar_samp(y,y),4)+0.0 AS yy, round(covar_samp(y,z),4)+0.0 AS yz, round(covar_samp(z,z),4)+0.0 AS zz FROM cloud GROUP BY kf""",
)
def plane_cov(t):
    out = clouds.covariance(rec.cloud(t), ["kf"])
    return out.withColumns({p: clean(c(p), 4) for p in ("xx", "xy", "xz", "yy", "yz", "zz")})


@query(
    "plane_normal",
    f"""WITH {rec.CLOUD_SQL}, v AS (SELECT kf, count(*) AS n, covar_samp(x,x) AS xx, covar_samp(x,y) AS xy, covar_samp(x,z) AS xz, covar_samp(y,y) AS yy, covar_samp(y,z) AS yz, covar_samp(z,z) AS zz FROM cloud GROUP BY kf HAVING count(*)>=3),
    q AS (SELECT *, (xx+yy+zz)/3 AS m FROM v), p AS (SELECT *, sqrt((pow(xx-m,2)+pow(yy-m,2)+pow(zz-m,2)+2*(xy*xy+xz*xz+yz*yz))/6) AS s FROM q),
    d AS (SELECT *, ((xx-m)*((yy-m)*(zz-m)-yz*yz)-xy*(xy*(zz-m)-yz*xz)+xz*(xy*yz-(yy-m)*xz))/(2*s*s*s) AS h FROM p)
    SELECT kf, n, 1.0 AS length, true AS upward, round(m+2*s*cos(acos(least(greatest(h,-1),1))/3+2*pi()/3),3)+0.0 AS spread, true AS turned FROM d""",
)
def plane_normal(t):
    """The normal as SQL can hold it: of unit length, not downward, with the covariance's smallest eigenvalue as spread along it, and turned onto +Y."""
    pts = rec.cloud(t)
    got = clouds.plane_normal(pts, ["kf"]).join(clouds.covariance(pts, ["kf"]).drop("n"), "kf")
    x, y, z = c("nx"), c("ny"), c("nz")
    spread = x * x * c("xx") + y * y * c("yy") + z * z * c("zz") + 2 * (x * y * c("xy") + x * z * c("xz") + y * z * c("yz"))
    top = [c(f"r{3 * i}") * x + c(f"r{3 * i + 1}") * y + c(f"r{3 * i + 2}") * z for i in range(3)]
    turned = (F.abs(top[0]) < 0.02) & (F.abs(top[1] - 1) < 0.02) & (F.abs(top[2]) < 0.02)
    return got.select("kf", "n", F.round(F.sqrt(x * x + y * y + z * z), 6).alias("length"), (y >= 0).alias("upward"), clean(spread, 3).alias("spread"), turned.alias("turned"))


@query(
    "track_length",
    f"WITH {rec.OBS_SQL} SELECT point_id, CAST(count(*) AS BIGINT) AS track, count(DISTINCT image) AS images FROM obs WHERE point_id>=0 GROUP BY 1 HAVING count(*)>=3",
)
def track_length(t):
    seen = t.lineitem.select(
        c("l_suppkey").alias("image"), F.when(c("l_linenumber") % 7 != 0, c("l_partkey")).otherwise(-1).alias("point_id")
    )
    return clouds.track_lengths(seen)


@query(
    "distinct_landmarks",
    f"""WITH {rec.LANDMARK_SQL} SELECT DISTINCT px::FLOAT::DOUBLE AS px, round(py::FLOAT::DOUBLE,4)+0.0 AS py, pz::FLOAT::DOUBLE AS pz FROM landmarks
    WHERE point_id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber % 7 <> 0)""",
)
def distinct_landmarks(t):
    obs = t.lineitem.filter(c("l_linenumber") % 7 != 0).select(c("l_partkey").alias("point_id"))
    out = clouds.distinct_landmarks(obs, rec.landmarks(t))
    return out.select(c("px").cast("double"), clean(c("py").cast("double"), 4).alias("py"), c("pz").cast("double"))


MASK_W, MASK_H = 32, 16
MASKED_SQL = f"""{rec.CLOUD_SQL},
kfs AS (SELECT s_suppkey AS kf, cos(radians((s_suppkey*10) % 360)) AS co, sin(radians((s_suppkey*10) % 360)) AS si,
   -CAST(s_suppkey % 50 AS DOUBLE) AS tx, 0.5 AS ty, -CAST(s_suppkey % 100 AS DOUBLE) AS tz FROM supplier WHERE s_suppkey % 7 <> 3),
cm AS (SELECT cloud.*, k.kf AS known, co*x+si*z+tx AS cx, y+ty AS cy, -si*x+co*z+tz AS cz FROM cloud LEFT JOIN kfs k ON k.kf=cloud.kf),
uv AS (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) AS s FROM cm),
px AS (SELECT *, CAST(round_even(CASE WHEN s>=1e-10 THEN {MASK_W}*(atan2(cx,cz)/(2*pi())+0.5) END,0) AS BIGINT) AS u,
              CAST(round_even(CASE WHEN s>=1e-10 THEN {MASK_H}*(asin(cy/s)/pi()+0.5) END,0) AS BIGINT) AS v FROM uv),
st AS (SELECT {ID_SQL}, u, v, CASE WHEN known IS NULL THEN 'no_keyframe' WHEN kf % 5 = 2 THEN 'no_mask'
  WHEN u BETWEEN 0 AND {MASK_W - 1} AND v BETWEEN 4 AND {MASK_H - 1} AND (u+v+kf) % 3 <> 0 THEN 'floor' ELSE 'outside_mask' END AS status FROM px)"""


def masked(t):
    s = c("s_suppkey")
    rot = g.rot_y(((s * 10) % 360).cast("double"))
    kfs = t.supplier.filter(s % 7 != 3).select(
        s.alias("kf"), *[r.alias(f"r{i}") for i, r in enumerate(rot)],
        (-(s % 50).cast("double")).alias("tx"), F.lit(0.5).alias("ty"), (-(s % 100).cast("double")).alias("tz"),
    )
    px = t.supplier.filter(s % 5 != 2).select(
        s.alias("kf"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MASK_W - 1).cast("long"))).alias("u")
    ).select("kf", "u", F.explode(F.sequence(F.lit(4).cast("long"), F.lit(MASK_H - 1).cast("long"))).alias("v"))
    masks = px.filter((c("u") + c("v") + c("kf")) % 3 != 0)
    return clouds.masked_points(rec.cloud(t), kfs, masks, (MASK_W, MASK_H))


@query("masked_points", f"WITH {MASKED_SQL} SELECT {ID_SQL}, u, v, status FROM st")
def masked_points(t):
    return masked(t).select(*ID, "u", "v", "status")


@query(
    "outcome_stats",
    f"WITH {MASKED_SQL} SELECT status, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (),6)+0.0 AS share FROM st GROUP BY status",
)
def outcome_stats(t):
    return clouds.outcome_shares(masked(t), "status").select("status", "n", clean(c("share")).alias("share"))


@query(
    "grid_overlay",
    f"""WITH {GRID_SQL}, a AS (SELECT DISTINCT gx,gz FROM pc WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT gx,gz FROM pc WHERE l_linenumber % 2 = 0)
    SELECT coalesce(a.gx,b.gx) AS gx, coalesce(a.gz,b.gz) AS gz, CASE WHEN b.gx IS NULL THEN 'a only' WHEN a.gx IS NULL THEN 'b only' ELSE 'both' END AS where_set FROM a FULL JOIN b ON a.gx=b.gx AND a.gz=b.gz""",
)
def grid_overlay(t):
    pts = rec.cloud(t)
    frame = clouds.grid_frame(pts, RES)
    placed = clouds.attach(pts, frame).withColumns({
        "gx": clouds.cell(c("x"), c("x_min"), RES), "gz": clouds.cell(c("z"), c("z_min"), RES),
    })
    # Two extraction methods, each finding part of the floor.
    a = placed.filter(c("l_linenumber") % 2 == 1)
    b = placed.filter(c("l_linenumber") % 2 == 0)
    return clouds.grid_overlay(a, b)


def morph_sql(side):
    """Closing with an elliptic kernel of ``side`` and opening with one of 3, from the formula of the ellipse."""

    def kernel(name, k):
        r = k // 2
        far = f"round_even({r}*sqrt(1-dz*dz/({r}*{r})::DOUBLE),0)" if r else "0"
        return f"{name}(dx,dz) AS (SELECT dx, dz FROM range(-{r},{r + 1}) a(dx), range(-{r},{r + 1}) b(dz) WHERE abs(dx)<={far})"

    return f"""WITH {GRID_SQL}, {kernel('kc', side)}, {kernel('k3', 3)},
d1 AS (SELECT DISTINCT gx+dx AS gx, gz+dz AS gz FROM cells, kc),
cl AS (SELECT gx+dx AS gx, gz+dz AS gz FROM d1, kc GROUP BY ALL HAVING count(*)=(SELECT count(*) FROM kc)),
e1 AS (SELECT gx+dx AS gx, gz+dz AS gz FROM cl, k3 GROUP BY ALL HAVING count(*)=5),
op AS (SELECT DISTINCT gx+dx AS gx, gz+dz AS gz FROM e1, k3),
gr AS (SELECT gx+dx AS gx, gz+dz AS gz, max(r) AS r, max(g) AS g, max(b) AS b FROM cells, k3 GROUP BY 1, 2)
SELECT cl.gx, cl.gz, op.gx IS NOT NULL AS kept, coalesce(gr.r,0) AS r, coalesce(gr.g,0) AS g, coalesce(gr.b,0) AS b
FROM cl LEFT JOIN op ON op.gx=cl.gx AND op.gz=cl.gz LEFT JOIN gr ON gr.gx=cl.gx AND gr.gz=cl.gz"""


def morphology(t, side):
    cells_, _ = grid(t)
    closed = grids.close_open(cells_, side)
    return closed.join(grids.fill_colours(cells_, closed), ["gx", "gz"])


@query("grid_morphology", morph_sql(5))
def grid_morphology(t):
    return morphology(t, 5)


@query("grid_morphology_wide", morph_sql(9))
def grid_morphology_wide(t):
    """The kernel of a finer grid, whose closing distance covers nine cells."""
    return morphology(t, grids.kernel_for(0.025))


@query(
    "progressive_cloud",
    f"""WITH {rec.CLOUD_SQL}, k AS (SELECT DISTINCT kf FROM cloud)
    SELECT k.kf, count(*) AS n, round(median(z),6)+0.0 AS median, round(median(z)-2*stddev_pop(z),4)+0.0 AS band_lo, round(median(z)+2*stddev_pop(z),4)+0.0 AS band_hi
    FROM k JOIN cloud c ON c.kf <= k.kf GROUP BY k.kf""",
)
def progressive_cloud(t):
    out = clouds.running_band(rec.cloud(t).select("kf", "z"), "kf", "z")
    return out.select("kf", "n", clean(c("median")).alias("median"), clean(c("band_lo"), 4).alias("band_lo"), clean(c("band_hi"), 4).alias("band_hi"))


DOOR_SQL = """dp AS (SELECT c_custkey AS id, (c_custkey//40)*3.0::DOUBLE + abs(c_acctbal) % 2 AS x, (c_custkey%40)*0.8::DOUBLE AS z FROM customer)"""


@query(
    "door_clusters",
    f"""WITH RECURSIVE {DOOR_SQL},
    e AS (SELECT a.id AS a, b.id AS b FROM dp a JOIN dp b ON a.id<>b.id AND abs(a.x-b.x)<=1 AND abs(a.z-b.z)<=1 AND sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z))<=1.0),
    reach(a,b) AS (SELECT id,id FROM dp UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a=r.b),
    lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a),
    cen AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(z) AS cz FROM lab JOIN dp USING (id) GROUP BY 1)
    SELECT cluster, n, round(cx,5)+0.0 AS cx, round(cz,5)+0.0 AS cz, 18*4 AS stamped FROM cen""",
)
def door_clusters(t):
    k = c("c_custkey")
    pts = t.customer.select(
        k.alias("id"), (F.floor(k / 40) * 3.0 + F.abs("c_acctbal") % 2).alias("x"), ((k % 40) * 0.8).alias("z")
    )
    groups = cells.components(pts, "id", ["x", "z"], 1.0)
    centres = groups.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("z").alias("cz"))
    stamps = grids.stamp(centres, "cx", "cz", 0.05).groupBy("cluster").agg(F.count("*").alias("stamped"))
    return centres.join(stamps, "cluster").select(
        "cluster", "n", clean(c("cx"), 5).alias("cx"), clean(c("cz"), 5).alias("cz"), "stamped"
    )


RAY_SQL = f"""{rec.CLOUD_SQL},
mk AS (SELECT l_suppkey AS kf, l_partkey % 8 + (l_suppkey*5) % 56 AS u, l_orderkey % 6 + 14 AS v FROM lineitem),
ce AS (SELECT kf, CAST(trunc(avg(u)) AS BIGINT) AS u, CAST(trunc(avg(v)) AS BIGINT) AS v FROM mk GROUP BY kf),
br AS (SELECT kf, (u/64-0.5)*2*pi() AS lon, (v/32-0.5)*pi() AS lat, radians((kf*10) % 360) AS a FROM ce),
bw AS (SELECT kf, a, cos(lat)*sin(lon) AS bx, sin(lat) AS b_y, cos(lat)*cos(lon) AS bz FROM br),
wd AS (SELECT kf, cos(a)*bx - sin(a)*bz AS wx, b_y AS wy, sin(a)*bx + cos(a)*bz AS wz, CAST(kf % 50 AS DOUBLE) AS px, 1.0 AS py, CAST(kf % 100 AS DOUBLE) AS pz FROM bw),
sm AS (SELECT kf, i, px+wx*(0.5+i*0.5) AS sx, py+wy*(0.5+i*0.5) AS sy, pz+wz*(0.5+i*0.5) AS sz FROM wd, range(20) r(i)),
fp AS (SELECT DISTINCT x,y,z FROM cloud),
hit AS (SELECT kf, i, x, y, z, sqrt((sx-x)*(sx-x)+(sy-y)*(sy-y)+(sz-z)*(sz-z)) AS d FROM sm JOIN fp ON abs(sx-x)<0.5 AND abs(sy-y)<0.5 AND abs(sz-z)<0.5)"""


@query(
    "door_rays",
    f"WITH {RAY_SQL} SELECT kf, arg_min(x,(d,i,x,y,z)) AS x, round(arg_min(y,(d,i,x,y,z)),5)+0.0 AS y, arg_min(z,(d,i,x,y,z)) AS z, round(min(d),5)+0.0 AS dist FROM hit WHERE d<0.5 GROUP BY kf",
)
def door_rays(t):
    s = c("s_suppkey")
    kfs = t.supplier.select(
        s.alias("kf"), *[r.alias(f"r{i}") for i, r in enumerate(g.rot_y(((s * 10) % 360).cast("double")))],
        (s % 50).cast("double").alias("px"), F.lit(1.0).alias("py"), (s % 100).cast("double").alias("pz"),
    )
    masks = t.lineitem.select(
        c("l_suppkey").alias("kf"), (c("l_partkey") % 8 + (c("l_suppkey") * 5) % 56).alias("u"), (c("l_orderkey") % 6 + 14).alias("v")
    )
    out = cells.door_points(masks, kfs, rec.cloud(t).select("x", "y", "z"), (64, 32))
    return out.select("kf", "x", clean(c("y"), 5).alias("y"), "z", clean(c("dist"), 5).alias("dist"))


@query(
    "traj_normalize",
    f"""WITH {rec.TRAJ_SQL}, p AS (SELECT session, event_id, sum(dx) OVER w AS x, sum(dy) OVER w AS z FROM traj WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
    m AS (SELECT session, avg(x) AS mx, avg(z) AS mz FROM p GROUP BY 1), q AS (SELECT p.*, x-mx AS cx, z-mz AS cz FROM p JOIN m USING (session)),
    e AS (SELECT session, max(sqrt(cx*cx+cz*cz)) AS far FROM q GROUP BY 1)
    SELECT session, event_id, round(cx*CASE WHEN far>0 THEN 10.0/far ELSE 1 END,5)+0.0 AS nx, round(cz*CASE WHEN far>0 THEN 10.0/far ELSE 1 END,5)+0.0 AS nz FROM q JOIN e USING (session)""",
)
def traj_normalize(t):
    from waymark.operators.frames import positions

    out = clouds.trajectory_normalize(positions(rec.trajectory(t)), ["session"], 10.0)
    return out.select("session", "event_id", clean(c("nx"), 5).alias("nx"), clean(c("nz"), 5).alias("nz"))
