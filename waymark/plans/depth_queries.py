"""Depth rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators import depth as dp
from waymark.operators import fitting
from waymark.plans import recipes as rec
from waymark.plans.registry import query

c = F.col
clean = g.clean
W, H = rec.DEPTH_WIDTH, rec.DEPTH_HEIGHT


@query(
    "depth_to_points",
    f"""WITH {rec.DEPTH_SQL},
    p AS (SELECT *, (u/{W}-0.5)*2*pi() AS lon, (0.5-v/{H})*pi() AS lat FROM depth WHERE pred>0.1 AND pred<50),
    q AS (SELECT *, pred*cos(lat)*sin(lon) AS cx, -pred*sin(lat) AS cy, pred*cos(lat)*cos(lon) AS cz, radians((img*15) % 360) AS a FROM p)
    SELECT o_orderkey, round(cos(a)*(cx-img)-sin(a)*(cz+img),5)+0.0 AS x, round(cy-0.5,5)+0.0 AS y, round(sin(a)*(cx-img)+cos(a)*(cz+img),5)+0.0 AS z,
      round(cx,5)+0.0 AS gl_x, round(-cy,5)+0.0 AS gl_y, round(-cz,5)+0.0 AS gl_z,
      CASE o_orderkey % 4 WHEN 0 THEN o_orderkey/1000 WHEN 1 THEN o_orderkey/4000 WHEN 2 THEN o_orderkey/512 ELSE CAST(o_orderkey AS DOUBLE) END AS metres FROM q""",
)
def depth_to_points(t):
    px = rec.depth(t).filter(g.depth_in_range(c("pred")))
    cam = g.depth_to_camera(c("u"), c("v"), c("pred"), W, H)
    gl = g.depth_to_camera(c("u"), c("v"), c("pred"), W, H, "opengl")
    px = px.select("o_orderkey", "img", *[v.alias(f"c{i}") for i, v in enumerate(cam)], *[v.alias(f"g{i}") for i, v in enumerate(gl)])
    # Keyframe pose: turned about Y, offset with the image number.
    rot = g.rot_y(((c("img") * 15) % 360).cast("double"))
    world = g.camera_to_world(rot, [c("img").cast("double"), F.lit(0.5), -c("img").cast("double")], [c(f"c{i}") for i in range(3)])
    kinds = F.array(*[F.lit(x) for x in ("millimetre", "quarter_mm", "half_k", "metre")])
    return px.select(
        "o_orderkey", *[clean(v, 5).alias(n) for v, n in zip(world, "xyz")], *[clean(c(f"g{i}"), 5).alias(f"gl_{n}") for i, n in enumerate("xyz")],
        g.decode_depth(c("o_orderkey"), kinds[(c("o_orderkey") % 4).cast("int")]).alias("metres"),
    )


@query(
    "pinhole_points",
    f"""WITH {rec.DEPTH_SQL}, q AS (SELECT *, (u-32.0)*pred/40.0 AS cx, (v-16.0)*pred/42.0 AS cy, pred AS cz, radians((img*15) % 360) AS a FROM depth WHERE conf > 0.9)
    SELECT o_orderkey, round(cos(a)*(cx-img)-sin(a)*(cz+img),5)+0.0 AS x, round(cy-0.5,5)+0.0 AS y, round(sin(a)*(cx-img)+cos(a)*(cz+img),5)+0.0 AS z FROM q""",
)
def pinhole_points(t):
    px = rec.depth(t).filter(c("conf") > 0.9)
    cam = g.pinhole_ray_point(c("u"), c("v"), c("pred"), 40.0, 42.0, 32.0, 16.0)
    px = px.select("o_orderkey", "img", *[v.alias(f"c{i}") for i, v in enumerate(cam)])
    rot = g.rot_y(((c("img") * 15) % 360).cast("double"))
    world = g.camera_to_world(rot, [c("img").cast("double"), F.lit(0.5), -c("img").cast("double")], [c(f"c{i}") for i in range(3)])
    return px.select("o_orderkey", *[clean(v, 5).alias(n) for v, n in zip(world, "xyz")])


@query(
    "sample_map",
    f"""WITH {rec.DEPTH_SQL},
    a AS (SELECT o_orderkey, u, v, radians((img*20) % 360) AS yaw, radians((img % 7)*10-30) AS pit FROM depth),
    r AS (SELECT *, 1.0::DOUBLE AS px, (u-31.5)*(2*tan(radians(45.0))/63) AS py, -(v-15.5)*(2*tan(radians(22.5))/31) AS pz FROM a),
    p AS (SELECT *, cos(pit)*px - sin(pit)*pz AS ax, py AS ay, sin(pit)*px + cos(pit)*pz AS az FROM r),
    t AS (SELECT *, cos(yaw)*ax - sin(yaw)*ay AS x, sin(yaw)*ax + cos(yaw)*ay AS y, az AS z FROM p)
    SELECT o_orderkey, round(atan2(y,x)/pi()*511.5+511.5,4)+0.0 AS su, round(-asin(z/sqrt(x*x+y*y+z*z))/(pi()/2)*255.5+255.5,4)+0.0 AS sv,
      CASE WHEN abs(u-31.7)>=abs(v-15.3) AND abs(u-31.7)>=20.1 THEN CASE WHEN u-31.7>=0 THEN 'right' ELSE 'left' END
           WHEN 20.1>=abs(u-31.7) AND 20.1>=abs(v-15.3) THEN 'front' ELSE CASE WHEN v-15.3>=0 THEN 'down' ELSE 'up' END END AS face FROM t""",
)
def sample_map(t):
    px = rec.depth(t)
    su, sv = g.perspective_sample(
        c("u"), c("v"), W, H, 90.0, ((c("img") * 20) % 360).cast("double"), ((c("img") % 7) * 10 - 30).cast("double"), 1024, 512
    )
    face = g.cube_face([c("u") - 31.7, c("v") - 15.3, F.lit(20.1)])
    return px.select("o_orderkey", clean(su, 4).alias("su"), clean(sv, 4).alias("sv"), face.alias("face"))


SAMPLE_SQL = f"""{rec.DEPTH_SQL}, sm AS (SELECT img, u, v, u*1.75+img*3.25 AS su, v*0.9375+0.25 AS sv FROM depth)"""


@query(
    "raster_gather",
    f"""WITH {SAMPLE_SQL},
    n AS (SELECT sm.img, sm.u, sm.v, sqrt(d.pred) AS value FROM sm JOIN depth d ON d.img=sm.img AND d.u=CAST(round_even(su,0) AS BIGINT) % {W} AND d.v=greatest(0,least({H - 1},CAST(round_even(sv,0) AS BIGINT)))),
    tp AS (SELECT sm.img, sm.u, sm.v, (CAST(floor(su) AS BIGINT)+dx) % {W} AS x, greatest(0,least({H - 1},CAST(floor(sv) AS BIGINT)+dy)) AS y,
        CASE WHEN dx=1 THEN su-floor(su) ELSE 1-(su-floor(su)) END * CASE WHEN dy=1 THEN sv-floor(sv) ELSE 1-(sv-floor(sv)) END AS w
      FROM sm, (VALUES (0,0),(0,1),(1,0),(1,1)) k(dx,dy)),
    b AS (SELECT tp.img, tp.u, tp.v, CASE WHEN sum(w)>0 THEN sum(w*sqrt(pred))/sum(w) END AS value FROM tp JOIN depth d ON d.img=tp.img AND d.u=x AND d.v=y GROUP BY ALL)
    SELECT 'nearest' AS mode, img, u, v, round(value,9)+0.0 AS value FROM n UNION ALL SELECT 'bilinear', img, u, v, round(value,9)+0.0 FROM b""",
)
def raster_gather(t):
    px = rec.depth(t)
    sample = px.select("img", "u", "v", (c("u") * 1.75 + c("img") * 3.25).alias("su"), (c("v") * 0.9375 + 0.25).alias("sv"))
    src = px.select("img", "u", "v", F.sqrt("pred").alias("value"))
    out = [
        dp.gather(sample, src, W, H, mode=m).select(F.lit(m).alias("mode"), "img", "u", "v", clean(c("value"), 9).alias("value"))
        for m in ("nearest", "bilinear")
    ]
    return out[0].unionByName(out[1])


@query(
    "depth_metrics",
    f"""WITH {rec.DEPTH_SQL}, d AS (SELECT o_orderkey % 3 AS method, gt, pred*(1+(o_orderkey%3)*0.2) AS pred FROM depth),
    s AS (SELECT method, CASE WHEN count(*)>=100 THEN median(gt)/median(pred) ELSE 1 END AS scale FROM d WHERE gt>0.01 AND pred>0.01 GROUP BY method),
    a AS (SELECT 'raw' AS kind, method, gt, pred FROM d UNION ALL SELECT 'scaled', method, gt, pred*scale FROM d JOIN s USING (method))
    SELECT kind, method, count(*) AS n, round(avg(abs(pred-gt)),6)+0.0 AS mae, round(avg(abs(pred-gt)/gt),6)+0.0 AS abs_rel, round(avg((pred-gt)*(pred-gt)/gt),6)+0.0 AS sq_rel,
      round(sqrt(avg((pred-gt)*(pred-gt))),6)+0.0 AS rms, round(avg(CASE WHEN greatest(pred/gt,gt/pred)<1.25 THEN 1.0 ELSE 0 END),4)+0.0 AS a1,
      round(avg(CASE WHEN greatest(pred/gt,gt/pred)<1.25**2 THEN 1.0 ELSE 0 END),4)+0.0 AS a2, round(avg(CASE WHEN greatest(pred/gt,gt/pred)<1.25**3 THEN 1.0 ELSE 0 END),4)+0.0 AS a3 FROM a GROUP BY kind, method""",
)
def depth_metrics(t):
    m = c("o_orderkey") % 3
    d = rec.depth(t).select(m.alias("method"), "gt", (c("pred") * (m * 0.2 + 1)).alias("pred"))
    scaled = dp.median_scale(d, ["method"]).select(F.lit("scaled").alias("kind"), "method", "gt", "pred")
    both = d.select(F.lit("raw").alias("kind"), "method", "gt", "pred").unionByName(scaled)
    out = dp.error_metrics(both, ["kind", "method"])
    fine = {n: clean(c(n)) for n in ("mae", "abs_rel", "sq_rel", "rms")}
    return out.withColumns({**fine, **{n: clean(c(n), 4) for n in ("a1", "a2", "a3")}})


@query(
    "norm_diff_metrics",
    f"""WITH {rec.DEPTH_SQL}, e AS (SELECT img, min(gt) AS a0, max(gt) AS a1, min(pred) AS b0, max(pred) AS b1 FROM depth GROUP BY img),
    d AS (SELECT img, abs((gt-a0)/(a1-a0+1e-8)-(pred-b0)/(b1-b0+1e-8)) AS diff FROM depth JOIN e USING (img)),
    p AS (SELECT img, avg(diff) AS mae, sqrt(avg(diff*diff)) AS rmse, max(diff) AS max_diff, median(diff) AS median_diff FROM d GROUP BY img)
    SELECT img, round(avg(mae),6)+0.0 AS mae, round(avg(rmse),6)+0.0 AS rmse, round(avg(max_diff),6)+0.0 AS max_diff, round(avg(median_diff),6)+0.0 AS median_diff FROM p GROUP BY ROLLUP(img)""",
)
def norm_diff_metrics(t):
    out = dp.difference_metrics(dp.normalized_difference(rec.depth(t), "img", "gt", "pred"), "img")
    return out.withColumns({n: clean(c(n)) for n in ("mae", "rmse", "max_diff", "median_diff")})


@query(
    "robust_norm",
    f"""WITH {rec.DEPTH_SQL}, q AS (SELECT img, quantile_cont(pred,0.05) AS lo, quantile_cont(pred,0.95) AS hi FROM depth GROUP BY img)
    SELECT o_orderkey, round(least(1,greatest(0,(pred-lo)/(CASE WHEN hi<=lo THEN lo+1e-6 ELSE hi END-lo))),6)+0.0 AS normalized FROM depth JOIN q USING (img)""",
)
def robust_norm(t):
    out = dp.robust_range(rec.depth(t).select("o_orderkey", "img", "pred"), "img", "pred")
    return out.select("o_orderkey", clean(c("normalized")).alias("normalized"))


@query(
    "depth_mesh",
    f"""WITH {rec.DEPTH_SQL}, k AS (SELECT a.img, a.u, a.v FROM depth a JOIN depth b ON b.img=a.img AND b.u=a.u+1 AND b.v=a.v JOIN depth c ON c.img=a.img AND c.u=a.u AND c.v=a.v+1
      JOIN depth d ON d.img=a.img AND d.u=a.u+1 AND d.v=a.v+1
      WHERE least(a.pred,b.pred,c.pred,d.pred)>0 AND greatest(a.pred,b.pred,c.pred,d.pred)<100 AND greatest(a.pred,b.pred,c.pred,d.pred)/(least(a.pred,b.pred,c.pred,d.pred)+1e-6)<2.0)
    SELECT img, v*{W}+u AS a, (v+1)*{W}+u AS b, v*{W}+u+1 AS c FROM k UNION ALL SELECT img, v*{W}+u+1, (v+1)*{W}+u, (v+1)*{W}+u+1 FROM k""",
)
def depth_mesh(t):
    return dp.mesh(rec.depth(t).select("img", "u", "v", c("pred").alias("depth")), W)


CORR_SQL = """corr AS (SELECT p_partkey, p_size % 5 AS map_key, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 31 AS DOUBLE) AS y, CAST(p_partkey % 17 AS DOUBLE) AS z,
  20.0*p_size + 0.5*(p_partkey % 31) - 1.5*(p_partkey % 17) + 100 + (p_partkey % 5 - 2)*0.01 AS u,
  0.25*p_size + 1.0*(p_partkey % 31) + 18.0*(p_partkey % 17) + 50 + (p_partkey % 3 - 1)*0.02 AS v FROM part)"""


def correspondences(t):
    k = c("p_partkey")
    x, y, z = c("p_size").cast("double"), (k % 31).cast("double"), (k % 17).cast("double")
    return t.part.select(
        k, (c("p_size") % 5).alias("map_key"), x.alias("x"), y.alias("y"), z.alias("z"),
        (x * 20.0 + y * 0.5 - z * 1.5 + 100 + (k % 5 - 2) * 0.01).alias("u"),
        (x * 0.25 + y + z * 18.0 + 50 + (k % 3 - 1) * 0.02).alias("v"),
    )


@query(
    "affine_fit",
    f"""WITH {CORR_SQL}, m AS (SELECT map_key, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(u) AS mu, avg(v) AS mv FROM corr GROUP BY 1),
    d AS (SELECT corr.*, x-mx AS dx, y-my AS dy, z-mz AS dz, u-mu AS du, v-mv AS dv, n, mx, my, mz, mu, mv FROM corr JOIN m USING (map_key)),
    s AS (SELECT map_key, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, any_value(mu) AS mu, any_value(mv) AS mv,
      sum(dx*dx) AS xx, sum(dx*dy) AS xy, sum(dx*dz) AS xz, sum(dy*dy) AS yy, sum(dy*dz) AS yz, sum(dz*dz) AS zz,
      sum(dx*du) AS xu, sum(dy*du) AS yu, sum(dz*du) AS zu, sum(dx*dv) AS xv, sum(dy*dv) AS yv, sum(dz*dv) AS zv FROM d GROUP BY map_key),
    k AS (SELECT *, xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz) AS det FROM s),
    f AS (SELECT *, (xu*(yy*zz-yz*yz)-xy*(yu*zz-yz*zu)+xz*(yu*yz-yy*zu))/det AS a00, (xx*(yu*zz-yz*zu)-xu*(xy*zz-yz*xz)+xz*(xy*zu-yu*xz))/det AS a01,
      (xx*(yy*zu-yu*yz)-xy*(xy*zu-yu*xz)+xu*(xy*yz-yy*xz))/det AS a02,
      (xv*(yy*zz-yz*yz)-xy*(yv*zz-yz*zv)+xz*(yv*yz-yy*zv))/det AS a10, (xx*(yv*zz-yz*zv)-xv*(xy*zz-yz*xz)+xz*(xy*zv-yv*xz))/det AS a11,
      (xx*(yy*zv-yv*yz)-xy*(xy*zv-yv*xz)+xv*(xy*yz-yy*xz))/det AS a12 FROM k)
    SELECT p_partkey, round(a00,5)+0.0 AS a00, round(a01,5)+0.0 AS a01, round(a12,5)+0.0 AS a12, round(mu-a00*mx-a01*my-a02*mz,4)+0.0 AS a03,
      round(0.05*sqrt(pow(a00*x+a01*y+a02*z+mu-a00*mx-a01*my-a02*mz-u,2)+pow(a10*x+a11*y+a12*z+mv-a10*mx-a11*my-a12*mz-v,2)),6)+0.0 AS residual FROM corr JOIN f USING (map_key)""",
)
def affine_fit(t):
    corr = correspondences(t)
    fit = fitting.affine_fit(corr, ["map_key"])
    out = fitting.residuals(corr, fit, ["map_key"], 0.05)
    return out.select(
        "p_partkey", *[clean(c(n), 5).alias(n) for n in ("a00", "a01", "a12")], clean(c("a03"), 4).alias("a03"), clean(c("residual")).alias("residual")
    )
