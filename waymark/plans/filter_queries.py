"""Projections, filters (B) and set operations (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import names
from waymark.operators import filters
from waymark.operators import sets
from waymark.plans import recipes as rec
from waymark.plans.registry import query

c = F.col
clean = g.clean

# Keypoints: 125 per image, so the adaptive threshold lies between its two limits.
KP_SQL = f"""kp AS (SELECT vec_id, vec_id // {rec.KEYPOINTS_PER_IMAGE} AS image, vec_id % {rec.KEYPOINTS_PER_IMAGE} AS kp_idx,
  CAST((vec_id*37) % 640 AS DOUBLE) AS x, CAST((vec_id*91) % 480 AS DOUBLE) AS y, ((vec_id*7919) % 1000)/1000 AS score, embedding FROM embeddings)"""


def keypoints(t):
    v = c("vec_id")
    return t.embeddings.select(
        "vec_id", F.floor(v / rec.KEYPOINTS_PER_IMAGE).alias("image"), (v % rec.KEYPOINTS_PER_IMAGE).alias("kp_idx"),
        ((v * 37) % 640).cast("double").alias("x"), ((v * 91) % 480).cast("double").alias("y"),
        (((v * 7919) % 1000) / 1000).alias("score"), c("embedding").alias("desc"),
    )


@query(
    "adaptive_kp_filter",
    f"""WITH {KP_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY image) AS n FROM kp)
    SELECT image, kp_idx, x, y, score FROM n WHERE score >= CASE WHEN n<=50 THEN 0 WHEN n>=500 THEN 0.2 ELSE 0.2*(1-exp(-0.005*(n-50))) END""",
)
def adaptive_kp_filter(t):
    return filters.adaptive_keypoints(keypoints(t), ["image"]).select("image", "kp_idx", "x", "y", "score")


@query(
    "valid_depth_px",
    f"""WITH {rec.DEPTH_SQL}
    SELECT img, u, v, round(pred,6)+0.0 AS depth FROM depth
    WHERE u % 2 = 0 AND v % 2 = 0 AND pred > 0.1 AND pred < 50 AND conf > 0.5
      AND CASE WHEN img % 3 = 0 THEN v >= 16 ELSE (u + v + img) % 4 <> 0 END""",
)
def valid_depth_px(t):
    px = rec.depth(t).select("img", "u", "v", c("pred").alias("depth"), "conf")
    # Every third image has no mask.
    masks = px.filter((c("img") % 3 != 0) & ((c("u") + c("v") + c("img")) % 4 != 0)).select("img", "u", "v")
    has_any = filters.valid_pixels(px, masks, rec.DEPTH_HEIGHT, step=2, conf="conf", min_conf=0.5)
    return has_any.select("img", "u", "v", clean(c("depth")).alias("depth"))


@query(
    "valid_obs",
    f"""WITH {rec.OBS_SQL} SELECT image, kp_idx, x, y, point_id FROM obs WHERE point_id >= 0""",
)
def valid_obs(t):
    point = F.when(c("point_id") >= 0, c("point_id"))
    # Frames arrive in chunks of at most 1000 observations, so no array grows with the data.
    frames = rec.observations(t).groupBy("image", F.floor(c("kp_idx") / 1000).alias("chunk")).agg(
        F.collect_list(F.struct("kp_idx", "x", "y", point.alias("landmark"))).alias("observations")
    )
    kept = filters.with_landmark(frames).select("image", F.explode("observations").alias("o"))
    return kept.select("image", "o.kp_idx", "o.x", "o.y", c("o.landmark").alias("point_id"))


@query(
    "hash_sample",
    f"""WITH {rec.CLOUD_SQL}, k AS (SELECT kf, x, y, z, r, g, b, l_orderkey, l_linenumber, l_partkey, l_orderkey||'-'||l_linenumber||'-'||l_partkey AS row_key FROM cloud)
    SELECT * FROM k ORDER BY md5(row_key||'#0'), row_key LIMIT 50000""",
)
def hash_sample(t):
    return filters.hash_sample(rec.cloud(t).withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "row_key", 50000)


@query(
    "view_name_roundtrip",
    """WITH v AS (SELECT event_id, event_id % 3 AS pitch, (event_id*5) % 18 AS yaw FROM events)
    SELECT event_id, printf('%06d_pitch%02d_yaw%02d.png', event_id, pitch, yaw) AS name, event_id AS keyframe, pitch, yaw, yaw = 0 AS front,
       printf('image%d_yaw%03d_pitch%+03d.png', event_id, yaw*20, (pitch-1)*30) AS segment_name FROM v""",
)
def view_name_roundtrip(t):
    e = c("event_id")
    v = t.events.select("event_id", (e % 3).alias("p"), ((e * 5) % 18).alias("w"))
    v = v.select(
        "event_id", names.view_name(e, c("p"), c("w")).alias("name"),
        names.segment_view_name(F.concat(F.lit("image"), e), c("w") * 20, (c("p") - 1) * 30).alias("segment_name"),
    )
    kf, pitch, yaw = names.parse_view_name(c("name"))
    return v.select(
        "event_id", "name", kf.alias("keyframe"), pitch.alias("pitch"), yaw.alias("yaw"),
        names.is_front_view(c("name")).alias("front"), "segment_name",
    )


@query(
    "natural_order",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'thumb'||event_id||'.jpg' ELSE 'image'||((event_id*7919) % 1000003)||'.png' END AS name FROM events)
    SELECT event_id, name, CAST(regexp_extract(name,'(\\d+)',1) AS BIGINT) AS number FROM n WHERE regexp_matches(name,'image\\d+\\.png$')""",
)
def natural_order(t):
    e = c("event_id")
    name = F.when(e % 5 == 0, F.concat(F.lit("thumb"), e, F.lit(".jpg"))).otherwise(
        F.concat(F.lit("image"), (e * 7919) % 1000003, F.lit(".png"))
    )
    return filters.natural_order(t.events.select("event_id", name.alias("name")), "name")


@query(
    "slice_catalog",
    """WITH kf AS (SELECT c_custkey AS kf, radians(c_acctbal % 360) AS a, CAST(c_custkey % 13 AS DOUBLE) AS tx, CAST(c_custkey % 7 AS DOUBLE) AS ty, CAST(c_custkey % 5 AS DOUBLE) AS tz FROM customer),
    s AS (SELECT kf.*, i AS yaw_idx, radians(20.0*i) AS w FROM kf, range(18) r(i)),
    m AS (SELECT *, cos(a)*cos(w)+sin(a)*sin(w) AS co, sin(a)*cos(w)-cos(a)*sin(w) AS si FROM s)
    SELECT printf('%06d_pitch%02d_yaw%02d.png', kf, 0, yaw_idx) AS name, kf, yaw_idx, round(co,6)+0.0 AS r00, round(si,6)+0.0 AS r02,
      round(-(co*tx+si*tz),5)+0.0 AS tx, round(-ty,5)+0.0 AS ty, round(-(-si*tx+co*tz),5)+0.0 AS tz FROM m""",
)
def slice_catalog(t):
    k = c("c_custkey")
    # World-to-camera rotation about Y, camera centre T.
    kf = t.customer.select(
        k.alias("kf"), (c("c_acctbal") % 360).alias("a"),
        *[(k % n).cast("double").alias(x) for n, x in ((13, "x"), (7, "y"), (5, "z"))],
    )
    rows = sets.slice_views(kf, 18, [c("x"), c("y"), c("z")], g.rot_y(c("a")))
    return rows.select(
        names.view_name(c("kf"), F.lit(0), c("yaw_idx")).alias("name"), "kf", c("yaw_idx").cast("long"),
        clean(c("r0")).alias("r00"), clean(c("r2")).alias("r02"),
        *[clean(c(x), 5).alias(x) for x in ("tx", "ty", "tz")],
    )


@query(
    "strided_cap",
    f"""WITH {rec.CLOUD_SQL},
    r AS (SELECT kf, x, y, z, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY kf ORDER BY l_orderkey, l_linenumber, l_partkey, x, z) - 1 AS i,
          count(*) OVER (PARTITION BY kf) AS n FROM cloud)
    SELECT kf, x, round(y,6)+0.0 AS y, z, l_orderkey, i FROM r WHERE n <= 200 OR (i % greatest(1, n//200) = 0 AND i // greatest(1, n//200) < 200)""",
)
def strided_cap(t):
    out = filters.strided_cap(rec.cloud(t), ["kf"], ["l_orderkey", "l_linenumber", "l_partkey", "x", "z"], 200)
    return out.select("kf", "x", clean(c("y")).alias("y"), "z", "l_orderkey", c("_i").alias("i"))


# --- set operations -----------------------------------------------------------------


@query(
    "pair_union",
    """WITH a AS (SELECT l_partkey AS i, l_suppkey AS j FROM lineitem), b AS (SELECT l_suppkey AS i, l_orderkey AS j FROM lineitem)
    SELECT DISTINCT least(i,j) AS img1, greatest(i,j) AS img2 FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE i <> j""",
)
def pair_union(t):
    a = t.lineitem.select(c("l_partkey").alias("img1"), c("l_suppkey").alias("img2"))
    b = t.lineitem.select(c("l_suppkey").alias("img1"), c("l_orderkey").alias("img2"))
    return sets.pair_union([a, b])


@query(
    "route_network",
    f"""WITH {rec.NET_SQL} SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM net WHERE src <> dst""",
)
def route_network(t):
    return sets.undirected(rec.network(t).filter("src <> dst"), "src", "dst", "a", "b")


@query(
    "pending_floors",
    """SELECT DISTINCT n_name AS building, c_mktsegment AS floor FROM customer JOIN nation ON c_nationkey=n_nationkey
    WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer c2 ON o_custkey=c2.c_custkey WHERE c2.c_nationkey=customer.c_nationkey
       AND c2.c_mktsegment=customer.c_mktsegment AND o_totalprice > 490000)""",
)
def pending_floors(t):
    nat = F.broadcast(t.nation.select("n_nationkey", c("n_name").alias("building")))
    cust = t.customer.join(nat, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "building", c("c_mktsegment").alias("floor"))
    done = t.orders.filter(c("o_totalprice") > 490000).join(cust, c("o_custkey") == c("c_custkey")).select("building", "floor")
    return sets.pending(cust.select("building", "floor"), done, ["building", "floor"])


@query(
    "table_diff",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_totalprice/7 AS w FROM orders),
    b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 101 = 0 THEN 1000000000 ELSE 0 END AS k,
          o_totalprice*(1 + CASE WHEN o_orderkey % 17 = 0 THEN 1e-4 ELSE 1e-7 END) AS v, o_totalprice/7 + 1e-9 AS w FROM orders)
    SELECT coalesce(a.k,b.k) AS k, CASE WHEN a.k IS NULL THEN 'right only' WHEN b.k IS NULL THEN 'left only' ELSE 'differs' END AS state
    FROM a FULL JOIN b ON a.k=b.k WHERE a.k IS NULL OR b.k IS NULL OR abs(a.v-b.v) > 1e-8 + 1e-5*abs(b.v) OR abs(a.w-b.w) > 1e-8 + 1e-5*abs(b.w)""",
)
def table_diff(t):
    k = c("o_orderkey")
    a = t.orders.select(k.alias("k"), c("o_totalprice").alias("v"), (c("o_totalprice") / 7).alias("w"))
    b = t.orders.select(
        (k + F.when(k % 101 == 0, 1000000000).otherwise(0)).alias("k"),
        (c("o_totalprice") * (F.when(k % 17 == 0, F.lit(1e-4)).otherwise(F.lit(1e-7)) + 1)).alias("v"),
        (c("o_totalprice") / 7 + 1e-9).alias("w"),
    )
    return sets.table_diff(a, b, ["k"], ["v", "w"])
