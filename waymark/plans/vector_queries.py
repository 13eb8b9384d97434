"""Retrieval, matching, verification and model plug points (C4-C9, D2, E1, K)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import models
from waymark.operators import cells, filters, ranks, vectors, view_pairs
from waymark.operators import two_view as tv
from waymark.plans import recipes as rec
from waymark.plans.filter_queries import KP_SQL, keypoints
from waymark.plans.registry import query

c = F.col
clean = g.clean

QUERY_SQL = "qv AS (SELECT vec_id AS query, list_transform(embedding, lambda x, i: x::DOUBLE*(1+(i-1)%3*0.25)) AS v FROM embeddings), mv AS (SELECT label::BIGINT AS map_key, vec_id AS image, embedding::DOUBLE[] AS v FROM embeddings)"


def query_vectors(t):
    v = F.transform("embedding", lambda x, i: x * (1 + i % 3 * 0.25))
    return t.embeddings.select(c("vec_id").alias("query"), v.alias("vec"))


def map_vectors(t):
    return t.embeddings.select(c("label").cast("long").alias("map_key"), c("vec_id").alias("image"), c("embedding").alias("vec"))


def topk_sql(k):
    return f"""{QUERY_SQL}, s AS (SELECT query, map_key, image, list_cosine_similarity(qv.v, mv.v) AS score FROM qv, mv),
    m AS (SELECT *, row_number() OVER (PARTITION BY query, map_key ORDER BY score DESC, image) AS rank_in_map FROM s),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, image) AS rank FROM m WHERE rank_in_map<={k} QUALIFY rank<={k})"""


@query("vpr_topk", f"WITH {topk_sql(5)} SELECT query, map_key, image, round(score,5)+0.0 AS score, rank, rank_in_map FROM top")
def vpr_topk(t):
    out = vectors.retrieve_topk(query_vectors(t), map_vectors(t), 5)
    return out.withColumn("score", clean(c("score"), 5))


@query("vpr_topk_blocked", f"WITH {topk_sql(10)} SELECT query, map_key, image, round(score,5)+0.0 AS score, rank, rank_in_map FROM top")
def vpr_topk_blocked(t):
    """The same search over many small blocks."""
    out = vectors.retrieve_topk(query_vectors(t), map_vectors(t), 10, block=128)
    return out.withColumn("score", clean(c("score"), 5))


@query(
    "simjoin_topk",
    f"""WITH {QUERY_SQL}, s AS (SELECT a.image AS query, b.image, list_cosine_similarity(a.v,b.v) AS score FROM mv a JOIN mv b ON a.image<>b.image)
    SELECT query, image, round(score,5)+0.0 AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, image) AS rank FROM s QUALIFY rank<=8""",
)
def simjoin_topk(t):
    q = t.embeddings.select(c("vec_id").alias("query"), c("embedding").alias("vec"))
    out = vectors.retrieve_topk(q, map_vectors(t), 8, skip_self=True)
    return out.select("query", "image", clean(c("score"), 5).alias("score"), "rank")


@query(
    "two_level_topk",
    """WITH m AS (SELECT user_id AS query, event_type AS map_key, event_id AS image, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id)<=5)
    SELECT query, map_key, image, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, image) AS rank FROM m QUALIFY rank<=5""",
)
def two_level_topk(t):
    rows = t.events.select(c("user_id").alias("query"), c("event_type").alias("map_key"), c("event_id").alias("image"), c("value").alias("score"))
    order = [F.desc("score"), c("image")]
    per_map = ranks.top_per_group(rows, ["query", "map_key"], order, 5).drop("rank")
    return ranks.top_per_group(per_map, ["query"], order, 5)


IMAGE_PAIRS_SQL = "ip AS (SELECT DISTINCT image AS img1, image+d AS img2 FROM kp, (VALUES (1),(2)) k(d))"


def image_pairs(kp):
    return kp.select(c("image").alias("img1")).distinct().select(
        "img1", F.explode(F.array(c("img1") + 1, c("img1") + 2)).alias("img2")
    )


def mutual_sql(kp):
    return f"""sm AS (SELECT img1, img2, a.kp_idx AS kp1, b.kp_idx AS kp2, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, a.score*b.score AS conf, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
      FROM ip JOIN {kp} a ON a.image=img1 JOIN {kp} b ON b.image=img2),
    mn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img1,img2,kp1 ORDER BY sim DESC, kp2) AS r1, row_number() OVER (PARTITION BY img1,img2,kp2 ORDER BY sim DESC, kp1) AS r2 FROM sm) WHERE r1=1 AND r2=1),
    mt AS (SELECT *, row_number() OVER (PARTITION BY img1,img2 ORDER BY conf DESC, kp1, kp2) AS rank FROM mn)"""


@query(
    "mutual_nn",
    f"WITH {KP_SQL}, {IMAGE_PAIRS_SQL}, {mutual_sql('kp')} SELECT img1, img2, kp1, kp2, round(sim,5)+0.0 AS sim, round(conf,6)+0.0 AS conf, rank FROM mt WHERE rank<=40",
)
def mutual_nn(t):
    kp = keypoints(t)
    out = vectors.mutual_matches(image_pairs(kp), kp, max_matches=40, block=64)
    return out.withColumns({"sim": clean(c("sim"), 5), "conf": clean(c("conf"))})


FILTERED_SQL = f"""{KP_SQL}, kn AS (SELECT *, count(*) OVER (PARTITION BY image) AS n FROM kp),
kf AS (SELECT * FROM kn WHERE score >= CASE WHEN n<=50 THEN 0 WHEN n>=500 THEN 0.2 ELSE 0.2*(1-exp(-0.005*(n-50))) END), {IMAGE_PAIRS_SQL}, {mutual_sql('kf')}"""


def gated_matches(t, least=20):
    kp = keypoints(t)
    kept = filters.adaptive_keypoints(kp, ["image"])
    return vectors.match_gate(vectors.mutual_matches(image_pairs(kp), kept), least), kept


@query(
    "match_gate",
    f"WITH {FILTERED_SQL}, gt AS (SELECT img1, img2, count(*) AS n FROM mt GROUP BY ALL HAVING count(*)>=20) SELECT img1, img2, kp1, kp2, gt.n FROM mt JOIN gt USING (img1,img2)",
)
def match_gate(t):
    return gated_matches(t)[0].select("img1", "img2", "kp1", "kp2", "n")


@query(
    "consensus_verify",
    f"""WITH {FILTERED_SQL},
    sd AS (SELECT *, row_number() OVER (PARTITION BY img1,img2 ORDER BY (kp1*7919+kp2*104729) % 1000003, kp1, kp2)-1 AS r FROM mt),
    hy AS (SELECT a.img1, a.img2, a.r//2 AS h, a.x1 AS px, a.y1 AS py, a.x2 AS qx, a.y2 AS qy, b.x1-a.x1 AS ux, b.y1-a.y1 AS uy, b.x2-a.x2 AS vx, b.y2-a.y2 AS vy
      FROM sd a JOIN sd b ON a.img1=b.img1 AND a.img2=b.img2 AND a.r%2=0 AND b.r=a.r+1),
    hs AS (SELECT *, (vx*ux+vy*uy)/(ux*ux+uy*uy) AS a, (vy*ux-vx*uy)/(ux*ux+uy*uy) AS b FROM hy WHERE ux*ux+uy*uy>0),
    il AS (SELECT m.img1, m.img2, h, kp1, kp2 FROM mt m JOIN hs USING (img1,img2) WHERE pow(a*(x1-px)-b*(y1-py)+qx-x2,2)+pow(b*(x1-px)+a*(y1-py)+qy-y2,2) <= 60.0*60.0),
    ct AS (SELECT img1, img2, h, count(*) AS inliers FROM il GROUP BY ALL),
    bs AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY img1,img2 ORDER BY inliers DESC, h)=1)
    SELECT img1, img2, kp1, kp2, h, inliers FROM il JOIN bs USING (img1,img2,h) WHERE inliers>=4""",
)
def consensus_verify(t):
    return vectors.similarity_consensus(placed_matches(t), tol=60.0)


def placed_matches(t):
    matches, kept = gated_matches(t, 1)
    a = kept.select(c("image").alias("img1"), c("kp_idx").alias("kp1"), c("x").alias("x1"), c("y").alias("y1"))
    b = kept.select(c("image").alias("img2"), c("kp_idx").alias("kp2"), c("x").alias("x2"), c("y").alias("y2"))
    return matches.join(a, ["img1", "kp1"]).join(b, ["img2", "kp2"])


@query(
    "nn_lift",
    f"""WITH {rec.OBS_SQL}, q AS (SELECT image, kp_idx AS q_kp, x AS qx, y AS qy FROM obs WHERE point_id<0), m AS (SELECT * FROM obs WHERE point_id>=0),
    j AS (SELECT q.image, q_kp, kp_idx, point_id, sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) AS d FROM q JOIN m ON m.image=q.image AND abs(qx-x)<20 AND abs(qy-y)<20)
    SELECT image, q_kp, round(min(d),6)+0.0 AS dist, arg_min(kp_idx,(d,kp_idx)) AS kp_idx, arg_min(point_id,(d,kp_idx)) AS point_id FROM j WHERE d<20 GROUP BY 1,2""",
)
def nn_lift(t):
    obs = rec.observations(t)
    q = obs.filter(c("point_id") < 0).select("image", c("kp_idx").alias("q_kp"), c("x").alias("qx"), c("y").alias("qy"))
    m = obs.filter(c("point_id") >= 0)
    out = cells.nearest_within(q, m, ["image"], ["qx", "qy"], ["x", "y"], 20.0, ["q_kp"], ["kp_idx"])
    return out.select("image", "q_kp", clean(c("dist")).alias("dist"), "kp_idx", "point_id")


@query(
    "pose_pairs",
    """WITH v AS (SELECT c_custkey AS kf, i AS yaw, c_custkey*18+i AS view, CAST((c_custkey//2) % 1000 AS DOUBLE) AS x, CAST((c_custkey//2)//1000 AS DOUBLE) AS y, (c_custkey%2)*0.004 AS z,
      (c_acctbal % 360) - 20.0*i AS ang FROM customer, range(18) r(i)),
    d AS (SELECT a.view AS a, b.view AS b, ((a.ang-b.ang+180) % 360 + 360) % 360 - 180 AS rel FROM v a JOIN v b ON a.kf=b.kf AND a.view<b.view AND abs((((a.yaw-b.yaw)*20.0+180) % 360 + 360) % 360 - 180)<=20.0
      UNION ALL SELECT a.view, b.view, ((a.ang-b.ang+180) % 360 + 360) % 360 - 180 AS rel FROM v a JOIN v b ON a.x=b.x AND a.y=b.y AND abs(a.z-b.z)<0.01 AND a.view<b.view AND abs(((a.ang-b.ang+180) % 360 + 360) % 360 - 180) < 10)
    SELECT DISTINCT a, b FROM d WHERE cos(radians(rel)) >= cos(radians(45.0))""",
)
def pose_pairs(t):
    from waymark.operators.sets import slice_views

    k = c("c_custkey")
    half = F.floor(k / 2)
    kf = t.customer.select(
        k.alias("kf"), (c("c_acctbal") % 360).alias("a"), (half % 1000).cast("double").alias("x"),
        F.floor(half / 1000).cast("double").alias("y"), ((k % 2) * 0.004).alias("z"),
    )
    views = slice_views(kf, 18, [c("x"), c("y"), c("z")], g.rot_y(c("a"))).select(
        (c("kf") * 18 + c("yaw_idx")).alias("view"), "kf", F.lit(0).alias("pitch"), c("yaw_idx").alias("yaw"), "x", "y", "z", *view_pairs.ROT
    )
    return view_pairs.pose_pairs(views)


LETTERS_SQL = ", ".join(f"length(x)-length(replace(x,'{x}',''))" for x in "abcdefghijklmnopqrstuvwxyz")


@query(
    "batch_infer",
    f"""WITH d AS (SELECT doc_id AS id, coalesce(text,'') AS x FROM documents), v AS (SELECT id, [{LETTERS_SQL}] AS n FROM d),
    s AS (SELECT id, n, greatest(sqrt(list_sum(list_transform(n, lambda k: k*k))), 1e-12) AS size FROM v) SELECT id, list_transform(n, lambda k: round(k/size,5)+0.0) AS vec FROM s""",
)
def batch_infer(t):
    """Letter profiles of whole documents through the model plug point."""
    out = models.infer(t.documents.select(c("doc_id").alias("id"), "text"), "letters")
    return out.withColumn("vec", F.transform("vec", lambda x: clean(x, 5)))


def cosine_above(limit: float):
    """A plug-in matcher: pairs above a cosine limit, each row's best column only."""

    def fn(a: np.ndarray, b: np.ndarray):
        s = vectors.unit_rows(a) @ vectors.unit_rows(b).T
        j = s.argmax(axis=1)
        best = s[np.arange(len(a)), j]
        keep = np.nonzero(best > limit)[0]
        return keep, j[keep], best[keep]

    return fn


@query(
    "custom_matcher",
    f"""WITH {KP_SQL}, {IMAGE_PAIRS_SQL}, s AS (SELECT img1, img2, a.kp_idx AS kp1, b.kp_idx AS kp2, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS conf FROM ip JOIN kp a ON a.image=img1 JOIN kp b ON b.image=img2),
    l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY img1,img2,kp1 ORDER BY conf DESC, kp2)=1),
    r AS (SELECT * FROM l WHERE conf>0.2 QUALIFY row_number() OVER (PARTITION BY img1,img2,kp2 ORDER BY conf DESC, kp1)=1)
    SELECT img1, img2, kp1, kp2, round(conf,5)+0.0 AS conf FROM r""",
)
def custom_matcher(t):
    kp = keypoints(t)
    out = vectors.custom_matches(image_pairs(kp), kp, cosine_above(0.2), block=64)
    return out.withColumn("conf", clean(c("conf"), 5))


# --- two views of planted points -------------------------------------------------------

# Two hundred parts are the points of an image pair: seen by a camera at the origin and by one that is moved and turned a little. Of every ten matches
# nine, six or three are true (by the pair's number); the others lead to places that have nothing to do with the first view.
VIEW = 200
TWO_VIEW_SQL = f"""pt AS (SELECT p_partkey//{VIEW} AS img1, p_partkey AS k, (p_size-25)/5.0::DOUBLE AS px, (p_partkey*37 % 101 - 50)/10.0::DOUBLE AS py, 8.0::DOUBLE + (p_partkey*53 % 89)/10.0::DOUBLE AS pz,
  0.05::DOUBLE*(1+p_partkey//{VIEW} % 4) AS ang, 0.6::DOUBLE + 0.2*(p_partkey//{VIEW} % 3) AS tx, p_partkey % 10 < 9 - 3*(p_partkey//{VIEW} % 3) AS good FROM part),
tw AS (SELECT img1, k, good, ang, tx, 500*px/pz+320 AS x1, 500*py/pz+240 AS y1, 500*(cos(ang)*px+sin(ang)*pz+tx)/(cos(ang)*pz-sin(ang)*px+0.2)+320 AS u, 500*(py+0.1)/(cos(ang)*pz-sin(ang)*px+0.2)+240 AS v FROM pt),
tm AS (SELECT img1, k, ang, tx, x1, y1, CASE WHEN good THEN u ELSE (k*7919 % 6400)/10.0 END AS x2, CASE WHEN good THEN v ELSE (k*104729 % 4800)/10.0 END AS y2 FROM tw),
-- F = K^-T [t]x R K^-1 with t = (tx, 0.1, 0.2) and R a turn about y, in pixels
ge AS (SELECT img1, any_value(ang) AS a, any_value(tx) AS tx FROM tm GROUP BY 1),
es AS (SELECT img1, 0.2*0.0 + 0.1*(-sin(a)) AS e11, -0.2::DOUBLE AS e12, 0.1*cos(a) AS e13, 0.2*cos(a) + tx*sin(a) AS e21, 0.0::DOUBLE AS e22, 0.2*sin(a) - tx*cos(a) AS e23, -0.1*cos(a) AS e31, tx AS e32, -0.1*sin(a) AS e33 FROM ge)"""
# Sampson distance under E with points moved into camera coordinates: dividing by the focal length brings it back to pixels.
TRUE_INLIERS_SQL = f"""{TWO_VIEW_SQL},
nm AS (SELECT tm.img1, k, (x1-320)/500 AS x, (y1-240)/500 AS y, (x2-320)/500 AS u, (y2-240)/500 AS v, es.* EXCLUDE (img1) FROM tm JOIN es USING (img1)),
li AS (SELECT *, e11*x+e12*y+e13 AS p0, e21*x+e22*y+e23 AS p1, e31*x+e32*y+e33 AS p2, e11*u+e21*v+e31 AS q0, e12*u+e22*v+e32 AS q1 FROM nm),
sa AS (SELECT img1, k, 500*abs(u*p0+v*p1+p2)/sqrt(p0*p0+p1*p1+q0*q0+q1*q1) AS d FROM li)"""


def planted_views(t):
    """img1, img2, kp1, kp2, x1, y1, x2, y2 of the pairs, and f of each."""
    k = c("p_partkey")
    pair = F.floor(k / VIEW)
    ang, tx = 0.05 * (1 + pair % 4), 0.6 + 0.2 * (pair % 3)
    pz, px, py = 8.0 + (k * 53 % 89) / 10, (c("p_size") - 25) / 5, (k * 37 % 101 - 50) / 10
    rows = t.part.select(k.alias("k"), pair.alias("img1"), ang.alias("ang"), tx.alias("tx"), px.alias("px"), py.alias("py"), pz.alias("pz"), (k % 10 < 9 - 3 * (pair % 3)).alias("good"))
    a, x, y, z = c("ang"), c("px"), c("py"), c("pz")
    depth = F.cos(a) * z - F.sin(a) * x + 0.2
    u, v = 500 * (F.cos(a) * x + F.sin(a) * z + c("tx")) / depth + 320, 500 * (y + 0.1) / depth + 240
    matches = rows.select(
        "img1", (c("img1") + 1_000_000).alias("img2"), c("k").alias("kp1"), c("k").alias("kp2"), (500 * x / z + 320).alias("x1"), (500 * y / z + 240).alias("y1"),
        F.when(c("good"), u).otherwise((c("k") * 7919 % 6400) / 10).alias("x2"), F.when(c("good"), v).otherwise((c("k") * 104729 % 4800) / 10).alias("y2"),
    )
    s, o, m = F.sin(a), F.cos(a), c("tx")
    e = [-0.1 * s, F.lit(-0.2), 0.1 * o, 0.2 * o + m * s, F.lit(0.0), 0.2 * s - m * o, -0.1 * o, m, -0.1 * s]
    # K^-T E K^-1 for the focal length 500 and the middle (320, 240).
    i = [[1 / 500, 0.0, -320 / 500], [0.0, 1 / 500, -240 / 500], [0.0, 0.0, 1.0]]
    f = [sum(e[3 * p + q] * (i[p][r] * i[q][w]) for p in range(3) for q in range(3)) for r in range(3) for w in range(3)]
    return matches, rows.groupBy("img1", "ang", "tx").agg(F.lit(1)).select("img1", (c("img1") + 1_000_000).alias("img2"), F.array(*f).alias("f"))


@query("epipolar_score", f"WITH {TRUE_INLIERS_SQL} SELECT img1, count(*) AS matches, count(*) FILTER (d<=1) AS inliers FROM sa GROUP BY 1")
def epipolar_score(t):
    """Inliers of known geometry over the matches of each pair."""
    matches, geometry = planted_views(t)
    return tv.score_geometry(matches, geometry, 1.0).select("img1", "matches", "inliers")


@query("two_view", f"WITH {TRUE_INLIERS_SQL} SELECT img1, k, count(*) OVER (PARTITION BY img1) AS inliers FROM sa WHERE d<=1 QUALIFY count(*) OVER (PARTITION BY img1) >= 20")
def two_view(t):
    """Geometry found from the matches alone, with down to three in ten true: its inliers are those of the planted geometry."""
    return tv.two_view(planted_views(t)[0], tol=1.0, confidence=0.9999).select("img1", c("kp1").alias("k"), "inliers")
