"""Voting, stopping, fusion and whole-frame localization."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geometry import clean
from waymark.operators import localize as loc
from waymark.plans.registry import query
from waymark.plans.vector_queries import QUERY_SQL, map_vectors, query_vectors

c = F.col

CAND_SQL = """cand AS (SELECT event_id//15 AS query, event_type AS map_key, event_id AS image, row_number() OVER (PARTITION BY event_id//15 ORDER BY value DESC, event_id) AS rank, CAST((event_id*13) % 40 AS BIGINT) AS inliers FROM events)"""


def candidates(t):
    """Fifteen retrieved candidates per query, ranked by score."""
    from waymark.operators.ranks import top_per_group

    e = c("event_id")
    rows = t.events.select(
        F.floor(e / 15).alias("query"), c("event_type").alias("map_key"), e.alias("image"), c("value").alias("score"), ((e * 13) % 40).alias("inliers")
    )
    return top_per_group(rows, ["query"], [F.desc("score"), c("image")], 15)


STOP_SQL = f"""{CAND_SQL}, g AS (SELECT *, sum(CASE WHEN inliers>=6 THEN inliers ELSE 0 END) OVER (PARTITION BY query, map_key ORDER BY rank) AS gathered FROM cand WHERE rank<=10),
vs AS (SELECT g.* FROM g LEFT JOIN (SELECT query, min(rank) AS stop FROM g WHERE gathered>=50 AND inliers>=6 GROUP BY 1) s USING (query) WHERE stop IS NULL OR rank<=stop)"""


@query("early_stop", f"WITH {STOP_SQL} SELECT query, map_key, image, rank, inliers, CAST(gathered AS BIGINT) AS gathered FROM vs")
def early_stop(t):
    return loc.early_stop(candidates(t), 50).select("query", "map_key", "image", "rank", "inliers", "gathered")


@query(
    "region_vote",
    f"""WITH {STOP_SQL}, v AS (SELECT query, map_key, CAST(sum(inliers) AS BIGINT) AS total, count(*) AS images FROM vs WHERE inliers>=6 GROUP BY 1,2),
    w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY total DESC, map_key)=1)
    SELECT w.query, w.map_key, total, images, count(*) AS correspondences FROM w JOIN cand c ON c.query=w.query AND c.map_key=w.map_key GROUP BY ALL""",
)
def region_vote(t):
    cand = candidates(t)
    votes = loc.region_vote(loc.early_stop(cand, 50))
    kept = loc.winning_correspondences(cand, votes).groupBy("query").agg(F.count("*").alias("correspondences"))
    return votes.join(kept, "query")


def fuse_sql(p, key):
    return f"""fa AS (SELECT {key}, atan2(median(sin(radians(heading))),median(cos(radians(heading)))) AS anchor, count(*) AS n, sum(weight*x)/sum(weight) AS x, sum(weight*y)/sum(weight) AS y, arg_min(heading,ord) AS first FROM {p} GROUP BY 1),
fk AS (SELECT p.{key}, sum(weight*sin(radians(heading))) AS ws, sum(weight*cos(radians(heading))) AS wc FROM {p} p JOIN fa ON fa.{key}=p.{key}
  WHERE abs(((radians(heading)-anchor+pi()) % (2*pi()) + 2*pi()) % (2*pi()) - pi()) < pi()/2 GROUP BY 1),
fm AS (SELECT {key}, map_key FROM (SELECT {key}, map_key, count(*) AS k FROM {p} GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY k DESC, map_key)=1),
fused AS (SELECT fa.{key}, n, x, y, ((CASE WHEN n<3 THEN first WHEN ws IS NULL THEN degrees(anchor) ELSE degrees(atan2(ws,wc)) END) % 360 + 360) % 360 AS heading, map_key FROM fa LEFT JOIN fk USING ({key}) JOIN fm USING ({key}))"""


@query(
    "pose_fusion",
    f"""WITH ps AS (SELECT event_id//10 AS query, event_type AS map_key, event_id AS ord, CAST((event_id*37) % 101 AS DOUBLE) AS x, CAST((event_id*53) % 97 AS DOUBLE) AS y, (event_id//10)*31 % 360 + value*1.3 AS heading, CAST(1+event_id%9 AS DOUBLE) AS weight FROM events),
    {fuse_sql('ps', 'query')} SELECT query, n, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(heading,5)+0.0 AS heading, map_key FROM fused""",
)
def pose_fusion(t):
    e = c("event_id")
    poses = t.events.select(
        F.floor(e / 10).alias("query"), c("event_type").alias("map_key"), e, ((e * 37) % 101).cast("double").alias("x"),
        ((e * 53) % 97).cast("double").alias("y"), ((F.floor(e / 10) * 31) % 360 + c("value") * 1.3).alias("heading"), (e % 9 + 1).cast("double").alias("weight"),
    )
    out = loc.fuse_poses(poses)
    return out.select("query", "n", clean(c("x")).alias("x"), clean(c("y")).alias("y"), clean(c("heading"), 5).alias("heading"), "map_key")


# Local features: each image's 64 values are eight keypoints of eight. A frame sees its keypoints at half the size,
# turned a little with its number; every fifth image has its third keypoint displaced.
LOCAL_SQL = """mk AS (SELECT vec_id AS image, i AS kp, (i*37+vec_id) % 640 + CASE WHEN vec_id % 5 = 0 AND i = 3 THEN 200.0 ELSE 0.0 END AS x, ((i*i*91+vec_id*3) % 480)::DOUBLE AS y, (i%4+1)/4.0::DOUBLE AS score, list_slice(embedding::DOUBLE[], 8*i+1, 8*i+8) AS d FROM embeddings, range(8) r(i)),
qk AS (SELECT vec_id AS query, i AS kp, 0.5*((i*37+vec_id) % 640)-0.1*((i*i*91+vec_id*3) % 480)+10 AS x, 0.1*((i*37+vec_id) % 640)+0.5*((i*i*91+vec_id*3) % 480)+5 AS y, (i%4+1)/4.0::DOUBLE AS score, list_slice(list_transform(embedding, lambda e, j: e::DOUBLE*(1+(j-1)%3*0.25)), 8*i+1, 8*i+8) AS d FROM embeddings, range(8) r(i))"""


def points(t, frame: bool):
    v, i = c("vec_id"), F.col("i")
    px, py = ((i * 37 + v) % 640).cast("double"), ((i * i * 91 + v * 3) % 480).cast("double")
    desc = F.transform("embedding", lambda x, j: x * (1 + j % 3 * 0.25)) if frame else c("embedding")
    rows = t.embeddings.select(v, desc.alias("e")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    if frame:
        x, y = 0.5 * px - 0.1 * py + 10, 0.1 * px + 0.5 * py + 5
    else:
        x, y = px + F.when((v % 5 == 0) & (i == 3), 200.0).otherwise(0.0), py
    return rows.select(v.alias("image"), i.cast("long").alias("kp_idx"), x.alias("x"), y.alias("y"), ((i % 4 + 1) / 4).alias("score"), F.slice("e", i * 8 + 1, F.lit(8)).alias("desc"))


LOCALIZE_SQL = f"""WITH {QUERY_SQL}, {LOCAL_SQL}, fr AS (SELECT query, CASE WHEN query % 11 <> 5 THEN v END AS v FROM qv),
s AS (SELECT query, map_key, image, list_cosine_similarity(fr.v, mv.v) AS score, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(fr.v, mv.v) DESC, image) AS rank FROM fr, mv WHERE fr.v IS NOT NULL QUALIFY rank<=10),
sm AS (SELECT s.query, s.image, q.kp AS kp1, m.kp AS kp2, list_dot_product(q.d, m.d) AS sim, q.x AS x1, q.y AS y1, m.x AS x2, m.y AS y2 FROM s JOIN qk q ON q.query=s.query JOIN mk m ON m.image=s.image),
mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query,image,kp1 ORDER BY sim DESC, kp2) AS r1, row_number() OVER (PARTITION BY query,image,kp2 ORDER BY sim DESC, kp1) AS r2 FROM sm) WHERE r1=1 AND r2=1 QUALIFY count(*) OVER (PARTITION BY query,image)>=3),
sd AS (SELECT *, row_number() OVER (PARTITION BY query,image ORDER BY (kp1*7919+kp2*104729) % 1000003, kp1, kp2)-1 AS r FROM mt),
hy AS (SELECT a.query, a.image, a.r//2 AS h, a.x1 AS px, a.y1 AS py, a.x2 AS qx, a.y2 AS qy, b.x1-a.x1 AS ux, b.y1-a.y1 AS uy, b.x2-a.x2 AS vx, b.y2-a.y2 AS vy FROM sd a JOIN sd b ON a.query=b.query AND a.image=b.image AND a.r%2=0 AND b.r=a.r+1),
hs AS (SELECT *, (vx*ux+vy*uy)/(ux*ux+uy*uy) AS a, (vy*ux-vx*uy)/(ux*ux+uy*uy) AS b FROM hy WHERE ux*ux+uy*uy>0),
ct AS (SELECT m.query, m.image, h, count(*) AS inliers FROM mt m JOIN hs USING (query,image) WHERE pow(a*(x1-px)-b*(y1-py)+qx-x2,2)+pow(b*(x1-px)+a*(y1-py)+qy-y2,2) <= 25.0*25.0 GROUP BY ALL),
il AS (SELECT query, image, max(inliers) AS inliers FROM ct GROUP BY ALL HAVING max(inliers)>=2),
cand AS (SELECT s.query, s.map_key, s.image, s.rank, coalesce(il.inliers,0) AS inliers FROM s LEFT JOIN il ON il.query=s.query AND il.image=s.image),
g AS (SELECT *, sum(CASE WHEN inliers>=2 THEN inliers ELSE 0 END) OVER (PARTITION BY query, map_key ORDER BY rank) AS gathered FROM cand),
vis AS (SELECT g.* FROM g LEFT JOIN (SELECT query, min(rank) AS stop FROM g WHERE gathered>=14 AND inliers>=2 GROUP BY 1) z ON z.query=g.query WHERE stop IS NULL OR rank<=stop),
vt AS (SELECT query, map_key, sum(inliers)::BIGINT AS total, count(*) AS images FROM vis WHERE inliers>=2 GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sum(inliers) DESC, map_key)=1),
ps AS (SELECT vis.query, vis.map_key, vis.image AS ord, CAST((vis.image*37) % 101 AS DOUBLE) AS x, CAST((vis.image*53) % 97 AS DOUBLE) AS y, CAST((vis.image*31) % 360 AS DOUBLE) AS heading, CAST(inliers AS DOUBLE) AS weight FROM vis JOIN vt ON vt.query=vis.query AND vt.map_key=vis.map_key WHERE inliers>=2 AND vis.image % 13 <> 4),
{fuse_sql('ps', 'query')},
o AS (SELECT fr.query, CASE WHEN fr.v IS NULL THEN 'features' WHEN total IS NULL THEN 'match' WHEN images<2 THEN 'vote' WHEN fused.x IS NULL THEN 'pose' END AS stage, vt.map_key, total, images, x, y, heading FROM fr LEFT JOIN vt ON vt.query=fr.query LEFT JOIN fused ON fused.query=fr.query)
SELECT query, stage IS NULL AS success, stage, CASE stage WHEN 'features' THEN 'no features' WHEN 'match' THEN 'no verified candidate' WHEN 'vote' THEN 'too few images agree' WHEN 'pose' THEN 'map images have no pose' END AS reason,
  CASE WHEN stage IS NULL THEN map_key END AS map_key, CASE WHEN stage IS NULL THEN total END AS total, CASE WHEN stage IS NULL THEN images END AS images, CASE WHEN stage IS NULL THEN round(x,5)+0.0 END AS x, CASE WHEN stage IS NULL THEN round(y,5)+0.0 END AS y, CASE WHEN stage IS NULL THEN round(heading,4)+0.0 END AS heading FROM o"""

OPTIONS = {"k": 10, "least": 2, "least_matches": 3, "tol": 25.0, "least_inliers": 2, "target": 14}


def frame_inputs(t):
    """Frames with global and local features, and the prepared map; some frames have no features and some images no pose."""
    local = points(t, True).groupBy(c("image").alias("query")).agg(F.collect_list(F.struct("kp_idx", "x", "y", "score", "desc")).alias("local"))
    frames = query_vectors(t).withColumn("vec", F.when(c("query") % 11 != 5, c("vec"))).join(local, "query")
    v = c("vec_id")
    poses = t.embeddings.filter(v % 13 != 4).select(
        v.alias("image"), ((v * 37) % 101).cast("double").alias("x"), ((v * 53) % 97).cast("double").alias("y"), ((v * 31) % 360).cast("double").alias("heading")
    )
    return frames, loc.prepare_map(map_vectors(t), points(t, False), poses)


def rounded(out):
    return out.withColumns({"x": clean(c("x"), 5), "y": clean(c("y"), 5), "heading": clean(c("heading"), 4)})


@query("localize_batch", LOCALIZE_SQL)
def localize_batch(t):
    return rounded(loc.localize(*frame_inputs(t), **OPTIONS))
