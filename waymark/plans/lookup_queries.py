"""Equi-joins and lookups (C), trees and label edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geometry import clean
from waymark.operators import lookups
from waymark.operators.ranks import with_row
from waymark.plans import recipes as rec
from waymark.plans.registry import query
from waymark.plans.source_queries import LABEL_ROWS_SQL, label_rows
from waymark.sources import annotations as ann

c = F.col
MAP_KEY = rec.MAP_KEY


@query(
    "frame_assembly",
    f"""WITH {rec.OBS_SQL}, {rec.LANDMARK_SQL}
    SELECT image, kp_idx, x, y, CASE WHEN o.point_id >= 0 THEN o.point_id END AS point_id, px, round(py,6)+0.0 AS py, pz
    FROM obs o LEFT JOIN landmarks l ON l.point_id = o.point_id""",
)
def frame_assembly(t):
    frames = lookups.assemble_frames(rec.observations(t), rec.landmarks(t))
    o = frames.select("image", F.explode("observations").alias("o")).select("image", "o.*")
    return o.select("image", "kp_idx", "x", "y", "point_id", "landmark.px", clean(c("landmark.py")).alias("py"), "landmark.pz")


@query(
    "kf_landmarks",
    f"""WITH {rec.OBS_SQL}, {rec.LANDMARK_SQL}
    SELECT image AS kf, kp_idx, x, y, CASE WHEN o.point_id>=0 THEN o.point_id END AS lm_id, px, pz,
      CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE CAST(s_suppkey AS DOUBLE) END AS tx
    FROM obs o LEFT JOIN landmarks l ON l.point_id=o.point_id JOIN supplier ON s_suppkey=image""",
)
def kf_landmarks(t):
    obs = rec.observations(t).withColumnRenamed("image", "kf")
    poses = t.supplier.select(c("s_suppkey").alias("kf"), F.struct(c("s_suppkey").cast("double").alias("tx")).alias("pose"))
    traj = t.supplier.filter(c("s_suppkey") % 2 == 0).select(
        c("s_suppkey").alias("kf"), F.struct(c("s_acctbal").alias("tx")).alias("pose")
    )
    out = lookups.keyframe_landmarks(
        obs.select("kf", "kp_idx", "x", "y"), obs.select("kf", "kp_idx", c("point_id").alias("lm_id")),
        rec.landmarks(t), poses, traj,
    )
    return out.select("kf", "kp_idx", "x", "y", "lm_id", "px", "pz", "pose.tx")


@query(
    "hydrate_candidates",
    """WITH cand AS (SELECT event_id AS query, (event_id*7) % (SELECT count(*) FROM embeddings) AS image, ((event_id*7) % (SELECT count(*) FROM embeddings)) % 10 AS map_key, value AS score FROM events)
    SELECT query, image, map_key, score, label AS frame_label, embedding[1]::DOUBLE AS first_desc FROM cand JOIN embeddings ON vec_id=image""",
)
def hydrate_candidates(t):
    e = c("event_id")
    image = (e * 7) % c("_n")
    events = with_row(t.events, t.embeddings.agg(F.count("*").alias("_n")))
    cand = events.select(e.alias("query"), image.alias("image"), (image % 10).alias("map_key"), c("value").alias("score"))
    base = t.embeddings.select((c("vec_id") % 10).alias("map_key"), c("vec_id").alias("image"), "label", "embedding")
    frames = base.select("map_key", "image", c("label").alias("frame_label"))
    feats = base.select("map_key", "image", c("embedding")[0].cast("double").alias("first_desc"))
    return lookups.hydrate(cand, frames, feats).select("query", "image", "map_key", "score", "frame_label", "first_desc")


CONNECTOR_SQL = """con AS (SELECT *, pos AS ord, lower(description) AS d, TRY_CAST(regexp_replace(floor,'\\D','','g') AS BIGINT) AS num FROM nodes WHERE group_id=4),
half AS (SELECT a.place AS ap, a.building AS ab, a.floor AS af, a.node_id AS an, b.place AS bp, b.building AS bb, b.floor AS bf, b.node_id AS bn,
  CASE WHEN contains(a.d,'staircase') THEN 50.0::DOUBLE*coalesce(abs(a.num-b.num),0) WHEN contains(a.d,'elevator') THEN 3.0 ELSE 0.0 END AS weight
  FROM con a JOIN con b ON a.label=b.label AND a.ord<b.ord WHERE a.label<>''),
cedges AS (SELECT * FROM half UNION ALL SELECT bp,bb,bf,bn,ap,ab,af,an,weight FROM half)"""


def nav_nodes(t):
    """Numbered nodes of all floors, with the reading order of connectors."""
    from waymark.sources.annotations import shape_nodes

    pts = rec.point_shapes(t).select(
        *MAP_KEY, "pos", F.lit("point").alias("shape_type"), "group_id", "label", "description",
        F.array(F.array("x", "y")).alias("points"),
    )
    return shape_nodes(pts)


def connector_nodes(t):
    order = rec.point_shapes(t).filter(c("group_id") == 4).select(*MAP_KEY, "label", "x", "y", c("pos").alias("ord"))
    return nav_nodes(t).filter(c("group_id") == 4).join(order, [*MAP_KEY, "label", "x", "y"])


@query(
    "connector_edges",
    f"""WITH {rec.POINTS_SQL}, {CONNECTOR_SQL}
    SELECT ap AS src_place, ab AS src_building, af AS src_floor, an AS src_node, bp AS dst_place, bb AS dst_building, bf AS dst_floor, bn AS dst_node, weight FROM cedges""",
)
def connector_edges(t):
    e = lookups.connector_edges(connector_nodes(t))
    names = [*MAP_KEY, "node_id"]
    short = [*MAP_KEY, "node"]
    return e.select(
        *[c(f"src.{a}").alias(f"src_{b}") for a, b in zip(names, short)],
        *[c(f"dst.{a}").alias(f"dst_{b}") for a, b in zip(names, short)], "weight",
    )


@query(
    "label_lookup",
    f"""WITH {LABEL_ROWS_SQL},
    req AS (SELECT section, key, l.lang, name AS fallback FROM lab0, (VALUES ('zh'),('th'),('fr')) l(lang)),
    u AS (SELECT section, key, lang, trim(text) AS text FROM lab WHERE trim(text)<>'')
    SELECT r.section, r.key, r.lang, coalesce(a.text,b.text,fallback) AS label FROM req r LEFT JOIN u a USING (section,key,lang) LEFT JOIN u b ON b.section=r.section AND b.key=r.key AND b.lang='en'""",
)
def label_lookup(t):
    rows = label_rows(t)
    langs = F.explode(F.array(*[F.lit(x) for x in ("zh", "th", "fr")])).alias("lang")
    fallback = F.element_at(F.split("key", "/"), -1)
    req = rows.filter(c("lang") == "en").select("section", "key", langs, fallback.alias("fallback"))
    # Destinations fall back to the customer name, which their last key part numbers.
    name = F.concat(F.lit("Customer#"), F.lpad(c("fallback"), 9, "0"))
    req = req.withColumn("fallback", F.when(c("section") == "destinations", name).otherwise(c("fallback")))
    return lookups.label_lookup(req, rows.drop("h")).select("section", "key", "lang", "label")


@query(
    "alias_resolve",
    """WITH al AS (SELECT ['en','zh','th'][CAST(c_custkey % 3 AS INT)+1] AS lang, 'a'||c_custkey AS alias,
        CASE WHEN c_custkey % 4 = 0 THEN r_name ELSE r_name||'/'||n_name||'/'||c_mktsegment||'/'||c_custkey END AS canonical
        FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
    rq AS (SELECT event_id, ['en','zh','th'][CAST(event_id % 3 AS INT)+1] AS lang, trim('  a'||(event_id % (SELECT count(*) FROM customer))||' ') AS text FROM events)
    SELECT event_id, canonical, split_part(canonical,'/',1) AS place, nullif(split_part(canonical,'/',2),'') AS building, nullif(split_part(canonical,'/',4),'') AS dest_id
    FROM rq LEFT JOIN al ON al.lang=rq.lang AND al.alias=rq.text""",
)
def alias_resolve(t):
    nat = F.broadcast(rec.nations(t))
    k, e = c("c_custkey"), c("event_id")
    langs = F.array(*[F.lit(x) for x in ("en", "zh", "th")])
    full = F.concat_ws("/", "place", "building", "c_mktsegment", k)
    aliases = t.customer.join(nat, c("c_nationkey") == c("n_nationkey")).select(
        langs[(k % 3).cast("int")].alias("lang"), F.concat(F.lit("a"), k).alias("alias"),
        F.when(k % 4 == 0, c("place")).otherwise(full).alias("canonical"),
    )
    req = with_row(t.events, t.customer.agg(F.count("*").alias("_n"))).select(
        "event_id", langs[(e % 3).cast("int")].alias("lang"), F.concat(F.lit("  a"), e % c("_n"), F.lit(" ")).alias("text")
    )
    return lookups.resolve_alias(req, aliases).select("event_id", "canonical", "place", "building", "dest_id")


@query(
    "dest_search",
    """WITH q AS (SELECT s_suppkey AS term_id, CAST(s_suppkey AS VARCHAR) AS term FROM supplier UNION ALL
      SELECT 1000000000 + s_suppkey, 'MER#'||lpad(CAST(s_suppkey*3 AS VARCHAR),9,'0') FROM supplier)
    SELECT term_id, min(c_custkey) AS ord, min_by(c_name,c_custkey) AS name FROM q LEFT JOIN customer ON contains(lower(c_name),lower(term)) GROUP BY 1""",
)
def dest_search(t):
    s = c("s_suppkey")
    terms = t.supplier.select(s.alias("term_id"), s.cast("string").alias("term")).union(
        t.supplier.select(s + 1000000000, F.concat(F.lit("MER#"), F.lpad((s * 3).cast("string"), 9, "0")))
    )
    return lookups.search_names(terms, t.customer.select(c("c_custkey").alias("ord"), c("c_name").alias("name")))


@query(
    "depth_gt_join",
    f"""WITH {rec.DEPTH_SQL}, half AS (SELECT img, u//2 AS u, v//2 AS v, pred FROM depth WHERE u%2=0 AND v%2=0)
    SELECT d.img, d.u, d.v, round(d.gt,6)+0.0 AS gt, round(h.pred,6)+0.0 AS pred FROM depth d JOIN half h ON h.img=d.img AND h.u=d.u//2 AND h.v=d.v//2 WHERE d.gt > 0.3""",
)
def depth_gt_join(t):
    from waymark.operators.depth import join_nearest

    px = rec.depth(t)
    half = px.filter((c("u") % 2 == 0) & (c("v") % 2 == 0)).select(
        "img", F.floor(c("u") / 2).alias("u"), F.floor(c("v") / 2).alias("v"), "pred"
    )
    out = join_nearest(px.select("img", "u", "v", "gt"), half, (rec.DEPTH_WIDTH, rec.DEPTH_HEIGHT), (rec.DEPTH_WIDTH // 2, rec.DEPTH_HEIGHT // 2), min_gt=0.3)
    return out.select("img", "u", "v", clean(c("gt")).alias("gt"), clean(c("pred")).alias("pred"))


@query(
    "destinations",
    f"WITH {rec.POINTS_SQL} SELECT place, building, floor, node_id, label, x, y FROM nodes WHERE group_id=5",
)
def destinations(t):
    return nav_nodes(t).filter(c("group_id") == 5).select(*MAP_KEY, "node_id", "label", "x", "y")


@query(
    "dest_tree",
    f"""WITH {rec.POINTS_SQL},
    nav AS (SELECT place, building, floor, CAST(node_id AS VARCHAR) AS id, label AS name, node_id AS ord FROM nodes WHERE group_id=5 AND floor IN ('F0','F2','F4')),
    fil AS (SELECT place, building, floor, CAST(pos-1000 AS VARCHAR) AS id, 'file '||label AS name, pos AS ord FROM pts WHERE group_id=5),
    u AS (SELECT *, 'nav' AS origin FROM nav UNION ALL SELECT *, 'file' FROM fil WHERE NOT EXISTS (SELECT 1 FROM nav WHERE nav.place=fil.place AND nav.building=fil.building AND nav.floor=fil.floor))
    SELECT place, building, floor, origin, ord, id, name FROM u""",
)
def dest_tree(t):
    from waymark.operators.routes import destination_tree

    nodes = nav_nodes(t).filter(c("group_id") == 5)
    nav = nodes.filter(c("floor").isin("F0", "F2", "F4")).select(
        *MAP_KEY, c("node_id").alias("ord"), c("node_id").cast("string").alias("id"), c("label").alias("name")
    )
    files = rec.point_shapes(t).filter(c("group_id") == 5).select(
        *MAP_KEY, c("pos").alias("ord"), (c("pos") - 1000).cast("string").alias("id"), F.concat(F.lit("file "), "label").alias("name")
    )
    return destination_tree(nav, files)


LABEL_MERGE_SQL = f"""WITH {LABEL_ROWS_SQL},
    ch AS (SELECT CASE WHEN event_id % 50 = 7 THEN 'rooms' ELSE 'destinations' END AS section,
       r_name||'/'||n_name||'/'||c_mktsegment||'/'||c_custkey AS key, ['en','zh','fr'][CAST(event_id % 3 AS INT)+1] AS lang,
       CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' new '||event_id||' ' END AS text, ts, event_id
       FROM events JOIN customer ON c_custkey = (event_id*13) % (SELECT count(*) FROM customer) JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
    la AS (SELECT section, key, lang, trim(max_by(text, (ts, event_id))) AS text FROM ch WHERE section='destinations' GROUP BY ALL)
    SELECT coalesce(a.section,b.section) AS section, coalesce(a.key,b.key) AS key, coalesce(a.lang,b.lang) AS lang, CASE WHEN b.section IS NOT NULL THEN b.text ELSE a.text END AS text
    FROM lab a FULL JOIN la b ON a.section=b.section AND a.key=b.key AND a.lang=b.lang WHERE b.section IS NULL OR b.text <> ''"""


@query("label_merge", LABEL_MERGE_SQL)
def label_merge(t):
    return lookups.merge_labels(label_rows(t).drop("h"), label_changes(t), ["ts", "event_id"])


def label_changes(t):
    e = c("event_id")
    nat = F.broadcast(rec.nations(t))
    langs = F.array(*[F.lit(x) for x in ("en", "zh", "fr")])
    cust = t.customer.join(nat, c("c_nationkey") == c("n_nationkey")).select(
        "c_custkey", F.concat_ws("/", "place", "building", "c_mktsegment", "c_custkey").alias("key")
    )
    events = with_row(t.events, t.customer.agg(F.count("*").alias("_n")))
    return events.join(cust, (e * 13) % c("_n") == c("c_custkey")).select(
        F.when(e % 50 == 7, "rooms").otherwise("destinations").alias("section"), "key",
        langs[(e % 3).cast("int")].alias("lang"),
        F.when(e % 4 == 0, "  ").otherwise(F.concat(F.lit(" new "), e, F.lit(" "))).alias("text"), "ts", "event_id",
    )
