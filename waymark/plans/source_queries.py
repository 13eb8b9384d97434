"""Sources and sinks (A). Text and binary inputs are rendered from driver rows, then parsed back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from waymark.functions.geometry import clean
from waymark.operators.ranks import with_row
from waymark.plans import recipes as rec
from waymark.plans.registry import query
from waymark.session import shared_folder
from waymark.sources import annotations as ann
from waymark.sources import clouds, features, map_blobs, sparse_model, trajectories

c = F.col
MAP_KEY = rec.MAP_KEY


@query(
    "catalog_tree",
    f"""WITH {rec.POINTS_SQL},
    p AS (SELECT place, building, floor FROM floors)
    SELECT place, building, string_agg(floor, ',' ORDER BY floor) AS floors FROM p GROUP BY ALL""",
)
def catalog_tree(t):
    base = F.concat_ws("/", F.lit("/data"), *MAP_KEY)
    # Every floor folder holds a boundary file, one floor in two also a destination list, plus noise.
    names = F.array(F.lit("boundaries.json"), F.lit("destinations.json"), F.lit("notes.txt"))
    paths = rec.floors(t).select(F.explode(F.transform(names, lambda n: F.concat_ws("/", base, n))).alias("path"))
    tree = ann.catalog_tree(ann.floor_catalog(paths))
    return tree.select("place", "building", F.array_join("floors", ",").alias("floors"))


def annotation_docs(t):
    """One annotation JSON text per floor, shapes in file order."""
    s = rec.floor_shapes(t)
    fields = ["pos", "label", "group_id", "shape_type", "description", "points"]
    shapes = s.groupBy(*MAP_KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("shapes"))
    return shapes.select(
        *MAP_KEY, F.to_json(F.struct(F.transform("shapes", lambda x: x.dropFields("pos")).alias("shapes"))).alias("annotation")
    )


@query(
    "shape_nodes",
    f"""WITH {rec.POINTS_SQL} SELECT place, building, floor, node_id, x, y, label, group_id, description FROM nodes""",
)
def shape_nodes(t):
    return ann.shape_nodes(ann.parse_annotations(annotation_docs(t)))


@query(
    "shape_polygons",
    f"""WITH {rec.POINTS_SQL}, {rec.EDGES_SQL}
    SELECT place, building, floor, e.pos, e.group_id, r.label, e.k AS corner, ax AS x, ay AS y
    FROM floors, edges e JOIN rects r USING (pos)""",
)
def shape_polygons(t):
    polys = ann.shape_polygons(ann.parse_annotations(annotation_docs(t)))
    return polys.select(*MAP_KEY, c("pos").cast("long"), "group_id", "label", F.posexplode("ring").alias("corner", "p")).select(
        *MAP_KEY, "pos", "group_id", "label", "corner", c("p")[0].alias("x"), c("p")[1].alias("y")
    )


@query(
    "partner_lines",
    f"""WITH {rec.POINTS_SQL},
    f AS (SELECT place, building, floor, label, min(node_id) AS node_id FROM nodes WHERE group_id=4 GROUP BY ALL),
    l AS (SELECT place, building, floor, label, max(pos) AS pos FROM pts WHERE group_id=4 AND pos % 2 = 0 GROUP BY ALL)
    SELECT place, building, floor, label, node_id, x-5 AS x0, y AS y0, x+5 AS x1, y AS y1
    FROM l JOIN f USING (place, building, floor, label) JOIN pts USING (place, building, floor, label, pos)""",
)
def partner_lines(t):
    shapes = ann.parse_annotations(annotation_docs(t))
    out = ann.partner_lines(shapes, ann.shape_nodes(shapes))
    p = c("points")
    return out.select(
        *MAP_KEY, "label", "node_id", p[0][0].alias("x0"), p[0][1].alias("y0"), p[1][0].alias("x1"), p[1][1].alias("y1")
    )


@query(
    "floor_scales",
    f"WITH {rec.POINTS_SQL}, {rec.SCALES_SQL} SELECT place, building, floor, m_per_px FROM scales",
)
def floor_scales(t):
    per_building = rec.stored_scales(t).groupBy("place", "building").agg(
        F.map_from_entries(F.collect_list(F.struct("floor", "m_per_px"))).alias("f")
    )
    docs = per_building.select(F.to_json(F.create_map("place", F.create_map("building", "f"))).alias("scales"))
    return ann.with_default_scale(rec.floors(t), ann.parse_scales(docs))


LABEL_ROWS_SQL = """lab0 AS (
  SELECT 'places' AS section, r_name AS key, r_name AS name, r_regionkey AS h FROM region UNION ALL
  SELECT 'buildings', r_name||'/'||n_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL
  SELECT 'floors', r_name||'/'||n_name||'/'||c_mktsegment, c_mktsegment, min(c_custkey) FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY r_name, n_name, c_mktsegment UNION ALL
  SELECT 'destinations', r_name||'/'||n_name||'/'||c_mktsegment||'/'||c_custkey, c_name, c_custkey FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
lab AS (SELECT section, key, lang, CASE WHEN (h*7+i) % 4 = 0 THEN '  ' ELSE name||' '||lang END AS text, h FROM lab0, (VALUES ('en',0),('zh',1),('th',2)) l(lang,i))"""


def label_rows(t):
    """section, key, lang, text over places, buildings, floors and destinations; every fourth text is blank."""
    nat = F.broadcast(t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")))
    cust = t.customer.join(nat, c("c_nationkey") == c("n_nationkey"))
    floor_key = F.concat_ws("/", "r_name", "n_name", "c_mktsegment")
    parts = [
        t.region.select(F.lit("places").alias("section"), c("r_name").alias("key"), c("r_name").alias("name"), c("r_regionkey").cast("long").alias("h")),
        nat.select(F.lit("buildings"), F.concat_ws("/", "r_name", "n_name"), "n_name", c("n_nationkey").cast("long")),
        cust.groupBy("r_name", "n_name", "c_mktsegment").agg(F.min("c_custkey").alias("h")).select(F.lit("floors"), floor_key, "c_mktsegment", "h"),
        cust.select(F.lit("destinations"), F.concat_ws("/", floor_key, "c_custkey"), "c_name", "c_custkey"),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    langs = F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(i).alias("i")) for i, x in enumerate(("en", "zh", "th"))])
    rows = rows.select("*", F.explode(langs).alias("l"))
    blank = (c("h") * 7 + c("l.i")) % 4 == 0
    return rows.select(
        "section", "key", "l.lang", F.when(blank, "  ").otherwise(F.concat_ws(" ", "name", "l.lang")).alias("text"), "h"
    )


@query("labels_long", f"WITH {LABEL_ROWS_SQL} SELECT section, key, lang, text FROM lab WHERE section <> 'floors'")
def labels_long(t):
    # One label document per key; the floors section of every document is broken text.
    rows = label_rows(t).groupBy("section", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("langs")
    )
    body = F.to_json(F.create_map("key", "langs"))
    docs = rows.select(
        F.concat(
            F.lit('{"'), "section", F.lit('": '),
            F.when(c("section") == "floors", F.lit('"not an object"')).otherwise(body), F.lit("}"),
        ).alias("labels")
    )
    return ann.parse_labels(docs)


@query(
    "dest_files",
    """SELECT r_name AS place, n_name AS building, c_mktsegment AS floor, CAST(c_custkey AS VARCHAR) AS dest_id,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS name
       FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE c_custkey % 7 <> 0""",
)
def dest_files(t):
    nat = F.broadcast(rec.nations(t))
    key = c("c_custkey")
    # Entries without an id drop out; a missing name falls back to the id.
    entry = F.array(F.struct(
        F.when(key % 7 == 0, "").otherwise(key.cast("string")).alias("id"),
        F.when(key % 5 != 0, c("c_name")).alias("name"),
    ))
    docs = t.customer.join(nat, c("c_nationkey") == c("n_nationkey")).select(
        "place", "building", c("c_mktsegment").alias("floor"), F.to_json(entry).alias("destinations")
    )
    return ann.parse_destinations(docs)


@query(
    "traj_parse",
    """SELECT event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame_seq, CAST(event_id AS VARCHAR) AS frame_id,
       CAST((event_id*37) % 11 - 5 AS DOUBLE) AS tx, value AS tz, CAST(user_id AS DOUBLE) AS qw
       FROM events QUALIFY event_id % 9 <> 4""",
)
def traj_parse(t):
    """Trajectory text per event type, written as sorted files and read back in byte ranges."""
    e = c("event_id")
    good = F.concat_ws(" ", e, (e * 37) % 11 - 5, F.lit(0), "value", F.lit(0), F.lit(0), F.lit(0), "user_id")
    # Every ninth line is cut short: it keeps its number but yields no pose.
    line = F.when(e % 9 == 4, F.concat_ws(" ", e, "value")).otherwise(good)
    path = shared_folder(t.spark, "trajectories")
    t.events.select("event_type", "event_id", line.alias("value")).orderBy("event_type", "event_id").drop("event_id").write.partitionBy(
        "event_type"
    ).text(path)
    poses = trajectories.read_trajectories(t.spark, path, by_folder=True)
    source = F.regexp_extract("source", "event_type=([^/]*)$", 1)
    return poses.select(source.alias("source"), "frame_seq", "frame_id", "tx", "tz", "qw")


@query(
    "sfm_text_tables",
    f"""WITH {rec.OBS_SQL}, {rec.LANDMARK_SQL} SELECT 'image' AS kind, image AS image_id, count(*) AS n, CAST(sum(CASE WHEN point_id>=0 THEN 1 ELSE 0 END) AS BIGINT) AS with_point, round(sum(x),6)+0.0 AS sum_x FROM obs GROUP BY 2
    UNION ALL SELECT 'point', point_id, 2, NULL, round(px,6)+0.0 FROM landmarks""",
)
def sfm_text_tables(t):
    """Sparse-model text of images (two lines each) and points, written as files and read back in byte ranges."""
    obs = rec.observations(t)
    images = obs.groupBy("image", F.floor(c("kp_idx") / 500).alias("chunk")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("kp_idx", "x", "y", "point_id"))),
                lambda o: F.concat_ws(" ", o.x, o.y, o.point_id),
            ),
            " ",
        ).alias("obs")
    )
    head = F.concat_ws(" ", "image", F.lit("1 0 0 0 0.5 0.25"), "chunk", F.lit("1"), F.format_string("%06d.png", "image"))
    path = shared_folder(t.spark, "model")
    images.select(F.concat(F.lit("# image list\n"), head, F.lit("\n"), "obs").alias("value")).write.text(f"{path}/images")
    img = sparse_model.read_images(t.spark, f"{path}/images").select(
        F.lit("image").alias("kind"), "image_id", F.explode("observations").alias("o")
    ).groupBy("kind", "image_id").agg(
        F.count("*").alias("n"), F.sum(F.when(c("o.point_id") >= 0, 1).otherwise(0)).alias("with_point"),
        clean(F.sum("o.x")).alias("sum_x"),
    )
    p = rec.landmarks(t)
    line = F.concat_ws(" ", "point_id", "px", "py", "pz", F.lit("1 2 3 0.5"), "point_id", F.lit("0"), "point_id", F.lit("1"))
    p.select(line.alias("value")).write.text(f"{path}/points")
    pts = sparse_model.read_points(t.spark, f"{path}/points").select(
        F.lit("point").alias("kind"), c("point_id").alias("image_id"), F.size("track").cast("long").alias("n"),
        F.lit(None).cast("long").alias("with_point"), clean(c("x")).alias("sum_x"),
    )
    return img.unionByName(pts)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({
            "id": pdf["id"],
            "pos_w": [struct.pack("<3d", *v) for v in zip(pdf.x, pdf.y, pdf.z)],
            "color": [bytes((int(b), int(g), int(r))) for r, g, b in zip(pdf.r, pdf.g, pdf.b)],
            "ref_kf": pdf["kf"],
        })


@query(
    "blob_decode",
    f"""WITH {rec.CLOUD_SQL}
    SELECT l_orderkey*1000000 + l_partkey*10 + l_linenumber AS id, count(*) AS n, sum(x) AS x, round(sum(z),6)+0.0 AS z,
           CAST(sum(b) AS BIGINT) AS b, CAST(sum(r) AS BIGINT) AS r FROM cloud GROUP BY 1""",
)
def blob_decode(t):
    packed = rec.cloud(t).select(
        (c("l_orderkey") * 1000000 + c("l_partkey") * 10 + c("l_linenumber")).alias("id"), "x", "y", "z", "r", "g", "b", "kf"
    ).mapInPandas(_pack, "id long, pos_w binary, color binary, ref_kf long")
    pos = map_blobs.unpack_rows(packed, "id", "pos_w", "<f8", 3).select(
        "id", F.lit(0).alias("part"), c("cells")[0].alias("x"), c("cells")[2].alias("z"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("r")
    )
    col = map_blobs.unpack_rows(packed, "id", "color", "u1", 3).select(
        "id", F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("double"), c("cells")[0].cast("long"), c("cells")[2].cast("long")
    )
    return pos.union(col).groupBy("id").agg(
        F.sum(F.when(c("part") == 0, 1).otherwise(0)).alias("n"), F.sum("x").alias("x"),
        clean(F.sum("z")).alias("z"), F.sum("b").alias("b"), F.sum("r").alias("r"),
    )


@query(
    "feature_scan",
    """SELECT label AS map_key, vec_id AS image_name, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),5)+0.0 AS length
       FROM embeddings WHERE label < 5""",
)
def feature_scan(t):
    """Features written by map key; only the partitions of the asked maps are read back."""
    label = c("label").cast("string")
    key = {"place": F.concat(F.lit("p"), F.floor(c("label") / 25)), "building": F.concat(F.lit("b"), F.floor(c("label") / 5)), "floor": label}
    path = shared_folder(t.spark, "features")
    features.write_features(t.embeddings.withColumns(key).select(*MAP_KEY, "vec_id", "embedding"), path)
    # One row per map, as a catalog gives them.
    asked = t.embeddings.filter(c("label") < 5).select(c("label")).distinct().withColumns(key)
    rows = features.read_features(t.spark, path, asked, ["floor", "vec_id", "embedding"])
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.select(
        c("floor").cast("int").alias("map_key"), c("vec_id").alias("image_name"), F.size("embedding").alias("dim"), clean(F.sqrt(sq), 5).alias("length")
    )


@query(
    "ply_roundtrip",
    f"""WITH {rec.CLOUD_SQL}
    SELECT round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z, CAST(b AS INTEGER) AS blue, CAST(g AS INTEGER) AS green,
           CAST(r AS INTEGER) AS red, count(*) AS n FROM cloud GROUP BY ALL""",
)
def ply_roundtrip(t):
    body = clouds.point_lines(rec.cloud(t))
    header = t.spark.createDataFrame([(s,) for s in clouds.cloud_header(1).splitlines()], "value string")
    back = clouds.parse_point_lines(body.union(header))
    return back.groupBy(
        *[clean(c(n)).alias(n) for n in "xyz"],
        *[c(n).cast("int").alias(w) for n, w in (("b", "blue"), ("g", "green"), ("r", "red"))],
    ).agg(F.count("*").alias("n"))


MATCH_SQL = """mt AS (SELECT DISTINCT 'v'||l_suppkey AS img1, 'v'||(l_partkey % 97) AS img2, l_orderkey AS kp1, l_partkey AS kp2, l_suppkey % 3 AS segment FROM lineitem)"""


def raw_matches(t):
    return t.lineitem.select(
        F.concat(F.lit("v"), "l_suppkey").alias("img1"), F.concat(F.lit("v"), c("l_partkey") % 97).alias("img2"),
        c("l_orderkey").alias("kp1"), c("l_partkey").alias("kp2"), (c("l_suppkey") % 3).alias("segment"),
    ).distinct()


@query(
    "pairs_sink",
    f"""WITH {MATCH_SQL}, p AS (SELECT least(img1,img2) AS img1, greatest(img1,img2) AS img2, count(*) AS n FROM mt WHERE img1<>img2 GROUP BY ALL)
    SELECT img1, img2, n FROM p""",
)
def pairs_sink(t):
    """Write match rows by segment, read them back and list the canonical pairs."""
    path = shared_folder(t.spark, "pairs")
    features.write_matches(raw_matches(t), path)
    back = t.spark.read.parquet(path)
    counts = back.filter(c("img1") != c("img2")).groupBy(
        F.least("img1", "img2").alias("img1"), F.greatest("img1", "img2").alias("img2")
    ).agg(F.count("*").alias("n"))
    return features.canonical_pairs(back).join(counts, ["img1", "img2"])


SFM_SQL = """imgs AS (SELECT DISTINCT 'v'||s_suppkey AS name, (s_suppkey*37) % 1009 + 1 AS image_id FROM supplier),
mt AS (SELECT DISTINCT 'v'||least(l_suppkey, l_orderkey % n) AS img1, 'v'||greatest(l_suppkey, l_orderkey % n) AS img2, l_partkey AS kp1, l_linenumber AS kp2 FROM lineitem, (SELECT count(*) AS n FROM supplier) WHERE l_suppkey <> l_orderkey % n),
prs AS (SELECT DISTINCT CASE WHEN a.s_suppkey % 2 = 0 THEN 'v'||a.s_suppkey ELSE 'v'||((a.s_suppkey + k) % n) END AS img1,
               CASE WHEN a.s_suppkey % 2 = 0 THEN 'v'||((a.s_suppkey + k) % n) ELSE 'v'||a.s_suppkey END AS img2
        FROM supplier a, (VALUES (1),(3),(7),(120)) d(k), (SELECT count(*) AS n FROM supplier) WHERE a.s_suppkey <> (a.s_suppkey + k) % n)"""


def sfm_inputs(t):
    s = c("s_suppkey")
    n = t.supplier.agg(F.count("*").alias("_n"))
    images = t.supplier.select(F.concat(F.lit("v"), s).alias("name"), ((s * 37) % 1009 + 1).alias("image_id"))
    matches = (
        with_row(t.lineitem, n).filter(c("l_suppkey") != c("l_orderkey") % c("_n"))
        .select(
            F.concat(F.lit("v"), F.least("l_suppkey", c("l_orderkey") % c("_n"))).alias("img1"),
            F.concat(F.lit("v"), F.greatest("l_suppkey", c("l_orderkey") % c("_n"))).alias("img2"),
            c("l_partkey").alias("kp1"), c("l_linenumber").alias("kp2"),
        ).distinct()
    )
    step = with_row(t.supplier, n).select("_n", s.alias("a"), F.explode(F.array(*[F.lit(k) for k in (1, 3, 7, 120)])).alias("k"))
    b = (c("a") + c("k")) % c("_n")
    step = step.filter(c("a") != b)
    left, right = F.concat(F.lit("v"), "a"), F.concat(F.lit("v"), b)
    even = c("a") % 2 == 0
    pairs = step.select(
        F.when(even, left).otherwise(right).alias("img1"), F.when(even, right).otherwise(left).alias("img2")
    ).distinct()
    return images, pairs, matches


@query(
    "sfm_load",
    f"""WITH {SFM_SQL},
    j AS (SELECT p.img1, p.img2, m.kp1, m.kp2 FROM prs p JOIN mt m ON m.img1=p.img1 AND m.img2=p.img2
          UNION ALL SELECT p.img1, p.img2, m.kp2, m.kp1 FROM prs p JOIN mt m ON m.img1=p.img2 AND m.img2=p.img1
          WHERE NOT EXISTS (SELECT 1 FROM mt x WHERE x.img1=p.img1 AND x.img2=p.img2)),
    i AS (SELECT j.*, a.image_id AS id1, b.image_id AS id2 FROM j JOIN imgs a ON a.name=j.img1 JOIN imgs b ON b.name=j.img2)
    SELECT least(id1,id2)*2147483647+greatest(id1,id2) AS pair_id, CASE WHEN id1>id2 THEN kp2 ELSE kp1 END AS kp_a,
           CASE WHEN id1>id2 THEN kp1 ELSE kp2 END AS kp_b FROM i""",
)
def sfm_load(t):
    return sparse_model.load_matches(*sfm_inputs(t))


@query(
    "pair_match_audit",
    f"""WITH {SFM_SQL},
    st AS (SELECT img1, img2 FROM mt UNION SELECT img2, img1 FROM mt)
    SELECT p.img1, p.img2, CASE WHEN st.img1 IS NULL THEN 'missing' ELSE 'found' END AS state
    FROM prs p LEFT JOIN st ON st.img1=p.img1 AND st.img2=p.img2""",
)
def pair_match_audit(t):
    _, pairs, matches = sfm_inputs(t)
    missing = sparse_model.unmatched_pairs(pairs, matches)
    stored = matches.select("img1", "img2").union(matches.select("img2", "img1"))
    found = pairs.join(stored, ["img1", "img2"], "left_semi")
    return missing.withColumn("state", F.lit("missing")).unionByName(found.withColumn("state", F.lit("found")))


@query(
    "floor_metadata",
    f"""WITH {rec.CLOUD_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM cloud),
    k AS (SELECT kf, count(*) AS n, round(min(y),6)+0.0 AS y_min, round(max(y),6)+0.0 AS y_max,
          round(avg((x-x0)/(x1-x0)),3)+0.0 AS mean_u, round(avg((z-z0)/(z1-z0)),3)+0.0 AS mean_v FROM cloud, b GROUP BY kf)
    SELECT kf, '{{"n":'||n||',"u":'||CAST(mean_u AS VARCHAR)||',"v":'||CAST(mean_v AS VARCHAR)||'}}' AS body, y_min, y_max FROM k""",
)
def floor_metadata(t):
    from waymark.operators.clouds import bounds, unit_square

    pts = rec.cloud(t)
    framed = unit_square(pts, bounds(pts, ["x", "z"]))
    k = framed.groupBy("kf").agg(
        F.count("*").alias("n"), clean(F.min("y")).alias("y_min"), clean(F.max("y")).alias("y_max"),
        clean(F.avg("u"), 3).alias("u"), clean(F.avg("v"), 3).alias("v"),
    )
    return k.select("kf", F.to_json(F.struct("n", "u", "v")).alias("body"), "y_min", "y_max")


def _profile_sql():
    parts = []
    spec = {
        "part": [("p_partkey", "bigint", 1), ("p_name", "string", 0), ("p_size", "int", 1), ("p_retailprice", "double", 1)],
        "events": [("event_id", "bigint", 1), ("event_type", "string", 0), ("value", "double", 1)],
    }
    for table, cols in spec.items():
        for name, kind, numeric in cols:
            lo = f"min({name})::DOUBLE" if numeric else "NULL::DOUBLE"
            hi = f"max({name})::DOUBLE" if numeric else "NULL::DOUBLE"
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS type, count(*) AS rows, "
                f"count({name}) AS non_null, {lo} AS lo, {hi} AS hi FROM {table}"
            )
    return " UNION ALL ".join(parts)


@query("table_profile", _profile_sql())
def table_profile(t):
    return clouds.profile({
        "part": t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"),
        "events": t.events.select("event_id", "event_type", "value"),
    })
