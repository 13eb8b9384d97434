"""Voting, early stop, pose fusion and the per-frame localization job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators.filters import adaptive_keypoints
from waymark.operators.ranks import quantiles
from waymark.operators.two_view import fit_two_view
from waymark.operators.vectors import MapIndex, index_images, retrieve_topk, seed_order, similarity_fit
from waymark.session import cut_lineage, parallelism


def early_stop(candidates: DataFrame, target: int, least: int = 6, most: int = 10) -> DataFrame:
    """Candidates actually visited: at most ``most`` in rank order, ending with the first whose map
    has gathered ``target`` inliers. Candidates under ``least`` inliers add nothing.

    ``candidates``: query, map_key, image, rank, inliers. Queries are cut to ``most`` rows
    before any running sum.
    """
    taken = candidates.filter(F.col("rank") <= most)
    running = Window.partitionBy("query", "map_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("inliers") >= least, F.col("inliers")).otherwise(0)
    rows = taken.withColumn("gathered", F.sum(counted).over(running))
    whole = Window.partitionBy("query")
    stop = F.min(F.when((F.col("gathered") >= target) & (F.col("inliers") >= least), F.col("rank"))).over(whole)
    return rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop"))).drop("_stop")


def region_vote(verified: DataFrame, least: int = 6) -> DataFrame:
    """query, map_key, total, images of the map with most inliers; ties go to the smallest key."""
    strong = verified.filter(F.col("inliers") >= least)
    votes = strong.groupBy("query", "map_key").agg(F.sum("inliers").alias("total"), F.count("*").alias("images"))
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("total")).alias("n"), "map_key", "images")).alias("b"))
    return best.select("query", "b.map_key", (-F.col("b.n")).alias("total"), "b.images")


def winning_correspondences(correspondences: DataFrame, votes: DataFrame) -> DataFrame:
    """Correspondences of each query's winning map."""
    return correspondences.join(votes.select("query", "map_key"), ["query", "map_key"], "left_semi")


def fuse_poses(poses: DataFrame, key: str = "query", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """Weighted mean position and robust heading per query, with the most frequent map.

    ``poses``: key, map_key, x, y, heading (degrees), weight and the order columns. With
    three or more poses, headings 90 degrees or more from the circular median are left
    out; with fewer, the first heading is used.
    """
    c = F.col
    rad = F.radians("heading")
    p = poses.withColumns({"_s": F.sin(rad), "_c": F.cos(rad)})
    long = p.select(key, F.explode(F.array(
        F.struct(F.lit("s").alias("axis"), c("_s").alias("v")), F.struct(F.lit("c").alias("axis"), c("_c").alias("v"))
    )).alias("e")).select(key, "e.axis", "e.v")
    mid = quantiles(long, [key, "axis"], "v", {"m": 0.5}).groupBy(key).agg(
        F.max(F.when(c("axis") == "s", c("m"))).alias("_ms"), F.max(F.when(c("axis") == "c", c("m"))).alias("_mc")
    ).select(key, F.atan2("_ms", "_mc").alias("_anchor"))
    base = p.groupBy(key).agg(
        F.count("*").alias("n"), (F.sum(c("weight") * c("x")) / F.sum("weight")).alias("x"),
        (F.sum(c("weight") * c("y")) / F.sum("weight")).alias("y"), F.min_by("heading", F.struct(*order)).alias("_first"),
    )
    off = F.abs(F.pmod(F.radians("heading") - c("_anchor") + g.math.pi, F.lit(2 * g.math.pi)) - g.math.pi)
    kept = p.join(mid, key).filter(off < g.math.pi / 2).groupBy(key).agg(
        F.sum(c("weight") * c("_s")).alias("_ws"), F.sum(c("weight") * c("_c")).alias("_wc")
    )
    votes = p.groupBy(key, "map_key").agg(F.count("*").alias("_n")).groupBy(key).agg(
        F.min(F.struct((-c("_n")).alias("n"), "map_key")).alias("_m")
    )
    joined = base.join(mid, key).join(kept, key, "left").join(votes, key)
    angle = F.when(c("n") < 3, c("_first")).when(c("_ws").isNull(), F.degrees("_anchor")).otherwise(F.degrees(F.atan2("_ws", "_wc")))
    return joined.select(key, "n", "x", "y", F.pmod(angle, F.lit(360.0)).alias("heading"), c("_m.map_key").alias("map_key"))


class MapTables(NamedTuple):
    """A map made ready once for any number of localization jobs."""

    images: MapIndex  # global descriptors around pivots
    features: DataFrame  # image, kp, xy, desc: the local features of an image as one row
    poses: DataFrame  # image, x, y, heading


def image_rows(kept: DataFrame, key: str = "image") -> DataFrame:
    """An image's local features (kp_idx, x, y, desc) in order of kp_idx as one row; their number is bounded by the extractor."""
    m = F.array_sort(F.collect_list(F.struct(F.col("kp_idx").cast("long").alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("desc").cast("array<float>").alias("d"))))
    rows = kept.groupBy(key).agg(m.alias("m"))
    return rows.select(key, F.col("m.k").alias("kp"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.flatten("m.d").alias("desc"))


def prepare_map(map_feats: DataFrame, map_points: DataFrame, map_poses: DataFrame) -> MapTables:
    """``map_feats``: map_key, image, vec. ``map_points``: image, kp_idx, x, y, score, desc. ``map_poses``: image, x, y, heading.

    Keypoints under their image's adaptive threshold are left out; the packed tables are written once.
    """
    kept = adaptive_keypoints(map_points, ["image"]).drop("_n")
    return MapTables(index_images(map_feats), cut_lineage(image_rows(kept)), map_poses)


def verify(hits: DataFrame, local: DataFrame, tables: MapTables, least_matches: int, tol: float, least_inliers: int, model: str = "similarity") -> DataFrame:
    """query, image, inliers of each retrieved image whose local features fit the frame's by one ``model``: a planar similarity or an epipolar geometry.

    Reciprocal nearest descriptors, the gate on their number, then the best consensus: all inside the row of a (frame, image) pair, so
    only the counts are sent on. Pairs that fail a step are left out. ``local``: query and its packed features.
    """
    a = local.select("query", *[F.col(n).alias(f"a_{n}") for n in ("kp", "x", "y", "desc")])
    b = tables.features.select("image", *[F.col(n).alias(f"b_{n}") for n in ("kp", "x", "y", "desc")])
    pairs = hits.select("query", "image").join(a, "query").join(b, "image")
    names = ["query", "image", *[f"{s}_{n}" for s in "ab" for n in ("kp", "x", "y", "desc")]]

    def lists(column: pa.Array) -> list[np.ndarray]:
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.zeros(batch.num_rows, np.int64)
            cols = [lists(batch.column(k)) for k in range(2, 10)]
            for r, (ka, xa, ya, da, kb, xb, yb, db) in enumerate(zip(*cols, strict=True)):
                s = da.reshape(len(ka), -1).astype(float) @ db.reshape(len(kb), -1).astype(float).T
                j, i = s.argmax(axis=1), s.argmax(axis=0)  # features are in id order, so equals go to the lower id
                i1 = np.flatnonzero(i[j] == np.arange(len(ka)))
                if len(i1) < least_matches:
                    continue
                j1 = j[i1]
                p, q = np.stack([xa[i1], ya[i1]], 1), np.stack([xb[j1], yb[j1]], 1)
                fit = fit_two_view(p, q, tol) if model == "epipolar" else similarity_fit(seed_order(ka[i1], kb[j1]), p, q, tol)
                if fit is not None:
                    found[r] = fit[1].sum()
            keep = found >= max(1, least_inliers)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(found[keep])], names=["query", "image", "inliers"])

    # The work of a pair outweighs its bytes: spread it evenly.
    spread = pairs.select(*names).repartition(parallelism(hits.sparkSession))
    return spread.mapInArrow(run, "query long, image long, inliers long")


def verified_candidates(
    hits: DataFrame, frames: DataFrame, tables: MapTables, target: int, least_matches: int, tol: float, least_inliers: int, model: str = "similarity", bands: Sequence[int] = (3,)
) -> DataFrame:
    """hits with ``inliers``, verified in bands of rank: a later band only for frames whose earlier candidates have not reached ``target``.

    Candidates of a band that a frame never got to are left out.
    """
    points = frames.select("query", F.explode("local").alias("p")).select("query", "p.*")
    local = cut_lineage(image_rows(adaptive_keypoints(points, ["query"]), "query"))
    k = hits.agg(F.max("rank")).first()[0] or 0
    done, todo, low = None, hits, 0
    for high in [*[b for b in bands if b < k], k]:
        band = todo.filter((F.col("rank") > low) & (F.col("rank") <= high))
        got = verify(band, local, tables, least_matches, tol, least_inliers, model)
        part = cut_lineage(band.join(got, ["query", "image"], "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)).cast("long")))
        done = part if done is None else done.unionByName(part)
        if high < k:
            whole = done.filter(F.col("inliers") >= least_inliers).groupBy("query", "map_key").agg(F.sum("inliers").alias("n")).filter(F.col("n") >= target)
            todo = todo.join(whole.select("query").distinct(), "query", "left_anti")
        low = high
    return done


def localize(
    frames: DataFrame, tables: MapTables, k: int = 10, least: int = 2, least_matches: int = 4, tol: float = 6.0,
    least_inliers: int = 4, target: int = 50, model: str = "similarity",
) -> DataFrame:
    """One row per frame: retrieve, match, verify, stop early, vote and fuse; a failing stage is reported, not raised.

    ``frames``: query LONG, vec, local ARRAY of (kp_idx, x, y, score, desc); null or empty without features. A retrieved
    image is verified when at least ``least_matches`` reciprocal matches give ``least_inliers`` inliers of one planar
    similarity (or, with ``model`` "epipolar", one two-view geometry). Candidates are visited in rank order until one map has gathered ``target`` inliers, the map with most inliers
    wins, and the poses of its ``least`` or more images are fused with their inliers as weights.
    """
    c = F.col
    has = c("vec").isNotNull() & (F.size("vec") > 0) & (F.size("local") > 0)
    usable = frames.filter(has)
    # At most k rows per frame, read by every later step: materialized so that search and matching run once.
    hits = cut_lineage(retrieve_topk(usable.select("query", "vec"), None, k, index=tables.images))
    candidates = verified_candidates(hits, usable, tables, target, least_matches, tol, least_inliers, model)
    visited = early_stop(candidates, target, least_inliers, k)
    votes = region_vote(visited, least_inliers)
    voters = visited.filter(c("inliers") >= least_inliers).join(votes.select("query", "map_key"), ["query", "map_key"], "left_semi")
    poses = voters.join(tables.poses, "image").select(
        "query", "map_key", "image", "x", "y", "heading", c("inliers").cast("double").alias("weight")
    )
    fused = fuse_poses(poses, "query", ["image"]).select("query", c("x").alias("px"), c("y").alias("py"), "heading")
    found = hits.groupBy("query").agg(F.count("*").alias("_hits"))
    out = frames.join(found, "query", "left").join(votes, "query", "left").join(fused, "query", "left")
    stage = (
        F.when(~F.coalesce(has, F.lit(False)), "features").when(c("_hits").isNull(), "retrieve")
        .when(c("total").isNull(), "match").when(c("images") < least, "vote").when(c("px").isNull(), "pose")
    )
    # Reasons per failing stage.
    reasons = {
        "features": "no features", "retrieve": "no candidates", "match": "no verified candidate",
        "vote": "too few images agree", "pose": "map images have no pose",
    }
    reason = F.create_map(*[F.lit(v) for kv in reasons.items() for v in kv])[c("stage")]
    out = out.withColumn("stage", stage).withColumn("reason", reason).withColumn("success", c("stage").isNull())
    ok = c("success")
    return out.select(
        "query", "success", "stage", "reason", F.when(ok, c("map_key")).alias("map_key"), F.when(ok, c("total")).alias("total"),
        F.when(ok, c("images")).alias("images"), F.when(ok, c("px")).alias("x"), F.when(ok, c("py")).alias("y"), F.when(ok, c("heading")).alias("heading"),
    )
