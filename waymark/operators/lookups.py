"""Equi-joins that hydrate frames, resolve labels and merge edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_KEY = ["place", "building", "floor"]
# Sections that accept label edits.
SECTIONS = ("places", "buildings", "floors", "destinations")


def resolve_observations(observations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Observations with their 3D point as a nullable struct; id -1 means none."""
    lm = landmarks.select("point_id", F.struct("px", "py", "pz").alias("landmark"))
    ids = F.when(F.col("point_id") >= 0, F.col("point_id"))
    return observations.withColumn("point_id", ids).join(lm, "point_id", "left")


def assemble_frames(observations: DataFrame, landmarks: DataFrame, chunk: int = 2000) -> DataFrame:
    """image, chunk, observations array in keypoint order. Chunks bound the array of a crowded image."""
    rows = resolve_observations(observations, landmarks)
    packed = rows.groupBy("image", F.floor(F.col("kp_idx") / chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("kp_idx", "x", "y", "point_id", "landmark"))).alias("observations")
    )
    return packed


def keyframe_landmarks(
    keypoints: DataFrame, associations: DataFrame, landmarks: DataFrame, poses: DataFrame, trajectory: DataFrame
) -> DataFrame:
    """Keypoints with landmark position and pose; a trajectory pose overrides the stored one.

    ``poses`` and ``trajectory`` hold kf and a struct column ``pose``.
    """
    assoc = associations.filter(F.col("lm_id") >= 0)
    lm = landmarks.select(F.col("point_id").alias("lm_id"), "px", "py", "pz")
    pose = (
        poses.withColumnRenamed("pose", "_stored")
        .join(trajectory.withColumnRenamed("pose", "_traj"), "kf", "left")
        .select("kf", F.coalesce("_traj", "_stored").alias("pose"))
    )
    return keypoints.join(assoc, ["kf", "kp_idx"], "left").join(lm, "lm_id", "left").join(pose, "kf")


def hydrate(candidates: DataFrame, frames: DataFrame, features: DataFrame) -> DataFrame:
    """Candidates with frame and features, keyed by map and image so equal names on two floors stay apart."""
    key = ["map_key", "image"]
    return candidates.join(frames, key).join(features, key)


def label_lookup(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Requests (section, key, lang, fallback) -> label: language, then English, then the fallback."""
    text = F.trim("text")
    usable = labels.filter(text != "").select("section", "key", "lang", text.alias("text"))
    wanted = usable.select("section", "key", "lang", F.col("text").alias("_own"))
    english = usable.filter(F.col("lang") == "en").select("section", "key", F.col("text").alias("_en"))
    return (
        requests.join(wanted, ["section", "key", "lang"], "left")
        .join(english, ["section", "key"], "left")
        .withColumn("label", F.coalesce("_own", "_en", "fallback"))
        .drop("_own", "_en")
    )


def resolve_alias(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests (lang, text) -> canonical id and its levels; null when unknown."""
    known = aliases.select("lang", F.col("alias").alias("_alias"), "canonical")
    joined = requests.withColumn("_alias", F.trim("text")).join(known, ["lang", "_alias"], "left").drop("_alias")
    parts = F.split("canonical", "/")
    return joined.withColumns({n: F.get(parts, i) for i, n in enumerate((*MAP_KEY, "dest_id"))})


def _grams(text: Column, size: int) -> Column:
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(spots, lambda i: F.substr(text, i, F.lit(size))))


def search_names(terms: DataFrame, names: DataFrame, gram: int = 3, size: int = 4096) -> DataFrame:
    """First name (by ``ord``) containing each term, ignoring case; null for terms without a hit.

    ``terms`` holds term_id, term; ``names`` holds name, ord. Equal terms are searched once. The first name of every
    asked substring of up to ``gram`` characters is one aggregate, which already answers terms of that length. Longer terms
    meet the names that hold their rarest substring, with the exact test after it; a substring that is common even so
    is joined in blocks of ``size`` rows. Terms are not blank. Substrings and hits carry ``ord`` only, so a hash aggregate keeps
    one small row a key and no task sorts all substrings of its names; the name is read by ``ord`` at the end.
    """
    from waymark.operators.cells import deal

    def first(n: str) -> Column:
        return F.when(F.count_if(F.col(n).isNull()) == 0, F.min(n)).alias(n)  # nulls come first

    low = names.select("ord", "name", F.lower("name").alias("_n"))
    asked = terms.select("term_id", F.lower("term").alias("_t"))
    length = F.least(F.lit(gram), F.length("_t"))
    want = asked.select("_t").distinct().select(
        "_t", F.explode(F.coalesce(*[F.when(length == k, _grams(F.col("_t"), k)) for k in range(1, gram + 1)])).alias("_g"),
    )
    have = low.select(
        "ord", "_n",
        F.explode(F.flatten(F.array(*[_grams(F.col("_n"), k) for k in range(1, gram + 1)]))).alias("_g"),
    ).join(want.select("_g").distinct(), "_g", "left_semi")
    grams = have.groupBy("_g").agg(F.count("*").alias("_w"), first("ord"))
    # A substring that no name holds settles its term, so the inner join may drop it only with the whole term.
    rarest = (
        want.join(grams, "_g", "left").groupBy("_t")
        .agg(F.min(F.struct(F.coalesce("_w", F.lit(0)).alias("w"), F.col("_g").alias("g"), "ord")).alias("_r"))
        .filter("_r.w > 0")
    )
    short = F.length("_t") <= gram
    longer = rarest.filter(~short).select("_t", F.col("_r.g").alias("_g"))
    counts = (longer.groupBy("_g").agg(F.count("*").alias("n")), grams.select("_g", F.col("_w").alias("n")))
    a, b = deal(longer, have.join(longer.select("_g").distinct(), "_g", "left_semi"), ["_g"], counts, size)
    hits = a.join(b, ["_g", "_lb", "_rb"]).filter(F.contains("_n", "_t"))
    best = hits.groupBy("_t").agg(first("ord")).unionByName(rarest.filter(short).select("_t", "_r.ord"))
    found = best.join(low.withColumnRenamed("ord", "_o"), F.col("ord").eqNullSafe(F.col("_o")) & F.contains("_n", "_t"))
    named = found.groupBy("_t").agg(F.min(F.struct("ord", "name")).alias("m"))
    return asked.join(named, "_t", "left").select("term_id", "m.ord", "m.name")


def last_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest change per key."""
    rest = [n for n in changes.columns if n not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_c")).select(*keys, "_c.*")


def usable_labels(changes: DataFrame) -> DataFrame:
    """Label edits of known sections with a key."""
    return changes.filter(F.col("section").isin(*SECTIONS) & (F.coalesce("key", F.lit("")) != ""))


def usable_aliases(changes: DataFrame) -> DataFrame:
    """Alias edits with a language and an alias, trimmed, that delete or name a target."""
    named = (F.trim("lang") != "") & (F.trim("alias") != "")
    usable = F.col("delete") | (F.coalesce(F.trim("canonical"), F.lit("")) != "")
    return changes.filter(named & usable).withColumns({k: F.trim(k) for k in ("lang", "alias")})


def merge_labels(base: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Apply a change log to labels: text sets, blank text deletes, unknown sections are ignored."""
    keys = ["section", "key", "lang"]
    last = last_changes(usable_labels(changes), keys, order).select(*keys, F.trim(F.coalesce("text", F.lit(""))).alias("_new"))
    merged = base.select(*keys, "text").join(last, keys, "full_outer")
    return merged.select(*keys, F.coalesce("_new", "text").alias("text"), F.col("_new").isNull().alias("_old")).filter(
        F.col("_old") | (F.col("text") != "")
    ).drop("_old")


def merge_aliases(base: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Apply alias edits (lang, alias, canonical, delete)."""
    keys = ["lang", "alias"]
    last = last_changes(usable_aliases(changes), keys, order).select(*keys, F.trim("canonical").alias("_new"), F.col("delete").alias("_gone"))
    merged = base.select(*keys, "canonical").join(last, keys, "full_outer")
    return merged.filter(~F.coalesce("_gone", F.lit(False))).select(*keys, F.coalesce("_new", "canonical").alias("canonical"))


def connector_edges(nodes: DataFrame) -> DataFrame:
    """Edges between connectors that share a non-empty label, both directions.

    ``nodes`` holds map key, node_id, label, description and ``ord`` (the order in which
    connectors were read; the first one's description sets the penalty).
    """
    from waymark.functions.names import floor_number
    from waymark.operators.blocks import block_pairs

    key = [*MAP_KEY, "node_id", "ord"]
    conn = nodes.filter((F.col("group_id") == 4) & (F.col("label") != ""))
    a = conn.select("label", F.lower("description").alias("_desc"), *[F.col(k).alias(f"a_{k}") for k in key])
    b = conn.select("label", *[F.col(k).alias(f"b_{k}") for k in key])
    pairs = block_pairs(a, b, ["label"], "a_ord", "b_ord").filter(F.col("a_ord") < F.col("b_ord"))
    jump = F.abs(floor_number(F.col("a_floor")) - floor_number(F.col("b_floor")))
    # Penalty per floor for stairs, flat penalty for elevators.
    penalty = (
        F.when(F.contains("_desc", F.lit("staircase")), F.coalesce(jump, F.lit(0)) * 50.0)
        .when(F.contains("_desc", F.lit("elevator")), F.lit(3.0))
        .otherwise(F.lit(0.0))
    )
    ends = [*MAP_KEY, "node_id"]
    both = F.array(
        F.struct(F.struct(*[F.col(f"a_{k}").alias(k) for k in ends]).alias("src"), F.struct(*[F.col(f"b_{k}").alias(k) for k in ends]).alias("dst")),
        F.struct(F.struct(*[F.col(f"b_{k}").alias(k) for k in ends]).alias("src"), F.struct(*[F.col(f"a_{k}").alias(k) for k in ends]).alias("dst")),
    )
    return pairs.select(penalty.alias("weight"), F.explode(both).alias("e")).select("e.src", "e.dst", "weight")
