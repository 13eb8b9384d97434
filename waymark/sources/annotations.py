"""Floor annotations, scales, labels and destination files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAP_KEY = ["place", "building", "floor"]

ANNOTATION_SCHEMA = (
    "shapes array<struct<label string, group_id int, shape_type string, description string, "
    "points array<array<double>>>>"
)
SCALE_SCHEMA = "map<string,map<string,map<string,double>>>"
LABEL_SECTION_SCHEMA = "map<string,map<string,string>>"
# Sections of a label file.
LABEL_SECTIONS = ("places", "buildings", "floors", "destinations")
DESTINATION_SCHEMA = "array<struct<id string, name string>>"
# Files that mark a folder as a floor.
FLOOR_FILES = ("boundaries.json", "destinations.json")


def path_part(path: Column, from_end: int) -> Column:
    """Path component counted from the end; 1 is the file name."""
    return F.element_at(F.split(path, "/"), -from_end)


def list_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """File paths under a data root, without reading contents."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path")
    )


def floor_catalog(paths: DataFrame) -> DataFrame:
    """place, building, floor of every folder holding a floor file."""
    return (
        paths.filter(path_part(F.col("path"), 1).isin(*FLOOR_FILES))
        .select(
            path_part(F.col("path"), 4).alias("place"),
            path_part(F.col("path"), 3).alias("building"),
            path_part(F.col("path"), 2).alias("floor"),
        )
        .distinct()
    )


def catalog_tree(floors: DataFrame) -> DataFrame:
    """One row per building with its sorted floors."""
    return floors.groupBy("place", "building").agg(F.array_sort(F.collect_set("floor")).alias("floors"))


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """Annotation files under place/building/floor folders -> shapes."""
    docs = (
        spark.read.schema(ANNOTATION_SCHEMA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "boundaries.json")
        .json(root)
        .select("shapes", F.input_file_name().alias("path"))
    )
    keyed = docs.select(
        *[path_part(F.col("path"), n).alias(k) for n, k in ((4, "place"), (3, "building"), (2, "floor"))], "shapes"
    )
    return explode_shapes(keyed)


def parse_annotations(docs: DataFrame, text: str = "annotation") -> DataFrame:
    """place, building, floor, JSON text -> shapes."""
    parsed = F.from_json(F.col(text), ANNOTATION_SCHEMA)
    return explode_shapes(docs.select(*MAP_KEY, parsed.shapes.alias("shapes")))


def explode_shapes(docs: DataFrame) -> DataFrame:
    s = F.col("s")
    return docs.select(*MAP_KEY, F.posexplode("shapes").alias("pos", "s")).select(
        *MAP_KEY, "pos", s.shape_type.alias("shape_type"), s.group_id.alias("group_id"),
        F.trim(F.coalesce(s.label, F.lit(""))).alias("label"),
        F.trim(F.coalesce(s.description, F.lit(""))).alias("description"), s.points.alias("points"),
    )


def shape_nodes(shapes: DataFrame) -> DataFrame:
    """Point shapes numbered in file order over all point shapes of the floor."""
    w = Window.partitionBy(*MAP_KEY).orderBy("pos")
    return (
        shapes.filter((F.col("shape_type") == "point") & (F.size("points") > 0))
        .withColumn("node_id", (F.row_number().over(w) - 1).cast("long"))
        .select(
            *MAP_KEY, "node_id", F.col("points")[0][0].alias("x"), F.col("points")[0][1].alias("y"),
            "label", "group_id", "description",
        )
    )


def shape_polygons(shapes: DataFrame) -> DataFrame:
    """Regions (walkable 0, obstacle 1, door 2); a two-point rectangle becomes its four corners."""
    p = F.col("points")
    corners = F.array(
        F.array(p[0][0], p[0][1]), F.array(p[0][0], p[1][1]), F.array(p[1][0], p[1][1]), F.array(p[1][0], p[0][1])
    )
    ring = F.when((F.col("shape_type") == "rectangle") & (F.size("points") == 2), corners).otherwise(p)
    return shapes.filter(F.col("shape_type").isin("polygon", "rectangle") & F.col("group_id").isin(0, 1, 2)).select(
        *MAP_KEY, "pos", "group_id", "label", ring.alias("ring")
    )


def partner_lines(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Companion lines bound to the first connector with their label; the last line wins."""
    first = nodes.filter(F.col("group_id") == 4).groupBy(*MAP_KEY, "label").agg(F.min("node_id").alias("node_id"))
    lines = (
        shapes.filter((F.col("shape_type") == "line") & (F.col("group_id") == 6) & (F.size("points") == 2))
        .groupBy(*MAP_KEY, "label")
        .agg(F.max_by("points", "pos").alias("points"))
    )
    return lines.join(first, [*MAP_KEY, "label"])


def parse_scales(docs: DataFrame, text: str = "scales") -> DataFrame:
    """Scale JSON text -> place, building, floor, m_per_px."""
    places = docs.select(F.explode(F.from_json(F.col(text), SCALE_SCHEMA)).alias("place", "b"))
    buildings = places.select("place", F.explode("b").alias("building", "f"))
    return buildings.select("place", "building", F.explode("f").alias("floor", "m_per_px"))


def with_default_scale(floors: DataFrame, scales: DataFrame, default: float = 1.0) -> DataFrame:
    return floors.join(scales, MAP_KEY, "left").select(
        *MAP_KEY, F.coalesce("m_per_px", F.lit(default)).alias("m_per_px")
    )


def parse_labels(docs: DataFrame, text: str = "labels") -> DataFrame:
    """Label JSON text -> section, key, lang, text. A section that is not an object counts as empty."""
    raw = docs.select(F.from_json(F.col(text), "map<string,string>").alias("m"))
    sections = raw.select(
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("section"), F.from_json(F.col("m")[s], LABEL_SECTION_SCHEMA).alias("body"))
            for s in LABEL_SECTIONS
        ])).alias("s")
    )
    keys = sections.select("s.section", F.explode("s.body").alias("key", "langs"))
    return keys.select("section", "key", F.explode("langs").alias("lang", "text"))


def parse_aliases(docs: DataFrame, text: str = "labels") -> DataFrame:
    """Label JSON text -> lang, alias, canonical."""
    raw = docs.select(F.from_json(F.col(text), "map<string,string>")["aliases"].alias("a"))
    langs = raw.select(F.explode(F.from_json("a", LABEL_SECTION_SCHEMA)).alias("lang", "m"))
    return langs.select("lang", F.explode("m").alias("alias", "canonical"))


def parse_destinations(docs: DataFrame, text: str = "destinations") -> DataFrame:
    """Destination JSON text -> entries that have an id; the name defaults to the id."""
    rows = docs.select(*MAP_KEY, F.explode(F.from_json(F.col(text), DESTINATION_SCHEMA)).alias("d"))
    return rows.filter(F.coalesce("d.id", F.lit("")) != "").select(
        *MAP_KEY, F.col("d.id").alias("dest_id"), F.coalesce("d.name", "d.id").alias("name")
    )
