"""GeoJSON annotations: reading into rows, writing back to documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.color import geojson_color
from ..model import RINGS
from ..operators.annotations import sort_layers
from .contents import read_contents

FEATURE = (
    "struct<type:string,id:string,geometry:struct<type:string,coordinates:variant>,"
    "properties:struct<objectType:string,name:string,color:array<int>,classification:struct<name:string,color:array<int>>>>"
)
DOCUMENT = f"id string, type string, features array<{FEATURE}>, metadata struct<tags:array<string>>"


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: G.point(p[0], p[1]))


def _rings(paths: Column) -> Column:
    return F.transform(paths, lambda r: G.opened(_points(r)))


def geometries(kind: Column, coordinates: Column) -> Column:
    """Array of struct(annotation_type, rings): one for each part of the geometry. ``coordinates`` is a variant."""
    kind = F.lower(kind)
    as_ = lambda t: F.try_variant_get(coordinates, "$", t)
    one = lambda t, rings: F.struct(t.alias("annotation_type"), rings.cast(RINGS).alias("rings"))
    point = F.array(one(F.lit("POINT"), F.array(F.array(G.point(as_("array<double>")[0], as_("array<double>")[1])))))
    many = F.transform(as_("array<array<double>>"), lambda p: one(F.lit("POINT"), F.array(F.array(G.point(p[0], p[1])))))
    rings = _rings(as_("array<array<array<double>>>"))
    # the rings are an argument of the lambda, so that they are read once
    polygon = F.transform(F.array(rings), lambda r: one(F.when(G.is_rectangle(r), F.lit("BOX")).otherwise(F.lit("POLYGON")), r))
    parts = F.transform(as_("array<array<array<array<double>>>>"), lambda r: one(F.lit("POLYGON"), _rings(r)))
    bad = F.raise_error(F.concat(F.lit("unsupported geometry type: "), F.coalesce(kind, F.lit("none")))).cast(f"array<struct<annotation_type:string,rings:{RINGS}>>")
    return F.when(kind == "point", point).when(kind == "multipoint", many).when(kind == "polygon", polygon).when(kind == "multipolygon", parts).otherwise(bad)


def label_of(properties: Column) -> Column:
    """The classification's name, else an annotation's own name, else an error."""
    own = F.when(properties["objectType"] == "annotation", properties["name"])
    return F.coalesce(properties["classification"]["name"], own, F.raise_error(F.lit("feature without a label")).cast("string"))


def parse(contents: DataFrame, sorting: str = "NONE") -> DataFrame:
    """Annotations of documents: ``contents`` has slide_id, file, path and content, see ``read_contents``. A slide's
    layers are numbered in the order of file, path, feature and part."""
    rows = contents.select("slide_id", "file", "path", F.from_json("content", DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    rows = rows.select("slide_id", "file", "path", F.posexplode("d.features").alias("_k", "f"))
    rows = rows.select("slide_id", "file", "path", "_k", "f", F.posexplode(geometries(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("_p", "_g"))
    color = F.coalesce(geojson_color(F.col("f.properties.classification.color")), geojson_color(F.col("f.properties.color")))
    rows = rows.select("slide_id", "file", "path", "_k", "_p", label_of(F.col("f.properties")).alias("label"), F.col("_g.annotation_type"), color.alias("color"), F.lit(None).cast("int").alias("z_index"), F.col("_g.rings"))
    order = Window.partitionBy("slide_id").orderBy("file", "path", "_k", "_p")
    made = rows.withColumn("layer_idx", (F.row_number().over(order) - 1).cast("int")).select("slide_id", "layer_idx", "label", "annotation_type", "color", "z_index", "rings")
    return made if sorting.upper() == "NONE" else sort_layers(made, sorting)


def parse_tags(contents: DataFrame) -> DataFrame:
    """(slide_id, tag) of each slide's last document that has tags."""
    tags = F.from_json("content", DOCUMENT)["metadata"]["tags"]
    rows = contents.select("slide_id", F.struct("file", "path").alias("at"), tags.alias("tags")).filter(F.size("tags") > 0)
    return rows.groupBy("slide_id").agg(F.max_by("tags", "at").alias("tags")).select("slide_id", F.explode("tags").alias("tag"))


def read(spark: SparkSession, paths: str | Sequence[str], sorting: str = "NONE", slide_id: str | None = None) -> DataFrame:
    """Annotations of GeoJSON files, in order of the paths and features given. ``slide_id``: one for all paths;
    otherwise the file's name without its ending."""
    return parse(read_contents(spark, paths, slide_id), sorting)


def read_tags(spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None) -> DataFrame:
    """(slide_id, tag) of each slide's last document that has tags."""
    return parse_tags(read_contents(spark, paths, slide_id))


def feature(extra: bool = False) -> Column:
    """One annotation as a GeoJSON feature; ids are layer numbers. ``extra`` adds the type and z index."""
    pair = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(F.concat(G.opened(r), F.slice(r, 1, 1)), pair)
    geometry = F.when(F.col("annotation_type") == "POINT", F.parse_json(F.to_json(F.struct(F.lit("Point").alias("type"), pair(F.col("rings")[0][0]).alias("coordinates"))))).otherwise(
        F.parse_json(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform("rings", ring).alias("coordinates"))))
    )
    properties = [F.struct(F.col("label").alias("name"), F.col("color").alias("color")).alias("classification")]
    if extra:
        properties += [F.col("annotation_type").alias("annotationType"), F.col("z_index").alias("zIndex")]
    return F.struct(F.lit("Feature").alias("type"), F.col("layer_idx").cast("string").alias("id"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))


def documents(annotations: DataFrame, tags: DataFrame | None = None, extra: bool = False) -> DataFrame:
    """(slide_id, document): a FeatureCollection for each slide, features in order of layers."""
    made = annotations.select("slide_id", F.struct("layer_idx", F.to_json(feature(extra)).alias("f")).alias("_s"))
    made = made.groupBy("slide_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["f"]), ",").alias("features"))
    if tags is not None:
        made = made.join(tags.groupBy("slide_id").agg(F.to_json(F.sort_array(F.collect_list("tag"))).alias("tags")), "slide_id", "left")
    meta = F.concat(F.lit(',"metadata":{"tags":'), F.coalesce("tags", F.lit("[]")), F.lit("}")) if tags is not None else F.lit("")
    return made.select("slide_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]"), meta, F.lit("}")).alias("document"))
