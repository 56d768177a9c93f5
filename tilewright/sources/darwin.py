"""Darwin JSON annotations with the colours of their export's metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AnnotationError
from ..functions import geometry as G
from ..functions.color import parse_rgba
from ..operators.annotations import sort_layers
from ..operators.clip import even_odd_parts
from ..operators.dealing import dealt
from .contents import read_contents

XY = "struct<x:double,y:double>"
ANNOTATION = (
    f"struct<name:string,bounding_box:struct<x:double,y:double,w:double,h:double>,polygon:struct<path:array<{XY}>,paths:array<array<{XY}>>>,"
    f"keypoint:{XY},tag:struct<_:string>,ellipse:string,raster_layer:string>"
)
DOCUMENT = f"item struct<name:string>, annotations array<{ANNOTATION}>"
FROM = ["slide_id", "file", "path"]
METADATA = "classes array<struct<name:string,type:string,color:string>>"
#: Annotation types of the format.
TYPES = {"bounding_box": "BOX", "polygon": "POLYGON", "keypoint": "POINT", "tag": "TAG", "raster_layer": "RASTER", "mask": "RASTER"}


def parse_metadata(contents: DataFrame) -> DataFrame:
    """(label, annotation_type, color) of an export's classes; rasters are left out, an alpha other than 1 is an error."""
    rows = contents.select(F.from_json("content", METADATA, {"mode": "FAILFAST"}).alias("d")).select(F.explode("d.classes").alias("c"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), F.col("c.type"))
    return rows.select(F.col("c.name").alias("label"), kind.alias("annotation_type"), parse_rgba(F.col("c.color")).alias("color")).filter(F.col("annotation_type") != "RASTER")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(read_contents(spark, path))


def _annotations(contents: DataFrame) -> DataFrame:
    rows = contents.select(*FROM, F.from_json("content", DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    return rows.select(*FROM, F.posexplode("d.annotations").alias("_k", "a"))


def read(spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None, metadata: str | None = None, sorting: str = "NONE", z_indices: dict[str, int] | None = None) -> DataFrame:
    """Annotations of Darwin files, tags excepted (see ``read_tags``). Raster layers raise NotImplementedError."""
    contents = read_contents(spark, paths, slide_id)
    if not _annotations(contents).filter("a.raster_layer IS NOT NULL").isEmpty():
        raise NotImplementedError("raster annotations aren't supported")
    return parse(contents, None if metadata is None else read_metadata(spark, metadata), sorting, z_indices)


def parse(contents: DataFrame, metadata: DataFrame | None = None, sorting: str = "NONE", z_indices: dict[str, int] | None = None) -> DataFrame:
    """Annotations of ``contents`` (slide_id, file, path, content), tags excepted. ``metadata``: label,
    annotation_type and color of each class (see ``read_metadata``). A raster layer is an error when it is read."""
    raster = F.raise_error(F.lit("raster annotations aren't supported")).cast("boolean")
    rows = _annotations(contents).filter(F.when(F.col("a.raster_layer").isNotNull(), raster).otherwise(F.col("a.tag").isNull()))
    box = F.array(G.box_rings(F.col("a.bounding_box.x"), F.col("a.bounding_box.y"), F.col("a.bounding_box.w"), F.col("a.bounding_box.h")))
    point = F.array(F.array(F.array(G.point(F.col("a.keypoint.x"), F.col("a.keypoint.y")))))
    paths = F.coalesce("a.polygon.paths", F.array("a.polygon.path"))
    many = F.col("a.polygon.paths").isNotNull() & (F.size("a.polygon.paths") > 1)
    plain = F.array(F.transform(paths, G.opened))
    shape = F.when(F.col("a.polygon").isNotNull(), F.when(many, even_odd_parts(F.when(many, paths))).otherwise(plain)).when(F.col("a.keypoint").isNotNull(), point).when(F.col("a.bounding_box").isNotNull(), box)
    kind = F.when(F.col("a.polygon").isNotNull(), F.lit("POLYGON")).when(F.col("a.keypoint").isNotNull(), F.lit("POINT")).when(F.col("a.bounding_box").isNotNull(), F.lit("BOX"))
    unknown = F.raise_error(F.lit("unsupported annotation type"))
    rows = rows.select(*FROM, "_k", F.col("a.name").alias("label"), F.coalesce(kind, unknown.cast("string")).alias("annotation_type"), F.posexplode(shape).alias("_p", "rings"))
    if metadata is not None:
        found = metadata.select("label", F.col("annotation_type").alias("_t"), "color").dropDuplicates(["label"])
        lacking = F.raise_error(F.concat(F.lit("class without metadata: "), F.coalesce("label", F.lit("none")))).cast("array<int>")
        # a row for each class: broadcast, as a join by label would put all annotations of a class into one task
        rows = rows.join(F.broadcast(found), "label", "left").withColumn("color", F.when(F.col("_t").isNull(), lacking).otherwise(F.col("color"))).drop("_t")
    else:
        rows = rows.withColumn("color", F.lit(None).cast("array<int>"))
    if z_indices is not None:
        table = F.create_map(*(F.lit(x) for kv in z_indices.items() for x in kv))
        lacking = F.raise_error(F.concat(F.lit("no z index for "), F.col("label"))).cast("int")
        z = F.when(F.col("annotation_type") != "POINT", F.coalesce(F.try_element_at(table, F.col("label")), lacking))
    else:
        z = F.lit(None).cast("int")
    order = Window.partitionBy("slide_id").orderBy("file", "path", "_k", "_p")
    rows = dealt(rows, "slide_id").withColumn("z_index", z).withColumn("layer_idx", (F.row_number().over(order) - 1).cast("int"))
    made = rows.select("slide_id", "layer_idx", "label", "annotation_type", "color", "z_index", "rings")
    return made if sorting.upper() == "NONE" else sort_layers(made, sorting)


def parse_tags(contents: DataFrame) -> DataFrame:
    """(slide_id, tag), a row for every tag."""
    return _annotations(contents).filter("a.tag IS NOT NULL").select("slide_id", F.col("a.name").alias("tag"))


def read_tags(spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None) -> DataFrame:
    return parse_tags(read_contents(spark, paths, slide_id))


def check_z_indices(labels: list[str], z_indices: dict[str, int]) -> None:
    lacking = sorted(set(labels) - set(z_indices))
    if lacking:
        raise AnnotationError(f"no z index for {lacking}")
