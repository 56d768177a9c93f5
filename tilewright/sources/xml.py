"""XML annotations of two viewers: groups of coordinates (ASAP) and regions of layers (HALO)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.color import hex_to_rgb
from ..operators.annotations import sort_layers
from ..operators.clip import even_odd_parts
from .contents import read_contents

#: Coordinates are read as text: inference would give whole numbers another type, and some use a decimal comma.
ASAP = "Annotations struct<Annotation:array<struct<_Name:string,_Type:string,_PartOfGroup:string,_Color:string,Coordinates:struct<Coordinate:array<struct<_Order:bigint,_X:string,_Y:string>>>>>>"
#: The types that such files use.
ASAP_TYPES = {"polygon": "POLYGON", "rectangle": "BOX", "dot": "POINT", "spline": "POLYGON", "pointset": "POINT"}
HALO = "Annotation array<struct<_Name:string,_LineColor:string,Regions:struct<Region:array<struct<_Type:string,_NegativeROA:string,Vertices:struct<V:array<struct<_X:string,_Y:string>>>>>>>>"
HALO_TYPES = {"rectangle": "BOX", "polygon": "POLYGON", "ellipse": "POLYGON", "pin": "POINT"}


def _number(text):
    return F.regexp_replace(text, ",", ".").cast("double")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("layer_idx", (F.row_number().over(Window.partitionBy("slide_id").orderBy(*order)) - 1).cast("int"))


COLUMNS = ("slide_id", "layer_idx", "label", "annotation_type", "color", "z_index", "rings")


def _opened(contents: DataFrame, schema: str, annotations: str) -> DataFrame:
    """slide_id, file, path, _row and the fields of each annotation."""
    rows = contents.select("slide_id", "file", "path", F.from_xml("content", schema, {"mode": "FAILFAST"}).alias("d"))
    return rows.select("slide_id", "file", "path", F.posexplode(f"d.{annotations}").alias("_row", "a")).select("slide_id", "file", "path", "_row", "a.*")


def read_asap(spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None, scaling: float | None = None, sorting: str = "AREA") -> DataFrame:
    """ASAP files; ``slide_id``: one for all, otherwise each file's name without its ending."""
    return parse_asap(read_contents(spark, paths, slide_id), scaling, sorting)


def read_halo(spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None, scaling: float | None = None, sorting: str = "NONE") -> DataFrame:
    """HALO files; ``slide_id``: one for all, otherwise each file's name without its ending."""
    return parse_halo(read_contents(spark, paths, slide_id), scaling, sorting)


def parse_asap(contents: DataFrame, scaling: float | None = None, sorting: str = "AREA") -> DataFrame:
    """ASAP annotations of ``contents`` (slide_id, file, path, content). Points have no area and are skipped, as is
    every polygon without one; larger areas come first unless ``sorting`` says otherwise."""
    rows = _opened(contents, ASAP, "Annotations.Annotation")
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in ASAP_TYPES.items() for x in kv)), F.lower(F.trim("_Type")))
    factor = F.lit(float(scaling or 1.0))
    ring = F.transform(F.array_sort(F.transform("Coordinates.Coordinate", lambda c: F.struct(c["_Order"].alias("o"), (_number(c["_X"]) * factor).alias("x"), (_number(c["_Y"]) * factor).alias("y")))), lambda c: G.point(c["x"], c["y"]))
    unknown = F.raise_error(F.concat(F.lit("unknown annotation type: "), F.coalesce("_Type", F.lit("none")))).cast("string")
    rows = rows.select("slide_id", "file", "path", "_row", F.trim("_PartOfGroup").alias("label"), F.coalesce(kind, unknown).alias("annotation_type"), hex_to_rgb(F.col("_Color")).alias("color"), F.lit(None).cast("int").alias("z_index"), F.array(G.opened(ring)).alias("rings"))
    rows = rows.filter(F.col("annotation_type") != "POINT").select(*(c for c in rows.columns if c != "rings"), F.posexplode(even_odd_parts(F.col("rings"))).alias("_part", "rings"))
    rows = rows.filter(G.polygon_area(F.col("rings")) != 0)
    made = _numbered(rows, "file", "path", "_row", "_part").select(*COLUMNS)
    return made if sorting.upper() == "NONE" else sort_layers(made, sorting)


def parse_halo(contents: DataFrame, scaling: float | None = None, sorting: str = "NONE") -> DataFrame:
    """HALO annotations of ``contents`` (slide_id, file, path, content), relative to the slide's bounds (see
    operators.annotations.shifted): rectangles from two corners, ellipses as polygons of 64 corners in their box,
    polygons and pins."""
    rows = _opened(contents, HALO, "Annotation").select("*", F.posexplode("Regions.Region").alias("_k", "r"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in HALO_TYPES.items() for x in kv)), F.lower(F.trim("r._Type")))
    unknown = F.raise_error(F.concat(F.lit("unknown region type: "), F.coalesce("r._Type", F.lit("none")))).cast("string")
    factor = F.lit(float(scaling or 1.0))
    ring = F.transform("r.Vertices.V", lambda v: G.point(_number(v["_X"]) * factor, _number(v["_Y"]) * factor))
    b = G.bounds(F.array(ring))
    box = G.box_rings(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])
    turn = F.sequence(F.lit(0), F.lit(63))
    oval = F.array(F.transform(turn, lambda k: G.point((b["x0"] + b["x1"]) / 2 + (b["x1"] - b["x0"]) / 2 * F.cos(k * 3.141592653589793 / 32), (b["y0"] + b["y1"]) / 2 + (b["y1"] - b["y0"]) / 2 * F.sin(k * 3.141592653589793 / 32))))
    shape = F.lower(F.trim("r._Type"))
    rings = F.when(shape == "rectangle", box).when(shape == "ellipse", oval).when(shape == "pin", F.array(F.slice(ring, 1, 1))).otherwise(F.array(G.opened(ring)))
    # colours are one number, blue in its highest byte
    n = F.col("_LineColor").cast("long")
    color = F.when(n.isNotNull(), F.array(n.bitwiseAND(F.lit(255)).cast("int"), F.shiftright(n, 8).bitwiseAND(F.lit(255)).cast("int"), F.shiftright(n, 16).bitwiseAND(F.lit(255)).cast("int")))
    rows = rows.select("slide_id", "file", "path", "_row", "_k", F.col("_Name").alias("label"), F.coalesce(kind, unknown).alias("annotation_type"), color.alias("color"), F.lit(None).cast("int").alias("z_index"), rings.alias("rings"))
    made = _numbered(rows, "file", "path", "_row", "_k").select(*COLUMNS)
    return made if sorting.upper() == "NONE" else sort_layers(made, sorting)
