"""Names, enumerations and schemas of slides, regions and annotations.

Coordinates: level-0 pixels (annotations, regions of interest, slide bounds), view pixels at a scaling (grids, region
reads), native-level pixels (level-0 by the level's downsample) and mask pixels. Order is x, y and width, height;
only rasters are rows by columns.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class AnnotationType(str, Enum):
    POINT = "POINT"
    BOX = "BOX"
    POLYGON = "POLYGON"
    TAG = "TAG"
    RASTER = "RASTER"


class AnnotationSorting(str, Enum):
    AREA = "AREA"
    REVERSE = "REVERSE"
    Z_INDEX = "Z_INDEX"
    NONE = "NONE"


class TilingMode(str, Enum):
    skip = "skip"
    overflow = "overflow"


class GridOrder(str, Enum):
    C = "C"
    F = "F"


class BoundaryMode(str, Enum):
    crop = "crop"
    zero = "zero"


class Resampling(str, Enum):
    NEAREST = "NEAREST"
    LANCZOS = "LANCZOS"


class Compression(str, Enum):
    NONE = "none"
    CCITTFAX4 = "ccittfax4"
    JPEG = "jpeg"
    DEFLATE = "deflate"
    PACKBITS = "packbits"
    LZW = "lzw"
    WEBP = "webp"
    ZSTD = "zstd"
    JP2K = "jp2k"
    JP2K_LOSSY = "jp2k_lossy"
    PNG = "png"


POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
#: The same as a type object: vectorised functions are declared where no session can parse DDL.
RINGS_TYPE = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
LEVEL = "struct<level:int,width:int,height:int,downsample:double,mpp_x:double,mpp_y:double>"
SLIDES = f"slide_id string, width int, height int, mpp double, levels array<{LEVEL}>, offset_x int, offset_y int, bounds_w int, bounds_h int, properties map<string,string>"
REGIONS = "slide_id string, region_index long, grid_index int, ix int, iy int, x double, y double, w int, h int, mpp double"
ANNOTATIONS = f"slide_id string, layer_idx int, label string, annotation_type string, color array<int>, z_index int, rings {RINGS}"
TAGS = "slide_id string, tag string"


def annotation_class(label: str, annotation_type: str, color: tuple[int, int, int] | None = None, z_index: int | None = None) -> dict:
    """A checked annotation class; points and tags take no z index."""
    kind = AnnotationType(annotation_type.upper())
    if z_index is not None and kind in (AnnotationType.POINT, AnnotationType.TAG):
        raise ValueError(f"{kind.value} takes no z index")
    return {"label": label, "annotation_type": kind.value, "color": color, "z_index": z_index}
