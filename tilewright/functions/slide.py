"""Column expressions over slides: scalings, sizes, levels, spacing and bounds.

``levels`` columns are arrays of structs with ``level``, ``downsample`` and so on, in order of ``downsample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedSlideError

#: Fixed value: relative difference up to which two spacings count as equal.
MPP_TOLERANCE = 0.015


def scaling_of(native_mpp: Column, mpp: Column) -> Column:
    """Native over wanted spacing; 1 where the wanted one is null or 0."""
    return F.when(mpp.isNull() | (mpp == 0), F.lit(1.0)).otherwise(native_mpp / mpp)


def mpp_of(native_mpp: Column, scaling: Column) -> Column:
    return native_mpp / scaling


def scaled(size: Column, scaling: Column) -> Column:
    """Size in view pixels, truncated."""
    return (size * scaling).cast("int")


def slide_bounds(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Bounds in level-0 pixels; the whole slide where they are null."""
    return F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"), F.coalesce(w, width).alias("w"), F.coalesce(h, height).alias("h"))


def scaled_bounds(bounds: Column, scaling: Column) -> Column:
    return F.struct(*(scaled(bounds[k], scaling).alias(k) for k in ("x", "y", "w", "h")))


def scaled_view(slides: DataFrame, mpp: float | Column | None) -> DataFrame:
    """Add scaling, view_w, view_h and view_mpp."""
    want = mpp if isinstance(mpp, Column) else F.lit(mpp).cast("double")
    s = scaling_of(F.col("mpp"), want)
    return slides.withColumns({"scaling": s, "view_w": scaled(F.col("width"), s), "view_h": scaled(F.col("height"), s), "view_mpp": mpp_of(F.col("mpp"), s)})


def best_level(levels: Column, downsample: Column) -> Column:
    """Last level whose downsample isn't above the wanted one; level 0 below 1."""
    fit = F.filter(levels, lambda l: l["downsample"] <= downsample)
    return F.when(downsample < 1, F.lit(0)).otherwise(F.coalesce(F.array_max(F.transform(fit, lambda l: l["level"])), F.lit(0)))


def level_at(levels: Column, level: Column) -> Column:
    return F.element_at(F.filter(levels, lambda l: l["level"] == level), 1)


def closest_level(levels: Column, mpp: Column) -> Column:
    """Level of the spacing nearest to ``mpp``; of equally near ones the first."""
    return F.array_min(F.transform(levels, lambda l: F.struct(F.abs((l["mpp_x"] + l["mpp_y"]) / 2 - mpp).alias("d"), l["level"].alias("level"))))["level"]


def closest_mpp(levels: Column, mpp: Column) -> Column:
    own = level_at(levels, closest_level(levels, mpp))
    return (own["mpp_x"] + own["mpp_y"]) / 2


def with_spacing(levels: Column, mpp_x: Column, mpp_y: Column) -> Column:
    """Levels with the spacing of level 0 times their downsample."""
    return F.transform(levels, lambda l: F.struct(l["level"].alias("level"), l["width"].alias("width"), l["height"].alias("height"), l["downsample"].alias("downsample"), (mpp_x * l["downsample"]).alias("mpp_x"), (mpp_y * l["downsample"]).alias("mpp_y")))


def is_close(x: Column, y: Column, tolerance: float = MPP_TOLERANCE) -> Column:
    return F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))


def mpp_valid(x: Column, y: Column, tolerance: float = MPP_TOLERANCE) -> Column:
    """Both set, neither 0, and equal within the tolerance."""
    return F.coalesce((x != 0) & (y != 0) & is_close(x, y, tolerance), F.lit(False))


def checked_mpp(x: Column, y: Column, tolerance: float = MPP_TOLERANCE) -> Column:
    """The mean spacing; an error where it is missing, 0 or anisotropic."""
    missing = x.isNull() | y.isNull() | (x == 0) | (y == 0)
    return F.when(missing, F.raise_error(F.lit("Unable to parse mpp."))).when(~is_close(x, y, tolerance), F.raise_error(F.lit("The spacing is anisotropic."))).otherwise((x + y) / 2)


def check_mpp(x: float | None, y: float | None, tolerance: float = MPP_TOLERANCE) -> float:
    if not x or not y:
        raise UnsupportedSlideError("Unable to parse mpp.")
    if abs(x - y) > tolerance * max(abs(x), abs(y)):
        raise UnsupportedSlideError(f"The spacing is anisotropic: {x}, {y}.")
    return (x + y) / 2


def mpp_from_tiff(properties: Column) -> tuple[Column, Column]:
    """Spacing from TIFF resolution tags: only of library versions before 4.0.0 and plain TIFF files, unit cm."""
    old = F.regexp_extract(properties["openslide.library-version"], r"^(\d+)", 1).cast("int") < 4
    unit, vendor = properties["tiff.ResolutionUnit"], properties["openslide.vendor"]
    usable = old & (vendor == "generic-tiff")
    of = lambda tag: F.when(usable & (unit == "centimeter"), F.lit(10000.0) / properties[tag].cast("double")).when(usable, F.raise_error(F.concat(F.lit("unknown resolution unit "), F.coalesce(unit, F.lit("")))).cast("double"))
    return of("tiff.XResolution"), of("tiff.YResolution")


def aspect_ratio(width: Column, height: Column) -> Column:
    return width / height


def thumbnail_size(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """The largest size of the slide's aspect inside the box."""
    ratio = F.least(box_w / width, box_h / height)
    return F.struct(F.greatest(F.lit(1), F.round(width * ratio).cast("int")).alias("w"), F.greatest(F.lit(1), F.round(height * ratio).cast("int")).alias("h"))


def describe(slides: DataFrame) -> DataFrame:
    """slide_id and one line of text about the slide."""
    text = F.format_string("slide(%s, size=%dx%d, mpp=%.4f, levels=%d)", F.col("slide_id").cast("string"), "width", "height", "mpp", F.size("levels"))
    return slides.select("slide_id", text.alias("description"))


def property_rows(slides: DataFrame) -> DataFrame:
    """(slide_id, key, value) of all properties."""
    return slides.select("slide_id", F.explode("properties").alias("key", "value"))
