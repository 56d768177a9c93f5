"""Colours as arrays of three integers, and colour look-up tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_rgb(color: Column) -> Column:
    """``#rrggbb`` (the mark is optional) or ``black`` to [r, g, b]."""
    plain = F.regexp_replace(color, "^#+", "")
    part = lambda k: F.conv(F.substring(plain, k, 2), 16, 10).cast("int")
    return F.when(color == "black", F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(part(1), part(3), part(5)))


def rgb_to_hex(color: Column) -> Column:
    return F.format_string("#%02x%02x%02x", color[0], color[1], color[2])


def parse_rgba(color: Column) -> Column:
    """``rgba(r,g,b,1.0)`` to [r, g, b]; any alpha but 1.0 is an error."""
    parts = F.split(F.regexp_extract(color, r"^rgba\((.*)\)$", 1), r"\s*,\s*")
    bad = F.raise_error(F.concat(F.lit("alpha isn't 1.0: "), color)).cast("array<int>")
    return F.when(F.element_at(parts, 4).cast("double") != 1.0, bad).otherwise(F.transform(F.slice(parts, 1, 3), lambda x: x.cast("int")))


def geojson_color(color: Column) -> Column:
    """An array of three whole numbers, or null."""
    return F.when(F.size(color) == 3, F.transform(color, lambda x: x.cast("int")))


def _looked_up(table: Column):
    return lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0))


def color_lut(colormap: dict[int, tuple[int, int, int]]) -> Column:
    """[red, green, blue], each 256 values of 16 bits (value * 256); indices outside the map are 0."""
    index = F.sequence(F.lit(0), F.lit(255))
    bands = []
    for band in range(3):
        found = {k: v[band] * 256 for k, v in colormap.items()}
        if not found:
            bands.append(F.transform(index, lambda i: F.lit(0)))
            continue
        table = F.create_map(*(F.lit(x) for kv in found.items() for x in kv))
        bands.append(F.transform(index, _looked_up(table)))
    return F.array(*bands)
