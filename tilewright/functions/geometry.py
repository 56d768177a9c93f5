"""Geometry as column expressions: rings are arrays of points, polygons arrays of rings (shell, then holes)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RINGS


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_rings(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)))


def opened(ring: Column) -> Column:
    """The ring without a last point equal to its first."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def _turned(ring: Column) -> Column:
    """The ring starting at its second point."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    cross = F.zip_with(ring, _turned(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the shell less that of the holes; 0 for points."""
    each = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.when(F.size(rings) == 0, F.lit(0.0)).otherwise(F.aggregate(F.slice(each, 2, F.greatest(F.size(each), F.lit(1))), F.element_at(each, 1), lambda a, v: a - v))


def bounds(rings: Column) -> Column:
    """struct(x0, y0, x1, y1) over the first ring."""
    xs, ys = rings[0]["x"], rings[0]["y"]
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def map_points(rings: Column, fn: Callable[[Column], Column]) -> Column:
    """Every point through ``fn``, which gives a struct of x and y."""
    return F.transform(rings, lambda r: F.transform(r, fn))


def affine(rings: Column, scaling: Column, x: Column, y: Column) -> Column:
    """Tile-local coordinates: point * scaling - location."""
    return map_points(rings, lambda p: point(p["x"] * scaling - x, p["y"] * scaling - y))


def is_rectangle(rings: Column, tolerance: float = 1e-6) -> Column:
    """One ring of four corners, all right angles (rotated ones count)."""
    ring = opened(rings[0])
    turn = lambda k: F.element_at(ring, F.pmod(k, F.lit(4)) + 1)

    def right(k: Column) -> Column:
        a, b, c = turn(k), turn(k + 1), turn(k + 2)
        return F.abs((b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"])) <= tolerance

    return F.when((F.size(rings) == 1) & (F.size(ring) == 4), F.forall(F.sequence(F.lit(0), F.lit(3)), right) & (F.abs(signed_area(ring)) > 0)).otherwise(False)


def is_upright_box(rings: Column) -> Column:
    """A rectangle whose sides are parallel to the axes."""
    b = bounds(rings)
    corner = lambda p: ((p["x"] == b["x0"]) | (p["x"] == b["x1"])) & ((p["y"] == b["y0"]) | (p["y"] == b["y1"]))
    ring = opened(rings[0])
    return F.coalesce((F.size(rings) == 1) & (F.size(ring) == 4) & F.forall(ring, corner) & (F.abs(signed_area(ring)) == (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])), F.lit(False))


def _cut(ring: Column, axis: str, at: Column, keep_above: bool) -> Column:
    """The ring's part on one side of the line ``axis`` = ``at``; concave parts stay joined along the line."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] >= at) if keep_above else (p[axis] <= at)

    def step(p: Column, q: Column) -> Column:
        along = p[other] + (at - p[axis]) * (q[other] - p[other]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
        met = point(at, along) if axis == "x" else point(along, at)
        return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(met)).when(inside(q), F.array(met, q)).otherwise(F.slice(F.array(q), 1, 0))

    return F.flatten(F.zip_with(ring, _turned(ring), step))


def _side(axis: str, at: Column, above: bool) -> Callable[[Column], Column]:
    return lambda ring: _cut(ring, axis, at, above)


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring inside a box, side after side. The area is right for every ring, the outline for convex ones."""
    out = opened(ring)
    for axis, at, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        out = F.element_at(F.transform(F.array(out), _side(axis, at, above)), 1)
    return out


def clipped_area(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a polygon inside a box, for any shell and holes."""
    return polygon_area(F.transform(rings, lambda r: clip_ring(r, x0, y0, x1, y1)))


def box_overlap(b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of the intersection of upright boxes."""
    return F.greatest(F.lit(0.0), F.least(b["x1"], x1) - F.greatest(b["x0"], x0)) * F.greatest(F.lit(0.0), F.least(b["y1"], y1) - F.greatest(b["y0"], y0))


def clip_box(b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rings of the intersection of upright boxes."""
    a, c = F.greatest(b["x0"], x0), F.greatest(b["y0"], y0)
    return box_rings(a, c, F.least(b["x1"], x1) - a, F.least(b["y1"], y1) - c)


def canonical(rings: Column) -> Column:
    """Rings without a repeated last point, for comparisons."""
    return F.transform(rings, opened)


def same_annotation(a: Column, b: Column) -> Column:
    """Equal geometry, label, type, colour and, but for points, z index."""
    same = canonical(a["rings"]).eqNullSafe(canonical(b["rings"]))
    for k in ("label", "annotation_type", "color"):
        same = same & a[k].eqNullSafe(b[k])
    return same & ((a["annotation_type"] == "POINT") | a["z_index"].eqNullSafe(b["z_index"]))


def wkt(annotation_type: Column, rings: Column) -> Column:
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(opened(r), F.slice(r, 1, 1)), pair), ", "), F.lit(")"))
    area = F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))
    return F.when(annotation_type == "POINT", F.concat(F.lit("POINT ("), pair(rings[0][0]), F.lit(")"))).otherwise(area)


def empty_rings() -> Column:
    return F.array().cast(RINGS)
