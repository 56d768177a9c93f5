"""Annotations: what regions see of them, their order, classes and labels.

The spatial join buckets both sides by square cells of a slide and joins on (slide, cell), a hash join that any
number of executors share. A pair is kept in one cell only, that of the upper left corner of both boxes' overlap, so
that no distinct is needed. A crowded slide spreads over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnnotationError
from ..functions import geometry as G
from ..model import RINGS, AnnotationSorting
from . import tiling as T
from .clip import clip_parts
from .dealing import tasks

#: Side of a cell in level-0 pixels.
CELL = 512
#: Tasks among which the annotations of one slide are dealt.
SALTS = 16


def with_bounds(annotations: DataFrame) -> DataFrame:
    """Add ax0, ay0, ax1, ay1."""
    b = G.bounds(F.col("rings"))
    return annotations.withColumn("_b", b).select("*", *(F.col(f"_b.{k}").alias(f"a{k}") for k in ("x0", "y0", "x1", "y1"))).drop("_b")


def with_query_box(regions: DataFrame) -> DataFrame:
    """Add rx0, ry0, rx1, ry1: the region in level-0 pixels. ``regions`` has x, y, w, h and scaling."""
    s = F.col("scaling")
    return regions.withColumns({"rx0": F.col("x") / s, "ry0": F.col("y") / s, "rx1": (F.col("x") + F.col("w")) / s, "ry1": (F.col("y") + F.col("h")) / s})


def _cells(low: str, high: str, cell: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))


def spatial_join(regions: DataFrame, annotations: DataFrame, cell: int = CELL, how: str = "inner") -> DataFrame:
    """Pairs of a region (rx0, ry0, rx1, ry1) and an annotation (ax0, ay0, ax1, ay1) of one slide_id whose closed boxes
    meet. Both sides' other columns are kept and must differ in name."""
    return cell_join(regions, annotations, cell, how).drop("_cx", "_cy")


def cell_join(regions: DataFrame, annotations: DataFrame, cell: int = CELL, how: str = "inner") -> DataFrame:
    """``spatial_join`` with the cell _cx, _cy by which its rows are dealt."""
    left = regions.withColumn("_cx", _cells("rx0", "rx1", cell)).withColumn("_cy", _cells("ry0", "ry1", cell))
    right = annotations.withColumn("_cx", _cells("ax0", "ax1", cell)).withColumn("_cy", _cells("ay0", "ay1", cell))
    by = ["slide_id", "_cx", "_cy"]
    n = tasks(left.select(*by).union(right.select(*by)))
    met = left.repartition(n, *by).join(right.repartition(n, *by).hint("merge"), by)
    meets = (F.col("ax0") <= F.col("rx1")) & (F.col("ax1") >= F.col("rx0")) & (F.col("ay0") <= F.col("ry1")) & (F.col("ay1") >= F.col("ry0"))
    here = (F.floor(F.greatest("rx0", "ax0") / cell) == F.col("_cx")) & (F.floor(F.greatest("ry0", "ay0") / cell) == F.col("_cy"))
    return met.filter(meets & here)


def grid_join(slides: DataFrame, annotations: DataFrame, mpp: float | None, tile: tuple[int, int], overlap: tuple[int, int] = (0, 0), mode: str = "overflow", order: str = "C", rois: str | None = None, limit_bounds: bool = True, salts: int = SALTS) -> DataFrame:
    """The pairs that ``spatial_join`` finds between a standard tiling and annotations with bounds, without making a
    tile that no annotation reaches: the columns and rows under an annotation's box follow from its grid's step.

    Slides meet annotations in one join on slide_id and a salt, so that the annotations of one crowded slide are dealt
    to ``salts`` tasks; a slide is a row or two, so that repeating it costs little. The rest is row by row.
    """
    return salted_join(slides, annotations, mpp, tile, overlap, mode, order, rois, limit_bounds, salts).drop("_salt")


def salted_join(slides: DataFrame, annotations: DataFrame, mpp: float | None, tile: tuple[int, int], overlap: tuple[int, int] = (0, 0), mode: str = "overflow", order: str = "C", rois: str | None = None, limit_bounds: bool = True, salts: int = SALTS) -> DataFrame:
    """``grid_join`` with the salt by which its rows are dealt."""
    found = T.lattice(T.extents(slides, mpp, rois, limit_bounds), tile, overlap, mode).withColumn("_start", T.first_region(tile, overlap, mode, rois))
    keep = ["slide_id", "grid_index", "scaling", "view_mpp", "view_w", "view_h", "off_x", "off_y", "nx", "ny", "step_x", "step_y", "_start"]
    dealt = annotations.withColumn("_salt", F.pmod(F.xxhash64("ax0", "ay0", "ax1", "ay1"), F.lit(salts)).cast("int"))
    by = ["slide_id", "_salt"]
    n = tasks(annotations)
    every = found.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    met = every.repartition(n, *by).join(dealt.repartition(n, *by).hint("merge"), by)
    for axis, n, size in (("x", "nx", tile[0]), ("y", "ny", tile[1])):
        low, high = (F.col(f"a{axis}{k}") * F.col("scaling") - F.col(f"off_{axis}") for k in (0, 1))
        first = F.greatest(F.lit(0), F.ceil((low - size) / F.col(f"step_{axis}")).cast("int"))
        last = F.least(F.col(n) - 1, F.floor(high / F.col(f"step_{axis}")).cast("int"))
        met = met.withColumns({"_a": first, "_z": last}).filter("_a <= _z").withColumn(f"i{axis}", F.explode(F.sequence("_a", "_z")))
    met = T.placed(met.drop("_a", "_z").withColumn("k", T.number(order)), tile).withColumn("region_index", F.col("_start") + F.col("k"))
    made = with_query_box(met)
    # the arithmetic of steps may round: the boxes decide
    meets = (F.col("ax0") <= F.col("rx1")) & (F.col("ax1") >= F.col("rx0")) & (F.col("ay0") <= F.col("ry1")) & (F.col("ay1") >= F.col("ry0"))
    return made.filter(meets).drop("_start", "step_x", "step_y")


def _known(annotations: DataFrame) -> DataFrame:
    """Annotations with bounds and what clipping asks of each of them once."""
    rings = F.col("rings")
    return with_bounds(annotations).withColumns({"_upright": G.is_upright_box(rings), "_flat": G.polygon_area(rings) == 0})


def _seen(pairs: DataFrame, shapes: str) -> DataFrame:
    box = F.struct(F.col("ax0").alias("x0"), F.col("ay0").alias("y0"), F.col("ax1").alias("x1"), F.col("ay1").alias("y1"))
    edges = [F.col(k) for k in ("rx0", "ry0", "rx1", "ry1")]
    point, upright, flat = F.col("annotation_type") == "POINT", F.col("_upright"), F.col("_flat")
    inside = (F.col("ax0") >= edges[0]) & (F.col("ay0") >= edges[1]) & (F.col("ax1") <= edges[2]) & (F.col("ay1") <= edges[3])
    one = F.array(F.col("rings"))
    none = F.array().cast(f"array<{RINGS}>")
    clipped = F.when(G.box_overlap(box, *edges) > 0, F.array(G.clip_box(box, *edges))).otherwise(none)
    parts = F.when(point | flat | inside, one).when(upright, clipped)  # without area before: survives as it is
    if shapes == "any":
        rest = ~(point | flat | inside | upright)
        parts = F.coalesce(parts, clip_parts(F.when(rest, F.col("rings")), *edges))
    seen = pairs.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("part", "_rings")).drop("_parts")
    still = F.col("_upright") | G.is_rectangle(F.col("_rings"))
    kind = F.when((F.col("annotation_type") == "BOX") & ~still, F.lit("POLYGON")).otherwise(F.col("annotation_type"))
    local = G.affine(F.col("_rings"), F.col("scaling"), F.col("x"), F.col("y"))
    return seen.withColumns({"annotation_type": kind, "rings": local}).drop("_rings", "_upright", "_flat", "rx0", "ry0", "rx1", "ry1", "ax0", "ay0", "ax1", "ay1")


def read_regions(regions: DataFrame, annotations: DataFrame, cell: int = CELL, shapes: str = "any") -> DataFrame:
    """What each region sees: annotations clipped to it, in tile-local coordinates, one row per part.

    ``regions``: slide_id, x, y, w, h, scaling and others; ``annotations``: slide_id, layer_idx, label,
    annotation_type, color, z_index, rings. Points on the edge count; areas that only touch it don't. Boxes and
    other upright rectangles stay in the JVM; other polygons go through a vectorised function unless ``shapes`` is
    "boxes". A box that is no rectangle any more becomes a polygon; part numbers tell split polygons apart.
    """
    return _seen(spatial_join(with_query_box(regions), _known(annotations), cell), shapes)


def read_grid(slides: DataFrame, annotations: DataFrame, mpp: float | None, tile: tuple[int, int], shapes: str = "any", **tiling) -> DataFrame:
    """``read_regions`` for all tiles of a standard tiling; see ``grid_join``."""
    return _seen(grid_join(slides, _known(annotations), mpp, tile, **tiling), shapes)


def filter_labels(annotations: DataFrame, labels: str | Sequence[str]) -> DataFrame:
    return annotations.filter(F.col("label").isin(*([labels] if isinstance(labels, str) else labels)))


def has(label: str, annotation_type: str | None = None) -> Column:
    """Whether an annotation is of the class."""
    same = F.col("label") == label
    return same if annotation_type is None else same & (F.col("annotation_type") == annotation_type)


def contains(annotations: DataFrame, label: str, annotation_type: str | None = None) -> bool:
    return not annotations.filter(has(label, annotation_type)).isEmpty()


def available_classes(annotations: DataFrame) -> DataFrame:
    """Distinct classes of each slide with the layer where they first appear."""
    return annotations.groupBy("slide_id", "label", "annotation_type", "color", "z_index").agg(F.min("layer_idx").alias("first_layer"))


def bounding_box(annotations: DataFrame, slides: DataFrame | None = None) -> DataFrame:
    """(slide_id, x, y, w, h) of all annotations; zeros for slides without any, if ``slides`` is given."""
    made = with_bounds(annotations).groupBy("slide_id").agg(F.min("ax0").alias("x"), F.min("ay0").alias("y"), (F.max("ax1") - F.min("ax0")).alias("w"), (F.max("ay1") - F.min("ay0")).alias("h"))
    return made if slides is None else slides.select("slide_id").join(made.hint("merge"), "slide_id", "left").fillna(0.0, ["x", "y", "w", "h"])


def sort_key(sorting: str) -> list[Column]:
    kind = AnnotationSorting(sorting.upper())
    if kind is AnnotationSorting.AREA:
        return [G.polygon_area(F.col("rings")).desc(), F.col("layer_idx")]
    if kind is AnnotationSorting.Z_INDEX:
        return [F.col("z_index").asc_nulls_last(), F.col("layer_idx")]
    return [F.col("layer_idx").desc() if kind is AnnotationSorting.REVERSE else F.col("layer_idx")]


def sort_layers(annotations: DataFrame, sorting: str) -> DataFrame:
    """``layer_idx`` numbered anew for each slide in the order asked for; ties keep their order."""
    order = Window.partitionBy("slide_id").orderBy(*sort_key(sorting))
    return annotations.withColumn("layer_idx", (F.row_number().over(order) - 1).cast("int"))


def points_by_label(annotations: DataFrame, by: Sequence[str] = ("slide_id",)) -> DataFrame:
    """(by, points): a map from label to its points in order of layers."""
    points = annotations.filter(F.col("annotation_type") == "POINT").select(*by, "label", "layer_idx", F.col("rings")[0][0].alias("p"))
    each = points.groupBy(*by, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer_idx", "p"))), lambda s: s["p"]).alias("points"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "points")))).alias("points"))


def rename_labels(annotations: DataFrame, names: dict[str, str], keep_style: bool = False) -> DataFrame:
    """Labels through ``names`` where it has them. Colour and z index are dropped unless ``keep_style``."""
    table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv)) if names else None
    made = annotations if table is None else annotations.withColumn("label", F.coalesce(F.try_element_at(table, F.col("label")), F.col("label")))
    return made if keep_style else made.withColumns({"color": F.lit(None).cast("array<int>"), "z_index": F.lit(None).cast("int")})


def with_index(annotations: DataFrame, index_map: dict[str, int], out: str = "index_value") -> DataFrame:
    """Labels to class indices; a label outside the map is an error when its row is read."""
    if not index_map:
        raise ValueError("empty index map")
    table = F.create_map(*(F.lit(v) for kv in index_map.items() for v in kv))
    missing = F.raise_error(F.concat(F.lit("label isn't in the index map: "), F.coalesce("label", F.lit("null")))).cast("int")
    return annotations.withColumn(out, F.coalesce(F.try_element_at(table, F.col("label")), missing))


def check_labels(annotations: DataFrame, index_map: dict[str, int], roi: str | None = None) -> None:
    """Eager form of the check: ValueError naming the labels that the map lacks."""
    known = [*index_map, *([roi] if roi else [])]
    lacking = [r["label"] for r in annotations.filter((F.col("annotation_type") != "POINT") & ~F.col("label").isin(*known)).select("label").distinct().limit(20).collect()]
    if lacking:
        raise ValueError(f"labels aren't in the index map: {sorted(lacking)}")


def shifted(annotations: DataFrame, slides: DataFrame) -> DataFrame:
    """Annotations given relative to slide bounds, moved to level-0 pixels by the bounds' offset."""
    off = slides.select("slide_id", F.coalesce("offset_x", F.lit(0)).alias("_ox"), F.coalesce("offset_y", F.lit(0)).alias("_oy"))
    moved = annotations.join(off.hint("merge"), "slide_id", "left")
    ox, oy = F.coalesce("_ox", F.lit(0)), F.coalesce("_oy", F.lit(0))
    return moved.withColumn("rings", G.map_points(F.col("rings"), lambda p: G.point(p["x"] + ox, p["y"] + oy))).drop("_ox", "_oy")


def with_z_index(annotations: DataFrame, z_indices: dict[str, int]) -> DataFrame:
    """z index by label, points excepted; a label outside the map is an error when its row is read."""
    if not z_indices:
        raise AnnotationError("empty z index map")
    table = F.create_map(*(F.lit(v) for kv in z_indices.items() for v in kv))
    missing = F.raise_error(F.concat(F.lit("no z index for "), F.col("label"))).cast("int")
    return annotations.withColumn("z_index", F.when(F.col("annotation_type") != "POINT", F.coalesce(F.try_element_at(table, F.col("label")), missing)))
