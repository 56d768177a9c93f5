"""Tile grids as rows.

A grid is never materialised as axes: each tile's number is expanded from its extent's row and turned into column
and row by integer arithmetic, so that generation is one narrow step without a join or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slide import scaled, scaling_of
from ..model import GridOrder, TilingMode
from .dealing import dealt


def check_tiling(size: Sequence[float], tile: Sequence[float], overlap: Sequence[float]) -> None:
    if not len(size) == len(tile) == len(overlap):
        raise ValueError("size, tile and overlap differ in dimensions")
    if any(s <= 0 for s in size):
        raise ValueError("size must be positive")
    if any(t <= 0 for t in tile):
        raise ValueError("tile must be positive")


def stride(size: Column, tile: Column, overlap: Column) -> Column:
    """Tile size less the overlap, which counts modulo the smaller of tile and size."""
    return tile - F.pmod(overlap, F.least(tile, size))


def axis_count(size: Column, tile: Column, overlap: Column, mode: str = "skip") -> Column:
    """Tiles along an axis: whole ones only (skip), or as many as cover it (overflow)."""
    whole = (size - tile) / stride(size, tile, overlap) + 1
    n = F.floor(whole) if TilingMode(mode) is TilingMode.skip else F.ceil(whole)
    checked = F.when((size <= 0) | (tile <= 0), F.raise_error(F.lit("size and tile must be positive")).cast("long")).otherwise(n)
    return F.greatest(F.lit(0), checked).cast("int")


def axis_coordinates(size: Column, tile: Column, overlap: Column, mode: str = "skip", offset: Column | float = 0.0) -> Column:
    """Array of tile starts along an axis."""
    n, step = axis_count(size, tile, overlap, mode), stride(size, tile, overlap)
    start = offset if isinstance(offset, Column) else F.lit(float(offset))
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), 1, n), lambda i: i * step + start)


def indexed_mesh(df: DataFrame, axes: Sequence[str], out: Sequence[str]) -> DataFrame:
    """All combinations of the array columns ``axes``: for each an index column and a value column ``out``."""
    for axis, name in zip(axes, out, strict=True):
        df = df.select("*", F.posexplode(axis).alias(f"{name}_index", name))
    return df


def lattice(extents: DataFrame, tile: tuple[float, float], overlap: tuple[float, float] = (0, 0), mode: str = "skip") -> DataFrame:
    """Each extent that holds a tile with its columns and rows nx, ny and the steps step_x, step_y between tiles."""
    check_tiling((1, 1), tile, overlap)
    tw, th, ow, oh = (F.lit(float(v)) for v in (*tile, *overlap))
    wide, high = F.col("size_w").cast("double"), F.col("size_h").cast("double")
    made = extents.withColumns({"nx": axis_count(wide, tw, ow, mode), "ny": axis_count(high, th, oh, mode), "step_x": stride(wide, tw, ow), "step_y": stride(high, th, oh)})
    return made.filter((F.col("nx") > 0) & (F.col("ny") > 0))


def placed(tiles: DataFrame, tile: tuple[float, float]) -> DataFrame:
    """Add x, y, w and h of tiles with ix and iy."""
    at = {"x": F.col("ix") * F.col("step_x") + F.col("off_x"), "y": F.col("iy") * F.col("step_y") + F.col("off_y")}
    return tiles.withColumns({**at, "w": F.lit(int(tile[0])), "h": F.lit(int(tile[1]))})


def number(order: str) -> Column:
    """A tile's number in its grid, from ix and iy."""
    c = F.col("iy") * F.col("nx") + F.col("ix") if GridOrder(order) is GridOrder.C else F.col("ix") * F.col("ny") + F.col("iy")
    return c.cast("int")


def grid(extents: DataFrame, tile: tuple[float, float], overlap: tuple[float, float] = (0, 0), mode: str = "skip", order: str = "C") -> DataFrame:
    """Tiles of each extent: ``extents`` has off_x, off_y, size_w, size_h; adds k, ix, iy, nx, ny, x, y, w and h.

    Order C numbers along x first, F along y first.
    """
    made = lattice(extents, tile, overlap, mode).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)))
    by = "nx" if GridOrder(order) is GridOrder.C else "ny"
    first, second = F.pmod(F.col("k"), F.col(by)), F.floor(F.col("k") / F.col(by)).cast("int")
    ix, iy = (first, second) if by == "nx" else (second, first)
    return placed(made.withColumns({"ix": ix, "iy": iy}), tile).drop("step_x", "step_y")


def parse_rois(rois: Column, scaling: Column, width: Column | None = None, height: Column | None = None, strict: bool = False) -> Column:
    """Regions of interest in view pixels: starts rounded up, sizes down. ``rois``: array of struct(x, y, w, h).

    ``strict`` raises where one leaves the slide.
    """

    def one(r: Column) -> Column:
        made = F.struct(F.ceil(r["x"] * scaling).cast("int").alias("x"), F.ceil(r["y"] * scaling).cast("int").alias("y"), F.floor(r["w"] * scaling).cast("int").alias("w"), F.floor(r["h"] * scaling).cast("int").alias("h"))
        if not strict:
            return made
        bad = (r["x"] < 0) | (r["y"] < 0) | (r["w"] <= 0) | (r["h"] <= 0) | (r["x"] + r["w"] > width) | (r["y"] + r["h"] > height)
        return F.when(bad, F.raise_error(F.lit("region of interest outside the slide")).cast("struct<x:int,y:int,w:int,h:int>")).otherwise(made)

    return F.transform(rois, one)


def extents(slides: DataFrame, mpp: float | None, rois: str | None = None, limit_bounds: bool = True) -> DataFrame:
    """One row for each grid of a slide: its regions of interest (array column ``rois``), else its bounds, else all of
    it; grid_index counts them."""
    s = scaling_of(F.col("mpp"), F.lit(mpp).cast("double"))
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), scaled(F.col("width"), s).alias("w"), scaled(F.col("height"), s).alias("h"))
    if rois is not None:
        found = parse_rois(F.col(rois), s)
    elif limit_bounds and "offset_x" in slides.columns:
        bound = lambda c, d: scaled(F.coalesce(F.col(c), d), s)
        found = F.array(F.struct(bound("offset_x", F.lit(0)).alias("x"), bound("offset_y", F.lit(0)).alias("y"), bound("bounds_w", F.col("width")).alias("w"), bound("bounds_h", F.col("height")).alias("h")))
    else:
        found = F.array(whole)
    rows = slides.withColumns({"scaling": s, "view_mpp": F.col("mpp") / s, "view_w": scaled(F.col("width"), s), "view_h": scaled(F.col("height"), s)})
    rows = rows.select("*", F.posexplode(found).alias("grid_index", "_e"))
    return rows.withColumns({"off_x": F.col("_e.x"), "off_y": F.col("_e.y"), "size_w": F.col("_e.w"), "size_h": F.col("_e.h")}).drop("_e")


def first_region(tile: tuple[int, int], overlap: tuple[int, int], mode: str, rois: str | None) -> Column:
    """Tiles of the slide's grids before this one: their number follows from their extents, no shuffle is needed."""
    if rois is None:
        return F.lit(0).cast("long")
    tw, th, ow, oh = (F.lit(float(v)) for v in (*tile, *overlap))
    sizes = F.transform(parse_rois(F.col(rois), F.col("scaling")), lambda r: (axis_count(r["w"].cast("double"), tw, ow, mode) * axis_count(r["h"].cast("double"), th, oh, mode)).cast("long"))
    return F.aggregate(F.slice(sizes, 1, F.col("grid_index")), F.lit(0).cast("long"), lambda a, v: a + v)


def standard_tiling(
    slides: DataFrame,
    mpp: float | None,
    tile: tuple[int, int],
    overlap: tuple[int, int] = (0, 0),
    mode: str = "overflow",
    order: str = "C",
    rois: str | None = None,
    limit_bounds: bool = True,
    output_tile: tuple[int, int] | None = None,
) -> DataFrame:
    """All tiles of all slides with ``region_index`` (dense over a slide's grids), the number in their grid, both
    readings of the local coordinates, and x, y, w, h in view pixels.

    ``local_i, local_j`` unravel k along y first whatever the order, as consumers of the sample format expect;
    ``ix, iy`` are the true column and row.
    """
    tiles = grid(extents(slides, mpp, rois, limit_bounds), tile, overlap, mode, order)
    start = first_region(tile, overlap, mode, rois)
    tiles = tiles.withColumns({"region_index": start + F.col("k"), "local_i": F.floor(F.col("k") / F.col("ny")).cast("int"), "local_j": F.pmod(F.col("k"), F.col("ny"))})
    return recentred(tiles, output_tile) if output_tile else tiles


def recentred(tiles: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Tiles of another size around the same centres."""
    w, h = size
    return tiles.withColumns({"x": F.col("x") + F.col("w") / 2 - w / 2, "y": F.col("y") + F.col("h") / 2 - h / 2, "w": F.lit(w), "h": F.lit(h)})


def concat(parts: Sequence[DataFrame], ordinal: str = "ordinal") -> DataFrame:
    """One sequence after the other: ``ordinal`` (dense from 0 in each part) gains the lengths of the parts before.

    ``dataset`` is the part's number. No parts: AssertionError.
    """
    assert parts, "nothing to concatenate"
    out = None
    for k, part in enumerate(parts):
        own = part.withColumns({"dataset": F.lit(k), "local": F.col(ordinal).cast("long")})
        out = own if out is None else out.unionByName(own)
    lengths = out.groupBy("dataset").agg(F.count("*").alias("_n"))  # a row for each part
    before = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("dataset", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return out.join(F.broadcast(starts), "dataset").withColumn(ordinal, F.col("local") + F.col("_start")).select(*out.columns)


#: Ranges into which rows are cut for a sum over all of them.
RANGES = 200


def offsets(sizes: DataFrame, size: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``start``: the sum of ``size`` over the rows before, within ``by``.

    Without ``by`` the rows are cut into ranges at the values of a sample: sums run inside of ranges, and the sums of
    whole ranges before (a row for each) are added."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return sizes.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    drawn = sizes.select(order).filter(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order), order).limit(RANGES - 1)
    bounds = [r[0] for r in drawn.collect()]
    cut = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = sizes.withColumn("_range", cut)
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_t")).select("_range", F.coalesce(F.sum("_t").over(first), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    made = ranged.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(F.broadcast(totals), "_range")  # RANGES rows at most
    return made.withColumn("start", (F.col("_inside") + F.col("_before")).cast("long")).select(*sizes.columns, "start")


def locate(index: Column, starts: Sequence[int]) -> Column:
    """The part that holds a global index, by its part's start; negative indices count from the end at the caller."""
    return (F.size(F.filter(F.array(*(F.lit(int(s)).cast("long") for s in starts)), lambda s: s <= index)) - 1).cast("int")


def reindexed(kept: DataFrame, by: str = "slide_id", order: str = "region_index", out: str = "sample_index") -> DataFrame:
    """Dense numbers of what a filter left, in order, for each slide."""
    return dealt(kept, by).withColumn(out, (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("long"))


def sliced(df: DataFrame, start: int | None, stop: int | None, ordinal: str = "ordinal", total: int | None = None) -> DataFrame:
    """Rows of a slice of the ordinal; negative bounds need the total."""
    fix = lambda v, d: d if v is None else v + total if v < 0 else v
    if total is None and any(v is not None and v < 0 for v in (start, stop)):
        total = df.count()
    low, high = fix(start, 0), fix(stop, None)
    out = df.filter(F.col(ordinal) >= low)
    return out if high is None else out.filter(F.col(ordinal) < high)


def item(df: DataFrame, index: int, total: int, ordinal: str = "ordinal") -> DataFrame:
    """The row at an index; negative ones count from the end. Out of range: ValueError."""
    if not -total <= index < total:
        raise ValueError("index out of range")
    return df.filter(F.col(ordinal) == index % total)


def with_labels(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach a slide's labels (slide_id, name, value) to each of its tiles as a map; null without labels."""
    each = labels.groupBy("slide_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", F.col("value").cast("string"))))).alias("labels"))
    return tiles.join(each.hint("merge"), "slide_id", "left")
