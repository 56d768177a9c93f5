"""Tile samples: every tile with its coordinates, labels, annotations and pixels, as one row.

The mask filters tiles before annotations or pixels are joined to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import masks as M
from . import raster as R
from . import tiling as T
from .annotations import read_regions, shifted

TILE = ["slide_id", "region_index"]


def tile_samples(
    slides: DataFrame,
    mpp: float | None,
    tile: tuple[int, int],
    overlap: tuple[int, int] = (0, 0),
    mode: str = "overflow",
    order: str = "C",
    rois: str | None = None,
    limit_bounds: bool = True,
    output_tile: tuple[int, int] | None = None,
    crop: bool = False,
    mask: DataFrame | None = None,
    mask_kind: str = "annotations",
    mask_threshold: float | None = 0.0,
    annotations: DataFrame | None = None,
    offset_to_bounds: bool = False,
    labels: DataFrame | None = None,
    tile_table: DataFrame | None = None,
    stored_tile: int = 512,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per kept tile: slide_id, path (if the slides have one), sample_index, region_index, grid_index,
    grid_local_coordinates, ix, iy, coordinates, w, h, mpp, and, where they are given, labels, annotations (array of
    layers clipped to the tile, in its coordinates) and image.

    ``crop`` cuts tiles at the view's edge, otherwise images are padded with zeros. ``transform`` takes and returns
    the table of samples.
    """
    if mask is not None and mask_kind == "annotations" and mask_threshold is not None:
        tiles = M.masked_grid(slides, mask, mask_threshold, mpp, tile, overlap=overlap, mode=mode, order=order, rois=rois, limit_bounds=limit_bounds)
        more = [c for c in ("path", "levels") if c in slides.columns]
        tiles = tiles.withColumns({"local_i": F.floor(F.col("k") / F.col("ny")).cast("int"), "local_j": F.pmod(F.col("k"), F.col("ny"))}).join(slides.select("slide_id", *more).hint("merge"), "slide_id")
        tiles = T.recentred(tiles, output_tile) if output_tile else tiles
    else:
        tiles = T.standard_tiling(slides, mpp, tile, overlap, mode, order, rois, limit_bounds, output_tile)
        tiles = M.masked_tiles(tiles, mask, mask_threshold, mask_kind)
    return region_samples(tiles, slides, crop, annotations, offset_to_bounds, labels, tile_table, stored_tile, transform)


def region_samples(
    regions: DataFrame,
    slides: DataFrame,
    crop: bool = False,
    annotations: DataFrame | None = None,
    offset_to_bounds: bool = False,
    labels: DataFrame | None = None,
    tile_table: DataFrame | None = None,
    stored_tile: int = 512,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The same for any regions: slide_id, region_index, x, y, w, h, scaling, view_w, view_h, view_mpp."""
    tiles = R.boundary(regions, "crop" if crop else "zero")
    out = T.reindexed(tiles)
    extra = [c for c in ("path", "grid_index", "ix", "iy") if c in out.columns]
    local = [F.struct(F.col("local_i").alias("i"), F.col("local_j").alias("j")).alias("grid_local_coordinates")] if "local_i" in out.columns else []
    made = out.select("slide_id", "sample_index", "region_index", *extra, *local, F.struct("x", "y").alias("coordinates"), F.col("out_w").alias("w"), F.col("out_h").alias("h"), F.col("view_mpp").alias("mpp"))
    if labels is not None:
        made = T.with_labels(made, labels)
    if annotations is not None:
        layers = shifted(annotations, slides) if offset_to_bounds else annotations
        seen = read_regions(tiles.select(*TILE, "x", "y", "w", "h", "scaling"), layers)
        one = F.struct("layer_idx", "part", "label", "annotation_type", "color", "z_index", "rings")
        made = made.join(seen.groupBy(*TILE).agg(F.array_sort(F.collect_list(one)).alias("annotations")), TILE, "left")
    if tile_table is not None:
        wanted = tiles.filter("read_w > 0 AND read_h > 0").select(*TILE, F.col("read_x").alias("x"), F.col("read_y").alias("y"), F.col("read_w").alias("w"), F.col("read_h").alias("h"), "scaling", "levels")
        got = R.read_regions(wanted, tile_table, stored_tile).select(*TILE, F.struct(F.col("width"), F.col("height"), F.col("bands"), F.col("data")).alias("_i"))
        place = tiles.select(*TILE, "paste_x", "paste_y", "out_w", "out_h")
        made = made.join(got.join(place, TILE).select(*TILE, R.pasted(F.col("_i"), *(F.col(c) for c in ("paste_x", "paste_y", "out_w", "out_h"))).alias("image")), TILE, "left")
    return made if transform is None else made.transform(transform)
