"""Tiles kept by how much foreground they hold.

A threshold of None keeps every tile and plans nothing. Annotation and slide masks keep what exceeds the threshold,
or, at exactly 1, what is wholly covered; raster masks only what exceeds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TilewrightError
from ..functions import geometry as G
from . import tiling as T
from .annotations import CELL, cell_join, salted_join, with_bounds, with_query_box
from .dealing import dealt


#: Side of a mask slide's blocks.
BLOCK = 512


def _passes(fraction: Column, threshold: float) -> Column:
    return (fraction > threshold) | (F.lit(threshold == 1.0) & (fraction == 1.0))


def _shapes(annotations: DataFrame) -> DataFrame:
    areas = annotations.filter(F.col("annotation_type") != "POINT").select("slide_id", "rings")
    return with_bounds(areas).withColumn("_upright", G.is_upright_box(F.col("rings")))


def _share() -> Column:
    """The part of a tile that an annotation covers, in view pixels."""
    box = F.struct(F.col("ax0").alias("x0"), F.col("ay0").alias("y0"), F.col("ax1").alias("x1"), F.col("ay1").alias("y1"))
    edges = [F.col(k) for k in ("rx0", "ry0", "rx1", "ry1")]
    part = F.when(F.col("_upright"), G.box_overlap(box, *edges)).otherwise(G.clipped_area(F.col("rings"), *edges))
    return part * F.col("scaling") * F.col("scaling") / (F.col("w") * F.col("h"))


def annotated_fraction(tiles: DataFrame, annotations: DataFrame, key: str = "region_index", cell: int = CELL) -> DataFrame:
    """(slide_id, key, fraction) of tiles that polygons reach: summed clipped areas over the tile's, in view pixels;
    where polygons overlap they count twice."""
    slim = with_query_box(tiles.select("slide_id", key, "x", "y", "w", "h", "scaling"))
    each = cell_join(slim, _shapes(annotations), cell).withColumn("_a", _share())
    # summed where the join left them first, so that a tile is a row for each of its cells when it is dealt anew
    part = each.groupBy("slide_id", "_cx", "_cy", key).agg(F.sum("_a").alias("_a"))
    return dealt(part, "slide_id", key).groupBy("slide_id", key).agg(F.sum("_a").alias("fraction"))


def masked_grid(slides: DataFrame, annotations: DataFrame, threshold: float | None, mpp: float | None, tile: tuple[int, int], **tiling) -> DataFrame:
    """``masked_tiles`` of a standard tiling by annotations, made from the annotations' side: only tiles that one
    reaches become rows, and the only shuffles are the join on slide_id and the sum by tile."""
    if threshold is None or threshold < 0:
        return T.standard_tiling(slides, mpp, tile, **tiling)
    pairs = salted_join(slides, _shapes(annotations), mpp, tile, **tiling).withColumn("_a", _share())
    by = ["slide_id", "grid_index", "region_index"]
    same = ["k", "ix", "iy", "nx", "ny", "x", "y", "w", "h", "scaling", "view_mpp", "view_w", "view_h"]  # one value a tile
    part = pairs.groupBy("slide_id", "_salt", "grid_index", "region_index").agg(F.sum("_a").alias("_a"), *(F.first(c).alias(c) for c in same))
    shares = dealt(part, *by).groupBy(*by).agg(F.sum("_a").alias("fraction"), *(F.first(c).alias(c) for c in same))
    return shares.filter(_passes(F.col("fraction"), threshold))


def raster_fraction(tiles: DataFrame, masks: DataFrame, key: str = "region_index") -> DataFrame:
    """(slide_id, key, fraction) by the sum of mask pixels under a tile over its area in mask pixels.

    ``masks``: slide_id, mask_w, mask_h, sums: a summed-area table, row-major (mask_h + 1) x (mask_w + 1). One factor,
    from the longer sides, scales both axes. A tile costs four look-ups whatever the mask's size.
    """
    m = tiles.select("slide_id", key, "x", "y", "w", "h", "view_w", "view_h").join(masks.hint("merge"), "slide_id")
    f = F.greatest("mask_w", "mask_h") / F.greatest("view_w", "view_h")
    low = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(F.col(c) * F.col("_f")).cast("int"), F.col(n)))
    high = lambda c, d, n: F.greatest(F.lit(0), F.least(F.ceil((F.col(c) + F.col(d)) * F.col("_f")).cast("int"), F.col(n)))
    m = m.withColumn("_f", f).withColumns({"_x0": low("x", "mask_w"), "_y0": low("y", "mask_h"), "_x1": high("x", "w", "mask_w"), "_y1": high("y", "h", "mask_h")})
    at = lambda x, y: F.element_at("sums", F.col(y) * (F.col("mask_w") + 1) + F.col(x) + 1)
    total = at("_x1", "_y1") - at("_x0", "_y1") - at("_x1", "_y0") + at("_x0", "_y0")
    area = F.nullif(F.col("w") * F.col("_f") * F.col("h") * F.col("_f"), F.lit(0.0))
    return m.select("slide_id", key, (total / area).alias("fraction"))


def _sums(blocks: DataFrame, keep: list[str], foreground: bool) -> DataFrame:
    """``keep`` and sums: summed-area tables of row-major pixels, of 0 and 1 if ``foreground``; one numpy pass a row."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sums array<long>"

    def run(batches):
        for batch in batches:
            w, h = (batch.column(c).to_pylist() for c in ("mask_w", "mask_h"))
            offsets, values = [0], []
            pixels = batch.column("pixels")
            for i in range(batch.num_rows):
                p = pixels[i].values.fill_null(0).to_numpy(zero_copy_only=False).reshape(h[i], w[i]).astype(np.int64)
                out = np.zeros((h[i] + 1, w[i] + 1), np.int64)
                np.cumsum(np.cumsum(p > 0 if foreground else p, 0, dtype=np.int64), 1, out=out[1:, 1:])
                values.append(out.ravel())
                offsets.append(offsets[-1] + out.size)
            sums = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sums], names=[*keep, "sums"])

    return blocks.mapInArrow(run, shape)


def summed_area(masks: DataFrame) -> DataFrame:
    """Masks (slide_id, mask_w, mask_h, pixels: row-major array of ints) to summed-area tables."""
    return _sums(masks.select("slide_id", "mask_w", "mask_h", "pixels"), ["slide_id", "mask_w", "mask_h"], False)


def slide_fraction(tiles: DataFrame, blocks: DataFrame, key: str = "region_index", side: int = BLOCK) -> DataFrame:
    """(slide_id, key, fraction): the share of a mask slide's pixels with any colour under each tile.

    ``blocks``: slide_id, block_x, block_y, mask_w, mask_h, pixels: the mask slide at the tiles' scaling in squares of
    ``side`` pixels (the last ones smaller), row-major, null or 0 where there is background. A tile meets the few
    blocks under it and costs four look-ups in each, whatever their size.
    """
    spans = {f"_{a}": F.explode(F.sequence(F.floor(F.col(a) / side).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / side).cast("int"))) for a, n in (("x", "w"), ("y", "h"))}
    cells = tiles.select("slide_id", key, "x", "y", "w", "h").withColumn("block_x", spans["_x"]).withColumn("block_y", spans["_y"])
    tables = _sums(blocks.select("slide_id", "block_x", "block_y", "mask_w", "mask_h", "pixels"), ["slide_id", "block_x", "block_y", "mask_w", "mask_h"], True)
    met = cells.join(tables.hint("merge"), ["slide_id", "block_x", "block_y"])
    inside = lambda v, a, n: F.greatest(F.lit(0), F.least(F.ceil(v - F.col(f"block_{a}") * side).cast("int"), F.col(n)))
    met = met.withColumns({"_x0": inside(F.col("x"), "x", "mask_w"), "_y0": inside(F.col("y"), "y", "mask_h"), "_x1": inside(F.col("x") + F.col("w"), "x", "mask_w"), "_y1": inside(F.col("y") + F.col("h"), "y", "mask_h")})
    at = lambda x, y: F.element_at("sums", F.col(y) * (F.col("mask_w") + 1) + F.col(x) + 1)
    total = at("_x1", "_y1") - at("_x0", "_y1") - at("_x1", "_y0") + at("_x0", "_y0")
    part = met.select("slide_id", key, total.alias("_n"), ((F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))).cast("long").alias("_a"))
    return part.groupBy("slide_id", key).agg((F.sum("_n") / F.nullif(F.sum("_a"), F.lit(0))).alias("fraction"))


def masked_tiles(tiles: DataFrame, mask: DataFrame | None, threshold: float | None, kind: str = "annotations", key: str = "region_index") -> DataFrame:
    """Tiles whose foreground passes the threshold. ``kind``: annotations, raster or slide."""
    if threshold is None or mask is None:
        return tiles
    found = {"annotations": annotated_fraction, "raster": raster_fraction, "slide": slide_fraction}.get(kind)
    if found is None:
        raise TilewrightError(f"unknown mask kind: {kind}")
    shares = found(tiles, mask, key=key)
    kept = shares.filter(F.col("fraction") > threshold if kind == "raster" else _passes(F.col("fraction"), threshold))
    if threshold < 0:
        return tiles
    return tiles.join(kept.select("slide_id", key).hint("merge"), ["slide_id", key], "left_semi")
