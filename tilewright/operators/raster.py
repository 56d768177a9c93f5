"""Pixels: reads at any scaling, boundaries, thumbnails, pyramids and tile tables.

A slide's pixels are a tile table (slide_id, level, tile_row, tile_col, width, height, bands, data) written sorted by
its keys, so that a read prunes to the level and the tiles it needs. A read gathers the tiles under one region's patch
and resamples them in numpy, a pyramid step four tiles of the level below; pixels are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slide import best_level, level_at
from ..model import BoundaryMode

TILE_TABLE = "slide_id string, level int, tile_row int, tile_col int, width int, height int, bands int, data binary"


def check_region(size_w: Column, size_h: Column, x: Column, y: Column, level_w: Column, level_h: Column) -> Column:
    """True; an error for a negative size or a region that leaves the level."""
    bad = (size_w < 0) | (size_h < 0) | (x < 0) | (y < 0) | (x + size_w > level_w) | (y + size_h > level_h)
    return F.when(bad, F.raise_error(F.lit("requested region is outside the level")).cast("boolean")).otherwise(True)


def clip_to_size(value: Column, size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, size.cast("double")))


def boundary(regions: DataFrame, mode: str | None) -> DataFrame:
    """Add read_x, read_y, read_w, read_h (the part inside the view), paste_x, paste_y, out_w and out_h.

    None passes regions as they are; crop gives the smaller image; zero pads it to the size asked for.
    """
    x, y, w, h = (F.col(k) for k in "xywh")
    if mode is None:
        return regions.withColumns({"read_x": x, "read_y": y, "read_w": w, "read_h": h, "paste_x": F.lit(0), "paste_y": F.lit(0), "out_w": w, "out_h": h})
    off_x, off_y = F.greatest(F.lit(0.0), -x), F.greatest(F.lit(0.0), -y)
    inner = lambda at, size, off, view: (clip_to_size(at + size, F.col(view)) - at - off).cast("int")
    made = regions.withColumns({"read_x": x + off_x, "read_y": y + off_y, "read_w": F.greatest(F.lit(0), inner(x, w, off_x, "view_w")), "read_h": F.greatest(F.lit(0), inner(y, h, off_y, "view_h")), "paste_x": F.floor(off_x).cast("int"), "paste_y": F.floor(off_y).cast("int")})
    if BoundaryMode(mode) is BoundaryMode.zero:
        return made.withColumns({"out_w": w, "out_h": h})
    return made.withColumns({"paste_x": F.lit(0), "paste_y": F.lit(0), "out_w": F.col("read_w"), "out_h": F.col("read_h")})


def plan_reads(regions: DataFrame) -> DataFrame:
    """Level and native window of each region (x, y, w, h, scaling, levels): adds level, level_w, level_h, downsample,
    native_scaling, native_x, native_y, native_w, native_h, and the patch with its margin: patch_x, patch_y, patch_w, patch_h."""
    made = regions.withColumn("level", best_level(F.col("levels"), 1 / F.col("scaling")))
    own = level_at(F.col("levels"), F.col("level"))
    made = made.withColumns({"downsample": own["downsample"], "level_w": own["width"], "level_h": own["height"]})
    made = made.withColumn("native_scaling", F.col("scaling") * F.col("downsample"))
    n = F.col("native_scaling")
    made = made.withColumns({"native_x": F.col("x") / n, "native_y": F.col("y") / n, "native_w": F.col("w") / n, "native_h": F.col("h") / n})
    extra = F.when(n > 1, F.lit(3.0)).otherwise(F.ceil(3 / n).cast("double"))
    for a, size, limit in (("x", "w", "level_w"), ("y", "h", "level_h")):
        start = clip_to_size(F.floor(F.col(f"native_{a}") - extra), F.col(limit))
        snapped = F.floor(start * F.col("downsample")) / F.col("downsample")
        end = clip_to_size(F.ceil(F.col(f"native_{a}") + F.col(f"native_{size}") + extra), F.col(limit))
        made = made.withColumns({f"patch_{a}": snapped, f"patch_{size}": F.ceil(end - snapped).cast("int")})
    return made


def _lanczos(size: int, start: float, length: float, out: int, reach: float = 3.0) -> np.ndarray:
    """out x size weights that resample the window [start, start + length) with a Lanczos kernel."""
    step = length / out
    wide = max(step, 1.0)
    centre = start + (np.arange(out) + 0.5) * step
    d = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    k = np.where(np.abs(d) < reach, np.sinc(d) * np.sinc(d / reach), 0.0)
    return k / np.maximum(k.sum(1, keepdims=True), 1e-12)


def _nearest(size: int, start: float, length: float, out: int) -> np.ndarray:
    at = np.clip(np.floor(start + (np.arange(out) + 0.5) * (length / out)).astype(int), 0, size - 1)
    return np.eye(size)[at]


def resize(image: np.ndarray, box: tuple[float, float, float, float], out: tuple[int, int], kind: str = "LANCZOS") -> np.ndarray:
    """rows x cols x bands to out (w, h), from the fractional box (x0, y0, x1, y1)."""
    weights = _lanczos if kind == "LANCZOS" else _nearest
    x0, y0, x1, y1 = box
    across = weights(image.shape[1], x0, x1 - x0, out[0])
    down = weights(image.shape[0], y0, y1 - y0, out[1])
    made = np.einsum("yr,rcb,xc->yxb", down, image.astype(float), across, optimize=True)
    return np.clip(np.round(made), 0, 255).astype(np.uint8)


def tiles_of_regions(planned: DataFrame, tile_table: DataFrame, tile: int) -> DataFrame:
    """Each region with the tiles of its level that its patch overlaps, joined on their keys; a patch without pixels
    meets the tile nearest to it."""
    span = lambda at, size, limit: F.explode(F.sequence(F.floor(F.least(F.col(at), F.col(limit) - 1) / tile).cast("int"), F.floor(F.least(F.col(at) + F.greatest(F.col(size), F.lit(1)) - 1, F.col(limit) - 1) / tile).cast("int")))
    keyed = planned.withColumn("tile_row", span("patch_y", "patch_h", "level_h")).withColumn("tile_col", span("patch_x", "patch_w", "level_w"))
    return keyed.join(tile_table, ["slide_id", "level", "tile_row", "tile_col"])


def _patch(table: pa.Table, x: int, y: int, w: int, h: int, tile: int) -> np.ndarray:
    """The window (x, y, w, h) of a level from its tiles, 0 where there is none."""
    bands = table.column("bands")[0].as_py()
    image = np.zeros((max(h, 1), max(w, 1), bands), np.uint8)
    for row, col, tw, th, data in zip(*(table.column(c).to_pylist() for c in ("tile_row", "tile_col", "width", "height")), table.column("data"), strict=True):
        got = np.frombuffer(data.as_buffer(), np.uint8).reshape(th, tw, bands)
        x0, y0 = col * tile - x, row * tile - y
        a, b = max(0, x0), max(0, y0)
        c, d = min(image.shape[1], x0 + tw), min(image.shape[0], y0 + th)
        if a < c and b < d:
            image[b:d, a:c] = got[b - y0 : d - y0, a - x0 : c - x0]
    return image


def read_regions(regions: DataFrame, tile_table: DataFrame, tile: int, kind: str = "LANCZOS", key: str = "region_index", mode: str | None = None) -> DataFrame:
    """(slide_id, key, width, height, bands, data): every region resampled from its best level.

    ``mode`` None reads regions as they are, the other boundary modes their part inside the view (columns view_w and
    view_h), which zero pads to the size asked for; a region wholly outside gives no pixels when cropped. ``kind``
    LANCZOS resamples with that kernel, NEAREST takes the pixel under each output pixel's centre. A region's group
    holds the tiles under its patch: its size bounds what a task keeps.
    """
    asked = boundary(regions, mode)
    asked = asked.withColumns({"x": F.col("read_x"), "y": F.col("read_y"), "w": F.col("read_w"), "h": F.col("read_h")}) if mode is not None else asked
    planned = plan_reads(asked)
    pasted_ = ["paste_x", "paste_y", "out_w", "out_h"]
    cols = ["slide_id", key, "w", "h", "native_x", "native_y", "native_w", "native_h", "native_scaling", "patch_x", "patch_y", "patch_w", "patch_h", *pasted_, "tile_row", "tile_col", "width", "height", "bands", "data"]
    slim = planned.select("slide_id", key, "level", "level_w", "level_h", "w", "h", *pasted_, *(c for c in cols if c.startswith(("native_", "patch_"))))
    met = tiles_of_regions(slim, tile_table, tile).select(*cols)
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}

    def one(keys, table):
        r = {c: table.column(c)[0].as_py() for c in cols[2 : cols.index("tile_row")]}
        w, h, out_w, out_h = (int(r[c]) for c in ("w", "h", "out_w", "out_h"))
        ox, oy = int(np.floor(r["patch_x"])), int(np.floor(r["patch_y"]))
        image = _patch(table, ox, oy, r["patch_w"], r["patch_h"], tile)
        if w <= 0 or h <= 0:
            made = np.zeros((0, 0, image.shape[2]), np.uint8)
        elif kind == "NEAREST":
            at = lambda start, n, off, size: np.clip(np.floor((start * r["native_scaling"] + np.arange(n) + 0.5) / r["native_scaling"]).astype(int) - off, 0, size - 1)
            made = image[np.ix_(at(r["native_y"], h, oy, image.shape[0]), at(r["native_x"], w, ox, image.shape[1]))]
        else:
            fx, fy = r["native_x"] - r["patch_x"], r["native_y"] - r["patch_y"]
            box = (fx, fy, min(fx + r["native_w"], image.shape[1]), min(fy + r["native_h"], image.shape[0]))
            made = resize(image, box, (w, h), kind)
        if (out_w, out_h) != (w, h):
            canvas = np.zeros((out_h, out_w, image.shape[2]), np.uint8)
            px, py = int(r["paste_x"]), int(r["paste_y"])
            canvas[py : py + h, px : px + w] = made
            made = canvas
        return pa.table({"slide_id": pa.array([keys[0].as_py()], table.schema.field("slide_id").type), key: pa.array([keys[1].as_py()], table.schema.field(key).type), "width": pa.array([made.shape[1]], pa.int32()), "height": pa.array([made.shape[0]], pa.int32()), "bands": pa.array([made.shape[2]], pa.int32()), "data": [made.tobytes()]})

    return met.groupBy("slide_id", key).applyInArrow(one, f"slide_id {kinds['slide_id']}, {key} {kinds[key]}, width int, height int, bands int, data binary")


def bytes_of(data: Column) -> Column:
    """An image's bytes as an array of whole numbers."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("([0-9A-F]{2})"), 1), lambda x: F.conv(x, 16, 10).cast("int"))


def flatten_alpha(image: np.ndarray) -> np.ndarray:
    """RGBA over white."""
    if image.shape[2] != 4:
        return image
    alpha = image[..., 3:].astype(float) / 255
    return np.round(image[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)


def pyramid_levels(width: Column, height: Column, tile_w: Column, tile_h: Column) -> Column:
    """Array of struct(level, width, height): halved, rounding down, until a level is about a tile."""
    n = F.least(F.ceil(F.log2(width / tile_w)), F.ceil(F.log2(height / tile_h))).cast("int")
    two = lambda k: F.pow(F.lit(2.0), k)
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.struct(k.cast("int").alias("level"), F.floor(width / two(k)).cast("int").alias("width"), F.floor(height / two(k)).cast("int").alias("height")))


def downsample(tile_table: DataFrame, tile: int, is_mask: bool = False) -> DataFrame:
    """The next level of a tile table, in tiles of the same size: the mean of 2 x 2 pixels, halves rounding up, or for
    masks the upper left sample. Odd sizes lose their last row or column. A group holds four tiles."""
    keyed = tile_table.withColumns({"_r": F.floor(F.col("tile_row") / 2).cast("int"), "_c": F.floor(F.col("tile_col") / 2).cast("int")})
    kinds = {f.name: f.dataType.simpleString() for f in tile_table.schema}

    def one(keys, table):
        slide, level, row, col = (k.as_py() for k in keys)
        right = max(c * tile + w for c, w in zip(table.column("tile_col").to_pylist(), table.column("width").to_pylist(), strict=True)) - 2 * col * tile
        low = max(r * tile + h for r, h in zip(table.column("tile_row").to_pylist(), table.column("height").to_pylist(), strict=True)) - 2 * row * tile
        image = _patch(table, 2 * col * tile, 2 * row * tile, right, low, tile)[: low // 2 * 2, : right // 2 * 2]
        if is_mask:
            made = image[::2, ::2]
        else:
            made = ((image[::2, ::2].astype(np.uint16) + image[1::2, ::2] + image[::2, 1::2] + image[1::2, 1::2] + 2) // 4).astype(np.uint8)
        fields = {"slide_id": pa.array([slide], table.schema.field("slide_id").type)} | {k: pa.array([v], pa.int32()) for k, v in zip(("level", "tile_row", "tile_col", "width", "height", "bands"), (level + 1, row, col, made.shape[1], made.shape[0], made.shape[2]), strict=True)}
        return pa.table(fields | {"data": [made.tobytes()]})

    shape = f"slide_id {kinds['slide_id']}, level int, tile_row int, tile_col int, width int, height int, bands int, data binary"
    return keyed.groupBy("slide_id", "level", "_r", "_c").applyInArrow(one, shape).filter("width > 0 AND height > 0")


def resolution_tags(mpp_x: Column, mpp_y: Column, level: Column) -> Column:
    """Pixels per centimetre of a level."""
    two = F.pow(F.lit(2.0), level)
    return F.struct((F.lit(1.0) / mpp_x * 10000 / two).alias("x"), (F.lit(1.0) / mpp_y * 10000 / two).alias("y"))


def cut_tiles(image: np.ndarray, tile: tuple[int, int]) -> list[tuple[int, int, np.ndarray]]:
    """(tile_row, tile_col, pixels) in row-major order, the last ones smaller."""
    w, h = tile
    return [(r // h, c // w, image[r : r + h, c : c + w]) for r in range(0, image.shape[0], h) for c in range(0, image.shape[1], w)]


@F.arrow_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("bands", T.IntegerType()), T.StructField("data", T.BinaryType())]))
def _pasted(image: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
    rows = []
    for i, *at in zip(image.to_pylist(), *(c.to_pylist() for c in (x, y, w, h)), strict=True):
        px, py, width, height = (int(v) for v in at)
        if (px, py, width, height) == (0, 0, i["width"], i["height"]):
            rows.append(i)
            continue
        canvas = np.zeros((height, width, i["bands"]), np.uint8)
        canvas[py : py + i["height"], px : px + i["width"]] = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["bands"])
        rows.append({"width": width, "height": height, "bands": i["bands"], "data": canvas.tobytes()})
    return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("bands", pa.int32()), ("data", pa.binary())]))


def pasted(image: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The image on a black canvas of w x h at (x, y)."""
    return _pasted(image, x, y, w, h)
