"""Annotations of a tile to pixels: class masks, class planes, regions of interest and point lists.

A mask is an array, not rows of pixels. Tiles are cut into bands of ``BAND`` rows; an annotation goes to the bands that
its box reaches, bands are filled in numpy from a stream of polygons (edges count, coordinates rounded half to even,
exact in whole numbers), many polygons of a few bands at once, and the last polygon in order of layers wins a pixel. A
task holds a band or ``PIXELS`` of small ones whatever the number of polygons, a large view spreads over its bands, and
bands that nothing reaches are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnnotationError
from ..functions import geometry as G
from .annotations import points_by_label, with_index
from .dealing import dealt

TILE = ("slide_id", "region_index")
#: Rows of a band.
BAND = 128
#: Pixels of bands, and of polygons' windows, that are held at once, and bands whose runs are told at once.
PIXELS = 1 << 20
WINDOWS = 1 << 21
BANDS = 256


def _within(n: np.ndarray) -> np.ndarray:
    """0 to k - 1 for every k of ``n``."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _reach(start: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers k from ``first`` to ``last`` for which start + k * step lies between ``low`` and ``high``."""
    by = np.maximum(np.abs(step), 1)
    near, far = np.where(step < 0, start - high, low - start), np.where(step < 0, start - low, high - start)
    none = (step == 0) & ((start < low) | (start > high))
    return np.where(step == 0, first, np.maximum(first, -(-near // by))), np.where(none, -1, np.where(step == 0, last, np.minimum(last, far // by)))


def windows_covered(xs: np.ndarray, ys: np.ndarray, first: np.ndarray, n: np.ndarray, left: np.ndarray, top: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Which lattice points of each ring's window lie inside or on the ring: ring r has the ``n`` points from ``first`` on,
    with whole coordinates. Windows follow each other, row by row, with a column more at the end of each row, which is
    never covered."""
    stride = width + 1
    start = np.cumsum(stride * height) - stride * height
    size = int((stride * height).sum())
    ring = np.repeat(np.arange(len(n)), n)
    k = _within(n)
    p, q = first[ring] + k, first[ring] + (k + 1) % n[ring]
    up = ys[p] <= ys[q]
    p, q = np.where(up, p, q), np.where(up, q, p)
    x1, y1, dx, dy = xs[p], ys[p], xs[q] - xs[p], ys[q] - ys[p]
    lx, ty, wide, high = left[ring], top[ring], width[ring], height[ring]
    # points right of a crossing change sides; a row has an even number of them, so that sides are straight at its end
    a = np.maximum(y1, ty)
    count = np.maximum(np.minimum(y1 + dy, ty + high) - a, 0)
    e = np.repeat(np.arange(len(p)), count)
    row = a[e] + _within(count)
    after = x1[e] + (row - y1[e]) * dx[e] // dy[e] + 1
    odd = np.zeros(size, np.uint8)
    np.add.at(odd, start[ring][e] + (row - ty[e]) * stride[ring][e] + np.clip(after - lx[e], 0, wide[e]), np.uint8(1))
    inside = np.cumsum(odd, dtype=np.uint8) & 1
    steps = np.gcd(dx, dy)
    sx, sy = dx // np.maximum(steps, 1), dy // np.maximum(steps, 1)
    low, last = _reach(x1, sx, lx, lx + wide - 1, np.zeros_like(steps), steps)
    low, last = _reach(y1, sy, ty, ty + high - 1, low, last)
    count = np.maximum(last - low + 1, 0)
    e = np.repeat(np.arange(len(p)), count)
    k = low[e] + _within(count)
    inside[start[ring][e] + (y1[e] + k * sy[e] - ty[e]) * stride[ring][e] + x1[e] + k * sx[e] - lx[e]] = 1
    return inside.view(bool)


class _Polygons:
    """Polygons of a batch as flat arrays of whole coordinates."""

    def __init__(self, column: pa.ListArray):
        self.outer, self.inner = column.offsets.to_numpy().astype(np.int64), column.values.offsets.to_numpy().astype(np.int64)
        points = column.values.values
        self.x, self.y = (np.rint(points.field(k).to_numpy(zero_copy_only=False)).astype(np.int64) for k in ("x", "y"))

    def ring(self, polygon: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First point and number of points of the polygons' rings ``k``; none where there is no such ring."""
        have = self.outer[polygon + 1] - self.outer[polygon] > k
        r = np.where(have, self.outer[polygon] + k, 0)
        return self.inner[r], np.where(have, self.inner[r + 1] - self.inner[r], 0) if len(self.inner) > 1 else np.zeros_like(r)


def _fill(values: np.ndarray, seen: np.ndarray, polygons: _Polygons, which: np.ndarray, base: np.ndarray, w: np.ndarray, top: np.ndarray, rows: np.ndarray, value: np.ndarray) -> None:
    """Paint the polygons ``which``, one over the other, each into its band: the ``rows`` of ``w`` pixels from ``base`` on."""
    first, n = polygons.ring(which, 0)
    some = n > 0
    which, first, n, base, w, top, rows, value = (c[some] for c in (which, first, n, base, w, top, rows, value))
    if not len(which):
        return
    points = np.repeat(first, n) + _within(n)
    at = np.cumsum(n) - n
    x0, x1 = np.maximum(np.minimum.reduceat(polygons.x[points], at), 0), np.minimum(np.maximum.reduceat(polygons.x[points], at), w - 1)
    y0, y1 = np.maximum(np.minimum.reduceat(polygons.y[points], at), top), np.minimum(np.maximum.reduceat(polygons.y[points], at), top + rows - 1)
    some = (x0 <= x1) & (y0 <= y1)
    which, first, n, base, w, top, value, x0, x1, y0, y1 = (c[some] for c in (which, first, n, base, w, top, value, x0, x1, y0, y1))
    width, height = x1 - x0 + 1, y1 - y0 + 1
    size = (width + 1) * height
    run = np.cumsum(size + n) // WINDOWS
    for part in np.split(np.arange(len(which)), np.flatnonzero(run[1:] != run[:-1]) + 1):
        box = [c[part] for c in (x0, y0, width, height)]
        inside = windows_covered(polygons.x, polygons.y, first[part], n[part], *box)
        start = np.cumsum(size[part]) - size[part]
        for k in range(1, int((polygons.outer[which[part] + 1] - polygons.outer[which[part]]).max(initial=0))):
            hole, m = polygons.ring(which[part], k)
            have = np.flatnonzero(m)
            if len(have):
                cut = windows_covered(polygons.x, polygons.y, hole[have], m[have], *(c[have] for c in box))
                inside[np.repeat(start[have], size[part][have]) + _within(size[part][have])] &= ~cut
        # where each row of a window lies in its band
        line = np.repeat(np.arange(len(part)), height[part])
        y = _within(height[part])
        place = base[part][line] + (y0[part][line] - top[part][line] + y) * w[part][line] + x0[part][line]
        shift = place - (start[line] + y * (width[part][line] + 1))
        on = np.flatnonzero(inside)
        to = on + np.repeat(shift, width[part][line] + 1)[on]
        values[to] = np.repeat(value[part], size[part])[on]  # of equal places the last counts
        seen[to] = True


def _painted(batches, n: int, band: int):
    """(key columns, w, rows, offsets, values, seen) of runs of whole bands, whose pixels follow each other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in range(n + 1):
            c = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, batch.num_rows])
        keys = [batch.column(k).take(pa.array(first)) for k in range(n + 1)]
        w, rows, value, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("w", "rows", "value", "band"))
        same = held is not None and all(a[0].as_py() == b[0].as_py() for a, b in zip(held[0], keys, strict=True))
        if held is not None and not same:
            yield held
            held = None
        polygons = _Polygons(batch.column("rings"))
        area = w[first] * rows[first]
        g = 0
        while g < len(first):
            z = g + max(1, int(np.searchsorted(np.cumsum(area[g:]), PIXELS, "right")))
            offsets = np.r_[0, np.cumsum(area[g:z])]
            values, seen = np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1], bool)
            if g == 0 and held is not None:
                values[: area[0]], seen[: area[0]] = held[4], held[5]
            which = np.arange(first[g], first[g] + count[g:z].sum())
            _fill(values, seen, polygons, which, np.repeat(offsets[:-1], count[g:z]), w[which], number[which] * band, rows[which], value[which])
            whole = lambda a, b: ([c.slice(g + a, b - a) for c in keys], w[first[g + a : g + b]], rows[first[g + a : g + b]], offsets[a : b + 1] - offsets[a], values[offsets[a] : offsets[b]], seen[offsets[a] : offsets[b]])  # noqa: B023, E731
            if z < len(first):
                yield whole(0, z - g)
            else:  # the last band may go on in the next batch
                if z - g > 1:
                    yield whole(0, z - g - 1)
                held = whole(z - g - 1, z - g)
            g = z
    if held is not None:
        yield held


def paint(shapes: DataFrame, by: tuple[str, ...], band: int = BAND) -> DataFrame:
    """(by, band, w, rows, at, n, value): for every band that one of ``shapes`` (by, layer_idx, value, w, h, rings) covers
    a pixel of, the value of the last over each pixel, as runs inside of rows: packed 32-bit integers tell their places in
    the row-major band, their lengths and their values."""
    b = F.col("_b")
    first, last = F.greatest(F.lit(0), F.floor(b["y0"])), F.least(F.col("h") - 1, F.ceil(b["y1"]))
    reached = shapes.withColumn("_b", G.bounds(F.col("rings"))).withColumns({"_a": F.floor(first / band).cast("int"), "_z": F.floor(last / band).cast("int"), "_x0": b["x0"], "_x1": b["x1"]})
    # half a pixel more, as coordinates are rounded
    reached = reached.filter((first <= last) & (F.col("_x0") < F.col("w")) & (F.col("_x1") >= -0.5))
    cut = reached.withColumn("band", F.explode(F.sequence("_a", "_z"))).select(*by, "band", "w", F.least(F.lit(band), F.col("h") - F.col("band") * band).alias("rows"), "layer_idx", F.col("value").cast("int").alias("value"), "rings")
    group = [*by, "band"]
    sorted_ = dealt(cut, *group).sortWithinPartitions(*group, "layer_idx")
    shape = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in by) + ", band int, w int, rows int, at binary, n binary, value binary"
    n = len(by)

    def run(batches):
        for keys, w, rows, offsets, values, seen in _painted(batches, n, band):
            on = np.flatnonzero(seen)
            if not len(on):
                continue
            v = values[on]
            of = np.repeat(np.arange(len(w)), np.diff(np.searchsorted(on, offsets)))
            local = on - offsets[of]
            new = np.r_[True, (on[1:] != on[:-1] + 1) | (v[1:] != v[:-1])] | (local % w[of] == 0)
            start = np.flatnonzero(new)
            length = np.diff(np.r_[start, len(on)])
            packed = [x.astype(np.int32) for x in (local[start], length, v[start])]
            ends = np.searchsorted(of[start], np.arange(len(w) + 1))
            some = np.flatnonzero(np.diff(ends))
            cols = [pa.array([x[ends[g] : ends[g + 1]].tobytes() for g in some.tolist()], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in keys), pa.array(w[some].astype(np.int32)), pa.array(rows[some].astype(np.int32)), *cols], names=[*group, "w", "rows", "at", "n", "value"])

    return sorted_.mapInArrow(run, shape)


def _shapes(annotations: DataFrame, by: tuple[str, ...], size: tuple[int, int] | None) -> DataFrame:
    w, h = (F.lit(size[0]), F.lit(size[1])) if size else (F.col("w"), F.col("h"))
    return annotations.filter(F.col("annotation_type") != "POINT").select(*by, "layer_idx", "label", w.cast("int").alias("w"), h.cast("int").alias("h"), "rings")


def class_mask(annotations: DataFrame, index_map: dict[str, int], by: tuple[str, ...] = TILE, size: tuple[int, int] | None = None, roi: str | None = None) -> DataFrame:
    """Bands of the class of the last polygon over each covered pixel.

    ``size``: tile width and height, if all are alike; otherwise columns w and h are read."""
    shapes = annotations if roi is None else annotations.filter(F.col("label") != roi)
    return paint(with_index(_shapes(shapes, by, size), index_map).withColumnRenamed("index_value", "value"), by)


def class_planes(annotations: DataFrame, index_map: dict[str, int], by: tuple[str, ...] = TILE, size: tuple[int, int] | None = None, roi: str | None = None) -> DataFrame:
    """Bands by plane: 1 in the plane of every class over a covered pixel."""
    shapes = annotations if roi is None else annotations.filter(F.col("label") != roi)
    made = with_index(_shapes(shapes, by, size), index_map).withColumnRenamed("index_value", "plane").withColumn("value", F.lit(1))
    return paint(made, (*by, "plane"))


def roi_mask(annotations: DataFrame, roi: str, by: tuple[str, ...] = TILE, size: tuple[int, int] | None = None) -> DataFrame:
    """Bands of 1 inside the shells of the regions of interest; holes don't count."""
    shells = annotations.filter(F.col("label") == roi).withColumn("rings", F.slice("rings", 1, 1))
    return paint(_shapes(shells, by, size).withColumn("value", F.lit(1)), by)


def _unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The packed numbers of all rows, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.int32, int(ends[-1] - ends[0]) // 4, int(ends[0])), np.diff(ends) // 4


def runs(bands: DataFrame, by: tuple[str, ...] = TILE, band: int = BAND) -> DataFrame:
    """(by, py, x0, x1, value): a mask's covered pixels as runs of equal values, ends included."""
    keep = [c for c in bands.columns if c not in ("band", "w", "rows", "at", "n", "value")]
    shape = ", ".join(f"`{c}` {bands.schema[c].dataType.simpleString()}" for c in keep) + ", py int, x0 int, x1 int, value int"

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, BANDS):
                batch = whole.slice(k, BANDS)
                (at, count), (n, _), (v, _) = (_unpacked(batch.column(c)) for c in ("at", "n", "value"))
                of = np.repeat(np.arange(batch.num_rows), count)
                w, top = (batch.column(c).to_numpy().astype(np.int64)[of] for c in ("w", "band"))
                x = at % w
                same = [batch.column(c).take(pa.array(of)) for c in keep]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c.astype(np.int32)) for c in (at // w + top * band, x, x + n - 1, v))], names=[*keep, "py", "x0", "x1", "value"])

    return bands.mapInArrow(run, shape)


def dense(bands: DataFrame, tiles: DataFrame, by: tuple[str, ...] = TILE, default: int = 0, out: str = "mask", size: tuple[int, int] | None = None, band: int = BAND, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, keep, mask): rows of pixels (array of arrays, rows by columns) for every tile, ``default`` elsewhere, with the
    columns ``keep`` of ``tiles``: masks are large, so that joining to tiles beforehand is better."""
    w, h = (F.lit(size[0]), F.lit(size[1])) if size else (F.col("w"), F.col("h"))
    packed = dealt(bands.select(*by, F.struct("band", "at", "n", "value").alias("_s")), *by)
    held = packed.groupBy(*by).agg(F.collect_list("_s").alias("_b"))  # as many as the tile has bands
    met = tiles.select(*by, *keep, w.cast("int").alias("_w"), h.cast("int").alias("_h")).join(held.hint("merge"), list(by), "left")
    shape = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in (*by, *keep)) + f", `{out}` array<array<int>>"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                wide, high = batch.column("_w")[i].as_py(), batch.column("_h")[i].as_py()
                made = np.full(wide * high, default, np.int32)
                for b in batch.column("_b")[i].values or ():
                    at, n, v = (np.frombuffer(b[k].as_buffer(), np.int32) for k in ("at", "n", "value"))
                    made[np.repeat(at + b["band"].as_py() * band * wide, n) + _within(n)] = np.repeat(v, n)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(high + 1, dtype=np.int32) * wide), pa.array(made))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (*by, *keep)), pa.ListArray.from_arrays(pa.array([0, high], pa.int32()), rows)], names=[*by, *keep, out])

    return met.mapInArrow(run, shape)


def to_masks(annotations: DataFrame, tiles: DataFrame, index_map: dict[str, int], roi: str | None = None, default: int = 0, multiclass: bool = False, by: tuple[str, ...] = TILE, size: tuple[int, int] | None = None) -> DataFrame:
    """Per tile: points (map by label), mask (rows of classes; planes of rows if ``multiclass``) and, with ``roi``, roi.

    A tile without its region of interest is an error when it is read.
    """
    points = points_by_label(annotations, by)
    if multiclass:
        planes = F.explode(F.sequence(F.lit(0), F.lit(max(index_map.values())))).alias("plane")
        every = dense(class_planes(annotations, index_map, by, size, roi), tiles.select("*", planes), (*by, "plane"), 0, "_p", size)
        made = every.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("plane", "_p"))), lambda p: p["_p"]).alias("mask"))  # as many as classes
    else:
        with_points = tiles.join(points.hint("merge"), list(by), "left")
        made = dense(class_mask(annotations, index_map, by, size, roi), with_points, by, default, "mask", size, keep=("points",))
    out = made.join(points.hint("merge"), list(by), "left") if multiclass else made.select(*by, "mask", "points")
    if roi is None:
        return out
    inside = roi_mask(annotations, roi, by, size)
    out = out.join(dense(inside, tiles, by, 0, "roi", size).hint("merge"), list(by))
    lacking: Column = F.raise_error(F.lit(f"no region of interest {roi!r} in a tile")).cast("array<array<int>>")
    return out.withColumn("roi", F.when(F.exists("roi", lambda r: F.array_contains(r, 1)), F.col("roi")).otherwise(lacking))


def require_roi(annotations: DataFrame, tiles: DataFrame, roi: str, by: tuple[str, ...] = TILE) -> None:
    """Eager form of the check: AnnotationError if some tile lacks the region of interest."""
    if not tiles.join(annotations.filter(F.col("label") == roi), list(by), "left_anti").isEmpty():
        raise AnnotationError(f"tiles without a region of interest {roi!r}")
