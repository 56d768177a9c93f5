"""Slides: readers by name, checks, properties, and the job that resamples one into a new file.

A backend has ``open(path)`` giving size, spacing, levels and properties, ``read_window(path, level, x, y, w, h)``
giving a window of a level as rows x columns x bands, in that level's own pixels, and ``associated_images(path)``.
``tiff`` reads tiled TIFF files here; ``openslide`` and ``vips`` read through those libraries where they are installed
and raise ModuleNotFoundError where they aren't. Register others with ``register``.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Iterable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedSlideError
from ..functions.slide import check_mpp
from ..operators.raster import flatten_alpha, resize
from . import tiff


class Backend(Protocol):
    def open(self, path: str) -> dict: ...

    def read_window(self, path: str, level: int, x: int, y: int, w: int, h: int) -> np.ndarray: ...

    def associated_images(self, path: str) -> dict[str, np.ndarray]: ...


class TiffBackend:
    """Tiled TIFF files."""

    def open(self, path: str) -> dict:
        return tiff.describe(path)

    def read_window(self, path: str, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        with tiff.open_file(path) as f:
            return tiff.read_window(f, tiff.read_pages(f)[level], x, y, w, h)

    def associated_images(self, path: str) -> dict[str, np.ndarray]:
        return {}


class LibraryBackend:
    """A backend through a library that may be missing."""

    module = ""

    def library(self):
        if importlib.util.find_spec(self.module) is None:
            raise ModuleNotFoundError(f"this backend needs {self.module}")
        return importlib.import_module(self.module)


def _bounds(properties: dict[str, str]) -> dict[str, int]:
    names = {"offset_x": "bounds-x", "offset_y": "bounds-y", "bounds_w": "bounds-width", "bounds_h": "bounds-height"}
    return {k: int(properties[f"openslide.{n}"]) for k, n in names.items() if f"openslide.{n}" in properties}


def _levels(sizes: list[tuple[int, int]]) -> list[dict]:
    return [{"level": k, "width": w, "height": h, "downsample": sizes[0][0] / w} for k, (w, h) in enumerate(sizes)]


class OpenSlideBackend(LibraryBackend):
    """Formats of whole-slide scanners; regions come as RGBA."""

    module = "openslide"

    def _slide(self, path: str):
        return self.library().OpenSlide(path)

    def open(self, path: str) -> dict:
        slide = self._slide(path)
        properties = {k: str(v) for k, v in slide.properties.items()}
        mpp = tuple(float(properties[k]) for k in ("openslide.mpp-x", "openslide.mpp-y") if k in properties)
        levels = [{"level": k, "width": w, "height": h, "downsample": float(d)} for k, ((w, h), d) in enumerate(zip(slide.level_dimensions, slide.level_downsamples, strict=True))]
        return {"width": slide.dimensions[0], "height": slide.dimensions[1], "mpp": mpp if len(mpp) == 2 else None, "levels": levels, "properties": properties} | _bounds(properties)

    def read_window(self, path: str, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        slide = self._slide(path)
        down = slide.level_downsamples[level]
        return np.asarray(slide.read_region((int(round(x * down)), int(round(y * down))), level, (w, h)))

    def associated_images(self, path: str) -> dict[str, np.ndarray]:
        return {k: np.asarray(v) for k, v in self._slide(path).associated_images.items()}


class VipsBackend(LibraryBackend):
    """Whatever libvips opens: levels of scanner formats, pages of pyramids, or one image."""

    module = "pyvips"

    def _image(self, path: str, **how):
        return self.library().Image.new_from_file(path, **how)

    def _kind(self, image) -> tuple[str, int]:
        fields = set(image.get_fields())
        if "openslide.level-count" in fields:
            return "level", int(image.get("openslide.level-count"))
        return ("page", int(image.get("n-pages"))) if "n-pages" in fields else ("", 1)

    def _at(self, path: str, level: int):
        kind, _ = self._kind(self._image(path))
        return self._image(path, **{kind: level}) if kind else self._image(path)

    def open(self, path: str) -> dict:
        image = self._image(path)
        _, n = self._kind(image)
        properties = {k: str(image.get(k)) for k in image.get_fields()}
        sizes = [(i.width, i.height) for i in (self._at(path, k) for k in range(n))]
        if "openslide.mpp-x" in properties:
            mpp = float(properties["openslide.mpp-x"]), float(properties["openslide.mpp-y"])
        else:  # resolutions are pixels per millimetre
            mpp = (1000 / image.xres, 1000 / image.yres) if image.xres and image.yres else None
        return {"width": image.width, "height": image.height, "mpp": mpp, "levels": _levels(sizes), "properties": properties} | _bounds(properties)

    def read_window(self, path: str, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        got = self._at(path, level).crop(x, y, w, h)
        return np.asarray(got.numpy()).reshape(h, w, -1)

    def associated_images(self, path: str) -> dict[str, np.ndarray]:
        image = self._image(path)
        if "slide-associated-images" not in image.get_fields():
            return {}
        return {k: np.asarray(self._image(path, associated=k).numpy()) for k in (n.strip() for n in image.get("slide-associated-images").split(",")) if k}


BACKENDS: dict[str, Backend] = {"tiff": TiffBackend(), "openslide": OpenSlideBackend(), "vips": VipsBackend()}


def register(name: str, backend: Backend) -> None:
    BACKENDS[name] = backend


def backend_of(kind: str | Backend) -> Backend:
    if isinstance(kind, str):
        if kind not in BACKENDS:
            raise ValueError(f"unknown backend {kind!r}; known: {sorted(BACKENDS)}")
        return BACKENDS[kind]
    if not hasattr(kind, "open"):
        raise TypeError("a backend is a name or has an open method")
    return kind


@lru_cache(maxsize=32)
def _opened(path: str, kind: str) -> dict:
    return backend_of(kind).open(path)


def open_slide(path: str, backend: str | Backend = "tiff", overwrite_mpp: tuple[float, float] | None = None) -> dict:
    """A checked slide: spacing given or stored, both axes alike within the tolerance."""
    found = _opened(path, backend) if isinstance(backend, str) else backend_of(backend).open(path)
    spacing = overwrite_mpp or found["mpp"]
    if spacing is None:
        raise UnsupportedSlideError(f"the spacing of {path} is unknown")
    mpp = check_mpp(*spacing)
    first = found["levels"][0]["downsample"] or 1.0
    levels = [{**v, "mpp_x": spacing[0] * v["downsample"] / first, "mpp_y": spacing[1] * v["downsample"] / first} for v in found["levels"]]
    return {**found, "mpp": mpp, "levels": levels, "path": path}


#: Where a scanner found tissue; unknown where null.
BOUNDS = ("offset_x", "offset_y", "bounds_w", "bounds_h")


def read_slides(spark: SparkSession, paths: Iterable[str], backend: str | Backend = "tiff", overwrite_mpp: tuple[float, float] | None = None) -> DataFrame:
    """One row for each file. Headers are read on the executors, one file for each row."""
    paths = list(paths)
    names = spark.createDataFrame([(p,) for p in paths], "path string")

    def about(batches):
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                s = open_slide(path, backend, overwrite_mpp)
                rows.append({"slide_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": path, "width": s["width"], "height": s["height"], "mpp": s["mpp"], "levels": s["levels"], "properties": list(s["properties"].items())} | {k: s.get(k) for k in BOUNDS})
            point = pa.struct([("level", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("downsample", pa.float64()), ("mpp_x", pa.float64()), ("mpp_y", pa.float64())])
            schema = pa.schema([("slide_id", pa.string()), ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mpp", pa.float64()), ("levels", pa.list_(point)), ("properties", pa.map_(pa.string(), pa.string())), *((k, pa.int32()) for k in BOUNDS)])
            yield pa.RecordBatch.from_pylist(rows, schema)

    level = "array<struct<level:int,width:int,height:int,downsample:double,mpp_x:double,mpp_y:double>>"
    return names.repartition(max(1, min(len(paths), 200))).mapInArrow(about, f"slide_id string, path string, width int, height int, mpp double, levels {level}, properties map<string,string>, " + ", ".join(f"{k} int" for k in BOUNDS))


def read_region(path: str, location: tuple[float, float], scaling: float, size: tuple[int, int], kind: str = "LANCZOS", backend: str | Backend = "tiff", overwrite_mpp: tuple[float, float] | None = None, whole_pixels: bool = False) -> np.ndarray:
    """One region of one file, resampled from its best level; a region that leaves the view is an error.

    ``whole_pixels`` cuts the level's region at whole pixels before it is resized; otherwise it is resized from its
    exact place between pixels."""
    s = open_slide(path, backend, overwrite_mpp)
    w, h = int(s["width"] * scaling), int(s["height"] * scaling)
    if min(size) < 0 or min(location) < 0 or location[0] + size[0] > w or location[1] + size[1] > h:
        raise ValueError("requested region is outside the level")
    fit = [v for v in s["levels"] if v["downsample"] <= 1 / scaling + 1e-9]
    level = fit[-1] if fit else s["levels"][0]
    n = scaling * level["downsample"]
    at, need = (location[0] / n, location[1] / n), (size[0] / n, size[1] / n)
    extra = 3 if n > 1 else int(np.ceil(3 / n))
    dims = (level["width"], level["height"])
    a = [int(min(max(np.floor(p - extra), 0), d)) for p, d in zip(at, dims, strict=True)]
    z = [int(min(max(np.ceil(p + q + extra), 0), d)) for p, q, d in zip(at, need, dims, strict=True)]
    patch = backend_of(backend).read_window(path, level["level"], a[0], a[1], z[0] - a[0], z[1] - a[1])
    low = (at[0] - a[0], at[1] - a[1])
    if whole_pixels:
        x0, y0 = int(np.floor(low[0])), int(np.floor(low[1]))
        x1, y1 = max(x0 + 1, int(np.round(low[0] + need[0]))), max(y0 + 1, int(np.round(low[1] + need[1])))
        patch = patch[y0:y1, x0:x1]
        return resize(patch, (0, 0, patch.shape[1], patch.shape[0]), size, kind)
    box = (*low, min(low[0] + need[0], patch.shape[1]), min(low[1] + need[1], patch.shape[0]))
    return resize(patch, box, size, kind)


_IMAGE = "width int, height int, bands int, data binary"


def _images(df: DataFrame, keep: list[str], image) -> DataFrame:
    """``keep``, slide_id and the image that ``image(row)`` gives, for every row of ``df`` with a path, one at a time."""
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + (", " if keep else "") + "slide_id string, " + _IMAGE

    def run(batches):
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                got = image(row)
                slide = row["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
                made = [slide, got.shape[1], got.shape[0], got.shape[2], got.tobytes()]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in keep), *(pa.array([v], k) for v, k in zip(made, kinds, strict=True))], names=[*keep, "slide_id", "width", "height", "bands", "data"])

    return df.mapInArrow(run, shape)


def read_file_regions(regions: DataFrame, backend: str | Backend = "tiff", kind: str = "LANCZOS") -> DataFrame:
    """``read_region`` for rows of path, region_index, x, y, w, h and scaling: (region_index, slide_id, image)."""
    return _images(regions, ["region_index"], lambda r: read_region(r["path"], (r["x"], r["y"]), r["scaling"], (r["w"], r["h"]), kind, backend))


def thumbnail(path: str, box: tuple[int, int] = (512, 512), backend: str | Backend = "tiff", overwrite_mpp: tuple[float, float] | None = None) -> np.ndarray:
    s = open_slide(path, backend, overwrite_mpp)
    ratio = min(box[0] / s["width"], box[1] / s["height"])
    size = (max(1, int(s["width"] * ratio)), max(1, int(s["height"] * ratio)))
    return flatten_alpha(read_region(path, (0, 0), ratio, size, backend=backend, overwrite_mpp=overwrite_mpp))


def thumbnails(files: DataFrame, box: tuple[int, int] = (512, 512), backend: str | Backend = "tiff") -> DataFrame:
    """(slide_id, image) for rows of path."""
    return _images(files, [], lambda r: thumbnail(r["path"], box, backend))


def associated_images(path: str, backend: str | Backend = "tiff") -> dict[str, np.ndarray]:
    """Label, macro and other images kept beside a slide."""
    return backend_of(backend).associated_images(path)


def resample(path: str, out: str, mpp: float, tile: tuple[int, int] = (512, 512), compression: str = "deflate", pyramid: bool = True, backend: str | Backend = "tiff") -> None:
    """A file with the slide at another spacing, written tile after tile."""
    s = open_slide(path, backend)
    scaling = s["mpp"] / mpp
    w, h = int(s["width"] * scaling), int(s["height"] * scaling)
    bands = backend_of(backend).read_window(path, 0, 0, 0, 1, 1).shape[2]
    tiles = (read_region(path, (x, y), scaling, (min(tile[0], w - x), min(tile[1], h - y)), backend=backend) for y in range(0, h, tile[1]) for x in range(0, w, tile[0]))
    tiff.TiffWriter(out, (w, h, bands), (mpp, mpp), tile, pyramid=pyramid, compression=compression).from_tiles(tiles)
