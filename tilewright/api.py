"""Objects over the DataFrame functions, for those who think in slides, annotation sets and data sets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import annotations as A
from .operators import samples, tiling
from .sources import darwin, geojson, slides, xml


class Slide:
    """One slide file."""

    def __init__(self, path: str, backend: str = "tiff", overwrite_mpp: tuple[float, float] | None = None):
        self.path, self.backend, self.overwrite_mpp = path, backend, overwrite_mpp
        self.about = slides.open_slide(path, backend, overwrite_mpp)

    @property
    def size(self) -> tuple[int, int]:
        return self.about["width"], self.about["height"]

    @property
    def mpp(self) -> float:
        return self.about["mpp"]

    @property
    def properties(self) -> dict[str, str]:
        return self.about["properties"]

    @property
    def aspect_ratio(self) -> float:
        return self.size[0] / self.size[1]

    def scaling(self, mpp: float | None) -> float:
        return self.mpp / mpp if mpp else 1.0

    def scaled_size(self, scaling: float) -> tuple[int, int]:
        return int(self.size[0] * scaling), int(self.size[1] * scaling)

    def closest_native_level(self, mpp: float) -> int:
        return min(self.about["levels"], key=lambda v: (abs((v["mpp_x"] + v["mpp_y"]) / 2 - mpp), v["level"]))["level"]

    def read_region(self, location: tuple[float, float], scaling: float, size: tuple[int, int], kind: str = "LANCZOS") -> np.ndarray:
        return slides.read_region(self.path, location, scaling, size, kind, self.backend, self.overwrite_mpp)

    def thumbnail(self, box: tuple[int, int] = (512, 512)) -> np.ndarray:
        return slides.thumbnail(self.path, box, self.backend, self.overwrite_mpp)

    @property
    def associated_images(self) -> dict[str, np.ndarray]:
        return slides.associated_images(self.path, self.backend)

    def __repr__(self) -> str:
        return f"Slide({self.path!r}, size={self.size}, mpp={self.mpp}, levels={len(self.about['levels'])})"


class AnnotationSet:
    """The annotations of slides, their tags, and whether they count from the slides' bounds."""

    def __init__(self, layers: DataFrame, tags: DataFrame | None = None, offset_to_bounds: bool = False):
        self.layers, self.tags, self.offset_to_bounds = layers, tags, offset_to_bounds

    @classmethod
    def from_geojson(cls, spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None, sorting: str = "NONE") -> AnnotationSet:
        return cls(geojson.read(spark, paths, sorting, slide_id), geojson.read_tags(spark, paths, slide_id))

    @classmethod
    def from_asap_xml(cls, spark: SparkSession, path: str, slide_id: str, scaling: float | None = None, sorting: str = "AREA") -> AnnotationSet:
        return cls(xml.read_asap(spark, path, slide_id, scaling, sorting))

    @classmethod
    def from_halo_xml(cls, spark: SparkSession, path: str, slide_id: str, scaling: float | None = None, sorting: str = "NONE") -> AnnotationSet:
        return cls(xml.read_halo(spark, path, slide_id, scaling, sorting), offset_to_bounds=True)

    @classmethod
    def from_darwin_json(cls, spark: SparkSession, path: str, slide_id: str, metadata: str | None = None, sorting: str = "NONE", z_indices: dict[str, int] | None = None) -> AnnotationSet:
        return cls(darwin.read(spark, path, slide_id, metadata, sorting, z_indices), darwin.read_tags(spark, path, slide_id))

    def _with(self, layers: DataFrame) -> AnnotationSet:
        return AnnotationSet(layers, self.tags, self.offset_to_bounds)

    def filter(self, labels: str | Sequence[str]) -> AnnotationSet:
        return self._with(A.filter_labels(self.layers, labels))

    def sort(self, sorting: str) -> AnnotationSet:
        return self._with(A.sort_layers(self.layers, sorting))

    def rename(self, names: dict[str, str]) -> AnnotationSet:
        return self._with(A.rename_labels(self.layers, names))

    def available_classes(self) -> DataFrame:
        return A.available_classes(self.layers)

    def bounding_box(self) -> DataFrame:
        return A.bounding_box(self.layers)

    def read_regions(self, regions: DataFrame) -> DataFrame:
        return A.read_regions(regions, self.layers)

    def as_geojson(self) -> dict[str, dict]:
        """A document for each slide, on the driver; ``sources.geojson.documents`` keeps them in a table."""
        return {r["slide_id"]: json.loads(r["document"]) for r in geojson.documents(self.layers, self.tags).collect()}

    def __contains__(self, label: str) -> bool:
        return A.contains(self.layers, label)

    def __len__(self) -> int:
        return self.layers.count()

    def wkt(self) -> DataFrame:
        return self.layers.select("slide_id", "layer_idx", G.wkt(F.col("annotation_type"), F.col("rings")).alias("wkt"))


class TileDataset:
    """A sequence of samples over a table with a dense ``ordinal``. Indexing fetches rows to the driver; use ``table``
    for work on all of them."""

    def __init__(self, table: DataFrame):
        self.table, self._length = table, None

    @classmethod
    def from_standard_tiling(cls, slide_table: DataFrame, mpp: float | None, tile: tuple[int, int], **how) -> TileDataset:
        made = samples.tile_samples(slide_table, mpp, tile, **how)
        per = made.groupBy("slide_id").agg(F.count("*").alias("_n"))
        starts = tiling.offsets(per, "_n", "slide_id").select("slide_id", "start")
        return cls(made.join(starts, "slide_id").withColumn("ordinal", F.col("start") + F.col("sample_index")).drop("start"))

    @classmethod
    def concat(cls, parts: Sequence[TileDataset]) -> TileDataset:
        return cls(tiling.concat([p.table for p in parts]))

    def __add__(self, other: TileDataset) -> TileDataset:
        return TileDataset.concat([self, other])

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> TileDataset:
        return TileDataset(fn(self.table))

    def __len__(self) -> int:
        if self._length is None:
            self._length = self.table.count()
        return self._length

    def __getitem__(self, index: int | slice) -> Row | list[Row]:
        if isinstance(index, slice):
            wanted = range(*index.indices(len(self)))
            if not wanted:
                return []
            low, high = min(wanted[0], wanted[-1]), max(wanted[0], wanted[-1])
            at = F.col("ordinal")
            rows = self.table.filter(at.between(low, high) & (F.pmod(at - low, F.lit(abs(wanted.step))) == 0)).orderBy(at if wanted.step > 0 else at.desc())
            return rows.collect()
        return tiling.item(self.table, index, len(self)).first()

    def __iter__(self) -> Iterator[Row]:
        return self.table.orderBy("ordinal").toLocalIterator()
