"""Every registered query over the standard tables, with its SQL.

Queries take (spark, sf_dir). Whole numbers are returned as BIGINT and fractions as DOUBLE, so that both engines give
the same types; geometry is dyadic, so that they give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as colors
from ..functions import geometry as G
from ..functions import slide as S
from ..operators import annotations as A
from ..operators import masks as M
from ..operators import raster as R
from ..operators import rasterize as Z
from ..operators import samples
from ..operators import tiling as T
from ..operators.dealing import dealt
from . import derive as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(fn):
        name = fn.__name__.lstrip("_")
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def _tiles(spark, sf_dir, mpp=None, tile=(256, 256), overlap=(0, 0), mode="overflow", order="C", bounds=True) -> DataFrame:
    return T.standard_tiling(D.slides(spark, sf_dir), mpp, tile, overlap, mode, order, limit_bounds=bounds)


# --- grids

GRID = "SELECT slide_id, region_index, ix::BIGINT AS ix, iy::BIGINT AS iy, x, y, w::BIGINT AS w, h::BIGINT AS h FROM tiles"
GRID_COLUMNS = ["slide_id", "region_index", "ix", "iy", "x", "y", "w", "h"]


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256, mode="skip"), select=GRID))
def tile_grid_skip(spark, sf_dir):
    return _tiles(spark, sf_dir, mode="skip").select(*GRID_COLUMNS)


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256), select=GRID))
def tile_grid_overflow(spark, sf_dir):
    return _tiles(spark, sf_dir).select(*GRID_COLUMNS)


@query(_with(D.SLIDES_SQL, D.tiles_sql("mpp / 0.5", 128, 96, 32, 24), select=GRID))
def tile_grid_overlap(spark, sf_dir):
    return _tiles(spark, sf_dir, 0.5, (128, 96), (32, 24)).select(*GRID_COLUMNS)


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256, order="F"), select=GRID))
def tile_grid_order_f(spark, sf_dir):
    return _tiles(spark, sf_dir, order="F").select(*GRID_COLUMNS)


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256, bounds=False), select=GRID))
def tile_grid_whole_slide(spark, sf_dir):
    return _tiles(spark, sf_dir, bounds=False).select(*GRID_COLUMNS)


ROIS_SQL = """
rois AS (
  SELECT slide_id, mpp / 0.5 AS s, unnest([0, 1]) AS grid_index FROM slides),
extents AS (
  SELECT slide_id, grid_index, ceil((33 + 40 * grid_index) * s)::INT AS off_x, ceil((21 + 50 * grid_index) * s)::INT AS off_y,
         floor((201 + 30 * grid_index) * s)::INT AS size_w, floor((150 + 21 * grid_index) * s)::INT AS size_h FROM rois),
counted AS (SELECT *, greatest(0, floor((size_w - 64) / 64.0::DOUBLE + 1))::INT AS nx, greatest(0, floor((size_h - 64) / 64.0::DOUBLE + 1))::INT AS ny FROM extents),
started AS (SELECT *, coalesce(sum(nx * ny) OVER (PARTITION BY slide_id ORDER BY grid_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM counted),
numbered AS (SELECT *, unnest(range(nx * ny))::INT AS k FROM started WHERE nx > 0 AND ny > 0)
"""


@query(_with(D.SLIDES_SQL, ROIS_SQL, select="SELECT slide_id, grid_index::BIGINT AS grid_index, start + k AS region_index, (off_x + 64 * (k % nx))::DOUBLE AS x, (off_y + 64 * (k // nx))::DOUBLE AS y FROM numbered"))
def roi_grid(spark, sf_dir):
    box = lambda k: F.struct(F.lit(33 + 40 * k).alias("x"), F.lit(21 + 50 * k).alias("y"), F.lit(201 + 30 * k).alias("w"), F.lit(150 + 21 * k).alias("h"))
    slides = D.slides(spark, sf_dir).withColumn("rois", F.array(box(0), box(1)))
    return T.standard_tiling(slides, 0.5, (64, 64), mode="skip", rois="rois").select("slide_id", "grid_index", "region_index", "x", "y")


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 200, 120), select="SELECT slide_id, region_index, k // ny AS local_i, k % ny AS local_j, ix::BIGINT AS ix, iy::BIGINT AS iy FROM tiles").replace("k // ny AS", "(k // ny)::BIGINT AS").replace("k % ny AS", "(k % ny)::BIGINT AS"))
def grid_local_coords(spark, sf_dir):
    return _tiles(spark, sf_dir, tile=(200, 120)).select("slide_id", "region_index", "local_i", "local_j", "ix", "iy")


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256), select="SELECT slide_id, region_index, x + 128 - 80 AS x, y + 128 - 60 AS y, 160::BIGINT AS w, 120::BIGINT AS h FROM tiles"))
def center_retile(spark, sf_dir):
    return T.recentred(_tiles(spark, sf_dir), (160, 120)).select("slide_id", "region_index", "x", "y", "w", "h")


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256), select="SELECT slide_id, count(*)::BIGINT AS n_tiles, max(nx)::BIGINT AS nx, max(ny)::BIGINT AS ny FROM tiles GROUP BY slide_id"))
def grid_size(spark, sf_dir):
    return _tiles(spark, sf_dir).groupBy("slide_id").agg(F.count("*").alias("n_tiles"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))


# --- slides


@query(_with(D.SLIDES_SQL, select="SELECT slide_id, mpp / 0.3 AS scaling, trunc(width * (mpp / 0.3))::BIGINT AS view_w, trunc(height * (mpp / 0.3))::BIGINT AS view_h, mpp / (mpp / 0.3) AS view_mpp FROM slides"))
def scaled_size(spark, sf_dir):
    return S.scaled_view(D.slides(spark, sf_dir), 0.3).select("slide_id", "scaling", "view_w", "view_h", "view_mpp")


@query(_with(D.SLIDES_SQL, "wanted AS (SELECT *, unnest([0.5, 1.0, 2.0, 3.0, 4.5])::DOUBLE AS downsample FROM slides)", select="SELECT slide_id, downsample, (CASE WHEN downsample < 2 THEN 0 WHEN downsample < 4 THEN 1 ELSE 2 END)::BIGINT AS level FROM wanted"))
def best_level(spark, sf_dir):
    rows = D.slides(spark, sf_dir).withColumn("downsample", F.explode(F.array(*(F.lit(x) for x in (0.5, 1.0, 2.0, 3.0, 4.5)))))
    return rows.select("slide_id", "downsample", S.best_level(F.col("levels"), F.col("downsample")).alias("level"))


@query(
    _with(
        D.SLIDES_SQL,
        "wanted AS (SELECT slide_id, mpp, unnest([0.27, 0.49, 0.51, 1.2, 4.4])::DOUBLE AS want FROM slides)",
        "each AS (SELECT *, unnest([0, 1, 2]) AS level FROM wanted)",
        select="SELECT slide_id, want, min_by(level, (abs(mpp * pow(2, level) - want), level))::BIGINT AS level, min_by(mpp * pow(2, level), (abs(mpp * pow(2, level) - want), level)) AS closest_mpp FROM each GROUP BY slide_id, want",
    )
)
def closest_level(spark, sf_dir):
    rows = D.slides(spark, sf_dir).withColumn("want", F.explode(F.array(*(F.lit(x) for x in (0.27, 0.49, 0.51, 1.2, 4.4)))))
    return rows.select("slide_id", "want", S.closest_level(F.col("levels"), F.col("want")).alias("level"), S.closest_mpp(F.col("levels"), F.col("want")).alias("closest_mpp"))


@query("SELECT p_partkey AS slide_id, (x <> 0 AND abs(x - y) <= 0.015 * greatest(abs(x), abs(y))) AS valid FROM (SELECT p_partkey, (p_size % 5) / 4.0::DOUBLE AS x, (p_size % 5) / 4.0::DOUBLE + (p_partkey % 7) / 256.0::DOUBLE AS y FROM part)")
def mpp_valid(spark, sf_dir):
    x = (F.col("p_size") % 5) / F.lit(4.0)
    y = x + (F.col("p_partkey") % 7) / F.lit(256.0)
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), S.mpp_valid(x, y).alias("valid"))


@query(_with(D.SLIDES_SQL, select="SELECT slide_id, trunc(offset_x * (mpp / 0.75))::BIGINT AS x, trunc(offset_y * (mpp / 0.75))::BIGINT AS y, trunc(bounds_w * (mpp / 0.75))::BIGINT AS w, trunc(bounds_h * (mpp / 0.75))::BIGINT AS h FROM slides"))
def slide_bounds_scaled(spark, sf_dir):
    b = S.slide_bounds(*(F.col(c) for c in ("width", "height", "offset_x", "offset_y", "bounds_w", "bounds_h")))
    return D.slides(spark, sf_dir).select("slide_id", F.inline(F.array(S.scaled_bounds(b, S.scaling_of(F.col("mpp"), F.lit(0.75))))))


@query(_with(D.SLIDES_SQL, "each AS (SELECT *, unnest([0, 1, 2]) AS level FROM slides)", select="SELECT slide_id, level::BIGINT AS level, (width // pow(2, level)::INT)::BIGINT AS width, (height // pow(2, level)::INT)::BIGINT AS height, pow(2, level) AS downsample, mpp * pow(2, level) AS spacing FROM each"))
def level_metadata(spark, sf_dir):
    return D.slides(spark, sf_dir).select("slide_id", F.inline("levels")).select("slide_id", "level", "width", "height", "downsample", F.col("mpp_x").alias("spacing"))


@query(_with(D.SLIDES_SQL, select="SELECT slide_id, width / height::DOUBLE AS aspect_ratio, greatest(1, round(width * least(200 / width::DOUBLE, 150 / height::DOUBLE)))::BIGINT AS thumb_w, greatest(1, round(height * least(200 / width::DOUBLE, 150 / height::DOUBLE)))::BIGINT AS thumb_h FROM slides"))
def thumbnail_size(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    t = S.thumbnail_size(w, h, F.lit(200), F.lit(150))
    return D.slides(spark, sf_dir).select("slide_id", S.aspect_ratio(w, h).alias("aspect_ratio"), t["w"].alias("thumb_w"), t["h"].alias("thumb_h"))


# --- sequences of datasets


@query(
    _with(
        D.SLIDES_SQL,
        "parts AS (SELECT slide_id, slide_id % 3 AS dataset, row_number() OVER (PARTITION BY slide_id % 3 ORDER BY slide_id) - 1 AS local FROM slides)",
        select="SELECT slide_id, dataset::BIGINT AS dataset, local::BIGINT AS local, (local + (SELECT count(*) FROM parts q WHERE q.dataset < p.dataset))::BIGINT AS ordinal FROM parts p",
    )
)
def concat_datasets(spark, sf_dir):
    rows = D.slides(spark, sf_dir).select("slide_id", (F.col("slide_id") % 3).alias("third"))
    rows = T.reindexed(rows, "third", "slide_id", "ordinal")
    parts = [rows.filter(F.col("third") == k).drop("third") for k in range(3)]
    return T.concat(parts).select("slide_id", "dataset", "local", "ordinal")


@query("SELECT i AS ordinal, (CASE WHEN i < 40 THEN 0 WHEN i < 100 THEN 1 ELSE 2 END)::BIGINT AS dataset, (i - CASE WHEN i < 40 THEN 0 WHEN i < 100 THEN 40 ELSE 100 END)::BIGINT AS local FROM (SELECT p_partkey % 150 AS i FROM part)")
def concat_index_lookup(spark, sf_dir):
    starts = [0, 40, 100]
    i = (F.col("p_partkey") % 150).alias("ordinal")
    rows = D.table(spark, sf_dir, "part").select(i).withColumn("dataset", T.locate(F.col("ordinal"), starts))
    return rows.withColumn("local", F.col("ordinal") - F.element_at(F.array(*map(F.lit, starts)), F.col("dataset") + 1))


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256), "n AS (SELECT slide_id, count(*) AS n FROM tiles GROUP BY slide_id)", select="SELECT slide_id, n::BIGINT AS n, coalesce(sum(n) OVER (ORDER BY slide_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n"))
def cumulative_sizes(spark, sf_dir):
    n = _tiles(spark, sf_dir).groupBy("slide_id").agg(F.count("*").alias("n"))
    return T.offsets(n, "n", "slide_id")


@query(_with(D.SLIDES_SQL, D.tiles_sql("1", 128, 128), select="SELECT slide_id, region_index, x, y FROM tiles WHERE region_index >= 3 AND region_index < 7"))
def slice_regions(spark, sf_dir):
    return T.sliced(_tiles(spark, sf_dir, tile=(128, 128)), 3, 7, "region_index").select("slide_id", "region_index", "x", "y")


@query(
    _with(D.SLIDES_SQL, D.tiles_sql("1", 256, 256), select="SELECT t.slide_id, region_index, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, -1)::BIGINT AS toxic FROM tiles t LEFT JOIN labels ON t.slide_id = doc_id")
)
def labels_join(spark, sf_dir):
    made = T.with_labels(_tiles(spark, sf_dir), D.image_labels(spark, sf_dir))
    return made.select("slide_id", "region_index", *(F.coalesce(F.col("labels")[k].cast("long"), F.lit(-1)).alias(k) for k in ("quality", "toxic")))


# --- masks

SCALE = "mpp / 0.5"
FRACTIONS = """
pairs AS (
  SELECT t.slide_id, t.region_index, t.x, t.y, t.w, t.h, t.scaling,
         greatest(0, least((t.x + t.w) / scaling, a.x0 + a.aw) - greatest(t.x / scaling, a.x0)) * greatest(0, least((t.y + t.h) / scaling, a.y0 + a.ah) - greatest(t.y / scaling, a.y0)) AS part
  FROM tiles t JOIN annotations a USING (slide_id) WHERE a.annotation_type = 'BOX'),
shares AS (SELECT slide_id, region_index, sum(part * scaling * scaling / (w * h)) AS fraction FROM pairs GROUP BY slide_id, region_index HAVING sum(part) > 0)"""
MASKED = _with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.tiles_sql(SCALE, 32, 32), FRACTIONS, select="SELECT slide_id, region_index, x, y FROM tiles SEMI JOIN (SELECT * FROM shares WHERE {where}) s USING (slide_id, region_index)")


def _boxes(spark, sf_dir):
    return D.annotations(spark, sf_dir).filter("annotation_type = 'BOX'")


def _masked(spark, sf_dir, threshold):
    return M.masked_grid(D.slides(spark, sf_dir), _boxes(spark, sf_dir), threshold, 0.5, (32, 32)).select("slide_id", "region_index", "x", "y")


@query(MASKED.format(where="fraction > 0"))
def masked_tiles_box_0(spark, sf_dir):
    return _masked(spark, sf_dir, 0.0)


@query(MASKED.format(where="fraction > 0.5"))
def masked_tiles_box_05(spark, sf_dir):
    return _masked(spark, sf_dir, 0.5)


@query(MASKED.format(where="fraction > 1 OR fraction = 1"))
def masked_tiles_box_1(spark, sf_dir):
    return _masked(spark, sf_dir, 1.0)


@query(_with(D.SLIDES_SQL, D.tiles_sql(SCALE, 128, 128), select="SELECT slide_id, region_index, x, y FROM tiles"))
def mask_threshold_none(spark, sf_dir):
    tiles = _tiles(spark, sf_dir, 0.5, (128, 128))
    return M.masked_tiles(tiles, _boxes(spark, sf_dir), None).select("slide_id", "region_index", "x", "y")


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.tiles_sql(SCALE, 32, 32), FRACTIONS, select="SELECT slide_id, region_index, (row_number() OVER (PARTITION BY slide_id ORDER BY region_index) - 1)::BIGINT AS sample_index FROM shares WHERE fraction > 0.5"))
def masked_reindex(spark, sf_dir):
    return T.reindexed(_masked(spark, sf_dir, 0.5)).select("slide_id", "region_index", "sample_index")


MASK_TILES = """
mask_tiles AS (
  SELECT slide_id, (4 * j + i)::BIGINT AS region_index, 24 * i AS x, 24 * j AS y, 24 AS w, 24 AS h
  FROM (SELECT vec_id AS slide_id, i, unnest(range(4)) AS j FROM (SELECT vec_id, unnest(range(4)) AS i FROM embeddings)))"""


def _mask_tiles(spark, sf_dir):
    """4 x 4 tiles of 24 pixels over views of 96 pixels, whose masks have 8 x 8."""
    views = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_id"), F.lit(0).alias("off_x"), F.lit(0).alias("off_y"), F.lit(96).alias("size_w"), F.lit(96).alias("size_h"), F.lit(96).alias("view_w"), F.lit(96).alias("view_h"))
    return T.grid(views, (24, 24)).withColumn("region_index", F.col("k").cast("long"))


@query(_with(D.MASKS_SQL, MASK_TILES, select="SELECT t.slide_id, region_index, sum(value) / 4.0::DOUBLE AS fraction FROM mask_tiles t JOIN mask_pixels p ON t.slide_id = p.slide_id AND px * 12 >= x AND px * 12 < x + w AND py * 12 >= y AND py * 12 < y + h GROUP BY t.slide_id, region_index HAVING sum(value) / 4.0 > 0.5"))
def masked_tiles_raster(spark, sf_dir):
    tiles, table = _mask_tiles(spark, sf_dir), M.summed_area(D.masks(spark, sf_dir))
    return M.raster_fraction(tiles, table).filter("fraction > 0.5")


@query(
    _with(
        D.MASKS_SQL,
        "big AS (SELECT slide_id, px * 12 + dx AS px, py * 12 + dy AS py, value FROM (SELECT *, unnest(range(12)) AS dx FROM (SELECT *, unnest(range(12)) AS dy FROM mask_pixels)))",
        "mask_tiles AS (SELECT vec_id AS slide_id, (3 * j + i)::BIGINT AS region_index, 32 * i AS x, 32 * j AS y FROM (SELECT vec_id, i, unnest(range(3)) AS j FROM (SELECT vec_id, unnest(range(3)) AS i FROM embeddings)))",
        select="SELECT t.slide_id, region_index, avg(value)::DOUBLE AS fraction FROM mask_tiles t JOIN big p ON t.slide_id = p.slide_id AND px >= x AND px < x + 32 AND py >= y AND py < y + 32 GROUP BY t.slide_id, region_index HAVING avg(value) > 0.5",
    )
)
def masked_tiles_slide(spark, sf_dir):
    """Masks of 8 x 8 as mask slides of 96 x 96, cut into blocks of 48."""
    cell = lambda by, bx: F.transform(F.sequence(F.lit(0), F.lit(48 * 48 - 1)), lambda k: F.element_at("pixels", (F.lit(4 * by) + F.floor(k / 48 / 12)).cast("int") * 8 + (F.lit(4 * bx) + F.floor(k % 48 / 12)).cast("int") + 1))
    block = lambda by, bx: F.struct(F.lit(bx).alias("block_x"), F.lit(by).alias("block_y"), F.lit(48).alias("mask_w"), F.lit(48).alias("mask_h"), cell(by, bx).alias("pixels"))
    blocks = D.masks(spark, sf_dir).select("slide_id", F.inline(F.array(*(block(y, x) for y in (0, 1) for x in (0, 1)))))
    views = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_id"), F.lit(0).alias("off_x"), F.lit(0).alias("off_y"), F.lit(96).alias("size_w"), F.lit(96).alias("size_h"))
    tiles = T.grid(views, (32, 32)).withColumn("region_index", F.col("k").cast("long"))
    return M.slide_fraction(tiles, blocks, side=48).filter("fraction > 0.5")


# --- annotations

SHAPES_AND = (D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL)
SEEN = """
seen AS (
  SELECT t.slide_id, t.region_index, a.layer_idx, a.label, a.annotation_type, t.x, t.y, t.scaling, a.x0, a.y0, a.x1, a.y1,
         greatest(a.x0, t.x / scaling) AS cx0, greatest(a.y0, t.y / scaling) AS cy0, least(a.x1, (t.x + t.w) / scaling) AS cx1, least(a.y1, (t.y + t.h) / scaling) AS cy1
  FROM tiles t JOIN shapes a USING (slide_id)
  WHERE a.x0 <= (t.x + t.w) / scaling AND a.x1 >= t.x / scaling AND a.y0 <= (t.y + t.h) / scaling AND a.y1 >= t.y / scaling)"""
READ = (D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, D.tiles_sql(SCALE, 128, 128), SEEN)


@query(_with(*READ, select="SELECT slide_id, region_index, layer_idx::BIGINT AS layer_idx, label, cx0 * scaling - x AS x0, cy0 * scaling - y AS y0, cx1 * scaling - x AS x1, cy1 * scaling - y AS y1 FROM seen WHERE annotation_type = 'BOX' AND cx1 > cx0 AND cy1 > cy0"))
def ann_read_region(spark, sf_dir):
    got = A.read_grid(D.slides(spark, sf_dir), _boxes(spark, sf_dir), 0.5, (128, 128), "boxes").filter("annotation_type = 'BOX'")
    b = G.bounds(F.col("rings"))
    return got.select("slide_id", "region_index", "layer_idx", "label", *(b[k].alias(k) for k in ("x0", "y0", "x1", "y1")))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.tiles_sql(SCALE, 64, 64), FRACTIONS, select="SELECT slide_id, region_index, fraction FROM shares"))
def annotated_fraction(spark, sf_dir):
    """The general join by cells, for regions of any kind."""
    return M.annotated_fraction(_tiles(spark, sf_dir, 0.5, (64, 64)), _boxes(spark, sf_dir)).filter("fraction > 0")


@query(_with(*READ, select="SELECT slide_id, region_index, layer_idx::BIGINT AS layer_idx, x0 * scaling - x AS px, y0 * scaling - y AS py FROM seen WHERE annotation_type = 'POINT'"))
def ann_points_in_tile(spark, sf_dir):
    points = D.annotations(spark, sf_dir).filter("annotation_type = 'POINT'")
    got = A.read_regions(_tiles(spark, sf_dir, 0.5, (128, 128)), points, shapes="boxes")
    p = F.col("rings")[0][0]
    return got.select("slide_id", "region_index", "layer_idx", p["x"].alias("px"), p["y"].alias("py"))


#: An area in whole steps, whose limits no exact area meets: the engines' last bits differ.
STEP = "floor(({}) * 997 + 0.123)::BIGINT"


def _steps(area):
    return F.floor(area * 997 + F.lit(0.123))


#: Diamonds clipped to tiles, in the view's pixels: the height over x is linear between the places where an edge starts,
#: turns or meets the tile, so that trapezoids over them give the area.
CLIPPED = """
near AS (
  SELECT t.slide_id, t.region_index, a.layer_idx, (a.x0 + a.aw) * scaling - t.x AS cx, (a.y0 + a.ah) * scaling - t.y AS cy, a.aw * scaling AS hw, a.ah * scaling AS hh, t.w, t.h, scaling
  FROM tiles t JOIN shapes a USING (slide_id)
  WHERE a.annotation_type = 'POLYGON' AND a.x0 < (t.x + t.w) / scaling AND a.x1 > t.x / scaling AND a.y0 < (t.y + t.h) / scaling AND a.y1 > t.y / scaling),
spans AS (SELECT *, greatest(0, cx - hw) AS a, least(w, cx + hw) AS z FROM near),
turns AS (
  SELECT *, list_sort([greatest(a, least(z, v)) FOR v IN [a, z, cx, cx - hw * (1 - abs(cy) / hh), cx + hw * (1 - abs(cy) / hh), cx - hw * (1 - abs(h - cy) / hh), cx + hw * (1 - abs(h - cy) / hh)]]) AS v FROM spans),
heights AS (SELECT *, [greatest(0, least(h, cy + hh * (1 - abs(x - cx) / hw)) - greatest(0, cy - hh * (1 - abs(x - cx) / hw))) FOR x IN v] AS f FROM turns),
clipped AS (SELECT slide_id, region_index, layer_idx, scaling, w, h, hw, hh, list_sum([(v[i + 1] - v[i]) * (f[i] + f[i + 1]) / 2 FOR i IN range(1, 7)]) AS area FROM heights)"""


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, D.tiles_sql(SCALE, 128, 128), CLIPPED, select=f"SELECT slide_id, region_index, layer_idx::BIGINT AS layer_idx, 1::BIGINT AS parts, {STEP.format('area')} AS area_steps FROM clipped WHERE area > 0.001"))
def ann_polygons_in_tile(spark, sf_dir):
    """Clipped diamonds with their areas in the view's pixels; tests/test_clip.py holds other shapes to brute force."""
    shapes = D.annotations(spark, sf_dir).filter("annotation_type = 'POLYGON'")
    got = A.read_grid(D.slides(spark, sf_dir), shapes, 0.5, (128, 128))
    by = ["slide_id", "region_index", "layer_idx"]
    each = dealt(got.select(*by, G.polygon_area(F.col("rings")).alias("a")), *by).groupBy(*by).agg(F.count("*").alias("parts"), F.sum("a").alias("area")).filter("area > 0.001")
    return each.select("slide_id", "region_index", "layer_idx", "parts", _steps(F.col("area")).alias("area_steps"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, D.tiles_sql(SCALE, 64, 64), CLIPPED, select=f"SELECT slide_id, region_index, {STEP.format('sum(area)')} AS area_steps FROM clipped GROUP BY slide_id, region_index HAVING sum(area) > 0.001"))
def annotated_fraction_polygons(spark, sf_dir):
    """The share of each tile that diamonds cover."""
    shapes = D.annotations(spark, sf_dir).filter("annotation_type = 'POLYGON'")
    made = M.annotated_fraction(_tiles(spark, sf_dir, 0.5, (64, 64)), shapes)
    area = F.col("fraction") * 64 * 64
    return made.filter(area > 0.001).select("slide_id", "region_index", _steps(area).alias("area_steps"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, label, annotation_type FROM annotations WHERE label IN ('A', 'R')"))
def ann_filter_labels(spark, sf_dir):
    return A.filter_labels(D.annotations(spark, sf_dir), ["A", "R"]).select("slide_id", "layer_idx", "label", "annotation_type")


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, "b AS (SELECT slide_id, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM shapes GROUP BY slide_id)", select="SELECT slide_id, coalesce(x, 0)::DOUBLE AS x, coalesce(y, 0)::DOUBLE AS y, coalesce(w, 0)::DOUBLE AS w, coalesce(h, 0)::DOUBLE AS h FROM slides LEFT JOIN b USING (slide_id)"))
def ann_bounding_box(spark, sf_dir):
    return A.bounding_box(D.annotations(spark, sf_dir), D.slides(spark, sf_dir))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, label, annotation_type, coalesce(z_index, -1)::BIGINT AS z_index, min(layer_idx)::BIGINT AS first_layer FROM annotations GROUP BY ALL"))
def ann_available_classes(spark, sf_dir):
    return A.available_classes(D.annotations(spark, sf_dir)).select("slide_id", "label", "annotation_type", F.coalesce("z_index", F.lit(-1)).alias("z_index"), "first_layer")


SORTED = _with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, select="SELECT slide_id, label, annotation_type, x0::DOUBLE AS x0, (row_number() OVER (PARTITION BY slide_id ORDER BY {order}) - 1)::BIGINT AS layer_idx FROM shapes")


def _sorted(spark, sf_dir, how):
    return A.sort_layers(D.annotations(spark, sf_dir), how).select("slide_id", "label", "annotation_type", G.bounds(F.col("rings"))["x0"].alias("x0"), "layer_idx")


@query(SORTED.format(order="area DESC, layer_idx"))
def ann_sort_area(spark, sf_dir):
    return _sorted(spark, sf_dir, "AREA")


@query(SORTED.format(order="z_index ASC NULLS LAST, layer_idx"))
def ann_sort_zindex(spark, sf_dir):
    return _sorted(spark, sf_dir, "Z_INDEX")


@query(SORTED.format(order="layer_idx DESC"))
def ann_sort_reverse(spark, sf_dir):
    return _sorted(spark, sf_dir, "REVERSE")


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, CASE label WHEN 'A' THEN 'tumour' WHEN 'N' THEN 'stroma' ELSE label END AS label, z_index IS NULL OR TRUE AS unstyled FROM annotations"))
def ann_rename(spark, sf_dir):
    got = A.rename_labels(D.annotations(spark, sf_dir), {"A": "tumour", "N": "stroma"})
    return got.select("slide_id", "layer_idx", "label", (F.col("z_index").isNull() & F.col("color").isNull()).alias("unstyled"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, (CASE label WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END)::BIGINT AS index_value FROM annotations"))
def ann_class_index(spark, sf_dir):
    return A.with_index(D.annotations(spark, sf_dir), {"A": 1, "N": 2, "R": 3}).select("slide_id", "layer_idx", "index_value")


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, annotation_type = 'BOX' OR (annotation_type = 'POLYGON' AND aw = ah) AS is_rectangle FROM annotations"))
def is_rectangle(spark, sf_dir):
    return D.annotations(spark, sf_dir).select("slide_id", "layer_idx", G.is_rectangle(F.col("rings")).alias("is_rectangle"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, area::DOUBLE AS area FROM shapes"))
def polygon_area(spark, sf_dir):
    return D.annotations(spark, sf_dir).select("slide_id", "layer_idx", G.polygon_area(F.col("rings")).alias("area"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, label, string_agg(x0 || ' ' || y0, ',' ORDER BY layer_idx) AS points FROM annotations WHERE annotation_type = 'POINT' GROUP BY slide_id, label"))
def points_by_label(spark, sf_dir):
    rows = A.points_by_label(D.annotations(spark, sf_dir)).select("slide_id", F.explode("points").alias("label", "p"))
    text = F.array_join(F.transform("p", lambda q: F.concat_ws(" ", q["x"].cast("long").cast("string"), q["y"].cast("long").cast("string"))), ",")
    return rows.select("slide_id", "label", text.alias("points"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, (x0 + offset_x)::DOUBLE AS x0, (y0 + offset_y)::DOUBLE AS y0 FROM annotations JOIN slides USING (slide_id)"))
def ann_offset_to_bounds(spark, sf_dir):
    got = A.shifted(_corners(spark, sf_dir), D.slides(spark, sf_dir))
    p = F.col("rings")[0][0]
    return got.select("slide_id", "layer_idx", p["x"].alias("x0"), p["y"].alias("y0"))


def _corners(spark, sf_dir):
    """The annotations' upper left corners as points."""
    rows = D.annotations(spark, sf_dir)
    b = G.bounds(F.col("rings"))
    return rows.withColumns({"rings": F.array(F.array(G.point(b["x0"], b["y0"]))), "annotation_type": F.lit("POINT")})


def _double(sql: str) -> str:
    return f"({sql})::DOUBLE::VARCHAR"


WKT_SQL = f"""CASE annotation_type
  WHEN 'POINT' THEN 'POINT (' || {_double('x0')} || ' ' || {_double('y0')} || ')'
  WHEN 'BOX' THEN 'POLYGON ((' || array_to_string([{', '.join(f"{_double(x)} || ' ' || {_double(y)}" for x, y in (('x0', 'y0'), ('x0 + aw', 'y0'), ('x0 + aw', 'y0 + ah'), ('x0', 'y0 + ah'), ('x0', 'y0')))}], ', ') || '))'
  ELSE 'POLYGON ((' || array_to_string([{', '.join(f"{_double(x)} || ' ' || {_double(y)}" for x, y in (('x0', 'y0 + ah'), ('x0 + aw', 'y0'), ('x0 + 2 * aw', 'y0 + ah'), ('x0 + aw', 'y0 + 2 * ah'), ('x0', 'y0 + ah')))}], ', ') || '))' END"""


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, select=f"SELECT slide_id, layer_idx::BIGINT AS layer_idx, {WKT_SQL} AS wkt FROM annotations"))
def ann_wkt(spark, sf_dir):
    return D.annotations(spark, sf_dir).select("slide_id", "layer_idx", G.wkt(F.col("annotation_type"), F.col("rings")).alias("wkt"))


@query(_with(D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.tiles_sql(SCALE, 32, 32), FRACTIONS, select="SELECT s.slide_id, (row_number() OVER (PARTITION BY s.slide_id ORDER BY s.region_index) - 1)::BIGINT AS sample_index, s.region_index, 0::BIGINT AS grid_index, (k // ny)::BIGINT AS local_i, (k % ny)::BIGINT AS local_j, x, y, view_mpp AS mpp, coalesce(quality, -1)::BIGINT AS quality FROM shares s JOIN tiles t ON s.slide_id = t.slide_id AND s.region_index = t.region_index LEFT JOIN labels ON s.slide_id = doc_id WHERE fraction > 0.5"))
def tile_sample_rows(spark, sf_dir):
    made = samples.tile_samples(D.slides(spark, sf_dir), 0.5, (32, 32), mask=_boxes(spark, sf_dir), mask_threshold=0.5, labels=D.image_labels(spark, sf_dir))
    local, at = F.col("grid_local_coordinates"), F.col("coordinates")
    return made.select("slide_id", "sample_index", "region_index", "grid_index", local["i"].alias("local_i"), local["j"].alias("local_j"), at["x"].alias("x"), at["y"].alias("y"), "mpp", F.coalesce(F.col("labels")["quality"].cast("long"), F.lit(-1)).alias("quality"))


# --- rasterising: all slides, seen whole at a quarter of their size

QUARTER = """
views AS (SELECT slide_id, width // 4 AS vw, height // 4 AS vh FROM slides),
local AS (
  SELECT slide_id, layer_idx, label, annotation_type, vw, vh, round_even(x0 / 4.0::DOUBLE, 0)::INT AS x0, round_even(y0 / 4.0::DOUBLE, 0)::INT AS y0,
         round_even(x1 / 4.0::DOUBLE, 0)::INT AS x1, round_even(y1 / 4.0::DOUBLE, 0)::INT AS y1, round_even((x0 + aw) / 4.0::DOUBLE, 0)::INT AS xm, round_even((y0 + ah) / 4.0::DOUBLE, 0)::INT AS ym,
         round_even((x0 + 2) / 4.0::DOUBLE, 0)::INT AS hx0, round_even((y0 + 1) / 4.0::DOUBLE, 0)::INT AS hy0, round_even((x1 - 2) / 4.0::DOUBLE, 0)::INT AS hx1, round_even((y1 - 1) / 4.0::DOUBLE, 0)::INT AS hy1
  FROM shapes JOIN views USING (slide_id) WHERE annotation_type <> 'POINT'),
px AS (SELECT *, unnest(range(x0, least(x1, vw - 1) + 1)) AS px FROM local WHERE x0 < vw),
boxed AS (SELECT *, unnest(range(y0, least(y1, vh - 1) + 1)) AS py FROM px WHERE y0 < vh),
pixels AS (
  SELECT * FROM boxed WHERE annotation_type = 'BOX' OR (
    (xm - x0) * (py - ym) <= (y1 - ym) * (px - x0) AND (xm - x0) * (ym - py) <= (ym - y0) * (px - x0)
    AND (x1 - xm) * (py - ym) <= (y1 - ym) * (x1 - px) AND (x1 - xm) * (ym - py) <= (ym - y0) * (x1 - px)))"""
PIXELS = (D.SLIDES_SQL, D.ANNOTATIONS_SQL, D.SHAPES_SQL, QUARTER)
INDEX = {"A": 1, "N": 2, "R": 3}
INDEX_SQL = "CASE label WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
SUMS = "count(*)::BIGINT AS n, sum(px)::BIGINT AS sx, sum(py)::BIGINT AS sy, sum(px * px)::BIGINT AS sxx, sum(px * py)::BIGINT AS sxy, sum(py * py)::BIGINT AS syy"
LAST = f"last AS (SELECT slide_id, px, py, max_by({INDEX_SQL}, layer_idx)::BIGINT AS value FROM pixels GROUP BY slide_id, px, py)"
VIEW = ("slide_id",)


def _quarter(spark, sf_dir):
    """All boxes and diamonds on their slides' views."""
    views = D.slides(spark, sf_dir).select("slide_id", F.floor(F.col("width") / 4).cast("int").alias("w"), F.floor(F.col("height") / 4).cast("int").alias("h"))
    shapes = D.annotations(spark, sf_dir).filter("annotation_type <> 'POINT'").join(views.hint("merge"), "slide_id")
    return shapes.withColumn("rings", G.map_points(F.col("rings"), lambda p: G.point(p["x"] / 4, p["y"] / 4)))


def _moments(bands: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Number of a mask's pixels, and the sums of their coordinates, squares and products, by value."""
    runs = Z.runs(bands, by).withColumns({"n": F.col("x1") - F.col("x0") + 1, "a": F.col("x0").cast("long"), "z": F.col("x1").cast("long"), "py": F.col("py").cast("long")})
    n, y = F.col("n"), F.col("py")
    sx = F.expr("(a + z) * n div 2")
    square = lambda k: f"({k} * ({k} + 1) * (2 * {k} + 1) div 6)"
    sxx = F.expr(f"{square('z')} - {square('(a - 1)')}")
    return runs.groupBy(*by, "value").agg(F.sum(n).alias("n"), F.sum(sx).alias("sx"), F.sum(n * y).alias("sy"), F.sum(sxx).alias("sxx"), F.sum(sx * y).alias("sxy"), F.sum(n * y * y).alias("syy"))


@query(_with(*PIXELS, LAST, select=f"SELECT slide_id, value, {SUMS} FROM last GROUP BY slide_id, value"))
def mask_last_writer(spark, sf_dir):
    return _moments(Z.class_mask(_quarter(spark, sf_dir), INDEX, VIEW), VIEW)


@query(_with(*PIXELS, f"planes AS (SELECT DISTINCT slide_id, ({INDEX_SQL})::BIGINT AS plane, px, py FROM pixels)", select=f"SELECT slide_id, plane, 1::BIGINT AS value, {SUMS} FROM planes GROUP BY slide_id, plane"))
def mask_multiclass(spark, sf_dir):
    by = (*VIEW, "plane")
    return _moments(Z.class_planes(_quarter(spark, sf_dir), INDEX, VIEW), by)


@query(_with(*PIXELS, "inside AS (SELECT DISTINCT slide_id, px, py FROM pixels WHERE label = 'R')", select=f"SELECT slide_id, 1::BIGINT AS value, {SUMS} FROM inside GROUP BY slide_id"))
def roi_mask(spark, sf_dir):
    return _moments(Z.roi_mask(_quarter(spark, sf_dir), "R", VIEW), VIEW)


@query(
    _with(
        *PIXELS,
        f"last AS (SELECT slide_id, px, py, max_by({INDEX_SQL}, layer_idx)::BIGINT AS value FROM pixels WHERE NOT (px BETWEEN hx0 AND hx1 AND py BETWEEN hy0 AND hy1) GROUP BY slide_id, px, py)",
        select=f"SELECT slide_id, value, {SUMS} FROM last GROUP BY slide_id, value",
    )
)
def mask_holes(spark, sf_dir):
    """Every shape with a box cut out of it."""
    shapes = _quarter(spark, sf_dir).withColumn("_b", G.bounds(F.col("rings")))
    b = F.col("_b")
    hole = G.box_rings(b["x0"] + 0.5, b["y0"] + 0.25, b["x1"] - b["x0"] - 1, b["y1"] - b["y0"] - 0.5)
    return _moments(Z.class_mask(shapes.withColumn("rings", F.concat("rings", hole)).drop("_b"), INDEX, VIEW), VIEW)


@query(
    _with(
        *PIXELS,
        LAST,
        "sums AS (SELECT slide_id, sum(value)::BIGINT AS total, sum(value * (py + 1))::BIGINT AS by_row FROM last GROUP BY slide_id)",
        select="SELECT slide_id, vw::BIGINT AS w, vh::BIGINT AS h, coalesce(total, 0)::BIGINT AS total, coalesce(by_row, 0)::BIGINT AS by_row, (SELECT count(*) FROM annotations a WHERE a.slide_id = v.slide_id AND annotation_type = 'POINT')::BIGINT AS points FROM views v LEFT JOIN sums s USING (slide_id)",
    )
)
def to_masks(spark, sf_dir):
    """A whole mask and the points for every slide."""
    views = D.slides(spark, sf_dir).select("slide_id", F.floor(F.col("width") / 4).cast("int").alias("w"), F.floor(F.col("height") / 4).cast("int").alias("h"))
    points = D.annotations(spark, sf_dir).filter("annotation_type = 'POINT'").join(views.hint("merge"), "slide_id")
    made = Z.to_masks(_quarter(spark, sf_dir).unionByName(points), views, INDEX, by=VIEW)
    count = F.aggregate(F.map_values("points"), F.lit(0).cast("long"), lambda a, p: a + F.size(p))

    def sums(batches):
        for b in batches:
            rows = [np.array(m.flatten().to_numpy(), np.int64).reshape(len(m), -1) for m in (x.values for x in b.column("mask"))]
            cols = [[m.shape[1] for m in rows], [m.shape[0] for m in rows], [int(m.sum()) for m in rows], [int((m.sum(1) * np.arange(1, len(m) + 1)).sum()) for m in rows]]
            yield pa.RecordBatch.from_arrays([b.column("slide_id"), *(pa.array(c, pa.int64()) for c in cols), b.column("points")], names=["slide_id", "w", "h", "total", "by_row", "points"])

    kind = views.schema["slide_id"].dataType.simpleString()
    return made.select("slide_id", "mask", F.coalesce(count, F.lit(0).cast("long")).alias("points")).mapInArrow(sums, f"slide_id {kind}, w long, h long, total long, by_row long, points long")


# --- pixels

IMAGE = "image AS (SELECT vec_id AS slide_id, k % 8 AS px, k // 8 AS py, greatest(0, least(255, floor(embedding[k + 1]::DOUBLE * 128 + 128)))::BIGINT AS value FROM (SELECT vec_id, embedding, unnest(range(64))::INT AS k FROM embeddings))"


def _image(spark, sf_dir):
    """A tile table of images of 8 x 8 bytes, in tiles of 4 x 4, one level."""
    one = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 128 + 128)))), 2, "0"))
    rows = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_id"), one.alias("p"))
    part = lambda r, c: F.unhex(F.concat(*(F.array_join(F.slice("p", 8 * (4 * r + j) + 4 * c + 1, 4), "") for j in range(4))))
    tile = lambda r, c: F.struct(F.lit(0).alias("level"), F.lit(r).alias("tile_row"), F.lit(c).alias("tile_col"), F.lit(4).alias("width"), F.lit(4).alias("height"), F.lit(1).alias("bands"), part(r, c).alias("data"))
    return rows.select("slide_id", F.inline(F.array(*(tile(r, c) for r in (0, 1) for c in (0, 1)))))


def _views(spark, sf_dir, x, y, w, h, scaling=1.0):
    level = F.array(F.struct(F.lit(0).alias("level"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1.0).alias("downsample"), F.lit(1.0).alias("mpp_x"), F.lit(1.0).alias("mpp_y")))
    size = int(8 * scaling)
    made = {"region_index": F.lit(0).cast("long"), "x": F.lit(float(x)), "y": F.lit(float(y)), "w": F.lit(w), "h": F.lit(h), "scaling": F.lit(scaling), "levels": level, "view_w": F.lit(size), "view_h": F.lit(size)}
    return D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_id")).withColumns(made)


def _pixel_rows(images: DataFrame) -> DataFrame:
    rows = images.select("slide_id", "width", F.posexplode(R.bytes_of(F.col("data"))).alias("k", "value"))
    return rows.select("slide_id", (F.col("k") % F.col("width")).alias("tx"), F.floor(F.col("k") / F.col("width")).alias("ty"), "value")


def _padded(x: int, y: int, w: int, h: int) -> str:
    targets = f"targets AS (SELECT vec_id AS slide_id, tx, unnest(range({h})) AS ty FROM (SELECT vec_id, unnest(range({w})) AS tx FROM embeddings))"
    return _with(IMAGE, targets, select=f"SELECT t.slide_id, tx::BIGINT AS tx, ty::BIGINT AS ty, coalesce(value, 0)::BIGINT AS value FROM targets t LEFT JOIN image i ON i.slide_id = t.slide_id AND px = tx + {x} AND py = ty + {y}")


def _read(spark, sf_dir, view, kind="NEAREST", mode=None):
    return _pixel_rows(R.read_regions(_views(spark, sf_dir, *view), _image(spark, sf_dir), 4, kind, mode=mode))


@query(_padded(-2, 5, 6, 7))
def region_zero_pad(spark, sf_dir):
    return _read(spark, sf_dir, (-2, 5, 6, 7), mode="zero")


@query(_padded(0, 5, 4, 3))
def region_crop(spark, sf_dir):
    return _read(spark, sf_dir, (-2, 5, 6, 7), mode="crop")


@query(_with(IMAGE, "targets AS (SELECT vec_id AS slide_id, tx, unnest(range(16)) AS ty FROM (SELECT vec_id, unnest(range(16)) AS tx FROM embeddings))", select="SELECT t.slide_id, tx::BIGINT AS tx, ty::BIGINT AS ty, value FROM targets t JOIN image i ON i.slide_id = t.slide_id AND px = tx // 2 AND py = ty // 2"))
def resample_nearest(spark, sf_dir):
    return _read(spark, sf_dir, (0, 0, 16, 16, 2.0))


#: The Lanczos kernel of reach 3 at twice the size: out pixel t lies at (t + 0.5) / 2 of the image.
LANCZOS = """
taps AS (SELECT t, s, s + 0.5::DOUBLE - (t + 0.5::DOUBLE) * 0.5 AS d FROM (SELECT t, unnest(range(8)) AS s FROM (SELECT unnest(range(16)) AS t))),
raw AS (SELECT t, s, CASE WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * (sin(pi() * (d / 3)) / (pi() * (d / 3))) ELSE 0 END AS k FROM taps),
weights AS (SELECT t, s, k / sum(k) OVER (PARTITION BY t) AS k FROM raw),
across AS (SELECT slide_id, t AS tx, py, sum(value * k) AS v FROM image JOIN weights ON s = px GROUP BY slide_id, t, py),
both_ AS (SELECT slide_id, tx, t AS ty, sum(v * k) AS v FROM across JOIN weights ON s = py GROUP BY slide_id, tx, t)"""


@query(_with(IMAGE, LANCZOS, select="SELECT slide_id, tx::BIGINT AS tx, ty::BIGINT AS ty, greatest(0, least(255, round_even(v, 0)))::BIGINT AS value FROM both_"))
def resample_lanczos(spark, sf_dir):
    return _read(spark, sf_dir, (0, 0, 16, 16, 2.0), "LANCZOS")


@query(_with(IMAGE, select="SELECT slide_id, 1::BIGINT AS level, (px // 2)::BIGINT AS tx, (py // 2)::BIGINT AS ty, floor((sum(value) + 2) / 4)::BIGINT AS value FROM image GROUP BY slide_id, px // 2, py // 2"))
def pyramid_downsample(spark, sf_dir):
    return _pixel_rows(R.downsample(_image(spark, sf_dir), 4)).withColumn("level", F.lit(1))


@query(_with(IMAGE, select="SELECT slide_id, (px // 2)::BIGINT AS tx, (py // 2)::BIGINT AS ty, value FROM image WHERE px % 2 = 0 AND py % 2 = 0"))
def pyramid_downsample_mask(spark, sf_dir):
    return _pixel_rows(R.downsample(_image(spark, sf_dir), 4, is_mask=True))


@query(_with(D.SLIDES_SQL, "n AS (SELECT *, greatest(0, least(ceil(log2(width / 128.0::DOUBLE)), ceil(log2(height / 128.0::DOUBLE))))::INT AS n FROM slides)", "l AS (SELECT *, unnest(range(n + 1))::INT AS level FROM n)", select="SELECT slide_id, level::BIGINT AS level, (width // pow(2, level)::INT)::BIGINT AS level_w, (height // pow(2, level)::INT)::BIGINT AS level_h, 1 / mpp * 10000 / pow(2, level) AS per_cm FROM l"))
def pyramid_shapes(spark, sf_dir):
    levels = R.pyramid_levels(F.col("width"), F.col("height"), F.lit(128), F.lit(128))
    rows = D.slides(spark, sf_dir).select("slide_id", "mpp", F.explode(levels).alias("l"))
    tags = R.resolution_tags(F.col("mpp"), F.col("mpp"), F.col("l.level"))
    return rows.select("slide_id", F.col("l.level").alias("level"), F.col("l.width").alias("level_w"), F.col("l.height").alias("level_h"), tags["x"].alias("per_cm"))


PLANS = """
r AS (SELECT slide_id, width, height, unnest([2.0, 1.0, 0.5, 0.25])::DOUBLE AS scaling FROM slides),
l AS (SELECT *, CASE WHEN scaling >= 1 THEN 0 WHEN scaling = 0.5 THEN 1 ELSE 2 END AS level FROM r),
p AS (SELECT *, pow(2, level) AS ds, scaling * pow(2, level) AS ns, width // pow(2, level)::INT AS lw, height // pow(2, level)::INT AS lh, CASE WHEN scaling * pow(2, level) > 1 THEN 3 ELSE ceil(3 / (scaling * pow(2, level))) END AS extra FROM l),
q AS (SELECT *, floor(greatest(0, least(floor(24 / ns - extra), lw)) * ds) / ds AS px, floor(greatest(0, least(floor(16 / ns - extra), lh)) * ds) / ds AS py FROM p)"""


@query(_with(D.SLIDES_SQL, PLANS, select="SELECT slide_id, scaling, level::BIGINT AS level, px AS patch_x, py AS patch_y, ceil(greatest(0, least(ceil(24 / ns + 64 / ns + extra), lw)) - px)::BIGINT AS patch_w, ceil(greatest(0, least(ceil(16 / ns + 48 / ns + extra), lh)) - py)::BIGINT AS patch_h FROM q"))
def read_plan(spark, sf_dir):
    rows = D.slides(spark, sf_dir).withColumn("scaling", F.explode(F.array(*(F.lit(v) for v in (2.0, 1.0, 0.5, 0.25)))))
    rows = rows.withColumns({"x": F.lit(24.0), "y": F.lit(16.0), "w": F.lit(64), "h": F.lit(48)})
    return R.plan_reads(rows).select("slide_id", "scaling", "level", "patch_x", "patch_y", "patch_w", "patch_h")


@query(_with(D.SLIDES_SQL, "r AS (SELECT slide_id, width, height, -5.5::DOUBLE AS x, height - 40.0::DOUBLE AS y FROM slides)", select="SELECT slide_id, x + greatest(0, -x) AS read_x, y + greatest(0, -y) AS read_y, greatest(0, trunc(greatest(0, least(x + 64, width)) - x - greatest(0, -x)))::BIGINT AS read_w, greatest(0, trunc(greatest(0, least(y + 48, height)) - y - greatest(0, -y)))::BIGINT AS read_h, floor(greatest(0, -x))::BIGINT AS paste_x, floor(greatest(0, -y))::BIGINT AS paste_y, 64::BIGINT AS out_w, 48::BIGINT AS out_h FROM r"))
def region_boundary(spark, sf_dir):
    rows = D.slides(spark, sf_dir).withColumns({"x": F.lit(-5.5), "y": F.col("height") - F.lit(40.0), "w": F.lit(64), "h": F.lit(48), "view_w": F.col("width"), "view_h": F.col("height")})
    return R.boundary(rows, "zero").select("slide_id", "read_x", "read_y", "read_w", "read_h", "paste_x", "paste_y", "out_w", "out_h")


@query("SELECT p_partkey AS slide_id, CASE WHEN p_partkey % 2 = 0 THEN 10000 / (100 + p_size)::DOUBLE ELSE -1 END AS mpp_x, CASE WHEN p_partkey % 2 = 0 THEN 10000 / (200 + p_size)::DOUBLE ELSE -1 END AS mpp_y FROM part")
def tiff_mpp(spark, sf_dir):
    text = {"openslide.library-version": F.when(F.col("p_partkey") % 2 == 0, F.lit("3.4.1")).otherwise(F.lit("4.0.0")), "openslide.vendor": F.lit("generic-tiff"), "tiff.ResolutionUnit": F.lit("centimeter"), "tiff.XResolution": (100 + F.col("p_size")).cast("string"), "tiff.YResolution": (200 + F.col("p_size")).cast("string")}
    tags = F.create_map(*(c for k, v in text.items() for c in (F.lit(k), v)))
    x, y = S.mpp_from_tiff(F.col("tags"))
    rows = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), tags.alias("tags"))
    return rows.select("slide_id", F.coalesce(x, F.lit(-1.0)).alias("mpp_x"), F.coalesce(y, F.lit(-1.0)).alias("mpp_y"))


# --- colours


@query("SELECT p_partkey AS slide_id, (p_partkey % 256)::BIGINT AS r, (p_partkey * 7 % 256)::BIGINT AS g, (p_size * 5 % 256)::BIGINT AS b FROM part")
def hex_color(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.format_string("#%02x%02x%02x", (key % 256).cast("int"), (key * 7 % 256).cast("int"), (size * 5 % 256).cast("int"))
    rgb = colors.hex_to_rgb(text)
    return D.table(spark, sf_dir, "part").select(key.alias("slide_id"), *(rgb[k].alias(c) for k, c in enumerate("rgb")))


@query("SELECT i::BIGINT AS i, (CASE i WHEN 2 THEN 255 WHEN 3 THEN 255 ELSE 0 END * 256)::BIGINT AS r, (CASE i WHEN 1 THEN 128 WHEN 3 THEN 255 ELSE 0 END * 256)::BIGINT AS g, 0::BIGINT AS b FROM range(256) t(i)")
def color_lut(spark, sf_dir):
    lut = colors.color_lut({1: (0, 128, 0), 2: (255, 0, 0), 3: (255, 255, 0)})
    return spark.range(1).select(lut.alias("l")).select(F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(255)).alias("i"), F.col("l")[0].alias("r"), F.col("l")[1].alias("g"), F.col("l")[2].alias("b"))))
