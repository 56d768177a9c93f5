import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.errors import TilewrightError
from tilewright.functions import geometry as G
from tilewright.operators import masks as M
from tilewright.operators import tiling as T
from tilewright.operators.annotations import spatial_join

BOXES = [(100.0, 140.0, 100.0, 60.0), (500.0, 850.0, 300.0, 150.0)]


@pytest.fixture(scope="module")
def tiles(spark):
    slide = spark.createDataFrame([("s", 1000, 1000, 0.25)], "slide_id string, width int, height int, mpp double")
    return T.standard_tiling(slide, 0.25, (100, 100), order="F").cache()


@pytest.fixture(scope="module")
def annotations(spark):
    rows = spark.createDataFrame([("s", i, *b) for i, b in enumerate(BOXES)], "slide_id string, layer_idx int, x double, y double, bw double, bh double")
    return rows.select("slide_id", "layer_idx", F.lit("BOX").alias("annotation_type"), G.box_rings(F.col("x"), F.col("y"), F.col("bw"), F.col("bh")).alias("rings"))


@pytest.mark.parametrize("threshold,n", [(None, 100), (0.0, 7), (0.4, 7), (0.5, 4), (1.0, 3)])
def test_annotation_mask(tiles, annotations, threshold, n):
    assert M.masked_tiles(tiles, annotations, threshold).count() == n


def test_general_polygons_have_the_same_areas(tiles, annotations):
    turned = annotations.withColumn("rings", F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1))))
    five = turned.withColumn("rings", F.transform("rings", lambda r: F.concat(F.slice(r, 1, 1), F.array(F.struct(((r[0]["x"] + r[1]["x"]) / 2).alias("x"), r[0]["y"].alias("y"))), F.slice(r, 2, 3))))
    a = {r[1]: r[2] for r in M.annotated_fraction(tiles, annotations).collect()}
    b = {r[1]: r[2] for r in M.annotated_fraction(tiles, five).collect() if r[2] > 0}
    assert {k: v for k, v in a.items() if v > 0} == pytest.approx(b)


def _array():
    mask = np.zeros((100, 100), int)
    mask[14:20, 10:20] = 1
    mask[85:100, 50:80] = 1
    return mask


@pytest.mark.parametrize("threshold,n", [(0.0, 7), (0.4, 7), (0.5, 4)])
def test_raster_mask(spark, tiles, threshold, n):
    masks = spark.createDataFrame([("s", 100, 100, _array().ravel().tolist())], "slide_id string, mask_w int, mask_h int, pixels array<int>")
    table = M.summed_area(masks)
    sums = np.array(table.first()["sums"]).reshape(101, 101)
    assert (sums[1:, 1:] == _array().cumsum(0).cumsum(1)).all()
    assert M.masked_tiles(tiles, table, threshold, "raster").count() == n


@pytest.mark.parametrize("threshold,n", [(0.0, 7), (0.4, 7), (0.5, 4), (1.0, 3)])
def test_slide_mask(spark, tiles, threshold, n):
    m = np.kron(_array(), np.ones((10, 10), int))
    blocks = [("s", c // M.BLOCK, r // M.BLOCK, *(p := m[r : r + M.BLOCK, c : c + M.BLOCK]).shape[::-1], p.ravel().tolist()) for r in range(0, 1000, M.BLOCK) for c in range(0, 1000, M.BLOCK)]
    table = spark.createDataFrame(blocks, "slide_id string, block_x int, block_y int, mask_w int, mask_h int, pixels array<int>")
    assert M.masked_tiles(tiles, table, threshold, "slide").count() == n
    got = {r["region_index"]: r["fraction"] for r in M.slide_fraction(tiles, table).collect()}
    for t in tiles.collect():
        x, y = int(t["x"]), int(t["y"])
        assert got[t["region_index"]] == pytest.approx(m[y : y + t["h"], x : x + t["w"]].mean())


def test_large_rasters(spark):
    """A mask of 2000 x 2000; a table built by concatenation takes minutes for it."""
    bit = F.transform(F.sequence(F.lit(0), F.lit(2000 * 2000 - 1)), lambda i: (F.xxhash64(i) % 2 == 0).cast("int"))
    rows = spark.range(1).select(F.lit("s").alias("slide_id"), F.lit(2000).alias("mask_w"), F.lit(2000).alias("mask_h"), bit.alias("pixels"))
    total = rows.select(F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v)).first()[0]
    assert M.summed_area(rows).selectExpr("element_at(sums, -1) s", "size(sums) n").first() == (total, 2001 * 2001)


def test_unknown_kind(tiles, annotations):
    with pytest.raises(TilewrightError):
        M.masked_tiles(tiles, annotations, 0.5, "other")


def test_cells_find_what_the_inequality_join_finds(spark):
    rng = np.random.default_rng(3)
    box = lambda n: [(int(i % 3), *(float(v) for v in rng.integers(0, 900, 2)), *(float(v) for v in rng.integers(0, 200, 2))) for i in range(n)]
    make = lambda p, n: spark.createDataFrame([(s, i, x, y, x + w, y + h) for i, (s, x, y, w, h) in enumerate(box(n))], f"slide_id int, {p}id int, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double")
    r, a = make("r", 80), make("a", 80)
    want = r.join(a.withColumnRenamed("slide_id", "s2"), F.expr("slide_id = s2 AND ax0 <= rx1 AND ax1 >= rx0 AND ay0 <= ry1 AND ay1 >= ry0"))
    for cell in (64, 512):
        got = spatial_join(r, a, cell).select("rid", "aid").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("rid", "aid").collect())) and len(set(got)) == len(got)


@pytest.mark.parametrize("tile,overlap,mode,order", [((100, 100), (0, 0), "overflow", "F"), ((64, 48), (16, 8), "skip", "C"), ((37, 91), (0, 0), "overflow", "C")])
@pytest.mark.parametrize("threshold", [None, 0.0, 0.3, 1.0])
def test_grids_from_the_annotations_side(spark, annotations, tile, overlap, mode, order, threshold):
    """Tiles made from the annotations are those that the join over all tiles keeps."""
    slide = spark.createDataFrame([("s", 1000, 1000, 0.25, [(100, 100, 500, 300), (300, 600, 600, 400)])], "slide_id string, width int, height int, mpp double, rois array<struct<x:int,y:int,w:int,h:int>>")
    how = {"overlap": overlap, "mode": mode, "order": order}
    key = lambda df: sorted((r["region_index"], r["k"], r["ix"], r["iy"], r["x"], r["y"], r["w"], r["h"]) for r in df.collect())
    for more in ({}, {"rois": "rois"}):
        tiles = T.standard_tiling(slide, 0.5, tile, **how, **more)
        assert key(M.masked_grid(slide, annotations, threshold, 0.5, tile, **how, **more)) == key(M.masked_tiles(tiles, annotations, threshold))


def test_grid_reads_see_what_region_reads_see(spark, annotations):
    from tilewright.operators import annotations as A

    slide = spark.createDataFrame([("s", 1000, 1000, 0.25)], "slide_id string, width int, height int, mpp double")
    layers = annotations.select("*", F.lit("L").alias("label"))
    key = lambda df: sorted((r["region_index"], r["layer_idx"], str(r["rings"])) for r in df.collect())
    assert key(A.read_grid(slide, layers, 0.5, (64, 64), overlap=(8, 8))) == key(A.read_regions(T.standard_tiling(slide, 0.5, (64, 64), (8, 8)), layers))
