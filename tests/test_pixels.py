import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import color, slide
from tilewright.operators import raster as R
from tilewright.sources import tiff

LEVELS = [(0, 1000, 1000, 1.0, 0.5, 0.5), (1, 500, 500, 2.0, 1.0, 1.0), (2, 250, 250, 4.0, 2.0, 2.0)]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("a", 1000, 1000, 0.5, LEVELS)], "slide_id string, width int, height int, mpp double, levels array<struct<level:int,width:int,height:int,downsample:double,mpp_x:double,mpp_y:double>>")


@pytest.mark.parametrize("ds,level", [(0.5, 0), (1.0, 0), (2.0, 1), (3.0, 1), (4.5, 2)])
def test_best_level(base, ds, level):
    assert base.select(slide.best_level(F.col("levels"), F.lit(ds)).alias("l")).first()["l"] == level


@pytest.mark.parametrize("mpp,want", [(0.54, 0.5), (0.98, 1.0), (1.02, 1.0), (2.4, 2.0), (8.8, 2.0)])
def test_closest_mpp(base, mpp, want):
    assert base.select(slide.closest_mpp(F.col("levels"), F.lit(mpp)).alias("m")).first()["m"] == want


def test_scaling_and_checks(spark, base):
    assert base.select(slide.scaling_of(F.col("mpp"), F.lit(0.0)).alias("s")).first()["s"] == 1.0
    view = slide.scaled_view(base, 0.75).first()
    assert (view["view_w"], view["view_h"]) == (666, 666)
    for x, y, message in ((0.0, 0.25, "Unable to parse mpp."), (0.25, 3.0, "anisotropic")):
        with pytest.raises(Exception, match=message):
            slide.check_mpp(x, y)
        with pytest.raises(Exception, match=message):
            spark.range(1).select(slide.checked_mpp(F.lit(x), F.lit(y))).collect()


def test_mpp_from_tags(spark):
    tags = lambda v, x, y: F.create_map(*(F.lit(t) for kv in {"openslide.library-version": v, "openslide.vendor": "generic-tiff", "tiff.ResolutionUnit": "centimeter", "tiff.XResolution": x, "tiff.YResolution": y}.items() for t in kv))
    got = spark.range(1).select(*slide.mpp_from_tiff(tags("3.4.1", "254", "127")), *slide.mpp_from_tiff(tags("4.0.0", "254", "254"))).first()
    assert tuple(got) == (39.37007874015748, 78.74015748031496, None, None)


def test_colors(spark):
    got = spark.range(1).select(color.hex_to_rgb(F.lit("#f96400")), color.hex_to_rgb(F.lit("black")), color.parse_rgba(F.lit("rgba(1, 2,3,1.0)")), color.color_lut({1: (0, 128, 0)})).first()
    assert got[0] == [249, 100, 0] and got[1] == [0, 0, 0] and got[2] == [1, 2, 3]
    assert [len(b) for b in got[3]] == [256] * 3 and got[3][1][1] == 128 * 256 and got[3][0][1] == 0
    with pytest.raises(Exception, match="alpha"):
        spark.range(1).select(color.parse_rgba(F.lit("rgba(1,2,3,0.5)"))).collect()


def image(w, h, bands):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * 7 + y * 3 + 40 * b) % 251 for b in range(bands)], -1).astype(np.uint8)


@pytest.mark.parametrize("compression", ["none", "deflate", "packbits", "zstd"])
@pytest.mark.parametrize("w,h,bands", [(300, 200, 3), (256, 512, 1), (1024, 256, 4)])
def test_tiff_round_trip(spark, tmp_path, w, h, bands, compression):
    path, pixels = str(tmp_path / "x.tiff"), image(w, h, bands)
    tiff.TiffWriter(path, (w, h, bands), (1.0, 0.999), (128, 128), compression=compression).from_image(pixels)
    about = tiff.describe(path)
    assert (about["width"], about["height"]) == (w, h) and about["mpp"] == pytest.approx((1.0, 0.999))
    with tiff.open_file(path) as f:
        page = tiff.read_pages(f)[0]
        assert (tiff.read_window(f, page, 0, 0, w, h) == pixels).all()
        assert (tiff.read_window(f, page, 100, 50, 57, 38) == pixels[50:88, 100:157]).all()
        with pytest.raises(ValueError):
            tiff.read_window(f, page, w - 1, 0, 2, 2)
    spark.dataSource.register(tiff.TiledTiff)
    rows = spark.read.format("tiled_tiff").load(path)
    assert rows.count() == page.grid[0] * page.grid[1]
    few = spark.read.format("tiled_tiff").option("level", 0).option("x", 130).option("y", 10).option("w", 20).option("h", 20).load(path).collect()
    assert [(r["tile_row"], r["tile_col"]) for r in few] == [(0, 1)]
    assert (np.frombuffer(few[0]["data"], np.uint8).reshape(few[0]["height"], few[0]["width"], bands) == pixels[:128, 128:256]).all()


def test_pyramid(tmp_path):
    path, pixels = str(tmp_path / "p.tiff"), image(2173, 1010, 1)
    tiff.TiffWriter(path, (2173, 1010, 1), (0.5, 0.5), (128, 128), pyramid=True).from_image(pixels)
    with tiff.open_file(path) as f:
        pages = tiff.read_pages(f)
        assert [p.size for p in pages] == [(2173 // 2**k, 1010 // 2**k) for k in range(4)]
        second = tiff.read_window(f, pages[1], 0, 0, *pages[1].size)
    mean = pixels[:1010, :2172].reshape(505, 2, 1086, 2).mean((1, 3))
    assert np.abs(second[..., 0] - mean).max() <= 0.5
    assert [round(v["mpp_x"], 6) for v in tiff.describe(path)["levels"]] == [0.5, 1.0, 2.0, 4.0]


def test_mask_pyramid_and_colormap(tmp_path):
    path, pixels = str(tmp_path / "m.tiff"), np.kron(np.array([[0, 1], [2, 3]]), np.ones((128, 128), int)).astype(np.uint8)[..., None]
    tiff.TiffWriter(path, (256, 256, 1), (1, 1), (64, 64), pyramid=True, is_mask=True, colormap={1: (0, 128, 0)}).from_image(pixels)
    with tiff.open_file(path) as f:
        pages = tiff.read_pages(f)
        assert len(pages[0].tags[tiff.COLOR_MAP]) == 768 and pages[0].one(tiff.PHOTOMETRIC) == 3
        assert (tiff.read_window(f, pages[1], 0, 0, 128, 128) == pixels[::2, ::2]).all()
    with pytest.raises(ValueError):
        tiff.TiffWriter(path, (256, 256, 3), (1, 1), colormap={1: (0, 0, 0)})
    with pytest.raises(RuntimeError):
        tiff.TiffWriter(path, (10, 10, 1), (1, 1)).from_image(pixels[:10, :10])
    with pytest.raises(NotImplementedError):
        tiff.TiffWriter(path, (10, 10, 1), (1, 1), compression="jpeg")
    with pytest.raises(FileNotFoundError):
        tiff.describe(str(tmp_path / "none.tiff"))


@pytest.mark.parametrize("scaling", [2.0, 1.0, 1 / 3, 1 / 7])
@pytest.mark.parametrize("x,y", [(0, 0), (4, 6), (11, 9)])
def test_region_reads_have_the_size_asked_for(spark, base, scaling, x, y):
    levels = [tiff.tile_batches(image(1000 // 2**k, 1000 // 2**k, 3), "a", (256, 256), k).to_pylist() for k in range(3)]
    table = spark.createDataFrame([tuple(r.values()) for v in levels for r in v], tiff.TILE_TABLE)
    region = base.withColumns({"region_index": F.lit(0), "x": F.lit(float(x)), "y": F.lit(float(y)), "w": F.lit(57), "h": F.lit(38), "scaling": F.lit(float(scaling))})
    got = R.read_regions(region, table, 256).first()
    assert (got["width"], got["height"], got["bands"]) == (57, 38, 3)
    if scaling == 1:
        assert (np.frombuffer(got["data"], np.uint8).reshape(38, 57, 3) == image(1000, 1000, 3)[y : y + 38, x : x + 57]).all()


def test_constant_image_stays_constant():
    assert (R.resize(np.full((50, 40, 3), 77, np.uint8), (1.3, 2.1, 33.7, 44.2), (20, 30)) == 77).all()
    assert R.flatten_alpha(np.zeros((2, 2, 4), np.uint8)).min() == 255


def test_boundary_modes(spark, base):
    rows = base.withColumns({"x": F.lit(-3.0), "y": F.lit(995.0), "w": F.lit(10), "h": F.lit(10), "view_w": F.lit(1000), "view_h": F.lit(1000)})
    names = ("read_x", "read_y", "read_w", "read_h", "paste_x", "paste_y", "out_w", "out_h")
    of = lambda mode: tuple(R.boundary(rows, mode).first()[k] for k in names)
    assert of("zero") == (0.0, 995.0, 7, 5, 3, 0, 10, 10)
    assert of("crop") == (0.0, 995.0, 7, 5, 0, 0, 7, 5)
    assert of(None)[-2:] == (10, 10)
    bad = spark.range(1).select(R.check_region(*(F.lit(v) for v in (5, 5, 8, 0, 10, 10))))
    with pytest.raises(Exception, match="outside"):
        bad.collect()
