import json
import types

import numpy as np
import pytest

from tilewright import cli
from tilewright.errors import UnsupportedSlideError
from tilewright.log import setup_logging
from tilewright.operators.tiling import standard_tiling
from tilewright.sources import slides, tiff
from tilewright.streaming import tiles as stream

from .test_pixels import image


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("slides") / "one.tiff")
    tiff.TiffWriter(out, (600, 400, 3), (0.5, 0.5), (128, 128), pyramid=True).from_image(image(600, 400, 3))
    return out


def test_read_slides_and_tile(spark, path):
    rows = slides.read_slides(spark, [path])
    got = rows.first()
    assert (got["slide_id"], got["width"], got["height"], len(got["levels"])) == ("one", 600, 400, 3)
    assert got["mpp"] == pytest.approx(0.5) and got["properties"]["bands"] == "3"
    assert standard_tiling(rows, 1.0, (100, 100)).count() == 6


def test_backends(path):
    with pytest.raises(ValueError):
        slides.open_slide(path, "none")
    with pytest.raises(TypeError):
        slides.open_slide(path, 3)
    with pytest.raises(ModuleNotFoundError):
        slides.open_slide(path, "openslide")
    with pytest.raises(FileNotFoundError):
        slides.open_slide(path + "x")
    with pytest.raises(UnsupportedSlideError):
        slides.open_slide(path, overwrite_mpp=(1.2, 4.4))

    class Own:
        def open(self, p):
            return {"width": 10, "height": 10, "mpp": None, "levels": [{"level": 0, "width": 10, "height": 10, "downsample": 1.0}], "properties": {}}

        def read_window(self, p, level, x, y, w, h):
            return np.full((h, w, 1), 9, np.uint8)

    assert (slides.read_region("x", (1, 1), 1.0, (4, 3), backend=Own(), overwrite_mpp=(1.0, 1.0)) == 9).all()
    slides.register("own", Own())
    with pytest.raises(UnsupportedSlideError):
        slides.open_slide("x", "own")
    assert slides.open_slide("x", Own(), (1.0, 1.0))["mpp"] == 1.0


def test_library_backends(path, monkeypatch):
    """Both adapters over stand-ins for their libraries that serve the TIFF file's pixels."""
    pixels = image(600, 400, 3)

    class FakeOpenSlide:
        def __init__(self, p):
            self.dimensions, self.level_dimensions, self.level_downsamples = (600, 400), [(600, 400), (300, 200)], (1.0, 2.0)
            self.properties = {"openslide.mpp-x": "0.5", "openslide.mpp-y": "0.5", "openslide.bounds-x": "7", "openslide.vendor": "v"}
            self.associated_images = {"label": pixels[:4, :5]}

        def read_region(self, at, level, size):
            step = 2**level
            return pixels[at[1] :: step, at[0] :: step][: size[1], : size[0]]

    class FakeImage:
        def __init__(self, pixels, **fields):
            self.pixels, self.fields = pixels, fields
            self.height, self.width = pixels.shape[:2]
            self.xres = self.yres = 2000.0

        @classmethod
        def new_from_file(cls, p, page=0, associated=None):
            return cls(pixels[:3, :3]) if associated else cls(pixels[:: 2**page, :: 2**page], **{"n-pages": 2, "slide-associated-images": "macro, label"})

        def get_fields(self):
            return list(self.fields)

        def get(self, k):
            return self.fields[k]

        def crop(self, x, y, w, h):
            return FakeImage(self.pixels[y : y + h, x : x + w])

        def numpy(self):
            return self.pixels

    modules = {"openslide": types.SimpleNamespace(OpenSlide=FakeOpenSlide), "pyvips": types.SimpleNamespace(Image=FakeImage)}
    for cls in (slides.OpenSlideBackend, slides.VipsBackend):
        monkeypatch.setattr(cls, "library", lambda self: modules[self.module])
    for name in ("openslide", "vips"):
        s = slides.open_slide(path + name, name)
        assert (s["width"], s["mpp"], [v["downsample"] for v in s["levels"]]) == (600, 0.5, [1.0, 2.0])
        assert (slides.read_region(path + name, (10, 20), 1.0, (50, 40), backend=name) == pixels[20:60, 10:60]).all()
        assert slides.read_region(path + name, (5, 5), 0.5, (60, 30), backend=name).shape == (30, 60, 3)
    assert slides.open_slide(path + "openslide", "openslide")["offset_x"] == 7
    assert slides.associated_images(path, "openslide")["label"].shape == (4, 5, 3) and set(slides.associated_images(path, "vips")) == {"macro", "label"}
    assert slides.associated_images(path) == {}


def test_whole_pixels(path):
    pixels = image(600, 400, 3)
    assert (slides.read_region(path, (10, 20), 1.0, (50, 40), whole_pixels=True) == pixels[20:60, 10:60]).all()
    wide = slides.read_region(path, (31, 0), 2.0, (20, 10), "NEAREST", whole_pixels=True)
    assert (wide[0, :, 0] == pixels[0, 15 + ((np.arange(20) + 0.5) * (26 - 15) / 20).astype(int), 0]).all()


def test_regions_and_thumbnail(path):
    assert (slides.read_region(path, (10, 20), 1.0, (50, 40)) == image(600, 400, 3)[20:60, 10:60]).all()
    assert slides.read_region(path, (0, 0), 0.3, (180, 120)).shape == (120, 180, 3)
    with pytest.raises(ValueError):
        slides.read_region(path, (590, 0), 1.0, (50, 40))
    assert slides.thumbnail(path, (300, 150)).shape[:2] == (150, 225)


def test_resample_and_cli(path, tmp_path, capsys):
    out = str(tmp_path / "half.tiff")
    assert cli.main(["resample", path, out, "--mpp", "1.0", "--tile", "128"]) == 0
    assert (slides.open_slide(out)["width"], slides.open_slide(out)["mpp"]) == (300, pytest.approx(1.0))
    smooth = slides.read_region(path, (0, 0), 0.5, (300, 200)).astype(int)
    stored = slides.read_region(out, (0, 0), 1.0, (300, 200)).astype(int)
    assert np.abs(smooth - stored)[:120, :120].max() <= 1
    assert cli.main(["info", out, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["width"] == 300
    assert cli.main(["info", out]) == 0 and "height\t200" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["info", out + "x"])


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame([("a", 500, 300, 0.5), ("b", 200, 200, 0.25)], "slide_id string, width int, height int, mpp double")
    rows.write.parquet(str(tmp_path / "in"))
    made = stream.tile_stream(stream.read_slides(spark, str(tmp_path / "in"), rows.schema), 0.5, (64, 64))
    q = stream.write_tiles(made, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    got, want = spark.read.parquet(str(tmp_path / "out")), standard_tiling(rows, 0.5, (64, 64))
    key = lambda df: sorted((r["slide_id"], r["region_index"], r["x"], r["y"]) for r in df.collect())
    assert key(got) == key(want)


def test_logging(tmp_path):
    log = setup_logging("DEBUG", str(tmp_path / "logs" / "x.log"))
    log.info("hello")
    assert "hello" in (tmp_path / "logs" / "x.log").read_text() and len(log.handlers) == 2
    assert len(setup_logging("INFO").handlers) == 1
    with pytest.raises(ValueError):
        setup_logging("LOUD")
