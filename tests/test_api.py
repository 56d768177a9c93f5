import numpy as np
import pytest
from pyspark.sql import functions as F

import tilewright as tw
from tilewright.functions import geometry as G
from tilewright.operators import rasterize, samples
from tilewright.sources import slides, tiff

from .test_pixels import image


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("api") / "s.tiff")
    tiff.TiffWriter(path, (600, 400, 3), (0.5, 0.5), (128, 128), pyramid=True).from_image(image(600, 400, 3))
    spark.dataSource.register(tiff.TiledTiff)
    table = slides.read_slides(spark, [path])
    box = spark.range(1).select(F.lit("s").alias("slide_id"), F.lit(0).alias("layer_idx"), F.lit("tumour").alias("label"), F.lit("BOX").alias("annotation_type"), F.lit(None).cast("array<int>").alias("color"), F.lit(None).cast("int").alias("z_index"), G.box_rings(*(F.lit(float(v)) for v in (90, 90, 60, 20))).alias("rings"))
    return path, table, spark.read.format("tiled_tiff").load(path), box


def test_samples_have_everything(spark, one):
    _, table, pixels, box = one
    labels = spark.createDataFrame([("s", "grade", 3)], "slide_id string, name string, value int")
    got = samples.tile_samples(table, 0.5, (100, 100), annotations=box, labels=labels, tile_table=pixels, stored_tile=128).orderBy("sample_index").collect()
    assert len(got) == 24 and [r["region_index"] for r in got] == list(range(24))
    first = got[0]
    assert first["labels"] == {"grade": "3"} and first["coordinates"] == (0.0, 0.0) and first["mpp"] == pytest.approx(0.5)
    assert (np.frombuffer(first["image"]["data"], np.uint8).reshape(100, 100, 3) == image(600, 400, 3)[:100, :100]).all()
    assert sum(len(r["annotations"] or []) for r in got) == 4
    assert {(p["x"], p["y"]) for p in first["annotations"][0]["rings"][0]} == {(90, 90), (100, 90), (100, 100), (90, 100)}


def test_mask_comes_first_and_edges_are_padded(one):
    _, table, pixels, box = one
    got = samples.tile_samples(table, 0.5, (100, 100), mask=box, mask_threshold=0.04, tile_table=pixels, stored_tile=128).collect()
    assert sorted(r["region_index"] for r in got) == [1, 7]
    edge = samples.tile_samples(table, 0.5, (350, 300), tile_table=pixels, stored_tile=128).orderBy("sample_index").collect()
    last = edge[-1]["image"]
    pixels_ = np.frombuffer(last["data"], np.uint8).reshape(last["height"], last["width"], 3)
    assert pixels_.shape == (300, 350, 3) and not pixels_[100:].any() and (pixels_[:100, :250] == image(600, 400, 3)[300:, 350:]).all()
    cropped = samples.tile_samples(table, 0.5, (350, 300), crop=True, tile_table=pixels, stored_tile=128).orderBy("sample_index").collect()[-1]
    assert (cropped["w"], cropped["h"], cropped["image"]["width"], cropped["image"]["height"]) == (250, 100, 250, 100)


def test_dataset(one):
    _, table, _, box = one
    data = tw.TileDataset.from_standard_tiling(table, 0.5, (100, 100), annotations=box)
    assert len(data) == 24 and data[-1]["region_index"] == 23 and [r["ordinal"] for r in data[2:7:2]] == [2, 4, 6]
    both = data + data
    assert len(both) == 48 and both[24]["region_index"] == 0 and both[24]["dataset"] == 1
    assert [r["ordinal"] for r in both][:3] == [0, 1, 2]
    assert data.transform(lambda t: t.filter("annotations IS NOT NULL")).table.count() == 4
    with pytest.raises(ValueError):
        data[24]


def test_sample_masks(one):
    _, table, _, box = one
    made = samples.tile_samples(table, 0.5, (100, 100), annotations=box, mask=box, mask_threshold=0.04)
    layers = made.select("slide_id", "region_index", F.inline("annotations"))
    got = rasterize.to_masks(layers, made, {"tumour": 2}, size=(100, 100)).orderBy("region_index").first()["mask"]
    assert {v for r in got[90:] for v in r[:51]} == {2} and got[0][0] == 0


def test_slide(one):
    s = tw.Slide(one[0])
    assert s.size == (600, 400) and s.scaling(None) == 1.0 and s.scaled_size(0.5) == (300, 200) and s.aspect_ratio == 1.5
    assert s.closest_native_level(1.1) == 1 and "levels=3" in repr(s)
    assert s.read_region((0, 0), 1.0, (10, 10)).shape == (10, 10, 3) and s.thumbnail((60, 60)).shape == (40, 60, 3)


def test_annotation_set(spark, one, tmp_path):
    import json

    made = tw.AnnotationSet(one[3])
    assert "tumour" in made and "other" not in made and len(made) == 1
    doc = made.as_geojson()["s"]
    assert doc["features"][0]["properties"]["classification"]["name"] == "tumour"
    path = tmp_path / "s.geojson"
    path.write_text(json.dumps(doc))
    back = tw.AnnotationSet.from_geojson(spark, str(path))
    assert back.layers.first()["rings"] == one[3].first()["rings"] and back.bounding_box().first()["w"] == 60
    assert back.rename({"tumour": "x"}).filter("x").sort("AREA").available_classes().count() == 1
    assert back.wkt().first()["wkt"].startswith("POLYGON ((90.0 90.0")
