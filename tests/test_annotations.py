import json

import pytest
from pyspark.sql import functions as F

from tilewright.errors import AnnotationError
from tilewright.functions import geometry as G
from tilewright.model import ANNOTATIONS, annotation_class
from tilewright.operators import annotations as A
from tilewright.sources import darwin, geojson, xml

GLAND = [(11826, 12804), (11818, 12808), (11804, 12826), (11788, 12860), (11778, 12874), (11858, 12874), (11862, 12858), (11844, 12814), (11842, 12810)]
ASAP = """<?xml version="1.0"?><ASAP_Annotations><Annotations>
<Annotation Name="a" Type="Polygon" PartOfGroup="healthy glands" Color="#f96400"><Coordinates>{c}</Coordinates></Annotation>
<Annotation Name="p" Type="Dot" PartOfGroup="healthy glands" Color="black"><Coordinates><Coordinate Order="0" X="1" Y="2"/></Coordinates></Annotation>
<Annotation Name="r" Type="Rectangle" PartOfGroup="other" Color="black"><Coordinates><Coordinate Order="0" X="0,5" Y="0"/><Coordinate Order="1" X="2,5" Y="0"/><Coordinate Order="2" X="2,5" Y="1"/><Coordinate Order="3" X="0,5" Y="1"/></Coordinates></Annotation>
</Annotations></ASAP_Annotations>"""


@pytest.fixture(scope="module")
def asap(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("asap") / "a.xml"
    path.write_text(ASAP.format(c="".join(f'<Coordinate Order="{i}" X="{x}" Y="{y}"/>' for i, (x, y) in enumerate(GLAND))))
    return xml.read_asap(spark, str(path), "s")


def region(spark, x, y, w, h, scaling=1.0):
    return spark.createDataFrame([("s", 0, float(x), float(y), w, h, scaling)], "slide_id string, region_index int, x double, y double, w int, h int, scaling double")


def test_asap(spark, asap):
    rows = asap.orderBy("layer_idx").collect()
    assert [(r["label"], r["annotation_type"]) for r in rows] == [("healthy glands", "POLYGON"), ("other", "BOX")]
    assert rows[0]["color"] == [249, 100, 0] and rows[1]["color"] == [0, 0, 0]
    assert rows[1]["rings"][0][0]["x"] == 0.5
    got = A.read_regions(region(spark, 10000, 10000, 5000, 5000), A.filter_labels(asap, "healthy glands"))
    assert [r["a"] for r in got.select(G.polygon_area(F.col("rings")).alias("a")).collect()] == [3756.0]
    assert A.read_regions(region(spark, 3, 3, 5000, 5000), asap).count() == 0
    assert A.filter_labels(asap, "non-existing").count() == 0
    assert A.contains(asap, "other") and not A.contains(asap, "none")


def test_geojson_round_trip(spark, asap, tmp_path):
    doc = geojson.documents(asap, spark.createDataFrame([("s", "t1")], "slide_id string, tag string")).first()["document"]
    path = tmp_path / "s.geojson"
    path.write_text(doc)
    back = geojson.read(spark, str(path))
    key = lambda df: sorted((r["layer_idx"], r["label"], r["annotation_type"], str(r["rings"]), str(r["color"])) for r in df.collect())
    assert key(back) == key(asap)
    assert [r["tag"] for r in geojson.read_tags(spark, str(path), "s").collect()] == ["t1"]


def test_geojson_kinds(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    feature = lambda kind, c, **p: {"type": "Feature", "id": "x", "geometry": {"type": kind, "coordinates": c}, "properties": p}
    name = {"classification": {"name": "UT", "color": [255, 0, 0]}}
    made = [feature("Polygon", [square], **name), feature("Point", [1, 2], objectType="annotation", name="I"), feature("MultiPoint", [[1, 1], [2, 2]], **name), feature("MultiPolygon", [[square], [square]], **name)]
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    got = geojson.read(spark, str(path)).orderBy("layer_idx").collect()
    assert [r["annotation_type"] for r in got] == ["BOX", "POINT", "POINT", "POINT", "POLYGON", "POLYGON"]
    assert [r["layer_idx"] for r in got] == list(range(6)) and got[1]["label"] == "I" and got[0]["color"] == [255, 0, 0]
    for bad in (feature("LineString", [[1, 1]], **name), feature("Point", [1, 2], name="unlabelled")):
        path.write_text(json.dumps({"features": [bad]}))
        with pytest.raises(Exception, match="unsupported geometry|without a label"):
            geojson.read(spark, str(path)).collect()


def test_many_files_in_one_job(spark, tmp_path):
    """A file a slide by name, in a folder; and files of one slide in the order given."""
    dot = lambda x: json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, 0]}, "properties": {"classification": {"name": "p"}}}], "metadata": {"tags": [f"t{x}"]}})
    names = ["b one.json", "a.v2.json", "c.json"]
    for k, name in enumerate(names):
        (tmp_path / name).write_text(dot(k))
    got = {r["slide_id"]: r["rings"][0][0]["x"] for r in geojson.read(spark, str(tmp_path)).collect()}
    assert got == {"b one": 0.0, "a.v2": 1.0, "c": 2.0}
    assert {(r["slide_id"], r["tag"]) for r in geojson.read_tags(spark, str(tmp_path)).collect()} == {("b one", "t0"), ("a.v2", "t1"), ("c", "t2")}
    for order in ([2, 0, 1], [1, 2, 0]):
        paths = [str(tmp_path / names[k]) for k in order]
        rows = geojson.read(spark, paths, slide_id="s").orderBy("layer_idx").collect()
        assert [r["rings"][0][0]["x"] for r in rows] == order and {r["slide_id"] for r in rows} == {"s"}
        assert [r["tag"] for r in geojson.read_tags(spark, paths, "s").collect()] == [f"t{order[-1]}"]
    for k in range(3):
        (tmp_path / f"h{k}.xml").write_text(f'<Annotations><Annotation Name="L" LineColor="1"><Regions><Region Type="Pin"><Vertices><V X="{k}" Y="0"/></Vertices></Region></Regions></Annotation></Annotations>')
    assert {r["slide_id"]: r["rings"][0][0]["x"] for r in xml.read_halo(spark, str(tmp_path / "h*.xml")).collect()} == {f"h{k}": float(k) for k in range(3)}


def test_halo(spark, tmp_path):
    path = tmp_path / "h.xml"
    v = lambda *p: "<Vertices>" + "".join(f'<V X="{x}" Y="{y}"/>' for x, y in p) + "</Vertices>"
    path.write_text(f'<Annotations><Annotation Name="L" LineColor="65535"><Regions><Region Type="Rectangle">{v((1, 2), (5, 8))}</Region><Region Type="Pin">{v((3, 4))}</Region><Region Type="Ellipse">{v((0, 0), (4, 2))}</Region><Region Type="Polygon">{v((0, 0), (4, 0), (0, 4))}</Region></Regions></Annotation></Annotations>')
    got = xml.read_halo(spark, str(path), "s").orderBy("layer_idx").collect()
    assert [r["annotation_type"] for r in got] == ["BOX", "POINT", "POLYGON", "POLYGON"] and got[0]["color"] == [255, 255, 0]
    slides = spark.createDataFrame([("s", 10, 20)], "slide_id string, offset_x int, offset_y int")
    assert A.shifted(xml.read_halo(spark, str(path), "s"), slides).filter("annotation_type = 'POINT'").first()["rings"][0][0]["x"] == 13.0


def test_darwin(spark, tmp_path):
    path, meta = tmp_path / "d.json", tmp_path / "m.json"
    xy = lambda *p: [{"x": a, "y": b} for a, b in p]
    ring = lambda a, b: xy((a, a), (b, a), (b, b), (a, b))
    made = [
        {"name": "tag1", "tag": {}}, {"name": "A", "polygon": {"path": ring(0, 4)}}, {"name": "B", "keypoint": {"x": 1, "y": 2}},
        {"name": "A", "polygon": {"paths": [ring(0, 10), ring(2, 4), ring(20, 22)]}}, {"name": "A", "bounding_box": {"x": 1, "y": 1, "w": 2, "h": 3}},
    ]
    path.write_text(json.dumps({"annotations": made}))
    meta.write_text(json.dumps({"classes": [{"name": "A", "type": "polygon", "color": "rgba(1,2,3,1.0)"}, {"name": "B", "type": "keypoint", "color": "rgba(4,5,6,1.0)"}, {"name": "R", "type": "raster_layer", "color": "rgba(4,5,6,1.0)"}]}))
    got = darwin.read(spark, str(path), "s", str(meta), z_indices={"A": 3}).orderBy("layer_idx").collect()
    assert [(r["annotation_type"], len(r["rings"]), r["z_index"]) for r in got] == [("POLYGON", 1, 3), ("POINT", 1, None), ("POLYGON", 2, 3), ("POLYGON", 1, 3), ("BOX", 1, 3)]
    assert got[0]["color"] == [1, 2, 3]
    assert [r["tag"] for r in darwin.read_tags(spark, str(path), "s").collect()] == ["tag1"]
    path.write_text(json.dumps({"annotations": [{"name": "A", "raster_layer": {"dense_rle": []}}]}))
    with pytest.raises(NotImplementedError):
        darwin.read(spark, str(path), "s")


@pytest.fixture(scope="module")
def layers(spark):
    ring = lambda x, w: [[(float(x), 0.0), (float(x + w), 0.0), (float(x + w), 2.0), (float(x), 2.0)]]
    rows = [("s", 0, "a", "POLYGON", [1, 2, 3], 2, ring(0, 2)), ("s", 1, "b", "POINT", None, None, [[(5.0, 5.0)]]), ("s", 2, "a", "BOX", None, 1, ring(1, 9)), ("s", 3, "b", "POINT", None, None, [[(6.0, 7.0)]])]
    return spark.createDataFrame(rows, ANNOTATIONS).cache()


@pytest.mark.parametrize("how,order", [("AREA", [2, 0, 1, 3]), ("Z_INDEX", [2, 0, 1, 3]), ("REVERSE", [3, 2, 1, 0]), ("NONE", [0, 1, 2, 3])])
def test_sorting(layers, how, order):
    made = A.sort_layers(layers.withColumn("was", F.col("layer_idx")), how).orderBy("layer_idx")
    assert [r["was"] for r in made.collect()] == order


def test_classes_points_box_labels(spark, layers):
    assert A.available_classes(layers).count() == 3
    got = A.points_by_label(layers).first()["points"]
    assert {k: [tuple(p) for p in v] for k, v in got.items()} == {"b": [(5.0, 5.0), (6.0, 7.0)]}
    others = spark.createDataFrame([("s",), ("t",)], "slide_id string")
    assert {tuple(r) for r in A.bounding_box(layers, others).collect()} == {("s", 0.0, 0.0, 10.0, 7.0), ("t", 0.0, 0.0, 0.0, 0.0)}
    renamed = A.rename_labels(layers, {"a": "z"}).collect()
    assert {r["label"] for r in renamed} == {"z", "b"} and all(r["color"] is None and r["z_index"] is None for r in renamed)
    with pytest.raises(ValueError):
        A.check_labels(layers, {"b": 1})
    with pytest.raises(Exception, match="index map"):
        A.with_index(layers, {"b": 1}).collect()
    with pytest.raises(AnnotationError):
        A.with_z_index(layers, {})


def test_points_on_the_edge_count(spark, layers):
    seen = A.read_regions(region(spark, 5, 5, 1, 2), layers.filter("annotation_type = 'POINT'"))
    assert sorted((p["rings"][0][0]["x"], p["rings"][0][0]["y"]) for p in seen.collect()) == [(0.0, 0.0), (1.0, 2.0)]
    touching = A.read_regions(region(spark, 10, 0, 5, 5), layers.filter("annotation_type = 'BOX'"))
    assert touching.count() == 0


def test_class_checks():
    assert annotation_class("x", "box", z_index=3)["annotation_type"] == "BOX"
    with pytest.raises(ValueError):
        annotation_class("x", "point", z_index=1)
    with pytest.raises(ValueError):
        annotation_class("x", "circle")


def test_equality_and_wkt(spark, layers):
    pair = layers.select(F.struct(*layers.columns).alias("a"))
    assert pair.filter(G.same_annotation(F.col("a"), F.col("a"))).count() == 4
    other = pair.withColumn("b", F.struct(*(F.col(f"a.{c}") if c != "z_index" else F.lit(9).alias("z_index") for c in layers.columns)))
    assert [r["same"] for r in other.orderBy("a.layer_idx").select(G.same_annotation(F.col("a"), F.col("b")).alias("same")).collect()] == [False, True, False, True]
    assert layers.orderBy("layer_idx").select(G.wkt(F.col("annotation_type"), F.col("rings")).alias("w")).collect()[1]["w"] == "POINT (5.0 5.0)"
