"""Queries over files and documents made from the standard tables: each is written, read back and held to SQL over the
tables themselves. Importing this module registers them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import AnnotationSet
from ..functions import color as colors
from ..functions import geometry as G
from ..functions import slide as S
from ..model import annotation_class
from ..operators import annotations as A
from ..operators import clip
from ..operators import raster as R
from ..operators import samples
from ..operators import tiling as T
from ..sources import darwin, geojson, slides, tiff, xml
from . import derive as D
from .catalogue import IMAGE, SCALE, SHAPES_AND, WKT_SQL, _image, _tiles, _with, query


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one on a local master."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tilewright-")
    path = f"{there.removeprefix('file:').rstrip('/')}/files/{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _contents(rows: DataFrame, item, head: str, tail: str) -> DataFrame:
    """A document for each slide from one item of text for each annotation, in order of layers."""
    made = rows.select("slide_id", F.struct("layer_idx", item.alias("t")).alias("s")).groupBy("slide_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), ",").alias("t"))
    return made.select("slide_id", F.lit(0).alias("file"), F.lit("").alias("path"), F.concat(F.lit(head), F.col("t"), F.lit(tail)).alias("content"))


def _xml(rows: DataFrame, item, head: str, tail: str) -> DataFrame:
    made = _contents(rows, item, "", "")
    return made.withColumn("content", F.concat(F.lit(head), F.replace("content", F.lit(">,<"), F.lit("><")), F.lit(tail)))


HUE = ", ".join(f"(ascii(label) * {k} % 256)::BIGINT AS {c}" for k, c in ((3, "r"), (5, "g"), (7, "b")))
KIND = "CASE WHEN annotation_type = 'POLYGON' AND aw = ah THEN 'BOX' ELSE annotation_type END"


def _rgb():
    return [F.col("color")[k].alias(c) for k, c in enumerate("rgb")]



def _wkt():
    return G.wkt(F.col("annotation_type"), F.col("rings")).alias("wkt")


# --- annotation documents


@query(_with(*SHAPES_AND, select=f"SELECT slide_id, layer_idx::BIGINT AS layer_idx, label, {KIND} AS annotation_type, {HUE}, {WKT_SQL} AS wkt FROM annotations"))
def ann_geojson(spark, sf_dir):
    """A GeoJSON document for each slide, parsed again: a turned square is a box."""
    docs = geojson.documents(D.annotations(spark, sf_dir))
    back = geojson.parse(docs.select("slide_id", F.lit(0).alias("file"), F.lit("").alias("path"), F.col("document").alias("content")))
    return back.select("slide_id", "layer_idx", "label", "annotation_type", *_rgb(), _wkt())


@query(_with(*SHAPES_AND, select="SELECT slide_id, (2 * layer_idx + k)::BIGINT AS layer_idx, label, CASE WHEN k = 1 THEN 'POINT' ELSE 'POLYGON' END AS annotation_type, (x0 + k)::DOUBLE AS x0 FROM (SELECT *, unnest([0, 1]) AS k FROM shapes WHERE annotation_type = 'POINT') ORDER BY ALL").replace("(2 * layer_idx + k)", "(row_number() OVER (PARTITION BY slide_id ORDER BY k, layer_idx) - 1)"))
def geojson_files(spark, sf_dir):
    """Two documents a slide, multi-part geometries in both, numbered in the order of the files."""
    p = D.annotations(spark, sf_dir).filter("annotation_type = 'POINT'").withColumn("p", F.col("rings")[0][0])
    square = F.format_string('{"type":"Feature","id":"a","geometry":{"type":"MultiPolygon","coordinates":[[[[%s,0],[%s,0],[%s,9],[%s,0]]]]},"properties":{"classification":{"name":"%s"}}}', "p.x", F.col("p.x") + 1, F.col("p.x") + 1, "p.x", "label")
    points = F.format_string('{"type":"Feature","id":"b","geometry":{"type":"MultiPoint","coordinates":[[%s,%s]]},"properties":{"objectType":"annotation","name":"%s"}}', F.col("p.x") + 1, "p.y", "label")
    head, tail = '{"type":"FeatureCollection","features":[', "]}"
    first, second = _contents(p, square, head, tail), _contents(p, points, head, tail)
    got = geojson.parse(first.unionByName(second.withColumn("file", F.lit(1))))
    return got.select("slide_id", "layer_idx", "label", "annotation_type", F.col("rings")[0][0]["x"].alias("x0"))


@query("SELECT p_partkey AS slide_id, unnest(['s' || p_size, 'k' || (p_partkey % 7)]) AS tag FROM part")
def geojson_tags(spark, sf_dir):
    docs = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.explode(F.array(F.struct(F.lit(0).alias("file"), F.lit('{"features":[],"metadata":{"tags":["old"]}}').alias("content")), F.struct(F.lit(1).alias("file"), F.format_string('{"features":[],"metadata":{"tags":["s%d","k%d"]}}', "p_size", F.col("p_partkey") % 7).alias("content")), F.struct(F.lit(2).alias("file"), F.lit('{"features":[]}').alias("content")))).alias("d"))
    return geojson.parse_tags(docs.select("slide_id", "d.file", F.lit("").alias("path"), "d.content"))


@query(_with(*SHAPES_AND, select=f"SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY area DESC, layer_idx) - 1)::BIGINT AS layer_idx, label, annotation_type, {HUE}, (x0 + 0.5)::DOUBLE AS x0, y0::DOUBLE AS y0, area::DOUBLE AS area FROM shapes WHERE annotation_type <> 'POINT'"))
def ann_asap_xml(spark, sf_dir):
    """ASAP documents with decimal commas and corners out of order; dots are skipped, larger areas come first."""
    corner = lambda p, k: F.format_string('<Coordinate Order="%d" X="%d,5" Y="%d"/>', k, p["x"].cast("int"), p["y"].cast("int"))
    corners = F.array_join(F.reverse(F.transform(F.col("rings")[0], corner)), "")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in (("BOX", "Rectangle"), ("POLYGON", "Spline"), ("POINT", "Dot")) for x in kv)), F.col("annotation_type"))
    item = F.format_string('<Annotation Name="n" Type="%s" PartOfGroup=" %s " Color="%s"><Coordinates>%s</Coordinates></Annotation>', kind, "label", colors.rgb_to_hex(F.col("color")), corners)
    got = xml.parse_asap(_xml(D.annotations(spark, sf_dir), item, "<ASAP_Annotations><Annotations>", "</Annotations></ASAP_Annotations>"))
    b = G.bounds(F.col("rings"))
    return got.select("slide_id", "layer_idx", "label", "annotation_type", *_rgb(), b["x0"].alias("x0"), b["y0"].alias("y0"), G.polygon_area(F.col("rings")).alias("area"))


@query(_with(*SHAPES_AND, select=f"SELECT slide_id, layer_idx::BIGINT AS layer_idx, label, annotation_type, {HUE}, (2 * x0 + offset_x)::DOUBLE AS x0, (2 * y0 + offset_y)::DOUBLE AS y0, (4 * area)::DOUBLE AS area FROM shapes JOIN slides USING (slide_id)"))
def ann_halo_xml(spark, sf_dir):
    """HALO documents: rectangles by two corners, polygons and pins, at twice their size and moved by the bounds."""
    b, ring = G.bounds(F.col("rings")), F.col("rings")[0]
    vertex = lambda x, y: F.format_string('<V X="%d" Y="%d"/>', x.cast("int"), y.cast("int"))
    corners = F.when(F.col("annotation_type") == "BOX", F.concat(vertex(b["x1"], b["y0"]), vertex(b["x0"], b["y1"]))).otherwise(F.array_join(F.transform(ring, lambda p: vertex(p["x"], p["y"])), ""))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in (("BOX", "Rectangle"), ("POLYGON", "Polygon"), ("POINT", "Pin")) for x in kv)), F.col("annotation_type"))
    line = F.col("color")[0] + 256 * F.col("color")[1] + 65536 * F.col("color")[2]
    item = F.format_string('<Annotation Name="%s" LineColor="%d"><Regions><Region Type="%s"><Vertices>%s</Vertices></Region></Regions></Annotation>', "label", line, kind, corners)
    got = A.shifted(xml.parse_halo(_xml(D.annotations(spark, sf_dir), item, "<Annotations>", "</Annotations>"), 2.0), D.slides(spark, sf_dir))
    c = G.bounds(F.col("rings"))
    area = F.when(F.col("annotation_type") == "POINT", F.lit(0.0)).otherwise(G.polygon_area(F.col("rings")))
    return got.select("slide_id", "layer_idx", "label", "annotation_type", *_rgb(), c["x0"].alias("x0"), c["y0"].alias("y0"), area.alias("area"))


def _darwin(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents with every annotation and a tag after each, and the classes' metadata."""
    b, ring = G.bounds(F.col("rings")), F.col("rings")[0]
    box = F.struct(F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h")).alias("bounding_box"))
    shape = F.when(F.col("annotation_type") == "BOX", F.to_json(box)).when(F.col("annotation_type") == "POINT", F.to_json(F.struct(ring[0].alias("keypoint")))).otherwise(F.to_json(F.struct(F.struct(ring.alias("path")).alias("polygon"))))
    item = F.format_string('{"name":"%s",%s,{"name":"t%d","tag":{}}', "label", F.substring(shape, F.lit(2), F.length(shape)), "layer_idx")
    docs = _contents(D.annotations(spark, sf_dir), item, '{"annotations":[', "]}")
    classes = ",".join(f'{{"name":"{c}","type":"polygon","color":"rgba({ord(c) * 3 % 256},{ord(c) * 5 % 256}, {ord(c) * 7 % 256},1.0)"}}' for c in "ANR")
    return docs, darwin.parse_metadata(spark.createDataFrame([(f'{{"classes":[{classes},{{"name":"M","type":"mask","color":"rgba(1,1,1,0.5)"}}]}}',)], "content string"))


@query(_with(*SHAPES_AND, select=f"SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY layer_idx) - 1)::BIGINT AS layer_idx, label, annotation_type, CASE WHEN annotation_type = 'POINT' THEN -1 ELSE CASE label WHEN 'A' THEN 3 WHEN 'N' THEN 1 ELSE 2 END END::BIGINT AS z_index, {HUE}, {WKT_SQL} AS wkt FROM annotations"))
def ann_darwin_json(spark, sf_dir):
    docs, metadata = _darwin(spark, sf_dir)
    got = darwin.parse(docs, metadata, z_indices={"A": 3, "N": 1, "R": 2})
    return got.select("slide_id", "layer_idx", "label", "annotation_type", F.coalesce("z_index", F.lit(-1)).alias("z_index"), *_rgb(), _wkt())


@query(_with(*SHAPES_AND, select="SELECT slide_id, 't' || layer_idx AS tag FROM annotations"))
def darwin_tags(spark, sf_dir):
    return darwin.parse_tags(_darwin(spark, sf_dir)[0])


@query(_with(*SHAPES_AND, select="SELECT slide_id, label, layer_idx::BIGINT AS first_layer, k::BIGINT AS part, CASE k WHEN 0 THEN 2 ELSE 1 END::BIGINT AS n_rings, (CASE k WHEN 0 THEN aw * ah - (aw - 2) * (ah - 2) ELSE 4 END)::DOUBLE AS area FROM (SELECT *, unnest([0, 1]) AS k FROM annotations WHERE annotation_type = 'BOX')"))
def even_odd_rings(spark, sf_dir):
    """Paths of a box, a hole in it and a box apart: a polygon with a hole and one beside it."""
    b = G.bounds(F.col("rings"))
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    apart = G.box_rings(b["x1"] + 9, b["y0"], F.lit(2.0), F.lit(2.0))
    rows = D.annotations(spark, sf_dir).filter("annotation_type = 'BOX'").withColumn("rings", F.concat("rings", G.box_rings(b["x0"] + 1, b["y0"] + 1, w - 2, h - 2), apart))
    parts = rows.select("slide_id", "label", "layer_idx", F.posexplode(clip.even_odd_parts(F.col("rings"))).alias("part", "rings"))
    return parts.select("slide_id", "label", F.col("layer_idx").alias("first_layer"), "part", F.size("rings").alias("n_rings"), G.polygon_area(F.col("rings")).alias("area"))


# --- annotation values


@query(_with(*SHAPES_AND, select="SELECT slide_id, bool_or(label = 'A') AS has_a, bool_or(label = 'A' AND annotation_type = 'POINT') AS has_a_points FROM annotations GROUP BY slide_id"))
def ann_contains(spark, sf_dir):
    return D.annotations(spark, sf_dir).groupBy("slide_id").agg(F.bool_or(A.has("A")).alias("has_a"), F.bool_or(A.has("A", "POINT")).alias("has_a_points"))


@query(_with(*SHAPES_AND, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, CASE WHEN annotation_type = 'POINT' THEN -1 WHEN label = 'A' THEN 7 ELSE 4 END::BIGINT AS z_index FROM annotations"))
def ann_with_zindex(spark, sf_dir):
    got = A.with_z_index(D.annotations(spark, sf_dir), {"A": 7, "N": 4, "R": 4})
    return got.select("slide_id", "layer_idx", F.coalesce("z_index", F.lit(-1)).alias("z_index"))


@query(_with(*SHAPES_AND, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, TRUE AS itself, annotation_type = 'POINT' AS other_z, FALSE AS moved, label = 'A' AS relabelled FROM annotations"))
def ann_equality(spark, sf_dir):
    """An annotation against itself written with a closing point, with another z index, moved, and with the label A."""
    rows = D.annotations(spark, sf_dir).select(F.struct("label", "annotation_type", "color", "z_index", "rings").alias("a"), "slide_id", "layer_idx")
    closed = F.transform("a.rings", lambda r: F.concat(r, F.slice(r, 1, 1)))
    other = {"itself": F.col("a").withField("rings", F.when(F.col("a.annotation_type") == "POINT", F.col("a.rings")).otherwise(closed)), "other_z": F.col("a").withField("z_index", F.lit(99)), "moved": F.col("a").withField("rings", G.map_points(F.col("a.rings"), lambda p: G.point(p["x"] + 1, p["y"]))), "relabelled": F.col("a").withField("label", F.lit("A"))}
    return rows.select("slide_id", "layer_idx", *(G.same_annotation(F.col("a"), b).alias(k) for k, b in other.items()))


@query(_with(*SHAPES_AND, select="SELECT slide_id, layer_idx::BIGINT AS layer_idx, 4::BIGINT AS corners, area::DOUBLE AS area FROM shapes WHERE annotation_type <> 'POINT'"))
def ann_simplified(spark, sf_dir):
    """Shapes with a corner more on each side lose it again."""
    mid = lambda p, q: F.array(p, G.point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2))
    more = F.transform("rings", lambda r: F.flatten(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), mid)))
    rows = D.annotations(spark, sf_dir).filter("annotation_type <> 'POINT'").withColumn("rings", more)
    rows = rows.withColumn("rings", clip.simplified(F.col("rings"), 0.01))
    return rows.select("slide_id", "layer_idx", F.size(F.col("rings")[0]).alias("corners"), G.polygon_area(F.col("rings")).alias("area"))


@query("SELECT p_partkey AS slide_id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END::BIGINT AS g, p_partkey * 3 % 256 AS r, (p_size % 256)::BIGINT AS b, printf('#%02x%02x%02x', p_partkey * 3 % 256, p_size % 256, 7) AS hex FROM part".replace("p_partkey * 3 % 256 AS r", "(p_partkey * 3 % 256)::BIGINT AS r"))
def annotation_colors(spark, sf_dir):
    """Colours of GeoJSON (null unless three numbers), of CSS and as text."""
    size, red = F.col("p_size").cast("int"), (F.col("p_partkey") * 3 % 256).cast("int")
    short = F.when(size % 2 == 0, F.array(F.lit(1), size, F.lit(3))).otherwise(F.array(F.lit(1), size))
    css = colors.parse_rgba(F.format_string("rgba(%d, 9,%d,1.0)", red, size % 256))
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.coalesce(colors.geojson_color(short)[1], F.lit(-1)).alias("g"), css[0].alias("r"), css[2].alias("b"), colors.rgb_to_hex(F.array(red, size % 256, F.lit(7))).alias("hex"))


CLASSES = [annotation_class("A", "box", z_index=2), annotation_class("N", "point"), annotation_class("R", "polygon", color=(1, 2, 3))]


@query("SELECT * FROM (VALUES ('A', 'BOX', 2::BIGINT, -1::BIGINT), ('N', 'POINT', -1, -1), ('R', 'POLYGON', -1, 1)) t(label, annotation_type, z_index, r)")
def annotation_classes(spark, sf_dir):
    rows = [(c["label"], c["annotation_type"], -1 if c["z_index"] is None else c["z_index"], -1 if not c["color"] else c["color"][0]) for c in CLASSES]
    return spark.createDataFrame(rows, "label string, annotation_type string, z_index long, r long")


@query(_with(*SHAPES_AND, select="SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY layer_idx DESC) - 1)::BIGINT AS layer_idx, CASE label WHEN 'A' THEN 'tumour' ELSE label END AS label FROM annotations WHERE label <> 'R'"))
def annotation_set(spark, sf_dir):
    """Filtered, renamed and sorted through the object interface."""
    return AnnotationSet(D.annotations(spark, sf_dir)).filter(["A", "N"]).rename({"A": "tumour"}).sort("REVERSE").layers.select("slide_id", "layer_idx", "label")


# --- grids and samples


@query("SELECT p_partkey AS slide_id, i::BIGINT AS x_index, (4 + 10 * i)::DOUBLE AS x, j::BIGINT AS y_index, (10 * j)::DOUBLE AS y FROM (SELECT *, unnest(range(greatest(0, floor((p_size - 10) / 10.0) + 1)::INT)) AS j FROM (SELECT p_partkey, p_size, unnest(range(greatest(0, floor((2 * p_size - 7) / 10.0) + 1)::INT)) AS i FROM part))")
def grid_mesh(spark, sf_dir):
    """Two axes of tile starts as columns, and their combinations."""
    size = F.col("p_size").cast("double")
    tile, none = F.lit(10.0), F.lit(0.0)
    axes = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), T.axis_coordinates(2 * size + 3, tile, none, "skip", 4.0).alias("xs"), T.axis_coordinates(size, tile, none).alias("ys"))
    return T.indexed_mesh(axes, ["xs", "ys"], ["x", "y"]).select("slide_id", "x_index", "x", "y_index", "y")


@query(_with(D.SLIDES_SQL, select="SELECT slide_id, width - 10 >= 0 AND height - 20 >= 0 AS inside, greatest(0, least((width - 550)::DOUBLE, 600)) AS clipped FROM slides"))
def region_checks(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    return D.slides(spark, sf_dir).select("slide_id", R.check_region(F.lit(10), F.lit(20), w - 10, h - 20, w, h).alias("inside"), R.clip_to_size((w - 550).cast("double"), F.lit(600)).alias("clipped"))


@query(_with(D.SLIDES_SQL, select="SELECT slide_id, printf('slide(%s, size=%dx%d, mpp=%.4f, levels=%d)', slide_id::VARCHAR, width, height, mpp, 3) AS description FROM slides"))
def slide_descriptions(spark, sf_dir):
    return S.describe(D.slides(spark, sf_dir))


@query(_with(D.SLIDES_SQL, D.tiles_sql(SCALE, 128, 128), select="SELECT slide_id, region_index, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy FROM tiles"))
def sample_transform(spark, sf_dir):
    """A function over samples as a function over the table."""
    made = samples.tile_samples(D.slides(spark, sf_dir), 0.5, (128, 128), transform=lambda df: df.withColumns({"cx": F.col("coordinates.x") + F.col("w") / 2, "cy": F.col("coordinates.y") + F.col("h") / 2}))
    return made.select("slide_id", "region_index", "cx", "cy")


@query("SELECT (vec_id // 256) AS slide_id, count(*)::BIGINT AS n FROM embeddings GROUP BY 1".replace("count(*)::BIGINT AS n", "min(vec_id)::BIGINT AS first_vec, count(*)::BIGINT AS n"))
def region_samples(spark, sf_dir):
    """Regions given as rows become samples with dense numbers; here, their first and number by slide."""
    regions = D.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("slide_id"), F.col("vec_id").alias("region_index"))
    made = T.reindexed(regions)
    return made.groupBy("slide_id").agg(F.min_by("region_index", "sample_index").alias("first_vec"), (F.max("sample_index") + 1).alias("n"))


# --- slide files: an image of 64 x 64 bytes for every 64 vectors of 64 components, in tiles of 16 x 16

MOSAIC = """
cells AS (SELECT vec_id // 64 AS slide_id, (vec_id % 64)::BIGINT AS py, k::BIGINT AS px, greatest(0, least(255, floor(embedding[k + 1]::DOUBLE * 128 + 128)))::BIGINT AS value FROM (SELECT vec_id, embedding, unnest(range(64))::INT AS k FROM embeddings)),
files AS (SELECT DISTINCT slide_id FROM cells)"""


def _mosaic(spark, sf_dir) -> DataFrame:
    """Tile table of the images; rows that no vector has are black."""
    one = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 128 + 128)))), 2, "0"))
    rows = D.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("slide_id"), (F.col("vec_id") % 64).cast("int").alias("y"), one.alias("p"))
    cut = rows.select("slide_id", F.floor(F.col("y") / 16).cast("int").alias("tile_row"), (F.col("y") % 16).cast("int").alias("line"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.array_join(F.slice("p", c * 16 + 1, 16), ""))).alias("tile_col", "hex"))
    lines = cut.groupBy("slide_id", "tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct("line", "hex"))).alias("m"))
    full = rows.select("slide_id").distinct().select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile_row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile_col"))
    line = lambda k: F.coalesce(F.try_element_at("m", k), F.lit("00" * 16))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), line), ""))
    return full.join(lines, ["slide_id", "tile_row", "tile_col"], "left").select("slide_id", F.lit(0).alias("level"), "tile_row", "tile_col", F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(1).alias("bands"), data.alias("data"))


def _files(spark, sf_dir, **how) -> str:
    """A folder with a TIFF for each image, at 0.5 micrometres a pixel."""
    folder = scratch(spark)
    table = _mosaic(spark, sf_dir)
    sizes = table.select("slide_id").distinct().select("slide_id", F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit(1).alias("bands"), F.lit(0.5).alias("mpp"))
    tiff.write_slides(table, sizes, folder, (16, 16), **how).write.format("noop").mode("overwrite").save()
    return folder


def _stored(spark, folder: str, **options) -> DataFrame:
    """(slide_id, level, px, py, value) of the stored tiles."""
    spark.dataSource.register(tiff.TiledTiff)
    rows = spark.read.format("tiled_tiff").options(**options).load(folder)
    return _spread(rows.withColumns({"x": F.col("tile_col") * 16, "y": F.col("tile_row") * 16}))


def _spread(rows: DataFrame, *keep: str) -> DataFrame:
    cells = rows.select(F.col("slide_id").cast("long").alias("slide_id"), *keep, *([] if keep else ["level"]), "x", "y", "width", F.posexplode(R.bytes_of(F.col("data"))).alias("k", "value"))
    return cells.select("slide_id", *keep, *([] if keep else ["level"]), (F.col("x") + F.col("k") % F.col("width")).alias("px"), (F.col("y") + F.floor(F.col("k") / F.col("width"))).alias("py"), "value")


@query(_with(MOSAIC, select="SELECT slide_id, 0::BIGINT AS level, px, py, coalesce(value, 0)::BIGINT AS value FROM (SELECT slide_id, unnest(range(64))::BIGINT AS px, py FROM (SELECT slide_id, unnest(range(64))::BIGINT AS py FROM files)) LEFT JOIN cells USING (slide_id, px, py)"))
def tiff_tiles(spark, sf_dir):
    """Deflated tiles, written by executors and read through the data source."""
    return _stored(spark, _files(spark, sf_dir))


@query(_with(MOSAIC, select="SELECT slide_id, 2::BIGINT AS level, (px // 4)::BIGINT AS px, (py // 4)::BIGINT AS py, value FROM (SELECT slide_id, unnest(range(64))::BIGINT AS px, py FROM (SELECT slide_id, unnest(range(64))::BIGINT AS py FROM files)) LEFT JOIN cells USING (slide_id, px, py) WHERE px % 4 = 0 AND py % 4 = 0 AND px < 16 AND py < 16").replace("py, value FROM", "py, coalesce(value, 0)::BIGINT AS value FROM", 1))
def tiff_mask_pyramid(spark, sf_dir):
    """A window of the third level of zstd masks: every fourth pixel of the first quarter."""
    return _stored(spark, _files(spark, sf_dir, pyramid=True, is_mask=True, compression="zstd"), level=2, x=0, y=0, w=4, h=4).filter("px < 4 AND py < 4")


@query(_with(MOSAIC, select="SELECT slide_id::VARCHAR AS slide_id, 64::BIGINT AS width, 64::BIGINT AS height, 0.5::DOUBLE AS mpp, 3::BIGINT AS levels, 16::BIGINT AS last_w, 2.0::DOUBLE AS last_mpp, '1' AS bands, '16' AS tile_width FROM files"))
def tiff_slides(spark, sf_dir):
    """Headers of pyramids: sizes, spacings and properties."""
    found = slides.read_slides(spark, tiff.files_of(_files(spark, sf_dir, pyramid=True)))
    last = F.element_at("levels", -1)
    return found.select("slide_id", "width", "height", F.round("mpp", 6).alias("mpp"), F.size("levels").alias("levels"), last["width"].alias("last_w"), F.round(last["mpp_x"], 6).alias("last_mpp"), F.col("properties")["bands"].alias("bands"), F.col("properties")["tile_width"].alias("tile_width"))


@query(_with(MOSAIC, select="SELECT slide_id::VARCHAR AS slide_id, key, value FROM (SELECT slide_id, unnest(['width', 'height', 'bands', 'tile_width', 'tile_height', 'photometric', 'compression']) AS key, unnest(['64', '64', '1', '16', '16', '1', '32773']) AS value FROM files)"))
def slide_properties(spark, sf_dir):
    found = slides.read_slides(spark, tiff.files_of(_files(spark, sf_dir, compression="packbits")))
    return S.property_rows(found)


@query(_with(MOSAIC, select="SELECT slide_id, k::BIGINT AS region_index, (px - 10 - 3 * k)::BIGINT AS px, (py - 5 - 3 * k)::BIGINT AS py, value FROM (SELECT * FROM (SELECT slide_id, k, unnest(range(64))::BIGINT AS px, py FROM (SELECT slide_id, k, unnest(range(64))::BIGINT AS py FROM (SELECT slide_id, unnest([0, 1]) AS k FROM files))) LEFT JOIN cells USING (slide_id, px, py)) WHERE px >= 10 + 3 * k AND px < 30 + 3 * k AND py >= 5 + 3 * k AND py < 17 + 3 * k").replace("AS py, value FROM", "AS py, coalesce(value, 0)::BIGINT AS value FROM", 1))
def slide_regions(spark, sf_dir):
    """Regions of files at their own size, read through the backend."""
    files = spark.createDataFrame([(p,) for p in tiff.files_of(_files(spark, sf_dir))], "path string")
    at = lambda k: F.struct(F.lit(k).alias("region_index"), F.lit(10.0 + 3 * k).alias("x"), F.lit(5.0 + 3 * k).alias("y"), F.lit(20).alias("w"), F.lit(12).alias("h"), F.lit(1.0).alias("scaling"))
    got = slides.read_file_regions(files.select("path", F.inline(F.array(at(0), at(1)))))
    return _spread(got.withColumns({"x": F.lit(0), "y": F.lit(0)}), "region_index")


@query(_with(MOSAIC, select="SELECT slide_id::VARCHAR AS slide_id, 40::BIGINT AS width, 40::BIGINT AS height, 1::BIGINT AS bands FROM files"))
def slide_thumbnails(spark, sf_dir):
    files = spark.createDataFrame([(p,) for p in tiff.files_of(_files(spark, sf_dir))], "path string")
    return slides.thumbnails(files, (50, 40)).select("slide_id", "width", "height", "bands")


@query(_with(D.SLIDES_SQL, D.tiles_sql(SCALE, 128, 128), select="SELECT slide_id, region_index, x, y FROM tiles"))
def tile_stream(spark, sf_dir):
    """Tiles of slides that arrive as a stream, as one batch after another wrote them."""
    from ..streaming import tiles as stream

    folder = scratch(spark)
    rows = D.slides(spark, sf_dir)
    rows.repartition(4).write.parquet(f"{folder}/in")
    made = stream.tile_stream(stream.read_slides(spark, f"{folder}/in", rows.schema), 0.5, (128, 128))
    stream.write_tiles(made, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("slide_id", "region_index", "x", "y")
