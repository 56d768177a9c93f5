"""Slides, annotations, masks and labels derived from the standard tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.dealing import dealt

#: Bytes of a file of slides, or of vectors with masks, for each task: a row of it makes hundreds of tiles.
FEW = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slide for each part: three levels; parts of odd key have bounds inside the slide."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey", share=FEW).select(
        key.alias("slide_id"),
        (F.lit(500) + 20 * size).cast("int").alias("width"),
        (F.lit(400) + 10 * (key % 50)).cast("int").alias("height"),
        (F.lit(0.25) * F.pow(F.lit(2.0), (key % 3).cast("int"))).alias("mpp"),
    )
    odd = F.col("slide_id") % 2 == 1
    rows = rows.withColumns({"offset_x": F.when(odd, F.lit(16)), "offset_y": F.when(odd, F.lit(8)), "bounds_w": F.when(odd, F.col("width") - 100), "bounds_h": F.when(odd, F.col("height") - 60)})
    level = lambda k: F.struct(F.lit(k).alias("level"), F.floor(F.col("width") / 2**k).cast("int").alias("width"), F.floor(F.col("height") / 2**k).cast("int").alias("height"), F.lit(float(2**k)).alias("downsample"), (F.col("mpp") * 2**k).alias("mpp_x"), (F.col("mpp") * 2**k).alias("mpp_y"))
    return rows.withColumn("levels", F.array(*(level(k) for k in range(3))))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "q", "l_returnflag")
    items = dealt(items, "l_partkey").withColumn("layer_idx", (F.row_number().over(order) - 1).cast("int"))
    plain = slides(spark, sf_dir).select("slide_id", "width", "height")
    rows = items.join(plain.hint("merge"), items["l_partkey"] == plain["slide_id"])
    return rows.select(
        "slide_id", "layer_idx", F.col("l_returnflag").alias("label"), F.element_at(F.array(F.lit("BOX"), F.lit("POLYGON"), F.lit("POINT")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("annotation_type"),
        F.col("l_linenumber").alias("line"),
        ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % F.col("width")).cast("int").alias("x0"),
        ((F.col("l_orderkey") * 53 + F.col("l_suppkey") * 17) % F.col("height")).cast("int").alias("y0"),
        (F.col("q") + 8).alias("aw"),
        ((F.col("q") * 7) % 60 + 5).alias("ah"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation for each line item, on its part's slide: boxes, diamonds of even half axes, and points."""
    x, y, w, h = (F.col(k) for k in ("x0", "y0", "aw", "ah"))
    diamond = F.array(F.array(G.point(x, y + h), G.point(x + w, y), G.point(x + 2 * w, y + h), G.point(x + w, y + 2 * h)))
    rings = F.when(F.col("annotation_type") == "BOX", G.box_rings(x, y, w, h)).when(F.col("annotation_type") == "POINT", F.array(F.array(G.point(x, y)))).otherwise(diamond)
    z = F.when((F.col("annotation_type") != "POINT") & (F.col("line") % 4 != 0), F.col("line").cast("int"))
    hue = F.array(*(((F.ascii("label") * k) % 256).cast("int") for k in (3, 5, 7)))
    return _layers(spark, sf_dir).select("slide_id", "layer_idx", "label", "annotation_type", hue.alias("color"), z.alias("z_index"), rings.alias("rings"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 masks: foreground where a vector's component is positive; slide by the vector's id."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_id"), F.transform("embedding", lambda v: F.when(v > 0, F.lit(1)).otherwise(0)).alias("pixels"))
    return rows.withColumns({"mask_w": F.lit(8), "mask_h": F.lit(8)})


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: px, py, value."""
    rows = masks(spark, sf_dir).select("slide_id", F.posexplode("pixels").alias("k", "value"))
    return rows.select("slide_id", (F.col("k") % 8).alias("px"), F.floor(F.col("k") / 8).cast("int").alias("py"), "value")


def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").alias("slide_id"), F.inline(F.array(F.struct(F.lit("quality").alias("name"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("value")))))


#: The same tables in DuckDB SQL; queries prefix what they need.
SLIDES_SQL = """
slides AS (
  SELECT p_partkey AS slide_id, 500 + 20 * p_size AS width, 400 + 10 * (p_partkey % 50) AS height,
         0.25::DOUBLE * pow(2, p_partkey % 3) AS mpp,
         CASE WHEN p_partkey % 2 = 1 THEN 16 ELSE 0 END AS offset_x, CASE WHEN p_partkey % 2 = 1 THEN 8 ELSE 0 END AS offset_y,
         500 + 20 * p_size - CASE WHEN p_partkey % 2 = 1 THEN 100 ELSE 0 END AS bounds_w,
         400 + 10 * (p_partkey % 50) - CASE WHEN p_partkey % 2 = 1 THEN 60 ELSE 0 END AS bounds_h
  FROM part)"""
ANNOTATIONS_SQL = """
annotations AS (
  SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag) - 1)::INT AS layer_idx,
         l_returnflag AS label, CASE l_suppkey % 3 WHEN 0 THEN 'BOX' WHEN 1 THEN 'POLYGON' ELSE 'POINT' END AS annotation_type,
         CASE WHEN l_suppkey % 3 <> 2 AND l_linenumber % 4 <> 0 THEN l_linenumber::INT END AS z_index,
         (l_orderkey * 37 + l_linenumber * 101) % width AS x0, (l_orderkey * 53 + l_suppkey * 17) % height AS y0,
         l_quantity::INT + 8 AS aw, (l_quantity::INT * 7) % 60 + 5 AS ah
  FROM lineitem JOIN slides ON l_partkey = slide_id)"""
#: The annotations' boxes: a diamond's is twice its half axes, a point's is empty.
SHAPES_SQL = """
shapes AS (
  SELECT *, x0 + CASE annotation_type WHEN 'BOX' THEN aw WHEN 'POLYGON' THEN 2 * aw ELSE 0 END AS x1,
         y0 + CASE annotation_type WHEN 'BOX' THEN ah WHEN 'POLYGON' THEN 2 * ah ELSE 0 END AS y1,
         CASE annotation_type WHEN 'BOX' THEN aw * ah WHEN 'POLYGON' THEN 2 * aw * ah ELSE 0 END AS area
  FROM annotations)"""


def tiles_sql(scale: str, tw: int, th: int, ox: int = 0, oy: int = 0, mode: str = "overflow", order: str = "C", bounds: bool = True) -> str:
    """CTEs extents and tiles: the standard tiling at ``scale`` (SQL for native over wanted spacing)."""
    n = "ceil" if mode == "overflow" else "floor"
    first = "nx" if order == "C" else "ny"
    ix, iy = (f"k % {first}", f"k // {first}") if order == "C" else (f"k // {first}", f"k % {first}")
    area = ("offset_x", "offset_y", "bounds_w", "bounds_h") if bounds else ("0", "0", "width", "height")
    return f"""
extents AS (
  SELECT *, trunc({area[0]} * s)::INT AS off_x, trunc({area[1]} * s)::INT AS off_y, trunc({area[2]} * s)::INT AS size_w, trunc({area[3]} * s)::INT AS size_h
  FROM (SELECT *, ({scale})::DOUBLE AS s FROM slides)),
counted AS (
  SELECT *, greatest(0, {n}((size_w - {tw}) / sx::DOUBLE + 1))::INT AS nx, greatest(0, {n}((size_h - {th}) / sy::DOUBLE + 1))::INT AS ny
  FROM (SELECT *, {tw} - {ox} % least({tw}, size_w) AS sx, {th} - {oy} % least({th}, size_h) AS sy FROM extents)),
numbered AS (SELECT *, unnest(range(nx * ny))::INT AS k FROM counted WHERE nx > 0 AND ny > 0),
tiles AS (
  SELECT slide_id, k::BIGINT AS region_index, k, ({ix})::INT AS ix, ({iy})::INT AS iy, nx, ny, sx, sy, s AS scaling, mpp / s AS view_mpp,
         (({ix}) * sx + off_x)::DOUBLE AS x, (({iy}) * sy + off_y)::DOUBLE AS y, {tw} AS w, {th} AS h
  FROM numbered)"""


MASKS_SQL = """
mask_pixels AS (
  SELECT vec_id AS slide_id, k % 8 AS px, k // 8 AS py, CASE WHEN embedding[k + 1] > 0 THEN 1 ELSE 0 END AS value
  FROM (SELECT vec_id, embedding, unnest(range(64))::INT AS k FROM embeddings))"""
