import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import annotations as A
from tilewright.operators.clip import area, clip_polygon, even_odd, polygons, simplify_ring

COMB = [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (6, 2), (6, 10), (4, 10), (4, 2), (2, 2), (2, 10), (0, 10)]


def total(parts):
    return sum(abs(area(p[0])) - sum(abs(area(r)) for r in p[1:]) for p in parts)


def test_concave_pieces_are_told_apart():
    parts = clip_polygon([COMB], 0, 5, 10, 20)
    assert len(parts) == 3 and total(parts) == 30
    assert len(clip_polygon([COMB], 0, 1, 10, 20)) == 1


def test_holes():
    ring = [(0, 0), (8, 0), (8, 8), (0, 8)]
    hole = [(2, 2), (6, 2), (6, 6), (2, 6)]
    assert [len(p) for p in clip_polygon([ring, hole], -1, -1, 9, 9)] == [2]
    half = clip_polygon([ring, hole], -1, -1, 4, 9)
    assert [len(p) for p in half] == [1] and total(half) == 24
    band = clip_polygon([ring, hole], -1, 3, 9, 5)
    assert len(band) == 2 and total(band) == 8


def test_outside_and_inside():
    assert clip_polygon([COMB], 20, 20, 30, 30) == []
    assert total(clip_polygon([COMB], -5, -5, 50, 50)) == abs(area(COMB))


def test_even_odd_nesting():
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    made = even_odd([square(0, 10), square(1, 9), square(2, 8), square(20, 22)])
    assert sorted(len(p) for p in made) == [1, 1, 2]
    assert polygons([]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 9), st.integers(0, 10**6), st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 9), st.integers(1, 9)))
def test_area_against_sampling(n, seed, box):
    rng = np.random.default_rng(seed)
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    ring = [(5 + r * math.cos(t), 5 + r * math.sin(t)) for t, r in zip(angles, rng.uniform(1, 5, n), strict=True)]
    x0, y0, w, h = box
    got = total(clip_polygon([ring], x0, y0, x0 + w, y0 + h))
    grid = 120
    xs, ys = np.meshgrid(x0 + (np.arange(grid) + 0.5) * w / grid, y0 + (np.arange(grid) + 0.5) * h / grid)
    odd = np.zeros(xs.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= ((ay > ys) != (by > ys)) & (xs < (bx - ax) * (ys - ay) / (by - ay) + ax)
    assert got == pytest.approx(odd.mean() * w * h, abs=0.05 * w * h + 0.05)


def test_native_area_equals_pieces(spark):
    pts = lambda r: "array(" + ",".join(f"named_struct('x', {float(x)}D, 'y', {float(y)}D)" for x, y in r) + ")"
    row = spark.range(1).select(F.expr(f"array({pts(COMB)})").alias("r"))
    got = row.select(G.clipped_area(F.col("r"), F.lit(1.0), F.lit(5.0), F.lit(9.0), F.lit(20.0)).alias("a")).first()["a"]
    assert got == pytest.approx(total(clip_polygon([COMB], 1, 5, 9, 20)))


def test_read_regions_splits_and_moves(spark):
    pts = "array(" + ",".join(f"named_struct('x', {float(x)}D, 'y', {float(y)}D)" for x, y in COMB) + ")"
    rows = spark.range(1).select(F.lit("s").alias("slide_id"), F.lit(0).alias("layer_idx"), F.lit("L").alias("label"), F.lit("POLYGON").alias("annotation_type"), F.expr(f"array({pts})").alias("rings"))
    region = spark.range(1).selectExpr("'s' slide_id", "0 region_index", "0D x", "10D y", "20 w", "40 h", "2D scaling")
    got = A.read_regions(region, rows).orderBy("part").collect()
    assert len(got) == 3
    assert all(p["y"] >= 0 for r in got for p in r["rings"][0]) and max(p["y"] for r in got for p in r["rings"][0]) == 10


def test_rectangles(spark):
    shapes = {"upright": [(0, 0), (2, 0), (2, 1), (0, 1)], "turned": [(0, 0), (1, 1), (0, 2), (-1, 1)], "no": [(0, 0), (2, 0), (2, 1), (0, 2)], "five": [(0, 0), (1, 0), (2, 0), (2, 1), (0, 1)]}
    for name, r in shapes.items():
        pts = "array(" + ",".join(f"named_struct('x', {float(x)}D, 'y', {float(y)}D)" for x, y in r) + ")"
        got = spark.range(1).select(G.is_rectangle(F.expr(f"array({pts})")).alias("r"), G.is_upright_box(F.expr(f"array({pts})")).alias("u")).first()
        assert tuple(got) == (name in ("upright", "turned"), name == "upright")


def test_simplify():
    assert simplify_ring([(0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)], 0.1) == [(0, 0), (2, 0), (2, 2), (0, 2)]
