"""Rasterising against a pixel-by-pixel test of every polygon."""

import random

import numpy as np
import pytest

from tilewright.errors import AnnotationError
from tilewright.operators import rasterize as Z

SCHEMA = "slide_id string, region_index int, layer_idx int, label string, annotation_type string, rings array<array<struct<x:double,y:double>>>"
INDEX = {"gland": 3, "vessel": 1, "fold": 5}


def frame(spark, rows, tile=0):
    return spark.createDataFrame([("s", tile, i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def tile(spark):
    return spark.createDataFrame([("s", 0)], "slide_id string, region_index int")


def on_or_in(ring, x, y):
    """Brute force: on an edge, or an odd number of edges crossed to the right."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
            odd = not odd
    return odd


def brute(rows, w, h, roi=None):
    """(classes, -1 where none; region of interest) of rows (label, type, rings)."""
    mask, inside = np.full((h, w), -1), np.zeros((h, w), bool)
    for label, kind, rings in rows:
        if kind == "POINT":
            continue
        whole = [[(round(x), round(y)) for x, y in r] for r in rings]
        for y in range(h):
            for x in range(w):
                if on_or_in(whole[0], x, y):
                    if label == roi:
                        inside[y, x] = True
                    elif not any(on_or_in(r, x, y) for r in whole[1:]):
                        mask[y, x] = INDEX[label]
    return mask, inside


def scattered(seed, n, w, h):
    """Random polygons, some with a hole, some reaching out of the tile, corners off the lattice."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy, r = rng.uniform(0, w), rng.uniform(0, h), rng.uniform(1, max(w, h) / 2)
        ring = lambda f, k: [(cx + f * r * np.cos(a) * rng.uniform(0.5, 1), cy + f * r * np.sin(a) * rng.uniform(0.5, 1)) for a in np.sort([rng.uniform(0, 6.28) for _ in range(k)])]  # noqa: B023, E731
        out.append((rng.choice(list(INDEX)), "POLYGON", [[(float(x), float(y)) for x, y in r_] for r_ in [ring(1, rng.randint(3, 9)), *([ring(0.4, 4)] if rng.random() < 0.5 else [])]]))
    return out


@pytest.mark.parametrize("seed,n,w,h", [(1, 1, 13, 9), (2, 6, 40, 31), (3, 12, 21, 150), (4, 9, 64, 64)])
def test_polygons_against_brute_force(spark, tile, seed, n, w, h):
    rows = scattered(seed, n, w, h)
    want, _ = brute(rows, w, h)
    got = Z.to_masks(frame(spark, rows), tile, INDEX, default=-1, size=(w, h)).first()["mask"]
    assert (np.array(got) == want).all()
    seen = np.full((h, w), -1)
    for r in Z.runs(Z.class_mask(frame(spark, rows), INDEX, size=(w, h))).collect():
        assert (seen[r["py"], r["x0"] : r["x1"] + 1] == -1).all()
        seen[r["py"], r["x0"] : r["x1"] + 1] = r["value"]
    assert (seen == want).all()
    planes = np.array(Z.to_masks(frame(spark, rows), tile, INDEX, multiclass=True, size=(w, h)).first()["mask"])
    assert planes.shape == (max(INDEX.values()) + 1, h, w)
    for label, k in INDEX.items():
        assert (planes[k] == (brute([r for r in rows if r[0] == label], w, h)[0] >= 0)).all()
    assert not planes[0].any() and not planes[2].any()


def test_region_of_interest_is_apart(spark, tile):
    rows = scattered(8, 4, 30, 22) + [("roi", "POLYGON", [[(3.0, 2.0), (19.0, 4.0), (12.0, 17.0)], [(9.0, 6.0), (11.0, 6.0), (11.0, 9.0)]])]
    mask, inside = brute(rows, 30, 22, "roi")
    got = Z.to_masks(frame(spark, rows), tile, INDEX, roi="roi", default=-1, size=(30, 22)).first()
    assert (np.array(got["mask"]) == mask).all() and (np.array(got["roi"]) == inside).all() and inside[7, 10]


def test_points_and_empty_tiles(spark, tile):
    point = frame(spark, [("nucleus", "POINT", [[(6.0, 2.0)]])])
    got = Z.to_masks(point, tile, INDEX, size=(8, 4)).first()
    assert got["points"]["nucleus"][0] == (6.0, 2.0) and not any(map(any, got["mask"]))
    empty = Z.to_masks(point.filter("false"), tile, INDEX, default=7, size=(8, 4)).first()
    assert {v for r in empty["mask"] for v in r} == {7} and (len(empty["mask"]), len(empty["mask"][0])) == (4, 8)


@pytest.mark.parametrize("x,y", [(0.5, 1.5), (2.5, 0.2), (-3.4, 0.51), (0.49, -1.5)])
def test_halves_round_to_even(spark, tile, x, y):
    box = [("vessel", "BOX", [[(x, y), (x + 6, y), (x + 6, y + 3), (x, y + 3)]])]
    got = np.array(Z.to_masks(frame(spark, box), tile, INDEX, default=-1, size=(11, 7)).first()["mask"])
    assert (got == brute(box, 11, 7)[0]).all() and (got == 1).any()


def test_errors(spark, tile):
    rows = scattered(5, 2, 20, 20)
    with pytest.raises(Exception, match="index map"):
        Z.to_masks(frame(spark, rows), tile, {"other": 1}, size=(20, 20)).collect()
    with pytest.raises(Exception, match="region of interest"):
        Z.to_masks(frame(spark, rows), tile, INDEX, roi="roi", size=(20, 20)).collect()
    with pytest.raises(AnnotationError):
        Z.require_roi(frame(spark, rows), tile, "roi")


def test_large_tiles(spark):
    """Sixteen tiles of 512 x 512 with 50 polygons each; a look-up for every pixel takes hours for them."""
    one = [r for t in range(16) for r in [("s", t, i, *x) for i, x in enumerate(scattered(100 + t, 50, 512, 512))]]
    tiles = spark.createDataFrame([("s", t) for t in range(16)], "slide_id string, region_index int")
    got = Z.to_masks(spark.createDataFrame(one, SCHEMA), tiles, INDEX, size=(512, 512)).selectExpr("size(mask) n", "size(mask[511]) m").collect()
    assert [tuple(r) for r in got] == [(512, 512)] * 16
