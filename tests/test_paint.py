"""Many polygons at once against one ring after the other."""

from math import gcd

import numpy as np
import pyarrow as pa
import pytest

from tilewright.operators import rasterize as Z


def one_ring(xs: np.ndarray, ys: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """Which lattice points of the window lie inside or on a ring with whole coordinates."""
    odd = np.zeros((height, width + 1), bool)
    edge = np.zeros((height, width), bool)
    xs, ys = xs.tolist(), ys.tolist()
    for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True):
        if y1 > y2:
            x1, y1, x2, y2 = x2, y2, x1, y1
        dx, dy = x2 - x1, y2 - y1
        rows = np.arange(max(y1, top), min(y2, top + height))
        if len(rows):  # points right of the crossing change sides
            after = x1 + (rows - y1) * dx // dy + 1
            odd[rows - top, np.clip(after - left, 0, width)] ^= True
        steps = gcd(dx, dy)
        k = np.arange(steps + 1)
        x, y = x1 + k * (dx // max(steps, 1)) - left, y1 + k * (dy // max(steps, 1)) - top
        seen = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        edge[y[seen], x[seen]] = True
    return np.logical_xor.accumulate(odd[:, :width], axis=1) | edge


@pytest.mark.parametrize("seed", range(20))
def test_windows_equal_one_ring_after_the_other(seed):
    r = np.random.default_rng(seed)
    n = r.integers(1, 9, 30)
    xs, ys = r.integers(-20, 40, n.sum()), r.integers(-20, 40, n.sum())
    first = np.cumsum(n) - n
    left, top, width, height = r.integers(-9, 20, 30), r.integers(-9, 20, 30), r.integers(1, 30, 30), r.integers(1, 30, 30)
    got = Z.windows_covered(xs, ys, first, n, left, top, width, height)
    at = 0
    for k in range(30):
        points = slice(first[k], first[k] + n[k])
        want = one_ring(xs[points], ys[points], left[k], top[k], width[k], height[k])
        mine = got[at : at + (width[k] + 1) * height[k]].reshape(height[k], -1)
        assert (mine[:, :-1] == want).all() and not mine[:, -1].any()
        at += mine.size


def _batches(rows, size):
    kind = pa.struct([("slide_id", pa.int64()), ("band", pa.int32()), ("w", pa.int32()), ("rows", pa.int32()), ("value", pa.int32()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
    return [pa.RecordBatch.from_struct_array(pa.array(rows[k : k + size], kind)) for k in range(0, len(rows), size)]


@pytest.mark.parametrize("pixels", [1, 5000, 1 << 20])
def test_batches_and_runs_of_bands_do_not_matter(monkeypatch, pixels):
    r = np.random.default_rng(5)
    ring = lambda: [{"x": float(x), "y": float(y)} for x, y in r.integers(-5, 60, (r.integers(3, 7), 2))]
    rows = [{"slide_id": k // 9 if k else None, "band": 0, "w": 50, "rows": 40, "value": k, "rings": [ring() for _ in range(r.integers(0, 4))]} for k in range(60)]
    rows[7]["rings"] = None
    rows[8]["rings"] = [[]]
    want = {}
    for row in rows:
        v = want.setdefault(row["slide_id"], np.full((40, 50), -1))
        rings = row["rings"] or []
        if rings and rings[0]:
            one = [one_ring(np.array([p["x"] for p in g], int), np.array([p["y"] for p in g], int), 0, 0, 50, 40) for g in rings]
            v[one[0] & ~np.any([np.zeros_like(one[0]), *one[1:]], axis=0)] = row["value"]
    monkeypatch.setattr(Z, "PIXELS", pixels)
    monkeypatch.setattr(Z, "WINDOWS", max(pixels // 10, 1))
    for size in (1, 4, 60):
        got = {}
        for keys, w, high, offsets, values, seen in Z._painted(_batches(rows, size), 1, 128):
            for g in range(len(w)):
                part = slice(offsets[g], offsets[g + 1])
                key = keys[0][g].as_py()
                assert key not in got
                got[key] = np.where(seen[part], values[part], -1).reshape(high[g], w[g])
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
