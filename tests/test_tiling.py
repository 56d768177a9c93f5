import pytest
from pyspark.sql import functions as F

from tilewright.operators import tiling as T


def coordinates(spark, size, tile, overlap, mode):
    s, t, o = (F.lit(float(v)) for v in (size, tile, overlap))
    return spark.range(1).select(T.axis_coordinates(s, t, o, mode).alias("c")).first()["c"]


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_tile_larger_than_size(spark, overlap):
    assert len(coordinates(spark, 2, 10, overlap, "skip")) == 0
    assert len(coordinates(spark, 2, 10, overlap, "overflow")) == 1


@pytest.mark.parametrize("size,tile,overlap", [(10, 3, 0), (3, 1, 2), (17, 3.2, 2), (53.2, 12.2, 15), (1, 2, 3)])
@pytest.mark.parametrize("mode", ["skip", "overflow"])
def test_axis_is_sorted_uniform_and_fits(spark, size, tile, overlap, mode):
    got = coordinates(spark, size, tile, overlap, mode)
    assert got == sorted(got)
    if not got:
        return
    steps = {round(b - a, 9) for a, b in zip(got, got[1:], strict=False)}
    assert got[0] == 0 and len(steps) <= 1
    end = got[-1] + tile
    assert end <= size + 1e-9 if mode == "skip" else end >= size - 1e-9


@pytest.mark.parametrize("sizes", [((0, 1), (1, 1), (0, 0)), ((1, 1), (0, 1), (0, 0)), ((1, 1), (1,), (0, 0))])
def test_bad_tiling_is_an_error(sizes):
    with pytest.raises(ValueError):
        T.check_tiling(*sizes)


def test_orders(spark):
    extent = spark.range(1).selectExpr("0 off_x", "2 off_y", "2 size_w", "3 size_h")
    of = lambda order: [(r["x"], r["y"]) for r in T.grid(extent, (1, 1), order=order).orderBy("k").collect()]
    assert of("F")[:2] == [(0, 2), (0, 3)]
    assert of("C")[:3] == [(0, 2), (1, 2), (0, 3)]
    assert sorted(of("C")) == sorted(of("F"))


def slide(spark, **more):
    row = {"slide_id": "base", "width": 1000, "height": 1000, "mpp": 0.25, **more}
    kinds = {"slide_id": "string", "width": "int", "height": "int", "mpp": "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'int')}" for k in row))


def test_standard_tiling_has_seventy_tiles(spark):
    got = T.standard_tiling(slide(spark), 1.0, (32, 24), mode="skip")
    assert got.count() == 70
    assert [r["region_index"] for r in T.sliced(got.orderBy("region_index"), 0, 2, "region_index").collect()] == [0, 1]


def test_bounds_limit_the_grid(spark):
    rows = slide(spark, offset_x=100, offset_y=200, bounds_w=400, bounds_h=400)
    got = T.standard_tiling(rows, 0.5, (100, 100), mode="skip").agg(F.min("x"), F.min("y"), F.count("*")).first()
    assert tuple(got) == (50.0, 100.0, 4)
    assert T.standard_tiling(rows, 0.5, (100, 100), mode="skip", limit_bounds=False).count() == 25


def test_rois_number_regions_over_grids(spark):
    rows = slide(spark).withColumn("rois", F.expr("array(named_struct('x',3,'y',5,'w',101,'h',99), named_struct('x',500,'y',500,'w',200,'h',200))"))
    got = T.standard_tiling(rows, 0.5, (25, 25), mode="skip", rois="rois").orderBy("region_index").collect()
    assert [r["region_index"] for r in got] == list(range(len(got)))
    assert (got[0]["x"], got[0]["y"]) == (2.0, 3.0)
    assert {r["grid_index"] for r in got} == {0, 1} and sum(r["grid_index"] == 0 for r in got) == 2


def test_concat_and_index(spark):
    part = lambda v: spark.createDataFrame(list(enumerate(v)), "ordinal long, value int")
    both = T.concat([part([1, 2, 3]), part([4, 5, 6])])
    value = lambda i: T.item(both, i, 6).first()["value"]
    assert [value(i) for i in (0, 2, 3, 5, -6)] == [1, 3, 4, 6, 1]
    assert [r["value"] for r in T.sliced(both, 1, 3).orderBy("ordinal").collect()] == [2, 3]
    assert [r["value"] for r in T.sliced(both, -3, -1).orderBy(F.desc("ordinal")).collect()] == [5, 4]
    with pytest.raises(ValueError):
        T.item(both, -7, 6)
    with pytest.raises(AssertionError):
        T.concat([])


def test_mesh(spark):
    got = T.indexed_mesh(spark.range(1).selectExpr("array(1,2) a", "array(5,6,7) b"), ["a", "b"], ["x", "y"])
    assert [(r["x_index"], r["x"], r["y"]) for r in got.orderBy("x_index", "y_index").collect()][:4] == [(0, 1, 5), (0, 1, 6), (0, 1, 7), (1, 2, 5)]


def test_generation_needs_no_shuffle(spark):
    plan = T.standard_tiling(slide(spark), 1.0, (32, 24))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("ranges", [1, 3, 200])
def test_sums_over_all_rows_run_in_ranges(spark, ranges, monkeypatch):
    monkeypatch.setattr(T, "RANGES", ranges)
    rows = [(f"s{k * 37 % 101:03d}", k % 5) for k in range(101)]
    got = {r["slide_id"]: r["start"] for r in T.offsets(spark.createDataFrame(rows, "slide_id string, n int"), "n", "slide_id").collect()}
    want, at = {}, 0
    for slide, n in sorted(rows):
        want[slide], at = at, at + n
    assert got == want
    assert T.offsets(spark.createDataFrame([], "slide_id string, n int"), "n", "slide_id").count() == 0
