"""Tables that grow with the input aren't broadcast, and their rows are dealt to as many tasks as their number asks for."""

import os

import pytest
from pyspark.sql import functions as F

from tilewright.operators import dealing
from tilewright.plans import catalogue, formats  # noqa: F401 - both register queries

SF = "/root/testdata/sf0.001"
GROWING = ("ann_read_region", "ann_polygons_in_tile", "ann_points_in_tile", "ann_sort_area", "ann_halo_xml", "annotated_fraction", "masked_tiles_box_0", "masked_tiles_slide", "masked_reindex", "tile_sample_rows", "roi_mask", "to_masks")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", GROWING)
def test_nothing_that_grows_is_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_tasks_follow_the_files(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert dealing.tasks(rows.withColumn("x", F.explode(F.array("id", "id"))), share=20_000) > 4
    assert dealing.tasks(rows) == 4
    assert dealing.dealt(rows, "id", share=20_000).rdd.getNumPartitions() > 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_classes_do_not_gather_annotations(spark):
    plan = catalogue.QUERIES["ann_darwin_json"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [label" not in plan
