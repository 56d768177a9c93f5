"""Tiles of slides as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.tiling import standard_tiling


def read_slides(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of slides from parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def tile_stream(slides: DataFrame, mpp: float | None, tile: tuple[int, int], **how) -> DataFrame:
    """The standard tiling of every slide that arrives: no state, no shuffle."""
    return standard_tiling(slides, mpp, tile, **how)


def write_tiles(tiles: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the tiles to a parquet table, exactly once."""
    writer = tiles.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
