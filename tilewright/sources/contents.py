"""Whole files as rows, so that any number of documents is parsed in one job."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(path: str) -> str:
    return "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path).lstrip("/")


def stem(path: Column) -> Column:
    """A path's file name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_contents(spark: SparkSession, paths: str | Sequence[str], slide_id: str | None = None) -> DataFrame:
    """(slide_id, file, path, content): every file under ``paths``; ``file`` is the place in the list of paths, below
    folders and patterns the path decides. ``slide_id``: one for all files, otherwise the file's name without its
    ending."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.text(paths, wholetext=True).select(F.col("value").alias("content"), F.try_url_decode(F.input_file_name()).alias("path"))
    plain = F.concat(F.lit("/"), F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", ""))
    place = F.array_position(F.array(*(F.lit(_plain(p)) for p in paths)), plain)
    name = stem(F.col("path")) if slide_id is None else F.lit(slide_id)
    return rows.select(name.alias("slide_id"), place.cast("int").alias("file"), "path", "content")
