"""How many tasks share a table's rows.

Spark's guess at the size of a table made by ``explode`` or a Python function is that of the rows that it was made from,
so that it may broadcast one too large for the driver, or put all of one into a few tasks. Joins whose sides grow with
the input therefore ask for a merge join, and rows are dealt to as many tasks as the files beneath them suggest, which
keeps a task's rows the same in number whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of the files beneath a table for each task.
SHARE = 2 << 20
#: Sizes that Spark doesn't know are given as very large.
UNKNOWN = 1 << 46
MOST = 20_000


def tasks(df: DataFrame, share: int = SHARE) -> int:
    """As many as ``spark.sql.shuffle.partitions`` at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return least if size >= UNKNOWN else max(least, min(MOST, -(-size // share)))


def dealt(df: DataFrame, *by: str, share: int = SHARE) -> DataFrame:
    """``df`` dealt by the hash of ``by``; a stream stays as it is."""
    return df if df.isStreaming else df.repartition(tasks(df, share), *by)
