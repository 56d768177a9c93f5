"""What the text operators share: tables, folds, Arrow mapping and shared storage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch between Spark and Python: each task holds some of them in both, outside the heap.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to ``BATCH_BYTES``, if it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if int(now.rstrip("kmgtp")) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(now[-1], 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from ``df``'s columns, in any case."""
    mark, taken = "_", {c.lower() for c in df.columns}
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one is set on a local master and an error
    raised on a cluster, whose executors don't share local folders."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", there)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later work starts from those files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` has written to the shared folder, once nothing reads them any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tables")
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; for the small tables of iterations, whose files Spark may clean."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Return freed memory to the system at a task's end: its Python worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``most`` bytes of the column ``text``."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def map_text(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[[list], list]],
    keep: Sequence[str] | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Give ``df``'s columns ``keep`` (all, if None) and ``fields``, computed in Python from the column ``text``.

    ``start()`` runs once per task and returns a function from a list of texts (None where null) to one list
    or Arrow array per field; the texts of a call have about ``most`` bytes. A column of ``df`` whose name a field takes is replaced.
    """
    bound_batches(df.sparkSession)
    new = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    use = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        work = start()
        for batch in batches:
            for part in slices(batch, text, most):
                made = work(part.column(text).to_pylist())
                cols = [part.column(c).cast(arrow.field(c).type) for c in keep]
                for f, values in zip(new, made, strict=True):
                    kind = arrow.field(f).type
                    cols.append(values.cast(kind) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        give_back()

    return df.select(*(F.col(f"`{c}`") for c in use)).mapInArrow(run, schema)
