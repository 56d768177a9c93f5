"""Bounded-space online packing of token ids into sequences of a fixed size.

Each partition streams its documents with a fixed number of open windows. Whole windows are cut off a long
document; what remains goes, uncut, to the open window that it fills best. When none has room, the fullest window
is topped up with the head of the piece, emitted as full, and the rest opens a new window. What a partition leaves
open is merged with the leftovers of its neighbours (groups of partitions) in the same way; only the last window
of a group isn't full, and it is cut at powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; every id lies in exactly one piece; equal rows are
packed one by one; rows with the same or a null id are told apart by nothing but their pieces; a very long text is encoded alone and cut
into whole windows; ties in room go to the older window; columns beside the id and the text are ignored, so names can't
clash; an empty table has no pieces.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, give_back, slices, table

SIZE = 1024
OPEN_WINDOWS = 64
#: Partitions whose leftovers are merged by one task.
MERGED = 16

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bytes_of_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer(content: str):
    """A function from texts to ids, equal to the ``tokenizers`` library's on a byte-level BPE file as loaded: its added
    tokens are matched in texts.

    Where the file's merges are in the order of their ids and nothing else changes texts, tiktoken's merge loop gives
    the same ids some four times faster; any other file goes through ``tokenizers`` itself.
    """
    whole = json.loads(content)
    model, of = whole["model"], _bytes_of_symbols()
    extra = whole.get("added_tokens") or []
    special = {x["content"]: x["id"] for x in extra}
    # one added token without options is matched alike by both
    simple = len(extra) <= 1 and not any(x.get(k) for x in extra for k in ("single_word", "lstrip", "rstrip", "normalized"))
    plain = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"]["".join(m)] for m in merges]
    setting = whole["pre_tokenizer"] or {}
    bare = not whole.get("normalizer") and not whole.get("truncation") and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if model["type"] == "BPE" and bare and simple and order == sorted(order) and len(plain) == 256 + len(merges) and setting.get("type") == "ByteLevel" and not setting.get("add_prefix_space") and setting.get("use_regex", True):
        ranks = {bytes(of[c] for c in t): i for t, i in plain.items()}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        return lambda texts: [coder.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(content)
    return lambda texts: [np.array(e.ids, np.uint32) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


class Packer:
    """``most`` open windows of ``size`` ids. Pieces are (doc, start, ids, doc_tokens); ``put`` and ``flush`` give
    closed windows as lists of pieces."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.windows: dict[int, list] = {}
        self.free: list[tuple[int, int]] = []  # (room, window), in order
        self.next = 0

    def put(self, doc, start: int, ids: np.ndarray, doc_tokens: int):
        while len(ids) >= self.size:
            yield [(doc, start, ids[: self.size], doc_tokens)]
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        k = bisect.bisect_left(self.free, (len(ids), -1))
        if k < len(self.free):
            room, w = self.free.pop(k)
            self.windows[w].append((doc, start, ids, doc_tokens))
            if room == len(ids):
                yield self.windows.pop(w)
            else:
                bisect.insort(self.free, (room - len(ids), w))
            return
        if len(self.free) >= self.most:
            room, w = self.free.pop(0)
            yield [*self.windows.pop(w), (doc, start, ids[:room], doc_tokens)]
            start, ids = start + room, ids[room:]
        self.windows[self.next] = [(doc, start, ids, doc_tokens)]
        bisect.insort(self.free, (self.size - len(ids), self.next))
        self.next += 1

    def flush(self):
        """The open windows, fullest first."""
        for _, w in self.free:
            yield self.windows[w]
        self.windows, self.free = {}, []


def _rows(windows, ids_of: bool) -> dict[str, list]:
    cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
    for sequence, pieces in windows:
        at = 0
        for doc, start, ids, doc_tokens in pieces:
            raw = ids.astype("<u4").tobytes()
            for k, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), doc_tokens, sequence, at, raw if ids_of else None), strict=True):
                cols[k].append(v)
            at += len(ids)
    return cols


def _batches(windows, ids_of: bool, schema: pa.Schema, rows: int = 4000):
    part, n = [], 0
    for w in windows:
        part.append(w)
        n += len(w[1])
        if n >= rows:
            yield pa.RecordBatch.from_pydict({k: v for k, v in _rows(part, ids_of).items() if k in schema.names}, schema)
            part, n = [], 0
    if part:
        yield pa.RecordBatch.from_pydict({k: v for k, v in _rows(part, ids_of).items() if k in schema.names}, schema)


def pack(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, open_windows: int = OPEN_WINDOWS, merged: int = MERGED, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    kind = df.schema[doc_id].dataType.simpleString()
    shape = PIECE.format(id=kind) + ", ids binary, part long"
    schema = to_arrow_schema(spark.createDataFrame([], shape).schema)

    def first(batches):
        code, packer, part = tokenizer(content.value), Packer(size, open_windows), TaskContext.get().partitionId()
        number = part << 36

        def closed():
            nonlocal number
            for batch in batches:
                for piece in slices(batch, "text"):
                    for doc, ids in zip(piece.column("doc_id").to_pylist(), code(piece.column("text").to_pylist()), strict=True):
                        ids = np.append(ids, np.uint32(end_id))
                        for window in packer.put(doc, 0, ids, len(ids)):
                            yield number, window
                            number += 1

        narrow = pa.schema([f for f in schema if f.name != "part"])
        for ids_of, windows in ((False, closed()), (True, ((number + i, w) for i, w in enumerate(packer.flush())))):
            for b in _batches(windows, ids_of, narrow):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64())], schema=schema)
        give_back()

    packed = cut(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(first, shape))
    final = PIECE.format(id=kind)
    plain = to_arrow_schema(spark.createDataFrame([], final).schema)

    def merge(key, leftovers):
        # at most merged * open_windows windows
        group = key[0].as_py()
        pieces = sorted(leftovers.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        packer = Packer(size, open_windows)

        def again():
            for r in pieces:
                yield from packer.put(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            rest = Packer(size, 1)  # one open window: the next piece is cut to fill it
            for window in packer.flush():
                for piece in window:
                    yield from rest.put(*piece)
            for window in rest.flush():
                left, power = sum(len(x[2]) for x in window), size
                parts = [(d, s, i, n) for d, s, i, n in window]
                while left:
                    power >>= 1
                    if not left & power:
                        continue
                    left, room, own = left - power, power, []
                    while room:
                        d, s, i, n = parts.pop(0)
                        own.append((d, s, i[:room], n))
                        if len(i) > room:
                            parts.insert(0, (d, s + room, i[room:], n))
                        room -= len(own[-1][2])
                    yield own

        numbered = ((1 << 62 | group << 36 | i, w) for i, w in enumerate(again()))
        return pa.Table.from_batches(_batches(numbered, False, plain), plain)

    columns = [f.name for f in plain]
    open_ = packed.filter("ids is not null").withColumn("group", F.expr(f"part div {int(merged)}"))
    leftovers = open_.groupBy("group").applyInArrow(merge, final)
    return packed.filter("ids is null").select(*columns).unionByName(leftovers)


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
