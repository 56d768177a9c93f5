"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is split by the vocabulary's pattern; every piece is a row of byte tokens. Rows of like length share one
padded matrix. In each round every row merges its leftmost pair of least rank, pairs are looked up in a hash
table of (left id, right id), and the matrix is compacted: each row has lost one token, finished rows leave.

Defined results: a null or empty text has no ids and decodes to no bytes; equal rows get equal ids; a column of the
input named like an output is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table

NONE = np.iinfo(np.int32).max
#: Widths of the matrices. Longer pieces take ``_merge_long``: rounds over a row cost the square of its length.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512)
#: Pieces that a worker remembers with their ids; when full the memory starts anew.
REMEMBERED = 200_000
#: Bytes of text encoded at once: the more, the fewer and fuller the matrices.
SLICE = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks with the hash table of mergeable pairs and the byte table of decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"vocabulary lacks the bytes {missing[:5]}")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = dict(sorted((i, t) for t, i in ranks.items()))
        size = max(by_id) + 1
        self.lengths = np.zeros(size, np.int64)
        self.lengths[list(by_id)] = [len(t) for t in by_id.values()]
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_id.values()), np.uint8)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x) for x in zip(*pairs, strict=True))
        self._build(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), rank.astype(np.int32))

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(len(keys) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            at, who = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[todo[free]][who], ranks[todo[free]][who]
            placed = self.keys[slot] == keys[todo]
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where it can't merge; ids below 0 are padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo].astype(np.uint64) << np.uint64(32) | right.ravel()[todo].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != np.iinfo(np.uint64).max)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a piece that is a token as a whole is that token."""
        out: list = [None] * len(pieces)
        rest: list[list[int]] = [[] for _ in WIDTHS]
        widths, last = np.array(WIDTHS), WIDTHS[-1]
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > last:
                out[i] = self._merge_long(p)
            elif p:
                rest[int(np.searchsorted(widths, len(p)))].append(i)
            else:
                out[i] = np.empty(0, np.int32)
        for width, rows in zip(WIDTHS, rest, strict=True):
            step = max(1, 2_000_000 // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_rows([pieces[j] for j in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], np.int32(-1))
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(row):
            here = np.arange(len(row))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[here, at] if rank.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():
                for i, r, n in zip(row[done], ids[done], length[done], strict=True):
                    out[i] = r[:n].copy()
                live = ~done
                row, ids, rank, length, at, least = row[live], ids[live], rank[live], length[live], at[live], least[live]
                here = np.arange(len(row))
                if not len(row):
                    break
            ids[here, at] = least
            stay = np.ones(ids.shape, bool)
            stay[here, at + 1] = False
            ids = ids[stay].reshape(len(row), -1)
            stay = np.ones(rank.shape, bool)
            stay[here, at] = False
            rank = rank[stay].reshape(len(row), -1)
            length = length - 1
            if not rank.shape[1]:
                continue
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < rank.shape[1])
            rank[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long row, with a heap of (rank, position) in place of rounds."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), first.tolist() + [NONE]
        pair = {}

        def ranked(i: int) -> None:
            j, rank[i] = after[i], NONE
            if j < n:
                key = (ids[i], ids[j])
                if key not in pair:
                    pair[key] = int(self.pair_ranks(np.array([key[0]]), np.array([key[1]]))[0])
                rank[i] = pair[key]
                if rank[i] != NONE:
                    heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            ranked(i)
            if before[i] >= 0:
                ranked(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after the other; an id outside the vocabulary raises IndexError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise IndexError("id outside the vocabulary")
        n = self.lengths[ids]
        start = np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n)
        return self.blob[start + np.arange(len(start))].tobytes()


class Encoder:
    """A vocabulary with a bounded memory from pieces to their ids (little-endian int32 bytes)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        pieces = [self.vocabulary.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for doc in pieces for p in doc if p not in self.known})
        coded = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.known.update(zip(new, (x.astype("<i4").tobytes() for x in coded), strict=True))
        return [np.frombuffer(b"".join([self.known[p] for p in doc]), "<i4") for doc in pieces]


_CACHED: dict[tuple[str, str], Vocabulary] = {}


def cached(raw: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file's content, built once per worker process."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _CACHED:
        _CACHED[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}, pattern)
    return _CACHED[key]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Replace the column ``text`` by ``ids``, an array of token ids without special tokens."""
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def start():
        coder = Encoder(cached(raw.value, pattern))
        return lambda texts: [_lists(coder(texts), pa.int32())]

    return map_text(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], start, [c for c in df.columns if c != text], SLICE)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add the column ``decoded``: the bytes of ``ids`` (null ids: no bytes)."""
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf(T.BinaryType())
    def back(column: pa.Array) -> pa.Array:
        vocabulary = cached(raw.value, pattern)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in column)])
        return pa.array([vocabulary.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return df.withColumn(decoded, back(F.col(ids)))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, ranks), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
