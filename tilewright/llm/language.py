"""Language identification with language-bitmask n-gram filters.

Learning: 4-byte n-grams of the lower-cased letters of a text are counted per language over all training rows. A
language keeps an n-gram that makes up at least ``min_share`` of its n-grams and whose share is at least
``keep_ratio`` of the largest among languages. All languages' Bloom filters have the same slots and hashes and lie
bit-sliced in one table: a slot holds a bitmask of languages, and the AND of an n-gram's slots gives all languages
that contain it. The table's size is a parameter; ``min_share`` bounds what each filter can hold, so that the table
may be broadcast whatever the corpus' size.

Deciding: per language the n-grams whose mask has its bit are counted (popcount) and corrected for the filter's
false-positive rate; the language with most wins, ties going to the one with more training rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; if nothing was learned every text
is; rows with a null language or text teach nothing; equal rows get equal answers; an input column named like an output is replaced; very long texts are
taken in parts of ``SLICE`` bytes that overlap by an n-gram, which gives the same; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, fold, give_back, map_text, slices, table

UNDETERMINED = "und"
MIN_SHARE = 2.0**-18
KEEP_RATIO = 0.25
SLOT_BITS = 21
HASHES = 4
#: Distinct languages that may be learned: bitmasks are words of 62 bits, and the table is broadcast.
MOST_LANGUAGES = 496
WORD = 62
#: Stands in place of an n-gram for the number of rows.
ROWS = -1
#: Bytes of text whose n-grams are handled at once; each takes some 60 bytes in arrays.
SLICE = 1 << 19

_LETTER = regex.compile(r"\p{L}").search
#: ASCII letters and all bytes of other scripts stay, the rest are gaps.
_GAPS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MANY = re.compile(rb" {2,}")


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts, text of each)."""
    parts = list(windows(texts))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def windows(texts: list[str | None], most: int = 0):
    """The n-grams of texts, a long text's in parts of ``most`` (SLICE) bytes that overlap by three."""
    most = most or SLICE
    plain = [_MANY.sub(b" ", t.lower().encode().translate(_GAPS)).strip() if t else b"" for t in texts]
    run, at, total = [], [], 0
    for i, p in enumerate(plain):
        if not p:
            continue
        p = b"  " + p + b"  "
        for a in range(0, max(1, len(p) - 3), most):
            run.append(b"\0" + p[a : a + most + 3])
            at.append(i)
            total += len(run[-1])
            if total > most:
                yield _grams(run, at)
                run, at, total = [], [], 0
    yield _grams(run, at)


def _grams(run: list[bytes], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(run) + b"\0\0\0", np.uint8)
    doc = np.repeat(np.array(at, np.int32), [len(r) for r in run])
    gram = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    gap = raw == 0
    whole = ~(gap[:-3] | gap[1:-2] | gap[2:-1] | gap[3:])
    return gram[whole], doc[whole]


def _slots(gram: np.ndarray, bits: int, hashes: int):
    """The ``hashes`` slots of each n-gram, by double hashing."""
    h = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows with a text and a language, pre-aggregated by task; gram ``ROWS`` counts the rows."""

    bound_batches(docs.sparkSession)

    def run(batches):
        names: dict[str, int] = {}
        rows: Counter = Counter()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged(parts):
            key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[first], np.add.reduceat(n, first)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                which = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], np.uint64)
                rows.update(part.column("lang").to_pylist())
                for gram, doc in windows(part.column("text").to_pylist()):
                    key = np.sort(which[doc] << np.uint64(32) | gram)
                    if len(key):
                        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                        kept.append((key[first], np.diff(np.r_[first, len(key)])))
                        held += len(first)
                    if held > 4_000_000:
                        kept = [merged(kept)]
                        held = len(kept[0][0])
                        if held > 3_000_000:
                            yield from out(kept.pop(), names)
                            held = 0
        if kept:
            yield from out(merged(kept), names)
        kept = []
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([ROWS] * len(rows), pa.int64()), pa.array(list(rows.values()), pa.int64())], names=["lang", "gram", "n"])
        give_back()

    def out(one, names):
        key, n = one
        of = pa.array(list(names), pa.string())
        for k in range(0, len(key), 100_000):
            part = key[k : k + 100_000]
            yield pa.RecordBatch.from_arrays(
                [of.take(pa.array(part >> np.uint64(32))), pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[k : k + 100_000].astype(np.int64))],
                names=["lang", "gram", "n"],
            )

    read = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return read.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The learned languages and the bit-sliced table (words of a slot, slot)."""

    def __init__(self, languages: list[str], table: np.ndarray, bits: int, hashes: int):
        self.languages, self.table, self.bits, self.hashes = languages, table, bits, hashes
        fill = [float(np.mean(table[k // WORD] >> np.int64(k % WORD) & 1)) for k in range(len(languages))]
        self.false_positive = np.array(fill) ** hashes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, hits = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for gram, doc in windows(texts):
            total += np.bincount(doc, minlength=len(texts))
            slots = list(_slots(gram, self.bits, self.hashes))
            for word, column in enumerate(self.table):
                mask = column[slots[0]]
                for s in slots[1:]:
                    mask &= column[s]
                for k in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                    hits[k] += np.bincount(doc[mask >> np.int64(k % WORD) & 1 == 1], minlength=len(texts))
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        f = self.false_positive[:, None]
        real = np.maximum(0, (hits - total * f) / np.maximum(1 - f, 1e-9))
        best = real.argmax(0)
        top = real[best, np.arange(len(texts))]
        second = np.sort(real, 0)[-2] if len(real) > 1 else np.zeros(len(texts))
        score = np.divide(top, total, out=np.zeros_like(top), where=total > 0) * np.divide(top, top + second, out=np.zeros_like(top), where=top > 0)
        letters = np.array([bool(t) and _LETTER(t) is not None for t in texts])
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(score, 0, 1), 0.0)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE, keep_ratio: float = KEEP_RATIO, bits: int = SLOT_BITS, hashes: int = HASHES) -> Filters:
    """Filters of all languages in ``docs``."""
    counted = cut(count_grams(docs, text, lang))
    rows = counted.filter(F.col("gram") == ROWS).select("lang", F.col("n").alias("count")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in sorted(rows, key=lambda r: (-r["count"], r["lang"]))]
    words = max(1, -(-len(languages) // WORD))
    found = np.zeros((words, 1 << bits), np.int64)
    if languages:
        n = counted.filter(F.col("gram") != ROWS)
        total = n.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language: at most MOST_LANGUAGES
        share = n.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total"))
        share = share.filter(F.col("share") >= min_share)
        share = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= keep_ratio * F.col("most"))
        number = {x: i for i, x in enumerate(languages)}

        def slotted(batches):
            for b in batches:
                k = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
                for s in _slots(b.column("gram").to_numpy(zero_copy_only=False), bits, hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k // WORD), pa.array(np.int64(1) << (k % WORD))], names=["slot", "word", "mask"])

        slots = share.select("lang", "gram").mapInArrow(slotted, "slot long, word long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
        got = slots.toArrow()  # at most a row for each word and slot
        found[got.column("word").to_numpy(), got.column("slot").to_numpy()] = got.column("mask").to_numpy()
    return Filters(languages, found, bits, hashes)


def identify(df: DataFrame, filters: Filters, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the share of n-grams that the language explains, less where another does)."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def start():
        known = shared.value
        return lambda texts: list(known.predict(texts))

    return map_text(df, text, [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())], start, most=SLICE)


def op4_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    filters = learn(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), filters).select("doc_id", "held_out", "lang_pred", "score")
