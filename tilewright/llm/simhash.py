"""SimHash near-duplicates through covering locality-sensitive hashing.

A text's fingerprint has, per bit, the majority of its word shingles' hashes. To find all pairs within ``radius``
bits, every bit position gets one of the non-zero vectors of GF(2)^(radius+1) in turn; table v keeps the positions
whose vector has an odd product with v. The vectors of any ``radius`` differing positions leave some v orthogonal to
all of them, so each such pair agrees on a whole key of table v: the 2^(radius+1)-1 tables miss no pair.

Only distinct fingerprints are hashed (copies meet in a group-by). Buckets of two are compared in the JVM. Larger
ones are dealt in chunks of at most ``chunk`` fingerprints, every pair of chunks being one task's group, so that no
bucket is gathered whole. A group returns its
components as stars, never all pairs.

``near_copies`` links texts by the Jaccard similarity of their shingle sets. A similarity of 0.8 is some 15 % of a
fingerprint's bits, too many for masks of the kind above, so two independent fingerprints of 64 bits are cut into
``BLOCKS`` blocks each and a table keeps ``KEPT`` of them: of the C(8, 2) tables of a fingerprint one holds every pair
within 6 of its 64 bits, and most pairs beyond. Pairs of a bucket within ``FAR`` of the 128 bits are candidates; a
crowded bucket gives the edges of its minimum spanning forest in that distance instead, which joins, at every smaller
distance, what its pairs would join. Every candidate is verified on the exact shingle sets. Recall is measured in
tests/llm/test_simhash.py and the README. For many more than 2^25 distinct texts take longer keys (``kept`` 3).

Defined results: a null or empty text has the fingerprint zero, linked like any other; a text of fewer words than a
shingle is hashed whole; a row with a null id links like any other, but the id stands for its component only if that
has no other; equal rows get equal results, ties don't matter as the least id is taken; very long texts are hashed
whole, in blocks of shingles; input columns named like outputs are replaced, other names never clash; an empty table
gives an empty one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, fresh, give_back, map_text, slices, table
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
CHUNK = 1024
#: Of near copies: the least Jaccard similarity; blocks of a fingerprint and those that a table keeps; the most differing
#: bits of two fingerprints. At a similarity of 0.8 these are 19.4 of 128 on average; 99.6 % of pairs differ in 30 or less.
LEAST = 0.8
BLOCKS, KEPT = 8, 2
FAR = 30
WIDE_CHUNK = 4096
#: Rows of a bucket up to which all buckets' pairs are compared at once, and rows compared at once.
SMALL = 32
RUN = 200_000
#: Of links that the tables miss: columns of a text's parity map; distinct texts that tell which shingles are common, and
#: their count from which they are; so many shingles of a set make one more shared entry of prefixes; packed numbers of a
#: part; texts and bytes compared in a task, and the most bits of their maps.
MAP = tuple(f"p{k}" for k in range(8))
SAMPLE, COMMON = 4096, 8
SHARED = 20
ENTRIES = 1 << 20
SETTLED, SETTLED_BYTES = 256, 4 << 20
#: Of groups that are refined: their least number of texts, texts and prefix entries compared in a task, and the number of
#: texts with an entry from which it counts as crowded, and crowded entries counted at once.
REFINED, COUNTED, COUNTED_ENTRIES = 32, 2048, 1 << 20
CROWDED, COLUMNS = 64, 512
WIDE_MAP = 1 << 16
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        h = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    raw = np.array(h, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(_BITS[2 * ones > len(raw)].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the fingerprint as a signed long."""

    def start():
        return lambda texts: [np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)]

    return map_text(df, text, [T.StructField(out, T.LongType())], start, keep)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' bit masks: position i belongs to table v if vector 1 + i mod (2^(radius+1)-1) has an odd product."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links from the least node of each component of the pairs within ``radius`` to its others: a search that meets
    each node once."""
    out, rest = [], np.unique(nodes)
    while len(rest):
        least, queue, rest = int(rest[0]), [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(least, int(y)) for y in found]
                queue += list(found)
    return out


def links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints that join exactly those which a chain of pairs within ``radius``
    bits joins. ``fps`` should be cheap to read: it is read three times."""
    one = fps.select(F.col(fp).alias("fp")).distinct()
    keys = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius))))
    rows = one.select("fp", F.inline(keys))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    sizes = cut(sizes)
    two = sizes.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    many = rows.join(sizes.filter("n > 2").select("t", "key", parts.alias("parts")), ["t", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    many = many.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    # runs of one group are neighbours after the sort; a task keeps one group at a time
    order = ["t", "key", "i", "j"]
    dealt = many.select(*order, "fp").repartition(*order).sortWithinPartitions(*order)

    def compare(batches):
        held, last = [], None

        def done():
            got = _stars(np.concatenate(held).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(np.array([g[k] for g in got], np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if not batch.num_rows:
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for x, y in zip([0, *change], [*change, batch.num_rows], strict=True):
                now = tuple(int(c[x]) for c in cols[:4])
                if last is not None and now != last:
                    yield done()
                    held = []
                last = now
                held.append(cols[4][x:y])
        if held:
            yield done()

    return two.unionByName(dealt.mapInArrow(compare, "a long, b long")).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (all but the text, if None) with ``fingerprint`` (16 hex digits) and ``component_id``,
    the least id that any chain of links reaches."""
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in ("fingerprint", "component_id")]
    fp, of, own = fresh(df, "fp", "of", "own")
    ids = [] if doc_id in keep else [doc_id]
    marked = cut(fingerprints(df, text, fp, shingle, seed, [*keep, *ids]))
    # copies first: one row for each distinct fingerprint, whatever the ids of its rows
    groups = cut(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(f"`{doc_id}`").alias("rep")))
    named = _named(groups, links(groups, "fp", radius, chunk), "fp")
    back = marked.join(named.select(F.col("fp").alias(of), F.col("component_id").alias(own)), F.col(fp) == F.col(of))
    return back.select(*(F.col(f"`{c}`") for c in keep), F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), F.col(own).alias("component_id"))


def _named(groups: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """(node, component_id): the least ``rep`` among the nodes that the links ``found`` (a, b) join."""
    joined = components(found, "a", "b").select(F.col("node").alias(node), "component")
    named = cut(groups.select(node, "rep").join(joined, node, "left").select(node, "rep", F.coalesce("component", node).alias("all")))
    return cut(named.join(named.groupBy("all").agg(F.min("rep").alias("component_id")), "all").select(node, "component_id"))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(w: list[bytes], shingle: int) -> set[bytes]:
    """The set of a text's word shingles; fewer words are one shingle, none are none."""
    return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _name(w: list[bytes]) -> int:
    """What all texts of the same words share."""
    return xxhash.xxh64_intdigest(b" ".join(w), 7) - (1 << 63)


def two_hashes(w: list[bytes], shingle: int) -> np.ndarray:
    """Two independent hashes of each shingle of the set, a row each."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, SEED) for s in shingles(w, shingle)]), np.uint64).reshape(-1, 2)


def two_fingerprints(w: list[bytes], shingle: int) -> tuple[int, int]:
    """Two independent SimHashes, as signed longs, of the set of shingles."""
    return _majority(two_hashes(w, shingle))


def _majority(pairs: np.ndarray) -> tuple[int, int]:
    raw, ones = pairs.view(np.uint8).reshape(-1, 16), np.zeros(128, np.int64)
    for k in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[k : k + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(raw)).view(np.int64).tolist())


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """A map of ``bits`` (a power of two) bits: whether an odd number of hashes fall on each. Two maps differ in at most
    as many bits as two sets in shingles."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.int64)


def prefix(h: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many distinct hashes, rarest first, that two sets with a Jaccard similarity of ``least`` share
    n // SHARED + 1 of them (n: the smaller set's size). The order is by ``counts`` of the sorted hashes ``common``, 0 for others, then by hash:
    the same in all texts."""
    h = np.unique(h)
    take = len(h) - math.ceil(least * len(h) - 1e-9) + len(h) // SHARED + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
    return h[:take]


def block_tables(blocks: int = BLOCKS, kept: int = KEPT) -> list[tuple[int, tuple[int, ...]]]:
    """(fingerprint, first bits of the blocks) of each table."""
    size = 64 // blocks
    return [(word, tuple(size * b for b in some)) for word in (0, 1) for some in itertools.combinations(range(blocks), kept)]


def _forest(x: np.ndarray, y: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the minimum spanning forest of the rows' distances up to ``far`` (Prim)."""
    n = len(x)
    rest, near, of = np.arange(1, n), np.full(n - 1, 255, np.uint8), np.zeros(n - 1, np.int64)
    a, b, at = [], [], 0
    while len(rest):
        d = np.bitwise_count(x[rest] ^ x[at]) + np.bitwise_count(y[rest] ^ y[at])
        less = d < near
        near[less], of[less] = d[less], at
        k = int(near.argmin())
        at = rest[k]
        if near[k] <= far:
            a.append(of[k])
            b.append(at)
        rest[k], near[k], of[k] = rest[-1], near[-1], of[-1]
        rest, near, of = rest[:-1], near[:-1], of[:-1]
    return np.array(a, np.int64), np.array(b, np.int64)


def _close(x: np.ndarray, y: np.ndarray, far: int, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within ``far`` bits, or the edges of their forest if there are over ``few`` pairs a row."""
    found, total = [], 0
    for k in range(0, len(x), 256):
        d = np.bitwise_count(x[k : k + 256, None] ^ x[k:]) + np.bitwise_count(y[k : k + 256, None] ^ y[k:])
        a, b = np.nonzero(d <= far)
        ok = a < b
        found.append((a[ok] + k, b[ok] + k))
        total += int(ok.sum())
        if total > few * len(x):
            return _forest(x, y, far)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _in_runs(key: np.ndarray, near: Callable, run: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal ``key`` (sorted): those of runs of a few rows, all at once, for which ``near(a, b)`` is true;
    of a longer run, from place p with n rows, what ``run(p, n)`` gives, counted from p."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    left = np.repeat(np.where(size <= SMALL, first + size, 0), size) - np.arange(len(key))  # rows of the run from here on
    a, b = [], []
    here, step = np.flatnonzero(left > 1), 1
    while len(here):
        ok = near(here, here + step)
        a.append(here[ok])
        b.append(here[ok] + step)
        step += 1
        here = here[left[here] > step]
    for p, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        i, j = run(p, n)
        a.append(i + p)
        b.append(j + p)
    return (np.concatenate(a), np.concatenate(b)) if a else (first[:0], first[:0])


def _candidates(key: np.ndarray, x: np.ndarray, y: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows with equal ``key`` (sorted)."""
    near = lambda a, b: np.bitwise_count(x[a] ^ x[b]) + np.bitwise_count(y[a] ^ y[b]) <= far
    return _in_runs(key, near, lambda p, n: _close(x[p : p + n], y[p : p + n], far))


def _first(table: np.ndarray, x: np.ndarray, y: np.ndarray, blocks: int, kept: int) -> np.ndarray:
    """Whether ``table`` is the first whose blocks are zero in the differences ``x``, ``y`` of two rows' fingerprints."""
    size, first, done = 64 // blocks, np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    for t, (word, starts) in enumerate(block_tables(blocks, kept)):
        mask = np.uint64(sum(((1 << size) - 1) << s for s in starts))
        now = ~done & ((y if word else x) & mask == 0)
        first[now], done = t, done | now
    return first == table


def _whole(batches, n: int, rows: int = RUN):
    """The columns of runs of whole groups, rows with equal first ``n`` columns beside each other."""
    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:n]], axis=0)) + 1
        if held and any(c[0] != h[-1] for c, h in zip(cols[:n], held[-1][:n], strict=True)):
            change = np.r_[0, change]
        at = 0
        if len(change) and total + change[-1] >= rows:
            at = int(change[-1])
            held.append([c[:at] for c in cols])
            yield [np.concatenate(z) for z in zip(*held, strict=True)]
            held, total = [], 0
        held.append([c[at:] for c in cols])
        total += batch.num_rows - at
    if total:
        yield [np.concatenate(z) for z in zip(*held, strict=True)]


def _links(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The links of rows ``a`` and ``b``, each once."""
    both = np.unique(np.stack([np.minimum(name[a], name[b]), np.maximum(name[a], name[b])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _dealt(rows: DataFrame, key: str, chunk_of: str, *cols: str) -> DataFrame:
    """``rows`` dealt so that every two of a ``key`` meet: its ``parts`` chunks, by the hash of ``chunk_of``, pair by pair."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(chunk_of), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *cols)


def candidates(groups: DataFrame, far: int = FAR, blocks: int = BLOCKS, kept: int = KEPT, chunk: int = WIDE_CHUNK) -> DataFrame:
    """(a, b): names of distinct texts to be verified. ``groups`` has name, x and y (two fingerprints)."""
    size = 64 // blocks
    keys = []
    for t, (word, starts) in enumerate(block_tables(blocks, kept)):
        key = F.lit(t).cast("long")
        for s in starts:
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned("y" if word else "x", s).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(key)
    rows = groups.select(F.explode(F.array(*keys)).alias("key"), "name", "x", "y")
    # a crowded bucket is dealt in chunks; each pair of chunks is a task's group
    crowded = cut(rows.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts")))
    rows = rows.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    order = ["key", "i", "j"]
    dealt = _dealt(rows, "key", "name", "name", "x", "y").repartition(*order).sortWithinPartitions(*order)

    def run(batches):
        for key, i, j, name, x, y in _whole(batches, 3):
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            x, y = x.view(np.uint64), y.view(np.uint64)
            a, b = _candidates(np.cumsum(new), x, y, far)
            # a pair that meets in several tables is told by the first of them
            ok = _first(key[a] >> (size * kept), x[a] ^ x[b], y[a] ^ y[b], blocks, kept)
            yield _links(name, a[ok], b[ok])
        give_back()

    bound_batches(groups.sparkSession)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _common(rows: DataFrame, every: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes that are frequent in a sample of some ``SAMPLE`` of ``every`` texts, sorted, and their counts."""
    some = rows.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, every // SAMPLE))) == 0).distinct()
    told = map_text(some, "text", [T.StructField("h", T.ArrayType(T.LongType()))], lambda: lambda texts: [[two_hashes(words(t), shingle)[:, 0].view(np.int64).tolist() for t in texts]], [])
    got = told.select(F.explode("h").alias("h")).groupBy("h").count().filter(F.col("count") >= COMMON).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sharing(rows: DataFrame, groups: DataFrame, shingle: int, least: float) -> DataFrame:
    """(key, name, parts): the texts of ``rows`` that have a shingle of their ``prefix`` in common with another text."""
    every, entries = groups.agg(F.count("*"), F.sum(F.col("size") * (1 - least) + 1)).first()
    common, counts = _common(rows, every, shingle)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(entries or 0) // ENTRIES)

    def pack(batches):
        """Keys and names as packed numbers, a row for each part: rows of their own would take several times the room."""
        seen, keys, names, total = set(), [], [], 0

        def flush():
            key, name = np.concatenate(keys), np.concatenate(names)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
            cut_at = [*first[1:].tolist(), len(order)]
            take = [order[x:y] for x, y in zip(first.tolist(), cut_at, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[order][first]), pa.array([key[t].tobytes() for t in take], pa.binary()), pa.array([name[t].tobytes() for t in take], pa.binary())], names=["part", "keys", "names"])

        for batch in batches:
            for t in (t for piece in slices(batch, "text") for t in piece.column("text").to_pylist()):
                w = words(t)
                if not w or (name := _name(w)) in seen:
                    continue
                seen.add(name)
                keys.append(prefix(two_hashes(w, shingle)[:, 0], least, common, counts))
                names.append(np.full(len(keys[-1]), name, np.int64))
                total += len(keys[-1])
                if total >= ENTRIES:
                    yield flush()
                    keys, names, total = [], [], 0
        if total:
            yield flush()
        give_back()

    def meet(batches):
        held, last = [], None

        def done():
            key, name = (np.concatenate([np.frombuffer(h[k], kind) for h in held]) for k, kind in ((0, np.uint64), (1, np.int64)))
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]  # copies in several tasks
            key, name = key[new], name[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            n = np.repeat(size, size)
            ok = n > 1
            key, name, n = key[ok].view(np.int64), name[ok], n[ok]
            for k in range(0, len(key), RUN):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + RUN]), pa.array(name[k : k + RUN]), pa.array((n[k : k + RUN] + CHUNK - 1) // CHUNK)], names=["key", "name", "parts"])

        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "names")), strict=True):
                if held and part != last:
                    yield from done()
                    held = []
                last = part
                held.append(row)
        if held:
            yield from done()
        give_back()

    bound_batches(rows.sparkSession)
    packed = rows.select("text").mapInArrow(pack, "part long, keys binary, names binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, name long, parts long")


def _alike(size: np.ndarray, maps: np.ndarray, other: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes and parity maps can reach the similarity: no set that does is told apart."""
    apart = np.bitwise_count(maps ^ others).sum(-1, dtype=np.int64)
    return (apart <= (1 - least) / (1 + least) * (size + other) + 1e-9) & (np.minimum(size, other) >= least * np.maximum(size, other) - 1e-9)


def _search(size: np.ndarray, maps: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of rows that are ``_alike``: each row is met once."""
    a, b = [], []
    rest = np.arange(len(size))
    while len(rest):
        start, queue = rest[0], [(size[0], maps[0])]
        rest, size, maps = rest[1:], size[1:], maps[1:]
        while queue and len(rest):
            near = _alike(size, maps, *queue.pop(), least)
            if near.any():
                a += [start] * int(near.sum())
                b += rest[near].tolist()
                queue += list(zip(size[near], maps[near], strict=True))
                rest, size, maps = rest[~near], size[~near], maps[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def possible(rows: DataFrame, groups: DataFrame, shingle: int, least: float, shared: DataFrame | None = None) -> DataFrame:
    """(a, b): links between names whose components hold together all that a similarity of ``least`` joins, without
    exception, and little more. ``groups`` has name, size and the parity map of each text; ``shared`` is what ``sharing``
    gives, if it is there already."""
    shared = cut(sharing(rows, groups, shingle, least)) if shared is None else shared
    # a text with a partner shares as many entries as a partner of the least size has to share
    few = F.floor(F.ceil(F.col("size") * least - 1e-9) / SHARED) + 1
    enough = shared.groupBy("name").count().join(groups.select("name", "size", *MAP), "name").filter(F.col("count") >= few).drop("count")
    many = shared.join(enough, "name")
    order = ["key", "i", "j"]
    dealt = _dealt(many, "key", "name", "name", "size", *MAP).repartition(*order).sortWithinPartitions(*order)

    def run(batches):
        for key, i, j, name, size, *maps in _whole(batches, 3):
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            maps = np.stack(maps, 1).view(np.uint64)
            near = lambda a, b: _alike(size[a], maps[a], size[b], maps[b], least)  # noqa: B023, E731
            yield _links(name, *_in_runs(np.cumsum(new), near, lambda p, n: _search(size[p : p + n], maps[p : p + n], least)))  # noqa: B023
        give_back()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _settled(texts: list[str], known: np.ndarray, shingle: int, least: float) -> list[tuple[int, int]]:
    """Pairs of places in ``texts`` with a similarity of ``least`` that join, with the components ``known``, exactly what
    all such pairs join."""
    w = [words(t) for t in texts]
    hashes = [np.unique(two_hashes(one, shingle)[:, 0]) for one in w]
    size = np.array([len(h) for h in hashes])
    bits = min(WIDE_MAP, max(512, 1 << (4 * int(size.max())).bit_length()))
    maps = np.stack([parity(h, bits).view(np.uint64) for h in hashes])

    def similar(q: int, r: int) -> bool:
        both = len(np.intersect1d(hashes[q], hashes[r], assume_unique=True))
        return both >= least * (size[q] + size[r] - both) - 1e-6 and jaccard(shingles(w[q], shingle), shingles(w[r], shingle)) >= least

    out, rest = [], np.arange(len(w))
    while len(rest):
        mine = known[rest] == known[rest[0]]
        queue, rest = rest[mine].tolist(), rest[~mine]
        while queue and len(rest):
            q, joined = queue.pop(), set()
            fit = rest[np.minimum(size[rest], size[q]) >= least * np.maximum(size[rest], size[q]) - 1e-9]
            for r in fit[_alike(size[fit], maps[fit], size[q], maps[q], least)].tolist():
                if known[r] not in joined and similar(q, r):
                    out.append((q, r))
                    joined.add(known[r])
            if joined:
                mine = np.isin(known[rest], list(joined))
                queue, rest = queue + rest[mine].tolist(), rest[~mine]
    return out


def _enough(size: np.ndarray, keys: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join what all pairs join which share as many prefix entries as a similarity of ``least`` takes. Entries
    of a few texts are counted pair by pair, crowded ones by products of a 0-1 matrix."""
    n = len(size)
    key, row = np.concatenate(keys), np.repeat(np.arange(n), [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[first, len(key)])
    count = np.zeros((n, n), np.float32)
    left = np.repeat(np.where(many <= CROWDED, first + many, 0), many) - np.arange(len(key))  # texts of the entry from here on
    here, step = np.flatnonzero(left > 1), 1
    while len(here):
        np.add.at(count, (row[here], row[here + step]), np.float32(1))  # rows of an entry ascend
        step += 1
        here = here[left[here] > step]
    crowded = np.flatnonzero(many > CROWDED)
    for k in range(0, len(crowded), COLUMNS):
        some = np.zeros((n, min(COLUMNS, len(crowded) - k)), np.float32)
        for c, e in enumerate(crowded[k : k + COLUMNS].tolist()):
            some[row[first[e] : first[e] + many[e]], c] = 1
        count += some @ some.T
    out, rest = [], np.arange(n)
    while len(rest):
        start, queue, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            low, high = np.minimum(size[rest], size[q]), np.maximum(size[rest], size[q])
            near = (count[np.minimum(rest, q), np.maximum(rest, q)] >= low // SHARED + 1) & (low >= least * high - 1e-9)
            out += [(start, r) for r in rest[near].tolist()]
            queue += rest[near].tolist()
            rest = rest[~near]
    return out


def refined(bulk: DataFrame, shared: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(a, b): links inside of the groups ``bulk`` (name, bulk) that hold together all that a similarity of ``least`` joins.
    A parity map tells long texts apart badly; here the prefix entries that two texts share are counted, chunk by chunk."""
    held = shared.join(bulk.select("name", "bulk"), "name").groupBy("bulk", "name").agg(F.collect_set("key").alias("keys")).join(groups.select("name", "size"), "name")
    held = cut(held)
    size = held.groupBy("bulk").agg(F.ceil(F.greatest(F.count("*") / COUNTED, F.sum(F.size("keys")) / COUNTED_ENTRIES)).cast("int").alias("parts"))
    dealt = _dealt(held.join(size, "bulk"), "bulk", "name", "name", "size", "keys")

    def count(group: pa.Table) -> pa.Table:
        name = group.column("name").to_numpy()
        keys = [k.values.to_numpy(zero_copy_only=False) for c in group.column("keys").chunks for k in c]
        at = np.array(_enough(group.column("size").to_numpy(), keys, least), np.int64).reshape(-1, 2)
        give_back()
        return pa.table({"a": name[at[:, 0]], "b": name[at[:, 1]]})

    return _spread(dealt).groupBy("bulk", "i", "j").applyInArrow(count, "a long, b long").distinct()


def _spread(rows: DataFrame) -> DataFrame:
    """Pairs of chunks dealt to all tasks: they are small, but dear."""
    return rows.repartition(max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bulk", "i", "j")


def completed(found: DataFrame, wide: DataFrame, texts: DataFrame, shingle: int, least: float, shared: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(a, b): the links missing from ``found`` to join what all pairs join that are as similar as ``least``. ``wide`` has
    what ``possible`` gives, ``texts`` the name and text of all that it names. Components of ``wide`` that ``found`` has not
    joined wholly are compared, in chunks of bounded size, two at a time; larger ones are ``refined`` first, if ``shared``
    and ``groups`` are given."""
    known = components(found, "a", "b").select(F.col("node").alias("name"), F.col("component").alias("known"))
    bulk = components(wide, "a", "b").select(F.col("node").alias("name"), F.col("component").alias("bulk"))
    told = cut(bulk.join(known, "name", "left").select("name", "bulk", F.coalesce("known", "name").alias("known")))
    unsettled = lambda told: told.groupBy("bulk").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.count("*").alias("n")).filter("x < y")
    apart = unsettled(told).select("bulk")
    if shared is not None:
        large = told.join(unsettled(told).filter(F.col("n") > REFINED).select("bulk"), "bulk", "left_semi")
        finer = components(cut(refined(large, shared, groups, least)), "a", "b").select(F.col("node").alias("name"), F.col("component").alias("finer"))
        # a text of a large group without a link is alone
        told = cut(told.join(large.select("name", F.lit(True).alias("large")), "name", "left").join(finer, "name", "left").select("name", F.when(F.col("large"), F.coalesce("finer", "name")).otherwise(F.col("bulk")).alias("bulk"), "known"))
        apart = unsettled(told).select("bulk")
    left = cut(told.join(apart, "bulk", "left_semi").join(texts, "name"))
    size = left.groupBy("bulk").agg(F.ceil(F.greatest(F.count("*") / SETTLED, F.sum(F.octet_length("text")) / SETTLED_BYTES)).cast("int").alias("parts"))
    dealt = _dealt(left.join(size, "bulk"), "bulk", "name", "name", "known", "text")

    def settle(group: pa.Table) -> pa.Table:
        name = group.column("name").to_numpy()
        got = _settled(group.column("text").to_pylist(), group.column("known").to_numpy(), shingle, least)
        at = np.array(got, np.int64).reshape(-1, 2)
        return pa.table({"a": name[at[:, 0]], "b": name[at[:, 1]]})

    return _spread(dealt).groupBy("bulk", "i", "j").applyInArrow(settle, "a long, b long").distinct()


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = LEAST, **how) -> DataFrame:
    """(doc_id, component_id), a row for each of ``df``: the least id that a chain of texts reaches whose shingle sets
    have a Jaccard similarity of at least ``least``. ``df`` is read twice, so it should be a table."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def start():
        def work(texts):
            split = [words(t) for t in texts]
            pairs = [two_hashes(w, shingle) for w in split]
            two = [_majority(p) for p in pairs]
            maps = [parity(p[:, 0], 64 * len(MAP)).tolist() for p in pairs]
            return [[_name(w) for w in split], [t[0] for t in two], [t[1] for t in two], [len(p) for p in pairs], *([m[k] for m in maps] for k in range(len(MAP)))]

        return work

    marked = cut(map_text(rows, "text", [T.StructField(c, T.LongType()) for c in ("name", "x", "y", "size", *MAP)], start, ["doc_id"]))
    groups = cut(marked.groupBy("name").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("x", "y", "size", *MAP))))
    pairs = cut(candidates(groups, **how))
    shared = cut(sharing(rows, groups, shingle, least))
    wide = cut(possible(rows, groups, shingle, least, shared))
    ends = pairs.union(wide)
    asked = cut(ends.select(F.col("a").alias("name")).union(ends.select(F.col("b").alias("name"))).distinct())
    named = map_text(rows, "text", [T.StructField("name", T.LongType())], lambda: lambda texts: [[_name(words(t)) for t in texts]])
    texts = cut(named.join(asked, "name", "left_semi").groupBy("name").agg(F.min("text").alias("text")))
    both = pairs.join(texts.select(F.col("name").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("name").alias("b"), F.col("text").alias("t")), "b")

    def verify(batches):
        for batch in batches:
            for part in slices(batch, "s"):
                near = [jaccard(shingles(words(s), shingle), shingles(words(t), shingle)) >= least for s, t in zip(part.column("s").to_pylist(), part.column("t").to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        give_back()

    found = cut(both.select("a", "b", "s", "t").mapInArrow(verify, "a long, b long"))
    rest = cut(completed(found, wide, texts, shingle, least, shared, groups))
    return marked.select("doc_id", "name").join(_named(groups, found.union(rest), "name"), "name").select("doc_id", "component_id")


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
