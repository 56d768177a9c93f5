"""Near-duplicate vectors through a pivot-permutation index.

A bounded sample gives the pivots: reference vectors far from one another. Each vector is described by the ordered
list of its ``nearest`` pivots. An inverted list holds the vectors that have ``shared`` given pivots among them, so that
the lists two vectors meet in count the pivots they share, and meeting at all means sharing enough. A pair counts in one list
only, that of the least pivots it shares: a posting carries its lesser pivots beside the list's own (its rest), and two
vectors of a list belong there if their rests have no pivot in common. Rests are counted by list before any vector is moved;
postings whose rest meets no other that it has nothing in common with are dropped, so that a crowd of like vectors is
compared in one list, not in all. Long lists are dealt in chunks of at most ``chunk`` vectors, every pair of chunks being
one group; a group multiplies its vectors, verifies the cosine in double precision and returns link counts and its
components as stars, never all pairs. Equal vectors of a label are one class throughout, told by a number of its own.

There are C(pivots, shared) lists for each label and length; ``pivots`` grows with the largest label's vectors so that
lists hold few by chance at any size. Recall is measured in tests/llm/test_embeddings.py.

Defined results: null vectors or labels, empty and zero vectors, and vectors with a null or non-finite component link
with nothing and are their own component; vectors of different length never link; rows that share a vec_id are vectors
of their own; a vector with a null vec_id links like any other, and its component's id is null if no other has one;
equal cosines and repeated rows all count; input columns other than the three are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, table
from .components import components

COSINE = 0.98
#: Fewest pivots, whatever the number of vectors.
PIVOTS = 128
NEAREST = 6
SHARED = 3
SAMPLE = 2000
#: Pivots of the sample are at most this near to one another.
APART = 0.5
CHUNK = 256


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, apart: float = APART, seed: int = 5) -> np.ndarray:
    """Sampled vectors pairwise below ``apart`` in cosine, filled up with random directions."""
    out = np.empty((0, sample.shape[1]))
    for v in sample:
        if len(out) < pivots and (not len(out) or (out @ v).max() < apart):
            out = np.vstack([out, v])
    rng = np.random.default_rng(seed)
    return np.vstack([out, unit(rng.normal(size=(pivots - len(out), sample.shape[1])))]) if len(out) < pivots else out


def _matrix(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Links from the first row of each component of the symmetric matrix ``near`` to its others."""
    out, rest = [], np.arange(len(near))
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            hit = near[queue.pop(), rest]
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                out += [(first, y) for y in found]
                queue += list(found)
    return out


def pivots_for(vectors: int, shared: int = SHARED, least: int = PIVOTS) -> int:
    """The number of pivots with at least as many lists as a label has vectors."""
    n = least
    while math.comb(n, shared) < vectors:
        n += 1 + n // 16
    return n


def _runs(batches, keys: int, most: int):
    """(columns of a run of whole groups as numpy arrays or Arrow arrays, starts of its groups) from sorted batches
    whose first ``keys`` columns tell groups apart; a run has about ``most`` rows."""
    held, rows = [], 0

    def made():
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [t.column(k).to_numpy() for k in range(keys)]
        new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        return t, np.flatnonzero(np.r_[True, new])

    for b in batches:
        if not b.num_rows:
            continue
        if rows >= most:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            if any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(keys)):
                at = 0
            elif new.any():
                at = int(np.flatnonzero(new)[0]) + 1
            else:
                at = b.num_rows
            if at:
                held.append(b.slice(0, at))
            if at < b.num_rows:
                yield made()
                held, rows, b = [], 0, b.slice(at)
            else:
                rows += at
                continue
        held.append(b)
        rows += b.num_rows
    if held:
        yield made()


def _meets(rests: np.ndarray, counts: np.ndarray, pivots: int) -> np.ndarray:
    """Which distinct rests of a list (pivots, -1 where none) meet another, or the same twice, without a common pivot."""
    member = np.zeros((len(rests), pivots + 1), np.float32)
    member[np.arange(len(rests))[:, None], rests] = 1
    member = member[:, :pivots]
    out = np.zeros(len(rests), bool)
    for k in range(0, len(rests), 1024):
        apart = member[k : k + 1024] @ member.T == 0
        own = np.arange(k, min(k + 1024, len(rests)))
        apart[own - k, own] &= counts[own] > 1
        out[k : k + 1024] = apart.any(1)
    return out


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bound_batches(spark)
    all_ = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce((v == v) & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False)))
    sound = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    classes = cut(all_.filter(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    if pivots is None:
        pivots = pivots_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, shared)
    drawn = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toArrow()["embedding"].combine_chunks()
    size = int(np.bincount(drawn.value_lengths().to_numpy()).argmax()) if len(drawn) else 1
    main = choose_pivots(_matrix(drawn.filter(pc.equal(drawn.value_lengths(), size))) if len(drawn) else np.empty((0, 1)), pivots)
    points = spark.sparkContext.broadcast(main)  # pivots vectors of the sample

    def describe(batches):
        other = {size: points.value}
        for b in batches:
            length = b.column("embedding").value_lengths().to_numpy()
            near = np.zeros((len(length), nearest), np.int16)
            for d in np.unique(length):
                if d not in other:
                    other[d] = choose_pivots(np.empty((0, d)), pivots)
                at = np.flatnonzero(length == d)
                near[at] = np.argsort(-(_matrix(b.column("embedding").take(pa.array(at))) @ other[d].T), 1, kind="stable")[:, :nearest]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, nearest), pa.int32()), pa.array(near.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("label"), pa.array(length.astype(np.int32)), b.column("n"), b.column("embedding"), lists], names=["class", "label", "dim", "n", "embedding", "pivots"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    described = cut(classes.mapInArrow(describe, f"class long, label {kinds['label']}, dim int, n long, embedding {kinds['embedding']}, pivots array<short>"))
    # a posting: the list's pivots as one number, and its rest as another (pivot + 1 as digits)
    order, base = F.array_sort("pivots"), pivots + 1
    postings = []
    for c in itertools.combinations(range(nearest), shared):
        key = sum((F.element_at(order, i + 1).cast("long") * pivots**k for k, i in enumerate(c)), F.lit(0).cast("long"))
        rest = sum(((F.element_at(order, i + 1).cast("long") + 1) * base**k for k, i in enumerate(i for i in range(c[-1]) if i not in c)), F.lit(0).cast("long"))
        postings.append(F.struct(key.alias("key"), rest.alias("rest")))
    name = ["label", "dim", "key"]
    posted = described.select("class", "label", "dim", F.inline(F.array(*postings)))
    rests = posted.groupBy(*name, "rest").agg(F.count("*").alias("m")).repartition(*name).sortWithinPartitions(*name)
    held = nearest - shared

    def meeting(batches):
        for t, first in _runs(batches, 3, 50_000):
            rest, m = t["rest"].to_numpy(), t["m"].to_numpy()
            digits = np.stack([rest // base**k % base for k in range(held)], 1) - 1
            alive, total = np.zeros(len(rest), bool), np.zeros(len(rest), np.int64)
            last = np.r_[first[1:], len(rest)]
            one = last - first == 1
            alive[first[one]] = (rest[first[one]] == 0) & (m[first[one]] > 1)
            for p, q in zip(first[~one].tolist(), last[~one].tolist(), strict=True):
                alive[p:q] = _meets(digits[p:q], m[p:q], pivots)
            size_ = np.add.reduceat(np.where(alive, m, 0), first)
            total = np.repeat(size_, last - first)
            keep = pa.array(alive)
            yield from t.select([*name, "rest"]).append_column("size", pa.array(total)).filter(keep).to_batches()

    shape = f"label {kinds['label']}, dim int, key long, rest long, size long"
    alive = cut(rests.mapInArrow(meeting, shape))
    dealt = posted.join(alive, [*name, "rest"]).withColumn("parts", F.ceil(F.col("size") / chunk).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    group = [*name, "i", "j"]
    full = dealt.select(*group, "mine", "rest", "class").join(described.select("class", "n", "embedding"), "class")
    full = full.select(*group, "mine", "rest", "class", "n", "embedding").repartition(*group).sortWithinPartitions(*group)

    def verify(batches):
        for t, first in _runs(batches, 5, 4 * chunk):
            one, two, mine, rest, class_, n = (t[c].to_numpy() for c in ("i", "j", "mine", "rest", "class", "n"))
            rows_ = t["embedding"].combine_chunks()
            digits = np.stack([rest // base**k % base for k in range(held)], 1) - 1
            links, at, stars = [], [], []
            for p, q in zip(first.tolist(), [*first[1:].tolist(), len(rest)], strict=True):
                v = _matrix(rows_.slice(p, q - p))
                near = v @ v.T >= cosine
                if rest[p:q].any():
                    member = np.zeros((q - p, pivots + 1), np.float32)
                    member[np.arange(q - p)[:, None], digits[p:q]] = 1
                    near &= member[:, :pivots] @ member[:, :pivots].T == 0
                i, j = one[p], two[p]
                if i != j:
                    near &= mine[p:q, None] != mine[None, p:q]
                np.fill_diagonal(near, False)
                got = near @ n[p:q]
                some = np.flatnonzero(got)
                at.append(class_[p:q][some])
                links.append(got[some])
                stars += [(class_[p + a], class_[p + b]) for a, b in _stars(near)]
            at_, links_ = np.concatenate(at), np.concatenate(links).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at_), pa.nulls(len(at_), pa.int64()), pa.array(links_)], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(np.array([s[k] for s in stars], np.int64)) for k in (0, 1)] + [pa.array(np.zeros(len(stars), np.int64))], names=["a", "b", "links"])

    found = cut(full.mapInArrow(verify, "a long, b long, links long"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b IS NOT NULL").select("a", "b"), "a", "b").select(F.col("node").alias("class"), "component")
    told = cut(classes.join(counts, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")))
    told = told.join(told.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    final = cut(told.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("told")))
    back = all_.join(final, (all_["label"] == final["_label"]) & (all_["embedding"] == final["_embedding"]), "left")
    own = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("vec_id"))
    return back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op3_pivot_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
