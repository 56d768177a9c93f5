import itertools
import random
import re
import unittest.mock

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import simhash
from tilewright.llm.components import components

from .helpers import SF, awkward, crowded, prose


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[root(j)] = root(i)
    return [root(i) for i in range(len(fps))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbBé \n\t\x1c.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.masks(radius)
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(diff & m == 0 for m in masks)
    if radius == 2:
        assert all(any((1 << a | 1 << b) & m == 0 for m in masks) for a, b in itertools.combinations(range(64), 2))


@pytest.mark.parametrize("chunk", [8, 1024])
def test_links_join_what_brute_force_joins(spark, chunk):
    """A crowd of near fingerprints, dealt in chunks, chains and strangers."""
    rng = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    base = rng.getrandbits(64)
    fps = {base} | {flip(base, rng.randint(1, 2)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)}
    chain = rng.getrandbits(64)
    for _ in range(20):
        fps.add(chain)
        chain = flip(chain, 2)
    fps = sorted(fps)
    table = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = simhash.links(table, chunk=chunk).collect()
    place = {simhash._signed(x): i for i, x in enumerate(fps)}
    want = brute_components(fps, 2)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        assert want[place[r["a"]]] == want[place[r["b"]]]
        parent[root(place[r["b"]])] = root(place[r["a"]])
    assert len({root(i) for i in range(len(fps))}) == len(set(want))
    assert len(got) < 10 * len(fps)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    least = {n: n for link in links for n in link}
    for _ in range(300):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {n: c for n, c in least.items() if any(a != b for a, b in links if n in (a, b))}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d["text"]) for d in docs]
    groups = brute_components(fps, 2)
    least = {}
    for d, g in zip(docs, groups, strict=True):
        least.setdefault(g, d["doc_id"])
    want = sorted((d["doc_id"], f"{f:016x}", least[g]) for d, f, g in zip(docs, fps, groups, strict=True))
    assert sorted(tuple(r) for r in simhash.op9_covering_simhash(spark, SF).collect()) == want


def test_null_ids_bridge(spark):
    """A document without an id links its neighbours like any other."""
    docs = spark.createDataFrame([(9, "x"), (None, "y"), (3, "z")], "doc_id long, text string")
    fps = {"x": 0, "y": 3, "z": 15}
    def faked(df, text, out, shingle, seed, keep):
        return df.select(*keep, F.create_map(*(F.lit(v) for kv in fps.items() for v in kv))[F.col(text)].cast("long").alias(out))

    with unittest.mock.patch.object(simhash, "fingerprints", faked):
        got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, f"{15:016x}", 3), (9, f"{0:016x}", 3), (None, f"{3:016x}", 3)]


def test_awkward_names(spark):
    rows = awkward(spark)
    more = rows.select("*", *(F.lit(1).alias(c) for c in ("_fp", "_fp2", "_of", "fp", "rep", "_OWN", "all", "node")))
    key = lambda df: sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())
    got = simhash.near_duplicates(more)
    assert got.columns == [c for c in more.columns if c != "text"] + ["fingerprint", "component_id"] and key(got) == key(simhash.near_duplicates(rows))


def brute_near(rows, least=0.8):
    """The least id of what each row's text reaches through pairs of at least ``least``."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else set() for _, t in rows]
    at = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if at[i] != at[j] and (sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both)):
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    return {d: rows[a][0] for (d, _), a in zip(rows, at, strict=True)}


def planted():
    """Texts of 200 words and copies with up to five of them changed, in capitals."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        w = prose(rng, 200).split()
        rows.append((len(rows), " ".join(w)))
        for p in rng.sample(range(200), k % 6):
            w[p] = "changed"
        rows.append((len(rows), " ".join(w).upper()))
    return rows


def test_near_copies_equal_brute_force(spark):
    rows = planted()
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_near(rows)
    assert len(got) == len(want) and 60 < len(set(want.values())) < 120
    assert all(want[c] == want[d] for d, c in got.items())  # no link below the similarity
    assert sum(got[d] == c for d, c in want.items()) >= 0.95 * len(want)


def test_links_that_the_tables_miss_are_found(spark):
    """With no candidate but equal fingerprints: pairs and a crowd whose pairs lie on both sides of the similarity."""
    rng = random.Random(8)
    rows, base = planted(), prose(rng, 150).split()
    for _ in range(80):
        w = list(base)
        for p in rng.sample(range(150), rng.randint(1, 5)):
            w[p] = prose(rng, 1)
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(prose(rng, 30).split() * 2 + base[:40])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_near(rows)
    for how in ({"far": 0}, {}):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, **how).collect()} == want


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(9)
    for n in (1, 4, 5, 9, 10, 60, 500):
        h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        common, counts = np.sort(h[::3]), rng.integers(1, 9, len(h[::3]))
        for change in range(n // 5 + 1):
            # change gone, as many come as the similarity allows
            come = rng.integers(0, n // 4 + 1)
            a, b = h[:n], np.r_[h[change:n], h[n : n + come]]
            both = n - change
            if both >= 0.8 * (len(a) + len(b) - both):
                shared = np.intersect1d(simhash.prefix(a, 0.8, common, counts), simhash.prefix(b, 0.8, common, counts))
                assert len(shared) >= min(len(a), len(b)) // simhash.SHARED + 1


def test_crowded_buckets_give_the_same_components(spark):
    """A crowd of near fingerprints: by pairs, by forests, and dealt in small chunks."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    flips = (rng.random((6, 120, 2, 64)) < 0.05).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    x, y = (base[:, None] ^ flips.sum(-1, dtype=np.uint64)).reshape(-1, 2).T
    d = np.bitwise_count(x[:, None] ^ x) + np.bitwise_count(y[:, None] ^ y)

    def joined(pairs):
        at = np.arange(len(x))
        for a, b in pairs:
            at[at == max(at[a], at[b])] = min(at[a], at[b])
        return at

    want = joined(np.argwhere(d <= 20))
    few, forest = simhash._close(x, y, 20, few=10**9), simhash._close(x, y, 20, few=0)
    assert len(few[0]) == (d <= 20).sum() // 2 - len(x) // 2 and len(forest[0]) == len(x) - len(set(want))
    assert (joined(zip(*few, strict=True)) == want).all() and (joined(zip(*forest, strict=True)) == want).all()
    groups = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x.view(np.int64), y.view(np.int64), strict=True))], "name long, x long, y long")
    whole = {(r["a"], r["b"]) for r in simhash.candidates(groups, far=20).collect()}
    dealt = {(r["a"], r["b"]) for r in simhash.candidates(groups, far=20, chunk=16).collect()}
    assert all(d[a, b] <= 20 for a, b in whole | dealt)
    assert (joined(whole) == want).all() and (joined(dealt) == want).all()


def test_near_copies_of_awkward_rows(spark):
    rows = crowded(awkward(spark))
    got = simhash.near_copies(rows)
    assert got.count() == rows.count()
    of = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert of[12] == of[13] == of[14] == 12 and of[17] == 1 and of[15] == 15
    assert simhash.near_copies(rows.limit(0)).count() == 0


def test_awkward_rows(spark):
    rows = crowded(awkward(spark))
    got = simhash.near_duplicates(rows)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert {by[i]["fingerprint"] for i in (12, 13, 14)} == {"0" * 16} and {by[i]["component_id"] for i in (12, 13, 14)} == {12}
    assert by[17]["component_id"] == 1 and by[None]["component_id"] is not None
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
    assert np.bitwise_count(np.uint64(7)) == 3


def test_tables_can_be_dropped(spark):
    from tilewright.llm import common

    table = common.cut(spark.range(3))
    assert table.count() == 3
    path = table.inputFiles()[0]
    common.drop_tables(spark)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(path).count()
