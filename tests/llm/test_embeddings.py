import numpy as np
import pytest

from tilewright.llm import embeddings

from .helpers import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], n[i], least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows) if r[0] is not None)


def clustered(n, seed, dims=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dims))
    out = []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        noise = rng.normal(size=dims) * np.linalg.norm(c) / np.sqrt(dims) * rng.choice([0, 0.05, 0.12, 0.3])
        out.append((i, [float(x) for x in (c + noise).astype(np.float32)], int(rng.integers(2))))
    return out


@pytest.mark.parametrize("chunk", [4, 1024])
def test_against_brute_force(spark, chunk):
    """Components and counts equal brute force; chunks of four deal every list over many groups."""
    rows = clustered(240, 1)
    got = sorted(tuple(r) for r in embeddings.link(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect())
    want = brute(rows)
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert true > 100 and 0.95 * true <= found <= true
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_repeated_ids_are_vectors_of_their_own(spark):
    """One vec_id under two labels and with two lengths; a row without an id bridges two others."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees))), 0.0]
    rows = [(1, at(0), 0), (1, at(0), 1), (2, at(5), 1), (1, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (7, at(90), 3), (None, at(100), 3), (5, at(110), 3), (None, at(200), 3)]
    got = embeddings.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False), (7, 1, 5, False), (None, 2, 5, False), (5, 1, 5, True), (None, 0, None, True)], key=str)


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame(clustered(400, 3, 64), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder in (SF, str(tmp_path)):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
        got, want = sorted(tuple(r) for r in embeddings.op3_pivot_neardup(spark, folder).collect()), brute(rows)
        true = sum(w[1] for w in want)
        assert len(got) == len(want) and 0.95 * true <= sum(g[1] for g in got) <= true
        assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)
    assert true > 100


def test_rests_that_meet():
    rests = np.array([[-1, -1, -1], [2, -1, -1], [2, 5, -1], [5, -1, -1], [2, 5, 6]])
    count = lambda *n: np.array(n)
    assert embeddings._meets(rests, count(1, 1, 1, 1, 1), 9).tolist() == [True] * 5
    assert embeddings._meets(rests[1:], count(3, 3, 3, 3), 9).tolist() == [True, False, True, False]
    assert embeddings._meets(rests[:1], count(1), 9).tolist() == [False] and embeddings._meets(rests[:1], count(2), 9).tolist() == [True]


@pytest.mark.parametrize("vectors", [5_000, 30_000_000])
def test_recall_on_near_pairs(vectors):
    """Pairs at cosine 0.98 share three of six pivots in nearly all cases, also with the pivots of a large index."""
    rng = np.random.default_rng(2)
    x = embeddings.unit(rng.normal(size=(4000, 64)))
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = embeddings.unit(0.98 * x + np.sqrt(1 - 0.98**2) * embeddings.unit(noise))
    pivots = embeddings.choose_pivots(x[:2000], embeddings.pivots_for(vectors))
    near = lambda v: np.argsort(-(v @ pivots.T), 1)[:, : embeddings.NEAREST]
    shared = [len({*a} & {*b}) for a, b in zip(near(x).tolist(), near(y).tolist(), strict=True)]
    assert np.mean([s >= embeddings.SHARED for s in shared]) >= 0.97


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0), (9, [1.0, None, 2.0], 0), (10, [1.0, float("nan"), 2.0], 0), (11, [float("inf"), 1.0, 1.0], 0), (12, [1.0, 2.0], 0), (13, [3.0, -1.0, 0.5], 0)]
    got = sorted(tuple(r) for r in embeddings.link(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
    assert got[0] == (1, 2, 1, True) and got[2] == (3, 2, 1, False)
    twice = spark.createDataFrame([*rows, rows[0], (None, v, 0)], SCHEMA).selectExpr("*", "1 as n", "2 as rep", "3 as links")
    again = embeddings.link(twice)
    assert again.count() == len(rows) + 2
    assert {r["n_links"] for r in again.filter("vec_id = 1").collect()} == {4}  # the row without an id counts
    assert [tuple(r) for r in again.filter("vec_id is null").collect()] == [(None, 4, 1, False)]
    assert embeddings.link(spark.createDataFrame([], SCHEMA)).count() == 0
