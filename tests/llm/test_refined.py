"""Large groups of long texts, which parity maps can't tell apart, are told apart by the entries that they share."""

import itertools

import numpy as np

from tilewright.llm import simhash
from tilewright.llm.components import components


def test_enough_counts_every_pair(monkeypatch):
    r = np.random.default_rng(3)
    for crowded in (2, 64):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        monkeypatch.setattr(simhash, "COLUMNS", 3)
        keys = [np.unique(r.integers(0, 60, r.integers(1, 30))) for _ in range(40)]
        size = np.array([len(k) * 4 for k in keys])
        pairs = [(a, b) for a, b in itertools.combinations(range(40), 2) if len(np.intersect1d(keys[a], keys[b])) >= min(size[a], size[b]) // simhash.SHARED + 1 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])]
        assert _groups(simhash._enough(size, keys, 0.8), 40) == _groups(pairs, 40)


def _groups(links, n):
    of = list(range(n))
    for a, b in links:
        x, y = of[a], of[b]
        of = [min(x, y) if o in (x, y) else o for o in of]
    return of


def test_long_texts_with_passages_in_common_are_told_apart(spark):
    r = np.random.default_rng(1)
    draw = lambda k: [f"w{x}" for x in r.integers(0, 100_000, k)]
    passages = [draw(260) for _ in range(46)]  # each in two texts: too little to be similar
    texts = [" ".join(passages[k] + draw(1940) + passages[k + 1]) for k in range(45)]
    words = texts[0].split()
    texts.append(" ".join(words[:2250] + draw(210)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = lambda t: simhash.two_hashes(simhash.words(t), 5)[:, 0]
    names = [simhash._name(simhash.words(t)) for t in texts]
    groups = spark.createDataFrame([(names[k], len(one(t)), *simhash.parity(one(t), 64 * len(simhash.MAP)).tolist()) for k, t in enumerate(texts)], ", ".join(f"{c} long" for c in ("name", "size", *simhash.MAP)))
    shared = simhash.sharing(rows, groups, 5, 0.8)
    wide = components(simhash.possible(rows, groups, 5, 0.8, shared), "a", "b")
    assert wide.groupBy("component").count().agg({"count": "max"}).first()[0] > 40  # all in one group before
    bulk = wide.selectExpr("node AS name", "component AS bulk")
    assert {tuple(sorted(x)) for x in simhash.refined(bulk, shared, groups, 0.8).collect()} == {tuple(sorted((names[0], names[45])))}
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(rows).collect()}
    assert got == {**{k: k for k in range(45)}, 45: 0}
