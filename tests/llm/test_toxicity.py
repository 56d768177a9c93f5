import random
import zlib

import numpy as np
import pytest

from tilewright.llm import toxicity

from .helpers import SF, awkward, crowded, prose

ROOTS = ["grumbl", "snarkel", "vexwort"]


def corpus(n, seed, toxic_share=0.4, endings="abcdefghijklm"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(30, 300)).split()
        toxic = int(rng.random() < toxic_share)
        for _ in range(max(2, len(words) // 50) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(ROOTS) + rng.choice(endings) * rng.randint(1, 2))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(900, 1)
    return toxicity.fit([(c, t) for _, t, c in rows], (sum(1 - c for *_, c in rows), sum(c for *_, c in rows)))


def test_unseen_endings_are_caught(model):
    rows = corpus(200, 2, endings="nopqrstuvwxyz")
    p = model.scores([t for _, t, _ in rows]) >= 0.3
    y = np.array([c for *_, c in rows]) == 1
    assert (p & y).sum() >= 0.85 * y.sum() and (p & ~y).sum() <= 0.05 * (~y).sum()


def test_length_does_not_dilute(model):
    long = prose(random.Random(9), 5000)
    a, b = model.scores([long, f"{long} grumblx snarkelz vexwortq grumbly {long}"])
    assert a < 0.3 <= b


def test_features_average_words():
    idx, weight = toxicity.features("aa bb aa")
    assert weight.sum() == pytest.approx(1) and len(idx) == len(set(idx.tolist()))
    bucket, n = toxicity.subwords(["word", "a"])
    assert n.tolist() == [1 + 4 + 3 + 2 + 1, 1 + 1] and len(bucket) == n.sum()
    assert toxicity.features(" \n ")[0].size == 0


def test_operator(spark):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows if i % 4] + [(None, 1), (10**6, 1), (3, None)], "doc_id long, toxic int")
    fitted = toxicity.learn(docs, labels, per_class=200)
    got = toxicity.score(docs, fitted).collect()
    held = [(r["score"] >= 0.3) == bool(rows[r["doc_id"]][2]) for r in got if r["doc_id"] % 4 == 0]
    assert np.mean(held) >= 0.9


def test_awkward_rows(spark, model):
    rows = crowded(awkward(spark))
    got = toxicity.score(rows, model)
    assert got.count() == rows.count()
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert len({r["score"] for r in got.filter("doc_id in (12, 13, 14)").collect()}) == 1
    empty = toxicity.learn(rows.select("doc_id", "text"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert len({round(r["score"], 9) for r in toxicity.score(rows, empty).collect()}) == 1
    assert toxicity.score(rows.limit(0), model).count() == 0


def slow_averages(model, text):
    """The two averages by their definition."""
    words = text.lower().split()
    score = {w: model.word_scores([w])[0] for w in words}
    each = [0 if w in words[max(0, i - toxicity.SEGMENT + 1) : i] else score[w] for i, w in enumerate(words)]
    ends = range(1, len(words) + 1)
    return sum(score.values()) / max(len(score), toxicity.SEGMENT), max(sum(each[max(0, e - toxicity.SEGMENT) : e]) for e in ends) / toxicity.SEGMENT


@pytest.mark.parametrize("part", [40, 1 << 18])
def test_averages_at_every_place(model, part, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", part)
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 5, 9, 60)] + ["a b a b a b snarkela a b " * 4, "one  two\n three"]
    got = model.averages([*texts, "", None])
    assert got[:-2] == pytest.approx(np.array([slow_averages(model, t) for t in texts])) and not got[-2:].any()
    # a phrase counts alike wherever it stands
    phrase = "grumblx snarkelz vexwortq grumbly"
    assert len({round(model.averages([" ".join([*["house"] * k, phrase, *["house"] * 20])])[0, 1], 9) for k in range(12)}) <= 2


def test_query_on_held_out_documents(spark):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = toxicity.op6_subword_toxicity(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_repeated_labels_and_documents_count_once(spark):
    rows = corpus(60, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int")
    a, b = (toxicity.learn(d, x, epochs=1) for d, x in ((docs, labels), (docs.union(docs), labels.union(labels).union(labels))))
    assert (a.weights == b.weights).all() and a.bias == b.bias
