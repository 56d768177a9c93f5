import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import scoring

from .helpers import SF, awkward, crowded


def slow_probability(grams, contexts, key, order):
    """PPM by its definition: escape from context to context, excluding what was seen."""
    symbol, excluded, p = key & 511, set(), 1.0
    for k in range(order, -1, -1):
        context = (key >> 9) & ((1 << 9 * k) - 1)
        if context not in contexts[k]:
            continue
        kept = {g & 511: c for g, c in grams[k].items() if g >> 9 == context}
        n, pruned = contexts[k][context], contexts[k][context] - sum(kept.values())
        open_ = {s: c for s, c in kept.items() if s not in excluded}
        new = len(open_) + pruned
        whole = sum(open_.values()) + new
        if symbol in open_:
            return p * open_[symbol] / whole
        p *= new / whole if open_ else 1.0
        excluded |= set(kept)
        del n
    return p / (scoring.SYMBOLS - len(excluded))


@pytest.mark.parametrize("least", [1, 3])
def test_tables_give_ppm_by_its_definition(least):
    texts = [b"the cat sat on the mat", b"the hat that the cat had", b"a mat", b""]
    order = 3
    key, _ = scoring.keys(texts, order)
    grams = [Counter(int(k) & ((1 << 9 * (n + 1)) - 1) for k in key) for n in range(order + 1)]
    contexts = [Counter() for _ in grams]
    for n, g in enumerate(grams):
        for k, c in g.items():
            contexts[n][k >> 9] += c
    grams = [{k: c for k, c in g.items() if c >= least} for g in grams]
    contexts = [{k: c for k, c in g.items() if c >= least} for g in contexts]
    arrays = lambda ts: [(np.array(list(t), np.uint64), np.array(list(t.values()))) for t in ts]
    trie = scoring.Trie(arrays(grams), arrays(contexts))
    probe, _ = scoring.keys([b"that cat zz", b"the mat"], order)
    want = [math.log10(slow_probability(grams, contexts, int(k), order)) for k in probe]
    assert trie.log_probabilities(probe) == pytest.approx(want, abs=1e-9)
    for k in probe[:6]:
        every = np.array([(int(k) >> 9 << 9) | s for s in range(scoring.SYMBOLS)], np.uint64)
        assert (10 ** trie.log_probabilities(every)).sum() == pytest.approx(1, abs=1e-9)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_base_of_the_query(spark):
    got = {r["doc_id"]: r for r in scoring.op2_ppm_score(spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for d, t in docs:
        w, r = tokens(t), got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (len((t or "").encode()) + 1))
    seen = [r for r in got.values() if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_frequent_and_rare_words_count_alike(spark):
    rows = awkward(spark).filter("doc_id < 15")
    a = scoring.score(rows, F.col("doc_id") != 3, keep=["doc_id"], word_share=2.0).orderBy("doc_id", "base_score").collect()
    b = scoring.score(rows, F.col("doc_id") != 3, keep=["doc_id"], word_share=0.0).orderBy("doc_id", "base_score").collect()
    assert [r["base_score"] for r in a] == pytest.approx([r["base_score"] for r in b])
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in a] == [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in b]


def test_awkward_rows(spark):
    rows = crowded(awkward(spark))
    got = scoring.score(rows, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)), keep=["doc_id"])
    assert got.count() == rows.count()
    assert {r["n_tokens"] for r in got.filter("doc_id in (12, 13, 14)").collect()} == {1}
    assert len({r["score"] for r in got.filter("doc_id = 1").collect()}) == 1
    untrained = scoring.score(rows, F.lit(False), keep=["doc_id"]).filter("doc_id = 13").first()
    assert (untrained["train_tokens"], untrained["base_score"]) == (0, 0.0) and untrained["score"] == pytest.approx(-math.log10(257))
    assert scoring.score(rows.limit(0), F.lit(True), keep=["doc_id"]).count() == 0


def whole_trie(texts, order=scoring.ORDER):
    """The model of ``texts`` with nothing pruned."""
    key, _ = scoring.keys(texts, order)
    grams = [np.unique(key & np.uint64((1 << 9 * (k + 1)) - 1), return_counts=True) for k in range(order + 1)]
    contexts = [np.unique(key >> np.uint64(9) & np.uint64((1 << 9 * k) - 1), return_counts=True) for k in range(order + 1)]
    return scoring.Trie(grams, contexts)


@pytest.mark.parametrize("most", [7, 50, 10_000])
def test_parts_of_long_texts_give_the_same(most):
    texts = [b"", b"short one", b"a longer text that is cut in many parts " * 5, b"xxxxxxxxxxxxxxxxxxxxxxxx", b"end  \n of it"]
    for order in (1, 3, 5):
        key, doc = scoring.keys(texts, order)
        parts = list(scoring.windows(texts, order, most))
        assert (np.concatenate([p[0] for p in parts]) == key).all() and (np.concatenate([p[1] for p in parts]) == doc).all()
    for t in texts:
        assert [w for ws in scoring.words_of(t, most) for w in ws] == t.lower().split()


def test_any_column_names(spark):
    rows = awkward(spark).filter("doc_id < 15")
    more = rows.select("*", *(F.lit(1).alias(c) for c in ("_text", "_row", "_rare", "_known", "word", "gram", "n", "c", "p", "_SUM")))
    a, b = (sorted((r["doc_id"], r["score"], r["base_score"]) for r in scoring.score(x, F.col("doc_id") > 3, gram_share=0.01, word_share=0.01).collect()) for x in (rows, more))
    assert a == b


def test_rare_contexts_stay_in_the_model(spark):
    rare = "a quick brown zebra jumps over the lazy quagga"
    rows = [(i, "ab" * 5_000) for i in range(500)] + [(500, rare), (501, rare[8:] + " ab"), (502, "another zebra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in scoring.score(docs, F.col("doc_id") < 501, keep=["doc_id"]).collect()}
    trie = whole_trie([t.encode() for d, t in rows if d < 501])
    for d in (0, 500, 501, 502):
        want = trie.log_probabilities(scoring.keys([rows[d][1].encode()], scoring.ORDER)[0]).sum()
        assert got[d] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("order", [1, 2, 5])
def test_broadcast_and_joined_grams_score_alike(spark, order, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK", 50)
    rows = awkward(spark).filter("doc_id < 15 or doc_id > 16")
    a, b = ({(r["doc_id"], r["score"]) for r in scoring.score(rows, F.col("doc_id") > 3, keep=["doc_id"], order=order, gram_share=x).collect()} for x in (2.0, 0.0))
    assert a == b
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in rows.collect()]
    trie = whole_trie([t for d, t in texts if d > 3], order)
    want = {d: trie.log_probabilities(scoring.keys([t], order)[0]).sum() for d, t in texts}
    assert all(s == pytest.approx(want[d], abs=1e-6) for d, s in a)


def test_counting_hands_on_one_row_for_training_and_other_texts(spark):
    rows = [(i, t) for i, t in enumerate(["The cat  sat\x0b", "the CAT sat", "", None, " a cät\x1csat the\n"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = scoring.count(docs, F.col("doc_id") % 3 != 1, "text", 3).collect()
    every, trained, words = Counter(), Counter(), Counter()
    for d, t in rows:
        key = scoring.keys([(t or "").encode()], 3)[0].tolist()
        every.update(key)
        if d % 3 != 1:
            trained.update(key)
            words.update((t or "").encode().lower().split())
    assert {r["gram"]: (r["n"], r["trained"]) for r in got if r["word"] is None} == {k: (n, trained[k]) for k, n in every.items()}
    assert {r["word"].encode(): r["n"] for r in got if r["word"] is not None} == words
    assert len(got) == len(every) + len(words)


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_words_of_many_texts(most):
    texts = ["", "Ab  cD\x0bab", " \n ", "É x\x1cy z É " * 9, "\tend ", "w" * 60, "   "]
    got = [[] for _ in texts]
    for distinct, at, doc in scoring.words([t.encode() for t in texts], most):
        names = distinct.to_pylist()
        for a, d in zip(at, doc, strict=True):
            got[d].append(names[a].encode())
    assert got == [t.encode().lower().split() for t in texts]


@pytest.mark.parametrize("many", [3, 3000])
def test_keys_by_text(many):
    texts = [b"abcab" if i % 2 else b"" for i in range(many)]
    key, doc = scoring.keys(texts, 5)
    want = Counter(zip(doc.tolist(), key.tolist(), strict=True))
    got = [*zip(*(x.tolist() for x in scoring._by_text(key, doc, 5)), strict=True)]
    assert [(d, k, n) for k, n, d in got] == [(*dk, n) for dk, n in sorted(want.items())]
    plain = [sum((t[i - b] + 1 if 0 <= i - b < len(t) else 0) << 9 * b for b in range(6)) for t in texts for i in range(len(t) + 1)]
    assert key.tolist() == plain


def test_table_finds_keys_that_share_a_slot():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 54, 5_000).astype(np.uint64))
    table = scoring.Table(keys[::2])
    assert len(np.unique(table._slot(keys[::2]))) < len(keys[::2])
    assert table.find(keys).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(keys))]
    assert scoring.Table(keys[:0]).find(keys[:9]).tolist() == [-1] * 9
