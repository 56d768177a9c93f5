import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tilewright.llm import language

from .helpers import SF, awkward, crowded

WORDS = {"en": "the and of that with this from have not which water river house light", "de": "der und die nicht mit sich auf haben wasser flüsse häuser licht über", "fr": "le et les des dans pour avec être rivière maison lumière où"}


def corpus(spark, n=90, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(5, 40))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    filters = language.learn(docs.filter("doc_id % 3 <> 1"), bits=14)
    told = language.identify(docs.filter("doc_id % 3 = 1"), filters).collect()
    assert told and all(r["lang"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in told)


def test_filters_return_all_languages_of_an_ngram(spark):
    filters = language.learn(corpus(spark), bits=16)
    gram = np.array([int.from_bytes(g, "big") for g in (b"asse", b"sser", b"nich", b"icht", b"aben")], np.uint32)  # German alone
    slots = list(language._slots(gram, 16, filters.hashes))
    mask = np.bitwise_and.reduce([filters.table[0][s] for s in slots])
    assert (mask >> filters.languages.index("de") & 1).all()
    assert (filters.false_positive < 0.01).all()


def test_counts_equal_brute_force(spark):
    docs = corpus(spark, 20)
    got = {(r["lang"], r["gram"]): r["n"] for r in language.count_grams(docs, "text", "lang").collect()}
    want: dict = {}
    for r in docs.collect():
        want[(r["lang"], language.ROWS)] = want.get((r["lang"], language.ROWS), 0) + 1
        for g in language.grams([r["text"]])[0].tolist():
            want[(r["lang"], g)] = want.get((r["lang"], g), 0) + 1
    assert got == want


def test_awkward_rows(spark):
    rows = crowded(awkward(spark))
    filters = language.learn(rows, bits=16)
    told = language.identify(rows, filters)
    assert told.count() == rows.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in told.select("doc_id", "lang_pred", "score").collect()}
    assert all(got[i] == ("und", 0.0) for i in (12, 13, 14, 19)) and got[15][0] == "en" and got[18][0] == "de"
    nothing = language.learn(rows.filter("lang = 'xx'"), bits=10)
    assert {r["lang_pred"] for r in language.identify(rows, nothing).collect()} == {"und"}
    assert language.identify(rows.limit(0), filters).count() == 0


def test_many_languages_take_more_words(spark):
    rows = [(i, "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(60)) + f" w{'abcdefghij'[i % 10]}", f"l{i:03d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs, bits=16)
    assert filters.table.shape[0] == 2
    told = language.identify(docs, filters).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 26


def test_parts_of_long_texts_give_the_same():
    texts = [None, "", "ab", "The quick brown fox, 12 jumps; über den Fluß! " * 6, "12 34", "x" * 90]
    whole = language.grams(texts)
    for most in (5, 64, 10_000):
        parts = list(language.windows(texts, most))
        assert all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in (0, 1))
    assert whole[1].tolist().count(2) == 3 and 4 not in whole[1]


def test_query_on_held_out_documents(spark):
    """On the given table, and held to a filter without false positives: a set of n-grams for each language."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in language.op4_language_filters(spark, SF).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    count, rows = defaultdict(Counter), Counter()
    for d, r in docs.items():
        if not got[d]["held_out"] and r["lang"] is not None and r["text"] is not None:
            rows[r["lang"]] += 1
            count[r["lang"]].update(language.grams([r["text"]])[0].tolist())
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in count.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    known = {x: {g for g, v in s.items() if v >= language.MIN_SHARE and v >= language.KEEP_RATIO * most[g]} for x, s in share.items()}
    same = [max(known, key=lambda x: (sum(g in known[x] for g in grams), rows[x])) == got[d]["lang_pred"] for d, r in docs.items() if len(grams := language.grams([r["text"]])[0].tolist()) > 3]
    assert np.mean(same) >= 0.99
    held = [r["lang"] == got[d]["lang_pred"] for d, r in docs.items() if got[d]["held_out"] and r["lang"] and r["text"] and len(r["text"]) > 100]
    assert held and np.mean(held) >= 0.97
