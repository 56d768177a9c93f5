import os
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tilewright.llm import quality

from .helpers import SF, awkward, crowded, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    at = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(at) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at), failed


def test_measures(spark, monkeypatch):
    texts = [None, "", " \n ", "a b", "a a a a", "x y z x y z q", "l1\nl1\n\n \nl2\nl1", "#a *b $%&|<> é日本 \U0001f600", "a\x0bb\x0cc\td\re\x1cf g", "p q r s " * 200, "p q r " * 3 + prose(random.Random(1), 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {i: brute(t) for i, t in enumerate(texts)}
    for most in (quality.SCANNED, 0):  # both ways to find repeated windows
        monkeypatch.setattr(quality, "SCANNED", most)
        got = {r["doc_id"]: tuple(r[c] for c in quality.MEASURES) for r in quality.measure(docs).collect()}
        assert got == want


def brute_kept(text):
    n, chars, symbols, dup, _, failed = brute(text)
    text = text or ""
    lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    letters = sum(unicodedata.category(c)[0] in "LM" for c in text)
    return not (failed or 6 * symbols > n or chars < 2 * n or chars > 16 * n or 2 * dup > lines or 10 * letters < 7 * chars or 10 * len(re.findall("[A-Z]", text)) > 4 * chars or 5 * text.count("!") > n)


def test_order_follows_rejections_per_cost_and_not_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    even = lambda t, m: m("n_words") % 2 == 0
    never = quality.Rule("never", lambda t, m: m("n_words") < 0)
    dear = quality.Rule("dear", lambda t, m: (quality._left(t, "((a|e|i|o|u)+x?)+z") < 0) | even(t, m))
    measured = quality.Rule("measured", lambda t, m: (m("n_repeat_words") < 0) | even(t, m))
    cheap, rare = quality.Rule("cheap", even), quality.Rule("rare", lambda t, m: m("n_words") % 50 == 0)
    assert [r.name for r in quality.plan(docs, (never, dear, cheap))] == ["cheap", "dear", "never"]
    assert [r.name for r in quality.plan(docs, (measured, cheap))] == ["cheap", "measured"]
    assert [r.name for r in quality.plan(docs, (rare, cheap))] == ["cheap", "rare"]
    a = {r["doc_id"]: r["kept"] for r in quality.cascade(docs, (dear, cheap, rare)).collect()}
    b = {r["doc_id"]: r["kept"] for r in quality.cascade(docs, (rare, cheap, dear)).collect()}
    assert a == b


def test_judge_gives_the_cascades_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(awkward(spark))
    rng = random.Random(1)
    hindi = " ".join("".join(chr(rng.randrange(0x915, 0x939)) + chr(rng.randrange(0x93E, 0x94D)) for _ in range(3)) for _ in range(60))  # half its characters are marks
    docs = docs.unionByName(spark.createDataFrame([(10**6, hindi, "hi", "s", 1)], docs.schema))
    got = sorted((str(r["doc_id"]), r["kept"]) for r in quality.judge(docs).collect())
    assert got == sorted((str(r["doc_id"]), r["kept"]) for r in quality.cascade(docs).collect())
    assert got == sorted((str(r["doc_id"]), brute_kept(r["text"])) for r in docs.collect()) and (str(10**6), True) in got
    assert quality.judge(docs.select("*", *(F.lit(1).alias(c) for c in ("_body", "_words", "kept", "n_words")))).columns == [*docs.columns, "_body", "_words", "n_words", "kept"]


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = quality.op7_quality_cascade(spark, SF).toPandas(), c.sql(quality.OP7_SQL).df()
    cols = sorted(want.columns)
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert sorted(got.columns) == cols and order(got).equals(order(want))


def test_plan_is_native(spark):
    plan = quality.cascade(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_awkward_rows(spark):
    rows = crowded(awkward(spark))
    got = quality.cascade(rows)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["base_failed"] and not by[i]["kept"] for i in (12, 13, 14, 16)) and by[15]["kept"]
    for r in got.select("text", *quality.MEASURES).collect():
        assert tuple(r[1:]) == brute(r["text"])
    assert quality.cascade(rows.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{SF}/labels.parquet"), reason="no test data")
def test_good_documents_stay(spark):
    got = quality.cascade(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert got.filter("quality = 0 AND kept").count() == 0
    assert got.filter("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
