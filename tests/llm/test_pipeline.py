"""The pipeline against a brute-force version of its decisions."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tilewright.llm import secrets
from tilewright.llm.common import cut

from .helpers import DOCS, SF, awkward
from .test_packing import check
from .test_quality import brute
from .test_secrets import brute as brute_secrets
from .test_simhash import brute_near, planted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run(spark, docs):
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], SF)))
    return steps


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, good, told, unique, clean, packed = run(spark, docs)
    assert all(x.columns == COLUMNS for x in (good, told, unique, clean))
    text = {r["doc_id"]: r["text"] for r in raw.collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert all(not brute(text[d])[-1] for d in kept) and 0 < len(kept) < len(text)
    assert {r["doc_id"] for r in told.collect()} == kept  # all in a language of the corpus
    assert {r["doc_id"] for r in unique.collect()} == set(brute_near([(d, text[d]) for d in sorted(kept)]).values())
    for r in clean.collect():
        spans = brute_secrets(text[r["doc_id"]], secrets.RULES)
        assert (r["text"] == text[r["doc_id"]]) == (not spans) and r["n_chars"] == len(r["text"])
        assert not brute_secrets(r["text"], secrets.BASE)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert check(packed.collect(), {r["doc_id"]: [*coder.encode(r["text"], add_special_tokens=False).ids, 0] for r in clean.collect()}) == 0


def test_language_rejects_what_has_none(spark):
    docs = spark.createDataFrame([(i, "the water of the river and the house " * 3, "en", "s", 1) for i in range(9)] + [(9, "12 34 " * 60, "en", "s", 1), (10, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == set(range(9))


def test_near_copies_go(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in planted()], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == set(brute_near(planted()).values())


def test_columns_of_any_name(spark):
    """Columns named like what stages add stay as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    more = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["_words", "_body", "_kept", "kept", "n_words", "_lang_pred", "_score", "component_id", "rep", "all", "_fp2"])))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, SF)
        assert got.columns == more.columns, name
        assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, stage(spark, docs, SF).collect())), name
        assert all(r[c] == i for r in got.collect() for i, c in enumerate(more.columns[5:])), name


def test_awkward_rows(spark):
    _, good, told, unique, clean, packed = run(spark, awkward(spark))
    assert good.count() >= told.count() >= unique.count() == clean.count() > 0
    assert unique.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == unique.count()
    empty = run(spark, awkward(spark).limit(0))
    assert all(x.count() == 0 for x in empty)
