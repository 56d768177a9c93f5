"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

The stages but the last return the columns of ``documents``, further columns included, whatever their names. Defined
results: a null or empty text fails the quality rules and goes there, so that a table of such texts leaves nothing and
later stages give empty tables; a null id is an id; very long texts are handled whole; of rows that share an id the
near-dedup keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import language, packing, quality, secrets, simhash
from tilewright.llm.common import cut, fresh, table

#: A language's answer below this score is no answer.
LEAST_LANGUAGE_SCORE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps."""
    (kept,) = fresh(docs, "kept")
    return quality.judge(docs, kept=kept).filter(F.col(kept)).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; those without an answer, or with a weak one, go."""
    pred, score = fresh(docs, "lang_pred", "score")
    told = language.identify(docs, language.learn(docs), lang_pred=pred, score=score)
    return told.filter((F.col(pred) != language.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or
    more); of rows that share that id, one: the least by text, then by the other columns."""
    (mark,) = fresh(docs, "kept")
    groups = simhash.near_copies(docs.select("doc_id", "text"))
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(mark)).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", *rest)
    return kept.groupBy("doc_id").agg(F.min(row).alias(mark)).select(*(F.col("doc_id") if c == "doc_id" else F.col(f"{mark}.{c}").alias(c) for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and ``n_chars`` counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Fingerprints, regex spans and tokens can't be written in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
