import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import bpe

from .helpers import SF, awkward, crowded

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
VOCABULARY = bpe.Vocabulary(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_encodes_like_the_library_and_decodes_back(text):
    got = bpe.Encoder(VOCABULARY)([text])[0]
    assert got.tolist() == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(got) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="etaoinsr", min_size=1, max_size=700))
def test_long_pieces(text):
    """The heap of long rows and the rounds of matrices give the same merges."""
    raw = text.encode()
    rows = VOCABULARY._merge_rows([raw], max(2, len(raw)))[0]
    if len(raw) > 1:
        assert VOCABULARY._merge_long(raw).tolist() == rows.tolist()
    assert bpe.Encoder(VOCABULARY)([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_other_vocabulary_and_errors():
    other = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert other.decode(bpe.Encoder(other)(["schön 日本"])[0]).decode() == "schön 日本"
    with pytest.raises(IndexError):
        VOCABULARY.decode(np.array([10**6]))
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_awkward_rows(spark):
    rows = crowded(awkward(spark))
    both = bpe.decode(bpe.encode(rows, PATH), PATH).select("doc_id", "ids", "decoded").join(awkward(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct(), "doc_id").collect()
    assert both and all(bytes(r["decoded"]).decode() == r["t"] and r["ids"] == LIBRARY.encode_ordinary(r["t"]) for r in both)
    assert bpe.encode(rows, PATH).count() == rows.count()
    assert bpe.decode(bpe.encode(rows.limit(0), PATH), PATH).count() == 0


def test_query(spark):
    got = {r["doc_id"]: r for r in bpe.op1_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, text = LIBRARY.encode_ordinary(d["text"] or ""), (d["text"] or "").encode()
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
