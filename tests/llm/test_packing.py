import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilewright.llm import packing

from .helpers import SF, awkward, crowded

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(pieces, ids, size=1024):
    """Every id in one piece, gapless offsets; returns the padding."""
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        seen[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(seen) == set(ids)
    for d, ps in seen.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def of(rows):
    return {r["doc_id"]: [*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in rows}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert check(packing.op5_bounded_packing(spark, SF).collect(), of(docs)) == 0


@pytest.mark.parametrize("windows,parts", [(1, 1), (3, 7), (64, 3)])
def test_awkward_rows(spark, windows, parts):
    rows = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(parts)
    got = packing.pack(crowded(rows), PATH, open_windows=windows, merged=2)
    groups = -(-parts // 2)
    assert check(got.collect(), of(rows.collect())) <= 0 * groups
    assert packing.pack(rows.limit(0), PATH).count() == 0


def test_repeated_and_null_ids(spark):
    rows = awkward(spark)
    got = packing.pack(rows, PATH).groupBy("doc_id").sum("length").collect()
    want = defaultdict(int)
    for r in rows.collect():
        want[r["doc_id"]] += len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert {r[0]: r[1] for r in got} == dict(want)


def test_fast_tokens_equal_the_library(spark):
    code = packing.tokenizer(open(PATH, encoding="utf-8").read())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["<|endoftext|> x", "", "  \n\n a\u0085b ü 日本"]
    assert [x.tolist() for x in code(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    other = packing.tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert len(other(["hello world"])[0]) == 2


def test_packer_is_bounded_and_best_fit():
    p = packing.Packer(8, 2)
    put = lambda n: list(p.put("d", 0, np.zeros(n, np.uint32), n))
    assert put(5) == [] and put(4) == [] and len(p.windows) == 2
    assert put(3)[0][1][2].size == 3  # fills the window of 5, not the emptier one
    assert put(7) == [] and len(p.windows) == 2
    full = put(6)  # none fits: the fullest is topped up and leaves
    assert sum(len(x[2]) for x in full[0]) == 8 and len(p.windows) == 2


def test_added_tokens_in_texts_keep_their_ids(spark):
    loaded = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>  \n y<|endoftext|><|endoftext|> z  ", "<|endoftext| >", "it's  <|endoftext|>'s 12", "ü<|endoftext|>日本 <|EndOfText|>", "plain text"]
    want = [loaded.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    content = open(PATH, encoding="utf-8").read()
    assert [x.tolist() for x in packing.tokenizer(content)(texts)] == want
    for other in (content.replace('"dropout":null', '"dropout":0.0').replace('"ignore_merges":false', '"ignore_merges":true'), content.replace('"normalizer":null', '"normalizer":{"type":"Lowercase"}')):
        assert other != content
        library = Tokenizer.from_str(other)
        assert [x.tolist() for x in packing.tokenizer(other)(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    stripped = content.replace('"lstrip":false', '"lstrip":true', 1)
    assert stripped != content
    other = Tokenizer.from_str(stripped)
    assert [x.tolist() for x in packing.tokenizer(stripped)(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(packing.pack(rows, PATH).collect(), {i: [*w, 0] for i, w in enumerate(want)}) == 0
