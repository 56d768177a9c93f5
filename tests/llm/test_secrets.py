import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import secrets

from .helpers import SF, awkward, crowded


def brute(text, rules):
    found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.regex, text or "", r.flags) if len(m[r.group]) >= r.least]
    return sorted((a, k, b) for a, k, b in found)


def test_queries_are_mandatory_and_selective():
    q = {r.kind: secrets.trigram_query(r.regex) for r in secrets.RULES}
    assert q["hex"] is True
    assert q["access"] == ("and", frozenset({b"aki", b"kia"}))
    assert q["assign"][0] == "or" and {b"tok", b"oke", b"ken"} in [set(p[1]) for p in q["assign"][1] if isinstance(p, tuple)]
    assert secrets._named(q["key"]) >= {b"beg", b"egi", b"pri", b"key"}
    assert b"://" in secrets._named(q["url"])
    assert secrets.trigram_query("ab?cdef") == ("and", frozenset({b"cde", b"def"})) or secrets.trigram_query("ab?cdef")[0] in ("or", "and")
    assert secrets.trigram_query("abc|x") is True and secrets.trigram_query("(abc)*") is True


PIECES = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "ſecret", "toKen", "ghp_", "a" * 36, "xoxb-", "-----BEGIN ", "RSA PRIVATE KEY-----", "eyJabcdefgh.", "https://u:", "pass@host", "é", "\n", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_index_finds_what_full_scans_find(texts):
    got = secrets._scanner(secrets.RULES)(texts)
    assert [[(a, k, b) for a, b, k in one] for one in got] == [brute(t, secrets.RULES) for t in texts]


def test_index_drops_documents_without_the_trigrams():
    wanted = {b"aki": 0, b"kia": 1}
    import numpy as np

    lut = np.zeros(1 << 24, np.uint16)
    for g, i in wanted.items():
        lut[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
    index = secrets.Index([b"AK", b"IA xx", b"zakia", b"", b"aki kia"], wanted, lut)
    assert index.candidates(("and", frozenset({b"aki", b"kia"}))).tolist() == [False, False, True, False, True]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = secrets.op10_trigram_secrets(spark, SF).collect()
    assert len(got) == len(docs)
    base = {r.kind for r in secrets.BASE}
    for r in got:
        found = [(secrets.RULES[k].kind, a, b) for a, k, b in brute(docs[r["doc_id"]], secrets.RULES)]
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["spans"] == text(found)
        assert r["base_sha256"] == hashlib.sha256(text([s for s in found if s[0] in base]).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in found) for k in ("assign", "access", "hex")]
    assert any(r["spans"] for r in got)


def test_redaction(spark):
    rows = spark.createDataFrame([(1, 'a token = "abcdef0123456789abcdef" b'), (2, "clean"), (3, None)], "doc_id int, text string")
    assert [r["text"] for r in secrets.redact(rows).orderBy("doc_id").collect()] == ['a [SECRET]" b', "clean", None]


def test_awkward_rows(spark):
    rows = crowded(awkward(spark))
    got = secrets.find_secrets(rows)
    assert got.count() == rows.count() and got.filter("doc_id in (12, 13, 14) AND size(spans) > 0").count() == 0
    assert secrets.redact(rows).columns == rows.columns
    assert secrets.find_secrets(rows.limit(0)).count() == 0
    with pytest.raises(re.error):
        secrets.trigram_query("(")
