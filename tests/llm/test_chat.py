import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import chat

from .helpers import SF

NASTY = st.text(alphabet="<|\\>adturnsyo/ \n[INST]é\U0001f600", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|says|>"]), NASTY), max_size=6))
def test_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query(spark):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want[r["conv_id"]].append((r["role"], r["text"] or ""))
    want[-1] = [(r, t) for _, _, r, t in chat.ADDED]
    got = {r["conv_id"]: r for r in chat.op8_reply_trees(spark, SF).collect()}
    assert set(got) == set(want)
    for k, turns in want.items():
        lost = "".join(t for r, t in turns if r == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(lost), digest(lost))
        assert r["formatted_chars"] == len(chat.format_turns(turns)[0])


TREE = "tree long, id long, parent long, role string, text string, score double"


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 1.0), (2, 1, None, "user", "alone", None), (3, 9, 8, "assistant", "orphan", 1.0)]
    one = chat.format_trees(spark.createDataFrame(rows, TREE)).collect()
    assert sorted((r["tree"], r["leaf"], r["n_turns"]) for r in one) == [(1, 5, 4), (2, 1, 1), (3, 9, 1)]
    text = next(r["formatted"] for r in one if r["tree"] == 1)
    assert [t for _, t in chat.parse_turns(text)] == ["q", "good", "more", "end"]
    both = chat.format_trees(spark.createDataFrame(rows, TREE), branches=2).filter("tree = 1")
    assert sorted(r["leaf"] for r in both.collect()) == [2, 5]


def walked(parent, leaf):
    out = []
    while leaf is not None:
        out.append(leaf)
        leaf = parent[leaf]
    return out


def test_paths_of_deep_and_bushy_trees(spark):
    parent = {i: i // 3 if i % 7 else i - 1 for i in range(1, 120)}
    parent[0] = None
    rows = spark.createDataFrame([(0, i, p, float(i)) for i, p in parent.items()], "tree long, id long, parent long, score double")
    levels, summed = chat.ancestors(rows)
    assert {r["id"]: (r["total"], r["n"]) for r in summed.collect()} == {i: (sum(walked(parent, i)), len(walked(parent, i))) for i in parent}
    leaves = sorted(set(parent) - {p for p in parent.values() if p is not None})
    got = defaultdict(dict)
    for r in chat.paths(spark.createDataFrame([(0, x) for x in leaves], "tree long, leaf long"), levels).collect():
        got[r["leaf"]][r["up"]] = r["id"]
    assert {x: [got[x][k] for k in range(len(got[x]))] for x in leaves} == {x: walked(parent, x) for x in leaves}


def test_a_comb_is_ranked_without_all_its_paths(spark):
    """A spine of n messages with a reply to each: its paths hold n^2 messages, the tables 2 n."""
    n = 50_000
    spine = spark.range(n).selectExpr("0L tree", "id", "if(id = 0, null, id - 1) parent", "'user' role", "'s' text", "0D score")
    tooth = spark.range(n).selectExpr("0L tree", f"id + {n} id", "id parent", "'assistant' role", "'t' text", "if(id = 7, 100D, -1D) score")
    got = chat.format_trees(spine.union(tooth)).collect()
    assert [(r["leaf"], r["n_turns"]) for r in got] == [(n + 7, 9)]


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "b"), (1, None, None, "a"), (None, 0, "assistant", "x"), (None, 1, "assistant", "y"), (0, 0, "user", ""), (2, 0, "user", "t" * 50_000), (2, 0, "user", "t" * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as tree", "3 as score")
    formatted = chat.format_trees(chat.threads(table))
    got = sorted((r["tree"]["null"], r["tree"]["id"], chat.parse_turns(r["formatted"])) for r in formatted.collect())
    assert got == [(False, 0, [("user", "")]), (False, 1, [("", "a"), ("user", ""), ("user", "b")]), (False, 2, [("user", "t" * 50_000)] * 2), (True, 0, [("assistant", "x"), ("assistant", "y")])]
    assert chat.format_trees(chat.threads(table.limit(0))).count() == 0
    assert chat.read_back(formatted, keep=("tree",)).count() == 4


@pytest.mark.parametrize("rows", [[(0, 1, 2), (0, 2, 1)], [(0, 1, 1)], [(0, 0, None), (0, 1, 0), (0, 5, 6), (0, 6, 7), (0, 7, 5), (0, 8, 5), (0, 9, 8)]])
def test_cycles_are_an_error(spark, rows):
    with pytest.raises(ValueError):
        chat.ancestors(spark.createDataFrame([(*r, 1.0) for r in rows], "tree long, id long, parent long, score double"))


def test_messages_without_a_place(spark):
    rows = [(None, 1, None, "user", "a", 1.0), (1, None, 2, "user", "b", 1.0), (1, 2, None, "user", "c", float("nan")), (1, 2, None, "user", "d", 0.0), (1, 3, 2, None, None, None)]
    got = chat.format_trees(spark.createDataFrame(rows, TREE)).collect()
    assert sorted([t for _, t in chat.parse_turns(r["formatted"])] for r in got) == [["a"], ["b"], ["c", ""]]
