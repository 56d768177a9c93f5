"""Secret scans through a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain. Every slice of
documents gets its own inverted index (trigram -> bitmap of the slice's documents) limited to the trigrams that
some query asks for; the query's postings are intersected and united, and only the candidates are verified with
the regex itself. A rule whose regex has no mandatory trigram scans every document of the slice.

Index and queries fold ASCII letters to lower case, so that rules in either case use them too; a fold can only
add candidates.

Defined results: null and empty texts have no spans; equal rows get equal spans; spans are ordered by start, those that
start together by their rule's place; offsets are code points, ends exclusive; a very long text is scanned whole, in a
slice of its own; an input column named like an output is replaced, other names never clash; an empty table gives an
empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table

#: A set of alternatives this long is no longer kept exactly.
MOST_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``regex`` finds matches, leftmost and non-overlapping; those with fewer than ``least`` characters in
    ``group`` are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.compile(self.regex, self.flags).finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The three base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Formats of well-known credentials, found beside the base ones.
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{3,128}@[A-Za-z0-9.-]+"),
)
RULES = BASE + ADDED

# --- Boolean trigram queries: True (no demand), or ("and" | "or", frozenset of parts), a part a trigram or a query.


def _all(*parts):
    flat = frozenset(x for p in parts if p is not True for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p]))
    return True if not flat else ("and", flat) if len(flat) > 1 else next(iter(flat))


def _any(parts):
    parts = frozenset(parts)
    return True if not parts or True in parts else ("or", parts) if len(parts) > 1 else next(iter(parts))


def _grams(text: str):
    raw = text.encode()
    return _all(*(raw[i : i + 3] for i in range(len(raw) - 2)))


def _of(exact: frozenset[str]):
    return _any(_grams(x) for x in exact)


def _node(op, arg) -> tuple[frozenset[str] | None, object]:
    """(the exact lower-case strings that the node matches, or None; the query of what it must contain)."""
    if op is C.LITERAL:
        return (frozenset([chr(arg).lower()]), True) if arg < 128 else (None, True)
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= 8 else (None, True)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        made = [_sequence(x) for x in arg[1]]
        exact = frozenset().union(*(e for e, _ in made if e is not None))
        if all(e is not None for e, _ in made) and len(exact) <= MOST_EXACT:
            return exact, True
        return None, _any(_all(q, _of(e) if e is not None else True) for e, q in made)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = arg
        exact, query = _sequence(body)
        if most == 1 and exact is not None:
            return exact | {""} if least == 0 else exact, True
        if least == most and exact is not None and len(exact) ** least <= MOST_EXACT:
            out = frozenset([""])
            for _ in range(least):
                out = frozenset(a + b for a in out for b in exact)
            return out, True
        return None, (_all(query, _of(exact) if exact is not None else True) if least else True)
    if op is C.AT:
        return frozenset([""]), True
    return None, True


def _sequence(nodes) -> tuple[frozenset[str] | None, object]:
    run, query, whole = frozenset([""]), True, True
    for op, arg in nodes:
        exact, more = _node(op, arg)
        query = _all(query, more)
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        query = _all(query, _of(run))
        run = exact if exact is not None else frozenset([""])
    if whole:
        return run, query
    return None, _all(query, _of(run))


def trigram_query(regex: str):
    """The Boolean query over lower-case trigrams that holds for every text with a match; True if none is sure."""
    exact, query = _sequence(_parser.parse(regex))
    return _all(query, _of(exact)) if exact is not None else query


def _named(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class Index:
    """Inverted index over a slice of texts: for each wanted trigram, which texts hold it (ASCII letters folded)."""

    def __init__(self, texts: list[bytes], wanted: dict[bytes, int], lut: np.ndarray):
        self.n, self.wanted = len(texts), wanted
        joined = np.frombuffer(b"\xff\xff".join(texts).lower() + b"\xff\xff\xff", np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        self.postings = np.zeros((len(wanted), self.n), bool)
        code = lut[joined[:-2].astype(np.int32) << 16 | joined[1:-1].astype(np.int32) << 8 | joined[2:]]
        at = np.flatnonzero(code)
        self.postings[code[at].astype(np.int64) - 1, np.searchsorted(ends, at, side="right")] = True

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            return self.postings[self.wanted[query]]
        op = np.logical_and if query[0] == "and" else np.logical_or
        return op.reduce([self.candidates(q) for q in query[1]])


def _scanner(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.regex) for r in rules]
    wanted = {g: i for i, g in enumerate(sorted(set().union(*map(_named, queries))))}
    lut = np.zeros(1 << 24, np.uint16)
    for g, i in wanted.items():
        lut[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def scan(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, end, rule) in order of start and then of the rules."""
        texts = [t or "" for t in texts]
        index = Index([t.encode() for t in texts], wanted, lut)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            for i in np.flatnonzero(index.candidates(query)).tolist():
                found[i] += [(a, b, k) for a, b in rule.spans(texts[i])]
        return [sorted(x, key=lambda s: (s[0], s[2], s[1])) for x in found]

    return scan


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_secrets(df: DataFrame, text: str = "text", spans: str = "spans", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Add ``spans``: array of (kind, start, end) in order of start, then of ``rules``."""

    def start():
        scan = _scanner(rules)
        return lambda texts: [[[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in one] for one in scan(texts)]]

    return map_text(df, text, [T.StructField(spans, T.ArrayType(SPAN))], start, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace each secret in ``text`` (overlapping spans as one) by ``mark``; null stays null."""

    def start():
        scan = _scanner(rules)

        def work(texts):
            out = []
            for t, found in zip(texts, scan(texts), strict=True):
                done, parts = 0, []
                for a, b, _ in found:
                    if a >= done:
                        parts += [t[done:a], mark]
                    done = max(done, b)
                out.append("".join([*parts, t[done:]]) if found else t)
            return [out]

        return work

    order = df.columns
    return map_text(df, text, [T.StructField(text, T.StringType())], start).select(*(F.col(f"`{c}`") for c in order))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
