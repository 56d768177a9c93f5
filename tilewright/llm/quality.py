"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Rules run one after the other until one rejects. Their order is planned: on a sample each rule's own time (a job's,
less that of a job with an empty rule) and share of rejections are measured, and rules are sorted by rejections per
second. The order changes the cost, never the verdict.

A rule names the measures that it needs. ``judge`` writes a measure's expression into the branch of the rule, so that
it is computed for the rows alone that no earlier rule has rejected, and its cost counts for the rule in the plan;
``cascade`` reports all measures and so computes them for every row first. Expressions that several others need are
computed once per row: columns behind ``inline(array(struct(...)))``, a step that the optimizer neither merges nor
duplicates, and inside of expressions as the argument of a lambda.

Repeated windows are found by hash and then told apart word by word, so that the counts are exact.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; equal rows get equal verdicts,
rules that tie in the plan keep their given order; very long texts are measured whole; measures named like a column of
the input replace it, other names never clash; an empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

#: Fixed value: the characters between words, space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Up to this many distinct repeated windows, membership is a scan of them; beyond, windows are sorted.
SCANNED = 256
#: Bounds of the sample that plans the cascade: rows, code points of a row, one of how many rows may be drawn; a timed
#: job goes through the sample until it has handled ``TIMED_ROWS`` rows, and the least of ``TIMED`` jobs counts.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
SAMPLE_SHARE = 8
TIMED_ROWS = 2000
TIMED = 2

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _once(df: DataFrame, **made: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, computing ``value`` once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _again(keys: Column) -> Column:
    """Distinct elements that occur twice or more."""
    return _let(F.sort_array(keys), lambda s: F.array_distinct(F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())))


def _positions(keys: Column, twice: Column) -> Column:
    """Positions (from 0) of the elements of ``keys`` that are in ``twice``, its elements that occur twice or more."""
    few = F.filter(F.transform(keys, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
    many = _let(
        F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        lambda s: F.array_distinct(F.flatten(F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull()))),
    )
    return F.when(F.size(twice) <= SCANNED, few).otherwise(many)


def _repeat_words(w: Column) -> Column:
    """The number of words in 3-word windows that occur twice or more."""
    n = F.size(w)
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    hashes = F.zip_with(pairs, F.slice(w, 3, F.greatest(n, F.lit(1))), lambda p, c: F.xxhash64(p, c))

    def exact(at: Column, twice: Column) -> Column:
        # words hold no spaces, so windows are equal if their joined words are; equal windows have equal hashes, so as
        # many windows as hashes mean that no two windows share a hash
        windows = F.transform(at, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        apart = lambda x: F.transform(_let(_again(x), lambda t: _positions(x, t)), lambda k: F.get(at, k))
        return _let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(twice), at).otherwise(apart(x)))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))).cast("long")

    def count(h: Column) -> Column:
        some = lambda twice: _let(_positions(h, twice), lambda at: _let(exact(at, twice), covered))
        return _let(_again(h), lambda twice: F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(some(twice)))

    return _let(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))), count)


def _measures(body: Column, w: Column) -> dict[str, Column]:
    """The measures as expressions over a text (not null) and its words."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(w),
    }


def _split(df: DataFrame, text: str, body: str, words: str) -> DataFrame:
    out = _once(df, **{body: F.coalesce(F.col(f"`{text}`"), F.lit(""))})
    trimmed = F.btrim(body, F.lit(SPACE))
    return _once(out, **{words: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))})


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and base_failed."""
    plain = df.drop(*(c for c in (*MEASURES, "n_lines") if c != text))
    body, words = fresh(df, "body", "words")
    out = _split(plain, text, body, words)
    out = _once(out, **_measures(F.col(body), F.col(words)))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop(body, words)


@dataclass(frozen=True)
class Rule:
    """``rejects``: from the text (not null) and a look-up of the measures by name, true where the rule rejects."""

    name: str
    rejects: Callable[[Column, Callable[[str], Column]], Column]


def _left(text: Column, pattern: str) -> Column:
    """Code points left of a text without what the pattern matches."""
    return F.length(F.regexp_replace(text, pattern, ""))


#: The two halves of the base rule.
BASE = (Rule("few_words", lambda t, m: m("n_words") < 50), Rule("repeated_windows", lambda t, m: 100 * m("n_repeat_words") > 50 * m("n_words")))
RULES = (
    Rule("symbols", lambda t, m: 6 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda t, m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 16 * m("n_words"))),
    Rule("repeated_lines", lambda t, m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("few_letters", lambda t, m: 10 * _left(t, r"[^\p{L}\p{M}]+") < 7 * m("word_chars")),
    Rule("capitals", lambda t, m: 10 * _left(t, "[^A-Z]+") > 4 * m("word_chars")),
    Rule("exclaiming", lambda t, m: 5 * (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) > m("n_words")),
)


def _rejects(rule: Rule, text: Column, measures: Callable[[str], Column]) -> Column:
    return F.coalesce(rule.rejects(text, measures), F.lit(False))


def plan(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[Rule]:
    """``rules`` by rejections per second on a sample, best first.

    The sample is ``sample_rows`` texts of at most ``sample_chars`` code points, drawn by hash: fetching them reads
    partitions one after the other until there are enough, whatever the table's size. A job goes through it as often
    as gives ``TIMED_ROWS``, the least of ``TIMED`` jobs' times counts, and an empty rule's is taken off.
    """
    drawn = df.select(F.col(f"`{text}`").alias("text")).filter((F.length("text") <= sample_chars) & (F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0))
    rows = df.sparkSession.createDataFrame(drawn.take(sample_rows), T.StructType([T.StructField("text", T.StringType())]))
    sample = _split(rows, "text", "body", "words").persist()
    made = _measures(F.col("body"), F.col("words"))

    def timed(rejects: Column) -> tuple[float, int]:
        # a plan of its own for every run: one collected again would take its shuffle's files from the run before
        job, least, n = lambda: some.agg(F.count_if(rejects).alias("n")).collect(), float("inf"), 0
        job()  # compiles
        for _ in range(TIMED):
            began = time.perf_counter()
            n = job()[0]["n"]
            least = min(least, time.perf_counter() - began)
        return least, n

    try:
        copies = max(1, TIMED_ROWS // max(1, sample.count()))
        some = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
        total = some.count()
        empty = timed(F.size("words") < 0)[0]
        ranked = []
        for k, rule in enumerate(rules):
            seconds, rejected = timed(_rejects(rule, F.col("body"), made.__getitem__))
            ranked.append((-(rejected / max(total, 1)) / max(seconds - empty, empty / 20, 1e-6), k))
        return [rules[k] for _, k in sorted(ranked)]
    finally:
        sample.unpersist()


def _verdict(rules: Sequence[Rule], text: Column, measures: Callable[[str], Column]) -> Column:
    """True unless a rule rejects: the branches run in order, and none after one that rejects."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(_rejects(rule, text, measures), False)
    return out.otherwise(True)


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, kept: str = "kept") -> DataFrame:
    """``df`` with all its measures, ``base_failed`` and ``kept``."""
    (body,) = fresh(df, "body")
    measured = _once(measure(df.drop(*(c for c in [kept] if c != text)), text), **{body: F.coalesce(F.col(f"`{text}`"), F.lit(""))})
    verdict = F.when(F.col("base_failed"), False).otherwise(_verdict(plan(df, rules, text, sample_rows), F.col(body), F.col))
    return _once(measured, **{kept: verdict}).drop(body)


def judge(df: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), text: str = "text", sample_rows: int = SAMPLE_ROWS, kept: str = "kept") -> DataFrame:
    """``df`` with the verdict ``kept`` alone: measures are computed in the rules' branches, where a row gets there."""
    body, words = fresh(df, "body", "words")
    made = _measures(F.col(body), F.col(words))
    split = _split(df.drop(*(c for c in [kept] if c != text)), text, body, words)
    return _once(split, **{kept: _verdict(plan(df, rules, text, sample_rows), F.col(body), made.__getitem__)}).drop(body, words)


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", *MEASURES, "kept")


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
split AS (
  SELECT doc_id, body,
         list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT s.doc_id, s.body, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 6 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR 2 * n_dup_lines > n_lines
            OR 10 * length(regexp_replace(body, '[^\p{L}\p{M}]+', '', 'g')) < 7 * word_chars
            OR 10 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 4 * word_chars
            OR 5 * (length(body) - length(replace(body, '!', ''))) > n_words) AS kept
FROM b
"""
