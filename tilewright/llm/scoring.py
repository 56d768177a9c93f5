"""Scoring by prediction by partial matching (PPM) over bytes, with a unigram base.

The model is a trie of byte contexts up to ``order`` symbols, pretrained on all training rows: every position gives
one (context, symbol), contexts reach back over the start of the text, and an end symbol closes it. Estimation is
method C with symbol exclusion: in a context seen n times with d kept symbols, a symbol seen c times has c/(n+d);
otherwise the model escapes to the context one symbol shorter, where the symbols already seen are excluded, and at
last to all symbols unseen. Since the kept symbols of a context are kept in its suffix too, what exclusion takes from
a suffix is one number per context, so that escapes are table look-ups over arrays of positions.

Counting covers all rows and is aggregated by task before it is shuffled; no (context, symbol) counted in training is
pruned. A position's probability depends on its (context, symbol) alone, so each distinct one is given its probability
once: the counts are partitioned by the last ``HEAD + 1`` symbols of the context, which holds all longer contexts of a
group in one task; the counts of shorter contexts (a table bounded by the number of symbols, not by the corpus) go to
every task. A (context, symbol) that makes up at least ``gram_share`` of all positions is broadcast with its
probability (at most 1/gram_share), the others are looked up by a join. Words are alike: those of at least
``word_share`` of all tokens are broadcast (at most 1/word_share), the others are joined. Logarithms are added as
whole numbers of 2^-36, so that a score doesn't depend on the order of rows.

Defined results: null and empty texts hold the end alone; with no training rows every symbol is equally likely and
every base probability is 1; equal rows get equal scores; an empty table gives an empty one. Rows are told apart by
their place in the input, so repeated and null ids are scored one by one. Very long texts are counted and scored in
parts of ``SLICE`` bytes, each with the context before it, and their words in parts of ``SLICE_BYTES``, cut between
words, which gives the same. Input columns named like outputs are
replaced, other names never clash.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bound_batches, cut, fold, fresh, slices, table

_GAP = re.compile(rb"[\t-\r ]")

ORDER = 5
GRAM_SHARE = 2.0**-21
WORD_SHARE = 2.0**-20
#: Orders whose counts go to every task.
HEAD = 2
#: Logarithms are kept as whole numbers of this part.
UNIT = 2.0**-36
#: Distinct (context, symbol)s that are given their probabilities at once.
CHUNK = 300_000
#: Bits of a symbol: 0 is the boundary (start and end of text), byte b is b + 1.
BITS = 9
SYMBOLS = 257
#: Distinct words or n-grams that a counting task holds before it passes them on.
HELD = 500_000
#: Bytes of text whose positions are handled at once; each takes some 100 bytes in arrays.
SLICE = 1 << 18
#: Positions that a counting task sorts at once.
AT_ONCE = 8 * SLICE


def _low(k: int) -> np.uint64:
    return np.uint64((1 << (BITS * k)) - 1)


def keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every position, text of each)."""
    size = np.array([len(t) for t in texts], np.int64) + (order + 1)
    first = np.cumsum(size) - size
    joined = bytes(order) + bytes(order + 1).join(texts) + bytes(1)
    key = np.frombuffer(joined, np.uint8).astype(np.uint64)
    key += np.uint64(1)
    before = (first[:, None] + np.arange(order)).ravel()
    key[before] = 0
    key[first + size - 1] = 0
    have = 1
    while have <= order:  # keys of twice as many symbols; what is too much is cut at the end
        longer = key[:-have] << np.uint64(BITS * have)
        longer |= key[have:]
        key[have:] = longer
        have *= 2
    key &= _low(order + 1)
    here = np.ones(len(key), bool)
    here[before] = False
    return key[here], np.repeat(np.arange(len(texts), dtype=np.int32), size - order)


def windows(texts: list[bytes], order: int, most: int = 0):
    """``keys`` of all positions, a long text's in parts of ``most`` (SLICE) bytes: (context and symbol, text of each)."""
    most, first, total = most or SLICE, 0, 0
    for i, t in enumerate(texts):
        if total + len(t) > most and i > first:
            key, doc = keys(texts[first:i], order)
            yield key, doc + np.int32(first)
            first, total = i, 0
        total += len(t)
        if len(t) > most:
            for a in range(0, len(t) + 1, most):
                # with the bytes before it as context; what belongs to them or to the part's own end is left out
                low = max(0, a - order)
                key, _ = keys([t[low : a + most]], order)
                key = key[a - low : None if a + most > len(t) else -1]
                yield key, np.full(len(key), i, np.int32)
            first, total = i + 1, 0
    if first < len(texts):
        key, doc = keys(texts[first:], order)
        yield key, doc + np.int32(first)


def words_of(text: bytes, most: int = 0):
    """Lists of a text's lower-cased (A-Z) words, a long text's in parts cut between words."""
    most = most or SLICE
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def words(texts: list[bytes], most: int = 0):
    """The texts' lower-cased (A-Z) words in parts of ``most`` (SLICE_BYTES) bytes: (distinct words, place among them
    of each word, text of each word)."""
    most, first, total = most or SLICE_BYTES, 0, 0

    def split(low, high):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts[low:high], pa.binary()).cast(pa.string())))
        return placed(lists.flatten(), np.repeat(np.arange(low, high), np.diff(lists.offsets.to_numpy())))

    def placed(found, doc):
        coded = found.dictionary_encode()
        at, blank = coded.indices.to_numpy(), pc.index(coded.dictionary, "").as_py()  # beside outer gaps
        if blank >= 0:
            there = at != blank
            at, doc = at[there], doc[there]
        return coded.dictionary, at, doc

    for i, t in enumerate(texts):
        if total + len(t) > most and i > first:
            yield split(first, i)
            first, total = i, 0
        total += len(t)
        if len(t) > most:
            for w in words_of(t, most):
                yield placed(pa.array(w, pa.binary()).cast(pa.string()), np.full(len(w), i))
            first, total = i + 1, 0
    if first < len(texts):
        yield split(first, len(texts))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, the first of ``parts``' columns, and the sums of the others."""
    key, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], *(np.add.reduceat(x[by], first) for x in more)


def _tallied(tagged: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, its number, its number in training rows) from twice the keys, plus 1 in training rows; sorts in place."""
    tagged.sort()
    first = np.flatnonzero(np.r_[True, tagged[1:] != tagged[:-1]])
    n, tagged = np.diff(np.r_[first, len(tagged)]), tagged[first]
    key, trained = tagged >> np.uint64(1), np.where(tagged & np.uint64(1), n, 0)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first), np.add.reduceat(trained, first)


def count(docs: DataFrame, training: Column, text: str, order: int) -> DataFrame:
    """(gram, word, n, trained): counts of (context, symbol)s in all and in training rows, the word null, and of words
    in training rows, the gram null."""

    bound_batches(docs.sparkSession)
    names = ["gram", "word", "n", "trained"]

    def run(batches):
        grams: list[tuple[np.ndarray, ...]] = []
        tally: list[pa.Table] = []
        waiting: list[np.ndarray] = []
        held = spoken = 0

        def out_grams():
            key, n, trained = _merged(grams)
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.string()), pa.array(n[k : k + 100_000]), pa.array(trained[k : k + 100_000])], names=names)

        def summed_words():
            return pa.concat_tables(tally).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        def out_words():
            for part in summed_words().to_batches(max_chunksize=100_000):
                n = part.column("n")
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), part.column("word"), n, n], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                trains = part.column("training").to_numpy(zero_copy_only=False).astype(np.uint64)
                for distinct, at, _ in words([t for t, one in zip(texts, trains, strict=True) if one]):
                    n = np.bincount(at, minlength=len(distinct))
                    some = np.flatnonzero(n)
                    tally.append(pa.table({"word": distinct.take(pa.array(some)), "n": n[some]}))
                    spoken += len(some)
                    if spoken > 2 * HELD:
                        tally = [summed_words()]
                        spoken = len(tally[0])
                        if spoken > HELD:
                            yield from out_words()
                            tally, spoken = [], 0
                for key, doc in windows(texts, order):
                    waiting.append(key << np.uint64(1) | trains[doc])
                    if sum(map(len, waiting)) > AT_ONCE:
                        grams.append(_tallied(np.concatenate(waiting)))
                        waiting = []
                        held += len(grams[-1][0])
                    if held > 3 * HELD:
                        grams = [_merged(grams)]
                        held = len(grams[0][0])
                        if held > 2 * HELD:
                            yield from out_grams()
                            grams, held = [], 0
        if waiting:
            grams.append(_tallied(np.concatenate(waiting)))
        if grams:
            yield from out_grams()
        if tally:
            yield from out_words()

    flag = F.coalesce(training, F.lit(False)).alias("training")
    found = docs.select(F.col(f"`{text}`").alias("text"), flag).mapInArrow(run, "gram long, word string, n long, trained long")
    # dealt before they are summed: a task gives most of them once, so that a sum by task would find little
    return found.repartition("gram", "word").groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


class Table:
    """Hashed keys: ``find`` gives each key's place in the sorted keys, -1 if absent."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray):
        self.sorted = keys
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 2))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.at = np.full(1 << bits, self.EMPTY), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            places, who = np.unique(slot[free], return_index=True)
            self.keys[places], self.at[places] = keys[todo[free]][who], todo[free][who]
            on = self.keys[slot] != keys[todo]
            todo, slot = todo[on], (slot[on] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.at.take(slot)
        todo = np.flatnonzero(self.keys.take(slot) != keys)
        todo = todo[out[todo] >= 0]  # another key is there
        out[todo] = -1
        keys, slot = keys[todo], slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (there != self.EMPTY)
            todo, keys, slot = todo[on], keys[on], slot[on]
        return out


class Trie:
    """Pruned PPM tables. ``grams[k]``: {(context of k symbols, symbol): count}, ``contexts[k]``: {context: count}."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(grams) - 1
        self.grams, self.contexts, self.log_count, kept, distinct, seen, of = [], [], [], [], [], [], []
        for (g, c), (x, n) in zip(grams, contexts, strict=True):
            by, bx = np.argsort(g), np.argsort(x)
            g, c, x, n = g[by], c[by].astype(float), x[bx], n[bx].astype(float)
            of.append(np.searchsorted(x, g >> np.uint64(BITS)))
            self.grams.append(Table(g))
            self.contexts.append(Table(x))
            self.log_count.append(np.log10(c))
            kept.append(np.bincount(of[-1], c, len(x)))
            distinct.append(np.bincount(of[-1], minlength=len(x)).astype(float))
            seen.append(n)
        # entered anew: log of the whole and of the escape's share, per context
        self.whole = [np.log10(n + d) for n, d in zip(seen, distinct, strict=True)]
        self.anew = [c - w[o] for c, w, o in zip(self.log_count, self.whole, of, strict=True)]  # per gram
        self.escape = [np.log10(n - m + d) - w for n, m, d, w in zip(seen, kept, distinct, self.whole, strict=True)]
        # entered by an escape from the context one symbol longer: the same, per longer context
        self.whole_after, self.escape_after = [], []
        for k in range(self.order):
            longer, suffix = self.contexts[k + 1].sorted, self.contexts[k].find(self.contexts[k + 1].sorted & _low(k))
            shared = self.grams[k].find(self.grams[k + 1].sorted & _low(k + 1))
            taken = np.bincount(of[k + 1], 10.0 ** self.log_count[k][shared], len(longer)) if len(longer) else np.zeros(0)
            left = np.round(kept[k][suffix] - taken)
            new = distinct[k][suffix] - distinct[k + 1] + np.round(seen[k][suffix] - kept[k][suffix])
            sure = left <= 0  # nothing is left here: the escape is certain
            whole = np.log10(np.where(sure, 1, left + new))
            self.whole_after.append(whole)
            self.escape_after.append(np.where(sure, 0, np.log10(np.maximum(new, 1)) - whole))
        unseen = SYMBOLS - (distinct[0][0] if len(distinct[0]) else 0)
        self.uniform = -np.log10(max(unseen, 1))

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """log10 of each position's symbol in its context (``order`` symbols, then the symbol)."""
        out = np.zeros(len(key))
        todo, came = np.arange(len(key)), np.full(len(key), -1)  # came: the longer context escaped from, or -1
        for k in range(self.order, -1, -1):
            gram = key & _low(k + 1)
            hit = self.grams[k].find(gram)
            found, anew = hit >= 0, came < 0
            one = found & anew
            out[todo[one]] += self.anew[k][hit[one]]
            if k < self.order:
                one = found & ~anew
                out[todo[one]] += self.log_count[k][hit[one]] - self.whole_after[k][came[one]]
            rest = ~found
            key, todo, came, gram = key[rest], todo[rest], came[rest], gram[rest]
            context = self.contexts[k].find(gram >> np.uint64(BITS))
            one = (came < 0) & (context >= 0)
            out[todo[one]] += self.escape[k][context[one]]
            if k < self.order:
                one = came >= 0
                out[todo[one]] += self.escape_after[k][came[one]]
            came = context
        out[todo] += self.uniform
        return out


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    by = np.argsort(key)
    key, n = key[by], n[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _levels(key: np.ndarray, n: np.ndarray, low: int, high: int):
    """(grams, contexts) of orders ``low`` to ``high`` from counts of an order of at least ``high``."""
    grams = [_summed(key & _low(k + 1), n) for k in range(low, high + 1)]
    return grams, [_summed(g >> np.uint64(BITS), c) for g, c in grams]


def solve(counted: DataFrame, order: int) -> DataFrame:
    """(gram, n, p): every (context, symbol) of ``count`` with its count in all rows and log10 of its probability."""
    head = min(HEAD, order)
    grams = counted.filter("word IS NULL").select("gram", "n", "trained")
    short = grams.filter("trained > 0").groupBy(F.col("gram").bitwiseAND(F.lit(int(_low(head + 1)))).alias("key")).agg(F.sum("trained").alias("n")).toArrow()  # at most 257^(head+1)
    shared = counted.sparkSession.sparkContext.broadcast(_levels(short["key"].to_numpy().astype(np.uint64), short["n"].to_numpy(), 0, head))
    names = ["gram", "n", "p"]

    def run(batches):
        def solved(held):
            key, every, trained = (np.concatenate(x) for x in zip(*held, strict=True))
            known = trained > 0
            g, c = _levels(key[known], trained[known], head + 1, order)
            p = np.rint(Trie(shared.value[0] + g, shared.value[1] + c).log_probabilities(key) / UNIT).astype(np.int64)
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (key.astype(np.int64), every, p)], names=names)

        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            suffix, *counts = (batch.column(k).to_numpy() for k in range(4))
            counts[0] = counts[0].astype(np.uint64)
            change = np.flatnonzero(np.r_[last is None or suffix[0] != last, suffix[1:] != suffix[:-1]])
            at = 0
            if len(change) and rows + change[-1] >= CHUNK:  # whole suffixes only
                at = change[-1]
                held.append([x[:at] for x in counts])
                yield from solved(held)
                held, rows = [], 0
            held.append([x[at:] for x in counts])
            rows, last = rows + len(suffix) - at, suffix[-1]
        if rows:
            yield from solved(held)

    suffix = F.shiftrightunsigned("gram", BITS).bitwiseAND(F.lit(int(_low(head + 1))))
    dealt = grams.select(suffix.alias("suffix"), "gram", "n", "trained").repartition("suffix").sortWithinPartitions("suffix")
    return dealt.mapInArrow(run, "gram long, n long, p long")


def learn(docs: DataFrame, training: Column, text: str = "text", order: int = ORDER, gram_share: float = GRAM_SHARE, word_share: float = WORD_SHARE):
    """(Table of frequent (context, symbol)s, their log-probabilities, DataFrame of (gram, p) of the others, DataFrame
    of (word, c) of rare training words, dict of frequent words' counts, N, V, training rows)."""
    counted = cut(count(docs, training, text, order))
    totals = counted.agg(
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("positions"),
        F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("words"),
        F.count("word").alias("distinct"),
    ).first()
    ends = docs.filter(training).count()
    tokens, distinct = totals["words"] + ends, totals["distinct"] + (1 if ends else 0)
    model = cut(solve(counted, order))
    got = model.filter(F.col("n") >= totals["positions"] * gram_share).select("gram", "p").toArrow().sort_by("gram")  # at most 1/gram_share
    common, p = Table(got["gram"].to_numpy().astype(np.uint64)), got["p"].to_numpy()
    vocabulary = counted.filter("word IS NOT NULL").select("word", F.col("n").alias("c"))
    found = vocabulary.filter(F.col("c") >= tokens * word_share).toArrow()  # at most 1/word_share
    frequent = dict(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True))
    others = model.filter(F.col("n") < totals["positions"] * gram_share).select("gram", "p")
    return common, p, others, vocabulary.filter(F.col("c") < tokens * word_share), frequent, int(tokens), int(distinct), int(ends)


def _by_text(key: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, its number, text) of each text's distinct keys, by text."""
    if not len(key):
        return key.astype(np.int64), np.zeros(0, np.int64), doc
    bits = np.uint64(BITS * (order + 1))
    if (int(doc[-1]) - int(doc[0])) >> (64 - int(bits)):  # too many texts for one number
        by = np.lexsort((key, doc))
        key, doc = key[by], doc[by]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        return key[first].astype(np.int64), np.diff(np.r_[first, len(key)]), doc[first]
    both = np.sort((doc - doc[0]).astype(np.uint64) << bits | key)
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    n, both = np.diff(np.r_[first, len(both)]), both[first]
    return (both & _low(order + 1)).astype(np.int64), n, (both >> bits).astype(np.int32) + doc[0]


def score(df: DataFrame, training: Column, text: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """``df``'s columns ``keep`` (all but the text, if None) with n_tokens, n_known, train_tokens, base_score, score
    and bits_per_byte (the end counts as a byte), learned from the rows for which ``training`` holds."""
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in made]
    order = how.get("order", ORDER)
    common, p, others, rare, frequent, n, v, ends = learn(df, training, text, **how)
    whole = float(np.log10(n + v + 1))
    places = {w: i for i, w in enumerate(frequent)}
    logs = np.log10(np.array([*frequent.values(), 0.0]) + 1) - whole
    logs[-1] = 0  # of rare words, and p of rare (context, symbol)s: looked up by the joins
    shared = df.sparkSession.sparkContext.broadcast((common, np.append(p, 0), places, logs))
    end = float(np.log10(ends + 1)) - whole
    from pyspark.sql.pandas.types import to_arrow_schema

    names = fresh(df, "text", "row", "tokens", "known", "base", "sum", "rare", "grams", "more", "found", "rest", "size")
    text_, row_, tokens_, known_, base_, sum_, rare_, grams_, more_, found_, rest_, size_ = names
    inner = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(text_))
    shape = ", ".join(f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in keep) + (", " if keep else "")
    shape += f"{row_} long, {size_} long, {tokens_} long, {known_} long, {base_} double, {sum_} long, {rare_} array<struct<word:string,n:long>>, {grams_} array<struct<gram:long,n:int>>"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)

    def run(batches):
        model, logp, places, logs = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, text_):
                texts = [(t or "").encode() for t in part.column(text_).to_pylist()]
                many = len(texts)
                total = np.zeros(many, np.int64)
                found: list[tuple[np.ndarray, ...]] = []
                for key, doc in windows(texts, order):
                    at = model.find(key)
                    low, high = int(doc[0]), int(doc[-1]) + 1  # each text has a position at least, its end
                    total[low:high] += np.add.reduceat(logp.take(at, mode="wrap"), np.searchsorted(doc, np.arange(low, high)))
                    there = at < 0
                    found.append(_by_text(key[there], doc[there], order))
                tokens, hits, base = np.ones(many, np.int64), np.full(many, int(ends > 0)), np.full(many, end)
                others: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
                for distinct, at, doc in words(texts):
                    known = np.fromiter(map(places.get, distinct.to_pylist(), itertools.repeat(-1)), np.int64, len(distinct))[at]
                    tokens += np.bincount(doc, minlength=many)
                    base += np.bincount(doc, logs[known], many)
                    rest = known < 0
                    hits += np.bincount(doc[~rest], minlength=many)
                    each, n_ = np.unique(doc[rest] * len(distinct) + at[rest], return_counts=True)
                    d, at = np.divmod(each, max(len(distinct), 1))
                    others.append((distinct.take(pa.array(at)), n_, d))
                rest = listed([pa.concat_arrays([x[0] for x in others]), *(np.concatenate([x[k] for x in others]) for k in (1, 2))], rare_, many)
                grams = listed([np.concatenate(x) for x in zip(*found, strict=True)], grams_, many)
                cols = [part.column(c).cast(arrow.field(c).type) for c in keep]
                made_ = [np.arange(row, row + many), np.array([len(t) for t in texts]), tokens, hits, base, total]
                row += many
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, arrow.field(len(keep) + i).type) for i, x in enumerate(made_)), rest, grams], schema=arrow)

    def listed(columns, name, many):
        """The lists of (key, n) of each text, from columns in the order of texts: key, n, text."""
        kind = arrow.field(name).type
        value = pa.StructArray.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns[:2], kind.value_type, strict=True)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(columns[2], np.arange(many + 1)).astype(np.int32)), value).cast(kind)

    scored = cut(inner.mapInArrow(run, shape))
    looked = scored.select(row_, F.inline(rare_)).join(rare, "word", "left")
    part = looked.groupBy(row_).agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(whole))).alias(more_),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias(found_),
    )
    asked = scored.select(row_, F.inline(grams_)).join(others, "gram")
    more = asked.groupBy(row_).agg(F.sum(F.col("n") * F.col("p")).alias(rest_))
    both = scored.drop(rare_, grams_).join(part, row_, "left").join(more, row_, "left")
    whole_score = (F.col(sum_) + F.coalesce(rest_, F.lit(0))) * F.lit(UNIT)
    return both.select(
        *(F.col(f"`{c}`") for c in keep),
        F.col(tokens_).alias("n_tokens"),
        (F.col(known_) + F.coalesce(found_, F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col(base_) + F.coalesce(more_, F.lit(0.0))).alias("base_score"),
        whole_score.alias("score"),
        (-whole_score / (F.lit(math.log10(2)) * (F.col(size_) + 1))).alias("bits_per_byte"),
    )


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score(docs, ~F.col("held_out"))

