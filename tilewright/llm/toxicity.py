"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6 code points, with marks at its ends) and itself, hashed to a
table of embeddings; a text is the average of its words; a linear softmax on that average gives the class.
Embeddings and softmax are trained together on a bounded sample of labelled rows. As both are linear, a trained
model scores a word with one number, a text with averages of them; a misspelling never seen shares n-grams with
words that were.

The sample: see ``learn``. A third of it calibrates the averages to probabilities, classes weighing as in all labels,
which are counted.

Defined results: a null or empty text has no words and the score of averages of 0; rows with a null label, key or text
teach nothing; repeated labels and documents count once; if a class has no labelled rows every score is the prior;
equal rows get equal scores; very long texts are scored whole, in parts; an input column named like an output is
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_text, table

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
DIMS = 8
SEGMENT = 8
#: Bounds of the training sample: rows of each class, and code points of a row.
PER_CLASS = 3000
SAMPLE_CHARS = 20_000
EPOCHS = 8
LEAST_UPDATES = 400
#: Spread of new embeddings: near nothing, so that n-grams never trained on add no noise.
INIT = 0.001
REMEMBERED = 300_000
#: Code points of a very long text that are scored at once.
PART = 1 << 18
_GAP = re.compile(r"\s")
STRIP = "\"'.,!?;:()[]{}"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' subwords, number of each word's)."""
    marked = [f"<{w.strip(STRIP)}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(m) for m in marked], np.int64)
    word, end = np.repeat(np.arange(len(marked)), size), np.repeat(np.cumsum(size), size)
    rolled, parts = np.zeros(len(code), np.uint64), []
    here = np.arange(len(code))
    for n in range(1, max(SIZES) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
        if n in SIZES:
            ok = here[:m] + n <= end[:m]
            parts.append((word[:m][ok], rolled[ok] * np.uint64(2 * n + 1)))
    whole = np.zeros(len(marked), np.uint64)
    first = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        live = size > k
        whole[live] = whole[live] * np.uint64(0x100000001B3) + code[first[live] + k] + np.uint64(7)
    parts.append((np.arange(len(marked)), whole))
    of, hashed = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(of, kind="stable")
    hashed = hashed[order] * np.uint64(0x9E3779B97F4A7C15)
    return (hashed >> np.uint64(64 - 18)).astype(np.int32), np.bincount(of, minlength=len(marked))


def _parts(text: str):
    """Lists of a very long text's words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PART)
        end = gap.start() if gap else len(text)
        words = text[at:end].lower().split()
        if words:
            yield words
        at = end


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, weights summing to 1): the text's words' subwords, each word weighing the same."""
    count: dict[str, int] = {}
    for w in text.lower().split():
        count[w] = count.get(w, 0) + 1
    if not count:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    bucket, n = subwords(list(count))
    weight = np.repeat(np.array(list(count.values())) / n, n) / sum(count.values())
    distinct, at = np.unique(bucket, return_inverse=True)
    return distinct.astype(np.int32), np.bincount(at, weight).astype(np.float32)


class Model:
    """One number per bucket: a word's score is the mean over its subwords. A text has two averages: that of its
    distinct words, and the largest over all its runs of ``SEGMENT`` words, at every place (missing words and those that
    repeat one of the ``SEGMENT`` - 1 before them as 0), which its length doesn't dilute; ``slopes`` and ``bias`` turn
    them into log odds. A very long text is gone through in parts of ``PART`` code points, cut between words."""

    def __init__(self, weights: np.ndarray, bias: float = 0.0):
        self.weights, self.slopes, self.bias, self.known, self.scored = weights, np.zeros(2), bias, {}, np.zeros(0)

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, n = subwords(words)
        first = np.cumsum(n) - n
        return np.add.reduceat(self.weights[bucket], first) / n if len(n) else np.empty(0)

    def forget(self) -> None:
        self.known, self.scored = {}, np.zeros(0)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers in ``scored``."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.scored = np.append(self.scored, self.word_scores(new))
        return np.array([known[w] for w in words], np.int64)

    def averages(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        short = [t if t and len(t) <= PART else "" for t in texts]
        split = [t.lower().split() for t in short]
        size = np.array([len(d) for d in split])
        number = self._numbers([w for d in split for w in d])
        out = np.zeros((len(texts), 2))
        for i, (a, z) in enumerate(zip((np.cumsum(size) - size).tolist(), np.cumsum(size).tolist(), strict=True)):
            if z > a:
                out[i] = self._average([number[a:z]])
            elif texts[i] and len(texts[i]) > PART and not texts[i].isspace():
                if len(self.known) > REMEMBERED:
                    self.forget()
                out[i] = self._average(self._numbers(w) for w in _parts(texts[i]))
        return out

    def _average(self, parts) -> tuple[float, float]:
        distinct, before, most = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf
        for number in parts:
            distinct = np.union1d(distinct, number)
            run = np.concatenate([before, number])
            each = self.scored[run].copy()
            for k in range(1, SEGMENT):
                each[k:][run[k:] == run[:-k]] = 0
            total = np.cumsum(np.concatenate([np.zeros(SEGMENT), each]))
            sums = total[SEGMENT:] - total[:-SEGMENT]
            most = max(most, sums[len(before) :].max())
            before = run[1 - SEGMENT :]
        return float(self.scored[distinct].sum()) / max(len(distinct), SEGMENT), float(most) / SEGMENT

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.averages(texts) @ self.slopes, -60, 60)))

    def calibrate(self, x: np.ndarray, label: np.ndarray, prior: tuple[int, int]) -> None:
        """Logistic regression of the label on the averages, classes weighing as in ``prior``."""
        weight = np.where(label == 1, prior[1] / max(1, (label == 1).sum()), prior[0] / max(1, (label == 0).sum()))
        weight = weight / weight.sum()
        mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        z, t = np.column_stack([(x - mean) / spread, np.ones(len(x))]), np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(3), z.T @ (weight * (p - label)) + 1e-4 * t)
            t -= np.clip(step, -2, 2)
        self.slopes = np.maximum(t[:2], 0) / spread
        self.bias = float(t[2] - self.slopes @ mean)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int = DIMS, epochs: int = EPOCHS, rate: float = 0.5, batch: int = 64, decay: float = 1e-6, seed: int = 7) -> Model:
    """Bucket scores from (label, buckets, weights) rows: embeddings and softmax by AdaGrad on cross entropy."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, INIT, (BUCKETS, dims)).astype(np.float32)
    out = np.zeros((dims, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.1, dims)
    out[:, 0] = -out[:, 1]
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    scale = np.float32(30)  # averages of many words are short; this keeps their gradients in range
    for _ in range(max(epochs, -(-LEAST_UPDATES * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = [rows[i] for i in order[k : k + batch]]
            idx, val = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part]) * scale
            doc = np.repeat(np.arange(len(part)), [len(r[1]) for r in part])
            label = np.array([r[0] for r in part])
            hidden = np.stack([np.bincount(doc, emb[idx, d] * val, len(part)) for d in range(dims)], 1).astype(np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d_logits = p
            d_logits[np.arange(len(part)), label] -= 1
            d_logits /= len(part)
            d_out, d_bias, d_hidden = hidden.T @ d_logits, d_logits.sum(0), d_logits @ out.T
            distinct, at = np.unique(idx, return_inverse=True)
            d_emb = np.stack([np.bincount(at, d_hidden[doc, d] * val, len(distinct)) for d in range(dims)], 1).astype(np.float32)
            d_emb += decay * emb[distinct]
            g_emb[distinct] += (d_emb**2).mean(1)
            emb[distinct] -= rate * d_emb / np.sqrt(g_emb[distinct])[:, None] * 0.1
            g_out += d_out**2
            out -= rate * 0.1 * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= rate * 0.1 * d_bias / np.sqrt(g_bias)
    return Model((emb @ (out[:, 1] - out[:, 0])) * scale)


def fit(rows: list[tuple[int, str]], prior: tuple[int, int], **how) -> Model:
    """A model from (label, text) rows: two thirds train the embeddings, one third the calibration."""
    weights = [(c, *features(t)) for k, (c, t) in enumerate(rows) if k % 3]
    weights = [r for r in weights if len(r[1])]
    rest = [r for k, r in enumerate(rows) if not k % 3]
    if {r[0] for r in weights} != {0, 1} or {r[0] for r in rest} != {0, 1}:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((prior[1] + 0.5) / (prior[0] + 0.5))))
    model = train(weights, **how)
    x = np.concatenate([model.averages([t for _, t in rest[k : k + 500]]) for k in range(0, len(rest), 500)])
    model.calibrate(x, np.array([c for c, _ in rest]), prior)
    model.forget()
    return model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS, **how) -> Model:
    """A model from the rows of ``docs`` whose ``key`` has a label 0 or 1 in ``labels``.

    The sample is drawn among the labels alone, and only its rows' texts are fetched: at most ``per_class`` of each
    class, those of least hash of ``key``; texts of more than ``sample_chars`` code points are left out. A key with
    both labels has 1, a key with several texts the least.
    """
    told = labels.filter(F.col(label).isin(0, 1) & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(F.col(label).cast("int")).alias("label")).withColumn("h", F.xxhash64("_key"))
    prior = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    drawn = [told.filter(F.col("label") == c).orderBy("h", "_key").limit(per_class) for c in (0, 1)]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(f"`{key}`").alias("_doc"), F.col(f"`{text}`").alias("text")).filter(F.length("text") <= sample_chars)
    # one text for each of them, however often its key occurs
    texts = texts.join(picked, F.col("_doc") == F.col("_key")).groupBy("h", "_key", "label").agg(F.min("text").alias("text"))
    found = texts.select("h", "label", "text").collect()
    rows = sorted((r["h"], r["label"], r["text"]) for r in found)
    return fit([(c, t) for _, c, t in rows], (prior.get(0, 0), prior.get(1, 0)), **how)


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score``: the probability that a text is of class 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value
        return lambda texts: [known.scores(texts)]

    return map_text(df, text, [T.StructField(score, T.DoubleType())], start)


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    return score(docs, learn(docs, labels)).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
