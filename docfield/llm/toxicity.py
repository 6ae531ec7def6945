"""Operator 4: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features (present or not, 2^20 places): words and their first three to six characters, pairs of neighbours, and
pairs with one word between. Training is online: each coordinate has its own learning rate, and L1 keeps
the weights sparse, so what is sent to the tasks is a short list of places and weights. Rows of class 1, the rarer one,
count POSITIVE times. Besides a model of all rows there is one for each of FOLDS folds, and the weights are
their mean, as a single pass order is chancy on small samples. A sigmoid turns margins into scores: it is fitted, with both
classes weighing the same, on the margins that the folds' models give to the rows they didn't learn from,
and its odds are raised by MISSED, as a missed row costs more than a false alarm.

Learns on the driver from a bounded sample: at most PER_CLASS labelled rows of either class, in the order
of a hash of their ids. Scores every whole text. Null and empty texts get the score of the bias alone.
Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import Bounded, as_bytes, id_and_text, slices
from docfield.llm.features import BITS, MASK, crc_of_id, label_sample, mixed, sigmoid_fit, word_hash, words_of

PER_CLASS = 4_000
PASSES, ALPHA, BETA, L1, L2 = 6, 4.0, 1.0, 14.0, 0.1
POSITIVE, FOLDS, MISSED = 5.0, 3, 2.0
THRESHOLD = 0.7
CACHE_WORDS = 500_000
PREFIXES = (3, 4, 5, 6)


def word_places(word: bytes) -> tuple[int, ...]:
    """Places of the features of one word: itself, and its beginnings that are shorter."""
    text = word.decode("utf-8", "replace")
    own = [(word, 0), *((text[:n].encode("utf-8"), n) for n in PREFIXES if len(text) > n)]
    return tuple({(word_hash(w) ^ 0x2545F491 * n & 0xFFFFFFFF) * 0x9E3779B1 >> 7 & MASK for w, n in own})


def pair_places(hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.uint64)
    return np.concatenate([mixed(h[:-1], h[1:]), mixed(h[:-2], h[2:] ^ np.uint64(0x5BD1E995))])


def places(text: bytes, of_word=word_places) -> np.ndarray:
    """All places of a text, each once."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int32)
    own = set().union(*map(of_word, set(words)))
    return np.unique(np.r_[np.fromiter(own, np.int64, len(own)), pair_places(np.array([word_hash(w) for w in words], np.uint64))]).astype(np.int32)


class FTRL:
    """Follow the regularised leader, proximal form (McMahan et al. 2013)."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias

    def weights(self, at: np.ndarray, rate: np.ndarray | None = None) -> np.ndarray:
        """Weights of places, of which the last is the bias: it has no L1. rate: roots of their squared gradients."""
        z = self.z[at]
        rate = np.sqrt(self.n[at]) if rate is None else rate
        held = np.clip(z, -self.l1, self.l1)
        held[-1] = 0
        return (held - z) / ((self.beta + rate) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: int, weight: float = 1.0) -> float:
        """One row (distinct places, then the bias) with its label; gives the probability it had before."""
        n = self.n[at]
        rate = np.sqrt(n)
        w = self.weights(at, rate)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = weight * (p - y)
        n += g * g
        self.z[at] += g - (np.sqrt(n) - rate) / self.alpha * w
        self.n[at] = n
        return p

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange((1 << BITS) + 1))


def fitted(rows: list[np.ndarray], y: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights, the bias last, from rows of places with the bias behind them. Classes take turns as far as their numbers allow."""
    model, place = FTRL(), np.zeros(len(y))
    for k in (0, 1):
        of = np.flatnonzero(y == k)
        place[of] = (np.arange(of.size) + 0.5) / max(of.size, 1)
    order = np.lexsort((y, place)).tolist()
    for _ in range(passes):
        for i in order:
            model.learn(rows[i], y[i], POSITIVE if y[i] else 1.0)
    return model.all_weights()


def train(sample: list[tuple[bytes, int]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, the weights, the bias, all scaled by the sigmoid; nothing if a class is missing."""
    y = np.array([k for _, k in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    of_word = Bounded(word_places, CACHE_WORDS).__getitem__
    rows = [np.r_[places(t, of_word), 1 << BITS] for t, _ in sample]
    w = fitted(rows, y, passes)
    fold = np.zeros(len(y), np.int64)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    a, b = 1.0, 0.0
    if min((y == k).sum() for k in (0, 1)) >= 10 * FOLDS:
        margin, total = np.zeros(len(y)), w.copy()
        for f in range(FOLDS):
            own = np.flatnonzero(fold != f)
            v = fitted([rows[i] for i in own], y[own], passes)
            total += v
            for i in np.flatnonzero(fold == f):
                margin[i] = v[rows[i]].sum()
        a, b = sigmoid_fit(margin, y, balanced=True)
        w, b = total / (FOLDS + 1), b + float(np.log(MISSED))
    at = np.flatnonzero(w[:-1])
    return at, a * w[at], a * float(w[-1]) + b


class Scorer:
    """Scores texts with sparse weights: words and pairs without a weight drop out before anything is gathered."""

    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float):
        self.w, self.bias = np.zeros(1 << BITS), bias
        self.w[at] = w
        self.used = self.w != 0
        self.places = frozenset(np.flatnonzero(self.used).tolist())
        self.seen = Bounded(self._mark, CACHE_WORDS)

    def _mark(self, word: bytes) -> int:
        """The word's hash, with bit 32 set if a feature of the word has a weight."""
        return word_hash(word) | (not self.places.isdisjoint(word_places(word))) << 32

    def score(self, text: bytes) -> float:
        words = words_of(text)
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        marks = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        pairs = pair_places(marks & np.uint64(0xFFFFFFFF))
        hot = set(pairs[self.used[pairs]].tolist())
        for i in np.flatnonzero(marks >> np.uint64(32)).tolist():
            hot.update(p for p in word_places(words[i]) if self.used[p])
        z = self.bias + float(self.w[sorted(hot)].sum()) if hot else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1) for each row of docs."""
    at, w, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(at, w, bias)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer.score(t) for t in as_bytes(batch.column("text"))], pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learnt from rows that aren't held out."""
    out = crc_of_id(F.col("doc_id")) % 3 == 1
    scored = score_documents(docs, train(label_sample(docs, labels, "toxic", out, per_class)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
