"""Operator 7: naive Bayes support vectors (NBSVM, Wang and Manning 2012) for document quality.

Features are indicators, hashed to 2^20 places: word unigrams and bigrams; unigrams to trigrams of token
shapes (capital, lower, digits, signs, stops, repeats of the token before); and the text's shares of repeated
words, repeated lines and signs, cut into steps. Each indicator is scaled by its class log-count ratio, rows
are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al.
2008). A sigmoid fitted on rows that the descent didn't see turns margins into scores.

Learns on the driver from a bounded sample: at most PER_CLASS labelled rows of either class, in the order
of a hash of their ids. Scores every whole text. Null and empty texts have the single indicator of no words.
Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import Bounded, as_bytes, id_and_text, slices
from docfield.llm.features import BITS, crc_of_id, label_sample, mixed, sigmoid_fit, word_hash

PER_CLASS = 5_000
C, EPOCHS, SMOOTH, SEED = 1.0, 10, 1.0, 7
THRESHOLD = 0.3
CACHE_WORDS = 500_000
STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
_SHAPE = bytes(ord("9") if 0x30 <= b <= 0x39 else ord("A") if 0x41 <= b <= 0x5A else ord("a") if 0x61 <= b <= 0x7A or b >= 0x80 else ord(".") if b in b".,;:!?'\"()-" else ord("|") if b == ord("|") else ord("*") for b in range(256))
_KINDS = np.uint64(0x51ED27), np.uint64(0x2F0B43), np.uint64(0x7C15A9), np.uint64(0x1B8735), np.uint64(0x64E6D1)


def shape(token: bytes) -> bytes:
    """Runs of character classes, each once: Thre*** is Aa*."""
    marks = token.translate(_SHAPE)
    return bytes(c for k, c in enumerate(marks) if not k or marks[k - 1] != c)[:6]


def token_marks(token: bytes) -> int:
    """Hash of the token in lower case, then of its shape."""
    return word_hash(token.lower()) << 32 | zlib.crc32(shape(token))


def _steps(name: bytes, share: float) -> list[int]:
    return [word_hash(b"%s>%d" % (name, k)) for k, s in enumerate(STEPS) if share > s]


class Features:
    def __init__(self, size: int = CACHE_WORDS):
        self.seen = Bounded(token_marks, size)

    def places(self, text: bytes) -> np.ndarray:
        """Places of a text's indicators, each once."""
        tokens = text.split()
        if not tokens:
            return mixed(np.array([word_hash(b"no words")], np.uint64), _KINDS[4:5] * np.ones(1, np.uint64))
        marks = np.fromiter(map(self.seen.__getitem__, tokens), np.uint64, len(tokens))
        word, form = marks >> np.uint64(32), marks & np.uint64(0xFFFFFFFF)
        same = np.r_[False, word[1:] == word[:-1]]
        form = np.where(same, np.uint64(1), form)
        lines = [x for x in text.split(b"\n") if x.strip()]
        counted = np.unique(word).size
        extra = [*_steps(b"words again", 1 - counted / len(tokens)), *_steps(b"word beside itself", same.mean()), *_steps(b"lines again", 1 - len(set(lines)) / len(lines)), *(word_hash(b"length>%d" % k) for k in range(1, 15) if len(tokens) >> k)]
        one = lambda kind, *c: mixed(np.full(c[0].size, kind), *c)
        found = [one(_KINDS[0], np.unique(word)), one(_KINDS[1], word[:-1], word[1:]), one(_KINDS[2], np.unique(form)), one(_KINDS[3], form[:-1], form[1:]), one(_KINDS[3], form[:-2], form[1:-1], form[2:]), one(_KINDS[4], np.array(extra, np.uint64))]
        return np.unique(np.concatenate(found))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Of each place: log of its share among the indicators of class 1 over that of class 0."""
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for at, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[at] += 1
    return np.log(p / (p.sum())) - np.log(q / (q.sum()))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine; the two classes weigh the same in all."""
    w, bias, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    norm = [float(v @ v) + 1.0 for v in values]
    share = (y > 0).mean()
    cap = np.where(y > 0, c * 0.5 / share, c * 0.5 / (1 - share))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i], values[i]
            g = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cap[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class NBSVM:
    """ratio, weight, bias and sigmoid; `known` are the places that the sample has."""

    def __init__(self, sample: list[tuple[bytes, int]]):
        f = Features(200_000)
        rows = [f.places(t) for t, _ in sample]
        y = np.array([1.0 if k else -1.0 for _, k in sample])
        self.v, self.r2, self.bias, self.a, self.b = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0
        if len(set(y.tolist())) < 2:
            return
        tuned = np.arange(len(rows)) % 5 == 4
        fit = np.flatnonzero(~tuned)
        if len(rows) < 50 or len(set(y[fit].tolist())) < 2 or len(set(y[tuned].tolist())) < 2:
            fit, tuned = np.arange(len(rows)), np.ones(len(rows), bool)
        ratio = log_count_ratio([rows[i] for i in fit], y[fit])
        values = [ratio[rows[i]] / max(np.linalg.norm(ratio[rows[i]]), 1e-9) for i in fit]
        w, self.bias = dual_descent([rows[i] for i in fit], values, y[fit])
        self.v, self.r2 = (ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32)
        margins = np.array([self.margin(rows[i]) for i in np.flatnonzero(tuned)])
        self.a, self.b = sigmoid_fit(margins, y[tuned])

    def margin(self, at: np.ndarray) -> float:
        return float(self.v[at].sum() / max(np.sqrt(self.r2[at].sum()), 1e-9) + self.bias)

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(at) + self.b, -35, 35))))


def score_documents(docs: DataFrame, model: NBSVM) -> DataFrame:
    """doc_id, score (0 to 1) for each row of docs. The model's two tables (2^20 numbers each) are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = held.value, Features()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.score(f.places(t)) for t in as_bytes(batch.column("text"))], pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learnt from rows that aren't held out."""
    out = crc_of_id(F.col("doc_id")) % 5 == 0
    scored = score_documents(docs, NBSVM(label_sample(docs, labels, "quality", out, per_class)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
