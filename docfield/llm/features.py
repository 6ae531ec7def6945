"""Hashed word features that the two classifiers share, and their bounded training samples."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 20
#: Text of a training sample.
SAMPLE_BYTES = 256 << 20
MASK = (1 << BITS) - 1
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of 0-9, a-z and bytes beyond ASCII."""
    return text.lower().translate(_TABLE).split()


def word_hash(word: bytes) -> int:
    """32 bits, the same in every process."""
    return zlib.crc32(word)


def mixed(*columns: np.ndarray) -> np.ndarray:
    """Places in the table of features made of several hashes, in order."""
    h = np.full(columns[0].size, len(columns), np.uint64)
    for c in columns:
        h = (h ^ c) * _A
        h ^= h >> np.uint64(31)
    return (h * _B >> np.uint64(64 - BITS)).astype(np.int64)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of doc_id as text; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(0))


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, balanced: bool = False) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton steps with a little ridge. balanced: both classes weigh the same in all."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    weight = np.where(y > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) if balanced else np.ones(len(y))
    t = t * ((t.sum() + 1) / (t.sum() + 2)) + (1 - t) * (1 / ((1 - t).sum() + 2))
    loss = lambda a, b: float((weight * (np.logaddexp(0, a * margin + b) - t * (a * margin + b))).sum() + 5e-4 * a * a)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        s = weight * p * (1 - p)
        g = np.array([(weight * (p - t) * margin).sum() + 1e-3 * a, (weight * (p - t)).sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while np.abs(step).max() >= 1e-9 and loss(a - step[0], b - step[1]) > now:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Texts and labels of at most per_class rows of each class, outside held_out (a condition on doc_id).

    Rows come in the order of a hash of their ids, so the choice is the same at every run and spread over the
    table. Ids labelled more than once take their largest label; of rows that share an id the text of the smallest
    hash counts. What goes to the driver is bounded twice: 2 * per_class rows, and of each class, in the
    same order, only rows until their texts have sample_bytes / 2 together.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).where(~held_out)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("y = 0").orderBy(*order).limit(per_class).union(marks.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    met = texts.join(F.broadcast(chosen), "doc_id")  # chosen: 2 * per_class ids
    one = met.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    before = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = one.withColumn("bytes", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("bytes") < sample_bytes // 2)
    rows = held.select("doc_id", "y", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.doc_id))
    return [(r.text.encode(), r.y) for r in rows]
