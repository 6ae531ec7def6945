"""Operator 9: SimHash near-duplicates by deletion-variant signatures.

Fingerprint: XXH64 (seed 42) of each 4-word shingle of the text with A-Z lower-cased; a bit is 1 if set
in more than half of the hashes. Fewer than four words are one shingle, none give fingerprint zero.

Search: fingerprints that differ by k = 4 bits at most are cut into k // 2 + 1 = 3 segments, so that one
segment differs by one bit at most. Each segment is indexed under every one-wildcard variant (one bit
left out), which makes 64 keys a fingerprint; equal keys meet by a shuffle on the key and are verified.

Only distinct fingerprints are indexed. A bucket yields a spanning forest of its links, never all its
pairs. Buckets above BUCKET members are keyed anew by exact pieces of the other bits (five, of which one
must be equal), and what is still above it by midpoints: two fingerprints within four bits have a
midpoint within two bits of both, and all that share a midpoint are linked to its least member. Both
ways are complete, so no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import as_bytes, id_and_text, slices, stored
from docfield.llm.components import components

WORDS, BITS, SEED = 4, 4, 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Members of a bucket that one task compares.
BUCKET = 20_000
#: In buckets of up to so many members every pair is compared by shifting.
SMALL = 8
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    m = len(words) - WORDS + 1
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :])], np.uint64, m)  # noqa: B905
    counts = np.zeros(64, np.int64)
    for k in range(0, m, CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text, to tell rows of one id apart), fp (as a signed long): one row for each row. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter(map(fingerprint, as_bytes(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    return id_and_text(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, fp long")


def _variant_key(bit: Column) -> Column:
    """Number of the left-out bit, then its segment without that bit."""
    offset = F.when(bit < 21, 0).when(bit < 42, 21).otherwise(42)
    mask = F.when(bit < 42, (1 << 21) - 1).otherwise((1 << 22) - 1)
    segment = F.call_function("shiftrightunsigned", F.col("fp"), offset).bitwiseAND(mask.cast("long"))
    hole = F.call_function("shiftleft", F.lit(1).cast("long"), bit - offset)
    return F.call_function("shiftleft", bit.cast("long"), F.lit(22)).bitwiseOR(segment.bitwiseAND(F.bitwise_not(hole)))


def _piece_keys() -> Column:
    """For a bucket too large: its key with each of five exact pieces of the bits outside its segment."""
    bit = F.call_function("shiftright", F.col("key"), F.lit(22)).cast("int")
    n = F.when(bit < 21, 0).when(bit < 42, 1).otherwise(2)
    out = None
    for s, (offset, width) in enumerate(SEGMENTS):
        others = [b for b in range(64) if not offset <= b < offset + width]
        cuts = [others[len(others) * k // 5 : len(others) * (k + 1) // 5] for k in range(5)]
        keys = []
        for k, cut in enumerate(cuts):
            mask = sum(1 << b for b in cut)
            mask -= (mask >> 63) << 64
            keys.append(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
        out = F.when(n == s, F.array(*keys)) if out is None else out.when(n == s, F.array(*keys))
    return out


def _forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each component among the members: all but the first, and the first. Breadth-first over what is left, so a dense group takes few passes."""
    left, children, roots = np.unique(members), [], []
    while left.size:
        root, frontier, left = left[0], left[:1], left[1:]
        while frontier.size and left.size:
            near = np.zeros(left.size, bool)
            for one in frontier:
                rest = np.flatnonzero(~near)
                if not rest.size:
                    break
                near[rest[np.bitwise_count(left[rest] ^ one) <= bits]] = True
            frontier, left = left[near], left[~near]
            children.append(frontier)
            roots.append(np.full(frontier.size, root))
    none = np.zeros(0, np.uint64)
    return np.concatenate([*children, none]), np.concatenate([*roots, none])


def bucket_links(bits: int = BITS, bucket: int = BUCKET):
    """For mapInArrow over rows sorted by key: links (kind 0: two fingerprints) and rows of buckets too large (kind 1: key, fingerprint)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole buckets."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, key.size])
        large = np.repeat(sizes > SMALL, sizes)
        k, f = key[~large], fp[~large]
        for lag in range(1, SMALL):
            at = np.flatnonzero(k[lag:] == k[:-lag])
            if not at.size:
                break
            at = at[np.bitwise_count(f[at] ^ f[at + lag]) <= bits]
            if at.size:
                yield out(0, f[at], f[at + lag])
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            if n > bucket:
                yield out(1, key[s : s + n].view(np.uint64), fp[s : s + n])
            else:
                a, b = _forest(fp[s : s + n], bits)
                if a.size:
                    yield out(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if over is not None:  # the rest of a bucket known to be too large
                n = int(np.searchsorted(key, over, side="right"))
                if n:
                    yield out(1, key[:n].view(np.uint64), fp[:n])
                key, fp = key[n:], fp[n:]
                if not key.size:
                    continue
                over = None
            if not key.size:
                continue
            whole = int(np.searchsorted(key, key[-1], side="left"))
            if whole:
                yield from links(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
            if key.size > bucket:
                yield out(1, key.view(np.uint64), fp)
                over, key, fp = key[-1], key[:0], fp[:0]
        if key.size:
            yield from links(key, fp)

    return run


def _bucketed(keyed: DataFrame, bits: int, bucket: int) -> DataFrame:
    return stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links(bits, bucket), "kind int, a long, b long"), "links")


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect exactly what all links of distinct fingerprints (column fp) would connect."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    found = _bucketed(nodes.select("fp", bit).select(_variant_key(F.col("bit")).alias("key"), "fp"), bits, bucket)
    out, over = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if over.isEmpty():
        return out
    found = _bucketed(over.select(F.explode(_piece_keys()).alias("key"), "fp"), bits, bucket)
    out, over = out.union(found.where("kind = 0").select("a", "b")), found.where("kind = 1").select(F.col("b").alias("fp")).distinct()
    if over.isEmpty():
        return out
    flips = [sum(1 << b for b in c) for n in range(bits // 2 + 1) for c in combinations(range(64), n)]
    masks = F.array(*[F.lit(m - ((m >> 63) << 64)).cast("long") for m in flips])
    near = over.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    first = near.groupBy("mid").agg(F.min("fp").alias("b"))
    return out.union(near.join(first, "mid").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def classes(docs: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, h, fp, component_id for each row of docs; component_id is the smallest doc_id that links reach, the row's own included.

    Null ids don't count in that minimum; a class without any other has a null component_id. Repeated rows
    stay repeated. An empty table gives no rows.
    """
    if not 2 <= bits <= BITS:
        raise ValueError("three segments are complete for two to four bits")
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, bits, bucket))
    labelled = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(labelled.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "h", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (of repeated ids, the smallest text hash; of rows equal in both, the one whose JSON is smallest).

    A class whose ids are all null keeps one row the same way. Other columns pass through, whatever their names.
    """
    found = stored(classes(docs).select("doc_id", "h", "fp", F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull().alias("n")), "classes")
    keep = found.groupBy("c", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("k")).select("k.doc_id", "k.h")
    repeated = not found.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    if repeated:  # equal ids and texts: the row that is first as JSON, aggregated map-side
        row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        docs = row.groupBy(F.col("row.doc_id").cast("long").alias("i"), F.xxhash64(F.col("row.text").cast("string")).alias("h")).agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")).select("row.*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(keep, rows["row.doc_id"].cast("long").eqNullSafe(keep["doc_id"]) & (F.xxhash64(rows["row.text"].cast("string")) == keep["h"]), "left_semi")
    return kept.select("row.*")
