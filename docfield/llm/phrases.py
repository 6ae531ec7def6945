"""Operator 5: benchmark decontamination with a distributed positional inverted index.

The training side is indexed by document: each task turns a run of documents into a segment and writes its terms and
posting lists (term: ascending token positions, counted through the segment, a gap between documents) to the shared
folder. Every word of the corpus has its list, so the index serves any later benchmark or phrase. Lists are never
gathered by term, so a frequent word fills no single task, and there is no shuffle.

A phrase is answered segment by segment: its terms are taken from the rarest of the segment to the most frequent, and
the lists, moved by the terms' offsets, are intersected; most phrases end at their first or second list. All windows of
a block of items go through these steps together: those that lack a term in the segment drop out first, the others
bring the list of their rarest term. `proximity` does the same for terms within a distance.

Words: A-Z lower-cased, runs of 0-9, a-z and all characters beyond ASCII. A window is 13 consecutive words of an item;
a shorter item that has a word is one window. Null texts have no words. Items may repeat; the windows of items without
an id count as hits and name no item. Items are held against the index in blocks of ITEM_BYTES of text, which bounds
what the driver holds and each task is sent, whatever the benchmark's size (longer items are cut, with overlap); the
index is built once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import as_bytes, slices, stored

WINDOW = 13
#: Text of the items in one block.
ITEM_BYTES = 4 << 20
SEGMENT_BYTES = 24 << 20
#: Places between the documents of a segment, which no list has.
GAP = 1
#: Windows, and places of their rarest terms, that one step takes at a time.
STEP_WINDOWS, STEP_PLACES = 1 << 15, 1 << 21

_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
INDEX = "docs binary, n_words binary, keys binary, terms binary, sizes binary, positions binary"
HITS = "doc_id long, key long, n_words long, hits array<array<long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


def _packed(array: np.ndarray) -> bytes:
    """Compressed, equal bytes of the numbers together: the high ones are mostly zero."""
    import zstandard

    planes = np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class _Numbers(dict):
    """A number for each new key, from 0."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def segment(texts: Iterable[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """n_words of each text; the terms; their list sizes, and the lists one after another."""
    numbers, counts, keys, at = _Numbers(), [], [], 0
    number = numbers.__getitem__
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        term = np.fromiter(map(number, words), np.uint64, len(words))
        keys.append(term << np.uint64(32) | np.arange(at, at + len(words), dtype=np.uint64))
        at += len(words) + GAP
    key = np.sort(np.concatenate([*keys, np.zeros(0, np.uint64)]))
    sizes = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(numbers))
    return np.array(counts, np.int64), list(numbers), sizes.astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def build_index(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Segments of the positional index of docs (doc_id, text), stored in the shared folder. key: a long that tells rows of one id apart, by default the hash of the text."""
    import zstandard

    names = INDEX.replace(" binary", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, limit=SEGMENT_BYTES):
            counts, terms, sizes, place = segment(as_bytes(batch.column("text")))
            doc = batch.column("doc_id")
            null = np.array(doc.is_null().to_numpy(zero_copy_only=False), np.int64)
            rows = np.r_[null, np.array(doc.fill_null(0).to_numpy(zero_copy_only=False), np.int64)]
            step = np.diff(place, prepend=0).astype(np.int32)  # ascending inside a list
            row = (_packed(rows), _packed(counts), _packed(np.array(batch.column("key"), np.int64)), pack(b" ".join(terms)), _packed(sizes.astype(np.int32)), _packed(step))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(docs.withColumn("key", F.xxhash64("text") if key is None else key).mapInArrow(run, INDEX), "postings")


class Segment:
    """Posting lists of a stored segment."""

    def __init__(self, row: dict):
        import zstandard

        docs = _unpacked(row["docs"], np.int64)
        self.null, self.docs = docs[: docs.size // 2].astype(bool), docs[docs.size // 2 :]
        self.n_words, self.keys = _unpacked(row["n_words"], np.int64), _unpacked(row["keys"], np.int64)
        self.first = np.cumsum(np.r_[0, self.n_words + GAP])[:-1]
        terms = zstandard.ZstdDecompressor().decompress(row["terms"])
        self.number = {w: k for k, w in enumerate(terms.split())}
        self.sizes = _unpacked(row["sizes"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.cumsum(_unpacked(row["positions"], np.int32).astype(np.int64))

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        """The segment's number of each term, -1 where it has none."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in terms), np.int64, len(terms))

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def _places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each term's list, with the index of the term in the argument."""
        n = self.sizes[term]
        of = np.repeat(np.arange(term.size), n)
        inside = np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
        return of, self.place[self.starts[term][of] + inside]

    def _has(self, lists: np.ndarray, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list; lists: term and place in one number, ascending."""
        want = term << 32 | place
        at = np.searchsorted(lists, want)
        at[at == lists.size] = 0
        return lists[at] == want

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of windows (the segment's numbers of their terms, -1: none) that occur, and where they begin."""
        none = np.zeros(0, np.int64)
        rows = np.flatnonzero((windows >= 0).all(1))
        if not rows.size:
            return none, none
        terms = windows[rows]
        used = np.unique(terms)
        of, place = self._places(used)
        lists = used[of] << 32 | place  # ascending, as used and the lists are
        order = np.argsort(self.sizes[terms], axis=1, kind="stable")
        cost = self.sizes[np.take_along_axis(terms, order[:, :1], 1)[:, 0]]
        found = []
        cuts = np.flatnonzero(np.diff(np.cumsum(cost) // STEP_PLACES)) + 1
        for part in np.split(np.arange(rows.size), cuts):
            w, at = self._places(terms[part, order[part, 0]])
            w = part[w]
            at = at - order[w, 0]
            for k in range(1, terms.shape[1]):
                offset = order[w, k]
                good = (at >= 0) & self._has(lists, terms[w, offset], at + offset)
                w, at = w[good], at[good]
                if not w.size:
                    break
            good = at >= 0
            found.append((rows[w[good]], at[good]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def near(self, terms: list[bytes], distance: int) -> np.ndarray:
        """Places of the rarest term that have every other term within `distance` words of the same document."""
        numbers = np.unique(self.numbers(terms))
        if not numbers.size or numbers[0] < 0:
            return np.zeros(0, np.int64)
        rarest, *others = numbers[np.argsort(self.sizes[numbers], kind="stable")].tolist()
        of = lambda t: self.place[self.starts[t] : self.starts[t] + self.sizes[t]]
        found = of(rarest)
        for t in others:
            d = self.document(found)
            low, high = np.maximum(found - distance, self.first[d]), np.minimum(found + distance, self.first[d] + self.n_words[d] - 1)
            found = found[np.searchsorted(of(t), low) < np.searchsorted(of(t), high, side="right")]
        return found


class Block:
    """Windows of some items: distinct ones, with the items that have them. Its size is bounded by the text of the items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        numbers = _Numbers()
        words = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for _, w in items]
        self.terms = list(numbers)
        self.names = sorted({i for i, _ in items if i is not None})
        name = {i: k for k, i in enumerate(self.names)}
        self.ids = np.concatenate([*words, np.zeros(0, np.int32)])
        starts, size, item, at = [], [], [], 0
        for (i, _), w in zip(items, words, strict=True):
            n = max(1, w.size - window + 1)
            starts.append(np.arange(at, at + n))
            size.append(np.full(n, min(w.size, window)))
            item.append(np.full(n, -1 if i is None else name[i]))
            at += w.size
        none = np.zeros(0, np.int64)
        starts, size, item = (np.concatenate([*x, none]) for x in (starts, size, item))
        #: size of the windows: (place of each distinct one in ids, where its items start in the list, the list)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            at, of = starts[size == n], item[size == n]
            rows = np.ascontiguousarray(self.ids[at[:, None] + np.arange(n)])
            _, first, same = np.unique(rows.view(f"V{rows.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(same.astype(np.int64) * (len(name) + 1) + of + 1)  # distinct window and item + 1
            pairs = pairs[pairs % (len(name) + 1) > 0]
            self.windows[n] = at[first].astype(np.int32), np.searchsorted(pairs // (len(name) + 1), np.arange(first.size + 1)), (pairs % (len(name) + 1) - 1).astype(np.int32)


def blocks(items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> Iterator[Block]:
    """Items (item_id, text) in blocks of about item_bytes of text, read one after another; longer items are cut, with window - 1 words of overlap."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        words = words_of((r.t or "").encode())
        while words:
            total, n = 0, 0
            while n < len(words) and (n < window or total < item_bytes):
                total += len(words[n]) + 1
                n += 1
            if held and size + total > item_bytes:
                yield Block(held, window)
                held, size = [], 0
            held.append((r.i, words[:n]))
            size += total
            words = words[n - window + 1 :] if n < len(words) else []
    if held:
        yield Block(held, window)


def _lists(values: pa.Array, of: np.ndarray, n: int) -> pa.Array:
    """values (ordered by row) as one list for each of n rows; of: their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def block_hits(s: Segment, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Covered runs of a segment (start, end; ascending, merged); documents and the items found in them, ascending pairs."""
    number, width = s.numbers(block.terms), len(block.names) + 1
    starts, ends, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, (places, first, items) in block.windows.items():
        for k in range(0, places.size, STEP_WINDOWS):
            rows, at = s.phrases(number[block.ids[places[k : k + STEP_WINDOWS, None] + np.arange(n)]])
            starts.append(at)
            ends.append(at + n)
            seen = np.unique(s.document(at) * places.size + rows + k)
            d, w = seen // places.size, seen % places.size
            count = first[w + 1] - first[w]
            of = np.repeat(np.arange(w.size), count)
            inside = np.arange(of.size) - np.repeat(np.cumsum(count) - count, count)
            pairs.append(np.unique(d[of] * width + items[first[w][of] + inside]))
    start, end, pair = np.concatenate(starts), np.concatenate(ends), np.unique(np.concatenate(pairs))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if start.size else np.zeros(0, np.int64)
    last = np.r_[new[1:], start.size] - 1 if start.size else new
    return start[new], reach[last] if start.size else reach, pair // width, pair % width


def _hits(index: DataFrame, block: Block, every: bool) -> DataFrame:
    """HITS of the index's documents; with `every` those without a hit too."""
    held = index.sparkSession.sparkContext.broadcast(block)  # its size is bounded by ITEM_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        names = pa.array(block.names, pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                start, end, doc, item = block_hits(s, block)
                of, n = s.document(start), s.docs.size
                bounds = np.stack([start - s.first[of], end - s.first[of]], 1).ravel()
                runs = pa.ListArray.from_arrays(pa.array(np.arange(0, bounds.size + 1, 2, dtype=np.int32)), pa.array(bounds, pa.int64()))
                out = pa.RecordBatch.from_arrays([pa.array(s.docs, pa.int64(), mask=s.null), pa.array(s.keys), pa.array(s.n_words), _lists(runs, of, n), _lists(names.take(pa.array(item)), doc, n)], ["doc_id", "key", "n_words", "hits", "items"])
                yield out if every else out.filter(pa.array(np.bincount(of, minlength=n) > 0))

    return index.mapInArrow(run, HITS)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("hits")
        columns = list(batch.columns)
        columns[at] = pa.array([merged(x) for x in columns[at].to_pylist()], pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def index_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """HITS of items (item_id, text) in a stored index: one row for each row that was indexed, covered words as runs (start, end)."""
    parts = [_hits(index, block, not k) for k, block in enumerate(blocks(items, window, item_bytes))] or [_hits(index, Block([], window), True)]
    if len(parts) == 1:
        return parts[0]
    every = parts[0].withColumn("copies", F.lit(1))
    for p in parts[1:]:  # rows with hits only
        every = every.unionByName(p.withColumn("copies", F.lit(0)))
    one = every.groupBy("doc_id", "key", "n_words").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("copies").alias("copies"))
    whole = one.select("doc_id", "key", "n_words", "hits", "items", "copies").mapInArrow(_merged_rows, HITS + ", copies long")
    return whole.select("doc_id", "key", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """HITS of items in docs, whose index is built and stored first: one row for each row of docs."""
    return index_matches(build_index(docs), items, window, item_bytes)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, key, n_words, n_hit, items, contaminated (a twentieth of the words hit, or more) for each row of docs."""
    found = matches(docs, items, window, item_bytes)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), "items").withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The figures of contamination() with the items as a count and a digest."""
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated rows, all columns as they are. Null texts stay; repeated rows stay or go together."""
    bad = contamination(docs, items).where("contaminated").select("doc_id", "key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    good = rows.join(bad, rows["row.doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & F.xxhash64(rows["row.text"].cast("string")).eqNullSafe(bad["key"]), "left_anti")
    return good.select("row.*")


def index_proximity(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """doc_id, n_places: documents that hold all the words of `terms` within `distance` words of the rarest one, and at how many of its places.

    Which word is the rarest goes by the segment; of equally rare ones the first that the segment met. A word asked
    twice counts once, one place of each other word is enough. Rows of one id stay apart; no terms find nothing.
    """
    wanted = [w for t in terms for w in words_of(t.encode())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                n = np.bincount(s.document(s.near(wanted, distance)), minlength=s.docs.size)
                keep = n > 0
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(s.docs[keep], pa.int64(), mask=s.null[keep]), pa.array(n[keep])], ["doc_id", "n_places"])

    return index.mapInArrow(run, "doc_id long, n_places long")


def proximity(docs: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """index_proximity() over docs, whose index is built and stored first."""
    return index_proximity(build_index(docs), terms, distance)
