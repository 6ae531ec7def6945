"""Operator 6: quality rules by distribution divergence.

Each document has two histograms: of character classes and of a language's common words (plus all other
words). Their Jensen-Shannon distances (square root of the divergence, base 2, 0 to 1) to the
references of the document's language decide, beside a few counted base rules. Under MIN_CHARS or
MIN_WORDS a histogram says too little, and its distance doesn't count.

References are taken in a first pass, so that neither a source nor the usual junk moves them: documents that fail
the base rules or hold more than one symbol in ten words are left out, sources fall into GROUPS groups by a hash of their
names (partial sums, one row for each language, group, bin and task), and a bin's value is the median of the groups' means.
Where groups are small, they are folded into fewer, each source still in one. It takes junk in half of a language's
groups to carry the median; a table of one source or without the column has one group, which is the plain mean.
A document of no or of an unknown language is held against every reference, the nearest of which counts; the same if
its language has too few documents.

Null text has no words. Languages that hold no reference at all leave only the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import as_bytes, slices

#: Frequent function words of each language (public common knowledge), in natural order.
COMMON_WORDS = {
    "de": "auch auf aus bei das dem den der des die ein eine einer es für ich im in ist mit nicht sich sie und von war wie zu",
    "en": "a an and are as at be by for from had have he his i in is it not of on or that the this to was were which with you",
    "es": "a al como con de del el en es esta la las lo los más no o para pero por que se su sus un una y",
    "fr": "au aux avec ce dans de des du elle en est et il la le les leur ne ou par pas plus pour que qui se sur un une",
}
SYMBOLS = b"#*$%&|<>"
WHITE = bytes([0x20, *range(0x09, 0x0E)])
CLASSES = ("vowel", "consonant", "capital", "other letter", "digit", "space", "line break", "stop", "symbol", "other")

WINDOW, MIN_CHARS, MIN_WORDS = 5, 200, 50
#: A language's own reference holds from so many documents in the corpus; groups are folded until they have GROUP_DOCS in the median.
REFERENCE_DOCS, GROUPS, GROUP_DOCS = 5, 64, 20
#: Good texts have a median class distance of 0.04, table-like and symbol-laden ones 0.18 and more.
#: A text without any common word is 0.38 to 0.39 from its reference, one in another language mostly more than 0.40.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.18, 0.36


def _class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a character have none (len(CLASSES))."""
    out = np.full(256, CLASSES.index("other"), np.int64)
    for name, members in (("consonant", b"bcdfghjklmnpqrstvwxyz"), ("vowel", b"aeiou"), ("capital", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" \t\x0b\x0c\r"), ("line break", b"\n"), ("stop", b".,;:!?'\"()-"), ("symbol", SYMBOLS + b"@[]{}\\/^_~`+=")):
        out[list(members)] = CLASSES.index(name)
    out[0xC0:] = CLASSES.index("other letter")
    out[0x80:0xC0] = len(CLASSES)
    return out


TABLE = _class_table()
EVERY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Bins of the word histogram: every listed word, then all others.
BIN = {w.encode(): n for n, w in enumerate(EVERY)}


def class_histogram(text: bytes) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def bins(words: list[bytes]) -> np.ndarray:
    get, rest = BIN.get, len(EVERY)
    return np.bincount([get(w, rest) for w in words], minlength=rest + 1) if words else np.zeros(rest + 1, np.int64)


_STOPS = bytes.maketrans(b".,;:!?\"()", b" " * 9)


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_STOPS).split()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 1 if just one is empty."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return float(bool(a) != bool(b))
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(min(1.0, max(0.0, d / 2))))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == n:
        return 0
    m = n - window + 1
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = (h ^ ids[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if all((ids[a + k] == ids[b + k]).all() for k in range(window)):
        twice = np.zeros(m, bool)
        twice[a] = twice[b] = True
    else:  # two windows share a hash: compare the windows themselves
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window), axis=0, return_inverse=True, return_counts=True)
        twice = counts[inverse.ravel()] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += twice
    edge[window : window + m] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = int((TABLE[np.frombuffer(text.translate(None, WHITE), np.uint8)] < len(CLASSES)).sum())
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


#: A document's histogram enters its group's sum in so many equal parts, so that long documents weigh no more than others; whole numbers, so that sums don't depend on their order.
PARTS = 1_000_000


def is_sound(text: bytes, words: list[bytes]) -> bool:
    """May a text enter a reference? By fixed rules, whatever else the table holds."""
    n, _, symbols, _, repeats = base_counts(text)
    return not base_failed(n, repeats) and 10 * symbols <= len(words)


def median_of_groups(groups: np.ndarray) -> np.ndarray | None:
    """The reference from the groups' sums (a row for each of GROUPS, the last column counts documents); None if documents are too few."""
    if groups[:, -1].sum() < REFERENCE_DOCS:
        return None
    while len(groups) > 1 and np.median(groups[groups[:, -1] > 0, -1]) < GROUP_DOCS:
        groups = groups[: len(groups) // 2] + groups[len(groups) // 2 :]
    groups = groups[groups[:, -1] > 0]
    return np.median(groups[:, :-1] / groups[:, -1:], axis=0)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and word histograms of each language: medians over groups of sources. The result is one row for each language, group and bin."""
    width, rest = len(CLASSES), len(EVERY) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in slices(batches):
            for lang, group, text in zip(batch.column("lang").to_pylist(), batch.column("grp").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if len(text) < MIN_CHARS:
                    continue
                classes, words = class_histogram(text), plain_words(text)
                if classes.sum() >= MIN_CHARS and len(words) >= MIN_WORDS and is_sound(text, words):
                    counts = bins(words)
                    own = np.r_[classes * PARTS // classes.sum(), counts * PARTS // counts.sum(), 1]
                    key = (lang, group)
                    sums[key] = sums[key] + own if key in sums else own
        rows = [(*key, n, int(x)) for key, found in sums.items() for n, x in enumerate(found) if x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["lang", "grp", "bin", "n"])

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    group = F.pmod(F.crc32(source.cast("binary")), F.lit(GROUPS)).cast("int")
    known = docs.select(F.col("lang").cast("string").alias("lang"), group.alias("grp"), F.col("text").cast("string").alias("text")).where(F.col("lang").isin(*sorted(COMMON_WORDS)))
    found: dict[str, np.ndarray] = {}
    for r in known.mapInArrow(run, "lang string, grp int, bin int, n long").groupBy("lang", "grp", "bin").agg(F.sum("n").alias("n")).collect():  # languages x groups x bins
        found.setdefault(r.lang, np.zeros((GROUPS, width + rest + 1), np.int64))[r.grp, r.bin] = r.n
    medians = {lang: median_of_groups(x) for lang, x in sorted(found.items())}
    return {lang: (x[:width], x[width:]) for lang, x in medians.items() if x is not None}


def verdict(text: bytes, lang: str | None, refs: dict) -> tuple[float, float]:
    """Distances of a text's class and word histograms to its language's references; 0 where the text is too short."""
    if not refs or len(text) < MIN_CHARS:
        return 0.0, 0.0
    held = [refs[lang]] if lang in refs else list(refs.values())
    classes, words = class_histogram(text), plain_words(text)
    by_class = min(distance(classes, r[0]) for r in held) if classes.sum() >= MIN_CHARS else 0.0
    by_word = 0.0
    if len(words) >= MIN_WORDS:
        counts = bins(words)
        by_word = min(distance(counts, r[1]) for r in held)
    return by_class, by_word


def _judged(texts: list[bytes], langs: list, refs: dict, max_class: float, max_word: float) -> Iterator[tuple]:
    for text, lang in zip(texts, langs, strict=True):
        n, chars, symbols, lines, repeats = base_counts(text)
        failed = base_failed(n, repeats)
        by_class, by_word = verdict(text, lang, refs)
        yield n, chars, symbols, lines, repeats, failed, by_class, by_word, not failed and by_class <= max_class and by_word <= max_word


REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def quality_report(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, the base counts, both distances and the verdict: one row for each row of docs."""
    refs = references(docs)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    names = [x.split()[0] for x in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(_judged(as_bytes(batch.column("text")), batch.column("lang").to_pylist(), refs, max_class, max_word))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, " + REPORT)


def keep_good(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of docs whose verdict is to keep them, all columns as they are."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = _judged(as_bytes(batch.column("text")), batch.column("lang").to_pylist(), refs, max_class, max_word)
            kept = batch.filter(pa.array([r[-1] for r in rows], pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
