"""Operator 1: token ids as a wavelet matrix per shard.

Texts are put into ascending doc_id order by range partitions, tokenised, and written as shards. A shard is
one row of one Parquet file (so that Spark's commit protocol, not our own, guards against lost or repeated
tasks): a wavelet matrix in one compressed blob, with the documents' ids and lengths beside it.

Shard blob: the bytes "WVM1", version-independent little-endian header (tokens n as u64, planes as u8, zeros of each
plane as u64), then each bit-plane as a zstd frame behind its u32 length, highest bit first. A plane holds
n bits, least bit of each byte first, padded to whole 64-bit words. The rank directory (ones before each
512-bit block) follows from a plane in one pass and is made when a plane is opened.

    access(i)       token at place i
    rank(t, i)      how often token t stands before place i
    count(t)        how often it stands in the shard
    select(t, k)    place of its k-th occurrence, from 0
    tokens()        all tokens at once

Order: null ids first, then ascending; rows of one id by the hash of their texts. Null text counts as empty
(the end id alone). A shard holds SHARD_TOKENS tokens or one document; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfield.llm.common import id_and_text, shared_path, slices

END_ID = 2
SHARD_TOKENS = 8 << 20
BLOCK_WORDS = 8
#: Entries of a worker's word cache.
CACHE_WORDS = 700_000
SHARDS = "part long, seq long, n_docs long, n_tokens long, doc_ids binary, lengths binary, matrix binary"


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ones: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def of(cls, tokens: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        tokens = np.ascontiguousarray(tokens)
        bits = bits or max(1, int(tokens.max(initial=0)).bit_length())
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (tokens >> tokens.dtype.type(b) & tokens.dtype.type(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes.append(np.pad(packed, (0, -packed.size % 8)).view(np.uint64))
            zeros.append(int(tokens.size - np.count_nonzero(one)))
            if b:
                tokens = np.concatenate([tokens[~one], tokens[one]])
        return cls(tokens.size, planes, zeros)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        out = [b"WVM1", struct.pack("<QB", self.n, len(self.planes)), struct.pack(f"<{len(self.zeros)}Q", *self.zeros)]
        for plane in self.planes:
            data = pack(plane.tobytes())
            out += [struct.pack("<I", len(data)), data]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != b"WVM1":
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QB", blob, 4)
        zeros = struct.unpack_from(f"<{bits}Q", blob, 13)
        at, planes, unpack = 13 + 8 * bits, [], zstandard.ZstdDecompressor().decompress
        for _ in range(bits):
            (size,) = struct.unpack_from("<I", blob, at)
            planes.append(np.frombuffer(unpack(blob[at + 4 : at + 4 + size]) if n else b"", np.uint64))
            at += 4 + size
        return cls(n, planes, list(zeros))

    def _before(self, level: int) -> np.ndarray:
        """Ones before each block of a plane."""
        if self._ones[level] is None:
            counts = np.bitwise_count(self.planes[level]).astype(np.int64)
            self._ones[level] = np.r_[0, np.cumsum(np.add.reduceat(counts, np.arange(0, counts.size, BLOCK_WORDS)) if counts.size else counts)]
        return self._ones[level]

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 6]) >> (i & 63) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        plane, word = self.planes[level], i >> 6
        block = word // BLOCK_WORDS
        n = int(self._before(level)[block]) + int(np.bitwise_count(plane[block * BLOCK_WORDS : word]).sum())
        return n + (int(plane[word]) & (1 << (i & 63)) - 1).bit_count() if i & 63 else n

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th such bit of a plane."""
        before = self._before(level)
        if not bit:
            before = np.arange(before.size, dtype=np.int64) * 64 * BLOCK_WORDS - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        words = self.planes[level][block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS]
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return block * 64 * BLOCK_WORDS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        """Bounds of the token's run in the last order, counted up to place i."""
        start, end, bits = 0, min(max(i, 0), self.n), len(self.planes)
        if token < 0 or token >> bits:
            return 0, 0
        for level in range(bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if token >> (bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, i: int) -> int:
        start, end = self._walk(token, i)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        start, end = self._walk(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i, bits = start + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            if token >> (bits - 1 - level) & 1:
                i = self._select(level, 1, i - self.zeros[level])
            else:
                i = self._select(level, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: the planes are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            put = np.empty_like(out)
            put[~one] = out[: self.zeros[level]]
            put[one] = out[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            out = put
        return out


class WordTokenizer:
    """ids of texts by a tokenizers file whose words never span a space or line break.

    New words go to the library together, with a control character between them, which is a token of its own; known
    ones come from a bounded cache. Words that hold the character themselves are encoded alone. Texts of Latin-1
    characters are lower-cased beforehand, which the file's own normaliser (NFC, then lower case) leaves as they are;
    a stop behind letters is a word of its own for the file, and so its letters are looked up without it. Texts that
    hold a special token, in any case, go to the library as they are: it finds special tokens before it lower-cases.
    """

    MARK = "\x00"
    STOPS = frozenset(".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.seen: dict[str, tuple[int, ...]] = {}
        self.own = list(range(self.library.get_vocab_size())).__getitem__  # one object for each id
        (self.mark,) = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.bits = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.apart = self._spaces_part()
        self.byte_marks = {b: m for b in range(0x20, 0xC4) for m in self._byte_mark(b)}
        self.special = sorted({x for t in self.library.get_added_tokens_decoder().values() for x in (t.content, t.content.lower())})

    @staticmethod
    def _byte_mark(byte: int) -> str:
        """The character that stands for a byte of a Latin-1 word in the byte-level alphabet: printable bytes for themselves, others from U+0100 on."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(byte if byte in printable else 0x100 + sum(b not in printable for b in range(byte)))

    def _spaces_part(self) -> bool:
        """Whether this file's words end at spaces and line breaks: it drops white space and knows no piece with one."""
        import json

        d = json.loads(self.library.to_str())
        kind = d.get("pre_tokenizer") or {}
        split = (kind.get("pretokenizers") or [kind])[0]
        return split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and split["pattern"].get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and "Lowercase" in json.dumps(d.get("normalizer"))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        seen, own, merge, plain = self.seen, self.own, self.library.model.tokenize, []
        for w in words:
            if not w.isalpha() or not w.isascii() and max(w) > "\xff" or w != w.lower():
                plain.append(w)
            else:  # one word for the file's pattern, and its normaliser leaves it: only the merges are left to do
                seen[w] = tuple([own(t.id) for t in merge(w if w.isascii() else "".join(map(self.byte_marks.__getitem__, w.encode())))])
        words, plain = plain, [w for w in plain if self.MARK not in w]
        for w in words:
            if self.MARK in w:
                seen[w] = tuple(self._ids([w])[0])
        for k in range(0, len(plain), 2_000):
            part = plain[k : k + 2_000]
            ids, start = [*map(own, self._ids([f" {self.MARK} ".join([*part, ""])])[0])], 0
            mark, find = self.mark, ids.index
            for w in part:
                end = find(mark, start)
                seen[w] = tuple(ids[start:end])
                start = end + 1

    def _split(self, text: str) -> list[str] | None:
        """Words of a text, or None if it has to go to the library whole."""
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        if any(s in text for s in self.special):
            return None
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """ids of each text, with end_id appended."""
        split = [self._split(t) if self.apart else None for t in texts]
        whole = [k for k, found in enumerate(split) if found is None]
        if whole:
            ids = iter(self._ids([texts[k] for k in whole]))
            rest = iter(self._encode([found for found in split if found is not None], end_id))
            return [np.array([*next(ids), end_id], np.uint32) if found is None else next(rest) for found in split]
        return self._encode(split, end_id)

    def _encode(self, split: list[list[str]], end_id: int) -> list[np.ndarray]:
        """The same of texts cut into words, by the cache."""
        words = set().union(*split) if split else set()
        seen = self.seen
        new = words.difference(seen)
        if new:
            if len(seen) + len(new) > CACHE_WORDS:
                seen.clear()
                new = words
            tailed = [w for w in new if w[-1:] in self.STOPS and w[:-1].isalpha() and (w.isascii() or max(w) <= "\xff")]
            need = new.difference(tailed).union(w[:-1] for w in tailed).union(w[-1] for w in tailed)
            self._learn([w for w in need if w not in seen])
            for w in tailed:
                seen[w] = seen[w[:-1]] + seen[w[-1]]
        get, end = seen.__getitem__, ((end_id,),)
        return [np.fromiter(chain.from_iterable(chain(map(get, found), end)), np.uint32) for found in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> str:
    """Tokenises docs in ascending doc_id order into shards at `path` (a new folder of the shared one if None), and returns the path."""
    path = path or shared_path(docs.sparkSession, "tokens")

    def shard(part: int, seq: int, ids: list[int | None], held: list[np.ndarray], bits: int) -> pa.RecordBatch:
        null = np.array([i is None for i in ids], np.int64)
        tokens = np.concatenate(held)
        tokens = tokens.astype(np.uint16) if bits <= 16 else tokens
        row = (part, seq, len(ids), tokens.size, np.r_[null, np.array([i or 0 for i in ids], np.int64)].tobytes(), np.array([x.size for x in held], np.int64).tobytes(), WaveletMatrix.of(tokens, bits).to_bytes())
        kinds = [pa.int64()] * 4 + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seq = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, held, total = [], [], 0
        for batch in slices(batches):
            for i, found in zip(batch.column("doc_id").to_pylist(), t.encode([x or "" for x in batch.column("text").to_pylist()], end_id), strict=True):
                if held and total + found.size > shard_tokens:
                    yield shard(part, seq, ids, held, t.bits)
                    ids, held, total, seq = [], [], 0, seq + 1
                ids.append(i)
                held.append(found)
                total += found.size
        if held:
            yield shard(part, seq, ids, held, t.bits)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = id_and_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    ranged.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(path)
    return path


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards at path."""
    shards = spark.read.parquet(path)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row of two numbers for each shard
    starts = shards.select("part", "seq", "n_tokens").select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = WaveletMatrix.from_bytes(row["matrix"]).tokens().astype("<u4")
                lengths, ids = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["doc_ids"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                n = lengths.size
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["seq"])), pa.array(ids[n:], pa.int64(), mask=ids[:n].astype(bool)), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark, path: str, token: int) -> DataFrame:
    """part, seq, n, places: how often and where a token stands in each shard that has it, by count and select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix.from_bytes(row["matrix"])
                if n := m.count(token):
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]]), pa.array([row["seq"]]), pa.array([n]), pa.array([[m.select(token, k) for k in range(n)]], pa.list_(pa.int64()))], ["part", "seq", "n", "places"])

    return spark.read.parquet(path).mapInArrow(run, "part long, seq long, n long, places array<long>")
