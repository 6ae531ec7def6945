"""Operator 2: exact merge-type (BPE) encoding and decoding of SentencePiece models by backtracking.

Method. All vocabulary matches of a word come from one Aho-Corasick pass. Encoding walks from the left
and takes the longest match first; a match may follow its left neighbour only if re-merging the two
gives the same two pieces again. Where no match fits, the position is marked in a bitfield of failed
positions and the walk backs up by one piece. The result is the one sequence that the merge order yields.

No vocabulary piece holds a space mark after another character, so a text is encoded word by word, and
each worker keeps the words it has met in a bounded cache. Runs of spaces merge only among themselves
(at the lowest score) and are merged directly, ties from the left.

Null text counts as empty (no ids, decoded to the empty text). Length is not limited.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docfield.llm.common import Bounded, id_and_text, slices

SPACE = "▁"
NORMAL = 1
#: Entries of a worker's word cache.
CACHE_WORDS = 200_000
CACHE_PAIRS = 200_000
CACHE_TAILS = 50_000


class PieceModel:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(processor.serialized_model_proto())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only identity normalisation with a leading space is supported")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        if {p.type for p in proto.pieces} - {1, 2, 3, 6}:
            raise ValueError("user-defined or unused pieces are not supported")
        if any(SPACE in text.lstrip(SPACE) for _, text, _ in pieces):
            raise ValueError("a piece holds a space mark behind another character")
        if any(text.startswith(SPACE * 2) and text.strip(SPACE) for _, text, _ in pieces):
            raise ValueError("a piece holds several space marks before a word")

        self.ids = {text: i for i, text, _ in pieces}
        self.texts = {i: text for i, text, _ in pieces}
        self.score = {text: score for _, text, score in pieces}
        runs = [text for _, text, _ in pieces if text == SPACE * len(text) and len(text) > 1]
        words = [text for _, text, _ in pieces if text not in set(runs)]
        if runs and max(self.score[r] for r in runs) >= min(self.score[w] for w in words if len(w) > 1):
            raise ValueError("space runs must merge last")
        scores = [self.score[w] for w in words if len(w) > 1]
        if len(set(scores)) != len(scores):
            raise ValueError("two merges have one score")
        #: Merge order of word pieces: single characters come first, as they need no merge.
        order = sorted(words, key=lambda w: (len(w) > 1, -self.score[w]))
        self.rank = {self.ids[w]: n for n, w in enumerate(order)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        #: Neighbouring characters that some piece holds; no merge crosses any other seam.
        self.joined = {w[k : k + 2] for w in words for k in range(len(w) - 1)}

        #: The last merge of each reachable piece; what no merge order yields stays out of the automaton.
        self.halves: dict[int, tuple[int, int] | None] = {}
        automaton = ahocorasick.Automaton()
        for w in order:
            derived = self._merged(w)
            if derived is not False:
                i = self.ids[w]
                self.halves[i] = derived
                automaton.add_word(w, (len(w), i, len(w) - 1))
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs = Bounded(lambda ab: self._fits(*ab), CACHE_PAIRS)
        self.words = Bounded(self._word, CACHE_WORDS)
        self.tails = Bounded(self._known, CACHE_TAILS)
        self.runs = Bounded(self._run, 4_096)
        self.spans = [(self.texts[i].replace(SPACE, " ").encode() if i in self.texts else self.bytes_of.get(i, b"")) for i in range(len(proto.pieces))]
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.spans[self.unk] = trainer.unk_surface.encode()

    def _merged(self, word: str):
        """The two halves of the last merge when the merge order turns `word` into one piece, None for a character, else False."""
        parts, last = list(word), None
        while len(parts) > 1:
            best = max(((self.score[a + b], -n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return False
            n = -best[1]
            last = (parts[n], parts[n + 1])
            parts[n : n + 2] = [parts[n] + parts[n + 1]]
        return last and (self.ids[last[0]], self.ids[last[1]])

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces anew gives the same two pieces.

        Undoes the later of the two pieces' last merges along the seam, one at a time; a merge across
        the seam that would have come before the merges undone so far breaks the pair.
        """
        rank, halves, ids, texts = self.rank, self.halves, self.ids, self.texts
        limit = len(rank) * 2 + 2  # double ranks: odd limits order ties, as the left one of equal merges goes first
        while True:
            across = ids.get(texts[left] + texts[right])
            if across is not None and across in rank and 2 * rank[across] < limit:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                limit = 2 * rank[left]
                left = a[1]
            else:
                limit = 2 * rank[right] + 1
                right = b[0]

    def _known(self, word: str) -> tuple[int, ...]:
        """Encodes characters between which merges may happen."""
        n = len(word)
        if n == 1:
            i = self.ids.get(word)
            return (i,) if i is not None else tuple(self.byte_ids[b] for b in word.encode())
        starts: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            starts[end - found[2]].append(found)  # ends rise, so sizes rise too
        failed, out, pos, fits = bytearray(n + 1), [], 0, self.pairs
        while pos < n:
            for size, i, _ in reversed(starts[pos]):
                if not failed[pos + size] and (not out or fits[out[-1], i]):
                    out.append(i)
                    pos += size
                    break
            else:
                failed[pos] = 1
                pos -= len(self.texts[out.pop()])
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        """ids of a word; one that starts with a line break stands without a space mark, all others with one."""
        joined, bare = self.joined, word[0] == "\n"
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        if not bare and SPACE + word[0] not in joined:
            return (self.ids[SPACE], *self._tails(word, [0, *cuts]))
        if not cuts:
            return self._known(word if bare else SPACE + word)
        head = word[: cuts[0]]
        return (*(self.tails[head] if bare else self.words[head]), *self._tails(word, cuts))

    def _tails(self, word: str, cuts: list[int]) -> list[int]:
        return [i for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True) for i in self.tails[word[a:b]]]

    def _run(self, n: int) -> tuple[int, ...]:
        """ids of n space marks alone: best score first, ties from the left."""
        parts, after, before = [SPACE] * n, [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (both := parts[a] + parts[b]) in self.score:
                heapq.heappush(heap, (-self.score[both], a, b, len(both)))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return tuple(self.ids[p] for p in parts if p)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        words = text.replace("\n", " \n").split(" ")
        seen, out = self.words, []
        if "" not in words:
            for w in words:
                out += seen[w]
            return out
        pending, mark = 0, self.ids[SPACE]
        for w in words:
            if not w:
                pending += 1
                continue
            ids = seen[w]
            if pending and w[0] == "\n":
                out += self.runs[pending]
            elif pending:
                if ids[0] == mark:
                    out += self.runs[pending + 1]
                    ids = ids[1:]
                else:
                    out += self.runs[pending]
            pending = 0
            out += ids
        if pending:
            out += self.runs[pending]
        return out

    def decode(self, ids) -> str:
        spans = self.spans
        if len(ids) and min(ids) < 0:
            raise IndexError("id out of range")
        raw = b"".join([spans[i] for i in ids])
        first = next((i for i in ids if spans[i]), None)
        if first is not None and self.texts.get(first, "").startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._repaired(ids, raw)

    def _repaired(self, ids, raw: bytes) -> str:
        """As the library does: in a run of byte ids, each byte that starts no whole character becomes U+FFFD."""
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.bytes_of:
                run += self.bytes_of[i]
                continue
            k = 0
            while k < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[k : k + size].decode())
                        k += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            first = first and not run
            run.clear()
            if i is not None:
                text = self.spans[i].decode()
                out.append(text[1:] if first and text.startswith(" ") and i in self.texts else text)
                first = first and not text
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, decode: bool = True) -> DataFrame:
    """doc_id, ids array<int>, decoded string: one row for each row of docs (null text: no ids). Without `decode` the last column is left out."""
    names = ["doc_id", "ids", "decoded"] if decode else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in slices(batches):
            ids = [m.encode(t or "") for t in batch.column("text").to_pylist()]
            texts = [pa.array([m.decode(x) for x in ids], pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), *texts], names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if decode else ""))


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of encode_documents, taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sha = model(model_path), hashlib.sha256
        for batch in slices(batches):
            counts, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids = m.encode(text or "")
                counts.append(len(ids))
                a.append(sha(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                b.append(sha(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
