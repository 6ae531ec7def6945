"""Operator 3: personal data by base patterns and a skip-chain conditional random field.

Base patterns give certain spans, which stay. The field then labels every token that holds a digit or an
at sign as other, email, ip, card or phone. Neighbouring tokens share chain potentials. Distant tokens that
repeat or resemble one another (same letters and digits, same last seven digits, same mailbox name) share
skip potentials by way of a hidden node for what they have in common, so a number found once with its prefix is also found
where it stands without, at any distance, and edges stay linear in the text. Loopy sum-product messages run until
each document's own messages settle (ROUNDS at most; a document's result doesn't depend on its batch).
A token whose label is likelier than `threshold` and that no base span touches becomes a span; neighbours
of the same likeliest label join it as far as they make one number.

Weights are trained here, piecewise: node weights by multinomial logistic regression, chain and skip
potentials by smoothed log-odds of label agreement, on SAMPLES generated and labelled documents (fixed
seed; no data of the corpus). Base matches are features that are hidden in a part of the samples.

Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows and null ids give a
row each. All patterns are linear in the text. Tokens and messages are held in arrays, about 150 bytes for a token with a
digit, for at most BLOCK_TOKENS tokens or one text; all else is worked on in steps of EDGES edges.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import Bounded, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLES, SEED = 1_500, 20
THRESHOLD = 0.95
ROUNDS, DAMPING, SETTLED = 200, 0.5, 1e-3
#: A neighbour of a likely token joins its span above this probability.
JOIN = 0.5
BLOCK_TOKENS, EDGES = 1 << 17, 1 << 16
#: Shares of the log-odds that become chain and skip potentials.
CHAIN_SCALE, SKIP_SCALE = 0.3, 0.7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"([^\s0-9@]*+[0-9@]\S*+)|\S++")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs: a match starts as far left of one as its characters reach."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- features -----------------------------------------------------------------------------------------

_COUNT_BINS = (0, 1, 3, 4, 6, 7, 9, 10, 11, 15, 16, 19)
_TESTS = (
    ("at", lambda t, d: "@" in t), ("at and dot behind", lambda t, d: "." in t.partition("@")[2].rstrip(".,;:")), ("plus first", lambda t, d: t.lstrip("([\"'")[:1] == "+"), ("brackets", lambda t, d: "(" in t and ")" in t),
    ("dash", lambda t, d: "-" in t.strip("-")), ("dashed digits", lambda t, d: bool(re.fullmatch(r"\(?\d{3}\)?-?\d{3}-\d{4}\W*|\d{3}-\d{4}\W*", t))), ("four parts", lambda t, d: bool(re.fullmatch(r"\D?\d{1,3}(\.\d{1,3}){3}\W*", t))), ("dot", lambda t, d: "." in t.rstrip(".,;:")),
    ("slash or colon", lambda t, d: "/" in t or ":" in t.rstrip(":")), ("letters", lambda t, d: any(c.isalpha() for c in t)), ("digits only", lambda t, d: t.strip(".,;:()").isdigit()), ("checksum", lambda t, d: 16 <= len(d) <= 19 and luhn(d)), ("failed checksum", lambda t, d: 16 <= len(d) <= 19 and not luhn(d)), ("other signs", lambda t, d: any(c in "=\"'_%$#*&<>" for c in t)),
    ("decimal number", lambda t, d: bool(re.fullmatch(r"\W?\d+[.,]\d+\W*", t))), ("day", lambda t, d: bool(re.fullmatch(r"\d{4}-\d\d-\d\d\W*", t))),
)
SHAPES = 1 + len(_COUNT_BINS) + len(_TESTS)
WIDTH = SHAPES + 3 * len(KINDS) + 2


def shape(token: str) -> int:
    """The tests that a token passes, as bits."""
    digits = "".join(c for c in token if c in "0123456789")
    bits = [0, *[1 + k for k, x in enumerate(_COUNT_BINS) if len(digits) > x], *[1 + len(_COUNT_BINS) + k for k, (_, test) in enumerate(_TESTS) if test(token, digits)]]
    return sum(1 << b for b in bits)


def likeness(token: str) -> tuple[int, ...]:
    """Hashes of what like tokens have in common."""
    plain = token.strip(".,;:()[]\"'").lower()
    digits = "".join(c for c in token if c in "0123456789")
    out = ["t" + plain]
    if len(digits) >= 7:
        out.append("d" + digits[-7:])
    name = plain.partition("@")[0]
    if len(name) >= 5 and any(c.isalpha() for c in name):
        out.append("n" + name)
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in out)


class Tokens:
    """Candidate tokens of some texts, in arrays: where they are, their shapes, base kinds (0: none), neighbours and likenesses."""

    def __init__(self):
        self.text, self.start, self.end, self.shape, self.base, self.linked = array("i"), array("i"), array("i"), array("I"), array("b"), array("b")
        self.key, self.key_of = array("Q"), array("i")
        self.seen = Bounded(lambda t: (shape(t), likeness(t)), 50_000)

    def __len__(self) -> int:
        return len(self.text)

    def add(self, n: int, text: str, spans: list[tuple[str, int, int]]) -> None:
        starts = sorted((a, b, 1 + KINDS.index(k)) for k, a, b in spans)
        linked, s = 0, 0
        for m in _TOKEN.finditer(text):
            if m[1] is None:
                linked = 0
                continue
            a, b = m.span()
            while s < len(starts) and starts[s][1] <= a:
                s += 1
            form, keys = self.seen[m[1]] if b - a <= 64 else (shape(m[1]), likeness(m[1]))
            for key in keys:
                self.key.append(key)
                self.key_of.append(len(self.text))
            self.text.append(n)
            self.start.append(a)
            self.end.append(b)
            self.base.append(next((k for x, y, k in starts[s : s + 4] if x < b and y > a), 0))
            self.shape.append(form)
            self.linked.append(linked)
            linked = 1

    def graph(self) -> Graph:
        text, linked = np.array(self.text, np.int32), np.array(self.linked, bool)
        second = np.flatnonzero(linked).astype(np.int32)
        key, of = np.array(self.key, np.uint64), np.array(self.key_of, np.int32)
        order = np.lexsort((of, key, text[of])) if of.size else of
        key, of = key[order], of[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (text[of[1:]] != text[of[:-1]])] if of.size else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        shared = np.bincount(group, minlength=1)[group] > 1 if of.size else new
        of, group = of[shared], group[shared]
        hub = np.cumsum(np.r_[True, group[1:] != group[:-1]]).astype(np.int32) - 1 if of.size else of
        return Graph(text, second, of, hub)

    def context(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base kinds of each token, of its neighbour before and of that behind; -1 where there is no neighbour."""
        base, linked = np.array(self.base, np.int8), np.array(self.linked, bool)
        before, behind = np.full(base.size, -1, np.int8), np.full(base.size, -1, np.int8)
        before[linked] = base[np.flatnonzero(linked) - 1]
        behind[np.flatnonzero(linked) - 1] = base[linked]
        return base, before, behind

    def features(self, hide: np.ndarray) -> np.ndarray:
        """Rows of indicators for training; hide: tokens whose base kinds, and neighbours', are not told."""
        out = np.zeros((len(self), WIDTH))
        out[:, :SHAPES] = np.array(self.shape, np.uint32)[:, None] >> np.arange(SHAPES, dtype=np.uint32) & 1
        for k, kinds in enumerate(self.context()):
            at = np.flatnonzero((kinds > 0) & ~hide)
            out[at, SHAPES + k * len(KINDS) + kinds[at] - 1] = 1
            if k:
                out[kinds >= 0, SHAPES + 3 * len(KINDS) + k - 1] = 1
        return out


class Graph:
    """Edges among tokens: chain edges by their second token, skip edges between a token and a hidden node, in the order of documents."""

    def __init__(self, text: np.ndarray, second: np.ndarray, member: np.ndarray, hub: np.ndarray):
        self.text, self.second, self.member, self.hub = text, second, member, hub
        self.hubs = int(hub[-1]) + 1 if hub.size else 0

    def edges(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ends of the chain edges and of the skip edges; hidden nodes are numbered behind the tokens."""
        return [(self.second - 1, self.second), (self.member, self.hub + np.int32(self.text.size))]


# --- training -----------------------------------------------------------------------------------------


def _entity(r: random.Random) -> tuple[str, list[str]]:
    """A kind and ways to write one entity of it, the first of which the base patterns find."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    kind = r.choice(KINDS)
    if kind == "email":
        name, host = f"{word(r.randint(4, 9))}.{digits(2)}", f"{word(5)}.{r.choice(['com', 'org', 'net'])}"
        return kind, [f"{name}@{host}", f"{name}@{word(6)}", f"{name}@"]
    if kind == "ip":
        ip = ".".join(str(r.randint(1, 255)) for _ in range(4))
        return kind, [ip, f"{ip}/24", f"{ip},"]
    if kind == "card":
        body = digits(15)
        card = body + next(c for c in "0123456789" if luhn(body + c))
        return kind, [card, f"{card}.", ".".join(card[k : k + 4] for k in range(0, 16, 4))]
    a, b, c = digits(3), digits(3), digits(4)
    return kind, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{b}-{c}"]


def _noise(r: random.Random) -> str:
    """A token with digits, or an at sign, that is no personal data."""
    n = "".join(r.choice("0123456789") for _ in range(r.randint(1, 6)))
    hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40])))
    long = "".join(r.choice("0123456789") for _ in range(r.choice([8, 9, 10, 12, 13, 14, 16, 18, 20])))
    if 16 <= len(long) <= 19 and luhn(long):
        long = long[:-1] + str((int(long[-1]) + 1) % 10)
    year = f"{r.randint(1900, 2099)}"
    return r.choice([n, n, year, f"{year}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{n}.{n[:2]}", f"v{n[0]}.{n[-1]}.0", f"${n}", f"{n}%", f"{n}-{n}", f"({n})", f'"{hexed}"', hexed, hexed.upper(), f'"{hexed.upper()}"', long, long, f"id{long}", f"{n[:2]}:{n[-2:]}", "@here", f"@{n}", f"x{n}", f"{n}x{n}", f"#{n}", f"{n},{n[:3]}"])


def labelled(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """n generated documents, each with its parts: start, end and label (a number of LABELS)."""
    r = random.Random(seed)
    for _ in range(n):
        parts: list[tuple[str, int]] = []
        entities, noises = [_entity(r) for _ in range(r.randint(0, 3))], [_noise(r) for _ in range(2)]
        for _ in range(r.randint(4, 14)):
            roll = r.random()
            if entities and roll < 0.35:
                kind, ways = r.choice(entities)
                parts.append((ways[0] if r.random() < 0.6 else r.choice(ways), LABELS.index(kind)))
            elif roll < 0.7:
                parts.append((r.choice(noises) if r.random() < 0.6 else _noise(r), 0))
            else:
                parts.append((r.choice(["the", "of", "and", "thion", "eron"]), 0))
        text, marks = "", []
        for part, label in parts:
            marks.append((len(text), len(text) + len(part), label))
            text += part + " "
        yield text, marks


class SkipChainField:
    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        tokens, gold = Tokens(), []
        for n, (text, marks) in enumerate(labelled(samples, seed)):
            first, k = len(tokens), 0
            tokens.add(n, text, base_spans(text))
            for a, b in zip(tokens.start[first:], tokens.end[first:], strict=True):
                while marks[k][1] < b:
                    k += 1
                gold.append(marks[k][2] if marks[k][0] <= a else 0)
        y, g = np.array(gold), tokens.graph()
        hide = np.random.default_rng(seed).random(len(y)) < 0.3
        self.weights = self._logistic(tokens.features(hide), y)
        votes = np.zeros((g.hubs, len(LABELS)))
        np.add.at(votes, (g.hub, y[g.member]), 1)
        shared = votes.argmax(1)  # of a hidden node: what most of its tokens are
        self.potentials = [self._agreement(y[g.second - 1], y[g.second], CHAIN_SCALE), self._agreement(y[g.member], shared[g.hub], SKIP_SCALE)]

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
        w, target, move = np.zeros((x.shape[1], len(LABELS))), np.eye(len(LABELS))[y], np.zeros((x.shape[1], len(LABELS)))
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            move = 0.9 * move + x.T @ (target - p) / len(y) - ridge * w
            w = w + 0.5 * move
        return w

    @staticmethod
    def _agreement(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
        """Log-odds of two labels at an edge, either way round, over labels drawn alone; scaled, as node weights already tell a part."""
        counts = np.ones((len(LABELS), len(LABELS)))
        np.add.at(counts, (a, b), 1)
        np.add.at(counts, (b, a), 1)
        counts /= counts.sum()
        return scale * np.clip(np.log(counts / np.outer(counts.sum(1), counts.sum(0))), -3, 3)

    def unary(self, tokens: Tokens) -> np.ndarray:
        """Log-probabilities of each token's labels from its own features."""
        forms, of = np.unique(np.array(tokens.shape, np.uint32), return_inverse=True)
        out = ((forms[:, None] >> np.arange(SHAPES, dtype=np.uint32) & 1) @ self.weights[:SHAPES])[of].astype(np.float32)
        for k, kinds in enumerate(tokens.context()):
            rows = np.zeros((len(KINDS) + 2, len(LABELS)), np.float32)  # no neighbour, no base kind, the kinds
            rows[2:] = self.weights[SHAPES + k * len(KINDS) : SHAPES + (k + 1) * len(KINDS)]
            if k:
                rows[1:] += self.weights[SHAPES + 3 * len(KINDS) + k - 1].astype(np.float32)
            out += rows[kinds + 1]
        return out - np.logaddexp.reduce(out, axis=1, keepdims=True)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Label probabilities of each token after loopy messages."""
        unary, graph = self.unary(tokens), tokens.graph()
        return np.exp(messages(unary, graph, [np.exp(p).astype(np.float32) for p in self.potentials])[: len(tokens)])

    @staticmethod
    def _one(kind: str, text: str) -> bool:
        """Whether like neighbours are parts of one number, not two numbers."""
        digits = sum(c in "0123456789" for c in text)
        return kind == "phone" and digits <= 11 or kind == "card" and digits <= 16

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]], threshold: float = THRESHOLD) -> list[list[tuple[str, int, int]]]:
        """Spans beside the base ones, for each text. Documents go in blocks of about BLOCK_TOKENS tokens."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        tokens = Tokens()
        for n, (text, spans) in enumerate(zip(texts, base, strict=True)):
            tokens.add(n, text, spans)
            if len(tokens) >= BLOCK_TOKENS:
                self._spans(tokens, texts, out, threshold)
                tokens = Tokens()
        if len(tokens):
            self._spans(tokens, texts, out, threshold)
        return out

    def _spans(self, tokens: Tokens, texts: list[str], out: list[list[tuple[str, int, int]]], threshold: float) -> None:
        p = self.marginals(tokens)
        label, best = p.argmax(1), p.max(1)
        linked, base = tokens.linked, tokens.base
        done = -1
        for i in np.flatnonzero((label > 0) & (best >= threshold)).tolist():
            if i <= done or base[i]:
                continue
            n, kind, text = tokens.text[i], LABELS[label[i]], texts[tokens.text[i]]
            like = lambda j: not base[j] and label[j] == label[i] and best[j] >= JOIN  # noqa: E731, B023
            first = last = i
            while linked[first] and first - 1 > done and like(first - 1) and self._one(kind, text[tokens.start[first - 1] : tokens.end[last]]):
                first -= 1
            while last + 1 < len(tokens) and linked[last + 1] and like(last + 1) and self._one(kind, text[tokens.start[first] : tokens.end[last + 1]]):
                last += 1
            done = last
            a, b = tokens.start[first], tokens.end[last]
            while b > a and text[b - 1] in ".,;:\"'!?":
                b -= 1
            while a < b and text[a] in "\"'[":
                a += 1
            if a < b:
                out[n].append((kind, a, b))


def messages(unary: np.ndarray, graph: Graph, factors: list[np.ndarray]) -> np.ndarray:
    """Log-marginals by loopy sum-product over tokens and hidden nodes; factors: symmetric tables of the two kinds of edges.

    Every message is made from the last round's beliefs, and a document rests when none of its own moves any more.
    Edges go in steps of EDGES. Arrays have a row for each label.
    """
    n, labels = unary.shape
    start = np.concatenate([unary.T, np.full((labels, graph.hubs), -np.log(labels), np.float32)], axis=1)
    ends = graph.edges()
    sent = [(np.zeros((labels, a.size), np.float32), np.zeros((labels, a.size), np.float32)) for a, _ in ends]  # to the second end, to the first

    by_token = np.argsort(graph.member, kind="stable")
    tokens, first_of_token = np.unique(graph.member[by_token], return_index=True)
    first_of_hub = np.searchsorted(graph.hub, np.arange(graph.hubs))

    def beliefs() -> np.ndarray:
        out = start.copy()
        for k in range(labels):
            out[k, graph.second] += sent[0][0][k]  # a token has one neighbour on each side
            out[k, graph.second - 1] += sent[0][1][k]
            if graph.hubs:
                out[k, tokens] += np.add.reduceat(sent[1][1][k][by_token], first_of_token)
                out[k, n:] += np.add.reduceat(sent[1][0][k], first_of_hub)
        return out

    def passed(cavity: np.ndarray, factor: np.ndarray) -> np.ndarray:
        cavity -= cavity.max(0)
        new = factor @ np.exp(cavity, out=cavity)
        return np.log(new / new.sum(0))

    live = [np.arange(a.size) for a, _ in ends]
    texts = int(graph.text[-1]) + 1 if n else 0
    for _ in range(ROUNDS):
        if not any(x.size for x in live):
            break
        belief, change = beliefs(), np.zeros(texts, np.float32)
        for (a, b), (there, back), factor, at in zip(ends, sent, factors, live, strict=True):
            for k in range(0, at.size, EDGES):
                e = slice(k, k + EDGES) if at.size == a.size else at[k : k + EDGES]
                old_x, old_y = there[:, e], back[:, e]
                x, y = passed(belief[:, a[e]] - old_y, factor), passed(belief[:, b[e]] - old_x, factor)
                moved = np.maximum(np.abs(x - old_x).max(0), np.abs(y - old_y).max(0))
                np.maximum.at(change, graph.text[a[e]], moved)
                there[:, e] = DAMPING * old_x + (1 - DAMPING) * x
                back[:, e] = DAMPING * old_y + (1 - DAMPING) * y
        rest = change < SETTLED
        live = [at[~rest[graph.text[a[at]]]] for (a, _), at in zip(ends, live, strict=True)]
    out = beliefs().T
    return out - np.logaddexp.reduce(out, axis=1, keepdims=True)


@lru_cache(maxsize=1)
def field() -> SkipChainField:
    """Trained once in each worker process; the same everywhere, as the seed is fixed."""
    return SkipChainField()


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found_spans(texts: list[str], threshold: float = THRESHOLD) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    held = [n for n, t in enumerate(texts) if t and ("@" in t or _DIGITS.search(t))]
    more = dict(zip(held, field().added([texts[n] for n in held], [base[n] for n in held], threshold), strict=True)) if held else {}
    return [(b, ordered(b + more.get(n, []))) for n, b in enumerate(base)]


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans: one row for each row of docs.

    Texts without a digit or an at sign can hold no span of any kind and are not sent to Python.
    """
    sha = lambda spans: hashlib.sha256(joined(spans).encode()).hexdigest()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = found_spans([t or "" for t in batch.column("text").to_pylist()], threshold)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([sha(b) for b, _ in rows]), pa.array([joined(a) for _, a in rows])], names)

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first and longest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with personal data masked in `text`; n_chars, where docs has it, counts the new text. Other columns and null texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = found_spans([t or "" for t in texts], threshold)
            new = [t if t is None or not s else mask(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            k = batch.schema.get_field_index("n_chars")
            if k >= 0 and pa.types.is_integer(batch.schema.field(k).type):
                columns[k] = pa.array([old if a is b else len(b) for old, a, b in zip(columns[k].to_pylist(), texts, new, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
