"""The deciding parts of the operators against naive versions of the same method, and bounds of time and memory."""

import hashlib
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# --- 8 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def markov(spark):
    from docfield.llm.secrets import train

    return train(spark)


def test_markov_ratio_is_the_mean_of_transitions(spark, markov):
    from docfield.llm import secrets as s

    table, limits = markov
    code = {c: k for k, c in enumerate(s.ALPHABET)} | {d: s.ALPHABET.index("0") for d in "0123456789"} | {c: s.ALPHABET.index("_") for c in s.SIGNS}
    tokens = [(r.token,) for r in s.identifier_samples(spark, 200, 5_000_000).collect()] + [("a",), ("",)]
    out = spark.createDataFrame(tokens, "token string").select("token", s.ratio(F.col("token"), s.table_column(table)).alias("r"), s.is_secret(F.col("token"), table, limits).alias("hit"))
    for r in out.collect():
        logs = [table[code[a] * len(s.ALPHABET) + code[b]] for a, b in zip(r.token, r.token[1:])]  # noqa: B905
        want = math.fsum(logs) / len(logs) if logs else 0.0
        assert abs(r.r - want) < 1e-9 and (r.hit == (want > limits[sum(len(r.token) >= b for b in s.BANDS[1:])]) or abs(want - max(limits)) < 1e-9)


def test_markov_on_labelled_tokens(spark, markov):
    from docfield.llm import secrets as s

    fresh = s.identifier_samples(spark, 5_000, 9_000_000).select("secret", s.is_secret(F.col("token"), *markov).cast("int").alias("hit"))
    share = {r.secret: r.share for r in fresh.groupBy("secret").agg(F.avg("hit").alias("share")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.002, share
    hand = [("Xq7Zk2Wv9Lp4Rt", 1), ("kJ8sQz1mWx0pTy5v", 1), ("qZkWxJvKyPBdRtGfHs", 1), ("8fA3kL0zQ1", 0), ("getUserAccountName", 0), ("MAX_RETRY_COUNT_2024", 0), ("chapter-12-section-3", 0), ("responsibilities", 0), ("v2/users/list/1000", 0)]
    rows = spark.createDataFrame([(k, f"see {t} here") for k, (t, _) in enumerate(hand)], "doc_id long, text string")
    assert {r.doc_id: len(r.added) for r in s.secret_spans(rows, markov).collect()} == {k: y for k, (_, y) in enumerate(hand)}


def test_markov_spans_leave_base_spans_alone(spark, markov):
    from docfield.llm import secrets as s

    r = random.Random(8)
    parts = ["token=", "Xq7Zk2Wv9Lp4Rt8Yb3Nd6", " ", " ", "AKIAABCDEFGHIJ12345", "0123456789abcdef0123", "/", "é", "-", "secret: ", "kJ8sQz1mWx0pTy5v", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(800)]
    for x in s.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), markov).collect():
        t, table = texts[x.doc_id], markov[0]
        tokens = [m.span() for m in re.finditer(s.TOKEN.replace("*+", "*"), t)]
        free = [(a, b) for a, b in tokens if not any(y.start < b and y.end > a for y in x.base)]
        added = [(y.start, y.end) for y in x.added]
        assert set(added) <= set(free) and added == sorted(added), repr(t)
        assert all(("Xq7Zk2Wv9Lp4Rt8Yb3Nd6" not in t[a:b]) or (a, b) in added or len(t[a:b]) > 60 for a, b in free), repr(t)


def test_secrets_of_long_tokens_and_many_matches(spark, markov):
    from docfield.llm.secrets import secret_spans

    r = random.Random(1)
    one = "".join(r.choice("ghijkqxzLMNOPQXZ07+/") for _ in range(1_000_000))
    texts = {1: one, 2: " ".join(f"{r.getrandbits(64):016x}" for _ in range(200_000)), 3: " ".join(["Xq7Zk2Wv9Lp4Rt8Yb3Nd6"] * 50_000)}
    for k, t in texts.items():
        began = time.time()
        row = secret_spans(spark.createDataFrame([(k, t)], "doc_id long, text string"), markov).select(F.size("base").alias("b"), F.size("added").alias("a"), F.element_at(F.concat("base", "added"), -1)["end"].alias("end")).first()
        assert (row.b, row.a, row.end) == {1: (0, 1, 1_000_000), 2: (200_000, 0, len(texts[2])), 3: (0, 50_000, len(texts[3]))}[k]
        assert time.time() - began < 120


# --- 5 ------------------------------------------------------------------------------------------------


def test_digests_of_contamination(spark):
    from docfield.llm.phrases import digests
    from tests.llm.test_operators import brute_hits

    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: h for r, h in zip(rows, brute_hits([r.text for r in rows], [(r.item_id, r.text) for r in items.collect()]), strict=True)}
    got = digests(docs, items).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n)


def test_phrases_of_random_texts_and_steps(monkeypatch):
    from docfield.llm import phrases as p

    monkeypatch.setattr(p, "STEP_WINDOWS", 7)
    monkeypatch.setattr(p, "STEP_PLACES", 5)
    r = random.Random(6)
    for _ in range(200):
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 30))).encode() for _ in range(r.randint(0, 6))]
        counts, terms, sizes, place = p.segment(texts)
        key = lambda x: p._packed(np.asarray(x))
        import zstandard

        row = {"docs": key(np.r_[np.zeros(len(texts), np.int64), np.arange(len(texts))]), "n_words": key(counts), "keys": key(counts), "terms": zstandard.ZstdCompressor().compress(b" ".join(terms)), "sizes": key(sizes.astype(np.int32)), "positions": key(np.diff(place, prepend=0).astype(np.int32))}
        s = p.Segment(row)
        items = [(r.choice(["x", "y", None]), [r.choice("abcde").encode() for _ in range(r.randint(1, 7))]) for _ in range(4)]
        start, end, doc, item = p.block_hits(s, p.Block(items, 3))
        want, named = set(), set()
        for d, t in enumerate(texts):
            w = t.split()
            for i, words in items:
                for k in range(max(1, len(words) - 2)):
                    part = words[k : k + 3]
                    for a in range(len(w) - len(part) + 1):
                        if w[a : a + len(part)] == part:
                            want |= {(d, x) for x in range(a, a + len(part))}
                            named |= {(d, i)} if i else set()
        got = [(int(d), int(x - s.first[d])) for a, b, d in zip(start, end, s.document(start), strict=True) for x in range(a, b)]
        names = sorted({i for i, _ in items if i})
        assert sorted(got) == sorted(want) and {(int(d), names[k]) for d, k in zip(doc, item, strict=True)} == named


def test_items_of_a_million_words_stay_in_bounded_blocks(spark):
    from docfield.llm.phrases import blocks, contamination

    word = lambda n: np.base_repr(n + 50_000, 36).lower()
    items = [(k, " ".join(word(n) for n in range(k * 1_000, k * 1_000 + 1_000))) for k in range(1_000)] + [(1_000, " ".join(word(n) for n in range(500_000)))]
    frame = spark.createDataFrame(items, "item_id long, text string").coalesce(4)
    held = list(blocks(frame, item_bytes=1 << 20))
    assert len(held) >= 6 and max(sum(map(len, b.terms)) for b in held) <= 1 << 20 and max(b.ids.size for b in held) < 300_000
    docs = [(1, " ".join(word(n) for n in range(123_450, 123_470))), (2, " ".join(word(n) for n in range(999_980, 1_000_020))), (3, " ".join(word(n) for n in range(100, 112))), (4, None), (1, "other")]
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), frame, item_bytes=1 << 20).collect())
    assert got == [(1, 1, 0, []), (1, 20, 20, ["1000", "123"]), (2, 40, 20, ["999"]), (3, 12, 0, []), (4, 0, 0, [])]


def test_an_index_serves_other_questions(spark):
    from docfield.llm.phrases import build_index, index_matches, index_proximity

    rows = [(1, "a b x a b"), (1, "b y y y a"), (2, "a a a a"), (None, "a b"), (3, None), (4, "")]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    near = lambda terms, distance: sorted(((r.doc_id or 0, r.n_places) for r in index_proximity(index, terms, distance).collect()))
    assert near(["a", "b"], 1) == [(0, 1), (1, 2)]  # b is the rarest
    assert near(["a", "b", "a"], 4) == [(0, 1), (1, 1), (1, 2)] and near(["a", "zz"], 9) == [] and near([], 9) == []
    assert near(["y"], 1) == [(1, 3)]
    for text, want in (("x a", {1: [[2, 4]]}), ("a a", {2: [[0, 4]]}), ("new", {})):
        found = index_matches(index, spark.createDataFrame([(1, text)], "item_id long, text string"), window=2).where("size(hits) > 0").collect()
        assert {r.doc_id: r.hits for r in found} == want
    assert index_matches(index, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    none = build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert index_proximity(none, ["a"], 3).count() == 0 and index_matches(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------


def test_messages_are_exact_on_trees():
    """Every labelling of small graphs without loops, counted out."""
    from itertools import product

    from docfield.llm.pii import Graph, messages

    g = np.random.default_rng(3)
    for case in range(30):
        n, labels = int(g.integers(1, 5)), 3
        unary = np.log(g.random((n, labels))).astype(np.float32)
        linked = np.array([k for k in range(1, n) if case % 3 == 0 and g.random() < 0.8], np.int32)  # chains alone, or hidden nodes alone
        hub = np.zeros(0, np.int32) if case % 3 == 0 or n < 2 else np.zeros(n, np.int32)
        member = np.arange(hub.size, dtype=np.int32)
        tables = [np.exp(x + x.T).astype(np.float32) for x in g.normal(size=(2, labels, labels))]
        graph = Graph(np.zeros(n, np.int32), linked, member, hub)
        total = np.zeros((n + graph.hubs, labels))
        for y in product(range(labels), repeat=n + graph.hubs):
            p = np.exp(sum(float(unary[k, y[k]]) for k in range(n)))
            for a, b in zip(*graph.edges()[0], strict=True):
                p *= tables[0][y[a], y[b]]
            for a, b in zip(*graph.edges()[1], strict=True):
                p *= tables[1][y[a], y[b]]
            for k, x in enumerate(y):
                total[k, x] += p
        total /= total.sum(1, keepdims=True)
        assert np.abs(np.exp(messages(unary, graph, tables)) - total).max() < 5e-3


def test_messages_on_loops_are_near_and_settle():
    from itertools import product

    from docfield.llm.pii import LABELS, SkipChainField, Tokens, base_spans, field, messages

    f, text = field(), "call (338) 555-7198 or 555-7198 then 338-555-7198 now"
    tokens = Tokens()
    tokens.add(0, text, base_spans(text))
    unary, graph = f.unary(tokens), tokens.graph()
    tables = [np.exp(p) for p in f.potentials]
    n = len(tokens)
    total = np.zeros((n, len(LABELS)))
    for y in product(range(len(LABELS)), repeat=n):
        p = np.exp(sum(float(unary[k, y[k]]) for k in range(n)))
        for a, b in zip(*graph.edges()[0], strict=True):
            p *= tables[0][y[a], y[b]]
        for h in range(graph.hubs):  # hidden nodes summed out
            p *= sum(np.prod([tables[1][y[m], z] for m in graph.member[graph.hub == h]]) for z in range(len(LABELS))) / len(LABELS)
        for k, x in enumerate(y):
            total[k, x] += p
    total /= total.sum(1, keepdims=True)
    got = f.marginals(tokens)
    assert (got.argmax(1) == total.argmax(1)).all() and np.abs(got - total).max() < 0.1
    assert isinstance(f, SkipChainField) and np.isfinite(messages(unary, graph, [t.astype(np.float32) for t in tables])).all()


def test_a_documents_spans_do_not_depend_on_its_batch():
    from docfield.llm import pii

    texts = [t for t, _ in pii.labelled(120, 77)]
    alone = [pii.found_spans([t])[0] for t in texts]
    assert pii.found_spans(texts) == alone
    far = "call +1 (338) 555-7198 now " + "and 12 or 345 then " * 400 + "ask 555-7198"
    base, every = pii.found_spans([far])[0]
    assert len(base) == 1 and every[-1] == ("phone", len(far) - 8, len(far))


def test_added_spans_on_labelled_samples():
    from docfield.llm import pii

    docs, right, added, wanted, met = list(pii.labelled(2_000, 4_242)), 0, 0, 0, 0
    for (_, marks), (base, every) in zip(docs, pii.found_spans([t for t, _ in docs]), strict=True):
        more = [x for x in every if x not in base]
        gold = [(pii.LABELS[y], a, b) for a, b, y in marks if y]
        free = [g for g in gold if not any(a < g[2] and b > g[1] for _, a, b in base)]
        touch = lambda x, g: x[0] == g[0] and x[1] < g[2] and x[2] > g[1]
        added, right = added + len(more), right + sum(any(touch(x, g) for g in gold) for x in more)
        wanted, met = wanted + len(free), met + sum(any(touch(x, g) for x in more) for g in free)
    assert right / added >= 0.96 and met / wanted >= 0.87, (right / added, met / wanted)


def test_pii_digests_are_those_of_the_spans(spark):
    from docfield.llm.pii import found_spans, joined, ordered, pii_spans
    from tests.llm.test_operators import ODD

    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in pii_spans(rows).collect():
        base, every = found_spans([texts[r.doc_id]])[0]
        assert r.base_sha256 == hashlib.sha256(joined(ordered(base)).encode()).hexdigest() and r.spans == joined(every)


def test_memory_on_a_long_text_of_numbers():
    """8 MB of numbers in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from docfield.llm import pii
r = random.Random(2)
text = " ".join(str(r.randrange(10**7)) for _ in range(1 << 20))
assert pii.found_spans([text])[0][0] == []
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 1000


# --- 4 and 7 ------------------------------------------------------------------------------------------


def test_ftrl_steps_are_the_formulas():
    from docfield.llm.toxicity import BITS, FTRL

    model, g = FTRL(0.5, 1.0, 0.3, 0.2), np.random.default_rng(2)
    z, n, bias = {}, {}, 1 << BITS

    def weight(i):
        if i != bias and abs(z.get(i, 0.0)) <= 0.3:
            return 0.0
        l1 = 0.0 if i == bias else 0.3
        return -(z.get(i, 0.0) - math.copysign(l1, z.get(i, 0.0))) / ((1.0 + math.sqrt(n.get(i, 0.0))) / 0.5 + 0.2)

    for step in range(400):
        at, y, heavy = np.sort(g.choice(12, g.integers(0, 6), replace=False)), int(g.random() < 0.4), 3.0 if step % 2 else 1.0
        row = [*at.tolist(), bias]
        w = {i: weight(i) for i in row}
        p = 1 / (1 + math.exp(-sum(w.values())))
        assert abs(model.learn(np.array(row), y, heavy) - p) < 1e-9
        for i in row:
            d = heavy * (p - y)
            sigma = (math.sqrt(n.get(i, 0.0) + d * d) - math.sqrt(n.get(i, 0.0))) / 0.5
            z[i], n[i] = z.get(i, 0.0) + d - sigma * w[i], n.get(i, 0.0) + d * d
    assert np.abs(model.all_weights()[[*range(12), bias]] - [weight(i) for i in [*range(12), bias]]).max() < 1e-9


def test_scorer_adds_the_weights_of_all_features():
    from docfield.llm.toxicity import Scorer, places, train, word_places

    r = random.Random(5)
    say = lambda bad: " ".join([r.choice(["the", "of", "tree", "house", "grünes", "été"]) for _ in range(12)] + (["scum", "idiots"] if bad else [])).encode()
    sample = [(say(k % 3 == 0), int(k % 3 == 0)) for k in range(300)]
    at, w, bias = train(sample)
    table = dict(zip(at.tolist(), w.tolist(), strict=True))
    scorer = Scorer(at, w, bias)
    for text in [t for t, _ in sample[:40]] + [b"", b"nothing known", "éÉ".encode(), b"\xff"]:
        z = bias + sum(table.get(p, 0.0) for p in places(text).tolist())
        assert abs(scorer.score(text) - 1 / (1 + math.exp(-z))) < 1e-9
    assert scorer.score(b"you scum idiots") > 0.5 > scorer.score(b"the tree of the house")
    assert len(word_places("ééé".encode())) == 1 and len(word_places("éééé".encode())) == 2  # cut at characters


def test_log_count_ratio_and_dual_descent():
    from docfield.llm.quality import dual_descent, log_count_ratio

    g = np.random.default_rng(1)
    rows = [np.sort(g.choice(40, 6, replace=False)) + (3 if k % 2 else 0) for k in range(60)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(60)])
    ratio, size = log_count_ratio(rows, y), 1 << 20
    count = lambda place, sign: 1 + sum(place in r for r, s in zip(rows, y, strict=True) if s == sign)
    total = {s: size + sum(len(r) for r, t in zip(rows, y, strict=True) if t == s) for s in (1.0, -1.0)}
    for place in (0, 2, 20, 42, 99):
        assert abs(ratio[place] - math.log(count(place, 1.0) / total[1.0] / (count(place, -1.0) / total[-1.0]))) < 1e-9
    values = [ratio[r] / np.linalg.norm(ratio[r]) for r in rows]
    w, bias = dual_descent(rows, values, y, epochs=400)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, y, strict=True))
    best = loss(w, bias)
    for _ in range(60):  # a minimum: no step to a side is better
        step = np.zeros_like(w)
        step[:43] = g.normal(size=43) * 10 ** g.uniform(-4, 0)
        assert loss(w + step, bias + g.normal() * 0.01) >= best - 1e-3


def test_training_samples_are_bounded(spark):
    from docfield.llm.features import label_sample

    docs = spark.createDataFrame([(k % 20, f"text {k}" * 10) for k in range(200)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, 0), (2, None), (99, 1)], "doc_id long, toxic int")
    held = F.col("doc_id") == 4
    rows = label_sample(docs, labels, "toxic", held, 50)
    assert len(rows) == 19 and sum(y for _, y in rows) == 10 and sorted(rows) == sorted(label_sample(docs.repartition(5), labels, "toxic", held, 50))
    assert len(label_sample(docs, labels, "toxic", held, 4)) in (7, 8)  # id 99 has no text
    assert len(label_sample(docs, labels, "toxic", held, 50, sample_bytes=400)) < 10


# --- 6 ------------------------------------------------------------------------------------------------


def test_distances_and_verdicts_are_the_definitions(spark):
    from docfield.llm import divergence as d

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = d.quality_report(docs).collect()

    def entropy_distance(p, q):
        p, q = np.asarray(p, float), np.asarray(q, float)
        if not p.sum() or not q.sum():
            return 0.0 if p.sum() == q.sum() else 1.0
        p, q = p / p.sum(), q / q.sum()
        h = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
        return math.sqrt(max(0.0, h((p + q) / 2) - (h(p) + h(q)) / 2))

    g = np.random.default_rng(8)
    for _ in range(300):
        p, q = g.integers(0, 4, 9), g.integers(0, 4, 9)
        if p.sum() and q.sum():
            assert abs(d.distance(p, q) - entropy_distance(p, q)) < 1e-6
    refs, texts = d.references(docs), {r.doc_id: r for r in docs.collect()}
    members = {"vowel": "aeiou", "consonant": "bcdfghjklmnpqrstvwxyz", "capital": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\x0b\x0c\r", "line break": "\n", "stop": ".,;:!?'\"()-", "symbol": "#*$%&|<>@[]{}\\/^_~`+="}
    kind = {c: k for k, cs in members.items() for c in cs}
    for r in out:
        t = texts[r.doc_id].text or ""
        classes = [kind.get(c, "other letter" if c > "\x7f" else "other") for c in t]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(" " if c in ".,;:!?\"()" else c.lower() if "A" <= c <= "Z" else c for c in t)) if w]
        held = [refs[texts[r.doc_id].lang]] if texts[r.doc_id].lang in refs else list(refs.values())
        by_class = by_word = 0.0
        if len(t.encode()) >= d.MIN_CHARS:
            if len(classes) >= d.MIN_CHARS:
                by_class = min(entropy_distance([classes.count(k) for k in d.CLASSES], x[0]) for x in held)
            if len(words) >= d.MIN_WORDS:
                by_word = min(entropy_distance([words.count(w) for w in d.EVERY] + [sum(w not in d.EVERY for w in words)], x[1]) for x in held)
        assert abs(r.class_distance - by_class) < 1e-6 and abs(r.word_distance - by_word) < 1e-6, r.doc_id
        assert r.kept == (not r.base_failed and r.class_distance <= d.MAX_CLASS_DISTANCE and r.word_distance <= d.MAX_WORD_DISTANCE)


# --- 2, 9 and the pipeline ----------------------------------------------------------------------------


def test_digests_of_pieces(spark):
    import sentencepiece

    from docfield.llm.pieces import encode_digests
    from tests.llm.test_operators import ODD

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in encode_digests(rows, path).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_fingerprints_as_text(spark):
    import xxhash

    from docfield.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_simhash"](spark, SF).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id]))
        hashes = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 3))] if w else []
        assert r.fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_pipeline_rows_are_those_of_naive_stages(spark):
    import sentencepiece

    import corpus_pipeline as c
    from docfield.llm import divergence
    from docfield.llm.pii import found_spans, mask
    from docfield.llm.simhash import fingerprint
    from tests.llm.test_operators import brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in divergence.quality_report(docs).collect() if r.kept}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in kept}
    ids = sorted(rows)
    prints = [fingerprint(rows[i].encode()) for i in ids]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    rows = {i: rows[i] for i in ids if find(i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = dict(zip(rows, brute_hits(list(rows.values()), items), strict=True))
    rows = {i: t for i, t in rows.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    rows = {i: mask(t, found_spans([t])[0][1]) for i, t in rows.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t) for i, t in rows.items()}
    got = c.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want) and all(r.n_tokens == len(r.ids) for r in got)


def test_equal_ids_and_texts_keep_a_defined_row(spark):
    from docfield.llm.simhash import drop_near_duplicates

    rows = [(1, "one two three four five", "b", 2), (1, "one two three four five", "a", 9), (1, "one two three four five", "a", 3), (2, "quite another text stands here", None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    for parts in (1, 3):
        assert sorted((r.doc_id, r.source, r.n) for r in drop_near_duplicates(frame.repartition(parts)).collect()) == [(1, "a", 3), (2, None, 0)]


def test_loss_mask_of_many_turns(spark):
    from docfield.llm.chat import format_conversations

    turns = [(1, k, "assistant" if k % 2 else "user", f"say </s> {k}") for k in range(40_000)]
    began = time.time()
    r = format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert len(r.loss_mask) == 20_000 and [r.formatted[m.start : m.end] for m in r.loss_mask[:2] + r.loss_mask[-1:]] == ["say <\\/s> 1", "say <\\/s> 3", "say <\\/s> 39999"]
    assert time.time() - began < 120


def test_stored_folders_can_be_released(spark):
    from docfield.llm import common

    first = len(common.MADE)
    a, b = (common.stored(spark.range(3), name) for name in "ab")
    common.release(spark, first, keep=1)
    assert len(common.MADE) == first + 1 and b.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        a.count()
    common.release(spark, first)
