"""The ten operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "Mixed CASE words here again", "x" * 30_000, "tab\tand\rreturn\x0bmore", "é ß 日本 𝄞 ▁ \x00", "same words here now " * 400, "call +1 (338) 555-7198, mail a.b@c.de, ip 1.2.3.4"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, each twice, a null id, and columns whose names clash with those of the operators."""
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(i + 100, t, None, 0) for i, t in enumerate(ODD)] + [(None, "no id", "xx", 1), (5, ODD[5], "en", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int").selectExpr("*", "fp AS key", "fp AS n_words", "fp AS row", "fp AS h", "'q' AS score")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 ------------------------------------------------------------------------------------------------


def test_wavelet_matrix_answers():
    from docfield.llm.wavelet import WaveletMatrix

    r = random.Random(3)
    for n, bits in ((0, 5), (1, 1), (700, 4), (3000, 16), (64 * 8 * 3, 17)):
        tokens = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint16 if bits <= 16 else np.uint32)
        m = WaveletMatrix.from_bytes(WaveletMatrix.of(tokens, bits).to_bytes())
        assert (m.tokens() == tokens).all()
        for i in (r.randrange(n) for _ in range(60 if n else 0)):
            t = int(tokens[i])
            before = int((tokens[:i] == t).sum())
            assert (m.access(i), m.rank(t, i), m.count(t), m.select(t, before)) == (t, before, int((tokens == t).sum()), i)
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"nothing")


def test_wavelet_documents(spark, odd, empty):
    from tokenizers import Tokenizer

    from docfield.llm.wavelet import occurrences, read_documents, write_shards

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    stored = write_shards(odd, path, shard_tokens=500)
    got = sorted(read_documents(spark, stored).collect(), key=lambda r: r.start)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert occurrences(spark, stored, 2).agg(F.sum("n")).first()[0] == len(rows)
    assert read_documents(spark, write_shards(empty, path)).count() == 0


def test_tokenizer_words_are_the_librarys():
    from docfield.llm.wavelet import WordTokenizer

    w, r = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    parts = ["a", "'s", "'ll", "É", "é", "\u0301", " ", "\n", "\t", "\u2003", "\x1c", "\x85", "1", "٣", "!", "-", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|end", "OFTEXT|>", "\x00", "ß", "İ", "Σ", "日", "T", "."]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert list(w.encode([s], 2)[0][:-1]) == w.library.encode(s, add_special_tokens=False).ids, repr(s)
    together = ["plain words", "<|ENDOFTEXT|>", "x <|endoftext|> y", "É <|EndOfText|> 日", "more words"]
    assert [list(x[:-1]) for x in w.encode(together, 2)] == [w.library.encode(s, add_special_tokens=False).ids for s in together]


# --- 2 ------------------------------------------------------------------------------------------------


def test_pieces_are_the_librarys(spark, odd, empty):
    import sentencepiece

    from docfield.llm.pieces import encode_digests, encode_documents, model

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, m, r = sentencepiece.SentencePieceProcessor(model_file=path), model(path), random.Random(1)
    pieces = list(m.ids)
    for n in range(4000):
        s = "".join(r.choice("aehtinorsT .\n▁  éß") for _ in range(r.randint(0, 30))) if n % 3 == 0 else "".join(r.choice(pieces) for _ in range(r.randint(1, 6))) if n % 3 == 1 else " " * r.randint(0, 60) + r.choice(["", "x", "\n", "é", "日本", "\x01𝄞"]) + " " * r.randint(0, 20)
        ids = m.encode(s)
        assert ids == library.encode(s), repr(s)
        assert m.decode(ids) == library.decode(ids)
        strange = [r.randrange(0, 600) for _ in range(6)]
        assert m.decode(strange) == library.decode(strange)
    for g in encode_digests(odd, path).collect():
        assert len(g.ids_sha256) == 64
    by = {(g.doc_id): g for g in encode_documents(odd, path).where("doc_id < 50").collect()}
    for i, t in enumerate(ODD):
        assert list(by[i].ids) == library.encode(t or "") and by[i].decoded == library.decode(library.encode(t or ""))
    assert encode_documents(empty, path).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------


def test_pii_base_is_the_patterns():
    from docfield.llm.pii import base_spans, luhn, ordered

    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]

    r = random.Random(5)
    parts = ["a@b.c", "@", "a", "1", "123", ".", " ", "-", "+", "(", ")", "+1 ", "4111111111111111", "x.y", "255", "256", "%", "٣", "é"]
    for _ in range(20_000):
        s = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert ordered(base_spans(s)) == ordered(brute(s)), repr(s)


def test_pii_field_and_masks(spark, odd, empty):
    from docfield.llm.pii import found_spans, mask_documents, pii_spans

    base, every = found_spans(["call +1 (338) 555-7198 now, later (338) 555-7198 or 555-7198"])[0]
    assert base == [("phone", 5, 22)] and set(base) < set(every)
    assert found_spans(["in 2024 v3.0 costs 500, order 123456789012 and 1234567812345678"])[0] == ([], [])
    got = {r.doc_id: r for r in pii_spans(odd).collect()}
    assert (got[10].n_phone, got[10].n_email, got[10].n_ip) == (1, 1, 1) and got[0].spans == ""
    masked = mask_documents(odd)
    assert masked.columns == odd.columns
    assert masked.where("doc_id = 10").first().text == "call <PHONE>, mail <EMAIL>, ip <IP>"
    assert masked.where("doc_id = 0").first().text is None and pii_spans(empty).count() == 0


# --- 4 and 7 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,label,least", [("op4_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    from docfield.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = {k: np.mean([r.predicted == k for r in rows if r.y == k]) for k in (0, 1)}
    assert min(right.values()) >= least, right


def test_classifiers_on_odd_rows(spark, odd, empty):
    from docfield.llm import quality, toxicity

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        assert {r.score for r in module.classify(odd, none).collect()} == {0.5}
        out = module.classify(odd, few).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert module.classify(empty, few).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------


def brute_hits(texts, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in items:
        w = word.findall(lower(text or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).update([] if item is None else [str(item)])
    sizes, out = {len(w) for w in windows}, []
    for text in texts:
        w, hit, named = word.findall(lower(text or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_decontamination(spark, odd, item_bytes):
    from docfield.llm.phrases import contamination, digests, drop_contaminated

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "words here"), (901, None), (None, "again"), (902, "?!"), (900, "words here")], "item_id long, text string"))
    want = sorted((str(r.doc_id), *h) for r, h in zip(docs.collect(), brute_hits([r.text for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]), strict=True))
    found = contamination(docs, items, item_bytes=item_bytes)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found.collect()) == want
    if item_bytes > 1000:
        kept = drop_contaminated(docs, items)
        assert kept.count() == sum(not (h and 20 * h >= n) for _, n, h, _ in want) and kept.columns == docs.columns
        assert digests(docs.where("1 = 0"), items).count() == 0 and contamination(docs, items.where("1 = 0")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    from docfield.llm.phrases import proximity

    rows = spark.createDataFrame([(1, "one two three four five"), (2, "one x x x x x x five"), (3, "five"), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_places) for r in proximity(rows, ["one", "five"], 4).collect()] == [(1, 1)]
    assert proximity(rows, [], 4).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------


def test_quality_counts(spark, odd, empty, docs):
    from docfield.llm.divergence import distance, keep_good, quality_report

    texts = {r.doc_id: r.text or "" for r in docs.collect()} | {i + 100_000: t or "" for i, t in enumerate(ODD)}
    rows = docs.select("doc_id", "text", "lang").union(odd.where("doc_id >= 100").selectExpr("doc_id + 99900", "text", "lang"))
    for r in quality_report(rows).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {k + i for at in seen.values() if len(at) > 1 for k in at for i in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert keep_good(rows).count() == quality_report(rows).where("kept").count()
    assert keep_good(odd).columns == odd.columns and quality_report(empty).count() == 0
    assert distance(np.array([1, 0]), np.array([0, 1])) == 1 and distance(np.array([2, 2]), np.array([1, 1])) == 0


def prose(docs, lang):
    """Rows of docs that are prose of a language: many words, no symbols."""
    return [r for r in docs.where(F.col("lang") == lang).orderBy("doc_id").collect() if len(set(r.text.split())) > 250 and not set(r.text) & set("#*$%&|<>")]


def test_word_distance_rejects(spark, docs):
    from docfield.llm.divergence import COMMON_WORDS, quality_report

    common = {w for words in COMMON_WORDS.values() for w in words.split()}
    en, de = prose(docs, "en")[:5], prose(docs, "de")[:5]
    salad = [(200_000 + k, " ".join(w for w in r.text.split() if w.lower().strip(".,;:!?\"()") not in common), "en") for k, r in enumerate(en)]
    wrong = [(200_100 + k, r.text, "en") for k, r in enumerate(de)] + [(200_200 + k, r.text, "de") for k, r in enumerate(en)]
    rows = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(salad + wrong, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality_report(rows).collect()}
    for i, *_ in salad + wrong:
        assert not got[i].base_failed and got[i].class_distance < 0.2 and not got[i].kept, got[i]
    assert all(got[r.doc_id].kept for r in en + de if not got[r.doc_id].base_failed)


def test_one_source_moves_no_reference(spark, docs):
    from docfield.llm.divergence import quality_report

    rows = docs.select("doc_id", "text", "lang", "source")
    en = prose(docs, "en")
    marked = lambda text, k: " ".join(w + "#$%&"[i % 4] * 3 if (i + k) % 2 else w for i, w in enumerate(text.split()))
    capital = lambda text, k: " ".join(w.upper() if (i + k) % 5 else w for i, w in enumerate(text.split()))
    third = rows.where("lang = 'en'").count() // 2
    before = {r.doc_id: r for r in quality_report(rows).collect()}
    for junk, sources in ((marked, ["hot"]), (marked, [f"src{k}" for k in range(20)]), (capital, ["hot"])):
        more = [(300_000 + k, junk(en[k % len(en)].text, k), "en", sources[k % len(sources)]) for k in range(third)]
        got = {r.doc_id: r for r in quality_report(rows.union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))).collect()}
        assert not any(got[i].kept for i, *_ in more)
        assert [i for i in before if got[i].kept != before[i].kept] == []


def test_tables_are_rejected(spark, docs):
    from docfield.llm.divergence import quality_report

    en = prose(docs, "en")[:10]
    tables = [(400_000 + k, "\n".join(" | ".join(r.text.split()[i : i + 8]) for i in range(0, len(r.text.split()), 8)), "en", "src1") for k, r in enumerate(en)]
    rows = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(tables, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in quality_report(rows).collect()}
    assert not any(got[i].kept for i, *_ in tables)
    assert all(got[r.doc_id].kept for r in en if not got[r.doc_id].base_failed)


# --- 8 ------------------------------------------------------------------------------------------------


def test_secrets(spark, odd, empty):
    from docfield.llm.secrets import digests

    key = "".join(f"[{c}{c.upper()}]" for c in "password")
    assign = re.compile(f"({key}|(?i:passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)

    def brute(t):
        out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))

    r = random.Random(2)
    parts = ["token", "Secret", "=", ":", " ", '"', "abcdef012345", "0123456789abcdef", "AKIA", "ABCDEFGHIJ1234", "é", "日", "\n", "password", "API_KEY", "x.y/z==", "zz9Q", "passwd: "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ODD + ["key Xq7Zk2Wv9Lp4Rt8Yb3Nd6 and get_user_account_name_2024"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in digests(rows).collect()}
    for i, t in enumerate(texts):
        assert out[i].base_sha256 == hashlib.sha256(brute(t or "").encode()).hexdigest(), repr(t)
    assert out[len(texts) - 1].spans == "markov:4:25"
    assert digests(odd).count() == odd.count() and digests(empty).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_simhash_classes(spark, odd, docs, bucket):
    import xxhash

    from docfield.llm.simhash import classes

    def fingerprint(text):
        w = WORD.findall(lower(text or ""))
        hashes = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = docs.select("doc_id", "text").union(odd.where("doc_id >= 100").selectExpr("doc_id + 900", "text"))
    near = [(5000 + i, " ".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa"] * 40 + [f"tail{i}"])) for i in range(40)]
    rows = rows.union(spark.createDataFrame(near, "doc_id long, text string"))
    all_rows = rows.collect()
    ids, fps = [r.doc_id for r in all_rows], np.array([fingerprint(r.text) for r in all_rows], np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = sorted((root(i), root(int(j))), key=lambda k: ids[k])
            parent[b] = a
    got = {r.doc_id: r for r in classes(rows, bucket=bucket).collect()}
    for i, d in enumerate(ids):
        assert got[d].fp % (1 << 64) == int(fps[i]) and got[d].component_id == ids[root(i)]


def test_simhash_keeps_one_of_each(spark, odd, empty):
    from docfield.llm.simhash import drop_near_duplicates

    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert all(i < 100 for i in ids) and len(ids) == len(set(ids)) and ids[0] == 0 and 1 not in ids
    assert kept.where("doc_id IS NULL").count() == 1 and drop_near_duplicates(empty).count() == 0


def test_components(spark):
    from docfield.llm.components import components

    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 61)} == {0} and {got[k] for k in range(101, 140)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    from docfield.llm.chat import format_conversations, parsed

    r = random.Random(4)
    parts = ["<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>", "[ROLE x] ", " [/ROLE]", "\\", "<", "[", "a", "\n", "]", "s>", "/", "é", "%5D", "#1\n", " "]
    say = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "a]b%", "", None]), r.choice([None, say(), say()])) for c in range(600) for t in range(r.randint(0, 4))]
    rows += [(None, 0, "user", "x"), (700, None, "user", "b"), (700, None, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = format_conversations(frame).withColumn("back", parsed(F.col("formatted"))).collect()
    source = {}
    for c, t, role, text in rows:
        source.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    for o in out:
        assert [(b.role, b.text) for b in o.back] == [x[1:] for x in sorted(source[o.conv_id])]
        assert len(o.loss_mask) == sum(x[1] == "assistant" for x in source[o.conv_id])
    assert len(out) == len(source) and {o.formatted[:2] for o in out} == {"#0", "#1"}
    assert format_conversations(frame.where("1 = 0")).count() == 0


@pytest.mark.parametrize("name", ["op5_decontaminate", "op10_chat"])
def test_queries_are_their_sql(spark, name):
    from docfield.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import differences

    assert differences(spark, QUERIES[name], ORACLE_SQL[name], SF) == []


# --- the pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = docs
    for name, stage in c.STAGES:
        after = stage(spark, before, "/root/testdata/sf0.01").cache()
        if name == "sentencepiece":
            assert set(after.columns) >= {"doc_id", "ids"} and after.count() == before.count()
        else:
            assert after.columns == docs.columns and 0 < after.count() <= before.count()
        stage(spark, odd, SF).collect()
        assert stage(spark, empty, SF).count() == 0
        before = after
    assert {n for n, _ in c.STAGES} and c.run(spark, SF).count() > 0
