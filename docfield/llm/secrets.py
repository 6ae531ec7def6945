"""Operator 8 (native): secrets by base patterns and by character Markov models.

Two first-order models over 54 character classes (each letter, any digit, any sign) are trained from
labelled samples: random strings (hex, base64 and such, cut from hashes) and ordinary identifiers (words
joined in the usual styles, with numbers). A token of MIN_LENGTH characters or more that holds a letter and
a digit, or a capital behind a small letter, is a secret if its mean log-likelihood ratio is above the
threshold of its length band: the highest of zero and the QUANTILE of held-out identifiers of that band.
Such spans (kind `markov`) are added where no base span touches. The time grows with n log n of a text's
matches and in proportion to its tokens' lengths.

DataFrame expressions only: matches are read off `regexp_extract_all`, and their places off the pieces
that `split` leaves between them. Offsets are code points, ends exclusive. Null and empty texts have none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfield.llm.common import once, running

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0_"
SIGNS = "+/_=-"
MIN_LENGTH, SAMPLES, QUANTILE, SMOOTH = 12, 20_000, 0.999, 0.5
#: Lengths at which a new threshold begins.
BANDS = (12, 16, 20, 28)

_KEY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of the class is maximal, so a minimal length drops the same runs as a later filter.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])|(?=[A-Z0-9+/_=-]*+[a-z][a-z0-9+/_=-]*+[A-Z]))[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH

#: Words of the identifier samples.
WORDS = (
    "access account action active add address admin agent alert all api app archive array asset async attribute audio author average background balance bank base batch billing block body book bottom box branch buffer build button cache call cancel card category center change channel char check child class clean clear client close cloud code collection color column command comment commit common company compare component config connect console contact container content context control copy core count country create current customer data database date debug default delete description detail device dialog direct disable display document domain download draft driver drop edit editor element email employee empty enable encoding end engine entry error event example execute export extension external factory feature field file filter final find first flag folder font footer form format frame function game general get global graph group handle handler hash header height help history home host icon id image import index info init input insert instance interface internal invoice is item job join key label language last layout length level library limit line link list load local location lock log login main manager map margin master max member memory menu message method min mobile mode model module month name network new next node note number object offset open option order output owner package page panel parent parse parser password path pattern payment phone plan player plugin point policy position post prefix previous price print process product profile project property provider public query queue random range rate read record region registry release remote remove render report request reset resource response result retry return role root route row rule run sample save scale schema score screen script search second section select send sequence server service session set shape share size sort source split stack start state status step storage store stream string style submit sum summary support sync system tab table tag target task template test text theme thread time title token tool top total track transfer tree trigger type unit update upload url user util valid value vector version video view volume web week widget width window word work wrap write year zone"
).split()


SPAN = "struct<start:long,k:int,end:long,kind:string>"


def matches(text: Column, pattern: str, when: Column, kind: str, secret_group: int = 0, least: int = 0, keep: bool = False) -> Column:
    """array<struct<start, k, end, kind>> of a pattern's matches, where `when` holds; k: the kind's number.

    Matches whose group has under `least` characters are dropped, without another try inside them. keep: with the
    matched text as `m`.
    """
    rex, k = F.lit(pattern), F.lit(KINDS.index(kind))
    found, pieces = F.regexp_extract_all(text, rex, F.lit(0)), F.split(text, pattern, -1)
    zero = F.lit(0).cast("long")

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        span = lambda end, m: F.struct((end - F.length(m)).alias("start"), k.alias("k"), end.alias("end"), F.lit(kind).alias("kind"), *([m.alias("m")] if keep else []))
        return F.zip_with(running(steps, lambda a, b: a + b, zero), found, span)

    out = once(found, spans)
    if least:
        secret = F.transform(F.regexp_extract_all(text, rex, F.lit(secret_group)), lambda s: F.length(s) >= least)
        out = F.transform(F.filter(F.arrays_zip(out.alias("span"), secret.alias("long")), lambda x: x["long"]), lambda x: x["span"])
    none = F.array().cast(f"array<{SPAN[:-1]},m:string>>" if keep else f"array<{SPAN}>")
    return F.when(when, out).otherwise(none)


def untouched(tokens: Column, base: Column) -> Column:
    """Of tokens (disjoint, by start) those that no base span touches.

    Both are put in one order by start, base spans first: a token is touched by an earlier span that ends behind its
    start, which the running maximum of ends shows, or by the next span in the order, if it starts before the token's end.
    """
    mark = lambda x, is_base, m: F.struct(x["start"].alias("start"), (F.lit(1) - is_base).alias("token"), x["end"].alias("end"), m.alias("m"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: mark(b, F.lit(1), F.lit(None).cast("string"))), F.transform(tokens, lambda t: mark(t, F.lit(0), t["m"]))))

    def free(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(F.lit(0).cast("long"))), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
        after = F.concat(F.slice(F.transform(both, lambda x: F.when(x["token"] == 0, x["start"])), F.lit(2), F.greatest(F.size(both) - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
        seen = F.arrays_zip(both.alias("x"), reach.alias("reach"), after.alias("after"))
        good = F.filter(seen, lambda s: (s["x"]["token"] == 1) & (s["reach"] <= s["x"]["start"]) & (s["after"].isNull() | (s["after"] >= s["x"]["end"])))
        return F.transform(good, lambda s: F.struct(s["x"]["start"].alias("start"), F.lit(KINDS.index("markov")).alias("k"), s["x"]["end"].alias("end"), F.lit("markov").alias("kind"), s["x"]["m"].alias("m")))

    return once(both, free)


def identifier_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """id (from `first`), secret (the label), token: n of each label, those under MIN_LENGTH left out."""
    ids = spark.range(first, first + n, 1, 1)
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30))
    digest = F.sha2(F.col("id").cast("string"), 256)
    encoded = F.base64(F.unhex(digest))
    size = (h(0) % 20 + MIN_LENGTH).cast("int")
    forms = [F.substring(digest, 1, 40), encoded, F.translate(encoded, "+/=", "xY"), F.upper(F.translate(encoded, "+/=", "3Z")), F.lower(F.translate(encoded, "+/=", "4q")), F.translate(encoded, "0123456789+/=", "kQzWxJvKyPmBd")]
    random = F.element_at(F.array(*[x.substr(F.lit(1), size) for x in forms]), (h(1) % len(forms) + 1).cast("int"))
    words = F.split(F.lit(" ".join(WORDS)), " ")
    word = lambda k: F.element_at(words, (h(k) % len(WORDS) + 1).cast("int"))
    number = lambda k: (h(k) % F.element_at(F.array(*[F.lit(x) for x in (10, 100, 3000, 1_000_000)]), (h(k + 50) % 4 + 1).cast("int"))).cast("string")
    snake = lambda sep: F.concat_ws(sep, word(2), word(3), word(4), number(5))
    camel = F.concat(word(2), F.initcap(word(3)), F.initcap(word(4)), number(5), F.initcap(word(6)))
    path = F.concat_ws("/", word(2), word(3), F.concat(F.lit("v"), number(5)), word(4), word(6))
    plain = [snake("_"), snake("-"), camel, path, F.upper(snake("_")), F.concat_ws("-", number(7), word(2), word(3), number(8), word(4)), F.concat(word(2), word(3), word(4), number(5)), F.concat(word(2), F.initcap(word(3)), F.initcap(word(4))), F.concat(F.initcap(word(2)), F.initcap(word(3)), F.upper(word(4)))]
    ordinary = F.element_at(F.array(*plain), (h(9) % len(plain) + 1).cast("int"))
    return ids.select("id", F.explode(F.array(F.struct(F.lit(1).alias("secret"), random.alias("token")), F.struct(F.lit(0).alias("secret"), ordinary.alias("token")))).alias("x")).select("id", "x.secret", "x.token").where(F.length("token") >= MIN_LENGTH)


def _classes(token: Column) -> Column:
    return F.translate(token, "123456789" + SIGNS, "0" * 9 + "_" * len(SIGNS))


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions, random over ordinary. Linear in its length."""
    n = len(ALPHABET)
    code = F.transform(F.split(_classes(token), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def mean(codes: Column) -> Column:
        steps = F.size(codes) - 1
        logs = F.zip_with(F.slice(codes, F.lit(1), steps), F.slice(codes, F.lit(2), steps), lambda a, b: F.get(table, a * n + b))
        return F.when(steps >= 1, F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / steps).otherwise(0.0)

    return once(code, mean)


def train(spark: SparkSession, samples: DataFrame | None = None) -> tuple[list[float], list[float]]:
    """The table of log ratios (54 x 54) and a threshold for each of BANDS. Every fifth id is held out for the thresholds."""
    samples = identifier_samples(spark) if samples is None else samples
    marks = _classes(F.col("token"))
    pairs = samples.where("id % 5 != 0").select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(marks, i, F.lit(2)))).alias("pair"))
    n = len(ALPHABET)
    counts = {0: [SMOOTH] * (n * n), 1: [SMOOTH] * (n * n)}
    for r in pairs.groupBy("secret", "pair").count().collect():  # at most 2 * 54 * 54 rows
        a, b = (ALPHABET.find(c) for c in r.pair)
        if a >= 0 and b >= 0:
            counts[r.secret][a * n + b] += r["count"]
    logs = {k: [math.log(c[i] / sum(c[i // n * n : i // n * n + n])) for i in range(n * n)] for k, c in counts.items()}
    table = [round(a - b, 6) for a, b in zip(logs[1], logs[0], strict=True)]
    held = samples.where("id % 5 = 0 AND secret = 0").select(band(F.length("token")).alias("band"), ratio(F.col("token"), table_column(table)).alias("r"))
    found = {r.band: r.q for r in held.groupBy("band").agg(F.percentile("r", F.lit(QUANTILE)).alias("q")).collect()}  # a row for each band
    return table, [max(0.0, found.get(k, 0.0)) for k in range(len(BANDS))]


def band(length: Column) -> Column:
    """Number of the band of a token's length."""
    return sum((F.when(length >= x, 1).otherwise(0) for x in BANDS[1:]), F.lit(0))


def table_column(table: list[float]) -> Column:
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")


def is_secret(token: Column, table: list[float], limits: list[float]) -> Column:
    return ratio(token, table_column(table)) > F.get(F.array(*map(F.lit, limits)), band(F.length(token)))


def secret_spans(docs: DataFrame, model: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """doc_id, base and added (arrays of spans: start, k, end, kind, by start and then kind) for each row of docs."""
    table, limits = model or train(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = matches(text, ASSIGN, text.rlike(_KEY), "assign", 2, 12)
    access = matches(text, ACCESS, text.contains("AKIA"), "access")
    hexes = matches(text, HEX, text.rlike("[0-9a-f]{16}"), "hex")
    tokens = matches(text, TOKEN, text.rlike(TOKEN), "markov", keep=True)
    found = rows.select("doc_id", F.array_sort(F.concat(assign, access, hexes)).alias("base"), tokens.alias("tokens"))
    chosen = F.filter(untouched(F.col("tokens"), F.col("base")), lambda t: is_secret(t["m"], table, limits))
    span = F.transform(chosen, lambda t: F.struct(*[t[c].alias(c) for c in ("start", "k", "end", "kind")]))
    return found.select("doc_id", "base", F.when(F.size("tokens") > 0, span).otherwise(F.array().cast(f"array<{SPAN}>")).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(docs).select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
