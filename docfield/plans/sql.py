"""SQL counterparts of the scalar expressions, for the comparison queries (RE2 patterns, so no look-around)."""

from __future__ import annotations

from docfield.functions import features as ff
from docfield.functions import lines as fl


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def inline(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def clean_line(x: str) -> str:
    return strip(rf"regexp_replace(replace({x}, chr(160), ' '), '[ \t]{{2,}}', ' ', 'g')")


def squeezed(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[ \t]+', ' ', 'g')")


def clean_text(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def words(x: str) -> str:
    return f"CASE WHEN {inline(x)} = '' THEN 0 ELSE len(string_split({inline(x)}, ' ')) END"


def upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def any_of(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def furniture(x: str) -> str:
    return f"(regexp_matches(lower({strip(x)}), '{'|'.join(fl.FURNITURE_PATTERNS)}') OR lower({strip(x)}) IN ({', '.join(repr(s) for s in fl.FURNITURE_LINES)}))"


def audit(x: str) -> str:
    return any_of(f"lower({x})", fl.AUDIT_SIGNALS)


def clause(x: str) -> str:
    return f"regexp_matches({strip(x)}, '{fl.CLAUSE}')"


def subclause(x: str) -> str:
    return f"regexp_matches({strip(x)}, '{fl.SUBCLAUSE}')"


def loose(x: str) -> str:
    return f"(regexp_matches({strip(x)}, '{fl.LOOSE_CLAUSE}') OR ({upper(strip(x))} AND {words(x)} <= 14))"


def content(x: str) -> str:
    s = strip(x)
    return rf"({clause(x)} OR regexp_matches({s}, '^([a-zA-Z][.)]|\([a-zA-Z0-9]+\))\s+\S+') OR {words(x)} >= 4 OR {any_of(s, fl.CONTENT_SIGNS)} OR regexp_matches({s}, '(?i)\b({'|'.join(fl.CONTENT_WORDS)})\b') OR ({upper(s)} AND {words(x)} BETWEEN 1 AND 12))"


def heading(x: str) -> str:
    s = strip(x)
    return f"(({upper(s)} AND {words(x)} BETWEEN 1 AND 12) OR regexp_matches({s}, '{fl.HEADING}'))"


def hint(x: str) -> str:
    first = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {squeezed('l')}), lambda l: l <> '')[1]"
    return f"CASE WHEN {clause(first)} OR {heading(first)} THEN substring({first}, 1, {fl.MAX_HINT}) END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_]+')"


def plain_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def long_terms(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) >= 3))"


def query_terms(x: str) -> str:
    return f"list_distinct(list_filter({plain_tokens(x)}, lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(s) for s in fl.STOPWORDS)})))"


def share(terms: str, other: str) -> str:
    return f"CASE WHEN len({terms}) > 0 THEN len(list_intersect({terms}, list_distinct({other}))) / len({terms})::DOUBLE ELSE 0.0 END"


def overlap(q: str, t: str) -> str:
    return share(long_terms(q), tokens(t))


def hint_overlap(q: str, h: str) -> str:
    return f"CASE WHEN coalesce({h}, '') = '' THEN 0.0 ELSE {share(long_terms(q), tokens(h))} END"


def phrase(q: str, t: str) -> str:
    low, terms = f"lower({strip(q)})", f"list_filter({tokens(q)}, lambda x: length(x) >= 3)"
    part = f"len(list_filter({terms}, lambda y: list_contains({tokens(t)}, y))) / len({terms})::DOUBLE"
    return f"CASE WHEN {low} = '' OR {t} = '' THEN 0.0 WHEN contains(lower({t}), {low}) THEN 1.0 WHEN len({terms}) = 0 THEN 0.0 WHEN {part} >= 0.6 THEN {part} ELSE 0.0 END"


def party(q: str) -> str:
    return any_of(f"lower({q})", ff.PARTY)


def page(q: str, p: str) -> str:
    return f"CASE WHEN {party(q)} THEN CASE WHEN {p} = 1 THEN 1.0 ELSE 0.0 END WHEN {any_of(f'lower({q})', ff.FIRST_PAGE)} AND {p} = 1 THEN 0.6 ELSE 0.0 END"


def recital(q: str, t: str, p: str) -> str:
    n = "(" + " + ".join(f"contains(lower({t}), '{s}')::INT" for s in ff.RECITAL) + ")"
    return f"CASE WHEN {party(q)} AND {p} = 1 THEN CASE WHEN {n} >= 3 THEN 1.0 WHEN {n} = 2 THEN 0.5 ELSE 0.0 END ELSE 0.0 END"


def junk(t: str) -> str:
    return any_of(f"lower({t})", ff.JUNK)


def size_penalty(t: str) -> str:
    n = f"length({strip(t)})"
    return f"CASE WHEN {n} < 40 THEN 0.22 WHEN {n} < 80 THEN 0.12 WHEN {n} < 140 THEN 0.05 ELSE 0.0 END"


def label_boost(q: str, h: str, t: str) -> str:
    q, h, t = f"lower({q})", f"lower(coalesce({h}, ''))", f"lower({t})"
    either = lambda s: f"(contains({h}, '{s}') OR contains({t}, '{s}'))"
    parts = (
        (0.35, f"{any_of(q, ff.NON_COMPETE)} AND ({any_of(h, ff.NON_COMPETE)} OR {any_of(t, ff.NON_COMPETE)})"), (0.35, f"{any_of(q, ff.NON_DISPARAGEMENT)} AND {any_of(h, ff.NON_DISPARAGEMENT)}"),
        (0.30, f"{any_of(q, ff.LAW)} AND {either('applicable law')}"), (0.25, f"contains({q}, 'compensation') AND {either('compensation')}"), (0.12, f"contains({q}, 'consultant') AND {either('consultant')}"),
    )
    return "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for w, c in parts) + ")"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.?!;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def packed(x: str, n: int = 1800) -> str:
    """List of the packed sentences of x (already clean text)."""
    fold = f"list_reduce(list_transform({sentences(x)}, lambda s: [s]), lambda a, b: CASE WHEN length(a[-1]) + 1 + length(b[1]) <= {n} THEN list_append(a[1:len(a) - 1], a[-1] || ' ' || b[1]) ELSE list_append(a, b[1]) END)"
    hard = f"list_filter(list_transform(range(0, length({x}), {n}), lambda i: {strip(f'substring({x}, i + 1, {n})')}), lambda s: s <> '')"
    return f"CASE WHEN {x} = '' THEN [] WHEN length({x}) <= {n} THEN [{x}] WHEN len({sentences(x)}) <= 1 THEN {hard} ELSE list_transform({fold}, lambda s: {clean_text('s')}) END"
