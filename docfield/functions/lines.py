"""Scalar expressions over lines of text: cleaning, classification, tokens. All are native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What page furniture looks like (anchored at the start of the lower-cased line).
FURNITURE_PATTERNS = (
    "^document ref:", r"^page \d+ of \d+$", "^consultant initials", "^company initials", "^signed with pandadoc", r"^ref\. number",
    "^signer timestamp", "^recipient verification", "^email viewed$", "^email verified$", "^ip address$", "^utc$", "^sent$", "^signed$",
)
FURNITURE_LINES = ("confidential", "v 12.29.16", "[signature]", "[authorized signatory]")
# Signals of a signature audit page.
AUDIT_SIGNALS = (
    "document completed by all parties", "signer timestamp signature", "recipient verification", "signed with pandadoc",
    "email viewed", "email verified", "ip address",
)
# Words and signs of a content line.
CONTENT_WORDS = ("company", "consultant", "agreement", "party", "parties", "date", "name", "title")
CONTENT_SIGNS = ("(", ")", "“", "”", ":", ",")
# Stopwords of query terms.
STOPWORDS = (
    "what", "is", "the", "a", "an", "of", "for", "to", "in", "on", "at", "by", "who", "when", "where", "does", "do", "did", "was",
    "were", "are", "and", "or", "this", "that", "these", "those", "all", "list", "agreement", "document", "contract", "clause", "term",
)
CLAUSE = r"^\d+(\.\s*|(\.\d+)+\s*)[A-Z]"
SUBCLAUSE = r"^([a-zA-Z]\.|\([a-zA-Z0-9]+\))\s+"
LOOSE_CLAUSE = r"^(\d|[a-zA-Z][.)]\s+|\([a-zA-Z0-9]+\)\s+)"
HEADING = r"^[A-Z][A-Z0-9 ,&/\-\(\)]+:$"
MAX_REPEATED, MAX_HINT = 120, 120


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at the ends; looks at the ends alone."""
    return F.btrim(text, F.lit(WHITE))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside array functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replaced(text: Column, signs: tuple[str, ...], pattern: str, by: str) -> Column:
    """regexp_replace() for texts that hold one of the signs, without which the pattern can't match."""
    return let(text, lambda t: F.when(_any(t.contains(s) for s in signs), F.regexp_replace(t, pattern, by)).otherwise(t))


def _plain_spaces(text: Column) -> Column:
    return F.replace(text, F.lit("\u00a0"), F.lit(" "))


def line_feeds(text: Column) -> Column:
    return _replaced(text, ("\r",), r"\r\n?", "\n")


def inline(text: Column) -> Column:
    """All white space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_line(line: Column) -> Column:
    """No-break spaces as spaces, runs of two or more spaces or tabs as one space. A single tab stays."""
    return strip(_replaced(_plain_spaces(line), ("  ", "\t"), r"[ \t]{2,}", " "))


def clean_page_text(text: Column) -> Column:
    lines = F.array_join(F.transform(F.split(line_feeds(text), "\n"), clean_line), "\n")
    return strip(_replaced(lines, ("\n\n\n",), r"\n{3,}", "\n\n"))


def squeezed_line(line: Column) -> Column:
    """Every run of spaces and tabs as one space, a single tab too."""
    return strip(_replaced(line, ("  ", "\t"), r"[ \t]+", " "))


def clean_text(text: Column) -> Column:
    """A chunk's text: line feeds only, squeezed, two line breaks at most."""
    return strip(_replaced(_replaced(_plain_spaces(line_feeds(text)), ("  ", "\t"), r"[ \t]+", " "), ("\n\n\n",), r"\n{3,}", "\n\n"))


def word_count(text: Column) -> Column:
    plain = inline(text)
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def has_words(plain: Column, n: int) -> Column:
    """word_count() >= n of a stripped text, without cutting it up."""
    return plain.rlike(rf"(?U)^\S++(?:\s++\S++){{{n - 1}}}")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def is_furniture(line: Column) -> Column:
    low = F.lower(strip(line))
    # one anchor for all, so that only the start of a line is tried
    return low.rlike(f"^(?:{'|'.join(p.removeprefix('^') for p in FURNITURE_PATTERNS)})") | low.isin(*FURNITURE_LINES)


def is_audit(line: Column) -> Column:
    low = F.lower(line)
    return _any(low.contains(s) for s in AUDIT_SIGNALS)


def is_clause_start(line: Column) -> Column:
    return strip(line).rlike(CLAUSE)


def is_subclause(line: Column) -> Column:
    return strip(line).rlike(SUBCLAUSE)


def is_loose_clause_start(line: Column) -> Column:
    """Wider than is_clause_start: any line that begins with a digit, a lettered item, or short capitals."""
    plain = strip(line)
    return plain.rlike(LOOSE_CLAUSE) | (is_upper(plain) & ~has_words(plain, 15))


def is_content(line: Column) -> Column:
    plain = strip(line)
    return (
        _any(plain.contains(s) for s in CONTENT_SIGNS)
        | has_words(plain, 4)
        | plain.rlike(CLAUSE)
        | plain.rlike(r"^([a-zA-Z][.)]|\([a-zA-Z0-9]+\))\s+\S+")
        | (is_upper(plain) & ~has_words(plain, 13))
        | plain.rlike(r"(?i)\b(" + "|".join(CONTENT_WORDS) + r")\b")
    )


def is_heading(line: Column) -> Column:
    plain = strip(line)
    return (is_upper(plain) & ~has_words(plain, 13)) | plain.rlike(HEADING)


def section_hint(text: Column) -> Column:
    """The first line of a chunk (at most 120 characters), if it starts a clause or is a heading."""
    first = squeezed_line(F.substring_index(strip(text), "\n", 1))
    return let(first, lambda x: F.when((x != "") & (is_clause_start(x) | is_heading(x)), F.substring(x, 1, MAX_HINT)))


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Without the underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def long_terms(text: Column) -> Column:
    """Distinct index tokens of three characters or more."""
    return F.array_distinct(F.filter(index_tokens(text), lambda t: F.length(t) >= 3))


def query_terms(text: Column) -> Column:
    """Distinct plain tokens without stopwords and single characters."""
    return F.array_distinct(F.filter(plain_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)))
