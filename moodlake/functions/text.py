"""Text scalar functions (all JVM-side built-ins; no Python on the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodlake.functions.dictionaries import WHITESPACE_CHARS

# `$`-prefixed or bare run of 1-5 capitals followed by a word boundary as
# Python's `re` defines it for text (next character not a letter, digit or
# underscore: [\p{L}\p{N}_]) — Java's own Unicode \b differs on characters
# such as '²' and combining marks. There is no leading boundary: a longer word
# yields its last five letters. The quantifier is possessive: a shorter match
# at the same start can never be followed by a non-word character, so
# backtracking into it is wasted work.
CANDIDATE_PATTERN = r"\$?([A-Z]{1,5}+)(?![\p{L}\p{N}_])"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def post_text(title="title", body="body") -> Column:
    """title + ' ' + body with NULLs as '' (the space is always kept)."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(body), F.lit("")))


def text_hash(text) -> Column:
    """MD5 hex of the lower-cased text with every whitespace character removed
    (translate() with an empty replacement deletes the characters — a char
    map, much cheaper than a Unicode regex)."""
    return F.md5(F.translate(F.lower(_c(text)), WHITESPACE_CHARS, ""))


def candidate_symbols(text) -> Column:
    """All candidate tokens of upper(text), in text order, `$` stripped.
    NULL or empty text gives an empty array."""
    t = _c(text)
    return F.when(t.isNull() | (F.length(t) == 0), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(F.upper(t), F.lit(CANDIDATE_PATTERN), F.lit(1)))


def title_of(text) -> Column:
    """First line of a text."""
    return F.split_part(_c(text), F.lit("\n"), F.lit(1))


def body_of(text) -> Column:
    """Everything after the first line break ('' when there is none)."""
    t = _c(text)
    return F.substr(t, F.length(title_of(t)) + F.lit(2))
