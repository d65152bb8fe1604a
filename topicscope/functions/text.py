"""Column expressions for text: tokens, stop words, n-grams, lengths.

All built-in functions / higher-order functions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
WORD = r"\p{L}+"                                   # letters only: drops digits and punctuation
IMPORT_TOKEN = r"[\p{L}\p{N}_]+|[\p{P}]+ "         # words, or a punctuation run followed by a space
DIGIT = r"\p{Nd}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text, pattern: str = WORD) -> Column:
    """Lower-case, then keep maximal runs of letters (punctuation/numbers removed)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), 0)


def import_tokens(text) -> Column:
    return tokens(text, IMPORT_TOKEN)


def drop_words(toks, words) -> Column:
    """Remove every token found in ``words`` (IN-list -> hash set lookup)."""
    words = list(words)
    if not words:
        return _c(toks)
    return F.filter(_c(toks), lambda x: ~x.isin(words))


def min_length(toks, n: int) -> Column:
    return F.filter(_c(toks), lambda x: F.length(x) >= n) if n > 1 else _c(toks)


def ngrams(toks, lo: int = 1, hi: int = 1, sep: str = "_") -> Column:
    """All n-grams for n in [lo, hi] joined by ``sep``, in text order per n.

    ``sequence(1, 0)`` counts down in Spark, so short token lists are guarded.
    """
    toks = _c(toks)
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(toks)
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), _gram_at(toks, n, sep))
        parts.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _gram_at(toks: Column, n: int, sep: str):
    # one-argument lambda: transform() would pass (element, index) to a two-argument one
    return lambda i: F.array_join(F.slice(toks, i, n), sep)


def strip_digits(text) -> Column:
    return F.regexp_replace(_c(text), DIGIT, "")


def remove_word(text, word: str) -> Column:
    """Delete whole-word occurrences of ``word`` (case-sensitive, quoted literally)."""
    return F.regexp_replace(_c(text), F.lit(r"\b\Q" + word + r"\E\b"), F.lit(""))


def doc_length(text) -> Column:
    """Number of pieces when splitting on whitespace runs; a leading blank yields
    one empty piece, trailing blanks none, the empty text zero pieces."""
    t = _c(text)
    trimmed = F.regexp_replace(t, r"\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))
