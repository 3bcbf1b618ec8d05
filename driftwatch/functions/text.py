"""Text normalisation, keyword and fingerprint columns (all built-in functions).

Patterns follow Unicode rules: ``(?U)`` makes Java's ``\\s``, ``\\d`` and
``\\b`` Unicode-aware and word characters are spelled out as letters, numbers
and underscore, so accented text keeps its letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords dropped from keyword lists.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up",
    "about", "into", "through", "during", "before", "after", "above", "below", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
)

# Parts of a page that change on every visit, removed in this order.
DYNAMIC_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}:\d{2}(?::\d{2})?",
    r"(?i)copyright\s+\d{4}",
    r"(?i)last\s+updated?:?\s*\d+",
    r"""session[_-]?id["']?\s*[:=]\s*["']?[\w\-]+""",
    r"""csrf[_-]?token["']?\s*[:=]\s*["']?[\w\-]+""",
    r"""nonce["']?\s*[:=]\s*["']?[\w\-]+""",
)

#: What every match of the patterns from the fifth on holds.
DYNAMIC_MARKS = ("session", "csrf", "nonce")

# Phrases that carry no meaning, blanked in this order.
BOILERPLATE_PATTERNS = (
    r"(?i)click\s+here",
    r"(?i)read\s+more",
    r"(?i)continue\s+reading",
    r"(?i)home\s*\|\s*about\s*\|\s*contact",
    r"(?i)privacy\s+policy",
    r"(?i)terms\s+of\s+service",
    r"(?i)copyright\s+\d{4}",
    r"\b\d+\b",
)

# Embedding clean-up steps (pattern, replacement), in this order.
EMBEDDING_PATTERNS = (
    (r"<[^>]+>", " "),
    (r"\s+", " "),
    (r"[^\w\s\-\.\,\!\?]", " "),
    (r"\b\d+\b", "[NUM]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"https?://\S+", "[URL]"),
)

CHUNK_CHARS = 1000


def unicode_pattern(pattern: str) -> str:
    """A pattern written for Unicode-aware engines, as a Java pattern.

    ``\\w`` becomes letters, numbers and underscore (Java's own Unicode word
    class also takes combining marks); ``(?d)`` limits line ends to ``\\n``.
    """
    return "(?Ud)" + expand_word_class(pattern)


def expand_word_class(pattern: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else r"[\p{L}\p{N}_]")
            i += 2
            continue
        if pair[0] == "\\":
            out.append(pair)
            i += 2
            continue
        in_class = True if pair[0] == "[" else False if pair[0] == "]" else in_class
        out.append(pair[0])
        i += 1
    return "".join(out)


def replace_all(col: Column, patterns, value: str) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, unicode_pattern(p), value), patterns, col)


def clean_text(col: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")).cast("long")


def normalize_text(col: Column) -> Column:
    """Lower case with everything but word characters and spaces blanked."""
    # white space is no word character either, so one pass does both
    return F.trim(F.regexp_replace(F.lower(col), r"(?U)[^\p{L}\p{N}_]+", " "))


def extract_keywords(col: Column, min_length: int = 3) -> Column:
    """Words of at least ``min_length`` characters that are not stopwords, in order."""
    words = F.split(normalize_text(col), " ")
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*STOPWORDS))


def keyword_set(col: Column) -> Column:
    """Distinct keywords of a text, null for an empty or missing text."""
    return F.when(col != "", F.array_distinct(extract_keywords(col)))


def strip_dynamic(col: Column) -> Column:
    """Content without the parts that change on every visit, lower-cased.

    A pattern only runs on texts that hold what each of its matches must contain.
    """
    out = F.transform(F.array(F.coalesce(col, F.lit(""))), _without_dated)
    for pattern, mark in zip(DYNAMIC_PATTERNS[4:], DYNAMIC_MARKS):
        out = F.transform(out, lambda x: F.when(F.contains(x, F.lit(mark)), replace_all(x, [pattern], "")).otherwise(x))  # noqa: B023
    return F.lower(clean_text(out[0]))


def _without_dated(x: Column) -> Column:
    """The patterns that need a digit; each only removes, so a text without digits gets none."""
    return F.when(x.rlike(r"(?U)\d"), replace_all(x, DYNAMIC_PATTERNS[:4], "")).otherwise(x)


def semantic_text(col: Column) -> Column:
    """Text without tags, boilerplate phrases and standalone numbers."""
    return clean_text(replace_all(F.regexp_replace(col, "<[^>]+>", " "), BOILERPLATE_PATTERNS, " "))


def preprocess_embedding(col: Column, placeholders_first: bool = False, max_chars: int | None = None) -> Column:
    """Text as it is handed to an embedding model, whole or its first ``max_chars`` characters.

    By default special characters go before the e-mail and URL placeholders,
    which therefore never match; ``placeholders_first`` puts those first.
    """
    steps = EMBEDDING_PATTERNS
    if placeholders_first:
        steps = (steps[0], *steps[4:], *steps[1:4])
    out = F.coalesce(col, F.lit(""))
    for pattern, value in steps:
        out = F.regexp_replace(out, unicode_pattern(pattern), value)
    out = F.trim(F.lower(out))
    return out if max_chars is None else F.substring(out, 1, max_chars)


def chunk_text(col: Column, limit: int = CHUNK_CHARS) -> Column:
    """Array of chunks: whole sentences packed greedily up to ``limit`` characters."""
    sentences = F.split(col, r"(?U)[.!?]+\s+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(acc: Column, sentence: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(sentence) <= limit
        close = ~fits & (acc["open"] != "")
        return F.struct(
            F.when(close, F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(fits, acc["open"]).otherwise(""), sentence, F.lit(". ")).alias("open"),
        )

    packed = F.aggregate(
        sentences, start, pack, lambda acc: F.concat(acc["done"], F.array(F.trim(acc["open"])))
    )
    return F.when(F.length(col) <= limit, F.array(col)).otherwise(packed)


def content_digest(col: Column, hash_type: str = "sha256") -> Column:
    """Digest of already normalised text; an unknown type is an error."""
    if hash_type == "sha256":
        return F.sha2(col, 256)
    if hash_type == "md5":
        return F.md5(col)
    raise ValueError(f"unsupported hash type: {hash_type}")


def external_resources(col: Column) -> Column:
    """Distinct http(s) addresses in a text."""
    pattern = r"""(?U)https?://[^\s<>"'{}|\\^`\[\]]*"""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)))


def fixed(col: Column, digits: int = 2) -> Column:
    """A number with fixed decimals and without separators, exact ties to even."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))
