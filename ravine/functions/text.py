"""Text as columns: tokens, trigrams, formatters, noise predicates. No UDF anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9]+"), lambda t: t != "")


def spaced(text: Column | str) -> Column:
    """The tokens of a text in one string: a blank on either side of each. Tokens are then found and
    counted by plain string functions, without an array."""
    t = F.btrim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "  "))
    return F.when(t == "", "").otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def has_token(spaced: Column, token: str) -> Column:
    return F.contains(spaced, F.lit(f" {token} "))


def token_hits(spaced: Column, token: str) -> Column:
    """How often a token occurs."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {token} "), F.lit("")))) / (len(token) + 2)).cast("int")


def token_count(spaced: Column) -> Column:
    return F.when(spaced == "", 0).otherwise(((F.length(spaced) - F.length(F.replace(spaced, F.lit("  "), F.lit("")))) / 2).cast("int") + 1)


def contains_any(text: Column | str, needles: list[str]) -> Column:
    """Substring match, as the reference's rules do it (no word boundaries)."""
    low = F.lower(col(text))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in needles])


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def trigrams(text: Column | str) -> Column:
    """The set of 3-grams of the lower-case text, padded by two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(col(text)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared 3-grams over all 3-grams of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def ellipsis(text: Column | str, n: int) -> Column:
    """At most n characters, the last three of a cut text being dots."""
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)


def minutes_seconds(seconds: Column) -> Column:
    """M:SS."""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def cache_key(question: Column | str, doc: Column | str) -> Column:
    """SHA-256 of the question — stripped, lower-cased, then without ?., — a colon and the document."""
    q = F.translate(F.lower(F.trim(col(question))), "?.,", "")
    return F.sha2(F.concat(q, F.lit(":"), col(doc).cast("string")), 256)


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))


#: Noise patterns and keywords of headings.
HEADER_PATTERNS = [r"^\s*page\s+\d+\s*$", r"^\s*\d+\s*$", r"^\s*\d+\s*/\s*\d+\s*$", r"\.pdf$", r"\.docx?$", r"^Chapter\s+\d+\s*$", r"^Section\s+\d+\.?\d*\s*$", r"^\d{4}-\d{2}-\d{2}", "confidential", "proprietary", r"copyright\s+©", "all rights reserved"]
LEGAL_KEYWORDS = ["cookie", "privacy policy", "privacy statement", "gdpr", "accept cookies", "manage cookies", "cookie settings", "we use cookies", "this website uses", "terms of service", "terms and conditions", "legal notice", "disclaimer"]
URL_PATTERNS = [r"https?://", r"www\.", r"@[a-z0-9]+\.", r"^[a-z_]{3,}$", r"^[a-z]+\.[a-z]+\.[a-z]+", r"^\[.*\]$", r"^<.*>$"]
NAVIGATION_KEYWORDS = ["previous", "next", "back to", "go to", "see also", "related", "reference", "link", "click here", "more info"]
NAVIGATION_PATTERN = r"\([/a-z0-9\-_]+\)"
METADATA_PATTERNS = [r"^version\s+\d", r"^rev\.?\s*\d", "^draft", r"^document\s+(title|name|id)", "^author:", "^date:", "^prepared by", "^approved by", "^status:"]


def is_header_noise(text: Column) -> Column:
    return matches_any(F.lower(text), HEADER_PATTERNS)


def is_legal(text: Column) -> Column:
    return contains_any(text, LEGAL_KEYWORDS)


def is_identifier(text: Column) -> Column:
    """URLs and the like; matched without case, so any single word of letters is one."""
    return matches_any(F.lower(text), URL_PATTERNS)


def is_navigation(text: Column) -> Column:
    return contains_any(text, NAVIGATION_KEYWORDS) | F.lower(text).rlike(NAVIGATION_PATTERN)


def is_metadata(text: Column) -> Column:
    return matches_any(F.lower(text), METADATA_PATTERNS)


def is_valid_title(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    shouting = text.rlike("[A-Za-z]") & (text == F.upper(text)) & (F.size(words) > 1) & F.exists(words, lambda w: F.length(w) > 4)
    return text.rlike("[a-zA-Z]{3,}") & ~shouting & (F.length(text) <= 150) & ~text.rlike(r"^[#*\-.,;:!?]")


def section_level(text: Column) -> Column:
    """1 for `1. X`, 2 for `1.1 X` and so on to 4; null without a number."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+){0,3})\.?\s+\S", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))
