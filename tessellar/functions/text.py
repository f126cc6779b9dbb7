"""Text functions of catalog and query strings, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = [(chr(o), unicodedata.normalize("NFD", chr(o))[0]) for o in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(o))) > 1]
_FROM, _TO = "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED)


SPACE = " \t\n\r\f\v\u00a0"


def trimmed(c: Column) -> Column:
    """Without white space at the ends."""
    return F.trim(c, F.lit(SPACE))


def trimmed_wide(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapse_space(c: Column) -> Column:
    """STR-01: trimmed, white space runs as one blank."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def plain_query(c: Column) -> Column:
    """STR-02: lower case, everything but letters, digits and white space as blanks, collapsed."""
    return collapse_space(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "))


def straight_quotes(c: Column) -> Column:
    """STR-03: typographic quotes as ASCII, collapsed."""
    return collapse_space(F.translate(F.trim(c), "\u201c\u201d\u2018\u2019", "\"\"''"))


def slug(c: Column, size: int = 80) -> Column:
    """STR-04: lower case, other runs than [a-z0-9] as one dash, none at the ends, cut to size."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, size)


def strip_accents(c: Column) -> Column:
    return F.translate(c, _FROM, _TO)


def index_tokens(c: Column) -> Column:
    """TXT-03: tokens of an indexed text: lower case, accents off, runs of letters and digits."""
    return F.coalesce(F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def query_terms(c: Column, compat: bool = True) -> Column:
    """TXT-01: white-space tokens of a query.  ``compat`` deletes the operator characters (so ``cherry-pick`` is one term
    ``cherrypick``); otherwise they separate, as in the index."""
    cleaned = F.regexp_replace(c, r'["*^\-():{}\[\]~]', "" if compat else " ")
    return F.filter(F.split(F.coalesce(cleaned, F.lit("")), r"\s+"), lambda t: t != "")


def match_expression(c: Column) -> Column:
    """TXT-02: quoted terms joined by AND, null if there is none."""
    terms = query_terms(c)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND "))


def query_tokens(c: Column) -> Column:
    """STR-17: lower-case tokens of [a-z0-9_+-]."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_+\-]+"), lambda t: t != "")


# Patterns of queries that aren't kept, in order (non_text also demands no two letters in a row).
JUNK_PATTERNS = [
    ("non_text", r"^[\W\d_\s]{1,}$"),
    ("pii_email", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    ("pii_token", r"\b(ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})\b"),
    ("pii_home_path", r"(?i)(?:/Users/[^/\s]+|/home/[^/\s]+|C:\\Users\\[^\\\s]+)"),
    ("pii_private_url", r"(?i)https?://(?:localhost|127\.0\.0\.1|192\.168\.|10\.|.*\.local)[^\s]*"),
    ("spam_repeat", r"^(.)\1{8,}$"),
]


def junk_reason(c: Column) -> Column:
    """FLT-03: why a query isn't fit to keep, first reason in order; null if it is."""
    q = trimmed(F.coalesce(c, F.lit("")))
    out = F.when(q == "", "empty").when(F.length(q) < 2, "too_short")
    for reason, pattern in JUNK_PATTERNS:
        met = q.rlike(pattern)
        out = out.when(met & ~q.rlike("[a-zA-Z]{2,}") if reason == "non_text" else met, reason)
    return out


def is_command_like(c: Column) -> Column:
    """FLT-05."""
    return F.coalesce(F.trim(c) == "", F.lit(True)) | c.rlike(r"(?i)^\s*git\b") | c.rlike(r"&&|\|\||;|`")


def is_fallback_question(c: Column) -> Column:
    """FLT-09."""
    return F.coalesce(c.rlike(r"(?i)^how do i use git\s+\S+"), F.lit(False))


def contains_ci(text: Column, needle: Column) -> Column:
    """JN-14: case-insensitive containment of a non-blank needle."""
    return (F.trim(needle) != "") & F.contains(F.lower(text), F.lower(needle))


def semver_key(c: Column) -> Column:
    """STR-20: a struct that sorts as versions do; missing parts are 0."""
    part = lambda k: F.coalesce(F.regexp_extract(c, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def near_edit(a: Column, b: Column) -> Column:
    """SIM-01: equal, contained, token Jaccard >= 0.5, or short with a normalised edit distance <= 0.35."""
    x, y = F.trim(F.lower(F.coalesce(a, F.lit("")))), F.trim(F.lower(F.coalesce(b, F.lit(""))))
    tokens = lambda s: F.array_distinct(F.filter(F.split(s, r"\s+"), lambda t: t != ""))
    both, either = F.size(F.array_intersect(tokens(x), tokens(y))), F.size(F.array_union(tokens(x), tokens(y)))
    longest = F.greatest(F.length(x), F.length(y))
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | (both >= either * 0.5) | ((longest <= 64) & (F.levenshtein(x, y) <= longest * 0.35)))


def strip_ansi(c: Column) -> Column:
    """STR-13: terminal control sequences taken out."""
    return F.regexp_replace(c, "\u001b\\[[0-9;?]*[ -/]*[@-~]|\u001b\\][^\u0007]*\u0007|\u001b[@-Z\\\\-_]", "")


def estimated_tokens(c: Column) -> Column:
    """MTH-05: a quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")
