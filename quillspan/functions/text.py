"""Text functions as columns. Lengths and places count code points, places from 0."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import RELAXED_DROP, RELAXED_LEAST

# What is dropped, and what is read as its plain twin, after NFKC.
DROPPED = "­​‌‍⁠﻿"
APOSTROPHES = "‘’‚‛ʼ´′"
QUOTES = "“”„″"
DASHES = "‐‑‒–—―−"
SLASH = "⁄"
SPACES = "     　•·…�"
_FROM = APOSTROPHES + QUOTES + DASHES + SLASH + SPACES
_TO = "'" * len(APOSTROPHES) + '"' * len(QUOTES) + "-" * len(DASHES) + "/" + " " * len(SPACES)
#: Characters before a span that are searched first for the beginning of a word.
_NEAR = 64
_SENTENCE = r"(?<=[.!?:;])(?U)\s+(?-U)(?=[\p{L}\p{N}(“\"'])"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_text(text: Column) -> Column:
    """NFKC, invisible characters gone, typographic twins plain, lower case, single spaces; not trimmed.

    Only texts with a character beyond ASCII go through Python; others reach it as null.
    """
    beyond = text.rlike(r"[^\x00-\x7F]")
    # translate drops the characters that have no twin
    plain = F.lower(F.when(beyond, F.translate(_nfkc(F.when(beyond, text)), _FROM + DROPPED, _TO)).otherwise(text))
    return F.regexp_replace(plain, r"[\t\r\n\f\x0B][ \t\r\n\f\x0B]*| [ \t\r\n\f\x0B]+", " ")


def normalize_quote(text: Column) -> Column:
    """Words wrapped by a hyphen at a line's end are joined, then folded and trimmed."""
    return F.trim(fold_text(F.regexp_replace(text, r"(\p{L})-[\r\n]+\s*(\p{L})", "$1$2")))


def squash_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def split_sentences(text: Column) -> Column:
    """Sentences, trimmed; the whole text if there is none."""
    # Not F.trim itself: it would be given the place of a part as the characters to trim.
    parts = F.filter(F.transform(F.split(text, _SENTENCE), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.trim(text))))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bounded_levenshtein(a: Column, b: Column, most: Column) -> Column:
    """The edit distance, or ``most + 1`` if it is larger."""
    distance = F.call_function("levenshtein", a, b, most.cast("int"))
    return F.when(distance < 0, most + 1).otherwise(distance)


def similarity(a: Column, b: Column, floor: float = 0.5) -> Column:
    """1 less the distance's share of the longer length; 0 if the distance is over what the floor allows."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.ceil(longest.cast("double") * F.lit(1.0 - floor))
    distance = F.nullif(F.call_function("levenshtein", a, b, most.cast("int")), F.lit(-1))  # -1 is over the limit
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.coalesce(F.lit(1.0) - distance.cast("double") / longest, F.lit(0.0)))


def token_coverage(needle: Column, matched: Column) -> Column:
    """The share of the needle's words of 3 and more, repeats included, that the match holds."""
    wanted = F.filter(tokenize(needle), lambda t: F.length(t) >= 3)
    have = tokenize(matched)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.filter(wanted, lambda t: F.array_contains(have, t))).cast("double") / F.size(wanted))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return F.when(shared <= 0, F.lit(0.0)).otherwise(shared.cast("double") / F.least(a_end - a_start, b_end - b_start))


def snap_to_words(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span grown outwards so that it cuts no word."""
    at = lambda i: F.substring(text, i + 1, F.lit(1))
    inside = lambda i: at(i).rlike(r"^[\p{L}\p{N}]$") & at(i - 1).rlike(r"^[\p{L}\p{N}]$")
    before = lambda at: F.length(F.regexp_extract(F.substring(text, at + 1, start - at), r"[\p{L}\p{N}]*$", 0))
    # Only where a word fills the last characters before the start is all of the text before it searched.
    near = before(F.greatest(F.lit(0), start - _NEAR))
    before = F.when(near < _NEAR, near).otherwise(before(F.lit(0)))
    after = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[\p{L}\p{N}]*", 0))
    return F.when((start > 0) & inside(start), start - before).otherwise(start), F.when((end < F.length(text)) & inside(end), end + after).otherwise(end)


def anchor_tokens(needle: Column) -> Column:
    """Up to 4 distinct words of 4 and more, longest first, earlier first among equals."""
    sized = F.transform(F.filter(tokenize(needle), lambda t: F.length(t) >= 4), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.slice(F.array_distinct(F.transform(F.array_sort(sized), lambda s: s.t)), 1, 4)


def occurrences(text: Column, token: Column, limit: int = 24) -> Column:
    """The first places of a token that don't overlap."""
    parts = F.split(text, F.concat(F.lit("\\Q"), token, F.lit("\\E")), -1)
    lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(F.slice(lengths, 1, limit), start, lambda a, n: F.struct((a["at"] + n + F.length(token)).alias("at"), F.concat(a.out, F.array(a["at"] + n)).alias("out")), lambda a: a.out)
    return F.when(F.length(token) > 0, fold).otherwise(F.array().cast("array<int>"))


def clamped(confidence: Column, ceiling: Column) -> tuple[Column, Column, Column]:
    """The floor of matching, that of the relaxed stage, and the ceiling of a page's coverage, within their limits."""
    floor = F.least(F.greatest(confidence, F.lit(0.6)), F.lit(0.99))
    return floor, F.greatest(F.lit(RELAXED_LEAST), floor - F.lit(RELAXED_DROP)), F.least(F.greatest(ceiling, F.lit(0.1)), F.lit(0.95))


def importance_rank(importance: Column) -> Column:
    return F.when(importance == "low", 0).when(importance == "medium", 1).when(importance == "high", 2)


def classify_error(status: Column) -> Column:
    """The kind of a failed request by its HTTP status, and whether to try again."""
    kind = F.when(status.isin(401, 403), "auth").when(status == 429, "rate-limit").when(status.isin(404, 400, 422), "model").when(status >= 500, "network").otherwise("unknown")
    return F.struct(kind.alias("kind"), ((status == 429) | (status >= 500)).alias("retryable"))


def detect_daily_quota(message: Column) -> Column:
    return message.rlike(r"(?i)per day|daily|quota.*exceeded|RESOURCE_EXHAUSTED")


def page_range_label(pages: Column) -> Column:
    """Of page numbers from 0: ``page N`` or ``pages A-B``."""
    first, last = (F.element_at(pages, i) + 1 for i in (1, -1))
    return F.when(F.size(pages) > 1, F.concat(F.lit("pages "), first, F.lit("-"), last)).otherwise(F.concat(F.lit("page "), first))


def _numbers_padded(text: Column) -> Column:
    """``text`` where each run of digits, without leading zeros, follows its length in eight digits."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 8, "0"), number(p))).otherwise(p)), "")


def natural_key(text: Column) -> Column:
    """A sort key that takes digits as numbers: each run of them, without leading zeros, follows its length in eight digits."""
    return _numbers_padded(F.lower(text))


def collated_key(text: Column) -> Column:
    """A sort key of the order in which readers expect names: by the root locale's collation (letters, then accents, then case), digits 0 to 9 as numbers.

    Names that differ only in leading zeros agree. Null stays null.
    """
    return F.collate(_numbers_padded(text), "UNICODE")


def output_name(name: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(f"{suffix}.pdf"))


def is_output(name: Column, suffix: str) -> Column:
    return F.endswith(F.lower(name), F.lit(f"{suffix}.pdf".lower()))
