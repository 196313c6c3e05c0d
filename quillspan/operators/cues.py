"""Sentences that carry a cue, by an ordered lexicon that is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences, token_count

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _any(*phrases: str) -> str:
    return _B + "(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + ")" + _E


# Label, importance and phrases (words apart by white space, at ASCII word edges), in order of precedence.
_NUMBER = "(?:two|three|four|five|six|seven|eight|nine|ten)"
CUES = (
    ("Definition", "high", _any("(?:is|are|was|were|can be|may be) (?:defined|described|termed) as", "is called", "are called", "is known as", "are known as", "refers to", "refer to the", "stands for", "is the (?:process|ability|study|measure|degree|state|amount|rate|term) of", "by definition", "definition of")),
    ("Formula or rule", "high", _any("formula", "equation", "is given by", "is calculated as", "is computed as", "equals", "theorem", "law of", "principle of", "rule states", "states that") + r"|[a-z0-9)\]]\s*=\s*[a-z0-9(]"),
    ("Classification", "high", _any("types of", "kinds of", "forms of", "categories", "classified (?:in)?to", "classification", "divided into", "consists of", "comprises", "composed of", "components of", "elements of")),
    ("Characteristics", "medium", _any("characteristics of", "features of", "functions of", "properties of", "advantages", "disadvantages", "benefits of", "limitations of", "objectives of", "importance of", "purpose of")),
    ("Process or steps", "medium", _any("steps (?:are|in|of|involved)", "stages of", "phases of", "procedure (?:is|for)", "the following (?:are|steps|stages|types|points)", "first step", "process of")),
    ("Enumeration", "medium", _any(rf"there are (?:{_NUMBER}|\d+)", f"{_NUMBER} (?:main|major|basic|important|types|kinds|categories|methods|factors|principles|stages|steps)")),
    ("Distinction", "medium", _any("difference between", "differs from", "as opposed to", "in contrast to", "whereas", "unlike")),
)
#: Boilerplate that is no cue. Names of publishers and shops are the caller's to add, with ``noise_with``.
NOISE = r"virtual\s+university|whatsapp|copyright|all\s+rights\s+reserved|^lecture\s+no|^page\s+\d|handout|^\d+$|table\s+of\s+contents|^topic\s+\d"
SHORTEST, LONGEST, LEAST_TOKENS, MOST_PER_PAGE = 28, 420, 6, 14


def noise_with(*names: str) -> str:
    """The boilerplate pattern with further names, which are taken literally."""
    return "|".join([NOISE, *(rf"\Q{n.lower()}\E" for n in names)])


def is_cue_sentence(sentence: Column, noise: str = NOISE) -> Column:
    return F.length(sentence).between(SHORTEST, LONGEST) & (token_count(sentence) >= LEAST_TOKENS) & ~sentence.rlike(noise)


def cue_sweep(pages: DataFrame, cues: Sequence[tuple[str, str, str]] = CUES, most: int = MOST_PER_PAGE, noise: str = NOISE) -> DataFrame:
    """Of pages (doc_id, page, normalized), the first sentences of each page with a cue: doc_id, page, sent_no, text, importance, reason."""
    sentences = pages.select("doc_id", "page", F.posexplode(split_sentences(F.col("normalized"))).alias("sent_no", "text")).filter(is_cue_sentence(F.col("text"), noise))
    kinds = [F.when(F.col("text").rlike(pattern), F.struct(F.lit(label).alias("label"), F.lit(importance).alias("importance"))) for label, importance, pattern in cues]
    # An exploded array, as a filter would be pushed below and try the patterns twice.
    found = sentences.select("*", F.explode(F.filter(F.array(F.coalesce(*kinds)), lambda c: c.isNotNull())).alias("cue"))
    order = Window.partitionBy("doc_id", "page").orderBy("sent_no")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("doc_id", "page", "sent_no", "text", "cue.importance", F.concat("cue.label", F.lit(" (rule sweep)")).alias("reason"))
