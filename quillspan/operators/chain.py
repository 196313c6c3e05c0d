"""All that is done to a document, from its text to its coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from ..sources import load_pages
from ..tables import cut
from .claim import match_highlights, union_candidates
from .cues import CUES, cue_sweep
from .report import page_coverage, union_coverage


def process(documents: DataFrame, settings: Settings, candidates: DataFrame | None = None, lexicon: Sequence[tuple[str, str, str]] = CUES, lines: int = 5) -> dict[str, DataFrame]:
    """Tables of documents (doc_id, text), in the order pages, cues, candidates, location, claims, coverage.

    ``candidates`` (doc_id, cand_no, text, importance) come before the cues that they lack; without them cues are all there is. Cues are
    swept if the settings say so. The tables: ``matched`` and ``failures`` as ``match_highlights`` gives them, ``coverage`` of each page
    (with ``union_share``, which counts what two spans cover once), and ``totals`` of each document, also of those without pages.
    """
    pages = cut(load_pages(documents, lines).select("doc_id", "page", "normalized"))
    found = cue_sweep(pages, lexicon).select("doc_id", "text", "importance", "page", "sent_no")
    found = found if settings.cue_sweep else found.limit(0)
    given = found.limit(0) if candidates is None else candidates.select("doc_id", "text", "importance", F.lit(-1).alias("page"), F.col("cand_no").alias("sent_no"))
    matched, failures = match_highlights(pages, union_candidates(given, found, ["page", "sent_no"]), settings)
    matched, failures = cut(matched), cut(failures)
    coverage = page_coverage(pages, matched).join(union_coverage(pages, matched).select("doc_id", "page", "covered", "union_share"), ["doc_id", "page"])
    number = matched.groupBy("doc_id").agg(F.countDistinct("group_id").alias("highlight_count"))
    lost = failures.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unmatched"))
    totals = documents.select("doc_id").distinct().join(number, "doc_id", "left").join(lost, "doc_id", "left")
    return {"matched": matched, "failures": failures, "coverage": coverage, "totals": totals.fillna(0, ["highlight_count", "unmatched"])}
