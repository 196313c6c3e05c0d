"""Coverage, status and resume reports, corpus listing and text audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_output, output_name, squash_space
from ..settings import GAP_PAGE_CHARS, PASSES

STATUSES = ("pending", "processing", "completed", "failed", "skipped")


def page_coverage(pages: DataFrame, matched: DataFrame) -> DataFrame:
    """Of each page: chars, highlighted chars and share (0 for an empty page)."""
    marked = matched.groupBy("doc_id", "page").agg(F.sum(F.length("matched_text")).alias("marked"))
    joined = pages.select("doc_id", "page", F.length("normalized").cast("long").alias("chars")).join(marked, ["doc_id", "page"], "left").withColumn("marked", F.coalesce("marked", F.lit(0)).cast("long"))
    return joined.withColumn("share", F.when(F.col("chars") > 0, F.col("marked").cast("double") / F.col("chars")).otherwise(F.lit(0.0)))


def union_coverage(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Of each page: chars, those under at least one span (doc_id, page, start, end), and their share (0 for an empty page).

    Spans are swept in order of their starts; each adds what lies beyond the furthest end so far. Ends beyond the page count up to it.
    """
    chars = F.length("normalized").cast("long")
    placed = spans.select("doc_id", "page", F.greatest("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    placed = placed.join(pages.select("doc_id", "page", chars.alias("chars")), ["doc_id", "page"]).withColumn("end", F.least("end", "chars"))
    before = Window.partitionBy("doc_id", "page").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    covered = placed.withColumn("fresh", fresh).groupBy("doc_id", "page").agg(F.sum("fresh").alias("covered"))
    joined = pages.select("doc_id", "page", chars.alias("chars")).join(covered, ["doc_id", "page"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return joined.withColumn("union_share", F.when(F.col("chars") > 0, F.col("covered").cast("double") / F.col("chars")).otherwise(F.lit(0.0)))


def doc_coverage(pages: DataFrame, matched: DataFrame, failures: DataFrame | None = None, cues: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Of each document: share, share of each page, and the long pages without a highlight, counted from 1.

    Where they are given, also ``unmatched`` (rows of ``failures``), ``rule_based_added`` (of ``cues``) and ``ai_requests``
    (``requests`` of the table of that name).
    """
    gap = (F.col("chars") >= GAP_PAGE_CHARS) & (F.col("marked") == 0)
    by_page = F.array_sort(F.collect_list(F.struct("page", "share")))
    gaps = F.sort_array(F.collect_list(F.when(gap, F.col("page") + 1)))
    rows = page_coverage(pages, matched).groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum("marked").alias("marked"), by_page.alias("p"), gaps.alias("gap_pages"))
    share = F.when(F.col("chars") > 0, F.col("marked").cast("double") / F.col("chars")).otherwise(F.lit(0.0))
    out = rows.select("doc_id", "chars", "marked", share.alias("share"), F.col("p.share").alias("page_shares"), "gap_pages")
    count = F.count(F.lit(1))
    for table, name, number in ((failures, "unmatched", count), (cues, "rule_based_added", count), (requests, "ai_requests", F.sum("requests") if requests is not None else None)):
        if table is not None:
            out = out.join(table.groupBy("doc_id").agg(number.alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def expected_annotations(matched: DataFrame) -> DataFrame:
    return matched.groupBy("doc_id").agg(F.countDistinct("group_id", "page").alias("annotations"))


def detect_scans(documents: DataFrame, pages: DataFrame, least: float = 60) -> DataFrame:
    """Whether a document needs recognition: no pages, or too few characters on the average one."""
    mean = pages.groupBy("doc_id").agg(F.avg(F.length("normalized")).alias("mean"))
    return documents.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce(F.col("mean") < least, F.lit(True)).alias("needs_ocr"))


def status_counts(documents: DataFrame) -> DataFrame:
    """Documents of each status, all statuses present."""
    all_ = documents.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return all_.join(documents.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("documents"))


def batch_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.countDistinct("course").alias("courses"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("highlights"), F.lit(0)).alias("highlights"), F.coalesce(F.sum("unmarked_pages"), F.lit(0)).alias("unmarked_pages"))


def course_rollup(documents: DataFrame) -> DataFrame:
    """Documents and completed ones of each course and, with a null course, of all."""
    return documents.rollup("course").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "completed").alias("completed"))


def progress(documents: DataFrame) -> DataFrame:
    """Total, completed, failed, skipped, remaining and the share that is done."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    rows = documents.agg(F.count(F.lit(1)).alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("skipped").alias("skipped"), n("pending", "processing").alias("remaining"))
    return rows.withColumn("done", F.when(F.col("total") > 0, (F.col("total") - F.col("remaining")).cast("double") / F.col("total")).otherwise(F.lit(0.0)))


def failed_documents(documents: DataFrame) -> DataFrame:
    return documents.filter("status = 'failed'")


def results_summary(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of total, completed, failed and skipped documents; the failed ones with their errors)."""
    return progress(documents).select("total", "completed", "failed", "skipped"), failed_documents(documents)


def resume_summary(snapshot: DataFrame) -> DataFrame:
    """What a stored session has done: completed, failed and remaining documents."""
    return progress(snapshot).select("completed", "failed", "remaining")


def filter_course(documents: DataFrame, course: str | None) -> DataFrame:
    """Documents of one course, or all."""
    return documents if course is None else documents.filter(F.col("course") == course)


def preflight(corpus: DataFrame, mode: str, keys: int, budget: int, spent: int) -> DataFrame:
    """One row on a scan before it is run: courses, documents, outputs that exist, documents to process, passes over each
    chunk, and how many requests the day still allows (null without a budget)."""
    inputs = ~F.col("is_output")
    counts = corpus.agg(F.countDistinct(F.when(inputs, F.col("course"))).alias("courses"), F.count_if(inputs).alias("documents"), F.count_if("is_output").alias("outputs"))
    left = skip_existing(corpus).agg(F.count(F.lit(1)).alias("to_process"))
    capacity = F.lit(max(0, keys * budget - spent) if budget > 0 else None).cast("long")
    return counts.join(left).select("*", F.lit(len(PASSES[mode])).alias("passes"), capacity.alias("capacity"))  # one row each


def resume_join(corpus: DataFrame, snapshot: DataFrame, root: str) -> DataFrame:
    """The scan with what a snapshot of the same root knows, unless that was pending or in work."""
    known = snapshot.filter((F.col("root") == root) & ~F.col("status").isin("pending", "processing")).select("doc_id", F.col("status").alias("_status"), F.col("highlight_count").alias("_count"))
    joined = corpus.join(known, "doc_id", "left")
    return joined.withColumn("status", F.coalesce("_status", F.lit("pending"))).withColumn("highlight_count", F.coalesce("_count", F.lit(0))).drop("_status", "_count")


def pending_queue(documents: DataFrame, reprocess: bool = False) -> DataFrame:
    states = ["pending", "skipped", "completed"] if reprocess else ["pending"]
    return documents.filter(F.col("status").isin(states))


def retry_failed(documents: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return documents.withColumn("error", F.when(~failed, F.col("error"))).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def newest(logs: DataFrame, order: Sequence[str], most: int = 800) -> DataFrame:
    return logs.orderBy(*[F.desc(c) for c in order]).limit(most)


def scan_corpus(paths: DataFrame, suffix: str = "_AI_Highlighted") -> DataFrame:
    """Documents of paths (path, size): course (first folder), file name, output flag and output name."""
    parts = F.split("path", "/")
    docs = paths.filter(F.lower("path").endswith(".pdf")).withColumn("file_name", F.element_at(parts, -1)).withColumn("course", F.when(F.size(parts) > 1, parts[0]).otherwise("Uncategorized"))
    inner = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), "/")).otherwise(F.col("path"))
    return docs.select(F.concat("course", F.lit("/"), inner).alias("doc_id"), "course", "path", "file_name", "size", is_output(F.col("file_name"), suffix).alias("is_output"), F.concat("course", F.lit("/"), output_name(inner, suffix)).alias("output"))


def skip_existing(corpus: DataFrame) -> DataFrame:
    """Inputs whose output isn't there yet."""
    there = corpus.filter("is_output").select(F.lower("doc_id").alias("_there")).distinct()
    return corpus.filter("NOT is_output").join(there, F.lower("output") == F.col("_there"), "left_anti")


def subtract_fragments(text: Column, fragments: Column) -> Column:
    """The text with each fragment replaced by a space, squashed; empty fragments do nothing."""
    # split with a literal pattern: a fragment is no expression here
    cut = F.aggregate(F.filter(fragments, lambda f: f != ""), text, lambda t, f: F.array_join(F.split(t, F.concat(F.lit("\\Q"), f, F.lit("\\E")), -1), " "))
    return squash_space(cut)


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages of both versions (doc_id, page, normalized; ``after`` with fragments): ``old``, ``new`` without the fragments, and whether the old text is ``kept``."""
    old = before.select("doc_id", "page", squash_space(F.col("normalized")).alias("old"))
    new = after.select("doc_id", "page", subtract_fragments(F.col("normalized"), F.col("fragments")).alias("new"))
    return old.join(new, ["doc_id", "page"]).withColumn("kept", (F.col("old") == "") | F.contains("new", F.col("old")))


def audit(before: DataFrame, after: DataFrame, scanned: bool = False) -> DataFrame:
    """Of each document, whether the old text of all pages is kept, and the first page that drifts.

    Scanned documents must have no letter or digit beyond the fragments.
    """
    fine = (F.regexp_replace("new", r"[^\p{L}\p{N}]", "") == "") if scanned else F.col("kept")
    return compare_versions(before, after).groupBy("doc_id").agg(F.every(fine).alias("ok"), F.min(F.when(~fine, F.col("page"))).alias("first_drift"))


def audit_counts(before: DataFrame, after: DataFrame, annotations: DataFrame) -> DataFrame:
    """Page counts and annotations against what is expected. ``annotations``: doc_id, expected, found, added (pages)."""
    count = lambda d, name: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    rows = count(before, "old_pages").join(count(after, "new_pages"), "doc_id", "left").join(annotations, "doc_id", "left")
    pages_ok = F.coalesce(F.col("new_pages"), F.lit(0)) == F.col("old_pages") + F.coalesce("added", F.lit(0))
    return rows.select("doc_id", pages_ok.alias("pages_ok"), (F.coalesce("found", F.lit(0)) >= F.coalesce("expected", F.lit(0))).alias("annotations_ok"))
