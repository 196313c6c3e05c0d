"""Chunks, request tables and model replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import CHUNK_CHARS, CHUNK_HIGHLIGHTS, HIGHLIGHTS_PER_PAGE, PASSES
from ..tables import cut


def build_chunks(pages: DataFrame, mode: str = "balanced", budget: int = CHUNK_CHARS) -> DataFrame:
    """Pages (doc_id, page, raw) packed in order to chunks: doc_id, chunk_no, pages, content, max_highlights.

    A chunk is closed when the next page's block would pass the budget; blank pages go.
    """
    blocks = pages.withColumn("body", F.trim("raw")).filter("body <> ''").withColumn("block", F.concat(F.lit("[page "), F.col("page") + 1, F.lit("]\n"), F.col("body")))
    sizes = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.length("block").alias("n")))).alias("p"))
    zero = F.expr("named_struct('size', 0, 'chunk', 0, 'out', cast(array() as array<int>))")

    def step(a, x):
        full = (a["size"] > 0) & (a["size"] + x["n"] > budget)
        chunk = a["chunk"] + full.cast("int")
        return F.struct((F.when(full, 0).otherwise(a["size"]) + x["n"]).alias("size"), chunk.alias("chunk"), F.concat(a["out"], F.array(chunk)).alias("out"))

    placed = sizes.select("doc_id", F.explode(F.arrays_zip(F.col("p.page").alias("page"), F.aggregate("p", zero, step, lambda a: a["out"]).alias("chunk_no"))).alias("x")).select("doc_id", "x.page", "x.chunk_no")
    grouped = blocks.join(placed, ["doc_id", "page"]).groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("page", "block"))).alias("b"))
    most = F.least(F.lit(CHUNK_HIGHLIGHTS), F.greatest(F.lit(3), F.size("b") * HIGHLIGHTS_PER_PAGE[mode]))
    return grouped.select("doc_id", "chunk_no", F.col("b.page").alias("pages"), F.array_join("b.block", "\n\n").alias("content"), most.alias("max_highlights"))


def pass_plan(spark: SparkSession, mode: str) -> DataFrame:
    return spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(PASSES[mode])], "pass_no int, pass string, share double")


def pass_quota(max_highlights: F.Column, share: F.Column) -> F.Column:
    return F.greatest(F.lit(3), F.round(max_highlights * share).cast("int"))


# The wording of requests.
LISTED = "ALREADY SELECTED (do not return these again):"
COURSE, HANDOUT, CONTENT = "Course: ", "\nHandout: ", "\nHANDOUT CONTENT:"


def exclusion_list(texts: F.Column, most: int = 60, preview: int = 90) -> F.Column:
    """What is selected already, numbered, cut to previews; null if nothing is."""
    lines = F.transform(F.slice(texts, 1, most), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(t, 1, preview)))
    more = F.when(F.size(texts) > most, F.array(F.concat(F.lit("...and "), (F.size(texts) - most).cast("string"), F.lit(" more.")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(texts) > 0, F.array_join(F.concat(F.array(F.lit(""), F.lit(LISTED)), lines, more), "\n"))


def build_requests(chunks: DataFrame, selected: DataFrame, mode: str) -> DataFrame:
    """A row for each chunk and pass with its user text. ``chunks`` also has course and file_name; ``selected``: doc_id, chunk_no, texts."""
    plan = F.broadcast(pass_plan(chunks.sparkSession, mode))  # three rows at most
    rows = chunks.join(selected, ["doc_id", "chunk_no"], "left").join(plan)
    quota = pass_quota(F.col("max_highlights"), F.col("share"))
    known = F.when(F.col("pass_no") > 0, exclusion_list(F.coalesce("texts", F.array().cast("array<string>"))))
    head = F.concat(F.lit(COURSE), "course", F.lit(HANDOUT), "file_name", F.lit("\nReturn at most "), quota.cast("string"), F.lit(" highlights for this content."))
    return rows.select("doc_id", "chunk_no", "pass_no", "pass", quota.alias("quota"), F.concat_ws("\n", head, known, F.lit(CONTENT), "content").alias("message"))


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejects) of replies (doc_id, chunk_no, pass_no, reply).

    A fenced block goes before the text around it; from the first brace to the last it must be JSON with an array
    ``highlights``. Entries without text or of unknown importance are dropped.
    """
    fenced = F.regexp_extract("reply", r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.col("reply").rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(F.col("reply"))
    first, last = F.instr(body, F.lit("{")), F.length(body) - F.instr(F.reverse(body), F.lit("}")) + 1
    has = (first > 0) & (F.instr(body, F.lit("}")) > 0) & (last >= first)
    json = F.when(has, F.substring(body, first, last - first + 1))
    parsed = replies.withColumn("json", json).withColumn("v", F.try_parse_json("json"))
    list_ = F.try_variant_get("v", "$.highlights", "array<variant>")
    parsed = parsed.withColumn("list", list_).withColumn("error", F.when(F.col("json").isNull(), "no JSON object").when(F.col("v").isNull(), "not valid JSON").when(F.col("list").isNull(), "no highlights array"))
    rejects = parsed.filter("error IS NOT NULL").select("doc_id", "chunk_no", "pass_no", "error")
    entries = parsed.filter("error IS NULL").select("doc_id", "chunk_no", "pass_no", F.posexplode("list").alias("pos", "e"))
    typed = lambda k: F.when(F.schema_of_variant(F.try_variant_get("e", f"$.{k}", "variant")) == "STRING", F.try_variant_get("e", f"$.{k}", "string"))
    fields = entries.select("doc_id", "chunk_no", "pass_no", "pos", typed("text").alias("text"), typed("importance").alias("importance"), F.substring(F.coalesce(typed("reason"), F.lit("")), 1, 120).alias("reason"))
    return fields.filter("trim(text) <> '' AND importance IN ('low', 'medium', 'high')"), rejects


def count_requests(passes: DataFrame) -> DataFrame:
    """Requests of each document: every pass of a chunk up to its first failure, that one included."""
    failed = F.min(F.when(~F.col("ok"), F.col("pass_no"))).over(Window.partitionBy("doc_id", "chunk_no"))
    return passes.withColumn("failed", failed).filter("failed IS NULL OR pass_no <= failed").groupBy("doc_id").agg(F.count(F.lit(1)).alias("requests"))


def union_passes(candidates: DataFrame, passes: DataFrame) -> DataFrame:
    """Candidates (doc_id, chunk_no, pass_no, pos ...) of the passes that count, with ``cand_no`` from 0 in the order of chunks, passes and places."""
    kept = candidates.join(merge_passes(passes).select("doc_id", "chunk_no", "pass_no"), ["doc_id", "chunk_no", "pass_no"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy("chunk_no", "pass_no", "pos")
    return kept.withColumn("cand_no", F.row_number().over(order) - 1)


def analyze(pages: DataFrame, source: Callable[[DataFrame], DataFrame] | DataFrame, mode: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """(candidates, rejects) of documents: ``source`` is a table of replies, or makes one (doc_id, chunk_no, pass_no, reply) of their chunks.

    A source that makes replies is asked once: what it answers is written, as candidates, rejects and passes are read from it in turn. So are
    the pages, which chunks need twice, and the few rejects.
    """
    replies = source
    if callable(source):
        replies = cut(source(build_chunks(cut(pages.select("doc_id", "page", "raw")), mode)).select("doc_id", "chunk_no", "pass_no", "reply"))
    candidates, rejects = parse_replies(replies)
    rejects = cut(rejects)
    bad = rejects.select("doc_id", "chunk_no", "pass_no").withColumn("bad", F.lit(True))
    passes = replies.select("doc_id", "chunk_no", "pass_no").join(bad, ["doc_id", "chunk_no", "pass_no"], "left").select("doc_id", "chunk_no", "pass_no", F.col("bad").isNull().alias("ok"))
    return union_passes(candidates, passes), rejects


def merge_passes(passes: DataFrame) -> DataFrame:
    """Passes (doc_id, chunk_no, pass_no, ok) that count: those before a chunk's first failure; a failed primary pass takes the document."""
    chunk = Window.partitionBy("doc_id", "chunk_no")
    failed = F.min(F.when(~F.col("ok"), F.col("pass_no"))).over(chunk)
    lost = passes.filter("pass_no = 0 AND NOT ok").select("doc_id").distinct()
    return passes.withColumn("failed", failed).filter("failed IS NULL OR pass_no < failed").drop("failed").join(lost, "doc_id", "left_anti")
