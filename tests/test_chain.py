"""Progress that outlives a run, whole documents as a stream, coverage of overlapping spans, and rests in the order of event time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspan import streaming
from quillspan.operators import report
from quillspan.sources import progress
from quillspan.streaming.chain import process_stream, results
from quillspan.streaming.ladder import cooldown_events

START = datetime(2024, 1, 1, 12)


def _states(spark, rows):
    return spark.createDataFrame(rows, progress.STATUS)


def _now(spark, store):
    return sorted((r.root, r.doc_id, r.status, r.highlight_count, r.batch) for r in progress.current(spark, store).collect())


def test_progress(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert _now(spark, store) == []
    progress.compact(spark, store)  # nothing to do
    progress.append(_states(spark, [("a", 1, "pending", 0, None), ("a", 2, "pending", 0, None), ("b", 1, "failed", 0, "x")]), store, 0)
    progress.append(_states(spark, [("a", 1, "completed", 5, None)]), store, 2)
    progress.append(_states(spark, [("a", 1, "failed", 0, "late"), ("a", 2, "skipped", 0, None)]), store, 1)
    want = [("a", 1, "completed", 5, 2), ("a", 2, "skipped", 0, 1), ("b", 1, "failed", 0, 0)]
    assert _now(spark, store) == want
    # A job that is killed before its manifest row leaves a table that nobody reads.
    _states(spark, [("a", 1, "pending", 9, None)]).withColumn("batch", F.lit(9).cast("long")).withColumn("written", F.lit(9).cast("long")).write.parquet(f"{store}/rows/orphan")
    for _ in range(2):
        progress.compact(spark, store)
        assert _now(spark, store) == want
    assert len(progress._live(spark, store)) == 1
    # Batches that come late or again, after a compaction.
    progress.append(_states(spark, [("a", 2, "pending", 0, None), ("b", 1, "pending", 0, None)]), store, 0)
    assert _now(spark, store) == [want[0], want[1], ("b", 1, "pending", 0, 0)]
    progress.append(_states(spark, []), store, 3)
    assert _now(spark, store)[0] == want[0]


def test_two_compactions_at_once(spark, tmp_path):
    store = f"{tmp_path}/store"
    for batch in range(3):
        progress.append(_states(spark, [("a", batch % 2, "completed", batch, None)]), store, batch)
    names = progress._live(spark, store)
    for _ in range(2):
        progress._write(progress._last(spark, store, names, progress.STATUS, ("root", "doc_id")), store, names)
    assert _now(spark, store) == [("a", 0, "completed", 2, 2), ("a", 1, "completed", 1, 1)]


def test_union_coverage(spark):
    rng = random.Random(5)
    pages = [(d, p, "x" * n) for d, p, n in ((1, 0, 60), (1, 1, 0), (2, 0, 40), (2, 1, 30))]
    spans = [(1, 0, s, s + rng.randint(0, 25)) for s in (rng.randint(0, 55) for _ in range(6))] + [(2, 0, 5, 10), (2, 0, 5, 10), (2, 0, 6, 8), (2, 0, 35, 90), (1, 1, 0, 4)]
    got = report.union_coverage(spark.createDataFrame(pages, "doc_id long, page int, normalized string"), spark.createDataFrame(spans, "doc_id long, page int, start int, end int"))
    want = {}
    for d, p, text in pages:
        under = {i for a, b, s, e in spans if (a, b) == (d, p) for i in range(s, min(e, len(text)))}
        want[d, p] = (len(text), len(under), len(under) / len(text) if text else 0.0)
    assert {(r.doc_id, r.page): (r.chars, r.covered, r.union_share) for r in got.collect()} == want


_TEXTS = {i: f"text number {i}" * i for i in range(1, 8)}


def _chain(docs):
    """A short chain, as the whole one is compared with SQL. Fails where the text says so, as on a document on which a function raises."""
    bad = F.when(F.contains("text", F.lit("poison")), F.raise_error(F.lit("cannot read it"))).otherwise(F.col("text"))
    rows = docs.withColumn("text", bad.cast("string"))
    return {"coverage": rows.select("doc_id", F.length("text").alias("chars")), "totals": rows.select("doc_id", F.length("text").alias("highlight_count"))}


def _run(spark, folder, checkpoint, most=20):
    schema = "doc_id long, text string"
    stream = spark.readStream.schema(schema).parquet(f"{folder}/docs")
    process_stream(stream, _chain, f"{folder}/out", f"{folder}/{checkpoint}", "here", once=True, most=most).awaitTermination()


def _tables(spark, folder):
    show = lambda name: sorted(map(tuple, results(spark, f"{folder}/out", name).collect()))
    return {name: show(name) for name in ("coverage", "totals")}


def test_stream_of_whole_documents(spark, tmp_path):
    docs = [(i, t) for i, t in _TEXTS.items()] + [(5, "poison in it"), (8, "poison"), (9, None), (None, "no id"), (1, None), (10, "")]
    docs = [d for d in docs if d != (5, _TEXTS[5])]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    _run(spark, tmp_path, "first")
    good = spark.createDataFrame([(i, t) for i, t in _TEXTS.items() if i != 5] + [(10, "")], "doc_id long, text string")
    want = {name: sorted(map(tuple, table.collect())) for name, table in _chain(good).items()}
    assert _tables(spark, tmp_path) == want
    states = {r.doc_id: (r.status, r.error) for r in progress.current(spark, f"{tmp_path}/out/progress").collect()}
    assert {d for d, s in states.items() if s == ("completed", None)} == {1, 2, 3, 4, 6, 7, 10}
    assert states[9] == ("failed", "no text") and "cannot read it" in states[5][1] and states[8][0] == "failed"
    held = spark.read.parquet(f"{tmp_path}/out/quarantine")
    assert sorted((r.doc_id or 0, r.text or "") for r in held.collect()) == [(0, "no id"), (1, ""), (5, "poison in it"), (8, "poison"), (9, "")]
    # A lost checkpoint gives the same batch again; nothing comes twice.
    _run(spark, tmp_path, "second")
    assert _tables(spark, tmp_path) == want and spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 5
    # A document that comes again, mended, has its last results only.
    spark.createDataFrame([(5, _TEXTS[5]), (1, _TEXTS[2])], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    _run(spark, tmp_path, "second")
    got = _tables(spark, tmp_path)
    assert len([r for r in got["totals"] if r[0] in (1, 5)]) == 2
    assert [r for r in got["coverage"] if r[0] not in (1, 5)] == [r for r in want["coverage"] if r[0] != 1]
    lengths = dict(got["coverage"])
    assert lengths[1] == lengths[2] and lengths[5] == len(_TEXTS[5])


def test_a_broken_job_is_no_poisoned_document(spark, tmp_path):
    spark.createDataFrame([(i, "poison") for i in range(4)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    with pytest.raises(Exception, match="cannot read it"):
        _run(spark, tmp_path, "first", most=2)
    assert progress.current(spark, f"{tmp_path}/out/progress").count() == 0


def _plain_events(rows, passed):
    """Rows (ts, request_id, outcome, daily) of one key, in order."""
    streak, total, day, off, until, out = 0, 0, None, False, None, []
    for ts, i, outcome, daily in sorted(rows):
        if ts >= passed:
            break
        if until and until <= ts:
            out.append((until, None, "ready", None))
            until = None
        if outcome == "success":
            streak = 0
        elif outcome == "auth":
            until = None
            out.append((ts, i, "disabled", None))
        elif outcome == "rate-limit":
            total += 1
            if daily and total >= 2:
                until = datetime(ts.year, ts.month, ts.day) + timedelta(days=1)
                out.append((ts, i, "exhausted", None))
            else:
                rest = (20, 45, 90, 180, 300)[min(streak, 4)]
                streak += 1
                until = ts + timedelta(seconds=rest)
                out.append((ts, i, "cooling", rest))
        else:
            until = ts + timedelta(seconds=5)
            out.append((ts, i, "cooling", 5))
    if until and until < passed:
        out.append((until, None, "ready", None))
    return out


def test_rests_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], START
    for i in range(240):
        at += timedelta(seconds=rng.choice([0, 3, 20, 60, 600, 1500]), microseconds=rng.choice([0, 0, 1500]))
        rows.append((at, i, i % 3, rng.choice(["rate-limit"] * 4 + ["success", "network", "timeout"] + ["auth"] * (i % 11 == 0)), rng.choice(["Daily limit", "slow", None])))
    schema = "ts timestamp, request_id long, key long, outcome string, message string"
    # Each file is a micro-batch of rows out of order, within the delay of the watermark.
    slices = [rows[i : i + 60] for i in range(0, 240, 60)]
    for a, b in zip(slices, slices[1:]):
        a[-8:], b[:8] = b[:8], a[-8:]
    for n, part in enumerate(slices):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    got = streaming.drained(stream, lambda s: cooldown_events(s, "10 hours"), "append", []).collect()
    last = max(r[0] for r in rows)
    passed = last.replace(microsecond=last.microsecond // 1000 * 1000) - timedelta(hours=10)
    for key in range(3):
        want = _plain_events([(ts, i, o, "Daily" in (m or "")) for ts, i, k, o, m in rows if k == key], passed)
        assert len(want) > 20 and {"ready", "cooling", "exhausted"} <= {w[2] for w in want}
        assert sorted(map(str, ((r["at"], r.request_id, r.state, r.rest_s) for r in got if r.key == key))) == sorted(map(str, want))
