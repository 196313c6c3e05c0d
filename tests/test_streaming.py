"""Streams over files, run to the end of what is there."""

from datetime import datetime, timedelta

from pyspark.sql import Row

from quillspan import streaming
from quillspan.operators import request_log
from quillspan.streaming import _Cooldown
from quillspan.streaming.ladder import _Ladder

START = datetime(2024, 1, 1, 12)


def _rows(spark, stream, name, mode):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_usage_and_duplicates(spark, tmp_path):
    log = spark.createDataFrame([(START + timedelta(seconds=i), i % 2) for i in range(9)], "ts timestamp, key long")
    log.write.parquet(f"{tmp_path}/log")
    read = lambda: spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    got = {r.key: (str(r.day), r.used, r.exhausted) for r in _rows(spark, streaming.daily_usage(read(), 5), "usage", "complete")}
    assert got == {0: ("2024-01-01", 5, True), 1: ("2024-01-01", 4, False)}
    assert {r.key: (r.requests, r.over) for r in _rows(spark, streaming.rate(read(), 4), "rate", "complete")} == {0: (5, True), 1: (4, False)}
    quotes = spark.createDataFrame([(START, 1, "A  Quote"), (START, 1, "a quote "), (START, 2, "a quote"), (START, 1, " ")], "ts timestamp, doc_id long, text string")
    quotes.write.parquet(f"{tmp_path}/quotes")
    found = _rows(spark, streaming.dedupe(spark.readStream.schema(quotes.schema).parquet(f"{tmp_path}/quotes")), "quotes", "append")
    assert sorted((r.doc_id, r.key_text) for r in found) == [(1, "a quote"), (2, "a quote")]


def test_cooldown_and_documents(spark, tmp_path):
    outcomes = ["rate-limit", "rate-limit", "network", "rate-limit", "success", "rate-limit"]
    outcomes += ["timeout", "rate-limit", "rate-limit", "auth"]
    said = {8: "Daily limit"}
    log = spark.createDataFrame([(START + timedelta(seconds=i), i, k, o, said.get(i)) for k in (1, 2) for i, o in enumerate(outcomes)], "ts timestamp, request_id long, key long, outcome string, message string")
    log.write.parquet(f"{tmp_path}/log")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rests = streaming.drained(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), streaming.cooldown, "append", [])
    want = [(0, "cooling", 20, 1), (1, "cooling", 45, 2), (2, "cooling", 5, 2), (3, "cooling", 90, 3), (5, "cooling", 20, 4), (6, "cooling", 5, 4), (7, "cooling", 45, 5), (8, "exhausted", None, 6), (9, "disabled", None, 6)]
    got = sorted((r.key, r.request_id, r.state, r.rest_s, r.total, r.day_over, r.off) for r in rests.collect())
    assert got == [(k, *w, w[0] >= 8, w[0] == 9) for k in (1, 2) for w in want]
    ladder = request_log.cooldown_ladder(log).filter("state <> 'idle'")
    assert sorted((r.key, r.request_id, r.state, r.rest_s) for r in ladder.collect()) == [g[:4] for g in got]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    read = lambda: spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")
    for want in ([1, 2], [1, 2, 3]):  # a second start reads only what is new
        query = streaming.documents(read(), lambda df: df.select("doc_id"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.processAllAvailable()
        query.stop()
        assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
        assert set(spark.read.parquet(f"{tmp_path}/out").columns) == {"doc_id", "batch"}
        spark.createDataFrame([(3, "three")], docs.schema).write.mode("append").parquet(f"{tmp_path}/docs")


def test_a_batch_that_is_run_again(spark, tmp_path):
    """After a crash a batch is run again; its rows don't come twice."""
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    read = lambda: spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")
    for checkpoint in ("first", "lost"):  # a lost checkpoint gives the same batch again
        streaming.documents(read(), lambda df: df.select("doc_id"), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", once=True).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_a_key_sends_few_messages_to_its_store():
    """Rows come as rows, not as a frame for each key, and a new key's requests aren't read back from the store."""
    calls = []

    class Store:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *a: calls.append((self.name, call))

    class Handle:
        getListState = getValueState = lambda self, name, schema: Store(name)
        registerTimer = lambda self, at: calls.append(("timer", at))

    class Passed:
        getCurrentWatermarkInMs = lambda self: 7

    rows = [Row(us=us, request_id=us, outcome="rate-limit", daily=False) for us in (9000, 5000, 8000)]
    ladder = _Ladder()
    ladder.init(Handle())
    assert [tuple(r) for r in ladder.handleInputRows((1,), iter(rows), Passed())] == [(1, 5000, 5000, "cooling", 20, 1, False, False)]
    assert calls == [("state", "get"), ("held", "appendList"), ("state", "update"), ("timer", 8)]
    calls.clear()
    rests = _Cooldown()
    rests.init(Handle())
    assert [r.request_id for r in rests.handleInputRows((1,), iter(rows), Passed())] == [5000, 8000, 9000]
    assert calls == [("streak", "get"), ("streak", "update")]
