"""Word files, written results, order over a table, and sources with memory."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import layout, replies, requests
from quillspan.operators.order import ranked, scan_order
from quillspan.sources import words, write_results
from quillspan.functions.text import collated_key


def _file(root, path, rows):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text("\n".join([words.HEADER, *("\t".join(map(str, r)) for r in rows)]) + "\n", encoding="utf-8")


def _size(page):
    return (1, page, 0, 0, 0, 0, 0, 0, 1190, 1684, -1, "")


def _word(page, line, n, text, confidence=90):
    return (5, page, 1, 1, line, n, n * 60, line * 20, 40, 12, confidence, text)


def test_word_files(spark, tmp_path):
    root = tmp_path / "my scans"
    _file(root, "CS 101/a+b%20c.v1.tsv", [_word(1, 1, 0, 'say "hi'), _size(1), (4, 1, 1, 1, 1, 0, 0, 0, 9, 9, -1, ""), _word(1, 1, 1, r"back\slash\\"), _word(1, 2, 0, "faint", 12), _word(1, 2, 1, "Infor-"), _word(1, 3, 0, "mation"), _word(1, 3, 1, "")])
    _file(root, "b.tsv", [_size(1), _word(1, 0, 0, "one"), _word(1, 0, 1, "two", "n/a"), ("short", 1), (*_word(1, 0, 2, "long"), "more"), _word(2, 0, 0, "homeless")])
    _file(root, "empty.tsv", [])
    (root / "notes.txt").write_text("not a word file")
    for given in (str(root), f"file://{root}/"):
        rows = words.read_rows(spark, given)
        found, rejects = words.words(rows, 2.0)
        texts = {(r.doc_id, r.page): r.normalized for r in layout.ocr_reading_order(found)[0].collect()}
        assert texts == {("CS 101/a+b%20c.v1", 0): r'say "hi back\slash\\ information', ("b", 0): "one"}
        told = [(r.doc_id, r.error.split("\t")[0], r.reason) for r in rejects.collect()]
        assert sorted(told) == [("b", "2", "no place on a page"), ("b", "5", "doesn't fit the columns"), ("b", "5", "doesn't fit the columns"), ("b", "short", "doesn't fit the columns")]
        assert rows.filter("error IS NOT NULL").count() == 3


def test_word_files_of_many_documents(spark, tmp_path):
    line = lambda name, r: "\t".join(map(str, (name, *r)))
    rows = [("CS 101/a", _size(1)), ("CS 101/a", _word(1, 0, 0, "one")), ("b", _word(1, 0, 0, "two", "n/a")), ("b", _size(1)), ("b", _word(1, 0, 1, 'say "hi')), ("b", ("short", 1))]
    (tmp_path / "x.tsv").write_text("\n".join([words.NAMED_HEADER, *[line(*r) for r in rows], "no tab"]) + "\n")
    (tmp_path / "y.tsv").write_text("\n".join([words.NAMED_HEADER, line("CS 101/a", _word(1, 1, 0, "more"))]) + "\n")
    read = words.read_rows(spark, str(tmp_path), named=True)
    found, rejects = words.words(read, 2.0)
    assert {(r.doc_id, r.page): r.normalized for r in layout.ocr_reading_order(found)[0].collect()} == {("CS 101/a", 0): "one more", ("b", 0): 'say "hi'}
    assert sorted((r.doc_id or "", r.reason) for r in rejects.collect()) == [("", "doesn't fit the columns"), *[("b", "doesn't fit the columns")] * 2]


def test_word_queries_write_few_files(spark):
    from quillspan.plans import results

    folder = results._word_files(spark, "/root/testdata/sf0.001")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").count()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).count()
    assert 0 < files < documents / 10


def test_word_files_as_stream(spark, tmp_path):
    root, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    run = lambda: words.read_rows(spark, str(root), stream=True).writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out)).awaitTermination()
    for name in ("a", "b"):
        _file(root, f"{name}.tsv", [_size(1), _word(1, 0, 0, name), ("x",)])
        run()
    same = lambda t: sorted(t.select("doc_id", "level", "text", "error").collect(), key=str)
    assert same(spark.read.parquet(str(out))) == same(words.read_rows(spark, str(root)))
    assert spark.read.parquet(str(out)).count() == 6


def test_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "results")
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "course string, n int")
    write_results(rows, folder)
    files = lambda: sorted(str(p.relative_to(folder)) for p in (tmp_path / "results").rglob("*.parquet"))
    before = files()
    broken = spark.range(0, 40, 1, 4).select(F.lit("C").alias("course"), F.when(F.col("id") == 39, F.raise_error("lost").cast("int")).otherwise(F.col("id").cast("int")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        write_results(broken, folder)
    assert files() == before
    write_results(spark.createDataFrame([("B", 9)], "course string, n int"), folder)
    assert sorted((r.course, r.n) for r in spark.read.parquet(folder).collect()) == [("A", 1), ("A", 2), ("B", 9)]


def test_collated_order(spark):
    # As a reader's locale sorts with numbers: letters before accents before case, over the whole name.
    names = [None, "_a", "-a", "a", "A", "a 2", "a1", "a2", "A2", "a10", "ä10", "a10b", "e1", "É1", "e2", "Z", "zz"]
    table = spark.createDataFrame([(n,) for n in reversed(names)], "n string").repartition(5)
    rows = ranked(table, [collated_key(F.col("n")), F.col("n")]).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.rank)] == names and sorted(r.rank for r in rows) == list(range(1, len(names) + 1))


def test_ranked_cases(spark):
    table = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("own"), F.col("id").alias("range"), (F.col("id") % 3).alias("rank"), F.lit(1).alias("k0"), F.lit(2).alias("a.b"))
    rows = ranked(table, [-F.col("own")]).collect()
    assert len(rows) == 5000 and all(r.rank == 5000 - r.own and (r.own, r.k0, r["a.b"]) == ((r.range * 7919) % 5000, 1, 2) for r in rows)
    repeated = ranked(spark.createDataFrame([("x",)] * 50 + [("w",)], "t string").repartition(4), [F.col("t")], "at").collect()
    assert sorted(r.at for r in repeated) == list(range(1, 52)) and [r.at for r in repeated if r.t == "w"] == [1]
    assert ranked(table.limit(0), [F.col("own")]).count() == 0
    documents = spark.createDataFrame([("c10", "c10/a.pdf"), ("c9", "c9/x10.pdf"), ("c9", "c9/X9.pdf"), ("C9", "C9/b.pdf")], "course string, path string")
    assert [r.path for r in scan_order(documents).orderBy("rank").collect()] == ["c9/X9.pdf", "c9/x10.pdf", "C9/b.pdf", "c10/a.pdf"]


def test_source_with_memory(spark):
    def answer(chunk, name, chosen):
        if "stop" in chunk["content"] and name == "gap":
            raise ValueError("no answer")
        if "lost" in chunk["content"]:
            raise KeyError("nothing")
        if "odd" in chunk["content"]:
            return [{"importance": "high"}]
        here = [w for w in chunk["content"].split("\n", 1)[1].split(" ") if w not in chosen]
        return [{"text": w, "importance": "high", "reason": str(len(chosen))} for w in here[: 1 if name == "primary" else None]]

    pages = [("a", 0, "x y x"), ("a", 1, "y z"), ("b", 0, "x stop"), ("b", 1, "x w"), ("c", 0, "x"), ("c", 1, "lost"), ("c", 2, "z"), ("d", 0, "odd"), ("é", 0, "long" * 5000), ("f", 0, "")]
    table = spark.createDataFrame(pages, "doc_id string, page int, raw string")
    source = replies.table_source(answer)
    # A chunk for each page: a page's number stands in the first line of its chunk.
    chunks = requests.build_chunks(table, budget=1)
    got = sorted((r.doc_id, r.chunk_no, r.pass_no, r.error is None) for r in source(chunks).collect())
    assert got == [("a", 0, 0, True), ("a", 0, 1, True), ("a", 1, 0, True), ("a", 1, 1, True), ("b", 0, 0, True), ("b", 0, 1, False), ("b", 1, 0, True), ("b", 1, 1, True), ("c", 0, 0, True), ("c", 0, 1, True), ("c", 1, 0, False), ("d", 0, 0, False), ("é", 0, 0, True), ("é", 0, 1, True)]
    candidates, rejects = requests.analyze(table, lambda _: source(chunks))
    assert sorted((r.doc_id, r.cand_no, r.text) for r in candidates.collect() if len(r.text) < 9) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "x"), ("b", 1, "w")]
    assert sorted((r.doc_id, r.chunk_no, r.pass_no) for r in rejects.collect()) == [("b", 0, 1), ("c", 1, 0), ("d", 0, 0)]
    assert source(chunks.limit(0)).count() == 0


def test_a_source_is_asked_once(spark):
    """Candidates, rejects and passes are read from what a source has answered."""
    asked = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame([("a", 0, "x y"), ("b", 0, "z")], "doc_id string, page int, raw string")
    count = F.udf(lambda r: asked.add(1) or r)
    chunks = requests.build_chunks(table)
    replied = chunks.select("doc_id", "chunk_no", F.lit(0).alias("pass_no"), count(F.lit('{"highlights": [{"text": "x", "importance": "high"}]}').substr(F.lit(1), F.length("content") + 99)).alias("reply"))
    candidates, rejects = requests.analyze(table, lambda _: replied)
    assert candidates.count() == 2 and rejects.count() == 0 and asked.value == 2
