"""Golden cases of text functions, cues, location, claims, chunks and replies."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import claim, cues, layout, request_log, requests
from quillspan.settings import PRESETS

DEFINITION = "Inflation is a sustained increase in the general price level of an economy."
CONCEPT = "Demand pull inflation occurs when aggregate demand exceeds aggregate supply."


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "folded"), [("ﬁrst", "first"), ("“Data” – info", '"data" - info'), ("co­op", "coop"), (" A\t\nB ", " a b "), ("a…b", "a...b"), ("x \n\t y\r\nz  é", "x y z é"), ("x\u00a0\u200b \u2003y", "x y"), ("", ""), (None, None)])
def test_fold(spark, text, folded):
    assert one(spark, T.fold_text, text) == folded


def test_scalars(spark):
    assert one(spark, T.normalize_quote, "normali-\nsation of cost-benefit") == "normalisation of cost-benefit"
    assert one(spark, T.split_sentences, "one two. three: four") == ["one two.", "three:", "four"]
    assert one(spark, lambda t: T.bounded_levenshtein(t, F.lit("sitting"), F.lit(10)), "kitten") == 3
    assert one(spark, lambda t: T.bounded_levenshtein(t, F.lit("zzzzzzzz"), F.lit(2)), "abcdefgh") == 3
    assert one(spark, T.anchor_tokens, "a long enough needle with needle") == ["enough", "needle", "long", "with"]
    assert one(spark, lambda t: T.occurrences(t, F.lit("aa")), "aaaa b aa") == [0, 2, 7]


def test_sentences_keep_digits_at_their_ends(spark):
    assert one(spark, T.split_sentences, "0 a 0. 16.195.23.11.   2 and 2: 3") == ["0 a 0.", "16.195.23.11.", "2 and 2:", "3"]
    assert one(spark, T.split_sentences, "so it ends. password=a1") == ["so it ends.", "password=a1"]


def test_cues(spark):
    texts = ["inflation is defined as a sustained increase in the general price level of an economy.", "the law of demand states that the quantity demanded falls as the price of a good rises.", "there are four main types of market structure studied in introductory courses.", DEFINITION.lower()]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("d", 9, " ".join(f"item {i} is defined as one distinct element of the overall scheme." for i in range(40)))], "doc_id string, page int, normalized string")
    rows = cues.cue_sweep(pages).collect()
    assert {r.page: r.reason for r in rows} == {0: "Definition (rule sweep)", 1: "Formula or rule (rule sweep)", 2: "Classification (rule sweep)", 9: "Definition (rule sweep)"}
    assert sum(r.page == 9 for r in rows) == 14


def test_match(spark):
    page0 = f"{DEFINITION} {CONCEPT} the first half of a quote ends here.".lower()
    pages = spark.createDataFrame([("d", 0, page0), ("d", 1, "the second half of it begins on this page.")], "doc_id string, page int, normalized string")
    quotes = [(DEFINITION, "high"), (DEFINITION, "low"), ("price", "high"), ("an entirely invented text that is nowhere", "high"), (CONCEPT.replace("occurs", "ocurs"), "medium"), ("The first half of a quote ends here. The second half of it begins on this page.", "low")]
    candidates = spark.createDataFrame([("d", i, t, k) for i, (t, k) in enumerate(quotes)], "doc_id string, cand_no int, text string, importance string")
    matched, failures = claim.match_highlights(pages, candidates, PRESETS["complete"])
    got = {(r.cand_no, r.page): r for r in matched.collect()}
    assert set(got) == {(0, 0), (4, 0), (5, 0), (5, 1)} and got[0, 0].confidence == 1.0 and 0.9 < got[4, 0].confidence < 1
    assert got[5, 0].group_id == got[5, 1].group_id == 2
    assert {r.cand_no: r.reason for r in failures.collect()} == {1: claim.REPEAT, 2: claim.SHORT, 3: claim.MISSING}


def test_chunks_and_replies(spark):
    pages = spark.createDataFrame([("d", i, "word " * 2000 if i != 2 else " ") for i in range(5)], "doc_id string, page int, raw string")
    assert [r.pages for r in requests.build_chunks(pages).orderBy("chunk_no").collect()] == [[0], [1], [3], [4]]
    replies = ['```json\n{"highlights":[{"text":"a b","importance":"high","reason":1},{"text":" ","importance":"low"},{"text":"x","importance":"vital"},3]}\n```', "none", "{bad}", '{"other":1}']
    table = spark.createDataFrame([("d", 0, i, r) for i, r in enumerate(replies)], "doc_id string, chunk_no int, pass_no int, reply string")
    good, bad = requests.parse_replies(table)
    assert [(r.text, r.importance, r.reason) for r in good.collect()] == [("a b", "high", "")]
    assert {r.pass_no: r.error for r in bad.collect()} == {1: "no JSON object", 2: "not valid JSON", 3: "no highlights array"}


def test_layout_and_ladder(spark):
    runs = [("d", 0, i, s, x, y, 40.0, 11.0, 11.0) for i, (s, x, y) in enumerate([("Infor-", 50.0, 700.0), ("mation", 50.0, 680.0), ("is", 100.0, 680.0), ("new", 50.0, 660.0)])]
    pages, _ = layout.assemble_page_text(spark.createDataFrame(runs, "doc_id string, page int, run_no int, str string, x double, y double, width double, height double, font_size double"))
    assert pages.first().normalized == "information is new"
    log = [(i, i, "k", o, m) for i, (o, m) in enumerate([("rate-limit", "slow"), ("rate-limit", "slow"), ("network", ""), ("success", None), ("rate-limit", "per day"), ("auth", "")])]
    table = spark.createDataFrame(log, "request_id long, ts long, key string, outcome string, message string")
    assert [(r.state, r.rest_s) for r in request_log.cooldown_ladder(table).orderBy("request_id").collect()] == [("cooling", 20), ("cooling", 45), ("cooling", 5), ("idle", None), ("exhausted", None), ("disabled", None)]


def test_natural_key(spark):
    names = ["a2", "a10", "a", "A1b3", "a123456789012345678901", "a123456789012345678902", "a9" + "0" * 40, "b007", "b7"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.natural_key(F.col("n")).alias("k")).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.k, r.n))] == ["a", "A1b3", "a2", "a10", "a123456789012345678901", "a123456789012345678902", "a9" + "0" * 40, "b007", "b7"]


def test_list_files(spark, tmp_path):
    from quillspan.operators import report
    from quillspan.sources import list_files

    for name in ("my(1)", "data/data"):
        root = tmp_path / name
        for path in ("CS101/a.pdf", "CS101/deep/b.PDF", "c.pdf", "CS101/notes.txt"):
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_bytes(b"12345")
        for given in (str(root), f"file://{root}/"):
            files = list_files(spark, given)
            assert {(r.path, r.size) for r in files.collect()} == {(p, 5) for p in ("CS101/a.pdf", "CS101/deep/b.PDF", "c.pdf", "CS101/notes.txt")}
        assert {(r.course, r.doc_id) for r in report.scan_corpus(files).collect()} == {("CS101", "CS101/a.pdf"), ("CS101", "CS101/deep/b.PDF"), ("Uncategorized", "Uncategorized/c.pdf")}


def test_noise_names(spark):
    from quillspan.operators import cues

    page = spark.createDataFrame([(1, 0, "sold by corner.shop, whereas all of the other books are not. this differs from all of the other books.")], "doc_id long, page int, normalized string")
    assert [r.sent_no for r in cues.cue_sweep(page).collect()] == [0, 1]
    assert [r.sent_no for r in cues.cue_sweep(page, noise=cues.noise_with("Corner.Shop")).collect()] == [1]


def test_read_table(spark, tmp_path, monkeypatch):
    from quillspan import sources

    path = str(tmp_path / "t.parquet")
    spark.range(100, numPartitions=1).write.parquet(path)
    spread = sources.read_table(spark, path, "id")
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread.collect()) == list(range(100))
    monkeypatch.setattr(sources, "SPREAD_BYTES", 0)
    assert sources.read_table(spark, path, "id").rdd.getNumPartitions() == 1


def test_snap_to_words_of_any_length(spark):
    """Words longer than what is searched first, and spans at a text's ends, against a plain version."""
    text = "a" * 200 + " é-" + "b" * 64 + " " + "c" * 63 + ", x"
    inside = lambda i: 0 < i < len(text) and text[i].isalnum() and text[i - 1].isalnum()

    def snapped(start, end):
        while inside(start):
            start -= 1
        while inside(end):
            end += 1
        return start, end

    spans = [(s, e) for s in (0, 1, 63, 64, 65, 150, 199, 200, 202, 204, 266, 267, 268, 300, 330) for e in (10, 199, 201, 230, 267, 331, len(text)) if s < e]
    start, end = T.snap_to_words(F.lit(text), F.col("s"), F.col("e"))
    rows = spark.createDataFrame(spans, "s int, e int").select("s", "e", start.alias("a"), end.alias("b")).collect()
    assert {(r.s, r.e): (r.a, r.b) for r in rows} == {(s, e): snapped(s, e) for s, e in spans}
