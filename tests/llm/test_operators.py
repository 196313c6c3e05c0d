"""The operators against brute-force versions on a small table with nulls, empty and long texts, ties, copies and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("quillspan.llm")
from quillspan.llm import op1_mixing, op2_substrings, op3_licenses, op4_tokens, op5_language, op6_simhash, op7_extraction, op8_decontamination, op9_revisits, op10_quality, scratch  # noqa: E402
from quillspan.llm.words import NOT_SPACE, chunks, run_hashes  # noqa: E402

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(7)
VOCABULARY = [f"{a}{b}" for a in ("ta", "né", "Ko", "ri", "zu") for b in ("m", "lo", "ß", "st", "")]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(70)
LONG = prose(20_000)
ITEMS = [(1, prose(14)), (2, "Tiny Item"), (3, None), (4, ""), (5, "!!")]
TEXTS = [None, "", "  \t\n", LONG, prose(40) + " " + PASSAGE + "\n" + prose(40), PASSAGE + " " + prose(9), prose(3) + " " + PASSAGE, prose(100), "same words here", "same words here", "x" * 5000, "a | b # c\n\na | b # c\nend", prose(30) + " " + "".join(c.upper() if c.isascii() else c for c in ITEMS[0][1]) + "!", "a tiny  ITEM, tiny", "Released under the MIT License.\nUnder an Apache-License", "Licensed under the Apache License, Version 2.0.", ("ab cd ef gh ij kl mn op " * 4).strip(), "a b  c 😀"]
TEXTS += [TEXTS[4], TEXTS[7] + " more", TEXTS[7]]
SOURCES = ["b", None, "a", "a", "b", "c", "c", "a", "d", "d", "é", "a", "a", None, "b", "b", "c", "a", "a", "a", "a"]
ROWS = [(i, t, ["en", "fr", None][i % 3], s, i) for i, (t, s) in enumerate(zip(TEXTS, SOURCES, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that operators also add must not clash.
    return spark.createDataFrame([(*r, 1, "x", 2, 3.0) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, size long, target string, n_words long, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text, pattern=SPACE):
    return pattern.findall((text or "") if pattern is SPACE else (text or "").translate(LOWER))


def test_mixing(docs, empty):
    rows = op1_mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, {s: 0.0 for s in names if sizes[s] == 0}
    while True:
        free = [s for s in names if s not in full]
        left, total = sum(sizes.values()) - sum(full.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3.0 * sizes[s] for s in over}
    target |= full
    taken, count, expected = Counter(), Counter(), Counter()
    for r in rows:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        count[r.source] += r.copies
        expected[r.source] += target[r.source] / sizes[r.source] if sizes[r.source] else 0
    assert len(rows) == len(ROWS) and all(abs(count[s] - expected[s]) <= 1 for s in names)
    assert op1_mixing.emit(op1_mixing.mix(docs)).count() == sum(count.values())
    clash = docs.withColumns({c: docs["doc_id"] for c in ("own", "name", "at", "before", "from", "part", "row", "n", "words", "_source", "_at", "Copies")})
    got = op1_mixing.mix(clash)
    assert got.columns.count("before") == 1 and "Copies" not in got.columns
    assert {(r.doc_id, r.text, r.copies, r.before) for r in got.collect()} == {(r.doc_id, r.text, r.copies, r.doc_id) for r in rows}
    assert op1_mixing.mix(empty).count() == 0 and taken is not None


def test_substrings(spark, docs, empty):
    least = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            least[k] = min(i, least.get(k, i))
    expected = {}
    for i, t, *_ in ROWS:
        w, gone = words(t), set()
        for j in range(len(w) - 49):
            if least[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        expected[i] = (len(w), len(gone), [x for j, x in enumerate(w) if j not in gone])
    clash = docs.withColumns({c: docs["doc_id"] for c in ("_doc", "_spans", "row", "id", "maybe", "_slot", "_word", "_mask")})
    for group, docs in ((op2_substrings.GROUP, docs), (1, clash), (200, clash)):
        got = {r.doc_id: (r.n_words, r.n_removed, words(r.kept_text)) for r in op2_substrings.substring_dedup(docs, group=group).collect()}
        assert got == expected
    assert sum(n for _, n, _ in expected.values()) > 200
    assert op2_substrings.substring_dedup(empty).count() == 0
    again = docs.union(docs).withColumn("doc_id", docs["doc_id"] * 0)
    assert {r.n_removed for r in op2_substrings.substring_dedup(again).collect()} == {0}


def test_windows_that_share_most_words(spark):
    """Texts of 49 shared words and one of their own: none repeats another's window, though some agree in 32 bits of their last words."""
    shared = [f"w{i}" for i in range(49)]
    chunk = next(iter(chunks(pa.array([" ".join([*shared[37:], f"own{i}"]) for i in range(300_000)]), NOT_SPACE, size=1 << 30)))
    narrow = run_hashes(chunk.hashes(), 13)[::13].view(np.int64).astype(np.int32)
    _, first, n = np.unique(narrow, return_index=True, return_counts=True)
    alike = np.flatnonzero(np.isin(narrow, narrow[first[n > 1]]))
    assert len(alike) > 4
    docs = spark.createDataFrame([(int(i), " ".join([*shared, f"own{i}"])) for i in alike], "doc_id long, text string")
    assert {r.n_removed for r in op2_substrings.substring_dedup(docs).collect()} == {0}


def most_in_a_run(text, template):
    """The most distinct words of a template that a run of 1.5 times its words holds."""
    v, w = words(text, ALNUM), words(template, ALNUM)
    size, wanted = math.ceil(1.5 * len(w)), set(w)
    return max((len(wanted & set(v[a : a + size])) for a in range(max(1, len(v) - size + 1))), default=0) / max(1, len(wanted))


def test_licenses(spark, docs, empty):
    whole = op3_licenses.TEMPLATES[-2][1].split()
    notice = op3_licenses.TEMPLATES[6][1].split()
    texts = [t for t in TEXTS if t is None or len(t) < 50_000]
    texts += [" ".join(prose(500).split() + whole[:120] + ["odd"] * 30 + whole[120:]), "\n".join(whole[: len(whole) // 2]), "\n\n".join(f"# {x}" for x in notice), " ".join(f"{x} y z" for x in notice), " ".join(notice[:12] + ["far"] * 60 + notice[12:])]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(2)
    got = {r.doc_id: r for r in op3_licenses.licenses(table).collect()}
    for i, t in enumerate(texts):
        w, places, labels = words(t, ALNUM), [], set()
        for phrase, label in op3_licenses.PHRASES:
            p = phrase.split()
            found = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        shares = [(most_in_a_run(t, text), label) for label, text in op3_licenses.TEMPLATES]
        more = labels | {label for share, label in shares if share >= 0.8 - 1e-9}
        score = 1.0 if labels else max([share for share, _ in shares if share >= 0.8 - 1e-9], default=0.0)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(labels)), ",".join(sorted(more))) and math.isclose(r.score, score), t
    assert {"mit"} == {label for r in got.values() for label in r.labels.split(",") if r.doc_id == len(TEXTS) - 1}
    assert op3_licenses.licenses(docs).count() == len(ROWS) and op3_licenses.licenses(empty).count() == 0
    for templates in ((), (("x", "!!"),)):
        assert all(r.labels == r.base_labels == got[r.doc_id].base_labels for r in op3_licenses.licenses(table, templates=templates).collect())


def test_wrapped_licenses(spark):
    rows = []
    for label, t in op3_licenses.TEMPLATES:
        for width in (1, 3, 5, 9):
            for before in (0, 1, 23, 24, 25, 200):
                v = t.split()
                lines = [" * " + " ".join(v[a : a + width]) for a in range(0, len(v), width)]
                rows.append((len(rows), "\n".join([*["filler " * 7] * (before // 7), "odd " * (before % 7), *lines, "", "the end"]), label))
    rows += [(len(rows), "\n".join(["Redistribution and use in source", *["and other words"] * 40, "and binary forms, with or without modification, are permitted provided that the following conditions are met"]), "")]
    rows += [(len(rows), "Licensed under the Apache License, Version 2.0.\nDas geht mit anderem", "apache")]
    got = {r.doc_id: r for r in op3_licenses.licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, t, label in rows:
        assert got[i].labels == "apache" or "anderem" not in t
        assert (label in got[i].labels.split(",") and got[i].score == 1) if label else not got[i].labels, t
    two = [("x", "one two three"), ("long", " ".join(f"w{i}" for i in range(300)))]
    df = spark.createDataFrame([(1, "one\ntwo\nthree"), (2, "a\n" * 77 + "\n".join(f"w{i}" for i in range(300))), (3, "one\n\n" + "b " * 2 + "\ntwo three"), (4, "one\n\n" + "b " * 3 + "\ntwo three")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in op3_licenses.licenses(df, templates=two).collect()} == {1: "x", 2: "long", 3: "x", 4: ""}


def test_tokens(docs, empty):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = [("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁ta", -3.0), ("ta", -3.0), ("t", -2.5), ("m", -1.0), ("lo", -2.0), ("né", -2.0)]
    known = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], 0))
    got = {r.doc_id: r for r in op4_tokens.token_counts(docs, vocabulary).collect()}
    for i, t, *_ in ROWS:
        assert got[i].n_words == len(words(t))
        assert got[i].n_tokens == sum(len(known.encode("▁" + w).ids) for w in words(t)), i
    assert op4_tokens.token_counts(empty, vocabulary).count() == 0


def test_tokens_by_bytes(spark):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = [("▁", -2.0), ("a", -2.0), ("ab", -4.0), ("né", -2.0), *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    known = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], 0, True))
    rows = list(enumerate(["ꦲꦏ꧀ꦱꦫ", "a𓀀𓀁𓀂b né€ab", "b" * 100, "é néé\n😀😀a ñ", ("ꦲ" * 3000) + "a", None, ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in op4_tokens.token_counts(df, vocabulary).collect()}
    assert got == {i: sum(len(known.encode("▁" + w).ids) for w in words(t)) for i, t in rows}
    given = sentencepiece.SentencePieceProcessor(model_file=op4_tokens.VOCABULARY)
    counter = op4_tokens.Counter(op4_tokens.read_vocabulary())
    for text in ("ꦲꦏ꧀ꦱꦫ", "𓀀𓀁𓀂"):  # no choice of pieces, so scores don't matter
        assert counter[text.encode()] == len(given.encode(text)) > 12


def presence(text):
    """The set of hashed n-grams of 1 to 3 bytes, byte by byte."""
    b, out = text.lower().encode(), set()
    mask = (1 << 32) - 1
    for i in range(len(b)):
        h = 0
        for n, mult in zip(range(min(3, len(b) - i)), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
            h = ((h ^ (b[i + n] + n + 1)) * mult) & mask
            h ^= h >> 15
            out.add(((h * 0x2C1B3C6D) & mask) >> 19)
    return out


def test_language_by_brute_force(spark):
    """Kernel ridge regression over the whole kernel matrix, one language against the rest; all rows are landmarks."""
    import numpy as np

    kinds = {"aa": "the of and ing", "bb": "der und sch keit", "cc": "les des eau que", "dd": "ñez los gas doe"}
    rows = [(i, " ".join(rng.choice((v + " lo mi ta").split()) + rng.choice("abc") for _ in range(rng.randrange(1, 9))), k) for i, (k, v) in enumerate(list(kinds.items()) * 40)]
    rows += [(500 + i, t, None) for i, t in enumerate(["x" * 300_000, "ÄÖ ta", "½ ② Ⅷ 12", rows[0][1], rows[0][1], None])]
    table = spark.createDataFrame([(*r, True, 7) for r in rows], "doc_id long, text string, lang string, known boolean, score long").repartition(2)
    got = {r.doc_id: r for r in op5_language.identify(table).collect()}
    fit = sorted((k, t) for i, t, k in rows if k and zlib.crc32(str(i).encode()) % 3 != 1)
    sets = [presence(t) for _, t in fit]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[x == name for name in kinds] for x, _ in fit], float)
    alpha = np.linalg.solve(k + op5_language.RIDGE * len(fit) * np.eye(len(fit)), y - y.mean(0))
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        scores = np.array([kernel(presence(t), b) for b in sets]) @ alpha + y.mean(0)
        assert math.isclose(got[i].score, min(max(scores.max(), 0), 1), abs_tol=1e-3), i
        assert got[i].lang_pred == list(kinds)[int(scores.argmax())] or np.sort(scores)[-1] - np.sort(scores)[-2] < 2e-3
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_many_languages(spark):
    """No language is left out, however many there are; with more of them than landmarks the matrix stays in two factors."""
    rows = [(i, f"{chr(0x4E00 + i // 6)}{chr(0x5E00 + i // 6)} zo", f"l{i // 6}") for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    packed = op5_language.training_rows(table, "doc_id", "text", "lang", rows=100)
    learned = {k for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {k for k, _ in packed} == learned and len(packed) < 600
    languages, matrices, _ = op5_language.fit_model(packed, landmarks=50)
    assert len(languages) == len(learned) and len(matrices) == 2
    got = op5_language.predict(table, op5_language.fit_model(packed)).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)


def test_language(spark, docs, empty):
    rows = [(i, " ".join(rng.choice(("the of and ing tion" if i % 2 else "der und sch keit über").split()) + rng.choice("abcde") for _ in range(60)), "en" if i % 2 else "de") for i in range(300)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (None, "the of and", "en"), (1003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op5_language.identify(df).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang_pred == r.lang for r in held) > 0.95 * len(held)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1000, 1001, 1003))
    assert not [r for r in got if r.doc_id is None][0].held_out and all(0 <= r.score <= 1 for r in got)
    assert op5_language.identify(empty).count() == 0


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """Of (id, fingerprint), the smallest id that two-bit links reach."""
    root = {i: i for i, _ in pairs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, x) in enumerate(pairs):
        for j, y in pairs[:n]:
            if (x ^ y).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in pairs}


def test_spread_join(spark):
    rows = [(i, 1 if i % 3 else (i if i % 2 else None)) for i in range(300)]
    left = spark.createDataFrame(rows, "i long, k long")
    right = spark.createDataFrame([(k, f"{k} {n}") for k in (1, 3, 9, 500) for n in range(2)], "o long, v string")
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = scratch.spread_join(left, right, "k", "o", sizes, F.col("i"))
    got = Counter((r.i, r.k, r.v) for r in joined.collect())
    assert got == Counter((i, k, v) for i, k in rows for v in ([f"{k} {n}" for n in range(2)] if k in (1, 3, 9) else [None]))
    assert joined.columns == ["i", "k", "o", "v"] and scratch.spread_join(left.limit(0), right, "k", "o", sizes.limit(0), F.col("i")).count() == 0


def test_simhash(spark, docs, empty):
    prints = [(i, fingerprint(t)) for i, t, *_ in ROWS]
    got = {r.doc_id: r for r in op6_simhash.near_duplicates(docs).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == dict(prints)
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert op6_simhash.near_duplicates(empty).count() == 0
    near = list({x: None for b in [rng.getrandbits(64) for _ in range(8)] for _ in range(30) for x in [b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))})]})
    pairs = list(enumerate(near))
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in pairs], "fp long, rep long")
    for group in (4096, 3):
        roots = {r.node: r.root for r in op6_simhash.components(op6_simhash.links(table, group)).collect()}
        assert {i: roots.get(i, i) for i, _ in pairs} == brute_components(pairs)


def test_extraction(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One\n two.<br><p>Three &eacute;<div class="comments"><p>Nice!</div></article><aside>Side</aside><form>Mail</form><footer>&copy;</footer></body></html>'
    bare = "<div class=x>Shared line</div><p>Text {}</p>"
    rows = [(1, "http://h/a", page), (2, None, None), (3, "http://h/b", ""), (4, "odd", "just < text & more")] + [(10 + i, f"https://other.net/{i}", bare.format(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op7_extraction.extract(df).collect()}
    assert got[1] == "Head & more\n\nOne two.\n\nThree é" and got[2] == got[3] == ""
    assert got[4] == "just < text & more"
    assert all(got[10 + i] == f"Text {i}" for i in range(12))  # the branch on which all pages agree goes
    assert op7_extraction.extract(df.limit(0)).count() == 0


def test_extraction_within_blocks(spark):
    dropped = [f"<{t}>gone</{t}>" for t in "script style noscript iframe object svg math canvas select button textarea audio video map".split()]
    cases = [(f"<p>Long paragraph {x} rest</p>", "Long paragraph rest") for x in (*dropped, "<svg><g><text>gone</text></g></svg>", "<svg><path/></svg>", "<select><option>gone</select>", '<span class="ad">gone <b>gone</b></span>', "<span hidden>gone</span>", "<i role=alert>gone</i>")]
    cases += [
        ("<div>Intro <a class=related><div>gone</div></a> rest</div>", "Intro\n\nrest"),
        ("<p>Intro <button><p>gone</p></button> rest</p>", "Intro rest"),
        ("<div>Intro <noscript><div>gone</div></noscript></div>", "Intro"),
        ("<main>Intro<video>gone</video></main><p>out</p>", "Intro"),
        ('<article><p>One <a class="share">gone</a>two<br>three</p><nav>gone</nav>four</article>', "One two three\n\nfour"),
        ("<p>Intro <svg>gone", "Intro"),
        ("<p>Intro <svg><p>gone</p></svg></p><p>rest", "Intro\n\nrest"),
        ("<div class=ad>gone <b>gone</b></div>rest <b class=x>bold</b>", "rest bold"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}/", html) for i, (html, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op7_extraction.extract(df).collect()}
    assert [got[i] for i in range(len(cases))] == [text for _, text in cases]


def test_extraction_of_templates(spark):
    first = "<body><div class=a><div class=one>Same {}</div><p>Story {}</p></div></body>"
    second = "<body><div class=b><ul><li>Home</ul><p>Tale {}</p></div></body>"
    rows = [(i, first.format(i, i)) for i in range(60)] + [(100 + i, second.format(i)) for i in range(40)]
    rows += [(200 + i, "<body><div class=c><h2>Copied</h2><p>page</p></div></body>") for i in range(10)]
    rows += [(300 + i, f"<body><h4>Rare</h4><p>Text {i}</p></body>") for i in range(3)]
    rows += [(400 + i, f"<body><h4>Often</h4><p>Text {i}</p></body>") for i in range(9)]
    df = spark.createDataFrame([(i, f"http://h{i // 300 * (i // 100)}/", html) for i, html in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op7_extraction.extract(df).collect()}
    assert all(got[i] == f"Same {i}\n\nStory {i}" for i in range(60))
    assert all(got[100 + i] == f"Tale {i}" for i in range(40))  # a template of a third of the host
    assert all(got[200 + i] == "Copied\n\npage" for i in range(10))
    assert all(got[300 + i] == f"Rare\n\nText {i}" for i in range(3))  # three pages tell little
    assert all(got[400 + i] == f"Text {i}" for i in range(9))


def test_extraction_of_ordinary_pages(spark):
    deep = "<div>" * 3000 + "<p>Deep text" + "</div>" * 3000
    cases = [
        ("<html><head><title>x</title><body><p>hello world</p>", "hello world"),
        ("<title>x</title><meta name=a><p>no head", "no head"),
        ("<head><title>x</title>bare text", "bare text"),
        ("<p>important text <script>x()</script> tail</p>", "important text tail"),
        ("<div class='notice-board'>Board</div><div class='alert-list'>List</div>", "Board\n\nList"),
        ("<p>One <span class='sponsor'>gone</span> two</p>", "One two"),
        ("<div id=top-nav>gone</div><div class='site_footer2'>gone</div><div class=adSlot>gone</div><p>Text", "Text"),
        ("<article><p>Teaser</p></article><div id=content><p>The long text of the page</p></div>", "Teaser\n\nThe long text of the page"),
        ("<div class=sidebar><p>All there is</p></div>", "All there is"),
        ("<div class=ad>gone</div><article></article>", ""),
        ("<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Mail</a></div><p>See <a href=4>this</a>, that and more.</p>", "See this, that and more."),
        (deep, "Deep text"),
        ("<p>" + "word " * 200_000, ("word " * 200_000).strip()),
        ("<<p>a &lt; b &amp;amp; c &#x41;</p>", "<\n\na < b &amp; c A"),
    ]
    rows = [(i, f"http://h{i}/", html, 1, "x") for i, (html, _) in enumerate(cases)]
    df = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string, host long, texts string")
    got = [(r.page_id, r.text) for r in op7_extraction.extract(df).collect()]
    assert sorted(got) == sorted((i, cases[i][1]) for i in [*range(len(cases)), 0, 1])


def test_extraction_by_the_tree(spark):
    """Menus that name nothing, in one of a few forms on each page; evidence is compared with a brute-force version."""
    menus, ends = ["<b>Home</b> | News", "<b>Start</b> | Blog", "<b>Top</b> | All"], ["Write to us", "Write us"]
    page = "<body><div>{}</div><div><h1>Title {}</h1><p>Story {}</p><p>Read more.</p></div><div><p>{}</p></div></body>"
    rows = [(i, page.format(menus[i % 3], i // 2, i, ends[i % 2])) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(3)]
    df = spark.createDataFrame([(i, "https://site.org/x", html) for i, html in rows], "page_id long, url string, html string")
    for priors, most in ((True, 200_000), (False, 200_000), (True, 0)):
        got = {r.page_id: r.text for r in op7_extraction.extract(df, priors=priors, broadcast_rows=most).collect()}
        assert all(got[i] == f"Title {i // 2}\n\nStory {i}\n\nRead more." for i in range(200))
    parsed = op7_extraction.parse(df, "page_id", "url", "html")
    nodes = sorted((r.pages, round(r.evidence, 9)) for r in op7_extraction.importance(parsed).collect())

    def entropy(values):
        n = Counter(values)
        return -sum(c / len(values) * math.log(c / len(values)) for c in n.values())

    ids = [i if i < 1000 else 0 for i, _ in rows]
    expected = []
    # Of each node: contents, presentations and pages of its occurrences.
    for content, shape, per_page in ((lambda i: i % 3, None, 1), (lambda i: i, None, 1), (lambda i: i // 2, None, 1), (lambda i: i % 2, None, 2)):
        h = entropy(ids)
        values = [content(i) for i in ids]
        share = 0.9 * min(1, entropy(values) / h)
        n = math.exp(h) - 1
        expected.append((len(ids) * (2 if per_page == 2 else 1) // per_page, (4 + n * share) / (4 + n)))
    # menu, middle, title, and the end as a box and as its paragraph; the middle's paragraphs are one node.
    middle = [x for i in ids for x in (("s", i), "more")]
    h = entropy(ids)
    n = math.exp(h) - 1
    expected += [(len(ids), expected[3][1]), (2 * len(ids), (4 + n * 0.9 * min(1, entropy(middle) / h)) / (4 + n))]
    assert nodes == sorted((a, round(b, 9)) for a, b in expected)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = {}
    for i, t, *_ in ROWS:
        w, hit, names = words(t, ALNUM), set(), set()
        for name, text in ITEMS:
            v = words(text, ALNUM)
            m = min(10, len(v))
            grams = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if v else set()
            for j in range(len(w) - m + 1):
                if m and tuple(w[j : j + m]) in grams:
                    hit |= set(range(j, j + m))
                    names.add(str(name))
        expected[i] = (len(w), len(hit), sorted(names))
    for size in (1 << 20, 40):
        found = op8_decontamination.contamination(docs, items, block_bytes=size)
        got = {r.doc_id: (r.n_words, r.n, list(r["items"])) for r in found.withColumn("n", op8_decontamination.n_hit()).collect()}
        assert got == expected
        assert found.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "spans", "items"]
        assert op8_decontamination.contamination(docs.union(docs), items, block_bytes=size, keep_text=False).count() == 2 * len(ROWS)
    assert sum(n > 0 for _, n, _ in expected.values()) >= 2
    assert op8_decontamination.contamination(empty, items).count() == 0
    assert {r["items"][0] if r["items"] else None for r in op8_decontamination.contamination(docs, items.limit(0)).collect()} == {None}


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com/x/?utm_source=q", 1, "response", {"ETag": '"1"', "Content-Type": "t"}),
        (2, "https://a.com/x#f", 2, "revisit", {"etag": 'W/"1"', "Date": "d", "Server": "s"}),
        (3, "http://a.com/x", 3, "response", {"ETag": '"2"'}),
        (4, "http://a.com/x", 4, "revisit", {"ETag": '"1"'}),
        (5, "http://b.com", 5, "revisit", None),
        (8, "http://c.com", 1, "response", {"ETag": '"9"', "VIA": "a", "Via": "b", "via": "c", "x": None}),
        (9, "http://c.com", 2, "revisit", {"ETag": '"9"', "etag": '"9"', "Date": "d"}),
        (10, "http://d.com", 1, "response", {"ETag": '"9"'}),
        (10, "http://d.com", 1, "response", {"ETag": '"9"'}),
        (11, "http://d.com", 1, "revisit", {"ETag": '"9"'}),
        (None, "http://d.com", 1, "revisit", {"ETag": '"9"'}),
        (6, "http://a.com/x", 6, "revisit", {}),
        (7, None, None, "revisit", {}),
    ] + [(100 + i, "http://hot.com/", 10 + i, "response" if i == 0 else "revisit", {"Last-Modified": "m"}) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id long, url string, ts long, kind string, headers map<string,string>, target_url string, _part long")
    got = {r.record_id: r for r in op9_revisits.resolve(df).collect()}
    assert {i: (got[i].response_id, got[i].state) for i in (2, 4, 5, 6, 7)} == {2: (1, "resolved"), 4: (3, "mismatch"), 5: (None, "orphan"), 6: (3, "unvalidated"), 7: (None, "orphan")}
    assert (got[9].state, got[9].headers) == ("mismatch", {"etag": '"9", "9"', "date": "d"})
    assert (got[11].response_id, got[11].state, got[None].response_id) == (10, "resolved", None)  # at one time ids decide; null comes first
    assert got[2].headers == {"etag": 'W/"1"', "date": "d", "content-type": "t"}
    assert all((got[i].response_id, got[i].state) == (100, "resolved") for i in range(101, 300))
    assert op9_revisits.resolve(df.limit(0)).count() == 0


def test_revisits_by_timestamps_and_urns(spark):
    rows = [("1", "http://a.com", "2024-01-01 00:00:01.900", "response", "x"), ("2", "http://a.com", "2024-01-01 00:00:01.100", "response", "y"), ("3", "http://a.com", "2024-01-01 00:00:01.950", "revisit", "x")]
    rows += [("9", "http://b.com", "2024-01-01 00:00:01.100", "response", "x"), ("30", "http://b.com", "2024-01-01 00:00:01.950", "revisit", "x")]
    df = spark.createDataFrame(rows, "record_id string, url string, ts string, kind string, tag string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("headers", F.create_map(F.lit("ETag"), "tag"))
    numbered = op9_revisits.resolve(df.withColumn("record_id", F.col("record_id").cast("int"))).collect()
    assert {(r.record_id, r.response_id, r.state) for r in numbered} == {(3, 1, "resolved"), (30, 9, "resolved")}
    named = op9_revisits.resolve(df.withColumn("record_id", F.concat(F.lit("urn:uuid:"), "record_id"))).collect()
    assert {(r.record_id, r.response_id, r.state) for r in named} == {("urn:uuid:3", "urn:uuid:1", "resolved"), ("urn:uuid:30", "urn:uuid:9", "resolved")}
    with pytest.raises(TypeError):
        op9_revisits.resolve(df.withColumn("ts", F.lit("today")))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (5, 1, 0), (5, 1, 0), (None, 1, 0), (6, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op10_quality.quality(docs, labels).collect()}
    for i, t, *_ in ROWS:
        w = words(t)
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeated = {k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert got[3].kept and got[4].kept
    # The ratio, threshold and verdict, with buckets by the operator's own hashes.
    raw, good, each = Counter(), Counter(), {}
    for i, t, *_ in ROWS:
        chunk = next(iter(chunks(pa.array([t], pa.string()), NOT_SPACE)))
        h = chunk.hashes()
        each[i] = [int(x >> np.uint64(48)) for x in [*h, *(run_hashes(h[j : j + 2], 2)[0] for j in range(len(h) - 1))]]
        raw.update(each[i])
        good.update(each[i] if i in (3, 4, 5) else [])
    size = 1 << 16
    of = lambda n, b: math.log((n[b] + 1) / (sum(n.values()) + size))
    score = {i: sum(of(good, b) - of(raw, b) for b in v) / max(1, len(v)) for i, v in each.items()}
    assert all(math.isclose(got[i].score, score[i], abs_tol=1e-9) for i in score)
    bins = sorted(math.floor(score[i] * 1000) for i in (3, 4, 5))
    low, middle = bins[0], bins[math.ceil(len(bins) / 2) - 1]
    least = (middle - 3 * (middle - low)) / 1000
    assert all(r.kept == (not r.base_failed and score[i] >= least) for i, r in got.items())
    assert len({r.kept for r in got.values() if not r.base_failed}) == 2
    assert op10_quality.quality(empty, labels).count() == 0
    with pytest.raises(TypeError):
        op10_quality.quality(docs.withColumn("doc_id", docs["doc_id"].cast("string")), labels)
    assert all(r.kept != r.base_failed for r in op10_quality.quality(docs, labels.limit(0)).collect())
