"""The pipeline against a brute-force version of its stages."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("quillspan.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from quillspan.llm import op1_mixing  # noqa: E402

from test_operators import ALNUM, SPACE, brute_components, fingerprint, words  # noqa: E402

rng = random.Random(11)
VOCABULARY = {k: [rng.choice(a) + rng.choice(b) for _ in range(400)] for k, a, b in (("en", "th wh str sh gr bl".split(), "ing ough ed tion ly and".split()), ("de", "sch pf zw kn ge ver".split(), "ung heit keit lich über ßen".split()))}
ITEM = " ".join(rng.choice(VOCABULARY["en"]) for _ in range(14))


def prose(lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def rows():
    out = []
    for i in range(150):
        lang = ("en", "de")[i % 2]
        out.append((i, prose(lang, rng.randrange(55, 120)), lang if i % 7 else None, ("a", "a", "b", "c", None)[i % 5]))
    texts = [r[1] for r in out]
    passage = prose("de", 70)
    out += [(200 + i, texts[5], "de", "b") for i in range(4)]  # exact copies
    out += [(210, texts[8] + " thing", "en", "c"), (211, texts[8].upper(), "en", "c")]  # near copies
    out += [(220 + i, prose("de", 40) + "\n" + passage + " " + prose("de", 30 + i), "de", "a") for i in range(3)]
    out += [(230, texts[30] + "  " + ITEM.upper() + ". " + prose("en", 20), "en", "b"), (231, prose("en", 60), "en", "b"), (231, prose("en", 60), "en", "b")]
    out += [(240, None, "en", "a"), (241, "", "de", "b"), (242, "12 34 !!", "en", None), (None, prose("en", 80), "en", "a")]
    return out


def repeats_cut(docs):
    least = {}
    for i, t, _, _ in docs:
        w = words(t)
        for j in range(len(w) - 49) if i is not None else ():
            k = tuple(w[j : j + 50])
            least[k] = min(i, least.get(k, i))
    for i, t, lang, source in docs:
        w, gone = words(t), set()
        for j in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        if kept or not gone:
            yield i, " ".join(kept), lang, source


def mixed(docs):
    """Of each document and copy, how often it is emitted."""
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(full.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3.0 * sizes[s] for s in over}
    target |= full
    out, offset = Counter(), op1_mixing.offset_of(op1_mixing.SEED)
    for s in names:
        own = sorted((len(words(t)), -1 if i is None else i) for i, t, _, x in docs if x == s)
        for rank, (_, i) in enumerate(own):
            rate = target[s] / sizes[s]
            for copy in range(math.floor(rate * (rank + 1) + offset) - math.floor(rate * rank + offset)):
                out[i, copy + 1] += 1
    return out


def test_pipeline(spark, tmp_path):
    given = rows()
    # Further columns bear names that operators add.
    table = spark.createDataFrame([(*r, len(r[1] or ""), f"s{r[0]}", r[0], [1.5]) for r in given], "doc_id long, text string, lang string, source string, n_chars long, size string, n_words long, spans array<double>")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "!!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    docs = [r for r in given if re.search(r"[^\W\d_]", r[1] or "")]
    assert len(docs) == len(given) - 3
    prints = {i: fingerprint(t) for i, t, _, _ in docs if i is not None and i != 231}
    component = brute_components(sorted(prints.items()))
    docs = [r for r in docs if component.get(r[0], r[0]) == r[0]]
    assert not {200, 201, 202, 203, 211} & {r[0] for r in docs} and {5, 8} <= {r[0] for r in docs}
    before = {r[0]: len(words(r[1])) for r in docs}
    docs = list(repeats_cut(docs))
    assert all(len(words(t)) <= before[i] - 70 for i, t, _, _ in docs if i in (221, 222))
    item = words(ITEM, ALNUM)
    grams = {tuple(item[j : j + 10]) for j in range(5)}
    docs = [r for r in docs if not any(tuple(words(r[1], ALNUM)[j : j + 10]) in grams for j in range(len(words(r[1], ALNUM)) - 9))]
    assert 230 not in {r[0] for r in docs}

    expected = mixed(docs)
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.copy) for r in got) == expected and len(expected) > 100
    kept = {(i, tuple(words(t))) for i, t, _, _ in docs}
    assert all((r.doc_id, tuple(SPACE.findall(r.text))) in kept for r in got)
    own = {r[0]: r for r in given}
    for r in got:
        assert (r.size, r.n_words, r.spans, r.lang, r.source) == (f"s{r.doc_id}", r.doc_id, [1.5], *own[r.doc_id][2:])
        assert r.n_chars == len(r.text)


def test_unlearned_languages(spark):
    given = [(r[0], r[1], r[2]) for r in rows() if r[0] is not None and r[0] < 150]
    russian, greek = ([" ".join("".join(chr(rng.randint(a, b)) for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (5, 60, 300)] for a, b in ((0x430, 0x44F), (0x3B1, 0x3C9)))
    other = [" ".join(rng.choice("pym xoc jaqu vib".split()) + rng.choice("awn ozz ukk ipa".split()) for _ in range(60))]
    short = [(300 + i, prose(("en", "de")[i % 2], 8), None) for i in range(10)] + [(320, prose("en", 3000), None)]
    df = spark.createDataFrame(given + short + [(400 + i, t, None) for i, t in enumerate([*russian, *greek, *other])], "doc_id long, text string, lang string")
    assert {r.doc_id for r in pipeline.language_id(spark, df, "").collect()} == {r[0] for r in given + short}


def test_empty(spark, tmp_path):
    table = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = pipeline.run(spark, str(tmp_path))
    assert found.columns == [*table.columns, "copy"] and found.count() == 0
