"""The Pitman-Yor model: drawn tables against all seatings, probabilities that sum to one, base scores, and held-out gain."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quillspan.llm")
from quillspan.llm import op13_scoring as m  # noqa: E402

TRAIN = "crc32(coalesce(cast(doc_id AS string), '')) % 5 <> 1"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def is_train(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1


def test_tables_are_drawn_like_seatings():
    """The number of tables of 5 customers of one dish, against the weights of all ways of seating them."""
    discount, strength, prior, others = 0.4, 1.5, 0.3, 2
    weights = Counter()
    for way in itertools.product(range(5), repeat=5):
        if any(x > max(way[:i], default=-1) + 1 for i, x in enumerate(way)):
            continue  # tables are numbered as they are opened
        w, sizes = 1.0, []
        for x in way:
            if x == len(sizes):
                w *= (strength + discount * (others + len(sizes))) * prior
                sizes.append(1)
            else:
                w *= sizes[x] - discount
                sizes[x] += 1
        weights[len(sizes)] += w
    n = 40_000
    got = Counter(m.draw_tables(np.full(n, 5), np.full(n, 2.0), np.full(n, prior), discount, strength, np.random.default_rng(1), m.log_stirling(discount)).tolist())
    for t in range(1, 6):
        assert abs(got[t] / n - weights[t] / sum(weights.values())) < 0.01
    big = m.draw_tables(np.array([1, 64, 65, 10**6]), np.zeros(4), np.full(4, 0.01), 0.3, 10.0, np.random.default_rng(1), m.log_stirling(0.3))
    assert big[0] == 1 and 1 <= big[1] <= 64 and big[1] < big[3] < 10**5


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ta", "né", "Ko", "ri") for b in ("m", "lo", "ß", "st")]
    follow = {w: r.sample(vocabulary, 3) for w in vocabulary}

    def text(n):
        out = [r.choice(vocabulary)]
        for _ in range(n):
            out.append(r.choice(follow.get(out[-1], vocabulary)) if r.random() < 0.7 else r.choice(["the", "THE", *vocabulary]))
        return " ".join(out)

    texts = [None, "", " \n", "never seen", text(3000), *(text(r.randrange(1, 60)) for _ in range(150)), *["the " * 40] * 120]
    return [*enumerate(texts), (None, "the the"), (4, texts[4])]


def test_scores(spark, rows, monkeypatch):
    taken = {}
    plain = m.answered
    monkeypatch.setattr(m, "answered", lambda packed, answers, deal, model: taken.update(answers=answers.collect(), model=model, deal=deal) or plain(packed, answers, deal, model))
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, chunk long, score double").coalesce(1)
    found = m.score_texts(docs, TRAIN).collect()
    assert Counter(m.score_texts(docs, TRAIN).collect()) == Counter(found)
    count = Counter(w for i, t in rows if is_train(i) for w in tokens(t))
    total, known = sum(count.values()), len(count)
    assert len(taken["deal"].hot) and taken["model"]["known"] == known  # a word of a third of all tokens is dealt to several tasks
    expected = Counter()
    for i, t in rows:
        x = tokens(t)
        expected[i, not is_train(i), len(x), sum(count[w] > 0 for w in x), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (known + 1))) for w in x), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)
    # All pairs stand in one chunk: what is left of customers and what goes to the parent make one, in each restaurant and in the parent.
    model, checked = taken["model"], 0
    left = sum((m._numbers(a.b).reshape(m.SAMPLES, -1) - model["root_discount"] * m._numbers(a.c).reshape(m.SAMPLES, -1)).sum(1) for a in taken["answers"] if a.kind == "words")
    assert np.allclose(left + model["backs"], model["alls"])
    for a in (a for a in taken["answers"] if a.kind == "pairs"):
        customers, tables = m._numbers(a.d).astype(np.int64), m._numbers(a.c).reshape(m.SAMPLES, -1)
        seats, share = m._numbers(a.b).sum() / m.SAMPLES, model["discount"] * tables.mean(0)
        assert m._numbers(a.a).sum() == customers.sum() or set(customers) & set(taken["deal"].counts.tolist())
        if not set(customers) & set(taken["deal"].counts.tolist()):
            checked += 1
            assert math.isclose(model["discount"] * seats, share.sum(), rel_tol=1e-9)  # what dishes give up is the parent's
    assert checked


def test_chunks_need_not_be_one(spark, rows, monkeypatch):
    """Answers come back to the chunk that asked, whatever chunks there are; the model hardly depends on them."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {(r.doc_id, r.base_score): r.score for r in m.score_texts(docs.coalesce(1), TRAIN).collect()}
    many = m.score_texts(docs.coalesce(3), TRAIN).collect()
    assert all(math.isclose(one[r.doc_id, r.base_score], r.score, rel_tol=1e-6) for r in many)


def test_none(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = m.score_texts(docs, "false").collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0, 0)
    assert m.score_texts(docs.limit(0), TRAIN).count() == 0


BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_chunks_are_the_same_from_batches_of_any_size(monkeypatch):
    """So Spark may send small batches, of which it keeps less: chunks are filled from several and end at the same rows."""
    monkeypatch.setattr(m, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(m, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    r = random.Random(5)
    texts = [None, "", *("wörd " * r.randrange(60) for _ in range(200)), "x" * 5000, *["a b"] * 400, None]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([i % 3 > 0 for i in range(len(texts))]), pa.array(texts)], names=["doc_id", "train", "text"])

    def found(size):
        parts = m._chunks(iter([whole.slice(0, 0), *(whole.slice(a, size) for a in range(0, len(whole), size))]))
        return [(number, ids.to_pylist(), train.tolist(), chunk.buf.tobytes(), chunk.offsets.tolist()) for number, ids, train, chunk in parts]

    one = found(len(whole))
    assert [i for _, ids, *_ in one for i in ids] == list(range(len(texts)))
    assert [number for number, *_ in one] == [(3 << 24) + i for i in range(len(one))]
    assert all(len(buf) <= 1000 or len(ids) == 1 for _, ids, _, buf, _ in one) and len(one) < 1.5 * sum(len((x or "").encode()) for x in texts) / 1000
    assert all(found(size) == one for size in (1, 7, 50))
    assert list(m._chunks(iter([]))) == list(m._chunks(iter([whole.slice(0, 0)]))) == []


@pytest.mark.parametrize("own", [None, "3000000"])
def test_spark_sends_small_batches_while_texts_are_scored(spark, monkeypatch, own):
    """Both limits of the session come back, its default and one that the user has set."""
    seen, plain = [], m.answered
    monkeypatch.setattr(m, "answered", lambda *a: seen.append(spark.conf.get(BATCHES)) or plain(*a))
    before = spark.conf.get(BATCHES, None)
    try:
        spark.conf.set(BATCHES, own) if own else spark.conf.unset(BATCHES)
        assert m.score_texts(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string"), "doc_id = 1").count() == 2
        assert seen == [str(m.BATCH_BYTES)] and spark.conf.get(BATCHES, None) == own
        with pytest.raises(Exception, match="nowhere"):
            m.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "nowhere = 1")
        assert spark.conf.get(BATCHES, None) == own
    finally:
        spark.conf.unset(BATCHES) if before is None else spark.conf.set(BATCHES, before)


def test_packed_words_and_numbers():
    """Frequent words take 2 bytes before compression, others 6 more; numbers of any width come back."""
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 48, 5000, dtype=np.uint64)
    deal = m.Deal(4, frequent=words[:3000])
    asked = r.choice(words, 20_000)
    data = deal.written(asked, deal.codes(asked))
    assert (deal.read(data) == asked).all() and len(data) < 0.75 * len(m._short(asked))
    plain = m.Deal(4)
    for some in (asked, asked[:0]):
        assert (plain.read(plain.written(some, plain.codes(some))) == some).all() and (deal.read(deal.written(some, deal.codes(some))) == some).all()
    for most in (0, 255, 256, 65_535, 65_536, (1 << 32) - 1, 1 << 32, 1 << 62):
        x = np.array([[most, 0, 1], [min(most, 7), most // 2, most]], np.int64)
        assert (m._numbers(m._small(x)).reshape(2, 3).astype(np.int64) == x).all()
    assert not len(m._numbers(m._small(np.empty(0, np.int64))))
    for x in (asked, asked[:0]):
        (a, b), (c, d) = m._unique(x), np.unique(x, return_inverse=True)
        assert (a == c).all() and (b == d).all()
