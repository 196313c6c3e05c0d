"""Heap-bounded clustering against Lloyd's rounds over all vectors in plain integers."""

import hashlib
import math
import random

import pytest

pytest.importorskip("quillspan.llm")
from quillspan.llm import op12_clusters as m  # noqa: E402


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < m.LIMIT for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), n in zip(kept, near) if n == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i is not None, i or 0, n, far(v, centroids[n])) for (i, v), n in zip(kept, near)), centroids


def check(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, embedding array<double>, cluster int, data binary").repartition(3)
    found, centroids, scanned = m.cluster(df, k=k, rounds=rounds, dims=dims)
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect())
    assert (got, centroids.tolist()) == plain(rows, k, rounds, dims)
    return scanned


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 50)
    r = random.Random(11)
    heart = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in r.choice(heart)]) for i in range(600)]
    rows += [(7, rows[7][1]), (None, rows[0][1]), (None, [0.0] * 5), (900, None), (901, [1.0] * 4), (902, [1.0] * 4 + [None]), (903, [math.nan] * 5), (904, [math.inf] * 5), (905, [1e300] * 5), (906, [])]
    rows += [(1000 + i, [0.25] * 5) for i in range(300)]  # copies of one vector
    scanned = check(spark, rows, 8, 6, 5)
    assert scanned[0] == 903 and sum(scanned[1:]) < 0.8 * 903 * 6  # most vectors keep their cluster unmeasured
    check(spark, [(i, [float(i % 3), float(i % 2)]) for i in range(40)], 6, 2, 2)  # ties
    check(spark, [(i, [100_000.0 * (i % 7), -3.5e4 * i]) for i in range(40)], 4, 2, 2)  # beyond exact doubles
    check(spark, rows[:3], 8, 1, 5)
    check(spark, rows[:300], 1, 1, 5)
    assert check(spark, rows[-4:-3], 8, 2, 5)[0] == 1


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    found, centroids, scanned = m.cluster(df)
    assert found.count() == 0 and len(centroids) == 0 and scanned == []
