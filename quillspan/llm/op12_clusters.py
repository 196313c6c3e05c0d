"""Exact Lloyd clustering of integer vectors with heaps of bounds.

Vectors are packed once into blocks. A block keeps, for each cluster, a heap of its vectors by their gap: the distance to the second nearest
centroid less that to the nearest, when last measured, plus what the cluster's drift had summed up to by then. In each round a cluster's drift grows by
how far its own centroid moved and by the farthest move of another; the gap of a vector can't have shrunk by more. So only vectors at a heap's
top whose number is at most the drift are popped and measured against all centroids, and the others keep their cluster unseen. All
distances are exact integers; the bounds are floating numbers, rounded to the safe side. A block also keeps the sums of its clusters, which only
moved vectors change, so that a round gathers ``k`` sums and counts of each block, added up before they are shuffled; the driver gets ``k`` times ``dims`` numbers.

Each round makes the next blocks from the last by one narrow step and persists them. Lost blocks are made again from the written vectors by
at most as many narrow steps as rounds. No vector is ever shuffled, so copies of one vector or a cluster of most vectors weigh like others.

Cases: vectors that are null, have another length or hold a null or non-finite component are left out, as are those with a component of
``LIMIT`` or more in size, whose distances could leave 64 bits. Repeated rows count each; equal hashes go by components. Null ids are clustered but never
begin a centroid unless nothing else is left. With fewer vectors than ``k`` there are fewer centroids; without any the result is empty. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import integer_ids, materialize

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"
BLOCK = 2048
LIMIT = 1 << 27
_SLACK = 1e-9


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to all centroids."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # every sum below is an exact double
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    wide = x.astype(np.int64)
    return np.stack([((wide - c) ** 2).sum(1) for c in centroids], 1)


def pack(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """Blocks of kept vectors: ``ids``, and ``data``, their integers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            ids, values = ids.filter(right), lists.filter(right).flatten()
            x = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                x = np.floor(x * scale)
            kept = (np.abs(np.nan_to_num(x, nan=np.inf)) < LIMIT).all(1)
            ids, x = ids.filter(pa.array(kept)), x[kept].astype(np.int32)
            for a in range(0, len(x), BLOCK):
                part = ids.slice(a, BLOCK)
                own = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                yield pa.RecordBatch.from_arrays([own, pa.array([x[a : a + BLOCK].tobytes()], pa.binary())], names=["ids", "data"])

    return vectors.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(blocks, "ids array<long>, data binary")


def first_centroids(blocks: DataFrame, k: int, dims: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``seed:id``; each block offers ``k``."""

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.int32).reshape(-1, dims)
                named = ((i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x[j].tolist()) for j, i in enumerate(ids))
                best = heapq.nsmallest(k, named)
                yield pa.RecordBatch.from_arrays([pa.array([b[c] for b in best], t) for c, t in enumerate((pa.bool_(), pa.string(), pa.list_(pa.int32())))], names=["none", "hash", "x"])

    best = blocks.mapInArrow(offers, "none boolean, hash string, x array<int>").orderBy("none", "hash", "x").limit(k).collect()
    return np.array([r.x for r in best], np.int64).reshape(-1, dims)


_STATE = "ids array<long>, data binary, near binary, keys binary, who binary, ends array<int>, sums array<long>, scanned long"


class _Block:
    """A block's vectors, clusters, heaps and sums."""

    def __init__(self, row: dict, k: int, dims: int) -> None:
        self.x = np.frombuffer(row["data"], np.int32).reshape(-1, dims)
        n = len(self.x)
        self.sums = np.array(row["sums"], np.int64).reshape(k, dims + 1) if row.get("sums") is not None else np.zeros((k, dims + 1), np.int64)
        self.scanned = 0
        if row.get("near") is None:
            self.near, self.heaps, self.fresh = np.full(n, -1, np.int32), [[] for _ in range(k)], np.arange(n)
            return
        self.near, self.fresh = np.frombuffer(row["near"], np.int32).copy(), None
        keys, who, ends = np.frombuffer(row["keys"], np.float64), np.frombuffer(row["who"], np.int32), row["ends"]
        self.heaps = [(keys[a:b], who[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def advance(self, centroids: np.ndarray, drift: list[float]) -> None:
        """Pops what has expired, measures it against all centroids, and pushes it where it belongs now."""
        gone: list[int] = []
        if self.fresh is not None:
            gone = self.fresh.tolist()
        else:
            for c, (keys, who) in enumerate(self.heaps):
                if len(keys) and keys[0] <= drift[c]:
                    heap = list(zip(keys.tolist(), who.tolist(), strict=True))
                    while heap and heap[0][0] <= drift[c]:
                        gone.append(heapq.heappop(heap)[1])
                    self.heaps[c] = heap
        self.scanned = len(gone)
        if not gone:
            return
        at = np.array(gone, np.int64)
        d = distances(self.x[at], centroids)
        near = d.argmin(1)  # of equal ones the smallest number
        u = np.sqrt(d[np.arange(len(at)), near])
        if len(centroids) > 1:
            d[np.arange(len(at)), near] = np.iinfo(np.int64).max
            low = np.sqrt(d.min(1))
        else:
            low = np.full(len(at), np.inf)
        gap = np.where(np.isinf(low), np.inf, low - u - _SLACK * (low + u + 1))
        moved = self.near[at] != near
        full = np.concatenate([self.x[at[moved]].astype(np.int64), np.ones((int(moved.sum()), 1), np.int64)], 1)
        old = self.near[at[moved]]
        np.subtract.at(self.sums, old[old >= 0], full[old >= 0])
        np.add.at(self.sums, near[moved], full)
        self.near[at] = near
        for i, c, g in zip(gone, near.tolist(), gap.tolist(), strict=True):
            if not isinstance(self.heaps[c], list):
                self.heaps[c] = list(zip(self.heaps[c][0].tolist(), self.heaps[c][1].tolist(), strict=True))
            heapq.heappush(self.heaps[c], (g + drift[c], i))

    def packed(self) -> list:
        flat = [(np.array([h[0] for h in heap], np.float64), np.array([h[1] for h in heap], np.int32)) if isinstance(heap, list) else heap for heap in self.heaps]
        ends = np.cumsum([0, *(len(w) for _, w in flat)], dtype=np.int32)
        join = lambda j: b"".join(np.ascontiguousarray(f[j]).tobytes() for f in flat)
        return [self.near.tobytes(), join(0), join(1), ends.tolist(), self.sums.ravel().tolist(), self.scanned]


def advance(blocks: DataFrame, centroids: np.ndarray, drift: list[float], dims: int) -> DataFrame:
    """The blocks once more, assigned to ``centroids``; ``drift`` is each cluster's sum of moves so far."""
    k = len(centroids)
    types = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
    names = [x.split()[0] for x in _STATE.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                one = batch.slice(j, 1)
                row = {n: one.column(n)[0].as_py() for n in one.schema.names if n != "ids"}
                b = _Block(row, k, dims)
                b.advance(centroids, drift)
                yield pa.RecordBatch.from_arrays([one.column("ids"), one.column("data"), *(pa.array([v], t) for v, t in zip(b.packed(), types, strict=True))], names=names)

    return blocks.mapInArrow(step, _STATE)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``vec_id``, ``cluster`` and ``distance`` of each kept vector, the final centroids, and how many vectors each assignment measured."""
    integer_ids(vectors, vec_id)
    blocks = materialize(pack(vectors, vec_id, embedding, dims, scale))
    centroids = first_centroids(blocks, k, dims, seed)
    if len(centroids) == 0:
        return blocks.select(F.explode("ids").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, []
    drift, state, scanned = [0.0] * len(centroids), blocks, []
    for turn in range(rounds + 1):
        before, state = state, advance(state, centroids, drift, dims).persist(StorageLevel.MEMORY_AND_DISK)
        # One row of totals for each place in the sums, added up within tasks first.
        totals = state.select("scanned", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum(F.when(F.col("at") == 0, F.col("scanned"))).alias("scanned")).collect()
        before.unpersist()
        scanned.append(next(r.scanned for r in totals if r["at"] == 0))
        if turn == rounds:
            break
        sums = np.array([r.x for r in sorted(totals)], object).reshape(len(centroids), dims + 1)
        moved = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, centroids, strict=True)], np.int64)
        moves = [math.sqrt(int(d)) * (1 + _SLACK) for d in ((moved - centroids) ** 2).sum(1)]
        drift = [x + moves[c] + max((m for o, m in enumerate(moves) if o != c), default=0.0) for c, x in enumerate(drift)]
        centroids = moved
    final = centroids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                x, near = np.frombuffer(batch.column(1)[j].as_py(), np.int32).reshape(-1, dims), np.frombuffer(batch.column(2)[j].as_py(), np.int32)
                own = ((x.astype(np.int64) - final[near]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[j].values, pa.array(near), pa.array(own)], names=["vec_id", "cluster", "distance"])

    found = materialize(state.select("ids", "data", "near").mapInArrow(rows, "vec_id long, cluster int, distance long"))
    state.unpersist()
    return found, final, scanned


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    hashes = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row for each of k clusters
    own = own.join(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia"))), F.lit(True)).join(F.broadcast(hashes), "cluster")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    near = lambda c: f"(SELECT v.row, v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS best FROM v, {c} c GROUP BY v.row, v.vec_id, v.x)"
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {K}))"""]
    for i in range(ROUNDS):
        parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT c, list(m ORDER BY place) AS x FROM (
      SELECT best.c AS c, place, floor(sum(e) / count(*))::BIGINT AS m FROM (SELECT best, unnest(x)::DOUBLE AS e, generate_subscripts(x, 1) AS place FROM {near(f"c{i}")}) GROUP BY ALL) GROUP BY c) m ON m.c = c.c)""")
    return f"""WITH {", ".join(parts)}, last AS MATERIALIZED {near(f"c{ROUNDS}")}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} c ON c.c = best.c"""


#: Sums of the given tables' integers are exact doubles, so floors of quotients are exact too.
ORACLE = _oracle()
