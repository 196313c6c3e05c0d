"""SimHash near-duplicates through a hierarchical index in Gray order.

1. Each document gets a 64-bit fingerprint of its word shingles. Documents of one fingerprint become one class,
   standing for its smallest id, so copies are never compared.
2. Two fingerprints that differ in at most two bits agree in two of four 16-bit blocks, so each class is dealt to
   the six groups named by a pair of blocks and their bits. A group above ``GROUP`` is dealt on by one of three parts
   of the bits that are left, and again: after each step fewer bits are free, so groups can't stay large.
3. In a group the fingerprints are sorted by Gray rank and gathered eight by eight into nodes, level upon level. A node
   holds the bits that all below it share; a child holds only what it shares beyond its parent. A search goes down with
   the differences accumulated so far and prunes a whole node once they pass two. Most pairs are ruled out by step 2
   already; the index saves those of large groups.
4. Of each group only a forest of its links leaves (each class to the smallest id it reaches there), never all pairs.
   Connected components then follow by large-star and small-star rounds over Spark tables. Documents learn theirs in
   a join by fingerprint, in which one that a third of them share is cut.

Cases: a null, empty or wordless text has fingerprint zero and links like others. A null doc_id gets a fingerprint,
is linked to nothing and has a null component. Repeated ids are one document per fingerprint. Ids are integers. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from .scratch import integer_ids, materialize, partitions, spread_join
from .words import NOT_SPACE, Chunk, chunks

SHINGLE, SEED, DIFFER = 3, 42, 2
GROUP = 4096
FANOUT = 8
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def _fingerprints(chunk: Chunk, shingle: int) -> np.ndarray:
    """The fingerprint of each text of a chunk of lower-cased words."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(chunk.rows), np.uint64)
    for row, (a, b) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        text = chunk.buf[chunk.starts[a] : chunk.ends[b - 1]].tobytes()
        joined = b" ".join(text.split())
        size = chunk.ends[a:b] - chunk.starts[a:b]
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size).tolist()
        k = min(shingle, b - a)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: b - a - k + 1], ends[k - 1 :].tolist(), strict=True)], np.uint64)
        total = np.zeros(64, np.int64)
        for c in range(0, len(h), 1 << 15):
            total += np.unpackbits(h[c : c + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[row] = np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), NOT_SPACE, lowered=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows)), pa.array(_fingerprints(chunk, shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(scan, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class _Roots:
    """A forest over 0 .. n - 1 in which a tree's root is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def _index(fp: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of nodes from the roots, one for each group, down to the fingerprints: (bits, mask of the bits it adds, first child)."""
    levels = [(fp, np.full(len(fp), ~np.uint64(0)), np.arange(len(fp)), group)]
    while len(levels[-1][0]) > len(np.unique(levels[-1][3])):
        bits, mask, _, of = levels[-1]
        begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        size = np.diff(np.append(begins, len(of)))
        inside = np.arange(len(of)) - np.repeat(begins, size)
        first = np.flatnonzero(inside % FANOUT == 0)
        ones = np.bitwise_and.reduceat(bits & mask, first)
        zeros = np.bitwise_and.reduceat(~bits & mask, first)
        levels.append((ones, ones | zeros, first, of[first]))
    out = []
    for k in range(len(levels) - 1, -1, -1):
        bits, mask, first, _ = levels[k]
        if k + 1 < len(levels):
            above, starts = levels[k + 1][1], levels[k + 1][2]
            parent = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bits))))
            mask = mask & ~above[parent]
        out.append((bits, mask, np.append(first, len(levels[k - 1][0])) if k else first))
    return out


def group_links(fp: np.ndarray, rep: np.ndarray, group: np.ndarray, differ: int = DIFFER) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints in groups, the representative of each that has a smaller one in its tree, and that one."""
    order = np.lexsort((gray_rank(fp), group))
    fp, rep, group = fp[order], rep[order], group[order]
    levels = _index(fp, group)
    _, root = np.unique(group, return_inverse=True)
    by_rep = np.argsort(rep, kind="stable")
    place = np.empty(len(rep), np.int64)
    place[by_rep] = np.arange(len(rep))  # so that the root of a tree is its smallest representative
    forest = _Roots(len(fp))
    for a in range(0, len(fp), 2048):
        who = np.arange(a, min(a + 2048, len(fp)))
        node, spent = root[who], np.zeros(len(who), np.uint8)
        for depth, (bits, mask, first) in enumerate(levels):
            spent = spent + np.bitwise_count((fp[who] ^ bits[node]) & mask[node])
            alive = spent <= differ
            who, node, spent = who[alive], node[alive], spent[alive]
            if depth + 1 < len(levels):
                low, n = first[node], first[node + 1] - first[node]
                node = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                who, spent = np.repeat(who, n), np.repeat(spent, n)
        later = node < who
        forest.join(place[who[later]], place[node[later]])
    forest.join(np.empty(0, np.int64), np.empty(0, np.int64))
    of = rep[by_rep][forest.parent[place]]
    moved = of != rep
    return rep[moved], of[moved]


def _keys(level: int, fp: F.Column) -> F.Column:
    """The values that name the groups of a fingerprint at a level: a pair of blocks, then parts of the 32 bits left."""
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    whole = []
    for t, (a, b) in enumerate(_PAIRS):
        c, d = (i for i in range(4) if i not in (a, b))
        rest = F.shiftleft(block(c), 16).bitwiseOR(block(d))
        named = F.shiftleft(block(a), 16).bitwiseOR(block(b))
        if level == 0:
            whole.append(F.struct(F.lit(t).alias("t"), named.alias("a"), F.lit(0).cast("long").alias("b")))
            continue
        # Three parts of 11, 11 and 10 bits: two differences leave one of them whole. Then four parts of what is left.
        parts = [(0, 11), (11, 11), (22, 10)]
        for p, (at, size) in enumerate(parts):
            part = F.shiftright(rest, at).bitwiseAND(F.lit((1 << size) - 1))
            if level == 1:
                whole.append(F.struct(F.lit(t * 3 + p).alias("t"), named.alias("a"), part.alias("b")))
                continue
            left = rest.bitwiseAND(F.lit(0xFFFFFFFF ^ (((1 << size) - 1) << at)))
            for q in range(3):
                keep = sum(1 << i for k, i in enumerate(i for i in range(32) if not at <= i < at + size) if k * 3 // (32 - size) == q)
                whole.append(F.struct(F.lit((t * 3 + p) * 3 + q).alias("t"), named.alias("a"), F.shiftleft(part, 32).bitwiseOR(left.bitwiseAND(F.lit(keep))).alias("b")))
    return F.array(*whole)


def _search(keyed: DataFrame) -> DataFrame:
    """Links within groups (t, a, b) of (fp, rep): the groups' rows come sorted, a partition may hold many."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(0)))
            group = np.cumsum(change)
            size = np.bincount(group)[group]
            rows, group = rows[:, size > 1], group[size > 1]
            if rows.shape[1]:
                a, b = group_links(rows[3].view(np.uint64), rows[4], group)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            rows = np.concatenate([*held, rows], 1)
            last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut and cut > 50_000:  # whole groups only; small batches gather first
                yield from done(rows[:, :cut])
                rows = rows[:, cut:]
            held = [rows]
        if held and held[0].shape[1]:
            yield from done(held[0])

    n = partitions(keyed.sparkSession)
    return keyed.repartition(n, "t", "a", "b").sortWithinPartitions("t", "a", "b").select("t", "a", "b", "fp", "rep").mapInArrow(scan, "u long, v long")


def links(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (u, v) between representatives of ``classes`` (fp, rep) that connect what is linked at two bits."""
    found, todo = [], classes
    for level in range(3):
        keyed = todo.select("fp", "rep", F.explode(_keys(level, F.col("fp"))).alias("k")).select("fp", "rep", "k.*")
        sizes = keyed.groupBy("t", "a", "b").count()
        if level == 2:
            found.append(_search(keyed))
            break
        large = materialize(sizes.filter(F.col("count") > group).drop("count"))
        if large.isEmpty():
            found.append(_search(keyed))
            break
        # Members of large groups go on to the next level, with all their groups there; small groups end here.
        found.append(_search(keyed.join(large, ["t", "a", "b"], "left_anti")))
        todo = materialize(keyed.join(large, ["t", "a", "b"], "left_semi").select("fp", "rep").distinct())
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, of all nodes of ``edges`` (u, v) but roots."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        # Large star: larger neighbours of each node go to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the smallest doc_id that links reach."""
    integer_ids(docs, doc_id)
    prints = materialize(fingerprints(docs, doc_id, text, shingle))
    sizes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    classes = sizes.filter("rep IS NOT NULL").select("fp", "rep")
    roots = components(links(classes, group))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("component_id"))
    joined = spread_join(prints, named, "fp", "_fp", sizes, F.col("doc_id"))
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
