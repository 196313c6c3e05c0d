"""Texts' probabilities by a hierarchical Pitman-Yor model of words and pairs of words.

Each word that is followed by others has a restaurant; its customers are the words that follow, its dishes the distinct ones. All these
restaurants share one parent, whose customers are their tables, and whose own parent is the uniform distribution over the known words and one that
stands for all others. Tables are drawn by Gibbs: for each dish the number of tables, given all other dishes' tables and the parent's probability of the
word. How a dish's customers sit at that many tables is summed out, by generalised Stirling numbers, for the first ``EXACT`` customers; further ones are
seated after them, in blocks that grow by a ``1/32``, each taking a new table with its probability given those before. Discounts come
from the counts of counts, strengths are drawn on a grid. A first round of ``SWEEPS`` sweeps starts from the parent that a task's own
restaurants would give, a second from the parent drawn after it; the second's last ``SAMPLES`` sweeps, with a parent drawn for each, give
the probabilities whose mean is used.

Texts are read in chunks. A chunk sends its distinct pairs with their numbers once, dealt by the first word, so that a restaurant is in one task; words
of more pairs than a task should hold are dealt by the second word too. Tasks of restaurants tell tasks of words how many tables each word has, and are told its
probability. Both answer chunks: arrays in the order of the question, so that pairs aren't sent back. A chunk asks for a pair once however often it has it, so a
frequent pair weighs like any other. What a task holds is its share of pairs, of words or a chunk. Dishes of one task are drawn
given its tables of the sweep before, and parts of a split restaurant given as many tables elsewhere as in proportion: the usual
approximation of parallel sampling.

Words are told apart by 48 bits of their hashes. Chunks are made twice, from a table that must give the same rows in the same partitions, as files do; check sums make the job
fail, rather than err, if it does not.

Cases: a null or empty text has one token, its end. Ids are integers; a null id is scored and, like any id, trained on by its crc32 (of an empty text). Without training
texts everything is one unknown word of probability 1. Rows of one id are scored each. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import integer_ids, materialize, partitions
from .words import NOT_SPACE, U64, Chunk, _mix, chunks, texts

EXACT, SWEEPS, SAMPLES, SEED = 64, 3, 2, 20_240_101
CHUNK_BYTES = 4 << 20
#: Bytes of the Arrow batches in which Spark sends texts and groups to Python; it keeps a few times as much for each task.
BATCH_BYTES = 2 << 20
#: Tasks of restaurants and of words for each shuffle partition of the session.
TASKS = 2
END = U64((1 << 48) - 1)
_GRID = 0.25 * 2.0 ** np.arange(20)
_HOT_OF_TASK = 16
#: The most frequent words are written as 2 bytes instead of 6 within pairs; the last code stands for all others.
FREQUENT = OTHER = (1 << 16) - 1


def _short(words: np.ndarray) -> bytes:
    """Words as 6 bytes each."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _small(numbers: np.ndarray) -> bytes:
    """Whole numbers, most of them small, packed: all lowest bytes first, then all next ones."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(numbers.max(initial=0)) < 1 << 8 * w)
    data = np.ascontiguousarray(numbers, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    width = data[0]
    plain = np.frombuffer(pa.Codec("zstd").decompress(data[9:], int.from_bytes(data[1:9], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(plain.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint32 if width < 4 else f"<u{width}", copy=False)


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


@dataclass
class Deal:
    """How words and pairs are dealt to tasks; ``hot`` words' pairs to several."""

    tasks: int
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, U64))
    parts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, U64))  # most frequent first

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones, or ``OTHER``."""
        if not len(self.frequent):
            return np.full(len(words), OTHER, np.uint16)
        order = np.argsort(self.frequent)
        at = order[np.minimum(np.searchsorted(self.frequent, words, sorter=order), len(order) - 1)]
        return np.where(self.frequent[at] == words, at, OTHER).astype(np.uint16)

    def written(self, words: np.ndarray, codes: np.ndarray) -> bytes:
        """Words and their codes as bytes."""
        head = _small(codes)
        return len(head).to_bytes(4, "little") + head + _short(words[codes == OTHER])

    def read(self, data: bytes) -> np.ndarray:
        n = 4 + int.from_bytes(data[:4], "little")
        codes = _numbers(data[4:n])
        out, other = np.empty(len(codes), U64), codes == OTHER
        out[~other] = self.frequent[codes[~other]]
        out[other] = _long(data[n:])
        return out

    def which(self, words: np.ndarray) -> np.ndarray:
        """The place in ``hot`` of each word, or -1."""
        if not len(self.hot):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, at, -1)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return (words % U64(self.tasks)).astype(np.int64)

    def of_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        hot = self.which(first)
        own = (_mix(first) % U64(self.tasks)).astype(np.int64)
        if (hot >= 0).any():
            part = (second % np.where(hot >= 0, self.parts[hot], 1).astype(U64)).astype(np.int64) if len(self.parts) else 0
            own = (own + np.where(hot >= 0, part, 0)) % self.tasks
        return own


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and each value's place among them, as ``np.unique`` gives them, in half its memory."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    found = ranked[new]
    del ranked
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return found, place


class Pairs:
    """The words and the distinct pairs of some texts, each text followed by its end; before a text stands the end of another."""

    def __init__(self, chunk: Chunk) -> None:
        n = chunk.counts
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        seq = np.full(int(n.sum()) + len(n), END, U64)
        seq[np.arange(len(chunk.starts)) + chunk.owner()] = chunk.hashes() >> U64(16)
        self.words, self.word = _unique(seq)
        del seq
        keys = np.empty(len(self.word), np.int64)
        keys[1:] = self.word[:-1]
        keys[:1] = np.searchsorted(self.words, END)
        keys *= len(self.words)
        keys += self.word
        keys, self.pair = _unique(keys)
        self.first, self.second = keys // len(self.words), keys % len(self.words)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each pair stands in training texts."""
        return np.bincount(self.pair[train[self.owner]], minlength=len(self.first))

    def dealt(self, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in the order of their tasks, and where each task's begin."""
        tasks = deal.of_pairs(self.words[self.first], self.words[self.second])
        order = np.argsort(tasks, kind="stable")
        return order, np.searchsorted(tasks[order], np.arange(deal.tasks + 1))

    def dealt_words(self, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
        tasks = deal.of_words(self.words)
        order = np.argsort(tasks, kind="stable")
        return order, np.searchsorted(tasks[order], np.arange(deal.tasks + 1))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows in batches of about ``CHUNK_BYTES`` of text, whatever batches they come in; no text is cut."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        ends, a = texts(rest.column(2))[1], 0
        while ends[-1] - ends[a] > CHUNK_BYTES:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, side="right")) - 1)
            yield rest.slice(a, b - a)
            a = b
        rest = rest.slice(a)
    if rest is not None:
        yield rest


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, Chunk]]:
    """Chunks of a partition with their numbers, ids and training flags."""
    number = TaskContext.get().partitionId() << 24
    for batch in _filled(batches):
        train = batch.column(1).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(2), NOT_SPACE, lowered=True, size=CHUNK_BYTES):
            a, n = int(chunk.rows[0]), len(chunk.rows)
            yield number, batch.column(0).slice(a, n), train[a : a + n], chunk
            number += 1


def _rows(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def word_blocks(docs: DataFrame, tasks: int) -> DataFrame:
    """For each chunk and task of words, the chunk's words and their numbers in training texts."""
    deal = Deal(tasks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, train, chunk in _chunks(batches):
            n = chunk.counts
            seq = np.concatenate([chunk.hashes() >> U64(16), np.full(len(n), END, U64)])
            words, word = _unique(seq)
            counted = np.concatenate([train[chunk.owner()], train]) if len(n) else np.empty(0, bool)
            counts = np.bincount(word[counted], minlength=len(words)).astype(np.uint32)
            at = deal.of_words(words)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(tasks + 1))
            rows = [(k, number, _short(words[order[a:b]]), _small(counts[order[a:b]])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield _rows([list(c) for c in zip(*rows, strict=True)], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["task", "chunk", "words", "n"])

    return docs.mapInArrow(ask, "task int, chunk long, words binary, n binary").repartition(tasks, "task")


def _totals(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of a task and their numbers."""
    words, n = np.concatenate([_long(b) for b in blocks["words"]]), np.concatenate([_numbers(b) for b in blocks["n"]])
    found, at = np.unique(words, return_inverse=True)
    return found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def _largest(blocks: pd.DataFrame, most: int) -> pd.DataFrame:
    words, n = _totals(blocks)
    top = np.argsort(-n, kind="stable")[:most]
    rows = [(None, int(n.sum()), int((n > 0).sum()))] + [(int(w), int(c), 0) for w, c in zip(words[top], n[top], strict=True)]
    return pd.DataFrame(rows, columns=["word", "n", "v"]).astype({"word": "Int64"})


def pair_blocks(docs: DataFrame, deal: Deal) -> DataFrame:
    """For each chunk and task, the chunk's distinct pairs by first word, with their numbers in training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, train, chunk in _chunks(batches):
            p = Pairs(chunk)
            codes = deal.codes(p.words)
            counts = p.counts(train).astype(np.uint32)
            order, cuts = p.dealt(deal)
            rows = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    own = order[a:b]
                    starts = _runs(p.first[own])
                    sizes = np.diff(np.append(starts, b - a))
                    first, second = p.first[own[starts]], p.second[own]
                    rows.append((k, number, deal.written(p.words[first], codes[first]), _small(sizes), deal.written(p.words[second], codes[second]), _small(counts[own])))
            yield _rows([list(c) for c in zip(*rows, strict=True)], [pa.int32(), pa.int64(), *[pa.binary()] * 4], ["task", "chunk", "first", "sizes", "second", "n"])

    return docs.mapInArrow(ask, "task int, chunk long, first binary, sizes binary, second binary, n binary").repartition(deal.tasks, "task")


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of all seatings of ``c`` customers at ``t`` tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            t = np.arange(1, c + 2)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1 : c + 2])
    return out


def draw_tables(c: np.ndarray, others: np.ndarray, prior: np.ndarray, discount: float, strength: float, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """For dishes of ``c`` customers, the number of their tables, given the restaurant's other tables and the parent's probability."""
    out = np.ones(len(c), np.int64)
    first = np.minimum(c, EXACT)
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(2, EXACT + 2))
    for size, (a, b) in zip(range(2, EXACT + 1), zip(cuts[:-1], cuts[1:], strict=True), strict=True):
        for lo in range(a, b, (1 << 19) // size):
            at = order[lo : min(b, lo + (1 << 19) // size)]
            k = np.arange(size)
            steps = np.log((strength + discount * (others[at][:, None] + k)) * prior[at][:, None])
            weight = np.cumsum(steps, 1) + stirling[size, 1 : size + 1]
            chance = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[at] = 1 + (chance < rng.random(len(at))[:, None] * chance[:, -1:]).sum(1)
    long, seated = np.flatnonzero(c > EXACT), EXACT
    while len(long):
        block = np.minimum(max(1, seated // 32), c[long] - seated)
        fresh = (strength + discount * (others[long] + out[long])) * prior[long]
        chance = fresh / (fresh + np.maximum(seated + (block - 1) / 2 - discount * out[long], 1e-9))
        out[long] += rng.binomial(block, np.clip(chance, 0, 1))
        seated += max(1, seated // 32)
        long = long[c[long] > seated]
    return out


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def strength_weights(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The log likelihood of restaurants' tables for each strength of the grid."""
    both, n = np.unique(np.stack([customers, tables])[:, customers > 0], axis=1, return_counts=True)
    c, t = both[0][:, None].astype(np.float64), both[1][:, None].astype(np.float64)
    return ((_lgamma(_GRID / discount + t) - _lgamma(_GRID / discount + 1) - _lgamma(_GRID + c) + _lgamma(_GRID + 1)) * n[:, None]).sum(0)


def draw_strength(weights: np.ndarray, rng: np.random.Generator) -> float:
    chance = np.exp(weights - weights.max())
    return float(rng.choice(_GRID, p=chance / chance.sum()))


class Restaurants:
    """One task's restaurants, from the questions of all chunks."""

    def __init__(self, blocks: pd.DataFrame, deal: Deal) -> None:
        self.chunks = blocks["chunk"].to_numpy()
        runs = [_numbers(s) for s in blocks["sizes"]]
        self.starts = [np.cumsum(r) - r for r in runs]  # where each chunk's questions of one first word begin
        first, seconds = np.concatenate([np.repeat(deal.read(f), r) for f, r in zip(blocks["first"], runs, strict=True)]), [deal.read(b) for b in blocks["second"]]
        second, n = np.concatenate(seconds), np.concatenate([_numbers(b) for b in blocks["n"]])
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        sums, sizes = [int(x.sum() & U64((1 << 62) - 1)) for x in seconds], [len(x) for x in seconds]
        del first, second, seconds
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        self.dish_of = np.empty(len(order), np.int32)  # of each question
        self.dish_of[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(order))))
        self.sums, self.sizes = sums, sizes
        self.c = np.add.reduceat(n[order].astype(np.int64), new)
        a, b = a[new], b[new]
        del order, n
        self.words, self.word = np.unique(b, return_inverse=True)
        self.names, self.room = np.unique(a, return_inverse=True)
        self.hot = deal.which(self.names)
        self.customers = np.bincount(self.room, weights=self.c, minlength=len(self.names)).astype(np.int64)
        self.scale = np.ones(len(self.names))
        split = self.hot >= 0
        if split.any():
            whole = deal.counts[self.hot[split]]
            self.scale[split] = whole / np.maximum(self.customers[split], 1)
            self.customers[split] = whole
        self.tables = (self.c > 0).astype(np.int64)

    def counts_of_counts(self) -> tuple[int, int]:
        return int((self.c == 1).sum()), int((self.c == 2).sum())

    def sweep(self, prior: np.ndarray, discount: float, strength: float, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
        """Draws all dishes' tables; ``prior`` is the parent's probability of each word. Returns the restaurants' tables."""
        at = np.flatnonzero(self.c > 1)
        full = np.bincount(self.room, weights=self.tables, minlength=len(self.names)) * self.scale
        others = np.maximum(full[self.room[at]] - self.tables[at], 0)
        self.tables[at] = draw_tables(self.c[at], others, prior[self.word[at]], discount, strength, rng, stirling)
        return np.bincount(self.room, weights=self.tables, minlength=len(self.names)).astype(np.int64)

    def dealt(self, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
        """The restaurants' words in the order of their tasks, and where each task's begin."""
        at = deal.of_words(self.words)
        order = np.argsort(at, kind="stable")
        return order, np.searchsorted(at[order], np.arange(deal.tasks + 1))

    def told(self, samples: list[np.ndarray], deal: Deal) -> Iterator[tuple[int, bytes, bytes]]:
        """For each task of words, the words of these restaurants and their tables in each sample."""
        have = np.stack([np.bincount(self.word, weights=t, minlength=len(self.words)) for t in samples]).astype(np.uint32)
        order, cuts = self.dealt(deal)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                yield k, _short(self.words[order[a:b]]), _small(have[:, order[a:b]])


_OUT = "kind string, target long, source int, a binary, b binary, c binary, d binary, e binary, sum long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def _stats(task: int, values: list[float] | np.ndarray, rooms: Restaurants | None = None, parts: np.ndarray | None = None) -> tuple:
    hot = np.flatnonzero(rooms.hot >= 0) if rooms is not None else np.empty(0, np.int64)
    return ("stats", 0, task, np.asarray(values, np.float64).tobytes(), rooms.hot[hot].astype(np.int64).tobytes() if rooms is not None else None, np.ascontiguousarray(parts[:, hot]).tobytes() if parts is not None else None, None, None, 0)


def first_round(blocks: DataFrame, deal: Deal, known: int, seed: int) -> DataFrame:
    """The first sweeps, from parents that a task's own restaurants give; tells tables and how likely strengths are."""

    def seat(part: pd.DataFrame) -> pd.DataFrame:
        task = int(part["task"].iloc[0])
        rooms, rng = Restaurants(part, deal), np.random.default_rng([seed, 1, task])
        ones, twos = rooms.counts_of_counts()
        discount = discount_of(ones, twos)
        has = np.bincount(rooms.word, weights=rooms.tables, minlength=len(rooms.words))
        prior = (has + 1 / (known + 1)) / (has.sum() + 1)
        strength, stirling = 1.0, log_stirling(discount)
        for _ in range(SWEEPS):
            tables = rooms.sweep(prior, discount, strength, rng, stirling)
            plain = rooms.hot < 0
            weights = strength_weights(rooms.customers[plain], tables[plain], discount)
            strength = draw_strength(weights, rng)
        rows = [("told", k, task, w, t, None, None, None, 0) for k, w, t in rooms.told([rooms.tables], deal)]
        return _frame([*rows, _stats(task, [ones, twos, *weights])])

    return blocks.groupBy("task").applyInPandas(seat, _OUT)


def _words_told(part: pd.DataFrame, samples: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of a task, their tables in each sample, and the places of each teller's words."""
    lists = [_long(b) for b in part["a"]]
    words, at = np.unique(np.concatenate(lists), return_inverse=True)
    have = np.concatenate([_numbers(b).reshape(samples, -1) for b in part["b"]], 1)
    sums = np.stack([np.bincount(at, weights=h, minlength=len(words)).astype(np.int64) for h in have])
    return words, sums, np.split(at, np.cumsum([len(x) for x in lists])[:-1])


def first_parent(told: DataFrame, known: int, seed: int) -> DataFrame:
    """Draws the parent's tables of each word; tells the restaurants' tasks what is left of its customers after the discount."""

    def seat(part: pd.DataFrame) -> pd.DataFrame:
        task = int(part["target"].iloc[0])
        part = part.sort_values("source")
        _, (n,), places = _words_told(part, 1)
        rng = np.random.default_rng([seed, 2, task])
        ones, twos = int((n == 1).sum()), int((n == 2).sum())
        discount = discount_of(ones, twos)
        tables = draw_tables(n, np.full(len(n), float(len(n))), np.full(len(n), 1 / (known + 1)), discount, 1.0, rng, log_stirling(discount))
        rows = [("parent", int(source), task, np.float64(discount).tobytes(), _small(n[at]), _small(tables[at]), None, None, 0) for source, at in zip(part["source"], places, strict=True)]
        return _frame([*rows, _stats(task, [ones, twos, n.sum(), tables.sum()])])

    return told.groupBy("target").applyInPandas(seat, _OUT)


def second_round(blocks: DataFrame, parent: DataFrame, deal: Deal, model: dict, seed: int) -> DataFrame:
    """The second sweeps; tells tables, and answers each chunk's questions from the last ones."""

    def seat(part: pd.DataFrame, probabilities: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return _frame([])
        task = int(part["task"].iloc[0])
        part = part.sort_values("chunk", ignore_index=True)
        rooms, rng = Restaurants(part, deal), np.random.default_rng([seed, 3, task])
        left, (order, cuts) = np.zeros(len(rooms.words)), rooms.dealt(deal)
        for x in probabilities.itertuples():
            left[order[cuts[x.source] : cuts[x.source + 1]]] = _numbers(x.b) - np.frombuffer(x.a)[0] * _numbers(x.c)
        prior = (left + model["back"] / (model["known"] + 1)) / model["all"]
        discount, strength = model["discount"], model["strength"]
        stirling, drawn, tables = log_stirling(discount), [], []
        for i in range(SWEEPS + SAMPLES - 1):
            now = rooms.sweep(prior, discount, strength, rng, stirling)
            if i >= SWEEPS - 1:
                drawn.append(rooms.tables.copy())
                tables.append(now)
        parts = np.stack(tables)
        rows = [("told", k, task, w, t, None, None, None, 0) for k, w, t in rooms.told(drawn, deal)]
        seats, at = np.sum(drawn, 0), 0
        for chunk, starts, size, checked in zip(rooms.chunks, rooms.starts, rooms.sizes, rooms.sums, strict=True):
            own = rooms.dish_of[at : at + size]
            at += size
            names = rooms.room[own[starts]]
            rows.append(("pairs", int(chunk), task, _small(rooms.c[own]), _small(seats[own]), _small(parts[:, names]), _small(rooms.customers[names]), None, checked))
        return _frame([*rows, _stats(task, [0.0], rooms, parts)])

    return blocks.groupBy("task").cogroup(parent.select(F.col("target").cast("int").alias("task"), "source", "a", "b", "c").groupBy("task")).applyInPandas(seat, _OUT)


def second_parent(words: DataFrame, told: DataFrame, model: dict, seed: int) -> DataFrame:
    """Draws the parent's tables for each sample, and answers each chunk's questions: numbers of words and what is left of their customers."""

    def seat(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return _frame([])
        task = int(asked["task"].iloc[0])
        found, count = _totals(asked)
        (customers, tables), stats = np.zeros((2, SAMPLES, len(found)), np.int64), []
        if len(part):
            names, sums, _ = _words_told(part.sort_values("source"), SAMPLES)
            rng, stirling, at = np.random.default_rng([seed, 4, task]), log_stirling(model["root_discount"]), np.searchsorted(found, names)
            for s, n in enumerate(sums):
                flat = np.full(len(n), 1 / (model["known"] + 1))
                customers[s, at] = n
                tables[s, at] = np.minimum(n, draw_tables(n, np.full(len(n), model["root_tables"]), flat, model["root_discount"], model["root_strength"], rng, stirling))
                stats += [float(n.sum()), float(tables[s].sum())]
        rows = []
        for chunk, b in zip(asked["chunk"], asked["words"], strict=True):
            own = np.searchsorted(found, _long(b))
            rows.append(("words", int(chunk), task, _small(count[own]), _small(customers[:, own]), _small(tables[:, own]), None, None, int(found[own].sum() & U64((1 << 62) - 1))))
        return _frame([*rows, _stats(task, stats or [0.0] * 2 * SAMPLES)])

    return words.groupBy("task").cogroup(told.select(F.col("target").cast("int").alias("task"), "source", "a", "b").groupBy("task")).applyInPandas(seat, _OUT)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as one row each."""
    for number, ids, train, chunk in _chunks(batches):
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        text = pa.Codec("zstd", compression_level=6).compress(chunk.buf.tobytes(), asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([number]), own, pa.array([train.tobytes()], pa.binary()), pa.array([chunk.offsets.astype(np.int64).tobytes()], pa.binary()), pa.array([text], pa.binary())], names=["chunk", "ids", "train", "offsets", "text"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def answered(packed: DataFrame, answers: DataFrame, deal: Deal, model: dict) -> DataFrame:
    """Each chunk's texts, scored with the answers to its questions."""

    def score(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in part.itertuples():
            offsets = np.frombuffer(r.offsets, np.int64)
            data = pa.Codec("zstd").decompress(r.text, int(offsets[-1]), asbytes=True) if offsets[-1] else b""
            train = np.frombuffer(r.train, bool)
            p = Pairs(Chunk(np.frombuffer(data, np.uint8), offsets, np.arange(len(train)), NOT_SPACE))
            count, left = np.zeros(len(p.words), np.int64), np.zeros((SAMPLES, len(p.words)))
            tables, customers = np.zeros((SAMPLES, len(p.words))), np.zeros(len(p.words))
            own = np.zeros(len(p.first))
            order, cuts = p.dealt(deal)
            by_word, word_cuts = p.dealt_words(deal)
            seen = 0
            for x in found.itertuples():
                if x.kind == "words":
                    at = by_word[word_cuts[x.source] : word_cuts[x.source + 1]]
                    _same(x.sum, p.words[at])
                    count[at] = _numbers(x.a)
                    left[:, at] = _numbers(x.b).reshape(SAMPLES, -1) - model["root_discount"] * _numbers(x.c).reshape(SAMPLES, -1)
                    seen += len(at)
                    continue
                at = order[cuts[x.source] : cuts[x.source + 1]]
                _same(x.sum, p.words[p.second[at]])
                seen += len(at)
                names = p.first[at[_runs(p.first[at])]]
                tables[:, names], customers[names] = _numbers(x.c).reshape(SAMPLES, -1), _numbers(x.d)
                own[at] = (_numbers(x.a) - model["discount"] * _numbers(x.b) / SAMPLES) / (model["strength"] + customers[p.first[at]])
            if seen != len(p.words) + len(p.first):
                raise RuntimeError("a chunk has other texts than when it asked; the table must not change while it is scored")
            hot = deal.which(p.words)
            for s in range(SAMPLES):
                tables[s, hot >= 0] = model["hot_tables"][s][hot[hot >= 0]]
            parent = (left + model["backs"][:, None] / (model["known"] + 1)) / model["alls"][:, None]
            share = (model["strength"] + model["discount"] * tables) / (model["strength"] + customers)
            logs = np.log10(own + (share[:, p.first] * parent[:, p.second]).mean(0))
            base = np.log10((count + 0.5) / (model["tokens"] + 0.5 * (model["known"] + 1)))
            n = len(train)
            sums = lambda x: np.bincount(p.owner, weights=x, minlength=n)  # noqa: B023, E731
            rows.append(pd.DataFrame({"doc_id": pd.array([None if i is None or i != i else int(i) for i in r.ids], "Int64"), "held_out": ~train, "n_tokens": np.bincount(p.owner, minlength=n), "n_known": sums(count[p.word] > 0).astype(np.int64), "train_tokens": model["tokens"], "base_score": sums(base[p.word]), "score": sums(logs[p.pair])}))
        return pd.concat(rows) if rows else pd.DataFrame({x.split()[0]: [] for x in _SCORED.split(", ")})

    columns = ["chunk", "kind", "source", "a", "b", "c", "d", "sum"]
    return packed.groupBy("chunk").cogroup(answers.withColumnRenamed("target", "chunk").select(*columns).groupBy("chunk")).applyInPandas(score, _SCORED)


def _same(told: int, words: np.ndarray) -> None:
    if int(words.sum() & U64((1 << 62) - 1)) != told:
        raise RuntimeError("a chunk has other texts than when it asked; the table must not change while it is scored")


def _read(stats: DataFrame) -> np.ndarray:
    """Totals of the tasks' statistics: one row for each task."""
    rows = [np.frombuffer(r.a, np.float64) for r in stats.select("source", "a").orderBy("source").collect()]
    return np.sum(rows, 0) if rows else np.zeros(64)


def score_texts(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``; ``train`` is a SQL condition of training rows."""
    integer_ids(docs, doc_id)
    with _small_batches(docs.sparkSession):
        return _scored(docs, train, doc_id, text, seed)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark's Arrow batches have ``BATCH_BYTES`` at most; all jobs of a scoring run within."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _scored(docs: DataFrame, train: str, doc_id: str, text: str, seed: int) -> DataFrame:
    tasks, rng = TASKS * partitions(docs.sparkSession), np.random.default_rng([seed, 0])
    docs = docs.select(F.col(doc_id).cast("long"), F.coalesce(F.expr(train), F.lit(False)), text)
    # Questions are read by tasks once or twice and would fill the heap; only what answers them, and is shuffled anyway, stays in memory.
    words = word_blocks(docs, tasks).persist(StorageLevel.DISK_ONLY)
    most = max(_HOT_OF_TASK, -(-FREQUENT // tasks))
    rows = words.groupBy("task").applyInPandas(lambda part: _largest(part, most), "word long, n long, v long").collect()
    tokens, known = sum(r.n for r in rows if r.word is None), sum(r.v for r in rows if r.word is None)
    hot = sorted((r.word, r.n) for r in rows if r.word is not None and r.n * tasks > tokens > 0)
    counts = np.array([n for _, n in hot], np.int64)
    parts = np.minimum(tasks, -(-counts * tasks // max(tokens, 1)))
    frequent = sorted((-r.n, r.word) for r in rows if r.word is not None and r.n)[:FREQUENT]
    deal = Deal(tasks, np.array([w for w, _ in hot], U64), parts, counts, np.array([w for _, w in frequent], U64))
    blocks = pair_blocks(docs, deal).persist(StorageLevel.DISK_ONLY)
    one = first_round(blocks, deal, known, seed).persist(StorageLevel.DISK_ONLY)
    total = _read(one.filter("kind = 'stats'"))
    model = {"known": known, "tokens": tokens, "discount": discount_of(total[0], total[1]), "strength": draw_strength(total[2 : 2 + len(_GRID)] if len(total) > 22 or tokens else np.zeros(len(_GRID)), rng)}
    parent = first_parent(one.filter("kind = 'told'"), known, seed).persist(StorageLevel.DISK_ONLY)
    total = _read(parent.filter("kind = 'stats'"))
    one.unpersist()
    root_discount = discount_of(total[0], total[1])
    root_strength = draw_strength(strength_weights(np.array([total[2]]), np.array([total[3]]), root_discount), rng) if total[2] else 1.0
    model |= {"root_discount": root_discount, "root_strength": root_strength, "root_tables": total[3], "back": root_strength + root_discount * total[3], "all": root_strength + total[2]}
    two = second_round(blocks, parent.filter("kind = 'parent'"), deal, model, seed).persist(StorageLevel.MEMORY_AND_DISK)
    hot_tables = np.zeros((SAMPLES, len(hot)))
    for r in two.filter("kind = 'stats'").select("b", "c").collect():  # the split restaurants' parts in each task
        at = np.frombuffer(r.b, np.int64)
        np.add.at(hot_tables, (slice(None), at), np.frombuffer(r.c, np.int64).reshape(SAMPLES, -1))
    blocks.unpersist()
    parent.unpersist()
    last = second_parent(words, two.filter("kind = 'told'"), model, seed).persist(StorageLevel.MEMORY_AND_DISK)
    total = _read(last.filter("kind = 'stats'"))[: 2 * SAMPLES].reshape(SAMPLES, 2)
    words.unpersist()
    model |= {"hot_tables": hot_tables, "backs": root_strength + root_discount * total[:, 1], "alls": root_strength + total[:, 0]}
    packed = docs.mapInArrow(_packed, "chunk long, ids array<long>, train binary, offsets binary, text binary")
    answers = two.filter("kind = 'pairs'").unionAll(last.filter("kind = 'words'"))
    scored = materialize(answered(packed, answers, deal, model))
    two.unpersist()
    last.unpersist()
    return scored


def op13_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "crc32(coalesce(cast(doc_id AS string), '')) % 5 <> 1")
