"""Licence scans: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is any run of words of a text, over line ends, ``SLACK`` times as long as the template; so it has room for comment marks
and the like, and scattered words of a long text don't make a notice. A text meets a template if some block holds at least the
share ``THRESHOLD`` of the template's distinct words. Templates may be sentences or whole licences. Blocks are sought in
windows that lie half over each other and hold every block of the longest template. The join is exact:

* words are ordered by how many windows of the whole corpus hold them, rarest first (counted over all documents);
* prefix filter: a window that lacks all of the first ``n - need + 1`` words of a template's n can't hold ``need``;
* length filter: a window of fewer than ``need`` distinct words can't either;
* positional filter: from the first common word in the order, what is left of template and window bounds the overlap;
* what passes is counted out, block by block.

Templates are the stated query set, given as a parameter and broadcast with the plan: their number doesn't grow with the data.

Cases: null is an empty text: no words, no labels, score 0. Equal words of a block count once. Templates of one label
may be several; one without words is met by nothing. Without templates only phrases are found. Repeated rows are scanned each. Null
and repeated doc_ids stay as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from .words import ALNUM, Chunk, chunks

#: Fixed values of the contract: phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences of public licences and usual notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    # Whole licences.
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
THRESHOLD = 0.8
#: Words of a block for each word of a template.
SLACK = 1.5


def _words(text: str) -> list[bytes]:
    chunk = next(iter(chunks(pa.array([text], pa.string()), ALNUM, lowered=True)))
    return [chunk.word(i) for i in range(len(chunk.starts))]


def _hash(words: Sequence[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words), np.uint8)
    return Chunk(joined, np.array([0, len(joined)]), np.zeros(1, np.int64), ALNUM).hashes()


def _cut(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one word of the parts between the edges; those of more than ``size`` words give several, each half over the next."""
    low, high = edges[:-1], edges[1:]
    more = np.maximum(1, -(-(high - low - size // 2) // (size // 2)))
    start = np.repeat(low, more) + (size // 2) * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    return start, np.minimum(start + size, np.repeat(high, more))


def _windows(chunk: Chunk, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that hold all runs of ``longest`` words of the chunk's texts, in order and with a word in at most two."""
    return _cut(np.unique(chunk.first), 2 * longest)


def _holding(blocks: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks that hold some of the words, and these words; a word lies in at most two."""
    first, last = blocks
    if not len(first):
        return
    newest = np.searchsorted(first, words, "right") - 1
    for block in (newest, newest - 1):
        inside = (block >= 0) & (words < last[block])
        yield block[inside], words[inside]


def word_frequencies(docs: DataFrame, text: str, words: list[bytes], longest: int) -> dict[bytes, int]:
    """How many windows of all documents hold each of the words; as many rows as words."""
    if not words:
        return {}
    hashes = _hash(words)
    order = np.argsort(hashes)
    known, names = hashes[order], [words[i] for i in order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0), ALNUM, lowered=True):
                h = chunk.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                place = np.flatnonzero(known[at] == h)
                for block, held in _holding(_windows(chunk, longest), place):
                    pairs = np.unique(block * len(known) + at[held])
                    total += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known), dtype=np.int32)), pa.array(total)], names=["word", "blocks"])

    rows = docs.select(text).mapInArrow(count, "word int, blocks long").groupBy("word").agg(F.sum("blocks").alias("blocks")).collect()
    return {names[r.word]: r.blocks for r in rows}


def _run(template: str) -> int:
    """Words of a run that may hold the template."""
    return int(np.ceil(SLACK * len(_words(template))))


class Templates:
    """Templates in the global order, with prefixes and needs."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> None:
        self.sets, self.labels, self.need = [], [], []
        self.by_prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        rank = sorted({w for _, t in templates for w in _words(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(rank)}
        for label, text in templates:
            ordered = sorted(set(_words(text)), key=self.rank.__getitem__)
            if not ordered:
                continue
            need = int(np.ceil(threshold * len(ordered) - 1e-9))
            for i in range(len(ordered) - need + 1):
                self.by_prefix[ordered[i]].append((len(self.sets), i))
            self.sets.append(frozenset(ordered))
            self.labels.append(label)
            self.need.append(need)
        self.prefix = np.sort(_hash(list(self.by_prefix))) if self.by_prefix else np.empty(0, np.uint64)
        self.runs = [_run(t) for _, t in templates if _words(t)]
        self.longest = max([1, *self.runs])

    def of(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Labels and containment of the templates that a block in the window meets."""
        block = set(words)
        common = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        tried = set()
        for i, word in enumerate(common):
            for k, j in self.by_prefix.get(word, ()):
                need = self.need[k]
                if k in tried or len(block) < need:
                    continue
                tried.add(k)  # the first common word of the order bounds the overlap
                if min(len(self.sets[k]) - j, len(common) - i) < need:
                    continue
                overlap = len(self.sets[k].intersection(common))
                if overlap >= need:
                    overlap = _most(words, self.sets[k], self.runs[k])
                if overlap >= need:
                    yield self.labels[k], overlap / len(self.sets[k])


def _most(words: list[bytes], template: frozenset[bytes], size: int) -> int:
    """The most distinct words of the template that ``size`` words in a row hold."""
    inside, most = Counter(), 0
    for i, word in enumerate(words):
        if word in template:
            inside[word] += 1
        if i >= size and words[i - size] in template:
            inside[words[i - size]] -= 1
            inside += Counter()  # drops zeros
        most = max(most, len(inside))
    return most


def _scan(chunk: Chunk, templates: Templates, phrases: list[tuple[np.ndarray, list[bytes], str]]) -> list[list]:
    h = chunk.hashes()
    n = len(chunk.rows)
    places: list[list[int]] = [[] for _ in range(n)]
    base: list[set[str]] = [set() for _ in range(n)]
    more: list[set[str]] = [set() for _ in range(n)]
    score = [0.0] * n
    for hashes, words, label in phrases:
        size = len(words)
        hit = np.ones(max(0, len(h) - size + 1), bool)
        for i, x in enumerate(hashes):
            hit &= h[i : len(h) - size + 1 + i] == x
        at = np.flatnonzero(hit)
        owner = np.searchsorted(chunk.first, at, "right") - 1
        for p, d in zip(at.tolist(), owner.tolist(), strict=True):
            if p + size <= chunk.first[d + 1] and all(chunk.word(p + i) == w for i, w in enumerate(words)):
                places[d].append(p - int(chunk.first[d]))
                base[d].add(label)
                score[d] = 1.0
    if len(templates.prefix):
        known = np.minimum(np.searchsorted(templates.prefix, h), len(templates.prefix) - 1)
        begins = np.flatnonzero(templates.prefix[known] == h)
        windows = _windows(chunk, templates.longest)
        held = np.unique(np.concatenate([np.zeros(0, np.int64), *(b for b, _ in _holding(windows, begins))]))
        for lo, hi in zip(windows[0][held].tolist(), windows[1][held].tolist(), strict=True):
            d = int(np.searchsorted(chunk.first, lo, "right")) - 1
            for label, share in templates.of([chunk.word(i) for i in range(lo, hi)]):
                more[d].add(label)
                score[d] = max(score[d], share)
    join = lambda x: ",".join(sorted(x))
    return [chunk.counts.tolist(), [len(p) for p in places], [min(p, default=None) for p in places], [max(p, default=None) for p in places], [join(x) for x in base], [join(x | y) for x, y in zip(base, more, strict=True)], score]


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is the largest containment of a template that is met, 1 for a whole phrase, 0 if nothing is found.
    """
    vocabulary = sorted({w for _, t in templates for w in _words(t)})
    ready = Templates(templates, word_frequencies(docs, text, vocabulary, max([1, *(_run(t) for _, t in templates)])), threshold)
    phrases = [(_hash(w), w, label) for p, label in PHRASES for w in [p.encode().split()]]
    shared = docs.sparkSession.sparkContext.broadcast((ready, phrases))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), ALNUM, lowered=True):
                found = _scan(chunk, *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows)), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names=names)

    return docs.select(doc_id, text).mapInArrow(scan, schema)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id"))
