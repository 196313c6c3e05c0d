"""Token counts of a unigram tokenizer, without making tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary reports every piece that ends at each character of a word. Dynamic
programming carries, for each end, the best score and the number of pieces of its path. The rules are those of
the usual unigram encoder: a later start replaces an earlier one only with a higher score; a character that is no
piece is unknown, at 10 below the lowest score; unknowns in a row are one token, or, if the vocabulary has the 256 byte
pieces, as many as their UTF-8 has bytes (byte fallback).

The vocabulary is a parameter: pieces with scores. ``read_vocabulary`` takes the normal and byte pieces of a SentencePiece file;
where a file only ranks its pieces, the scores are the logarithms of Zipf's law over the ranks. A word is a longest
run without white space, led by the word mark.

Cases: a null, empty or wordless text has no tokens. Words are counted once per task and kept in a table of bounded
size; very long words are counted anew in linear time. Repeated rows, null and repeated ids are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources import read_table
from .words import texts

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
KEPT, LONG = 1_000_000, 60
_BYTES = frozenset(f"<0x{b:02X}>" for b in range(256))


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Normal pieces and scores of a SentencePiece file, then its byte pieces, whose scores say nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [(p, -math.log(i + 1)) for i, p in enumerate(pieces)] + [(model.id_to_piece(i), 0.0) for i in range(model.get_piece_size()) if model.is_byte(i)]


class Counter(dict):
    """Words (as bytes) to numbers of tokens; what is missing is counted."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]) -> None:
        super().__init__()
        self.fallback = _BYTES.issubset(piece for piece, _ in vocabulary)
        if self.fallback:  # byte pieces stand for no text
            vocabulary = [x for x in vocabulary if x[0] not in _BYTES]
        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        if not self.single.issuperset(text):
            return self.count_unknown(text)
        n = len(text)
        best, pieces = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        # Ends come in order, and of one end the longest piece, so the earliest start, first.
        for at, (size, score) in self.find.iter(text):
            end, start = at + 1, at + 1 - size
            score += best[start]
            if score > best[end]:
                best[end], pieces[end] = score, pieces[start] + 1
        return pieces[n]

    def count_unknown(self, text: str) -> int:
        """The same with characters that are no pieces."""
        n = len(text)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found = self.find.iter(text)
        at, match = next(found, (n, None))
        for end in range(1, n + 1):
            top, start, single = -math.inf, -1, False
            while at == end - 1:
                size, score = match
                score += best[end - size]
                # Earlier starts win ties.
                if score > top or (score == top and end - size < start):
                    top, start = score, end - size
                single = single or size == 1
                at, match = next(found, (n, None))
            if not single and best[end - 1] + self.unknown > top:
                best[end], unknown[end] = best[end - 1] + self.unknown, True
                pieces[end] = pieces[end - 1] + (len(text[end - 1].encode()) if self.fallback else not unknown[end - 1])
            else:
                best[end], pieces[end] = top, pieces[start] + 1
        return pieces[n]

    def __missing__(self, word: bytes) -> int:
        n = self.count(MARK + word.decode("utf-8", "replace"))
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


_LAST: list = [None, None]


def _counter(vocabulary: list[tuple[str, float]]) -> Counter:
    """The counter of this worker, which later tasks of one vocabulary find filled."""
    if _LAST[0] != vocabulary:
        _LAST[:] = [vocabulary, Counter(vocabulary)]
    return _LAST[1]


def token_counts(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            n_words, n_tokens = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
            for i in range(len(n_words)):
                words = buf[offsets[i] : offsets[i + 1]].tobytes().split()
                n_words[i], n_tokens[i] = len(words), sum(map(counter.__getitem__, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(doc_id, text).mapInArrow(scan, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_tokens long")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id"), read_vocabulary())
