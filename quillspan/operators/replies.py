"""Sources of replies that go through a document's chunks in order and remember what they have chosen."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..settings import PASSES

#: Called with a chunk's row, the name of the pass and the texts chosen so far; answers with entries (text, importance, reason).
Answer = Callable[[Row, str, list[str]], list[dict[str, str]]]


def table_source(answer: Answer, mode: str = "balanced") -> Callable[[DataFrame], DataFrame]:
    """A source for ``requests.analyze``: doc_id, chunk_no, pass_no, reply and error for each chunk and pass of ``mode``.

    A table function takes each document's chunks in order, in one task, and calls ``answer`` for one pass after the other, with all texts that the
    document's earlier passes gave. Where ``answer`` raises, or what it gives is no list of entries, ``reply`` is null and ``error`` says why: further passes of the chunk aren't
    asked, and after a failed primary pass no further chunk of that document; other documents go on. ``doc_id`` may be of any type. A document
    needs memory for one chunk and its chosen texts.
    """
    names = [name for name, _ in PASSES[mode]]

    class Source:
        @staticmethod
        def analyze(chunks: AnalyzeArgument) -> AnalyzeResult:
            replies = StructType().add("doc_id", chunks.dataType["doc_id"].dataType).add("chunk_no", IntegerType()).add("pass_no", IntegerType()).add("reply", StringType()).add("error", StringType())
            return AnalyzeResult(schema=replies, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("chunk_no")])

        def __init__(self) -> None:
            self.chosen: list[str] = []
            self.lost = False

        def eval(self, chunk: Row) -> Iterator[tuple]:
            for number, name in enumerate(names if not self.lost else ()):
                reply = error = None
                try:
                    entries = answer(chunk, name, list(self.chosen))
                    reply = json.dumps({"highlights": entries}, ensure_ascii=False)
                    self.chosen += [e["text"] for e in entries]
                except Exception as e:  # noqa: BLE001 - whatever a caller's function raises is a row
                    reply, error = None, f"{type(e).__name__}: {e}"
                yield chunk["doc_id"], chunk["chunk_no"], number, reply, error
                if error is not None:
                    self.lost = number == 0
                    return

    return lambda chunks: udtf(Source)(chunks.asTable())
