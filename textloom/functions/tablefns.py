"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class DocChunks:
    """Pieces of a document's sentences, given as they come.

    Called on sentences partitioned by document and ordered within it; yields a piece
    as soon as it is full and keeps no more than one.
    """

    def __init__(self) -> None:
        self.doc, self.chunk, self.six, self.sents = None, 0, [], []

    def eval(self, sent: Row, size: int) -> Iterator[tuple]:
        if size < 1:
            raise ValueError(f"chunk size {size}")
        self.doc = sent["doc_id"]
        self.six.append(sent["six"])
        self.sents.append(sent["sent"])
        if len(self.six) >= size:
            yield self._piece()

    def terminate(self) -> Iterator[tuple]:
        if self.six:
            yield self._piece()

    def _piece(self) -> tuple:
        out = self.doc, self.chunk, self.six, self.sents
        self.chunk, self.six, self.sents = self.chunk + 1, [], []
        return out


DOC_CHUNKS = "doc_id bigint, chunk_id int, six array<int>, sents array<string>"


def register(spark: SparkSession) -> None:
    """Makes ``doc_chunks(TABLE(t) PARTITION BY (doc_id) ORDER BY (six), n)`` callable."""
    spark.udtf.register("doc_chunks", F.udtf(DocChunks, returnType=DOC_CHUNKS))
