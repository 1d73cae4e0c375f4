"""Harmonic packing of token sequences.

What is left of a document after its full sequences belongs to a class: with room for ``capacity``
tokens, class k holds the lengths over capacity / (k + 1) and up to capacity / k, and a bin of
class k takes exactly k of them. Classes do not interact, so every Spark task fills bins of its own
and nothing is shuffled.

A bin that is full by count is cut into sequences of powers of two, which need no padding. What
remains below ``least`` tokens goes back to its class as a shorter piece; at the end of a task the
last pieces are cut down to powers of two as well.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sugarline.llm.common import released, small_batches, text_blocks
from sugarline.llm.tokens import default_tokenizer, word_ids

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
#: A piece: doc_id, place of its first token, its ids (4 bytes each), tokens of its document.
Piece = tuple[int | None, int, memoryview, int]


class Bins:
    """The bins of one task."""

    def __init__(self, capacity: int = 2048, least: int = 128, most_padding: int = 32, first_id: int = 0):
        if capacity & (capacity - 1) or least & (least - 1):
            raise ValueError("capacity and least must be powers of two")
        self.capacity, self.least, self.most_padding = capacity, least, most_padding
        self.open: dict[int, list[Piece]] = defaultdict(list)
        self.next_id = first_id
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        view, total, wide = memoryview(ids), len(ids) // 4, 4 * self.capacity
        full = len(ids) - len(ids) % wide
        for at in range(0, full, wide):
            self._emit([(doc_id, at // 4, view[at : at + wide], total)])
        if full < len(ids):
            self._put((doc_id, full // 4, view[full:], total))

    def _put(self, piece: Piece) -> None:
        waiting = [piece]
        while waiting:
            piece = waiting.pop()
            k = self.capacity // (len(piece[2]) // 4)
            held = self.open[k]
            held.append(piece)
            if len(held) == k:
                del self.open[k]
                waiting += self._close(held, self.least)

    def _close(self, pieces: list[Piece], least: int) -> list[Piece]:
        """Emit a bin as sequences of powers of two from the largest down to ``least``; what is left."""
        total = sum(len(p[2]) for p in pieces) // 4
        if 0 <= self.capacity - total <= self.most_padding:
            self._emit(pieces)
            return []
        size = self.capacity
        while size >= least:
            if total >= size:
                head, pieces = _split(pieces, size)
                self._emit(head)
                total -= size
            size //= 2
        return pieces

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def finish(self) -> None:
        """Close all bins, the fullest classes first, as far as whole sequences go; then the rest."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        while sum(len(p[2]) for p in pieces) >= 4 * self.capacity:
            head, pieces = _split(pieces, self.capacity)
            self._emit(head)
        self._close(pieces, 1)


def _split(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` tokens, and the rest; a piece across the edge is cut."""
    head: list[Piece] = []
    for i, (doc_id, start, ids, total) in enumerate(pieces):
        n = len(ids) // 4
        if n > size:
            rest = [(doc_id, start + size, ids[4 * size :], total), *pieces[i + 1 :]]
            return ([*head, (doc_id, start, ids[: 4 * size], total)] if size else head), rest
        head.append(pieces[i])
        size -= n
    return head, []


def packed(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text): see ``SCHEMA``.

    Every document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Repeated
    rows are packed one by one; a null doc_id stays null; a long text fills as many sequences as it
    needs; extra columns are ignored; no rows give no result. A sequence_id holds the task's number
    in its high bits, so ids of different tasks never meet.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = word_ids(path)
        bins = Bins(capacity, first_id=TaskContext.get().partitionId() << 36)
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def rows() -> pa.RecordBatch:
            columns = list(zip(*bins.rows, strict=True)) or [[]] * len(names)
            bins.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        try:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for a, b, texts in text_blocks(batch.column(1)):
                    for doc_id, text in zip(doc_ids[a:b], texts, strict=True):
                        bins.add(doc_id, ids.of(text or "") + end)
                yield rows()
            bins.finish()
            yield rows()
        finally:
            ids.clear()

    return docs.select("doc_id", "text").mapInArrow(released(fill), SCHEMA)
