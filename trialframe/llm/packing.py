"""Harmonic packing of documents into fixed-length training sequences.

A piece of r tokens belongs to class j = capacity // r: its length lies in
(capacity/(j+1), capacity/j], and a bin of class j takes exactly j such pieces. What such a bin
leaves free is topped up with the head of the next document, which may be cut, so a closed bin is
full. Classes beyond ``classes`` share the last one. Every worker fills its own bins, one partition
at a time, without a shuffle; at its end the open bins are run together, cut at the capacity, and
what is left is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.tokens import WordTokenizer
from trialframe.llm.workers import bound_batches, parts, trim

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
END = 2
CLASSES = 64
Piece = tuple[object, int, np.ndarray, int]  # document, start, ids, the document's tokens


class HarmonicPacker:
    """Feed documents with ``add``; whole sequences come back as lists of pieces."""

    def __init__(self, capacity: int, classes: int = CLASSES) -> None:
        self.capacity, self.classes = capacity, classes
        self.bins: dict[int, list[Piece]] = {}
        self.filling: list[Piece] | None = None
        self.free = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        at, total = 0, len(ids)
        while at < total:
            left = total - at
            if self.filling is not None:
                n = min(left, self.free)
                self.filling.append((doc, at, ids[at : at + n], total))
                at, self.free = at + n, self.free - n
                if not self.free:
                    yield self.filling
                    self.filling = None
            elif left >= self.capacity:
                yield [(doc, at, ids[at : at + self.capacity], total)]
                at += self.capacity
            else:
                kind = min(self.capacity // left, self.classes)
                held = self.bins.setdefault(kind, [])
                held.append((doc, at, ids[at:], total))
                at = total
                if len(held) == kind:
                    del self.bins[kind]
                    self.free = self.capacity - sum(len(p[2]) for p in held)
                    if self.free:
                        self.filling = held
                    else:
                        yield held

    def finish(self) -> Iterator[list[Piece]]:
        """The open bins: full sequences first, then one of each power of two."""
        rest = [p for _, held in sorted(self.bins.items()) for p in held] + (self.filling or [])
        left = sum(len(p[2]) for p in rest)
        self.bins, self.filling = {}, None
        room, row = 0, []
        for doc, start, ids, total in rest:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                row.append((doc, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    yield row
                    row = []


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: document, start, length, its ids (little-endian unsigned 32 bit), and its place.

    ``capacity`` is a power of two. A null or empty text is the end id alone. Rows that repeat an
    id are packed as documents of their own, null ids stay null, an empty table gives no rows, and
    only the id and text columns are read. Memory holds a batch and the open bins, whatever a
    document's length. ``tokenizer_path`` must exist on every worker.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        packer = HarmonicPacker(capacity)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        end = np.array([end_id], np.uint32).tobytes()

        def place(sequences: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                    offset += len(ids)
                sequence += 1

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for part in parts(batches, 1, rows=256):
            texts = tokenizer.ids(part.column(1).to_pylist())
            for doc, ids in zip(part.column(0).to_pylist(), texts, strict=True):
                place(packer.add(doc, np.frombuffer(ids + end, np.uint32)))
            if rows:
                yield out()
        place(packer.finish())
        if rows:
            yield out()
        tokenizer.rest()
        trim()

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scan, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
