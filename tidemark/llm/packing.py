"""Bounded-space online best-fit packing of token pieces into fixed-length sequences.

Each task streams its documents once: a text becomes ids plus an end id, only longer ones are cut (the short remainder
first, then full pieces, which are sequences by themselves), and every shorter piece goes to the fullest open sequence
that still holds it. Open sequences hang on a bitset keyed by free space, so both the best fit and the fullest one are
a lowest-set-bit away; their number is fixed, and when one more is needed the fullest closes. A task holds the pieces
of its open sequences, at most ``open_bins`` times ``capacity`` tokens, and gives them out when these close.

The pieces are written to the shared folder once. What tasks still had open at their end, a bounded share of each, is
joined whole, largest first, among neighbouring tasks; the pieces of closed sequences are not moved again.

Null texts count as empty and give a piece holding the end id alone. Repeated rows are packed each. Empty tables give
no rows. Further columns are ignored. Ties go to the sequence opened last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec, ids_crc32
from tidemark.llm.common import checkpoint, text_slices, texts

OPEN_BINS = 512
TASKS_JOINED = 8
#: Bytes of text encoded at once.
SLICE = 1 << 18
#: Set in the numbers of sequences that hold what several tasks had open.
JOINED = 1 << 62


class OpenBins:
    """At most ``limit`` open bins of ``capacity``; the fullest closes when one more is needed."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self._with: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
        self._bits = 0
        self._open = 0
        self._next = 0
        #: The bin that the last call closed, if any.
        self.closed: int | None = None

    def _add(self, number: int, free: int) -> None:
        self._with[free].append(number)
        self._bits |= 1 << free
        self._open += 1

    def _take(self, free: int) -> int:
        number = self._with[free].pop()
        if not self._with[free]:
            self._bits &= ~(1 << free)
        self._open -= 1
        return number

    def fresh(self) -> int:
        self._next += 1
        return self._next - 1

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset for an item of ``size`` (1 to capacity)."""
        self.closed = None
        fits = self._bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self._open >= self.limit:
                self.closed = self._take((self._bits & -self._bits).bit_length() - 1)
            number, free = self.fresh(), self.capacity
        if free > size:
            self._add(number, free - size)
        return number, self.capacity - free

    def left(self) -> list[tuple[int, int]]:
        """Open bins and what they hold."""
        return [(n, self.capacity - free) for free, numbers in enumerate(self._with) for n in numbers]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else the remainder first and then full pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``; ``ids`` is null unless ``keep_ids``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins, task = codec(path), OpenBins(capacity, open_bins), TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}  # pieces of open bins
        schema = None

        def rows(pieces: list[tuple], still_open: bool) -> pa.RecordBatch:
            n = len(pieces)
            columns = list(zip(*pieces)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, schema)), pa.array([still_open] * n, pa.bool_())], names=["task", *schema.names, "open"])

        for batch in text_slices(batches, limit=SLICE):
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), *((c, pa.int64()) for c in ("ids_crc32", "bin", "offset"))])
            done: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode_batch(texts(batch))):
                ids = np.append(ids, np.int32(end_id))
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    number, offset = (bins.fresh(), 0) if length == capacity else bins.place(length)
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, part.copy() if keep_ids else None, ids_crc32(part), number, offset)
                    if length == capacity:
                        done.append(row)
                        continue
                    held.setdefault(number, []).append(row)
                    if bins.closed is not None:
                        done += held.pop(bins.closed)
                    if offset + length == capacity:
                        done += held.pop(number)
            yield rows(done, False)
        if schema:
            yield rows([r for pieces in held.values() for r in pieces], True)

    def join_open(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("task", "ascending"), ("bin", "ascending"), ("offset", "ascending")])
        task, number, length = (rows.column(c).to_numpy() for c in ("task", "bin", "length"))
        first = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (number[1:] != number[:-1])]))
        sizes = np.add.reduceat(length, first)
        bins = OpenBins(capacity, len(first))
        to, base = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            to[i], base[i] = bins.place(int(sizes[i]))
        pieces = np.diff(np.append(first, len(length)))
        own = {"sequence_id": pa.array((JOINED | key[0].as_py() << 32) + np.repeat(to, pieces)), "offset": pa.array(rows.column("offset").to_numpy() + np.repeat(base, pieces))}
        return pa.table({c: own.get(c, rows.column(c) if c in rows.column_names else None) for c in (*shared, "sequence_id", "offset")})

    shared = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]
    piece = f"doc_id {kind}, piece int, start long, length long, ids array<int>, ids_crc32 long"
    placed = checkpoint(docs.select("doc_id", "text").mapInArrow(place, f"task long, {piece}, bin long, offset long, open boolean"))
    closed = placed.where("not open").select(*shared, (F.shiftleft("task", 32) + F.col("bin")).alias("sequence_id"), "offset")
    opened = placed.where("open").drop("open").groupBy(F.floor(F.col("task") / TASKS_JOINED).alias("tasks")).applyInArrow(join_open, f"{piece}, sequence_id long, offset long")
    return closed.unionByName(opened)
