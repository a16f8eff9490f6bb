"""Sum-of-squares online packing of token sequences into windows of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import pick, release_memory
from scoutframe.llm.tokens import byte_encoder

Piece = tuple  # (doc_id, start, ids, doc_tokens)


class LevelPacker:
    """Places each piece where the sum over fill levels of (open windows at the level) squared gets smallest.

    ``counts[h]`` is the number of open windows filled to ``h``.  Equal sums go to the fuller window.  At most
    ``most_open`` windows are open: beyond that the fullest window is topped up with ids cut from the emptiest,
    all other placements stay.  Only at the end ``flush`` deals the open pieces out anew.
    """

    def __init__(self, capacity: int, most_open: int = 4096) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.held = 0  # windows that are open

    def best_level(self, size: int) -> int:
        """The fill level, 0 for a new window, that takes a piece of ``size``."""
        n, top = self.counts, self.capacity - size
        # moving a window from h to h + size changes the sum by 2 * (n[h + size] - n[h]) + 2
        change = 2 * (n[size:] - n[: top + 1]) + 2
        change[top] = 1 - 2 * n[top]  # a full window leaves the array
        change[0] = 2 * n[size] + 1 if top else 0
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[list[Piece]]:
        """Full windows that come of it."""
        size = len(piece[2])
        level = self.best_level(size)
        window = self.open[level].pop() if level else []
        self.counts[level] -= bool(level)
        window.append(piece)
        if level + size == self.capacity:
            self.held -= bool(level)
            return [window]
        self.open[level + size].append(window)
        self.counts[level + size] += 1
        self.held += not level
        return self._close_fullest() if self.held > self.most_open else []

    def _close_fullest(self) -> list[list[Piece]]:
        """The fullest window, filled with the last ids of the emptiest ones; none if all together do not fill it."""
        levels = np.flatnonzero(self.counts)
        full, low = int(levels[-1]), int(levels[0])
        window = self.open[full].pop()
        self.counts[full] -= 1
        self.held -= 1
        room = self.capacity - full
        while room and self.held:
            while not self.counts[low]:
                low += 1
            giver = self.open[low].pop()
            self.counts[low] -= 1
            doc, start, ids, total = giver.pop()
            keep = max(0, len(ids) - room)
            window.append((doc, start + keep, ids[keep:], total))
            room -= len(ids) - keep
            left = low - (len(ids) - keep)
            if keep:
                giver.append((doc, start, ids[:keep], total))
            if left:
                self.open[left].append(giver)
                self.counts[left] += 1
                low = left
            else:
                self.held -= 1
        if not room:
            return [window]
        self.open[self.capacity - room].append(window)
        self.counts[self.capacity - room] += 1
        self.held += 1
        return []

    def flush(self) -> list[list[Piece]]:
        """At the end: the open pieces cut into full windows, what is left in windows whose sizes are powers of two."""
        pieces = [p for level in self.open for window in level for p in window]
        self.open = [[] for _ in range(self.capacity + 1)]
        self.counts[:] = self.held = 0
        left = sum(len(p[2]) for p in pieces)
        out, window, room = [], [], self._room(left)
        for doc, start, ids, total in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                window.append((doc, start, part, total))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if room == 0:
                    out.append(window)
                    window, room = [], self._room(left)
        return out

    def _room(self, left: int) -> int:
        """Capacity, or the largest power of two that the ids left fill."""
        return self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    rows_per_batch: int = 4096,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    A document is its ids and ``end_id``; whole windows are cut off a long one and the rest is placed online.
    ``ids`` holds little-endian unsigned 32-bit integers.  Each input partition packs its own documents, so
    nothing is shuffled, and pads nothing: its last windows have sizes that are powers of two.  ``sequence_id``
    is unique in the result.  NULL or empty text is ``end_id`` alone; NULL and repeated ids are rows as any other;
    other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        packer = LevelPacker(capacity)
        base, rows = TaskContext.get().partitionId() << 40, []
        made, encode, end = 0, byte_encoder(tokenizer).encode, end_id.to_bytes(4, "little")

        def emit(windows):
            nonlocal made
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    rows.append((doc, start, len(ids), ids.tobytes(), total, base + made, offset))
                    offset += len(ids)
                made += 1

        def table():
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(encode(value.as_py() or "") + end, "<u4")
                whole = len(ids) - len(ids) % capacity
                emit([[(doc, i, ids[i : i + capacity], len(ids))] for i in range(0, whole, capacity)])
                if whole < len(ids):
                    emit(packer.place((doc, whole, ids[whole:], len(ids))))
                if len(rows) >= rows_per_batch:
                    yield table()
        emit(packer.flush())
        if rows:
            yield table()

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
