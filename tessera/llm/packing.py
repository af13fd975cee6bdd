"""Sum-of-squares online packing of documents into token windows.

A level array counts the partially filled windows by fill level. Each document goes, as it comes, to the level
where the sum of the squared counts becomes least; ties go to the fuller window. What a document has beyond
whole windows is cut off first and fills windows alone. Each task packs its own stream, so tasks share nothing
and a lost one is run again alone. When its stream ends, the windows left open are closed by moving the
emptiest ones' pieces, cut where need be, into the gaps of the fullest: one window of a task is padded at most.

Null texts are empty and still hold their end id. Repeated rows are packed one by one. A null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, tidy
from .pieces import PieceCoder

WINDOW = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Places pieces (size, anything) into windows; full ones are handed to emit."""

    def __init__(self, window: int, emit) -> None:
        self.window, self.emit = window, emit
        self.counts = np.zeros(window + 1, np.int64)  # of open windows by fill level; 0 and window stay 0
        self.open: list[list] = [[] for _ in range(window + 1)]

    def place(self, size: int, piece) -> None:
        w, n = self.window, self.counts
        if size == w:
            self.emit([piece])
            return
        levels = np.flatnonzero(n[: w - size + 1])
        best, level = 2 * int(n[size]) + 1, 0
        if len(levels):
            to = levels + size
            grown = 2 * (n[to] - n[levels]) + np.where(to == w, 1, 2)
            i = len(levels) - 1 - int(np.argmin(grown[::-1]))
            if grown[i] <= best:
                level = int(levels[i])
        held = self.open[level].pop() if level else []
        n[level] -= level > 0
        held.append(piece)
        if level + size == w:
            self.emit(held)
        else:
            self.open[level + size].append(held)
            n[level + size] += 1

    def left(self) -> list[tuple[int, list]]:
        """The open windows, the fullest first."""
        return [(level, held) for level in range(self.window, 0, -1) for held in self.open[level]]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document; see SCHEMA. sequence_id is unique over all tasks."""

    def run(batches):
        coder = PieceCoder(path, value=lambda ids: np.asarray(ids, "<u4").tobytes(), limit=300_000)
        tail, base = np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        serial = [0]

        def emit(held):
            offset = 0
            for doc_id, start, ids, doc_tokens in held:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, base + serial[0], offset))
                offset += len(ids) // 4
            serial[0] += 1

        def flush():
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        packer = SumOfSquares(window, emit)
        for batch in (part for whole in batches for part in slices(whole, 1, 2**22)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join([*coder.values(text.as_py() or ""), tail])
                n = len(ids) // 4
                whole = n // window * window
                for start in range(0, whole, window):
                    emit([(doc_id, start, ids[4 * start : 4 * (start + window)], n)])
                if whole < n:
                    packer.place(n - whole, (doc_id, whole, ids[4 * whole :], n))
            yield flush()
        left = packer.left()
        while left:
            level, held = left.pop(0)
            while level < window and left:
                size, other = left.pop()
                doc_id, start, ids, n = other.pop()
                take = min(window - level, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    other.append((doc_id, start + take, ids[4 * take :], n))
                level += take
                if size > take:
                    left.append((size - take, other))
            emit(held)
        yield flush()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(tidy(run), SCHEMA)
