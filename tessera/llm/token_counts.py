"""Token counts by overlap resynchronisation.

A huge text is encoded in chunks that overlap. Two neighbours are spliced at a place in their overlap that is
a token boundary of both and provably stable: a space with a non-space on both sides, where the pre-tokenizer
always cuts. Where an overlap has no such place, it is widened and encoded again, at last up to the text's end.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows each give a row; a null doc_id stays null; other
columns are not read. Texts with special strings are encoded whole, as the library does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import PieceCoder

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
LIMIT = 512


class Resynchroniser:
    def __init__(self, coder: PieceCoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.coder, self.chunk, self.overlap = coder, chunk, overlap
        self.lengths = np.zeros(max(coder.vocabulary.bytes) + 1, np.int64)
        for i, b in coder.vocabulary.bytes.items():
            self.lengths[i] = len(b)

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of a chunk end."""
        return np.cumsum(self.lengths[np.asarray(self.coder.engine.encode_ordinary(text), np.int64)])

    @staticmethod
    def stable(text: str, low: int, high: int) -> list[int]:
        """Places low < p < high - 1 of spaces that always begin a pre-token, the last first."""
        found, p = [], high
        while (p := text.rfind(" ", low + 1, p)) > low:
            if p + 1 < len(text) and not text[p - 1].isspace() and not text[p + 1].isspace() and p + 1 < high:
                found.append(p)
        return found

    def count(self, text: str) -> int:
        start, total, over = 0, 0, self.overlap  # start: where the last splice is
        while True:
            end = min(len(text), start + self.chunk + over)
            if end == len(text):
                return total + len(self.coder.engine.encode_ordinary(text[start:]))
            left = self.ends(text[start:end])
            here = end - over  # the next chunk begins here
            right = set(self.ends(text[here : min(len(text), end + over)]).tolist())
            skip, splice = len(text[start:here].encode()), None
            for p in self.stable(text, here, end):
                at = len(text[here:p].encode())
                i = int(np.searchsorted(left, skip + at))
                if at in right and i < len(left) and left[i] == skip + at:
                    splice, total, over = p, total + i + 1, self.overlap
                    break
            if splice is None:
                over *= 2
            else:
                start = splice


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every row of docs."""

    def run(batches):
        coder = PieceCoder(path)
        resync = Resynchroniser(coder, chunk, overlap)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                split = len(text) > huge and not any(s in text for s in coder.specials)
                n_tokens.append(resync.count(text) if split else sum(coder.values(text)))
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
