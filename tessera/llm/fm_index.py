"""An FM-index over words: wavelet matrix, ranks on packed bits, backward search for many patterns in step."""

from __future__ import annotations

import numpy as np


#: The lowest k bits, for each k.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)
#: Patterns sought in step: their intervals stay in a processor's cache.
STEP = 8192


class Bits:
    """A packed bit row with ranks: one count for each 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before i."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & _BELOW[i & 63])


class FMIndex:
    """tokens: whole numbers; the last is the only or a least one. Patterns of up to depth tokens can be sought."""

    def __init__(self, tokens: np.ndarray, depth: int) -> None:
        n = len(tokens)
        self.n = n
        rank, length = tokens.astype(np.int64), 1  # a copy
        order = np.argsort(rank)
        while length < depth:
            later = np.full(n, -1, np.int64)
            later[: n - length] = rank[length:]
            key = rank * (n + 2) + later + 1
            order = np.argsort(key)  # equal keys may come in any order
            held = key[order]
            rank[order] = np.cumsum(np.r_[False, held[1:] != held[:-1]]) if n else 0
            length *= 2
            if n and rank[order[-1]] == n - 1:
                break  # all suffixes differ by now
        last = tokens[order - 1].astype(np.int64)  # before the first suffix stands the last token
        self.sigma = int(tokens.max(initial=0)) + 1
        self.bits_of = max(1, int(self.sigma - 1).bit_length())
        self.counts = np.bincount(tokens, minlength=self.sigma)
        self.first = np.r_[0, np.cumsum(self.counts)[:-1]]
        self.rows = []
        row = last
        for level in range(self.bits_of - 1, -1, -1):
            bit = (row >> level) & 1
            self.rows.append(Bits(bit.astype(bool)))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.start = self._down(np.zeros(self.sigma, np.int64), np.arange(self.sigma))

    def _down(self, i: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for level, row in zip(range(self.bits_of - 1, -1, -1), self.rows, strict=True):
            one = ((symbols >> level) & 1).astype(bool)
            ones = row.ones(i)
            i = np.where(one, row.zeros + ones, i - ones)
        return i

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        base = self.first[symbols] - self.start[symbols]
        both = self._down(np.concatenate([low, high]), np.concatenate([symbols, symbols]))
        return base + both[: len(low)], base + both[len(low) :]

    def repeated(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """For each start, the interval's lower end if tokens[start : start + length] stands in the text more than once, else -1.

        Reads backwards from each pattern's end and gives a pattern up once its matching statistic ends short of its length.
        """
        lengths = np.broadcast_to(lengths, starts.shape)
        if len(starts) > STEP:
            return np.concatenate([self.repeated(tokens, starts[i : i + STEP], lengths[i : i + STEP]) for i in range(0, len(starts), STEP)])
        out = np.full(len(starts), -1, np.int64)
        ends = starts + lengths
        live = np.arange(len(starts))
        symbols = tokens[ends - 1]
        low = self.first[symbols]
        high = low + self.counts[symbols]
        back = 1
        while len(live):
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            over = lengths[live] == back
            if over.any():
                out[live[over]] = low[over]
                live, low, high = live[~over], low[~over], high[~over]
            if len(live):
                back += 1
                low, high = self.extend(low, high, tokens[ends[live] - back])
        return out
