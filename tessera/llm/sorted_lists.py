"""Exact top-k inner products by aggregation over sorted lists without random access.

Each block of candidates keeps one list per dimension, sorted by component. A query reads every list from the end that
its sign favours, all cursors moving on together. Of a candidate that it met in some lists it knows an upper bound: what
was read of it, and for the lists where it was not met what stands at their cursors. Candidates that it met nowhere share
one bound, the sum at the cursors. The bar is the k-th best score that is known so far: of earlier blocks, which are
searched first in small number for that, or the block's own k-th lower bound. Once the bound of unmet candidates is below
the bar, only those whose upper bound reaches it are kept, and reading goes on for these alone until at most k are left
or the lists end; then the scores of what is left are whole. All queries of a block read in step: bounds are
matrix products. Blocks past the first few are read with a bar that the query already has.

Components are first turned into floor(scale * x). Vectors that are null or hold null or non-finite components,
and rows with a null vec_id, take no part; equal rows count once; candidates have the query's length and another
vec_id than the query. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows. Other columns than vec_id
and embedding are not read. Where components are so large that doubles could round a score, whole Python numbers are
used; a score beyond 64 bits is given as the nearest long, after ranking by its true value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, merged, ranked, search, usable

SCALE = 256
EVERY = 50
K = 5
BLOCK = 8192
#: Where cursors pause, as shares of a list.
PAUSES = tuple(i / 16 for i in range(2, 16))
QUERIES_AT_ONCE = 256
#: Of the blocks, the share that is read in the second of three rounds (the first reads one).
SECOND = 0.125


class Lists:
    """Sorted lists of a block's components (n rows, whole doubles) and what is known at each pause."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, (self.n, dims) = x, x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None], axis=0)
        self.ordered = np.take_along_axis(x, order, axis=0)
        self.depths = sorted({d for p in PAUSES if 0 < (d := math.ceil(self.n * p)) < self.n})
        self._upper: dict[int, np.ndarray] = {}
        self._lower: dict[int, np.ndarray] = {}
        # From the high ends (for positive weights) and the low ends (for negative ones).
        self.cursors = {d: np.concatenate([self.ordered[self.n - d - 1], self.ordered[d]]) for d in self.depths}

    def _met(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rank >= self.n - depth, self.rank < depth

    def upper(self, depth: int) -> np.ndarray:
        if depth not in self._upper:
            high, low = self._met(depth)
            at = self.cursors[depth]
            dims = self.x.shape[1]
            self._upper[depth] = np.hstack([np.where(high, self.x, at[:dims]), np.where(low, self.x, at[dims:])])
        return self._upper[depth]

    def lower(self, depth: int) -> np.ndarray:
        if depth not in self._lower:
            high, low = self._met(depth)
            self._lower[depth] = np.hstack([np.where(high, self.x, self.ordered[0]), np.where(low, self.x, self.ordered[-1])])
        return self._lower[depth]


def block_top_k(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, bars: np.ndarray | None = None):
    """For each query: indices and scores of those of its k best rows of x that reach its bar, and the share of the lists read.

    bars: a score that k other candidates reach, or -inf. All values are whole numbers.
    """
    n, dims = x.shape
    bars = np.full(len(q), -np.inf) if bars is None else bars
    # Whole numbers below 2**24 are exact in single precision.
    kind = np.float32 if n and len(q) and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * dims < 2.0**24 else np.float64
    x, q = x.astype(kind), q.astype(kind)
    lists = Lists(x) if n else None
    for first in range(0, len(q), QUERIES_AT_ONCE):
        w, own, bar = (a[first : first + QUERIES_AT_ONCE] for a in (q, query_ids, bars))
        if not n:
            yield from ((np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0) for _ in w)
            continue
        signed = np.hstack([np.maximum(w, 0), np.minimum(w, 0)])
        same = own[:, None] == ids[None, :]
        left: list = [None] * len(w)  # the candidates that are kept, once no unmet one can qualify
        read = np.ones(len(w))
        bar = bar.astype(np.float64)
        for depth in lists.depths:
            fresh = np.array([i for i in range(len(w)) if left[i] is None], np.int64)
            if len(fresh):
                blind = fresh[~np.isfinite(bar[fresh])]
                if len(blind) and n > k:
                    lower = np.where(same[blind], -np.inf, signed[blind] @ lists.lower(depth).T)
                    low = np.partition(lower, n - k, axis=1)[:, n - k]
                else:
                    low = np.zeros(0)
                held = bar.copy()
                held[blind[: len(low)]] = low
                # No unmet candidate can reach the bar.
                ripe = fresh[signed[fresh] @ lists.cursors[depth] < held[fresh]]
                if len(ripe):
                    may = (signed[ripe] @ lists.upper(depth).T >= held[ripe][:, None]) & ~same[ripe]
                    for i, row in zip(ripe.tolist(), may, strict=True):
                        left[i], read[i] = np.flatnonzero(row), depth / n
                        if not np.isfinite(bar[i]):
                            bar[i] = held[i]
            for i, found in enumerate(left):
                if found is not None and len(found) > k and read[i] < depth / n:
                    low = np.partition(lists.lower(depth)[found] @ signed[i], len(found) - k)[len(found) - k]
                    bar[i] = max(bar[i], low)
                    left[i], read[i] = found[lists.upper(depth)[found] @ signed[i] >= bar[i]], depth / n
            if all(found is not None and len(found) <= k for found in left):
                break
        whole = [i for i, found in enumerate(left) if found is None]
        if whole:  # read to the ends of all lists
            scores = w[whole] @ x.T
            for i, row in zip(whole, scores, strict=True):
                low = max(bar[i], np.partition(row, n - k)[n - k - 1] if n > k + 1 else -np.inf)
                left[i] = np.flatnonzero((row >= low) & ~same[i])
        for i, found in enumerate(left):
            if len(found) > k:
                read[i] = 1.0
            scores = x[found] @ w[i]
            best = np.lexsort((ids[found], -scores))[:k]
            best = best[scores[best] >= bar[i]]
            yield found[best], scores[best].astype(np.int64), float(read[i])


def _exact(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Scores as whole Python numbers."""
    w = [int(v) for v in w]
    return [sum(int(a) * b for a, b in zip(row, w, strict=True)) for row in x]


def score_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, bars: np.ndarray):
    """block_top_k, with rows and queries of components too large for doubles scored apart."""
    limit = math.sqrt(2.0**53 / max(1, x.shape[1]))
    big = np.abs(x).max(1, initial=0) >= limit
    wide = np.abs(q).max(1, initial=0) >= limit
    small = np.flatnonzero(~big)
    fast = block_top_k(ids[small], x[small], query_ids[~wide], q[~wide], k, bars[~wide])
    for i in range(len(q)):
        if wide[i]:
            found, scores, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(x))
        else:
            found, scores, _ = next(fast)
            found, rest = small[found], np.flatnonzero(big)
        rest = rest[ids[rest] != query_ids[i]]
        if len(rest):
            every = list(zip(map(int, scores), found.tolist(), strict=True)) + list(zip(_exact(x[rest], q[i]), rest.tolist(), strict=True))
            every = sorted(every, key=lambda e: (-e[0], ids[e[1]]))[:k]
            found = np.array([e[1] for e in every], np.int64)
            scores = np.array([min(max(e[0], -(2**63) + 1), 2**63 - 1) for e in every], np.int64)
        yield found, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over vectors."""

    def score(a: pa.Table, b: pa.Table):
        x, q = (np.floor(matrix(t["x"]) * scale) for t in (a, b))
        bars = b["bar"].to_numpy(zero_copy_only=False) if "bar" in b.column_names else np.full(len(q), np.nan)
        bars = np.where(np.isnan(bars.astype(float)), -np.inf, bars.astype(float))
        return score_block(a["vec_id"].to_numpy(), x, b["vec_id"].to_numpy(), q, k, bars)

    rows, wanted = usable(vectors, zero=True), usable(queries, zero=True)
    parts = max(1, math.ceil(vectors.count() / block))
    cuts = sorted({0, min(1, parts), min(parts, 1 + math.ceil(parts * SECOND)), parts})
    found, asked = None, wanted
    for low, high in zip(cuts, cuts[1:], strict=False):
        hits = search(rows, asked, score, k, parts, "long", block, low, high)
        found = materialize(hits if found is None else merged(found.union(hits), k), "hits")
        if high < parts:
            # Scores beyond what a double holds exactly make no bar.
            last = F.when((F.size("hits") >= k) & (F.abs(F.col("hits")[k - 1]["loss"]) < 2**53), (-F.col("hits")[k - 1]["loss"]).cast("double"))
            asked = wanted.join(found.select(F.col("query_id").alias("vec_id"), F.size("hits").alias("many"), last.alias("bar")).drop("many"), "vec_id", "left")
    return ranked(found)


ORACLE_SQL = f"""
with rows as (select distinct vec_id, list_transform(embedding, v -> floor(v::double * {SCALE})) x from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, v -> v is not null and isfinite(v)))),
scored as (select q.vec_id query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint score from rows q join rows c
  on q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id and len(c.x) = len(q.x)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int "rank", vec_id, score from scored)
select * from ranked where "rank" <= {K}
"""
