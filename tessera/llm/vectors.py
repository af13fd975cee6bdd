"""Blocks of vectors, and a stated query set against all rows in pairs of blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
FAN_IN = 64


def usable(frame: DataFrame, zero: bool, once: bool = True) -> DataFrame:
    """vec_id, x (array of double) of the rows that take part: neither null nor with null or non-finite components; zero vectors only if asked for.

    Rows with a null vec_id take no part; equal rows count once, if not told otherwise.
    """
    x = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    if not zero:
        ok &= F.exists(x, lambda v: v != 0)
    rows = frame.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.distinct() if once else rows


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, hits: the k best hits of each query's lists."""
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


def search(candidates: DataFrame, queries: DataFrame, score, k: int, parts: int, kind: str, block: int = BLOCK, low: int = 0, high: int | None = None) -> DataFrame:
    """query_id, hits (loss, vec_id; best first) of each query's k best among the candidates' parts from low up to high.

    candidates and queries hold vec_id, x (or size, its length) and what else score reads. score(candidates, queries) takes two Arrow tables, of
    at most about block rows each and vectors of one length, and returns for each query the indices of candidates and
    their scores, best first. Blocks are dealt by hash, so they are even; what blocks found is merged FAN_IN at a time, so
    no group is larger than FAN_IN * k hits.
    """
    high = parts if high is None else high
    lots = max(1, math.ceil(queries.count() / block))
    # Both sides' keys need the same types: a cogroup deals an int and a long of one value to different tasks.
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")
    each = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b - 1).cast("long")))
    sized = lambda rows: rows if "size" in rows.columns else rows.withColumn("size", F.size("x"))
    left = sized(candidates).withColumn("part", part(parts)).filter(F.col("part").between(low, high - 1)).withColumn("lot", each(0, lots))
    right = sized(queries).withColumn("lot", part(lots)).withColumn("part", each(low, high))
    keys = ["part", "lot", "size"]

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        many, found, scores = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64 if kind == "long" else np.float64)]
        asked = b["vec_id"] if len(a) else b["vec_id"].slice(0, 0)
        if len(a) and len(b):
            for at, score_ in score(a, b):
                many.append(len(at))
                found.append(at)
                scores.append(score_)
        ids = a["vec_id"].to_numpy()[np.concatenate(found)]
        hits = pa.StructArray.from_arrays([pa.array(-np.concatenate(scores)), pa.array(ids, pa.int64())], ["loss", "vec_id"])
        asked = asked.combine_chunks().cast(pa.int64())
        hits = pa.ListArray.from_arrays(pa.array(np.cumsum(many), pa.int32()), hits)
        return pa.table([pa.array([key[0].as_py()] * len(hits), pa.int64()), asked, hits], ["part", "query_id", "hits"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"part long, query_id long, hits array<struct<loss:{kind},vec_id:long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
    while high - low > FAN_IN:
        low, high = low // FAN_IN, -(-high // FAN_IN)
        found = found.groupBy("query_id", F.floor(F.col("part") / FAN_IN).alias("part")).agg(best)
    return merged(found, k)


def ranked(found: DataFrame) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each hit."""
    found = found.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.loss")).alias("score"))
