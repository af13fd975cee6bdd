"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap of ids: 2 MB, however many rows there are.
BITS = 2**24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect the driver's heap: Spark then removes the shuffle files of lineage that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, size: int = 2**20):
    """A batch cut so that a slice's texts (of that column) are not much longer than size bytes together."""
    text = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(text.astype(np.int64) + 64) // size
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=False):
        yield batch.slice(int(a), int(b - a))


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one if a column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """Hashes of doc_id as a bitmap of BITS bits."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    parts = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def having(docs: DataFrame, bitmap: np.ndarray, there: bool = True) -> DataFrame:
    """The rows whose doc_id may be in the bitmap, or surely isn't: keeps other texts out of a shuffle."""

    def run(batches):
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            batch = batch.select(list(range(batch.num_columns - 1)))
            yield batch.filter(pa.array((((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1) == there))

    at = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)), F.lit(0)).alias(unused("at", docs.columns))
    return docs.select("*", at).mapInArrow(run, docs.schema)


def _trim() -> None:
    """Gives a worker's free memory back, as other workers and the executor's heap share the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """run, with a worker's free memory given back when it ends."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def inner(*args):
            yield from run(*args)
            _trim()
    elif len(inspect.signature(run).parameters) == 3:

        @functools.wraps(run)
        def inner(key, one, other):
            out = run(key, one, other)
            _trim()
            return out
    else:

        @functools.wraps(run)
        def inner(key, rows):
            out = run(key, rows)
            _trim()
            return out

    return inner
