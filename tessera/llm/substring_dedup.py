"""Removal of words covered by windows that repeat, with one FM-index for each shard.

Every window of WINDOW words has an anchor, the run of GRAM words in it with the smallest hash. Equal windows have equal
anchors, so windows are dealt to shards by anchor, each with the words around (a segment). Anchors that stand once can't
be in a repeated window. A shard indexes its segments, streams them through a backward search and reports the windows
that stand earlier. Anchors of many segments are split over shards; the first windows of each then meet by a hash
of their words. Of equal texts only one for each task is streamed: all others than the first lose all windows.

Words are split at ASCII white space and compared as they are. Windows are judged on the input. Null and empty texts
have no words. Rows of one doc_id are taken to be one document, given more than once; rows with a null doc_id are kept
whole and repeat nothing.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, having, materialize, partitions, release, slices, tidy, unused
from .fm_index import FMIndex
from .partenum import WordHashes, grams

WINDOW = 20
GRAM = 6
SHARD = 10_000
_NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _leftmost_least(g: np.ndarray, wide: int) -> np.ndarray:
    """For each run of wide values, the place of the first least one; runs double until they are wide enough."""
    v, p, span = g, np.arange(len(g)), 1
    while span < wide:
        by = min(span, wide - span)
        right = v[by:] < v[:-by]
        v, p, span = np.where(right, v[by:], v[:-by]), np.where(right, p[by:], p[:-by]), span + by
    return p


def anchors(texts: list[list[bytes]], memo: WordHashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of anchors, the first and last start of the windows that have them, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if total < window:
        return *_NONE, np.zeros(len(texts), np.int64)
    g = grams(np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.uint64, total), gram)
    at = _leftmost_least(g, window - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + window <= ends[text])  # windows of one text
    at, text = at[start], text[start]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    place = start - (ends - sizes)[text]
    last = np.r_[first[1:] - 1, len(at) - 1][: len(first)]
    return g[at[first]], place[first], place[last], np.bincount(text[first], minlength=len(texts))


def _marks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, n_words, class (of equal texts), and the anchors of those texts that a task meets first or with a smaller doc_id."""

    def run(batches):
        memo, seen = WordHashes(), {}
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, classes, wanted = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                c = xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63
                n.append(len(words))
                classes.append(c)
                fresh = doc_id < seen.get(c, doc_id + 1)
                if fresh:
                    seen[c] = doc_id
                wanted.append(words if fresh and len(words) >= window else [])
            h, a, b, many = anchors(wanted, memo, window, gram)
            ends = np.r_[0, np.cumsum(many)].astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["hash", "low", "high"])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows)], ["doc_id", "n_words", "class", "anchors"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_words long, class long, anchors array<struct<hash:long,low:int,high:int>>")


def shard_windows(doc_ids: np.ndarray, lows: np.ndarray, texts: list[bytes], window: int):
    """Windows of a shard's segments that stand earlier in the shard. Segments come in order of doc_id and place.

    The index holds each sequence of words once: the windows of its further segments stand earlier with it, those of
    its first are sought. Returns segment and start of each window, and whether an equal one stands earlier.
    """
    met: dict[bytes, int] = {}
    fresh = np.array([met.setdefault(t, i) for i, t in enumerate(texts)], np.int64) == np.arange(len(texts))
    sizes = np.array([t.count(b" ") + 1 for t in texts])
    words = b" ".join(met).split(b" ")
    known = {w: i for i, w in enumerate(set(words), 1)}  # any numbering will do
    once = sizes[fresh]
    tokens = np.zeros(len(words) + len(once), np.int64)  # 0 ends a segment
    begin = np.zeros(len(texts), np.int64)
    begin[fresh] = np.cumsum(once + 1) - once - 1
    filled = np.ones(len(tokens), bool)
    filled[begin[fresh] + once] = False
    tokens[filled] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    many = sizes - window + 1
    segment = np.repeat(np.arange(len(texts)), many)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many)
    index = FMIndex(tokens, window)
    earlier = ~fresh[segment]
    sought = np.flatnonzero(~earlier)
    low = index.repeated(tokens, begin[segment[sought]] + inside[sought], window)
    hit = sought[low >= 0]
    _, first = np.unique(low[low >= 0], return_index=True)
    earlier[hit] = True
    earlier[hit[first]] = False
    return segment, lows[segment] + inside, inside, earlier


def _runs(ids: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, first and end of the spans of words that windows with these starts cover; starts ascend in each id."""
    if not len(starts):
        return ids, starts, starts
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (np.diff(starts) > window)])
    return ids[first], starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]] + window


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, copy (its whole text stands earlier), spans (of words, end exclusive) of the documents that lose words."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    marks = materialize(_marks(docs, window, gram), "marks")
    exploded = marks.select("doc_id", F.explode("anchors").alias("a")).select("doc_id", "a.hash", "a.low", "a.high")
    often = materialize(exploded.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1"), "anchors")
    total = often.agg(F.sum("times")).first()[0] or 0
    shards = max(partitions(spark), math.ceil(total / shard))
    most = max(256, total // (4 * shards))
    chosen = exploded.join(often, "hash").groupBy("doc_id").agg(F.collect_list(F.struct("hash", "low", "high", "times")).alias("chosen"))
    chosen = materialize(chosen, "chosen")

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, 2**18)):
            chosen = batch.column(2)
            many = pc.list_value_length(chosen).to_numpy()
            hashes, lows, highs, times = (chosen.flatten().field(c) for c in ("hash", "low", "high", "times"))
            a, b, pieces, at = lows.to_pylist(), (highs.to_numpy() + window).tolist(), [], 0
            for text, k in zip(batch.column(1).to_pylist(), many.tolist(), strict=True):
                words = words_of(text)
                pieces += [b" ".join(words[x:y]) for x, y in zip(a[at : at + k], b[at : at + k], strict=True)]
                at += k
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), hashes, times, lows, pa.array(pieces, pa.binary())], ["doc_id", "hash", "times", "low", "words"])

    segments = having(docs, bitmap_of(chosen)).join(chosen, "doc_id").select("doc_id", "text", "chosen").mapInArrow(tidy(cut), "doc_id long, hash long, times long, low int, words binary")
    salts = F.ceil(F.col("times") / most).cast("long")
    segments = segments.withColumn("split", salts > 1).withColumn("shard", F.pmod(F.xxhash64("hash", F.pmod(F.xxhash64("doc_id"), salts)), F.lit(shards)).cast("long")).drop("hash", "times")

    def seek(key, table):
        ids, lows = table["doc_id"].to_numpy(), table["low"].to_numpy()
        order = np.lexsort((lows, ids))
        order = order[np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(lows[order]) != 0)]]  # a document given twice counts once
        ids, lows, split = ids[order], lows[order].astype(np.int64), table["split"].to_numpy(zero_copy_only=False)[order]
        texts = table["words"].take(pa.array(order)).to_pylist()
        segment, start, inside, earlier = shard_windows(ids, lows, texts, window)
        gone, low, high = _runs(ids[segment[earlier]], start[earlier], window)
        open_ = np.flatnonzero(~earlier & split[segment])
        keys, now, words = [], -1, []
        for s, k in zip(segment[open_].tolist(), inside[open_].tolist(), strict=True):
            if s != now:
                now, words = s, texts[s].split(b" ")
            keys.append(xxhash.xxh3_128_digest(b" ".join(words[k : k + window])))
        names, types = ["doc_id", "low", "high", "key"], (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        spans = pa.table([pa.array(c, t) for c, t in zip((gone, low, high, [None] * len(gone)), types, strict=True)], names)
        left = pa.table([pa.array(c, t) for c, t in zip((ids[segment[open_]], start[open_], [None] * len(open_), keys), types, strict=True)], names)
        return pa.concat_tables([spans, left])

    found = materialize(segments.groupBy("shard").applyInArrow(tidy(seek), "doc_id long, low int, high int, key binary"), "windows")
    firsts = found.filter("key is not null")
    least = firsts.groupBy("key").agg(F.min(F.struct("doc_id", "low")).alias("least"), F.count("*").alias("times")).filter("times > 1")
    late = firsts.join(least.select("key", "least"), "key").filter(F.struct("doc_id", "low") > F.col("least")).select("doc_id", "low", (F.col("low") + window).alias("high"))
    spans = found.filter("key is null").select("doc_id", "low", "high").union(late).groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    whole = marks.filter(f"n_words >= {window}").select("doc_id", "class")
    first = whole.groupBy("class").agg(F.min("doc_id").alias("first"))
    copies = whole.join(first, "class").filter("doc_id <> first").select("doc_id", F.lit(True).alias("copy")).distinct()
    return materialize(copies.join(spans, "doc_id", "full").select("doc_id", F.coalesce("copy", F.lit(False)).alias("copy"), "spans"), "spans")


def remove(docs: DataFrame, window: int = WINDOW, **more) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept (words joined by a space), kept_sha256 of every row of docs."""
    found = repeated_spans(docs, window, **more)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, gone, kept, sha = [], [], [], []
            for text, copy, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = words_of(text)
                n.append(len(words))
                if copy:
                    words = []
                elif spans:
                    out, end = [], 0
                    for a, b in sorted((s["low"], s["high"]) for s in spans):
                        out += words[end:a] if a > end else []
                        end = max(end, b)
                    words = out + words[end:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(sha, pa.string())], ["doc_id", "text", "n_words", "n_removed", "kept", "kept_sha256"])

    bitmap = bitmap_of(found)
    joined = having(docs, bitmap).join(found, "doc_id", "left").select("doc_id", "text", "copy", "spans")
    joined = joined.union(having(docs, bitmap, False).select("doc_id", "text", F.lit(None).cast("boolean"), F.lit(None).cast(found.schema["spans"].dataType)))
    return joined.mapInArrow(tidy(run), "doc_id long, text string, n_words long, n_removed long, kept string, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words taken out of text; a document that loses all words goes; n_chars follows where there is one."""
    found = repeated_spans(docs, window)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, names.index("text"))):
            texts, keep = [], []
            for text, copy, spans in zip(*(batch.column(i).to_pylist() for i in (names.index("text"), -2, -1)), strict=True):
                if copy or spans:
                    words, out, end = words_of(text), [], 0
                    for a, b in [] if copy else sorted((s["low"], s["high"]) for s in spans):
                        out += words[end:a] if a > end else []
                        end = max(end, b)
                    words = [] if copy else out + words[end:]
                    text = b" ".join(words).decode()
                    keep.append(bool(words))
                else:
                    keep.append(True)
                texts.append(text)
            out = batch.select(list(range(len(names)))).set_column(names.index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
            if "n_chars" in names:
                out = out.set_column(names.index("n_chars"), batch.schema.field("n_chars"), pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type))
            yield out.filter(pa.array(keep, pa.bool_()))

    bitmap = bitmap_of(found)
    more = [unused(name, names) for name in ("copy", "spans")]
    joined = having(docs, bitmap).join(found.toDF("doc_id", *more), "doc_id", "left").select(*names, *more)
    joined = joined.union(having(docs, bitmap, False).select(*names, F.lit(None).cast("boolean"), F.lit(None).cast(found.schema["spans"].dataType)))
    return joined.mapInArrow(tidy(run), schema)
