"""Jaccard join of word-shingle sets by PartEnum signatures.

Sets are joined by bands of size. Two sets of a band that are similar enough differ in at most k features. The
domain of features is hashed into n1 parts, each of n2 cells. If n1 * (k2 + 1) > k + m * (k2 + 1), more than m parts
hold at most k2 of the differing features, and in each of these some n2 - k2 cells hold none: the two sets agree
there. So each part and each choice of n2 - k2 of its cells gives a signature, a hash of the features there, and
similar sets share one. Signatures without features say nothing and are left out, unless they stand in more than m
parts of a set: a pair that could lose by it has them on both sides.

Equal sets count as one. The sets of a bucket (those that share a signature) form a group with the least of them;
buckets with the same least set make one group. Within a group, pairs of different components are filtered by size and
by bitmap, and each set's nearest ones are compared exactly; found links join components, and this goes on with what
is neither joined nor compared until no pair is left; once all pairs have met, only sets that had one take part. So no
link is lost, no connection is drawn through a pair that has not been compared, and a round gives a number of pairs in
proportion to its rows, not to their square. A bitmap holds the parity of the features of each place, so two of them
differ in no more places than the sets differ in features. Large groups are cut into blocks: in the first MIXES rounds
a set is in one block, another one each time, with the least set; later the sets of the group's largest component are,
and the others in all blocks. So all pairs of two components meet.

Words are split at ASCII white space after A-Z are lower-cased. A text of fewer words than a shingle is one shingle;
one without words has none and links with nothing, itself its component. Every row of the input gives a row, repeated
ones each their own. A row with a null doc_id links with nothing but equal sets: its component_id is the least doc_id
of the component that these are in, null if there are none. Of the input's columns only doc_id and text are read, so
others may have any name. Features and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bitmap_of, having, materialize, partitions, release, slices, tidy
from .components import components

GROWTH = 1.5
K2, N2 = 1, 3
SUBSETS = list(combinations(range(N2), N2 - K2))
BLOCK = 4096
MEMO = 100_000
PER_PART = 2_000_000
#: Tasks a core in which signatures meet, however many parts there are.
WAVES = 2
#: Signatures that a task sorts at once; rows of groups, and pairs, that it compares at once.
FLUSH, LOT, AT_ONCE = 1_000_000, 20_000, 65_536
#: Bits of a bitmap for each feature, and of the widest bitmap.
DENSE, WIDEST = 4, 16_384
#: How many of a set's nearest ones the first round compares; each further round takes FASTER times as many.
NEAREST, FASTER = 4, 4
MIXES = 2
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    size = min(n, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * _M3 + hashes[i : i + len(out)])
    return out


def shingle_set(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.unique(grams(memo.of(words), n)) if words else np.zeros(0, np.uint64)


def class_of(features: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(features.tobytes()) - 2**63


class Bands:
    """Bands of set size and the signatures of a set. Similar: similarity >= over / under."""

    def __init__(self, over: int, under: int) -> None:
        self.over, self.under = over, under
        self.low, self.plan = [1], []

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            low = self.low[-1]
            high = max(low + 1, int(low * GROWTH))
            top = high - 1
            k = (self.under - self.over) * (top + top * self.under // self.over) // (self.under + self.over)
            n1, m = max(1, -(-(k + 1) // (K2 + 1))), 0
            for _ in range(4):
                bare = len(SUBSETS) * (n1 + m) * math.exp(-low * (N2 - K2) / (N2 * (n1 + m)))
                m = math.ceil(bare + 2 * math.sqrt(bare)) if bare >= 0.01 else 0
                m = min(m, n1)
            self.plan.append((k, n1 + m, m))
            self.low.append(high)

    def of(self, size: int) -> list[int]:
        """Its band, and the one below if a set there can be similar."""
        self._grow(size)
        home = int(np.searchsorted(self.low, size, side="right")) - 1
        return [home, home - 1] if home and size * self.over <= (self.low[home] - 1) * self.under else [home]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        out = []
        for band in self.of(len(features)):
            k, n1, m = self.plan[band]
            if not k:
                continue  # only equal sets
            f = mix(features ^ mix(np.uint64([band + 1])))
            cell = ((f >> np.uint64(20)) % np.uint64(n1)).astype(np.int64) * N2 + ((f & np.uint64(0xFFFFF)) % np.uint64(N2)).astype(np.int64)
            sums = np.zeros(n1 * N2, np.uint64)
            np.add.at(sums, cell, mix(features))
            sums = sums.reshape(n1, N2)
            filled = np.bincount(cell, minlength=n1 * N2).reshape(n1, N2) > 0
            place = mix(np.arange(n1 * len(SUBSETS), dtype=np.uint64) + np.uint64(band << 40)).reshape(n1, -1)
            made = np.stack([sums[:, list(s)].sum(1, dtype=np.uint64) for s in SUBSETS], 1)
            some = np.stack([filled[:, list(s)].any(1) for s in SUBSETS], 1)
            if (~some.all(1)).sum() > m:
                some[:] = True
            out.append(mix(mix(made) + place)[some])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _blob(signatures: np.ndarray, classes: np.ndarray) -> bytes:
    known, at = np.unique(classes, return_inverse=True)
    kind = np.uint16 if len(known) <= 2**16 else np.uint32
    return b"".join(x.tobytes() for x in (np.array([len(at), len(known)], np.int64), known, signatures, at.astype(kind)))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, known = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16 + 8 * known + 4 * n
    return np.frombuffer(blob, np.int64, known, 16), np.frombuffer(blob, np.uint32, n, 16 + 8 * known), np.frombuffer(blob, np.uint16 if known <= 2**16 else np.uint32, n, at)


def facts(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets; null for the empty set), bits (bitmap of the set) of every row."""

    def run(batches):
        memo = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, c, bits = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, memo)
                n.append(len(s))
                c.append(class_of(s) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "class", "bits"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, class long, bits binary")


class Fresh:
    """Leaves out pairs of lead and class that this task gave before.

    Each of 2**places places keeps the last pair that fell there, 16 bytes, so a few pairs come again; none is lost.
    """

    def __init__(self, places: int) -> None:
        self.places, self.task, self.held = places, None, None

    def of(self, lead: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        context = TaskContext.get()
        task = context and context.taskAttemptId()
        if self.held is None or task != self.task:
            self.task, self.held = task, np.zeros((1 << self.places, 2), np.int64)
            self.held[:, 0] = 1  # no pair: a lead is never greater than its class
        pairs = np.stack([lead, member], 1)
        at = mix(mix(lead.view(np.uint64)) + member.view(np.uint64)) & np.uint64(len(self.held) - 1)
        new = (self.held[at] != pairs).any(1)
        self.held[at] = pairs
        return lead[new], member[new]


def grouped(docs: DataFrame, words: int, over: int, under: int, parts: int) -> DataFrame:
    """lead, class: for each signature that classes share, the least of them and all of them.

    Signatures are dealt to parts by hash; a part holds 12 bytes for each signature of a set in it. Sets that share many
    signatures meet in many parts. The number of parts grows with the data, that of tasks with the cores only, and a
    task gives a pair once for all its parts.
    """
    tasks = min(parts, WAVES * docs.sparkSession.sparkContext.defaultParallelism)
    fresh = Fresh(min(22, max(16, (parts * PER_PART // 128).bit_length())))

    def dealt(signatures, classes):
        x = np.concatenate(signatures)
        y = np.repeat(np.array(classes, np.int64), [len(s) for s in signatures])
        part = (x % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        x, y = ((x // np.uint64(parts)) & np.uint64(2**32 - 1)).astype(np.uint32)[order], y[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, _blob(x[a:b], y[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    def sign(batches):
        memo, bands, seen = WordHashes(), Bands(over, under), set()
        signatures, classes, held = [], [], 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, memo)
                c = class_of(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    signatures.append(bands.signatures(s))
                    classes.append(c)
                    held += len(signatures[-1])
                if held >= FLUSH:
                    yield dealt(signatures, classes)
                    signatures, classes, held = [], [], 0
        if held:
            yield dealt(signatures, classes)

    def meet(key, table):
        known, x, y = zip(*map(_unblob, table["blob"].to_pylist()), strict=True)
        every, place = np.unique(np.concatenate(known), return_inverse=True)
        first = np.cumsum([0, *map(len, known)])
        held = np.concatenate(x).astype(np.uint64) << np.uint64(32)
        held |= np.concatenate([place[a:b][at] for a, b, at in zip(first, first[1:], y, strict=False)]).astype(np.uint64)
        del x, y
        held.sort()
        held = held[np.r_[True, held[1:] != held[:-1]]]
        who = (held & np.uint64(2**32 - 1)).astype(np.int64)
        held >>= np.uint64(32)
        begin = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        size = np.diff(np.r_[begin, len(held)])
        del held
        wide = np.repeat(size > 1, size)
        lead = np.repeat(who[begin[size > 1]], size[size > 1])
        pairs = np.unique(lead * len(every) + who[wide])
        lead, member = fresh.of(every[pairs // len(every)], every[pairs % len(every)])
        return pa.table([pa.array(lead), pa.array(member)], ["lead", "class"])

    dealt_out = docs.mapInArrow(tidy(sign), "part long, blob binary").repartition(tasks, "part")
    return dealt_out.groupBy("part").applyInArrow(tidy(meet), "lead long, class long").distinct()


def similar(x: np.ndarray, y: np.ndarray, over: int, under: int) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return under * both >= over * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, over: int, under: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), over, under) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def bitmap(features: np.ndarray) -> bytes:
    """At each place the parity of the features that fall there; half as wide, it is the one half against the other."""
    width = min(WIDEST, max(64, 1 << (DENSE * len(features) - 1).bit_length()))
    at = (mix(features ^ _M3) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(a: np.ndarray, b: np.ndarray, maps: list[bytes]) -> np.ndarray:
    """In how many places the bitmaps of a and b differ."""
    width = np.array([8 * len(m) for m in maps], np.int64)
    at = np.minimum(width[a], width[b])
    out = np.zeros(len(a), np.int64)
    for w in np.unique(at).tolist():
        rows = np.flatnonzero(at == w)
        used = np.unique(np.concatenate([a[rows], b[rows]]))
        bits = np.zeros((len(used), w // 64), np.uint64)
        for i, u in enumerate(used.tolist()):
            m = np.frombuffer(maps[u], np.uint64)
            while len(m) > w // 64:
                m = m[: len(m) // 2] ^ m[len(m) // 2 :]
            bits[i] = m
        step = max(1, AT_ONCE * 64 // w)
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            out[r] = np.bitwise_count(bits[np.searchsorted(used, a[r])] ^ bits[np.searchsorted(used, b[r])]).sum(1, dtype=np.int64)
    return out


def nearest_pairs(table: pa.Table, failed: pa.Table, nearest: int, over: int, under: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes a < b to compare: each row's nearest ones of a group, of other components, not failed before.

    A group is a block of one lead's. Also the classes that have any such pair.
    """
    ids, each = np.unique(table["class"].to_numpy(), return_index=True)
    maps = table["bits"].take(pa.array(each)).to_pylist()
    n, comp = table["n"].to_numpy()[each], table["comp"].to_numpy()[each]
    who = np.searchsorted(ids, table["class"].to_numpy())
    lead, block = (table[c].to_numpy() for c in ("lead", "block"))
    order = np.lexsort((n[who], block, lead))
    lead, block, who = (x[order] for x in (lead, block, who))
    group = np.cumsum(np.r_[0, (np.diff(lead) != 0) | (np.diff(block) != 0)])
    # A row meets those after it in its group, up to the largest size that may be similar.
    high = n[who] * under // over
    wide = int(n.max(initial=0)) + 1
    most = np.searchsorted(group * wide + n[who], group * wide + np.minimum(high, wide - 1), side="right") - np.arange(len(who)) - 1
    lost = [failed[c].to_numpy() for c in "ab"]
    lost = np.stack(lost, 1)[np.isin(lost[0], ids) & np.isin(lost[1], ids)]
    gone = np.unique(np.searchsorted(ids, lost[:, 0]) * len(ids) + np.searchsorted(ids, lost[:, 1]))
    total, begin, out, loss = np.cumsum(most), 0, [], []
    while begin < len(who):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 4 * AT_ONCE, side="right")))
        many = most[begin:end]
        x = np.repeat(np.arange(begin, end), many)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        keep = comp[who[x]] != comp[who[y]]
        x, y = who[x[keep]], who[y[keep]]
        pairs = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y))
        pairs = pairs[~np.isin(pairs, gone, assume_unique=True)]
        a, b = pairs // len(ids), pairs % len(ids)
        apart, both = _apart(a, b, maps), n[a] + n[b]
        may = apart * (under + over) <= both * (under - over)
        out.append(pairs[may])
        loss.append(apart[may] / both[may])
        begin = end
    pairs, once = np.unique(np.concatenate([gone[:0], *out]), return_index=True)
    loss = np.concatenate([np.zeros(0), *loss])[once]
    a, b = pairs // max(1, len(ids)), pairs % max(1, len(ids))
    row, at = np.concatenate([a, b]), np.tile(np.arange(len(pairs)), 2)
    order = np.lexsort((loss[at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, row)
    chosen = np.unique(at[np.arange(len(row)) - first < nearest])
    return ids[a[chosen]], ids[b[chosen]], ids[np.unique(row)]


def _round(rows: DataFrame, failed: DataFrame, nearest: int, over: int, under: int) -> DataFrame:
    """lot, a, b: pairs to compare; b is null for a class a that has any. rows: lot, lead, class, comp, block, n, bits."""

    def run(key, table, failed):
        a, b, some = nearest_pairs(table, failed, nearest, over, under) if len(table) else [np.zeros(0, np.int64)] * 3
        lots = [key[0].as_py()] * (len(a) + len(some))
        return pa.table([pa.array(lots, pa.int64()), pa.array(np.concatenate([a, some])), pa.array(b.tolist() + [None] * len(some), pa.int64())], ["lot", "a", "b"])

    return rows.groupBy("lot").cogroup(failed.groupBy("lot")).applyInArrow(tidy(run), "lot long, a long, b long")


def _features(docs: DataFrame, wanted: DataFrame, words: int, repeated: bool) -> DataFrame:
    """class, features of the sets that are wanted (class, doc_id)."""

    def build(batches):
        memo = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 0)):
            sets = [shingle_set(t, words, memo) for t in batch.column(0).to_pylist()]
            keep = [class_of(s) == c for s, c in zip(sets, batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "features"]).filter(pa.array(keep, pa.bool_()))

    sets = having(docs, bitmap_of(wanted)).join(wanted, "doc_id").select("text", "class").mapInArrow(tidy(build), "class long, features binary")
    return sets.dropDuplicates(["class"]) if repeated else sets


def _linked(docs: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """doc_id, n_shingles, class, root (of the class's component; both null for the empty set), component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialize(facts(docs, words), "shingle-facts")
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / PER_PART))
    groups = materialize(grouped(docs, words, over, under, parts), "groups")
    release(spark)
    reps = materialize(known.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "classes")
    repeated = not known.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    size = groups.groupBy("lead").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    size = materialize(size, "sizes")
    large = size.filter("blocks > 1").select("lead")
    mixes = 0 if large.isEmpty() else MIXES
    lots = max(partitions(spark), math.ceil((size.agg(F.sum("size")).first()[0] or 0) / LOT))
    groups = materialize(groups.join(size.select("lead", "blocks"), "lead"), "groups")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    maps = known.join(reps.join(groups.select("class").distinct(), "class", "left_semi"), ["class", "doc_id"]).select("class", F.col("n_shingles").alias("n"), "bits")
    maps = materialize(maps.dropDuplicates(["class"]) if repeated else maps, "bitmaps")
    comps, links, sets, nearest, turn, full = None, None, None, NEAREST, 0, False
    failed = spark.createDataFrame([], "lot long, a long, b long")
    while True:
        if full:
            # All pairs of two components have met: a class that has none to compare won't get any, as components only grow.
            groups = groups.join(found.filter("b is null").select(F.col("a").alias("class")).distinct(), "class", "left_semi")
        if comps is None:
            now = groups.withColumn("comp", F.col("class"))
        else:
            now = groups.join(comps.withColumnRenamed("id", "class"), "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")
            now = materialize(now, "held")
            groups = now.select("lead", "class", "blocks")
            opened = now.groupBy("lead").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("lead")
            now = now.join(opened, "lead", "left_semi")
        own = F.pmod(F.xxhash64("class", F.lit(min(turn, mixes))), F.col("blocks"))
        if turn < mixes:
            now = now.withColumn("block", F.explode(F.when(F.col("lead") == F.col("class"), every).otherwise(F.array(own))))
        elif mixes:
            most = now.join(large, "lead", "left_semi").groupBy("lead", "comp").agg(F.count("*").alias("times")).groupBy("lead").agg(F.max_by("comp", F.struct("times", "comp")).alias("largest"))
            now = now.join(most, "lead", "left").withColumn("block", F.explode(F.when(F.col("comp") == F.col("largest"), F.array(own)).otherwise(every)))
        else:
            now = now.withColumn("block", F.lit(0).cast("long"))
        now = now.select("lead", "class", "comp", "block", F.pmod(F.xxhash64("lead", "block"), F.lit(lots)).cast("long").alias("lot"))
        found = materialize(_round(now.join(maps, "class"), failed, nearest, over, under), "pairs")
        pairs = found.filter("b is not null")
        turn += 1
        full = turn > mixes
        if pairs.isEmpty():
            if full:
                break
            continue
        if sets is None or turn <= mixes + 1:
            # After the first round that meets all pairs, no other sets can be asked for.
            some = found.filter("b is null").select(F.col("a").alias("class")).distinct().join(reps, "class")
            more = _features(docs, some if sets is None else some.join(sets.select("class"), "class", "left_anti"), words, repeated)
            sets = materialize(more if sets is None else sets.union(more), "sets")
        release(spark)
        x, y = (sets.select(F.col("class").alias(i), F.col("features").alias(f)) for i, f in (("a", "x"), ("b", "y")))
        fresh = materialize(_verify(pairs.select("a", "b").distinct().join(x, "a").join(y, "b"), over, under), "links")
        failed = materialize(failed.union(pairs.join(fresh, ["a", "b"], "left_anti").select("lot", "a", "b")), "failed")
        links = fresh if links is None else links.union(fresh)
        if not fresh.isEmpty():
            comps = components(links)
        release(spark)
        nearest *= FASTER
    named = reps if comps is None else reps.join(comps.withColumnRenamed("id", "class"), "class", "left")
    named = named.select("class", "doc_id", F.coalesce("root", "class").alias("root") if comps is not None else F.col("class").alias("root"))
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("class", "root", "component_id")
    return known.join(named, "class", "left").select("doc_id", "n_shingles", "class", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) of every row of docs."""
    return _linked(docs, words, over, under).select("doc_id", "n_shingles", "component_id")


def _one_each(docs: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """One row of docs, the least as JSON, for each row (doc_id, class) of first."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        memo = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 2)):
            sets = [shingle_set(text.as_py(), words, memo) for text in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], ["row", "doc_id", "class"])

    schema = StructType([*rows.schema.fields[:2], StructField("class", LongType())])
    least = rows.mapInArrow(tidy(run), schema).groupBy("doc_id", "class").agg(F.min_by("row", F.to_json("row")).alias("row"))
    first = first.select(F.col("doc_id").alias("first_id"), F.col("class").alias("first_class"))
    return least.join(first, (F.col("doc_id") == F.col("first_id")) & F.col("class").eqNullSafe(F.col("first_class"))).select("row.*")


def keep_first(docs: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """One row of docs for each component, with its smallest doc_id; rows with a null doc_id stay.

    A doc_id that stands once is judged alone. Where rows repeat a doc_id, each is judged by its text: it belongs to
    its class's component, or if it has no words to that of its doc_id's rows without words.
    """
    found = materialize(_linked(docs, words, over, under).select("doc_id", "class", "root", "component_id"), "linked")
    repeated = materialize(found.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1 and doc_id is not null").select("doc_id"), "repeated")
    out = found.filter("component_id <> doc_id").select("doc_id")
    if repeated.isEmpty():
        return docs.join(out, "doc_id", "left_anti").select(*docs.columns)
    first = found.join(repeated, "doc_id", "left_semi").filter("component_id = doc_id").groupBy("doc_id", "root").agg(F.min("class").alias("class"))
    once = docs.join(out.union(repeated).distinct(), "doc_id", "left_anti").select(*docs.columns)
    return once.union(_one_each(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns), first, words))
