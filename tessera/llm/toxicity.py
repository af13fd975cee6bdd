"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon that is learnt from labelled texts, as written and with obfuscation undone;
second-person words near lexicon words; rates of capitals, punctuation and obfuscated words; length. The trees
are fitted to log loss on a bounded sample of labelled rows (SAMPLE, those of smallest hash); one in five of these
is kept for the isotonic calibration. Language, source, doc_id and labels are no inputs of a score.

Null texts count as empty and are scored like any other; rows repeated are scored each; a null doc_id is scored
and belongs to no held-out set. Without labels of both kinds every score is the share of label 1 (0 if none).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

SAMPLE = 20_000
LEXICON = 200
FEATURES = 13
#: Second-person words, and what letters are obfuscated as.
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros tuyo".split())
_LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 or x == 39 else 32 for x in range(256))
_OBFUSCATED = re.compile(rb"[A-Za-z]+(?:[0-9@$!*._-]+[A-Za-z]+)+")
NEAR = 5
PASSAGE = 50


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


def undone(word: bytes) -> bytes:
    """A word with its obfuscation undone: digits and signs to letters, joints dropped."""
    return word.lower().translate(_LEET, b"*._-")


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    raw = text.encode()
    words = words_of(raw)
    n, size = max(1, len(words)), max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    weight = [lexicon[words[i]] for i in hits]
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    passages = Counter(i // PASSAGE for i in hits)
    hidden = shown = 0
    for m in _OBFUSCATED.finditer(raw):
        shown += 1
        hidden += undone(m[0]) in lexicon
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        len(hits) / n,
        float(len(hits)),
        float(len({words[i] for i in hits})),
        sum(weight) / n,
        max(weight, default=0.0),
        sum(weight),
        float(max(passages.values(), default=0)),
        near / n,
        hidden / n,
        capitals / size,
        (raw.count(b"!") + raw.count(b"?")) / size,
        shown / n,
        float(np.log1p(len(words))),
    ]


class Trees:
    """Boosted regression trees on binned features, fitted to log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0) -> None:
        self.depth = depth
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.trees = []
        score = np.full(len(y), self.base)
        nodes_most = 2**depth
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                gain = np.full((x.shape[1], 2**level, bins), -np.inf)
                for f in range(x.shape[1]):
                    key = node * bins + binned[:, f]
                    sg = np.bincount(key, g, 2**level * bins).reshape(-1, bins).cumsum(1)
                    sh = np.bincount(key, h, 2**level * bins).reshape(-1, bins).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    value = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[f] = np.where((sh >= least) & (th - sh >= least), value, -np.inf)
                best = gain.transpose(1, 0, 2).reshape(2**level, -1).argmax(1)
                f, b = best // bins, best % bins
                b = np.where(np.isfinite(gain[f, np.arange(2**level), b]), b, bins)
                splits.append((f, b))
                node = node * 2 + (binned[np.arange(len(y)), f[node]] > b[node])
            leaf = rate * np.bincount(node, g, nodes_most) / (np.bincount(node, h, nodes_most) + 1)
            self.trees.append((splits, leaf))
            score += leaf[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        total = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, b in splits:
                node = node * 2 + (binned[np.arange(len(x)), f[node]] > b[node])
            total += leaf[node]
        return total


class Isotonic:
    """Non-decreasing fit of y to scores by pooling adjacent violators."""

    def __init__(self, score: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum, count, least score, most score
        for s, v in zip(score[order], y[order], strict=True):
            pools.append([float(v), 1.0, float(s), float(s)])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
                a, b = pools[-2], pools.pop()
                pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
        self.at = np.array([v for p in pools for v in (p[2], p[3])])
        self.value = np.array([v for p in pools for v in [p[0] / p[1]] * 2])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.value), 0, 1)


class Model:
    def __init__(self, lexicon: dict[bytes, float], trees: Trees | None, calibrate: Isotonic | None, share: float) -> None:
        self.lexicon, self.trees, self.calibrate, self.share = lexicon, trees, calibrate, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        return self.calibrate(self.trees.score(np.array([features(t or "", self.lexicon) for t in texts])))


def held_out(column) -> F.Column:
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(5)) == 0


def _calibrates(column) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.concat(F.lit("calibration "), column.cast("string")), "UTF-8")), F.lit(5)) == 0


def _lexicon(labelled: DataFrame, size: int) -> dict[bytes, float]:
    """The words that most tell label 1, by smoothed log odds of holding them."""

    def run(batches):
        found: Counter = Counter()
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows[toxic] += 1
                for w in set(words_of((text or "").encode())):
                    found[w, toxic] += 1
        words = sorted({w for w, t in found if t})  # words that no text of label 1 holds can't be listed
        yield pa.record_batch([pa.array([*words, None], pa.binary()), pa.array([*(found[w, 1] for w in words), rows[1]], pa.int64()), pa.array([*(found[w, 0] for w in words), rows[0]], pa.int64())], ["word", "ones", "zeros"])

    counted = labelled.mapInArrow(tidy(run), "word binary, ones long, zeros long").groupBy("word").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    counted = materialize(counted, "toxicity-words")
    total = counted.filter("word is null").collect()
    if not total or not total[0].ones or not total[0].zeros:
        return {}
    n1, n0 = float(total[0].ones), float(total[0].zeros)
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1)) - F.log((F.col("zeros") + 0.5) / (n0 + 1))
    listed = counted.filter(F.col("word").isNotNull() & (F.col("ones") >= 5)).withColumn("odds", odds).filter("odds > 1.5")
    return {bytes(r.word): float(r.odds) for r in listed.orderBy(F.desc(F.col("odds") * F.log1p("ones")), "word").limit(size).collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Model:
    """Learns from labelled rows outside the held-out set. labels: doc_id, toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    known = materialize(known, "toxicity-labels")  # at most sample rows of two numbers: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = materialize(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"), "toxicity-rows")
    lexicon = _lexicon(labelled.filter(~_calibrates(F.col("doc_id"))), size)

    def run(batches):
        for batch in batches:
            x = [features(t or "", lexicon) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = labelled.mapInArrow(tidy(run), "doc_id long, toxic int, x array<double>").orderBy("doc_id", "toxic", "x").limit(2 * sample).collect()
    y = np.array([r.toxic for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array([r.x for r in rows])
    kept = np.array([zlib.crc32(b"calibration %d" % r.doc_id) % 5 == 0 for r in rows])
    fit = ~kept if min(len(set(y[kept])), len(set(y[~kept]))) == 2 else np.ones(len(y), bool)
    trees = Trees(x[fit], y[fit])
    rest = kept if not fit.all() else fit
    return Model(lexicon, trees, Isotonic(trees.score(x[rest]), y[rest]), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            s = np.concatenate([model.score(batch.column(1).slice(i, 256).to_pylist()) for i in range(0, len(batch), 256)] or [np.zeros(0)])
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def drop(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose own score is under a half."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
