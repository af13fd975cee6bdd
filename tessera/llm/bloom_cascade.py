"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix. The keys of a URL are all pairs of a suffix of its host (at dots) and a
prefix of its path of a length that some rule has. Level 1 of the cascade encodes the listed keys; level 2 the
keys of the corpus that level 1 takes wrongly; level 3 the listed keys that level 2 takes; and so on until a
level takes nothing wrongly. Since the levels saw every key of the corpus, the parity of the first level that
rejects a key is exact membership, and no join is needed. Level 1 has so many bits that the wrong keys are
expected to be no more than the listed ones, however large the corpus; the levels grow with the list alone.

Null and odd URLs have an empty host and path and fit no rule. Repeated rows each give a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query: verdict, host, path prefix.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MOST_LEVELS = 64


class Bloom:
    def __init__(self, keys: list[str], rate: float, seed: int) -> None:
        n = max(1, len(keys))
        self.seed = seed
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(-math.log2(rate)))
        self.array = np.zeros(self.bits, bool)
        for k in keys:
            self.array[self._places(k)] = True

    def _places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), self.seed)
        a, b = h >> 64, (h & (2**64 - 1)) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def has(self, key: str) -> bool:
        return all(self.array[p] for p in self._places(key))


class Cascade:
    """Levels in turn; odd ones (from 1) encode listed keys, even ones others."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def has(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if not level.has(key):
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select("page_id", F.translate(host, upper, lower).alias("host"), path.alias("path"))


def _keys(lengths: list[int]):
    """Column of the keys of a row with host and path; a key is host + path prefix."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.concat(s, F.substring("path", F.lit(1), n)))))


def _taken_wrongly(level: Bloom, listed: set[str]):
    @F.pandas_udf("boolean")
    def wrong(keys: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(keys)
        return pd.Series(np.array([k not in listed and level.has(k) for k in distinct], bool)[codes])

    return wrong


def build(spark: SparkSession, urls: DataFrame, rules: list[tuple[str, str, str]]) -> Cascade:
    """The cascade for all keys of urls (host, path). What a level takes wrongly is small, see above."""
    listed = sorted({host + path for _, host, path in rules})
    lengths = sorted({len(path) for _, _, path in rules})
    universe = urls.select(F.explode(_keys(lengths)).alias("key"))
    size = max(1, urls.count() * 4 * len(lengths))
    levels: list[Bloom] = []
    inside, outside = listed, None  # outside None: all keys of the corpus that aren't listed
    while len(levels) < MOST_LEVELS:
        rate = min(0.5, max(len(inside), 1) * math.sqrt(0.5) / size) if not levels else 0.5
        level = Bloom(inside, rate, len(levels))
        levels.append(level)
        if outside is None:
            wrong = _taken_wrongly(level, set(listed))
            outside = [r.key for r in universe.filter(wrong("key")).distinct().toLocalIterator()]
        else:
            outside = [k for k in outside if level.has(k)]
        if not outside:
            return Cascade(levels)
        inside, outside = outside, inside
    raise RuntimeError("the cascade doesn't end")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages. The longest rule that fits wins.

    default: the verdict where no rule fits; the cascade lists what is ruled, all else is let pass.
    """
    urls = split_url(pages)
    cascade = build(pages.sparkSession, urls, rules)
    lengths = sorted({len(path) for _, _, path in rules})
    verdicts = {host + path: verdict for verdict, host, path in rules}

    def run(batches):
        memo: dict[str, bool] = {}

        def has(key):
            if key not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[key] = cascade.has(key)
            return memo[key]

        for batch in batches:
            rule = [max((k for k in row if has(k)), key=len, default=None) for row in batch.column(3).to_pylist()]
            verdict = [default if r is None else verdicts[r] for r in rule]
            yield pa.record_batch([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    page_id = dict(pages.dtypes)["page_id"]
    return urls.select("page_id", "host", "path", _keys(lengths).alias("keys")).mapInArrow(run, f"page_id {page_id}, host string, path string, rule string, verdict string")


_EXPECTED = " union all ".join(f"select '{v}' v, '{h}' h, '{p}' p" for v, h, p in RULES)
ORACLE_SQL = f"""
with rules as ({_EXPECTED}),
cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
fit as (select page_id, max_by(h || p, length(h || p)) rule, max_by(v, length(h || p)) verdict from parts join rules
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') verdict from parts p left join fit f using (page_id)
"""
