import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import partenum
from tessera.llm.components import components


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, over, under):
    rows = [(d, sets_of(t, n)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    where = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(rows):
        counts = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if under * both >= over * (len(s) + len(rows[j][1]) - both):
                p, q = root(d), root(rows[j][0])
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d)) for d, s in rows)


def families(seed, n):
    """Texts with chains of near copies at about the threshold, shared passages and small sets."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    texts = ["", " \t", "one", "One two", "one  two", "a b c", "a b c d", None, "x y z"]
    while len(texts) < n:
        base = rng.choices(vocabulary, k=rng.choice([4, 8, 15, 30, 60, 120, 400, 900]))
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            texts.append(" ".join(base))
            base = list(base) if rng.random() < 0.5 else base
            for _ in range(rng.choice([0, 1, 1, 2, 1 + len(base) // 60])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    return [(i * 3 % 10_007, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "over", "under"), [(3, 90, 100), (5, 80, 100)])
def test_join_is_exact(spark, n, over, under):
    rows = families(n, 1500)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, n_shingles int").repartition(5)
    got = sorted(map(tuple, partenum.join(frame, n, over, under).collect()))
    assert got == brute(rows, n, over, under)


@pytest.mark.parametrize(("over", "block"), [(80, 8), (90, 3)])
def test_large_groups_are_dealt_in_blocks(spark, monkeypatch, over, block):
    for name, value in (("BLOCK", block), ("LOT", 100), ("AT_ONCE", 7), ("NEAREST", 1)):
        monkeypatch.setattr(partenum, name, value)
    rows = families(11, 260)
    got = sorted(map(tuple, partenum.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, over, 100).collect()))
    assert got == brute(rows, 3, over, 100)


def test_no_similar_pair_of_a_group_is_left_out():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.choice([2, 9, 60, 500, 12_000])), dtype=np.int64).astype(np.uint64)
        sets += [np.unique(np.r_[base[int(len(base) * rng.random() * 0.15) :], rng.integers(0, 2**63, 1 + len(base) // 20, dtype=np.int64).astype(np.uint64)]) for _ in range(3)]
    same = [0] * 180
    table = pa.table({"lead": [1] * 180, "class": list(range(180)), "comp": list(range(180)), "block": same, "n": [len(x) for x in sets], "bits": [partenum.bitmap(x) for x in sets]})
    near = {(a, b) for a in range(180) for b in range(a + 1, 180) if partenum.similar(sets[a], sets[b], 80, 100)}
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    found = set(zip(*(x.tolist() for x in partenum.nearest_pairs(table, none, 200, 80, 100)[:2]), strict=True))
    assert near and near <= found and len(found) < 2 * len(near) + 20
    a, b, some = partenum.nearest_pairs(table, none, 1, 80, 100)
    assert len(a) <= 180 and set(some.tolist()) == {x for p in found for x in p}
    failed = pa.table({"a": np.r_[a, -5, 7], "b": np.r_[b, 3, 999]})  # some of sets that are no longer there
    left = set(zip(*(x.tolist() for x in partenum.nearest_pairs(table, failed, 200, 80, 100)[:2]), strict=True))
    assert left == found - set(zip(a.tolist(), b.tolist(), strict=True))


def rows_made(df, name):
    """df's rows, and how many came out of its first operator of that name."""
    rows = df.collect()

    def find(node):
        kind = node.getClass().getSimpleName()
        if kind == name:
            return node.metrics().apply("pythonNumRowsReceived").value()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return next((x for x in map(find, inner) if x is not None), None)

    return rows, find(df._jdf.queryExecution().executedPlan())


def test_more_parts_do_not_repeat_pairs(spark):
    frame = spark.createDataFrame(families(5, 600), "doc_id long, text string").repartition(3)
    few, once = rows_made(partenum.grouped(frame, 3, 80, 100, 1), "FlatMapGroupsInArrowExec")
    many, made = rows_made(partenum.grouped(frame, 3, 80, 100, 500), "FlatMapGroupsInArrowExec")
    assert sorted(many) == sorted(few) and once == len(few) > 500
    assert made <= 2 * spark.sparkContext.defaultParallelism * once


@pytest.mark.parametrize("places", [0, 3, 16])
def test_each_pair_is_given_at_least_once(places):
    rng = np.random.default_rng(8)
    fresh, there, given, times = partenum.Fresh(places), set(), set(), 0
    for _ in range(50):
        pairs = np.unique(np.sort(rng.integers(-3, 12, (40, 2)), 1), axis=0)
        there |= set(map(tuple, pairs.tolist()))
        out = list(zip(*(x.tolist() for x in fresh.of(*np.ascontiguousarray(pairs.T))), strict=True))
        given |= set(out)
        times += len(out)
    assert given == there and (0, 0) in there
    assert places < 16 or times < 1.1 * len(there)


def test_join_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, partenum.join(docs, 3, 90, 100).collect())) == brute(rows, 3, 90, 100)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for over, under in ((9, 10), (8, 10)):
        bands = partenum.Bands(over, under)
        for _ in range(400):
            size = int(rng.integers(2, 700))
            union = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            cut = int(size * (under - over) / under)
            one = int(rng.integers(0, cut + 1))
            a, b = union[one:], np.r_[union[:one], union[cut:]]
            a, b = np.unique(a), np.unique(b)
            if partenum.similar(a, b, over, under) and not np.array_equal(a, b):
                assert np.intersect1d(bands.signatures(a), bands.signatures(b)).size


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(i, i + 1) for i in range(5000, 5030)] + [(9000, i) for i in range(9001, 9400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.join(empty, 3, 9, 10).count() == 0
    frame = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (1, "A B C D"), (5, None), (6, "")], "doc_id long, text string")
    frame = frame.union(spark.createDataFrame([(None, "p q r"), (None, None)], frame.schema))
    got = sorted((tuple(r) for r in partenum.join(frame, 3, 9, 10).collect()), key=str)
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (5, 0, 5), (6, 0, 6), (None, 0, None), (None, 1, None), (None, 2, 1)]
    kept = partenum.keep_first(frame.withColumn("n_shingles", F.lit(1)), 3, 9, 10)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, -1, 1, 5, 6]


def test_first_rows_are_kept_once(spark):
    rows = [
        (1, "a b c d", "x"), (1, "a b c d", "x"), (1, "A b  c d", "y"), (2, "a b c d", "x"),  # repeated smallest doc_id
        (3, "e f g h", "x"), (4, "e f g h", "x"), (4, "i j k l", "x"), (4, "i j k l", "x"),  # one text of doc_id 4 is a copy
        (5, "m n o p", "x"), (5, "q r s t", "x"), (6, "q r s t", "x"),  # two components of one smallest doc_id
        (7, None, "x"), (7, "", "x"), (7, "u v w", "x"), (8, "", "x"),
        (9, " ".join(map(str, range(60))), "x"), (9, " ".join(map(str, range(61))), "x"),  # near copies of one doc_id
        (None, "a b c d", "x"), (None, "a b c d", "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(3)
    kept = sorted(((r.doc_id or -1, (r.text or "").lower().split()[:3]) for r in partenum.keep_first(frame, 3, 90, 100).collect()))
    a, e, i, m, q, u = (x.split() for x in ("a b c", "e f g", "i j k", "m n o", "q r s", "u v w"))
    assert kept == [(-1, a), (-1, a), (1, a), (3, e), (4, i), (5, m), (5, q), (7, []), (7, u), (8, []), (9, ["0", "1", "2"])]
