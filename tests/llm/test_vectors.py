import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import additive_quantization, sorted_lists

LARGE = "/root/testdata/check_l/embeddings.parquet"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("x", F.lit("clash")).withColumn("part", F.lit(1))


def brute(ids, x, query_ids, k):
    out = []
    for q in query_ids:
        scores = x @ x[list(ids).index(q)]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(((s, i) for i, s in zip(ids, scores) if i != q), key=lambda p: (-p[0], p[1]))[:k])]
    return out


def loaded(vectors):
    rows = vectors.select("vec_id", "embedding").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)


def test_top_k_is_exact(vectors):
    ids, x = loaded(vectors)
    for block in (2048, 300):
        got = sorted(map(tuple, sorted_lists.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block=block).collect()))
        assert got == [(a, b, c, int(d)) for a, b, c, d in brute(ids, np.floor(x * 256), sorted(i for i in ids if i % 50 == 0), 5)]


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    x = np.floor(rng.exponential(40, (500, 4)))
    got = list(sorted_lists.block_top_k(np.arange(500), x, np.arange(20), x[:20], 3))
    for i, (found, scores, read) in enumerate(got):
        want = sorted(((x[j] @ x[i], -j) for j in range(500) if j != i), reverse=True)[:3]
        assert [(s, -f) for f, s in zip(found.tolist(), scores.tolist())] == want
    assert np.mean([read for *_, read in got]) < 1 and min(read for *_, read in got) <= 0.5
    # With a bar that others set, less is read, and only what reaches it is given.
    bars = np.array([scores[0] for _, scores, _ in got], float)
    again = list(sorted_lists.block_top_k(np.arange(500), x, np.arange(20), x[:20], 3, bars))
    assert all(scores.tolist() == [s for s in first.tolist() if s >= bar] for (_, scores, _), (_, first, _), bar in zip(again, got, bars))
    assert np.mean([read for *_, read in again]) < np.mean([read for *_, read in got])


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 40])
def test_blocks_of_any_size_with_ties(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-2, 3, (n, 3)).astype(float)
    q = rng.integers(-2, 3, (7, 3)).astype(float)
    own = np.arange(7)
    for bars in (None, np.full(7, 1.0)):
        for i, (found, scores, _) in enumerate(sorted_lists.block_top_k(np.arange(n), x, own, q, 5, bars)):
            want = sorted((-(x[j] @ q[i]), j) for j in range(n) if j != own[i])[:5]
            assert [(-s, f) for f, s in zip(found.tolist(), scores.tolist())] == [w for w in want if bars is None or -w[0] >= 1]


def test_large_components_are_exact(spark):
    rows = [(i, [float(i), 1e9 * (i % 3), -(2.0**40) if i % 7 == 0 else 3.0]) for i in range(120)] + [(150, [1e300, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(v * 256)) for v in x] for i, x in rows}
    got = sorted(map(tuple, sorted_lists.top_k(frame, frame.filter("vec_id % 50 = 0"), block=30).collect()))
    want = []
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, min(max(-s, -(2**63) + 1), 2**63 - 1)) for r, (s, i) in enumerate(best)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g for g in got if abs(g[3]) < 2**62] == [w for w in want if abs(w[3]) < 2**62]


def test_recall(vectors):
    ids, x = loaded(vectors)
    index, books = additive_quantization.build(vectors)
    got = additive_quantization.nearest(index, books, vectors.filter("vec_id % 20 = 0"), block=1024).collect()
    want = brute(ids, x, sorted(i for i in ids if i % 20 == 0), 20)
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
    exact = dict(zip(ids, x))
    for r in got:
        assert abs(r.score - exact[r.query_id] @ exact[r.vec_id]) < 1e-12
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert all([a[0] for a in sorted(v)] == list(range(1, 21)) and [a[1:] for a in sorted(v)] == sorted(a[1:] for a in v) for v in by.values())


@pytest.mark.skipif(not os.path.exists(LARGE), reason="needs a table of several times the sample's size")
def test_recall_of_rows_beyond_the_sample(spark):
    vectors = spark.read.parquet(LARGE)
    ids, x = loaded(vectors)
    ids = np.array(ids)
    assert len(ids) > 5 * additive_quantization.SAMPLE
    got = additive_quantization.nearest(*additive_quantization.build(vectors), vectors.filter("vec_id % 400 = 0")).collect()
    by, asked = {}, np.flatnonzero(ids % 400 == 0)
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[asked] @ x.T
    scores[asked[:, None] == np.arange(len(ids))] = -np.inf
    assert len(got) == 20 * len(asked)
    assert np.mean([len(by[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20 for q, s in zip(asked, scores)]) >= 0.95


def test_ties_and_lengths_that_the_sample_has_not(spark):
    """Equal vectors go by vec_id also where they are more than a shortlist; a rare length gets its own codebooks."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(400)] + [(1000 + i, [float(i), 1.0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sample in (5, 100):
        index, books = additive_quantization.build(frame, sample)
        got = additive_quantization.nearest(index, books, frame.filter("vec_id in (0, 200, 1020)"), k=5, shortlist=20, block=64).collect()
        assert [(r.rank, r.vec_id) for r in sorted(got) if r.query_id == 0] == [(i, i) for i in range(1, 6)]
        assert [(r.rank, r.vec_id) for r in sorted(got) if r.query_id == 200] == [(i + 1, i) for i in range(5)]
        if sample == 100:
            assert [(r.rank, r.vec_id) for r in sorted(got) if r.query_id == 1020] == [(i, 1030 - i) for i in range(1, 6)]
        assert {r.vec_id >= 1000 for r in got if r.query_id == 1020} == {True}


def test_least_values_are_found_by_groups():
    step = np.random.default_rng(1).normal(size=(50, 2048)).astype(np.float32)
    at = additive_quantization._least(step, 8)
    assert (np.sort(np.take_along_axis(step, at, axis=1), axis=1) == np.sort(step, axis=1)[:, :8]).all()


def test_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    books = additive_quantization.fit(x, 4, 16)
    errors = []
    for beam in (1, 8):
        codes, norms = additive_quantization.encode(x, books, beam)
        stood = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose(norms, (stood**2).sum(1), rtol=1e-4)
        errors.append(((x - stood) ** 2).sum())
    assert errors[1] < errors[0] < (x**2).sum()


ODD = [(0, None), (20, [0.0, 0.0]), (40, [1.0, None]), (50, [float("nan"), 1.0]), (60, [1.0, float("inf")]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-1.0, 0.5]), (9, [1.0]), (None, [1.0, 1.0]), (300, [])]


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, sorted_lists.top_k(frame, frame.filter("vec_id % 50 = 0")).collect()))
    unit = 256 * 256
    assert got == [(100, 1, 7, 5 * unit), (100, 2, 200, 5 * unit), (100, 3, 8, 0), (100, 4, 20, 0), (200, 1, 7, 5 * unit), (200, 2, 100, 5 * unit), (200, 3, 8, 0), (200, 4, 20, 0)]
    index, books = additive_quantization.build(frame)
    got = sorted(map(tuple, additive_quantization.nearest(index, books, frame.filter("vec_id % 20 = 0")).collect()))
    assert got == [(100, 1, 7, 5.0), (100, 2, 200, 5.0), (100, 3, 8, 0.0), (200, 1, 7, 5.0), (200, 2, 100, 5.0), (200, 3, 8, 0.0)]


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert sorted_lists.top_k(empty, empty).count() == 0
    assert additive_quantization.nearest(*additive_quantization.build(empty), empty).count() == 0
