import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import fm_index, substring_dedup


def brute(rows, window=20):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen, out = set(), []
    for d in sorted(words):
        w = words[d]
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(3000)] + ["A", "a"]
    passages = [rng.choices(vocabulary, k=k) for k in (19, 20, 21, 55, 300)]
    loop = rng.choices(vocabulary, k=3) * 30
    out = []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 60, 400]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        if rng.random() < 0.05:
            w += loop
        if out and rng.random() < 0.15:
            w = list(rng.choice(out))
            if rng.random() < 0.5 and w:
                w[rng.randrange(len(w))] = "changed"
        out.append(w)
    return [((i * 7919) % 5003, rng.choice([" ", "  ", "\n"]).join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("shard", [20_000, 50])
def test_remove_is_exact(spark, shard):
    rows = [*texts(shard, 700), (9000, None), (9001, ""), (9002, "x " * 5000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(frame, shard=shard).collect())
    assert got == brute(rows)


def test_hot_passage_is_split(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(frame, shard=100).collect())
    assert got == brute(rows)


def test_remove_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(docs).collect())
    assert got == brute(rows)
    cleaned = {r.doc_id: r for r in substring_dedup.clean(docs).collect()}
    assert set(cleaned) == {d for d, n, gone, _ in got if gone < n or not n}
    assert all(r.n_chars == len(r.text) for r in cleaned.values())


def test_backward_search_counts():
    rng = np.random.default_rng(0)
    tokens = np.r_[rng.integers(1, 6, 4000), 0]
    index = fm_index.FMIndex(tokens, 6)
    starts = np.arange(len(tokens) - 6)
    low = index.repeated(tokens, starts, 6)
    keys = [tuple(tokens[s : s + 6]) for s in range(len(tokens) - 5)]
    counts = {k: keys.count(k) for k in set(keys)}
    assert all((low[s] >= 0) == (counts[keys[s]] > 1) for s in starts)
    by = {}
    for s in starts[low[starts] >= 0]:
        by.setdefault(low[s], set()).add(keys[s])
    assert all(len(v) == 1 for v in by.values())


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove(empty).count() == 0
    t = " ".join(map(str, range(25)))
    frame = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.n_removed) for r in substring_dedup.remove(frame).collect()) == [(-1, 0), (1, 0), (1, 0), (2, 25)]
