import random
import re
import zlib
from collections import Counter

import numpy as np
import test_partenum
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, pieces, pii, toxicity
from tessera.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert 0.5 * before < docs.count() <= before
            before = docs.count()
    assert docs.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert docs.select("doc_id").distinct().count() == before


def test_toxic_rows_are_dropped_by_their_own_score(spark, monkeypatch):
    class Marked(toxicity.Model):
        def score(self, texts):
            return np.array([{"bad": 0.9, "half": 0.5}.get(t, 0.1) for t in texts])

    monkeypatch.setattr(toxicity, "train", lambda docs, labels: Marked({}, None, None, 0.0))
    rows = [(1, "bad"), (1, "good"), (1, "bad"), (None, "bad"), (None, "good"), (2, "half"), (3, None), (4, "good"), (4, "good")]
    docs = spark.createDataFrame([("x", *r) for r in rows], "lang string, doc_id long, text string")
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or -1), r.text or "") for r in kept.collect()) == [(-1, "good"), (1, "good"), (3, ""), (4, "good"), (4, "good")]


ODD_NAMES = ("__copy", "__spans", "__at", "class", "row", "part", "shard")


def odd_documents(spark):
    """The smallest table with null and repeated rows, rows without words, copies, shared passages, personal data and a very long text."""
    rng = random.Random(5)
    words = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    passage, near = words(60), words(120)
    long = words(30_000)
    rows = [(10**6 + i, t) for i, t in enumerate([None, "", " \t", "one", "One two", "one  two"])]
    rows += [(10**6 + 20 + i, " ".join(words(40) + passage + words(30))) for i in range(4)]
    rows += [(10**6 + 40 + i, " ".join([*near[:50], f"x{i}", *near[51:]])) for i in range(5)]
    rows += [(10**6 + 60, " ".join(long)), (10**6 + 61, " ".join(long) + " end"), (10**6 + 62, " ".join(words(200) + long[500:900]))]
    rows += [(10**6 + 80, "Mail to ann_1@mail.com or call (212) 555-0187, token = \"0123456789abcdef0123\" " + " ".join(words(30)))]
    rows += [(None, " ".join(passage)), (None, " ".join(passage)), (None, None), (None, "ann_1@mail.com")]
    rows += [rows[0], rows[1], rows[6], rows[10], rows[10], rows[13]]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").alias("n_chars"))
    return table.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).select("*", *(F.lit(i).alias(c) for i, c in enumerate(ODD_NAMES)))


def without_repeats(rows, window=20):
    """Texts less the words of windows that stand earlier; rows with a null doc_id stay."""
    seen, out = set(), [r for r in rows if r[0] is None]
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        if not any(gone):
            out.append((doc_id, text))
        elif not all(gone):
            out.append((doc_id, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def masked(rows):
    counts = Counter((kind, *v) for _, text in rows for kind, _, _, _, v in pii.candidates(text or ""))
    finder = pii.Finder(pii.Classifier(counts))
    out = []
    for doc_id, text in rows:
        regions = []
        for a, b, kind in sorted((a, b, k) for k, a, b in finder.spans(text or "")[1]):
            if regions and a < regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], b)
            else:
                regions.append([a, b, pii.KINDS[kind]])
        for a, b, kind in reversed(regions):
            text = f"{text[:a]}<{kind}>{text[b:]}"
        out.append((doc_id, text))
    return out


def test_run_is_what_brute_force_gives(spark, tmp_path, monkeypatch):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r, s in zip(rows, model.score([t for _, t in rows])) if s < 0.5]
    known = {d: t for d, t in rows if d is not None}
    first = {d for d, _, component in test_partenum.brute(sorted(known.items()), 5, 80, 100) if d == component}
    rows = [r for r in rows if r[0] is None] + [(d, t) for d, t in known.items() if d in first]
    assert len(known) > len(first)
    found = without_repeats(rows)
    assert sorted(found, key=str) != sorted(rows, key=str)
    rows = masked(found)
    assert sum(a != b for a, b in zip(found, rows)) >= 1

    stages = []
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, tag: stages.append(materialize(df, tag)) or stages[-1])
    pieces_ = corpus_pipeline.run(spark, str(tmp_path)).collect()
    last = stages[-1].collect()
    assert [len(s.columns) for s in stages] == [5 + len(ODD_NAMES)] * 4
    assert sorted(((r.doc_id, r.text) for r in last), key=str) == sorted(rows, key=str)
    assert all(tuple(r[c] for c in ODD_NAMES) == tuple(range(len(ODD_NAMES))) for r in last)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in last)

    tokens = Tokenizer.from_file(pieces.default_path())
    ids = [(d, [*tokens.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    assert sorted(((r.doc_id, r.doc_tokens) for r in pieces_ if r.start == 0), key=str) == sorted(((d, len(i)) for d, i in ids), key=str)
    by, sequences = dict(ids), {}
    for r in pieces_:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            assert r.ids_crc32 == zlib.crc32(np.array(by[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for d, i in ids:
        if d is not None:
            assert sorted(x for r in pieces_ if r.doc_id == d for x in range(r.start, r.start + r.length)) == list(range(len(i)))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 1024
    assert sum(1 for held in sequences.values() if sum(n for _, n in held) < 1024) <= docs.rdd.getNumPartitions() + 8
