import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe_automaton, packing, pieces, token_counts

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "x\t \n y", "don't  we'll 12a\u00a0b\u3000c", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>",
    "naïve Ünïcode — “quotes” … 東京 🙂🙂 \u200d\ufeff", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 300, " " * 700 + "z", "\r\n\r\n\x0b\x0c\x85\x1c x", "a b c\n\n\nd e", "The  end.\n\n  Of 'tis\t\tall ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pieces.default_path())


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in rows]
    long = "".join(t for _, t in texts)[:300_000]
    extra = [*TEXTS, None, long, "w" * 70_000, long[:40_000].replace(" ", "")]
    return texts + [(10_000 + i, t) for i, t in enumerate(extra)] + [(3, texts[3][1]), (None, "a b")]


@pytest.fixture(scope="module")
def frame(spark, documents):
    return spark.createDataFrame([(*d, "x", 1) for d in documents], "doc_id long, text string, n_tokens string, start int").repartition(3)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_are_the_librarys(library):
    coder = pieces.PieceCoder(value=list)
    for text in TEXTS:
        assert [i for part in coder.values(text) for i in part] == ids_of(library, text), text


def test_resynchronised_counts(library, documents):
    coder = pieces.PieceCoder()
    for chunk, overlap in ((64, 8), (1000, 1), (5000, 64)):
        resync = token_counts.Resynchroniser(coder, chunk, overlap)
        for _, text in documents[:40] + documents[-8:]:
            if text and "<|" not in text:
                assert resync.count(text) == len(ids_of(library, text))


def test_token_counts(frame, library, documents):
    got = sorted(map(tuple, token_counts.count_tokens(frame).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(ids_of(library, t)), n > 512) for d, t in documents]
    assert got == sorted(want, key=str)


def test_automaton_round_trip(frame, library, documents):
    got = sorted(map(tuple, bpe_automaton.encode_decode(frame).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in documents:
        ids = ids_of(library, t)
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_automaton_takes_any_bytes(library):
    coder = bpe_automaton.Coder()
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(chr(c) for c in rng.integers(1, 0x3000, 30) if not 0xD800 <= c < 0xE000)
        assert coder.encode(text) == ids_of(library, text)


def test_packing(frame, library, documents):
    rows = packing.pack(frame).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    counts = defaultdict(list)
    for d, t in documents:
        counts[d].append(np.asarray([*ids_of(library, t), 0], "<u4"))
    for d, encoded in counts.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, encoded))
        if len(encoded) == 1:
            for r in by_doc[d]:
                assert r.doc_tokens == len(encoded[0]) and r.ids_crc32 == zlib.crc32(encoded[0][r.start : r.start + r.length].tobytes())
    padded = 0
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        padded += at < 1024
    assert padded <= 3


def test_sum_of_squares_picks_the_least():
    rng, done = np.random.default_rng(0), []
    packer = packing.SumOfSquares(16, done.append)
    for _ in range(2000):
        size = int(rng.integers(1, 17))
        before = packer.counts.copy()
        options = []
        for level in range(0, 17 - size):
            if size < 16 and (level == 0 or before[level]):
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 16
                options.append(int((after.astype(int) ** 2).sum()))
        packer.place(size, size)
        if options:
            assert int((packer.counts**2).sum()) == min(options)
    assert all(sum(h) == 16 for h in done)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty).count() == bpe_automaton.encode_decode(empty).count() == packing.pack(empty).count() == 0
