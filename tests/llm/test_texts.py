import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import pii, toxicity

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HARD = [
    "", None, "a@b.com_x@d.org.", "@@a@b@c.d e@f..g h@i.j@k.l", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 01.2.3.45.6", "4337166598464399 4337-1665-9846-4399 1 4337166598464399", "+1 (988) 555-2485 +12 +1-2-3-4-5-6-7-8) ++49 30 1234567. +123456789012345678",
    "9" * 5000 + ".1.1.1", "call (212) 555-1234 now", "john (at) mail (dot) com", "password=b7db7aa4a5fcc78305 Secret: hunter22x", "x" * 20000 + "@", "١٢.1.2.3.4 é@é.com ab@c.é",
]


def by_pattern(text):
    found = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(s)))) % 10 == 0),
        ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15),
    ):
        found += [(kind, *m.span()) for m in pattern.finditer(text or "") if len(m[0]) > 4000 or ok(m[0])] if kind != "ip" else [(kind, *m.span()) for m in pattern.finditer(text or "") if len(m[0]) < 4000 and ok(m[0])]
    return [f for f in found if not (f[0] == "card" and f[2] - f[1] > 4000)]


def test_base_spans(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(5000 + i, t) for i, t in enumerate(HARD)] + [(None, "a@b.cd")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(frame, pii.train(frame)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want, r = by_pattern(text), got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS[:4]], doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_method_adds_spans_and_masks(spark):
    frame = spark.createDataFrame([(i, f"w{i} password=b7db7aa4a5fcc{i} mail me at u{i}@mail.example.com or +1 (988) 555-24{i:02d}", 7) for i in range(50)] + [(99, None, None), (98, "clean text", 10)], "doc_id long, text string, n_chars long")
    model = pii.train(frame)
    spans = {r.doc_id: r.spans for r in pii.find(frame, model).collect()}
    assert "secret:" in spans[3] and spans[98] == spans[99] == ""
    masked = {r.doc_id: r for r in pii.mask(frame, model).collect()}
    assert masked[3].text == "w3 password=<secret> mail me at <email> or <phone>" and masked[3].n_chars == len(masked[3].text)
    assert masked[98].text == "clean text" and masked[99].text is None


def test_quoted_and_long_secrets(spark):
    secrets = {
        0: ('token = "%s" tail', "b7db7aa4a5fcc783059233a8ecf7c5b09fe59497"),
        1: ("TOKEN='%s'; tail", "B7DB7AA4A5FCC78305"),
        2: ('{"api_key": "%s", "n": 1}', "b7db7aa4,a5fc;c783 05"),
        3: ("password=%s tail", "eyJ0eXAi." + "b7Db-7_a" * 60),
        4: ('secret: "%s"', "eyJ0eXAi." + "b7Db-7_a" * 60),
        5: ('token = "%s\n tail', "b7db7aa4a5fcc78305"),
        6: ('token = "%s" tail', "db://u1:b7db7aa4@mail.example.com/" + "b7Db-7_a" * 40),
        7: ('pwd = "%s" tail', 'b7db\\"7aa4a5'),
    }
    rows = [(i, text % secret, 0) for i, (text, secret) in secrets.items()]
    rows += [(20, 'the token = "abc" and "token" = none', 0)]
    frame = spark.createDataFrame([*rows, *[(100 + i, f"token=b7db7aa4a5fcc{i}", 0) for i in range(30)]], "doc_id long, text string, n_chars long")
    model = pii.train(frame)
    masked = {r.doc_id: r.text for r in pii.mask(frame, model).collect()}
    spans = {r.doc_id: r.spans for r in pii.find(frame, model).collect()}
    for i, (text, secret) in secrets.items():
        at = text.index("%s")
        assert f"secret:{at}:{at + len(secret)}" in spans[i].split(",")
        assert masked[i] == text % "<secret>"
    assert masked[20] == rows[-1][1]


def test_written_out_addresses_in_capitals():
    for text in ("JOHN [AT] MAIL [DOT] COM", "John (At) Mail (Dot) Com", "john {at} mail {dot} com"):
        assert [(k, text[a:b]) for k, a, b, _, _ in pii.candidates(text)] == [(0, text)]


def test_em_tells_good_from_bad_labelers():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.6
        v = tuple(int((1 if truth else -1) * (1 if rng.random() < a else -1)) for a in (0.95, 0.9, 0.85, 0.5, 0.9))
        counts[(3, *v)] = counts.get((3, *v), 0) + 1
    model = pii.Classifier(counts)
    good, bad = model.reliability[3][0], model.reliability[3][3]
    assert good[2, 0] > 0.9 and abs(bad[2, 0] - bad[2, 1]) < 0.1
    assert model.probability(3, (1, 1, 1, -1, 1)) > 0.9 > 0.1 > model.probability(3, (-1, -1, -1, 1, -1))


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum()) if len(order) else 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.97
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.95
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500).round(1)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float)
    fit = toxicity.Isotonic(s, y)
    v = fit(np.linspace(-5, 5, 300))
    assert (np.diff(v) >= 0).all() and 0 <= v.min() <= v.max() <= 1
    assert abs(fit(s).mean() - y.mean()) < 1e-9


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, some)).count() == 4
