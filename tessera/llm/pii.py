"""Personal data by weak supervision.

Base spans are what four fixed patterns find. Further candidates come from wider patterns (written-out e-mail
addresses, phone numbers without country code, grouped card-like numbers, assigned secrets). Labelers of three
kinds vote on every candidate: patterns and checksums, gazetteers, and words around it. Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability and the share of true spans of each kind;
the resulting probabilities train the final span classifier, a logistic one over the votes and shape. It adds
candidates that it finds likelier than THRESHOLD; base spans stay. Only counts of patterns, at most 3 to the
power of the number of labelers for each kind, reach the driver.

Null and empty texts have no spans. Repeated rows give a row each; a null doc_id stays null. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Fixed order of the kinds; the last is only found by the method.
KINDS = ("email", "ip", "card", "phone", "secret")
THRESHOLD = 0.5
BEFORE, AFTER = 40, 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can't begin inside a run of digits: it would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])")
_WIDE_CARD = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,7}(?![0-9A-Za-z])")
_WIDE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
# A quoted value, also one with blanks, goes to its closing quote; another, or one whose quote doesn't close, to the next blank, quote, comma or semicolon.
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?"
    r"(?:\"((?:[^\"\\\n]|\\.){6,}+)\"(?![A-Za-z0-9])|'((?:[^'\\\n]|\\.){6,}+)'(?![A-Za-z0-9])|[\"']?([^\s\"',;]{6,}))",
    re.I,
)
#: Fixed lists: words around spans, by kind, and endings of domains.
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt", "write to"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "fono", "ruf"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "login"),
}
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us co biz example".split())
VOTES = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    found, at, end = [], -1, 0
    while (at := text.find("@", at + 1)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and at >= end and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of email, ip, card, phone."""
    found = [emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        if "." in text:
            found[1] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-40:]) <= 255 for p in m[0].split("."))]
        found[2] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """Further candidates: kind, start, end."""
    found = []
    low = None
    if re.search(r"[(\[{] ?at ?[)\]}]", text, re.I):
        found += [(0, *m.span()) for m in _WIDE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(2, *m.span()) for m in _WIDE_CARD.finditer(text)]
        found += [(3, *m.span()) for m in _WIDE_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower() if low is None else low
        if any(w in low for w in ("password", "passwd", "pwd", "secret", "token", "key")):
            found += [(4, *m.span(m.lastindex)) for m in _SECRET.finditer(text)]
    return found


def _overlaps(span, taken) -> bool:
    return any(span[1] > s and span[0] < e for s, e in taken)


def _encloses(span, taken) -> bool:
    """Whether all spans that overlap it lie within, and leave as much of it as a secret has at least."""
    inner = [(s, e) for s, e in taken if span[1] > s and span[0] < e]
    rest = set(range(*span)).difference(*(range(s, e) for s, e in inner))
    return len(rest) >= 6 and all(span[0] <= s and e <= span[1] for s, e in inner)


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """What each labeler says: 1 for, -1 against, 0 nothing."""
    s = text[start:end]
    digits = _digits(s)
    around = text[max(0, start - BEFORE) : start].lower() + " " + text[end : end + AFTER].lower()
    context = 1 if any(w in around for w in CONTEXT[KINDS[kind]]) else 0
    others = -1 if any(w in around for k, words in CONTEXT.items() if k != KINDS[kind] for w in words if len(w) > 3) else 0
    pattern = 1 if is_base else 0
    if kind == 0:
        gazetteer = 1 if re.split(r"[ .\])}]+", s.rstrip(".)]} "))[-1].lower() in ENDINGS else -1
        shape = 1 if re.search(r"[0-9._]", s.split("@")[0]) else 0
    elif kind == 1:
        gazetteer = -1 if re.search(r"version|v\.|release", around) else 0
        shape = 1 if all(len(p) == len(p.lstrip("0")) or p == "0" for p in s.split(".")) else -1
    elif kind == 2:
        gazetteer = 1 if s[:1] in "3456" else -1
        shape = 1 if luhn(digits) else -1
    elif kind == 3:
        area = digits[-10:-7]
        gazetteer = 1 if area and area[0] in "23456789" else -1
        shape = 1 if re.search(r"[() -]", s) else -1
    else:
        kinds = bool(re.search("[a-z]", s, re.I)) + bool(digits) + bool(re.search(r"[^A-Za-z0-9\s]", s))
        gazetteer = -1 if s.lower() in ("required", "password", "username", "example", "string", "optional") else 0
        shape = 1 if kinds >= 2 and len(s) >= 8 else -1
    return pattern, gazetteer, shape, context, others


def candidates(text: str):
    """kind, start, end, is_base, votes; base spans first, others where no span is yet; secrets may also enclose spans."""
    base = base_spans(text)
    taken = [span for spans in base for span in spans]
    for kind, spans in enumerate(base):
        for a, b in spans:
            yield kind, a, b, True, votes(text, kind, a, b, True)
    for kind, a, b in wide_spans(text):
        if not _overlaps((a, b), taken) or (kind == 4 and _encloses((a, b), taken)):
            taken.append((a, b))
            yield kind, a, b, False, votes(text, kind, a, b, False)


class Classifier:
    """From counts of (kind, votes): reliabilities by EM, then logistic weights."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 60) -> None:
        self.reliability, self.share, self.weights = {}, {}, {}
        for kind in range(len(KINDS)):
            rows = sorted((k[1:], n) for k, n in counts.items() if k[0] == kind)
            if not rows:
                continue
            v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
            votes_for = (v > 0).sum(1) - (v < 0).sum(1)
            p = np.clip(0.5 + 0.2 * votes_for, 0.05, 0.95)  # majority vote to begin with
            for _ in range(rounds):
                share = np.clip(((n * p).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
                log = np.full(len(v), np.log(share) - np.log(1 - share))
                table = np.zeros((VOTES, 3, 2))
                for j in range(VOTES):
                    for a in (-1, 0, 1):
                        at = v[:, j] == a
                        table[j, a + 1] = [(n * p * at).sum() + (2 if a >= 0 else 1), (n * (1 - p) * at).sum() + (2 if a <= 0 else 1)]
                    table[j] /= table[j].sum(0)
                    log += np.log(table[j, v[:, j] + 1, 0]) - np.log(table[j, v[:, j] + 1, 1])
                p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            self.reliability[kind], self.share[kind] = table, float(share)
            x = np.concatenate([v > 0, v < 0, np.ones((len(v), 1))], 1).astype(float)
            w = np.zeros(x.shape[1])
            for _ in range(200):
                q = 1 / (1 + np.exp(-x @ w))
                hessian = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w))
                step = np.linalg.solve(hessian, x.T @ (n * (p - q)) - w)
                w += step
                if np.abs(step).max() < 1e-9:
                    break
            self.weights[kind] = w

    def probability(self, kind: int, v: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        x = np.array([*(a > 0 for a in v), *(a < 0 for a in v), 1], float)
        return float(1 / (1 + np.exp(-x @ self.weights[kind])))


def train(docs: DataFrame) -> Classifier:
    """Fits the labelers' reliabilities and the classifier on all rows."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for kind, _, _, _, v in candidates(text.as_py() or ""):
                    counts[(kind, *v)] += 1
        yield pa.record_batch([pa.array([list(k) for k in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return Classifier({tuple(r.pattern): r.n for r in found.collect()})


class Finder:
    def __init__(self, model: Classifier, threshold: float = THRESHOLD) -> None:
        self.model, self.threshold, self.memo = model, threshold, {}

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans, as (kind, start, end) in order."""
        base, every = [], []
        for kind, a, b, is_base, v in candidates(text):
            if is_base:
                base.append((kind, a, b))
            elif (kind, v) not in self.memo:
                self.memo[kind, v] = self.model.probability(kind, v) >= self.threshold
            if is_base or self.memo[kind, v]:
                every.append((kind, a, b))
        return sorted(base), sorted(every)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, of every row."""

    def run(batches):
        finder = Finder(model)
        for batch in batches:
            counts, shas, spans = [[], [], [], []], [], []
            for text in batch.column(1):
                base, every = finder.spans(text.as_py() or "")
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for k, _, _ in base))
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(every))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with each found span of text replaced by its kind in angle brackets; n_chars follows where there is one."""
    names = docs.columns

    def run(batches):
        finder = Finder(model)
        for batch in batches:
            at, texts = batch.schema.get_field_index("text"), []
            for text in batch.column(at).to_pylist():
                if text:
                    out, end = [], 0
                    for a, b, kind in sorted((a, b, k) for k, a, b in finder.spans(text)[1]):
                        if a >= end:
                            out += [text[end:a], f"<{KINDS[kind]}>"]
                        elif b <= end:
                            continue
                        end = max(end, b)
                    text = "".join([*out, text[end:]])
                texts.append(text)
            columns = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in names:
                i = names.index("n_chars")
                columns = columns.set_column(i, batch.schema.field(i), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(i).type))
            yield columns

    return docs.mapInArrow(tidy(run), docs.schema)
