"""A deterministic automaton over tokens that accepts just the sequences that byte-pair encoding makes.

It begins with one state that has an arc to itself for every byte. Each merge (u, v) adds a gadget: the state
that u leads to is copied without its arc v, u leads to the copy from now on, and the new token uv gets an arc
from wherever u had one, to where v leads. So a state is a copy of an earlier one less one arc, and is kept as
just that: base, removed arc, rank. A text has one path through the automaton; it is found by stepping over the
bytes of a pre-token with a table that gives the tokens ending at a place, longest first, and keeping the one whose
arc leaves the state reached before it. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pieces import LONGEST_KEPT, PATTERN, Odd, Vocabulary, default_path

MEMO_PAIRS = 1_000_000
MEMO_PIECES = 300_000
MEMO_BYTES = 64


class Automaton:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.labels = vocabulary.bytes
        self.base, self.removed, self.rank = [0], [-1], [-1]
        self.target = dict.fromkeys(vocabulary.bytes, 0)
        self.made = dict.fromkeys(vocabulary.bytes, -1)  # rank of the merge that made a token
        self.left = {}
        self.dead = set()
        for r, (u, v, w) in enumerate(vocabulary.merges):
            before, after = self.target[u], self.target[v]
            if not self._arc(before, v):
                self.dead.add(w)
            self.base.append(before)
            self.removed.append(v)
            self.rank.append(r)
            self.target[u] = len(self.base) - 1
            self.target[w], self.made[w], self.left[w] = after, r, u
        self._suffixes(vocabulary)
        self.arcs: dict[int, bool] = {}

    def _arc(self, state: int, token: int) -> bool:
        while state:
            if self.rank[state] > self.made[token]:
                if self.removed[state] == token:
                    return False
                state = self.base[state]
            else:
                token = self.left[token]
        return True

    def _suffixes(self, vocabulary: Vocabulary) -> None:
        """A table over bytes whose state names the tokens that a text ends in, longest first."""
        children, ends, parents = [{}], [None], [(0, 0)]
        for b, t in vocabulary.ids.items():
            if t in self.dead:
                continue
            node = 0
            for x in b:
                if x not in children[node]:
                    children[node][x] = len(children)
                    children.append({})
                    ends.append(None)
                    parents.append((node, x))
                node = children[node][x]
            ends[node] = (t, len(b))
        fails, order = [0] * len(children), [0]
        for node in order:
            order += children[node].values()

        def step(node: int, x: int) -> int:
            while node and x not in children[node]:
                node = fails[node]
            return children[node].get(x, 0)

        class Row(dict):
            __slots__ = ("node",)

            def __missing__(row, x: int) -> int:
                to = step(row.node, x)
                if len(row) < MEMO_BYTES:
                    row[x] = to
                return to

        self.suffixes: list[tuple] = [()] * len(children)
        self.steps = [Row() for _ in children]
        for node in order:
            self.steps[node].node = node
            parent, x = parents[node]
            if parent:
                fails[node] = step(fails[parent], x)
            if node:
                self.suffixes[node] = ((ends[node],) if ends[node] else ()) + self.suffixes[fails[node]]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        arcs, target, steps, suffixes = self.arcs, self.target, self.steps, self.suffixes
        states, came, node = [0], [], 0
        for j, x in enumerate(word, 1):
            node = steps[node][x]
            # Each prefix has one path, so the first token that an arc allows is its last.
            for end in suffixes[node]:
                t, size = end
                key = states[j - size] << 20 | t
                ok = arcs.get(key)
                if ok is None:
                    if len(arcs) >= MEMO_PAIRS:
                        arcs.clear()
                    ok = arcs[key] = self._arc(key >> 20, t)
                if ok:
                    break
            states.append(target[t])
            came.append(end)
        ids, j = [], len(word)
        while j:
            t, size = came[j - 1]
            ids.append(t)
            j -= size
        return ids[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Coder:
    def __init__(self, path: str | None = None) -> None:
        self.vocabulary = v = Vocabulary(path or default_path())
        self.automaton = a = Automaton(v)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.labels = a.labels | {i: s.encode() for s, i in v.special.items()}

        class Memo(dict):
            def __missing__(memo, piece):
                made = self.older.get(piece)
                if made is None:
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        raise Odd
                    made = self.pair(self.plain(" " + piece))
                if len(piece) <= LONGEST_KEPT:
                    if len(memo) >= MEMO_PIECES:
                        self.older = dict(memo)
                        memo.clear()
                    memo[piece] = made
                return made

        self.memo, self.older = Memo(), {}  # pieces in use move on from the older generation

    def plain(self, text: str) -> list[int]:
        words = (text,) if text[1:].isalpha() and text.isascii() and text[0] == " " else self.split(text)
        return [i for word in words for i in self.automaton.encode(word.encode())]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings become their ids."""
        if not self.special:
            return self.plain(text)
        return [i for part in self.special.split(text) for i in ([self.vocabulary.special[part]] if part in self.vocabulary.special else self.plain(part))]

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def pair(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), b"".join(map(self.labels.__getitem__, ids))

    def both(self, text: str) -> tuple[str, bytes]:
        """The ids joined by commas, and the decoded bytes. Pieces between spaces that always cut are kept."""
        if not text or any(s in text for s in self.vocabulary.special):
            return self.pair(self.encode(text))
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise Odd
            made = list(map(self.memo.__getitem__, rest))
        except Odd:
            return self.pair(self.plain(text))
        if first:
            made.insert(0, self.pair(self.plain(first)))
        ids, labels = zip(*made, strict=True)
        return ",".join(ids), b"".join(labels)


@functools.lru_cache(maxsize=2)
def coder(path: str | None) -> Coder:
    """One automaton and memo for all tasks of a worker process."""
    return Coder(path)


def encode_decode(docs: DataFrame, path: str | None = None, texts: bool = False) -> DataFrame:
    """Digests of ids and decoded text of every row of docs; with texts, also the ids and the text themselves.

    Null and empty texts have no ids and decode to the empty text. Repeated rows each give a row; a null doc_id
    stays null; other columns are not read.
    """
    more = [("ids", pa.string()), ("decoded", pa.string())] if texts else []

    def run(batches):
        both = coder(path).both
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, full = [], [], [], []
            for text in batch.column(1):
                ids, raw = both(text.as_py() or "")
                decoded = raw.decode("utf-8", "replace")
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(decoded.encode()).hexdigest())
                if texts:
                    full.append((ids, decoded))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            columns += [pa.array([x[i] for x in full], kind) for i, (_, kind) in enumerate(more)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(name for name, _ in more)])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts)
