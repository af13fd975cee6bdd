"""Token ids of a byte-level BPE vocabulary, with a bounded memo of space-delimited pieces.

The pre-tokenizer pattern has no look-behind and looks ahead only past white space. So a space with a
non-space on both sides always begins a pre-token, whatever stands around it: what lies between two such
spaces is encoded alike alone and in its text. A text is cut there and each distinct piece is encoded once.
"""

from __future__ import annotations

import json

import tiktoken

#: The byte-level alphabet's printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_KEPT = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    letters = {chr(b): b for b in _PRINTABLE}
    for b in range(256):
        if b not in letters.values():
            letters[chr(256 + sum(x not in _PRINTABLE for x in range(b)))] = b
    return letters


class Vocabulary:
    """The vocabulary of a tokenizers file: bytes by id, merges in order, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre, model = j["pre_tokenizer"] or {}, j["model"]
        if j["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = byte_letters()
        self.path = path
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()}
        whole = {t: i for t, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(whole[a], whole[b], whole[a + b]) for a, b in pairs]


class Odd(Exception):
    """A piece next to more white space: its text is encoded as a whole."""


class PieceCoder:
    """Encodes texts by pieces. value makes what is kept of a piece from its ids."""

    def __init__(self, path: str | None = None, limit: int = 400_000, value=len) -> None:
        self.vocabulary = v = Vocabulary(path or default_path())
        merged = [m[2] for m in v.merges]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.engine = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)
        self.specials = tuple(v.special)
        self.value = value
        encode = self.engine.encode_ordinary

        class Memo(dict):
            def __missing__(memo, piece):
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    raise Odd
                made = value(encode(" " + piece))
                if len(piece) <= LONGEST_KEPT:
                    if len(memo) >= limit:
                        memo.clear()
                    memo[piece] = made
                return made

        self.memo = Memo()

    def whole(self, text: str) -> list[int]:
        """Ids of a text in one go; special strings become their ids, as the tokenizers library does by default."""
        return self.engine.encode(text, allowed_special="all")

    def values(self, text: str) -> list:
        """The kept values, piece by piece."""
        if any(s in text for s in self.specials):
            return [self.value(self.whole(text))]
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise Odd
            found = list(map(self.memo.__getitem__, rest))
        except Odd:
            return [self.value(self.whole(text))]
        return [self.value(self.engine.encode_ordinary(first)), *found] if first else found
