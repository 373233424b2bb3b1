"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once.

A byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens side by side.  Tokenizers of
that kind are recognised by their file; texts of any other go through the library whole.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import regex

KNOWN, LONGEST_KNOWN = 1 << 19, 64
# The pattern of the byte-level pre-tokenizer, for any text and for ASCII.
PATTERN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
# The bytes that stand for themselves in the vocabulary; the others stand for the signs from 256 in their order.
OWN_SIGN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGNS = {b: b for b in OWN_SIGN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(OWN_SIGN)))}


class Known(dict):
    """Pre-token -> its ids as unsigned 32-bit little-endian bytes; of bounded size."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, token: str) -> bytes:
        ids = packed([t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(SIGNS))])
        if len(token) <= LONGEST_KNOWN:
            if len(self) >= KNOWN:
                self.clear()
            self[token] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """ids(text): the ids of a text as bytes, without begin, end or added special tokens; special strings in it are tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        plain = not any(t.lstrip or t.rstrip or t.single_word or not t.special for t in added.values())
        self.by_pretoken = plain and kind["model"]["type"] == "BPE" and not kind.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.special = {t.content: packed([i]) for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(self.tokenizer)

    def ids(self, text: str) -> bytes:
        if not self.by_pretoken:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.split and any(s in text for s in self.special):
            return b"".join(self.special[t] if i % 2 else self._plain(t) for i, t in enumerate(self.split.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, (ASCII_PATTERN if text.isascii() else PATTERN).findall(text)))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker, whose table of pre-tokens serves all its tasks."""
    return Encoder(path)
