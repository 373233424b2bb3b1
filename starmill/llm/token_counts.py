"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum over
its distinct pre-tokens of (times it occurs) x (pieces it has).  A task finds pre-token
boundaries for a whole chunk of texts at once, reduces them to per-document frequencies of
distinct pre-tokens, has the library count the pieces of each distinct pre-token once
(kept in a bounded table per worker), joins the two on the pre-token's code and sums.
No shuffle and no state grow with the corpus: a global table of distinct pre-tokens would
move one row per (document, pre-token) through the network, more than the texts themselves.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows give repeated rows;
an empty table gives an empty result; columns other than id and text are ignored.  A special
token's own string inside a text counts as that one token, as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textnp as tn
from .store import id_and_text

CACHE_PIECES = 1 << 17
LONGEST_CACHED = 64
CHUNK_CHARS = 1 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
_classes: np.ndarray | None = None
# What may follow an apostrophe in a contraction of the pre-tokenizer.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for code, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            found = "".join(regex.findall(f"{pattern}+", every))
            table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = code
        _classes = table
    return _classes


def pretoken_starts(points: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Mask of code points at which a pre-token starts. cut: mask (one longer) of segment starts and the end.

    The pattern is: contractions, else an optional single space before a run of letters,
    numbers or other signs, else white space of which the last sign stays for what follows.
    """
    n = len(points)
    kind = char_classes()[points]
    starts = np.ones(n, dtype=bool)
    if not n:
        return starts
    starts[1:] = kind[1:] != kind[:-1]
    starts |= cut[:n]
    space = kind == _SPACE
    # a white space run before a solid sign leaves its last sign apart ...
    last = space.copy()
    last[:-1] &= ~space[1:] & ~cut[1:n]
    last[-1] = False
    starts |= last
    # ... and a plain space there joins the run that follows
    joined = np.flatnonzero(last & (points == 32)) + 1
    starts[joined] = False
    # contractions: an apostrophe that opens a run of other signs and has no space joined before it
    for tail in CONTRACTIONS:
        size = len(tail) + 1
        if n < size:
            continue
        hit = (points[: n - size + 1] == 39) & starts[: n - size + 1]
        for i, c in enumerate(tail, 1):
            hit &= (points[i : n - size + 1 + i] == ord(c)) & ~cut[i : n - size + 1 + i]
        at = np.flatnonzero(hit)
        starts[at + 1] = False
        for i in range(2, size):
            starts[at + i] = False
        after = at + size
        starts[after[after < n]] = True
    # a space after a contraction keeps what the rules above gave it, but never a start of its partner
    starts[joined[joined < n]] = cut[joined[joined < n]]
    return starts


class Counter:
    """Counts pieces per distinct pre-token with the library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[bytes, int] = {}

    def pieces(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        missing = [t for t in tokens if t not in known]
        found = {}
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            for t, e in zip(part, self.tokenizer.encode_batch([x.decode() for x in part], add_special_tokens=False), strict=True):
                found[t] = len(e)
        out = np.fromiter((known[t] if t in known else found[t] for t in tokens), dtype=np.int64, count=len(tokens))
        if len(known) + len(found) > CACHE_PIECES:
            known.clear()
        known.update((t, n) for t, n in found.items() if len(t) <= LONGEST_CACHED)
        return out

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document of a chunk."""
        docs = len(offsets) - 1
        counts = np.zeros(docs, dtype=np.int64)
        whole = data.tobytes()
        segments = offsets
        owner = np.arange(docs)
        drop = np.zeros(0, dtype=np.int64)
        if self.split and any(s.encode() in whole for s in self.special):
            edges, owner_list, special = [], [], []
            for d in range(docs):
                text = whole[offsets[d] : offsets[d + 1]].decode()
                at = int(offsets[d])
                edges.append(at)
                owner_list.append(d)
                seen = 0
                for m in self.split.finditer(text):
                    at += len(text[seen : m.start()].encode())
                    size = len(m[0].encode())
                    special.append(len(edges))
                    edges += [at, at + size]
                    owner_list += [d, d]
                    at += size
                    seen = m.end()
                    counts[d] += 1
            segments = np.array([*edges, len(data)], dtype=np.int64)
            owner, drop = np.array(owner_list), np.array(special, dtype=np.int64)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each code point
        cut = np.zeros(len(points) + 1, dtype=bool)
        cut[np.searchsorted(lead, segments)] = True
        start = lead[pretoken_starts(points, cut)]
        if not len(start):
            return counts
        size = np.diff(np.append(start, len(data)))
        seg = np.searchsorted(segments, start, side="right") - 1
        keep = ~np.isin(seg, drop)
        doc = owner[seg]
        code = tn.BYTE_CODE[data]
        code *= tn.powers(int(size.max()))[np.arange(len(data)) - np.repeat(start, size)]
        key = tn.mix64(np.add.reduceat(code, start))
        start, size, doc, key = start[keep], size[keep], doc[keep], key[keep]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        tokens = [whole[a : a + n] for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True)]
        # frequencies of (document, distinct pre-token), then the join on the pre-token's code
        pair, freq = np.unique(doc * len(first) + inverse, return_counts=True)
        np.add.at(counts, pair // len(first), freq * self.pieces(tokens)[pair % len(first)])
        return counts


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            size = np.zeros(batch.num_rows, dtype=np.int64)
            for a, b, data, offsets in tn.chunks(batch.column(1), CHUNK_CHARS):
                n[a:b] = counter.chunk(data, offsets)
                size[a:b] = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("id", id_col)
