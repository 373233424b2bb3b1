"""Periodic runs of words in every document, by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q, of at least ``max(shortest, 2 * q)`` words, that no
neighbouring word extends keeping the period.  All runs of a text are found in time linear in its words:

* A run repeats a stretch of half the shortest length at the distance of its period, and such repeated stretches cover it
  without a gap.  So only the parts of a text that repeated stretches cover are looked at; no run lies elsewhere.
* A suffix automaton of such a part gives its Lempel-Ziv factors, each with the place of its earliest occurrence.
* Runs that cross or touch a factor's start are found by Main's algorithm: for every period, the longest common extensions to
  both sides of the start, from two Z tables over the factor and a stretch of words before it.
* Runs inside a factor are copied from the factor's earlier occurrence.

Documents are independent, so nothing is shuffled; a task holds one document's automaton at a time.  Words are compared by
their bytes.

Defined results: a null or blank text has no runs and an empty collapsed text; repeated rows are repeated; an empty table
gives an empty result.  Other columns are kept; columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textnp as tn
from .store import plain

BATCH_BYTES = 8 << 20
RESULT = ("_runs", "_kept")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Run = tuple[int, int, int]


def automaton(word: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton of a word: the transitions of every state, and where its strings first end."""
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(word):
        new = len(size)
        step.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if size[to] != size[at] + 1:
                twin = len(size)
                step.append(step[to].copy())
                size.append(size[at] + 1)
                first.append(first[to])
                link.append(link[to])
                link[to] = twin
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                to = twin
            link[new] = to
        last = new
    return step, first


def factors(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, start of its earliest occurrence) of the Lempel-Ziv factors; -1 for a letter that is new."""
    step, first = automaton(word)
    at, n = 0, len(word)
    while at < n:
        state, size = 0, 0
        while at + size < n:
            to = step[state][word[at + size]]
            if first[to] - size >= at:
                break
            state = to
            size += 1
        yield at, max(1, size), first[state] - size + 1 if size else -1
        at += max(1, size)


def z_table(s: list[int]) -> list[int]:
    """For every place of s, the longest common prefix of s and the rest from there."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(word: list[int], at: int, size: int, back: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that start at most back words before at, end from there to at + size, and cross or touch at."""
    before, factor = word[at - back : at], word[at : at + size]
    ahead = z_table([*factor, -1, *before, *factor])[size + 1 :]
    behind = z_table([*before[::-1], -1, *factor[::-1], *before[::-1]])[back + 1 :]
    ahead.append(0)
    behind.append(0)
    for p in range(1, size + 1):  # a whole period to the right of at
        a, b = behind[size - p], ahead[back + p]
        if a + b >= p and a + b + p >= shortest:
            yield at - a, at + p + b, p
    for p in range(1, back + 1):  # a whole period to the left
        a, b = behind[size + p], ahead[back - p]
        if a + b >= p and a + b + p >= shortest:
            yield at - p - a, at + b, p


def runs_of(word: list[int], shortest: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs of a word of whole numbers from 0."""
    word = [*word, -2]  # a last letter of its own closes every run
    n = len(word) - 1
    by_start: dict[int, dict[int, int]] = {}
    previous = 0
    for at, size, source in factors(word):
        # a run that ends in this factor starts fewer than two previous factors and this one before it
        back = min(at, 2 * previous + size)
        if back + size >= shortest and (source >= 0 or previous >= shortest):
            for a, b, p in crossing(word, at, size, back, shortest):
                if word[b] != word[b - p] and (not a or word[a - 1] != word[a - 1 + p]):
                    ends = by_start.setdefault(a, {})
                    ends[b] = min(p, ends.get(b, p))
        if source >= 0 and by_start:
            shift = at - source
            for a in range(source + 1, source + size - shortest):
                for b, p in list(by_start.get(a, {}).items()):
                    if b < source + size:
                        by_start.setdefault(a + shift, {})[b + shift] = p
        previous = size
    return {(a, b): p for a, ends in by_start.items() for b, p in ends.items() if b <= n}


def covered(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a document that repeated stretches of size words cover."""
    n = len(ids) - size + 1
    if n < 2:
        return []
    key = np.zeros(n, dtype=np.uint64)
    for i, c in enumerate(tn.constants(size, 71)):
        key += ids[i : n + i] * c
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    at = np.zeros(n, dtype=bool)
    at[order[1:][same]] = at[order[:-1][same]] = True
    at = np.flatnonzero(at)
    apart = np.flatnonzero(np.diff(at) > size)
    return list(zip(at[np.append(0, apart + 1)].tolist(), (at[np.append(apart, len(at) - 1)] + size).tolist(), strict=True))


def find(words: list[bytes], shortest: int) -> list[Run]:
    """(start, length, period) of the runs of a document, by start and period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    found = []
    for a, b in covered(ids, max(1, (shortest + 1) // 2)):
        if b - a >= shortest:
            found += [(a + s, e - s, p) for (s, e), p in runs_of(ids[a:b].tolist(), shortest).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, text_col: str = "text", shortest: int = 12) -> DataFrame:
    """docs with _runs (array of start, length, period, by start and period) and _kept (the words that stay, joined by one space)."""
    names = [c for c in docs.columns if c not in RESULT]
    columns, inner, schema = plain(docs, names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary() if batch.column(at).type == pa.string() else pa.large_binary())
            first, size, ends, runs, kept = 0, 0, [0], [], []
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                words = raw.split()
                own = find(words, shortest)
                runs += own
                ends.append(len(runs))
                kept.append(b" ".join(collapse(words, own) if own else words))
                size += len(raw)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    flat = np.array(runs, dtype=np.int64).reshape(-1, 3)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN)))
                    yield pa.RecordBatch.from_arrays([*(c[first : i + 1] for c in batch.columns), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=[*inner, *RESULT])
                    first, size, ends, runs, kept = i + 1, 0, [0], [], []

    found = docs.select(*columns).mapInArrow(run, f"{schema}, _runs array<struct<start: bigint, length: bigint, period: bigint>>, _kept string")
    return found.select(*(F.col(i).alias(n) for i, n in zip(inner, names, strict=True)), *RESULT)


def longest(runs: Column) -> Column:
    """The run of greatest length, of those the one that starts first, then of smallest period; null without runs."""
    order = lambda a, b: F.when((a.length > b.length) | ((a.length == b.length) & ((a.start < b.start) | ((a.start == b.start) & (a.period < b.period)))), -1).when(a == b, 0).otherwise(1)
    return F.get(F.array_sort(runs, order), F.lit(0))
