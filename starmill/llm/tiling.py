"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are words (ASCII case and punctuation apart).  Runs of ``LEAST`` words that
both have are the seeds, joined on their rolling (Karp-Rabin) hash.  For each document and item the longest common
runs that start at a seed are found, the longest is marked as a tile, words already marked are closed to further tiles, and so on
until no free match of ``LEAST`` words is left.  Tiles may come in any order, so a passage whose sentences are
shuffled is found like the passage itself.  The share of an item's words under tiles is its coverage; a document
that covers any item by ``COVERAGE`` or more is contaminated.

The benchmark is dealt with in blocks of at most ``BLOCK`` words, each broadcast (about 1 MB) to one pass over all
documents; a benchmark of any size is therefore exact, at a pass for each block.  Within a document only seeds are kept, never pairs of
documents.  Long matches are extended word by word on equal hashes, so a very long document costs its seeds.

Defined results: null texts are empty; an item of null id is an item like others and has a null id in the result; ids of either table may be of any type; items of fewer than ``LEAST`` words are one seed of all their words; empty
items match nothing; repeated rows are repeated; ties between equal tiles go to the earlier place in the item, then in the document; an
empty benchmark or table gives no matches; extra columns are ignored by ``matches`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import textnp as tn
from .store import col, plain

LEAST, COVERAGE, BLOCK = 5, 0.6, 100_000


def _words(data: np.ndarray, offsets: np.ndarray) -> tn.Words:
    low = tn.lower_ascii(data)
    return tn.words(low, offsets, tn.is_separator(low))


def tile(doc: np.ndarray, item: np.ndarray, at: np.ndarray, to: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in document, place in item, length) of the tiles of one document and item, given their word hashes and seed pairs (at, to).

    Seeds on one diagonal that follow each other are one maximal match, so extension is a pass over sorted seeds."""
    order = np.lexsort((at, at - to))
    at, to = at[order], to[order]
    new = np.append(True, (np.diff(at - to) != 0) | (np.diff(at) != 1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at))) + least - 1
    live = [(-int(n), int(to[i]), int(at[i])) for n, i in zip(size, first, strict=True)]
    import heapq

    heapq.heapify(live)
    used_doc: set[int] = set()
    used_item = np.zeros(len(item), dtype=bool)
    tiles = []
    while live and not used_item.all():
        n, t, a = heapq.heappop(live)
        n = -n
        free = [not used_item[t + i] and a + i not in used_doc for i in range(n)]
        if all(free):
            tiles.append((a, t, n))
            used_item[t : t + n] = True
            used_doc.update(range(a, a + n))
            continue
        i = 0  # what is left of an occluded match goes back as its free parts
        while i < n:
            if free[i]:
                j = i
                while j < n and free[j]:
                    j += 1
                if j - i >= least:
                    heapq.heappush(live, (i - j, t + i, a + i))
                i = j
            else:
                i += 1
    return tiles


class Block:
    """Word hashes and sorted seeds of some benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        w = _words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64))
        self.ids = ids
        self.items = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        h, at = tn.grams(w, least)
        owner = w.doc[at]
        self.seeds, self.owner, self.place = self._sort(h, owner, at - w.first[owner])
        self.short = []  # by length: items of fewer words than a seed
        n = np.diff(w.first)
        for size in range(1, least):
            few = np.flatnonzero(n == size)
            if len(few):
                h, at = tn.grams(w, size)
                mine = np.isin(w.doc[at], few)
                self.short.append((size, *self._sort(h[mine], w.doc[at][mine], np.zeros(mine.sum(), np.int64))))

    @staticmethod
    def _sort(h: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        return h[order], owner[order], place[order]

    def pairs(self, h: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index into seeds) of all equal pairs."""
        lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        n = hi - lo
        i = np.repeat(np.arange(len(h)), n)
        return i, np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(h) else i


def _found(block: Block, data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, words of the item, tiled words, tiles, longest tile) of the documents of a chunk that share a seed with an item."""
    w = _words(data, offsets)
    for size, seeds, owner, place in [(least, block.seeds, block.owner, block.place), *block.short]:
        if not len(seeds):
            continue
        h, at = tn.grams(w, size)
        spot = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
        hit = np.flatnonzero(seeds[spot] == h)
        i, j = block.pairs(h[hit], seeds)
        if not len(i):
            continue
        at = at[hit[i]]
        key = w.doc[at] * len(block.ids) + owner[j]
        order = np.argsort(key, kind="stable")
        key, at, to = key[order], at[order], place[j][order]
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            doc, item = divmod(int(key[a]), len(block.ids))
            words = block.items[item]
            tiles = tile(w.hash[w.first[doc] : w.first[doc + 1]], words, at[a:b] - w.first[doc], to[a:b], size)
            yield doc, item, len(words), sum(t[2] for t in tiles), len(tiles), max((t[2] for t in tiles), default=0)


def _item(benchmark: DataFrame, item_col: str) -> Column:
    """Item ids: whole numbers as longs, others as they are."""
    whole = benchmark.schema[item_col].dataType.simpleString() in ("tinyint", "smallint", "int")
    return col(item_col).cast("long") if whole else col(item_col)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int, limit: int) -> Iterator[Block]:
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for row in benchmark.select(_item(benchmark, item_col).alias("item"), col(text_col).alias("text")).orderBy("item", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len((row[1] or "").split())
        if size >= limit:
            yield Block(ids, texts, least)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, least)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """id, item, n_words, n_tiled, n_tiles, longest, coverage, contaminated for every document and item that share a seed."""
    kind = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.select(_item(benchmark, item_col)).schema[0].dataType
    item, arrow = item_type.simpleString(), to_arrow_type(item_type)
    names = [id_col, item_col, "n_words", "n_tiled", "n_tiles", "longest", "coverage", "contaminated"]
    schema = f"`{id_col}` {kind}, `{item_col}` {item}, n_words long, n_tiled long, n_tiles long, longest long, coverage double, contaminated boolean"
    out = None
    for part in _blocks(benchmark, item_col, item_text_col, least, block):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                rows = [(a + f[0], *f[1:]) for a, _, data, offsets in tn.chunks(batch.column(1)) for f in _found(block, data, offsets, least)]
                take = pa.array([r[0] for r in rows], type=pa.int64())
                share = np.array([r[3] / r[2] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array([block.ids[r[1]] for r in rows], type=arrow), *(pa.array([r[i] for r in rows], type=pa.int64()) for i in range(2, 6)), pa.array(share, type=pa.float64()), pa.array(share >= coverage, type=pa.bool_())],
                    names=names,
                )

        found = docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """The rows of docs that cover no benchmark item, each judged by its own text; no shuffle."""
    names = docs.columns
    place = names.index(text_col)
    docs = docs.toDF(*plain(docs, names)[1])
    for part in _blocks(benchmark, item_col, item_text_col, least, block):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for a, _, data, offsets in tn.chunks(batch.column(place)):
                    for doc, _, words, tiled, _, _ in _found(shared.value, data, offsets, least):
                        clean[a + doc] &= tiled / words < coverage
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
