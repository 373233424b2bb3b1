"""Substring dedup by sliding sentence spans.

A text is a row of sentences: words up to one that ends in . ! or ?, or up to a line feed; a sentence of over
``LONG`` words is also cut after words that end in a comma, semicolon or colon, and a piece that still has more than ``PIECE``
words before each word whose hash is the least of ``PIECE`` consecutive ones.  Where a piece ends so depends on the words around only,
pieces have at most ``PIECE`` words, and a repeated passage of 50 words holds a whole span wherever it starts and whatever its
punctuation (at most 10 words up to a cut, at most 29 for the span).  From every
sentence or piece starts one span: the shortest run of at least ``SENTENCES`` of them and ``WORDS`` words.  Spans are
hashed (case of A-Z and blanks apart) and joined globally; the first occurrence of a span is
the one of smallest id and position.  Every sentence that any other occurrence covers is removed.

Per chunk, equal spans are counted before they are dealt by hash, so a span that a third of all
documents share is a count from each task; the join back to the occurrences is one to many and
left to the skew handling of the join.

Defined results: a null or empty text has no sentences and stays as it is; rows of one id are one occurrence (their equal
spans are not removed from each other, except later in the same text); rows of null id come after all others, in order of a hash of
their text, and are one occurrence only where their texts are equal; ids may be
of any type that has an order; repeated rows are repeated; an empty table gives an empty result; an input column that bears the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textnp as tn
from .store import col, id_key, plain

SENTENCES, WORDS, LONG, PIECE = 2, 20, 20, 10
_STEP = 0x2545F4914F6CDD1D | 1
_BACK = pow(_STEP, -1, 1 << 64)
_forth, _back = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _forth, _back
    if len(_forth) < n:
        a, b = np.full(n, _STEP, np.uint64), np.full(n, _BACK, np.uint64)
        a[0] = b[0] = 1
        _forth, _back = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _forth[:n], _back[:n]


def _least_of_windows(value: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value (the first of equal ones) of some width consecutive places of one owner."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    windows = np.lib.stride_tricks.sliding_window_view(value, width)
    return np.unique(at + windows[at].argmin(1))


def sentences(data: np.ndarray, offsets: np.ndarray, long: int = LONG, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """document, first byte, end byte, words and hash of each sentence of a chunk."""
    low = tn.lower_ascii(data)
    w = tn.words(low, offsets)
    n = len(w.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.isin(data[w.end - 1], [33, 46, 63])
    stop[:-1] |= (w.doc[1:] != w.doc[:-1]) | (feeds[w.start[1:]] > feeds[w.end[:-1]])
    stop[-1] = True
    first = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    size = np.diff(np.append(first, n))
    lengthy = np.repeat(size > long, size)
    stop |= lengthy & np.isin(data[w.end - 1], [44, 58, 59])
    first = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    size = np.diff(np.append(first, n))
    live = np.flatnonzero(np.repeat(size > piece, size))
    cut = live[_least_of_windows(w.hash[live], np.repeat(np.arange(len(size)), size)[live], piece)]
    stop[cut[cut > 0] - 1] = True
    first = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    size = np.diff(np.append(first, n))
    code = w.hash * tn.powers(int(size.max()))[np.arange(n) - np.repeat(first, size)]
    return w.doc[first], w.start[first], w.end[first + size - 1], size, tn.mix64(np.add.reduceat(code, first))


def spans(data: np.ndarray, offsets: np.ndarray, least: int = SENTENCES, words: int = WORDS) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """(the sentences; first sentence, end sentence and hash of each span)."""
    s = sentences(data, offsets)
    doc, _, _, size, h = s
    m = len(doc)
    if not m:
        none = np.zeros(0, np.int64)
        return s, none, none, np.zeros(0, np.uint64)
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(m)
    end = np.maximum(at + least, np.searchsorted(total, total[:-1] + words, side="left"))
    last = np.searchsorted(doc, doc, side="right")  # end of the own document's sentences
    ok = end <= last
    at, end = at[ok], end[ok]
    forth, back = _steps(m)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * forth, dtype=np.uint64)])
    return s, at, end, tn.mix64((prefix[end] - prefix[at]) * back[at] + (end - at).astype(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """All columns of docs, the text without repeated spans, and n_sentences, n_removed (sentences), n_removed_bytes."""
    keyed = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("like"))
    kind = keyed.schema["id"].dataType.simpleString()

    def order(rows: DataFrame) -> F.Column:
        """The place of an occurrence: its id, then, without one, the hash of its text."""
        return F.struct(id_key(rows, "id").alias("id"), F.when(F.col("id").isNull(), F.col("like")).otherwise(F.lit(0)).alias("like"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, like = batch.column(0), batch.column(2)
            by_id = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy()
            rank = np.empty(batch.num_rows, np.int64)
            rank[np.lexsort((like.to_numpy(), by_id))] = np.arange(batch.num_rows)
            for a, _, data, offsets in tn.chunks(batch.column(1)):
                s, at, _, h = spans(data, offsets, least, words)
                row = a + s[0][at] if len(at) else np.zeros(0, np.int64)
                by = np.lexsort((rank[row], h))
                h, row = h[by], row[by]
                new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(h)))
                at = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), ids.take(at), like.take(at), pa.array(n)], names=["span", "id", "like", "n"])

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in tn.chunks(batch.column(1)):
                s, at, _, h = spans(data, offsets, least, words)
                row, h = tn.distinct_per_doc(a + s[0][at] if len(at) else np.zeros(0, np.int64), h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["span", "id", "like"])

    counted = keyed.mapInArrow(count, f"span long, id {kind}, like long, n long")
    first = counted.select("span", order(counted).alias("at"), "n").groupBy("span").agg(F.min("at").alias("first"), F.sum("n").alias("n")).filter("n > 1").select("span", "first")
    seen = keyed.mapInArrow(occur, f"span long, id {kind}, like long")
    # marks belong to a text of an id, so rows that repeat it share one set of its own size
    marks = seen.select("span", order(seen).alias("at"), id_key(seen, "id").alias("__sm_id"), F.col("like").alias("__sm_like")).join(first, "span")
    marks = marks.groupBy("__sm_id", "__sm_like").agg(F.collect_set(F.struct("span", (F.col("at") == F.col("first")).alias("own"))).alias("__sm_marks"))
    docs = docs.drop("_n", "_gone", "_bytes")
    found = docs.withColumns({"__sm_id": id_key(docs, id_col), "__sm_like": F.xxhash64(F.coalesce(col(text_col), F.lit("")))}).join(marks, ["__sm_id", "__sm_like"], "left")
    names = docs.columns
    place = names.index(text_col)
    chosen, inner, kinds = plain(docs, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            facts: list[tuple[int, int, int]] = []
            for text, mark in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw = (text or "").encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                s, at, end, h = spans(data, np.array([0, len(data)]), least, words)
                m = len(s[0])
                if mark and len(at):
                    code = np.array([x["span"] for x in mark], dtype=np.int64)
                    own = np.array([x["own"] for x in mark])
                    order = np.argsort(code)
                    code, own = code[order], own[order]
                    spot = np.minimum(np.searchsorted(code, h.view(np.int64)), len(code) - 1)
                    hit = code[spot] == h.view(np.int64)
                    # in the first document the first place stays, later ones go
                    again = np.ones(len(h), dtype=bool)
                    again[np.unique(h, return_index=True)[1]] = False
                    hit &= ~own[spot] | again
                    depth = np.zeros(m + 1, dtype=np.int64)
                    np.add.at(depth, at[hit], 1)
                    np.add.at(depth, end[hit], -1)
                    gone = np.cumsum(depth)[:m] > 0
                else:
                    gone = np.zeros(m, dtype=bool)
                if gone.any():
                    stops = np.append(s[1][1:], len(raw))
                    keep = bytearray(raw[: s[1][0]])
                    for a, b, g in zip(s[1].tolist(), stops.tolist(), gone.tolist(), strict=True):
                        if not g:
                            keep += raw[a:b]
                    text = keep.decode()
                texts.append(text)
                facts.append((m, int(gone.sum()), len(raw) - len((text or "").encode())))
            columns = [*batch.columns[: len(names)]]
            columns[place] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f[i] for f in facts], type=pa.int64()) for i in range(3))], names=[*inner, "_n", "_gone", "_bytes"])

    return found.select(*chosen, "__sm_marks").mapInArrow(cut, kinds + ", _n long, _gone long, _bytes long").toDF(*names, "_n", "_gone", "_bytes")
