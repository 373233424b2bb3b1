"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else.

* **Which suffixes.** Every window of ``length`` bytes has an anchor: the leftmost place of the
  smallest hash of ``GRAM`` bytes inside it.  Equal windows have equal anchors at equal places, so only
  anchored suffixes need indexing, about two for every ``length - GRAM`` bytes.  Consecutive windows
  of one anchor form a *run*; an entry is (hash of the anchor's bytes, hash of all bytes its run covers).
* **The family.** A batch's entries in key order are its suffix array (ordered by fingerprint
  of the first bytes, not by the bytes).  ``SuffixIndex.add`` merge-scans it against every level for
  keys in both, then merges levels of equal size, so a batch is rewritten at most
  log2(batches) times.
* **Matches.** Runs of equal content are repeated whole.  Where two runs share their anchor but not
  all content (the ends of a match), their windows are hashed and compared one by one:
  within a task for anchors of up to ``BIG`` different runs, by a distributed count beyond.

Entries are counted per chunk before they are dealt, so thousands of copies add one count for each task.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; each row is a document of
its own, so repeated rows repeat each other; a null id is an id like any other, and ids may be of any type; an empty table gives an empty result; extra
columns are kept, but one that bears the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp as tn
from .store import Store, bit_filter, col, id_hash, may_hold, plain

LENGTH, GRAM, BATCHES, BIG = 400, 64, 4, 4096
_PLACE = np.uint64((1 << 30) - 1)
_inverse = np.ones(1, np.uint64)
_BACK = np.uint64(pow(int(tn.BASE), -1, 1 << 64))


def _unscale(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        a = np.full(max(n, 1024), _BACK, np.uint64)
        a[0] = 1
        _inverse = np.multiply.accumulate(a)
    return _inverse[:n]


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tn.BYTE_CODE[data] * tn.powers(len(data)), out=out[1:])
    return out


def _range_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tn.mix64((prefix[b] - prefix[a]) * _unscale(len(prefix))[a])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor hash, run hash, document, first and last window start, place of the anchor of each run."""
    n = len(data)
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    live = size >= length
    if not live.any():
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    prefix = _prefix(data)
    value = tn.mix64((prefix[gram:] - prefix[:-gram]) * _unscale(n + 1)[: n - gram + 1])
    least = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64)
    wide, want = 1, length - gram + 1
    while wide * 2 <= want:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < want:
        least = np.minimum(least[: len(least) - (want - wide)], least[want - wide :])
    edge = np.zeros(n + 1, np.int64)
    edge[offsets[:-1][live]] += 1
    edge[offsets[1:][live] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge)[:n])
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    start, last, anchor = at[first], at[np.append(first[1:], len(at)) - 1], anchor[first]
    whole = tn.mix64(_range_hash(prefix, start, last + length) + (anchor - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return value[anchor], whole, doc, start, last, anchor


def runs(column: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """(bytes, runs) of one chunk after another; documents are row numbers of the column, places are those in ``bytes``,
    and a last array has the place of each run's document start. A very long text comes in overlapping parts: runs cut between
    them differ in content from whole ones and are then compared window by window."""
    for a, b, data, offsets in tn.chunks(column):
        if len(data) <= 2 * tn.CHUNK_BYTES:
            found = _runs(data, offsets, length, gram)
            yield data, (found[0], found[1], found[2] + a, *found[3:], offsets[found[2]])
            continue
        for lo in range(0, len(data), tn.CHUNK_BYTES):  # one document
            part = data[lo : lo + tn.CHUNK_BYTES + length - 1]
            found = _runs(part, np.array([0, len(part)]), length, gram)
            yield part, (found[0], found[1], np.full(len(found[2]), a), *found[3:], np.full(len(found[2]), -lo))


def entries(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """anchor, run, n (places) of the runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in runs(batch.column(0), length, gram):
                order = np.lexsort((found[1], found[0]))
                a, r = found[0][order], found[1][order]
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (r[1:] != r[:-1]))) if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(r[first].view(np.int64)), pa.array(np.diff(np.append(first, len(a))))], names=["anchor", "run", "n"])

    return docs.select(text_col).mapInArrow(run, "anchor long, run long, n long").groupBy("anchor", "run").agg(F.sum("n").alias("n"))


class SuffixIndex:
    """Levels of 1, 2, 4 ... batches, each a table of entries in key order; ``matched`` has the anchors found twice so far."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.store = Store(spark, "suffixes")
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    def add(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Index a batch; returns the anchors it shares with itself or with earlier batches."""
        new = self.store.keep(entries(docs, self.length, self.gram, text_col).sortWithinPartitions("anchor", "run"), "level")
        keys = new.groupBy("anchor").agg(F.sum("n").alias("n"))
        found = keys.filter("n > 1").select("anchor")
        for level in self.levels.values():
            found = found.union(keys.select("anchor").hint("merge").join(level.select("anchor"), "anchor", "left_semi"))
        found = self.store.keep(found, "matched")
        self.matches.append(found)
        size = 1
        while size in self.levels:
            old = self.levels.pop(size)
            merged = self.store.keep(old.union(new).groupBy("anchor", "run").agg(F.sum("n").alias("n")).sortWithinPartitions("anchor", "run"), "level")
            self.store.drop(old, new)
            new, size = merged, 2 * size
        self.levels[size] = new
        return found

    def repeated(self) -> DataFrame:
        """anchor, run, n, kinds (different runs of the anchor), ends (whether a run of the anchor occurs but once) of all anchors that occur twice or more."""
        matched = self.matches[0]
        for m in self.matches[1:]:
            matched = matched.union(m)
        every = None
        for level in self.levels.values():
            every = level if every is None else every.union(level)
        kept = every.join(matched.distinct(), "anchor", "left_semi").groupBy("anchor", "run").agg(F.sum("n").alias("n"))
        kept = self.store.keep(kept, "repeated")
        per = kept.groupBy("anchor").agg(F.count("*").alias("kinds"), (F.min("n") == 1).alias("ends"))
        return self.store.keep(kept.join(per, "anchor"), "flagged")


def _windows(raw: bytes, count: int, length: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    at = np.arange(count)
    return _range_hash(_prefix(data), at, at + length)


def _intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated_windows(docs: DataFrame, index: SuffixIndex, batches: list[DataFrame], text_col: str = "text", big: int = BIG) -> DataFrame:
    """Row keys with ranges [a, b) of repeated bytes. docs: columns id, part (hash of the text) and the text."""
    length, gram, store = index.length, index.gram, index.store
    for batch in batches:
        index.add(batch, text_col)
    flagged = index.repeated()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bit_filter(flagged.select("anchor").distinct(), "anchor"), bit_filter(flagged.filter("ends").select("anchor").distinct(), "anchor")))

    def locate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, ends = shared.value
        for batch in rows:
            for data, (anchor, run, doc, start, last, _, origin) in runs(batch.column(2), length, gram):
                ok = np.flatnonzero(may_hold(twice, anchor))
                end = may_hold(ends, anchor[ok])
                text = [data[a : b + length].tobytes() if e else None for a, b, e in zip(start[ok].tolist(), last[ok].tolist(), end.tolist(), strict=True)]
                take = pa.array(doc[ok])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor[ok].view(np.int64)), pa.array(run[ok].view(np.int64)), pa.array((start - origin)[ok]), pa.array((last - start + 1)[ok]), pa.array(text, type=pa.binary())],
                    names=["id", "part", "anchor", "run", "start", "count", "bytes"],
                )

    located = docs.select("id", "part", text_col).mapInArrow(locate, "id long, part long, anchor long, run long, start long, count long, bytes binary")
    located = store.keep(located.join(flagged, ["anchor", "run"]), "located")
    whole = located.filter("n > 1").select("id", "part", F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + length).alias("b"))
    # ends of matches: single runs, and one of each repeated run of the same anchor
    single = located.filter("ends AND n = 1").select("id", "part", "anchor", "run", "start", "count", "bytes", "kinds", F.lit(True).alias("single"))
    other = located.filter("ends AND n > 1").groupBy("anchor", "run").agg(F.first("count").alias("count"), F.first("bytes").alias("bytes"), F.first("kinds").alias("kinds"))
    other = other.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("part"), "anchor", "run", F.lit(0).cast("long").alias("start"), "count", "bytes", "kinds", F.lit(False).alias("single"))
    ends = single.union(other)
    row = "id long, part long, a long, b long"

    def batch_of(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], type=pa.int64()) for i in range(4)], names=["id", "part", "a", "b"])

    def compare(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        hashes = [_windows(g[5], g[4], length) for g in group]
        _, inverse, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        hit = n[inverse] > 1
        found, at = [], 0
        for g in group:
            if g[6]:
                for a, b in zip(*_intervals(hit[at : at + g[4]]), strict=True):
                    found.append((g[0], g[1], g[3] + int(a), g[3] + int(b) + length))
            at += g[4]
        return found

    def local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple[int, int, int, int]] = []
        for batch in rows:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][2] != r[2]:
                    found += compare(group)
                    group = []
                group.append(r)
            yield batch_of(found)
            found = []
        if group:
            yield batch_of(compare(group))

    few = ends.filter(F.col("kinds") <= big).select("id", "part", "anchor", "start", "count", "bytes", "single").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(local, row)

    # anchors with more runs than a task should hold: every window is a row, counted where its hash is dealt
    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, parts, starts, counts, raws, singles = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                h = _windows(raws[i], counts[i], length).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(n, ids[i])), pa.array(np.full(n, parts[i])), pa.array(starts[i] + np.arange(n)), pa.array(np.full(n, singles[i]))], names=["window", "id", "part", "a", "single"])

    windows = ends.filter(F.col("kinds") > big).select("id", "part", "start", "count", "bytes", "single").mapInArrow(spread, "window long, id long, part long, a long, single boolean")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    many = windows.filter("single").join(twice, "window").select("id", "part", "a", (F.col("a") + length).alias("b"))
    return whole.unionByName(few).unionByName(many)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, big: int = BIG) -> DataFrame:
    """All columns of docs and _kept (remaining bytes), _removed (array of {a, b}: maximal removed byte ranges)."""
    text = F.coalesce(col(text_col), F.lit(""))
    keyed = docs.select(id_hash(docs, id_col).alias("id"), F.xxhash64(text).alias("part"), text.alias("text"))
    order = F.pmod(F.xxhash64("id"), F.lit(batches))
    marks = repeated_windows(keyed, SuffixIndex(docs.sparkSession, length, gram), [keyed.filter(order == i) for i in range(batches)], big=big)
    marks = marks.groupBy("id", "part").agg(F.collect_list(F.struct("a", "b")).alias("__sm_ranges")).withColumnsRenamed({"id": "__sm_id", "part": "__sm_part"})
    docs = docs.drop("_kept", "_removed")
    rows = docs.withColumns({"__sm_id": id_hash(docs, id_col), "__sm_part": F.xxhash64(text)})
    names = docs.columns
    place = names.index(text_col)
    columns, inner, kinds = plain(docs, names)

    def cut(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows:
            kept: list[bytes] = []
            gone: list[list[dict[str, int]]] = []
            for value, ranges in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw = value or b""
                if not ranges:
                    kept.append(raw)
                    gone.append([])
                    continue
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, [r["a"] for r in ranges], 1)
                np.add.at(edge, [r["b"] for r in ranges], -1)
                a, b = _intervals(np.cumsum(edge)[:-1] > 0)
                gone.append([{"a": int(x), "b": int(y) + 1} for x, y in zip(a, b, strict=True)])
                stay = np.concatenate([[0], b + 1]), np.append(a, len(raw))
                kept.append(b"".join(raw[x:y] for x, y in zip(*stay, strict=True)))
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, type=pa.binary()), pa.array(gone, type=kind)], names=[*inner, "_kept", "_removed"])

    found = rows.join(marks, ["__sm_id", "__sm_part"], "left").select(*columns, "__sm_ranges")
    return found.mapInArrow(cut, kinds + ", _kept binary, _removed array<struct<a: long, b: long>>").toDF(*names, "_kept", "_removed")
