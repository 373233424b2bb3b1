"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A document is the multiset of its paragraphs (pieces between line feeds).  Every paragraph
is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo a power of two.  Hence the order of paragraphs does not matter
and a paragraph can be added to or taken from a fingerprint without the text: ``add`` and
``remove``.  A vector has two parts:

* 8 lanes modulo 2**64, the 512-bit keyed digest of the paragraph: equality;
* 64 lanes modulo 2**16, the sum of +-1 vectors of the paragraph's three-word runs: the
  squared length of the difference of two such parts estimates how many runs the documents
  do not share, which gives ``likeness`` between 0 and 1.

Defined results: a null text is empty; the empty text is one empty paragraph; repeated rows
are repeated; rows of equal or null id are ordered by text, null ids last; one row is its
own successor; an empty table gives an empty result.  Columns other than id and text are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as tn
from .store import WHOLE, id_and_text

EQUAL_LANES, LIKE_LANES, RUN = 8, 64, 3
U64, U16 = np.uint64, np.uint16
HEX = 2 * (8 * EQUAL_LANES + 2 * LIKE_LANES)


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprint of each document of a chunk."""
    docs = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    # a paragraph starts at each document's start and after each line feed; its end excludes the feed
    begin = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(docs), np.searchsorted(offsets, feeds, side="right") - 1])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, offsets[owner + 1], np.append(begin[1:], 0) - 1)
    whole = data.tobytes()
    digest = b"".join(hashlib.blake2b(whole[a:b], digest_size=8 * EQUAL_LANES).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True))
    each = np.frombuffer(digest, dtype="<u8").reshape(-1, EQUAL_LANES)
    equal = np.add.reduceat(each, np.searchsorted(owner, np.arange(docs)), axis=0)
    # the three-word runs of each paragraph, or all its words where it has fewer; blank and empty ones drop out
    w = tn.words(data, np.append(begin, len(data)))
    hashed, at = tn.grams(w, RUN)
    para = w.doc[at]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < RUN))
    few = np.zeros(len(short), dtype=U64)
    for i in range(RUN - 1):
        has = size[short] > i
        few[has] += w.hash[w.first[short[has]] + i] * tn.constants(RUN, 77)[i]
    doc = owner[np.concatenate([para, short])]
    hashed = np.concatenate([hashed, tn.mix64(few)])
    order = np.argsort(doc, kind="stable")
    doc, hashed = doc[order], hashed[order]
    like = np.zeros((docs, LIKE_LANES), dtype=np.int64)
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        bits = np.unpackbits(hashed.astype("<u8").view(np.uint8)).reshape(-1, LIKE_LANES)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        like[doc[first]] = 2 * ones - np.diff(np.append(first, len(doc)))[:, None]
    return equal, like.astype(U16)


def encode(equal: np.ndarray, like: np.ndarray) -> list[str]:
    return [a.astype("<u8").tobytes().hex() + b.astype("<u2").tobytes().hex() for a, b in zip(equal, like, strict=True)]


def decode(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 8 * EQUAL_LANES], "<u8").astype(U64), np.frombuffer(raw[8 * EQUAL_LANES :], "<u2").astype(U16)


def of_text(text: str) -> str:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return encode(*vectors(data, np.array([0, len(data)])))[0]


def add(a: str, b: str) -> str:
    """Fingerprint of the union of two multisets of paragraphs."""
    (p, q), (r, s) = decode(a), decode(b)
    return encode([p + r], [q + s])[0]


def remove(a: str, b: str) -> str:
    """Fingerprint without the paragraphs of b."""
    (p, q), (r, s) = decode(a), decode(b)
    return encode([p - r], [q - s])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of word runs two sets of documents have in common, estimated row by row; 1 for equal fingerprints."""
    x, y = a[1].view(np.int16).astype(np.int64), b[1].view(np.int16).astype(np.int64)
    gap = (a[1] - b[1]).view(np.int16).astype(np.int64)
    total = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(1 - (gap * gap).sum(1) / np.maximum(total, 1), 0, 1)
    out[total == 0] = 0
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.where(out >= 1, np.nextafter(1, 0), out))


def _vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [vectors(data, offsets) for _, _, data, offsets in tn.chunks(texts)]
    if not parts:
        return np.zeros((0, EQUAL_LANES), U64), np.zeros((0, LIKE_LANES), U16)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            chars = pa.array([len(t) for t in texts.to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), chars, pa.array(encode(*_vectors(texts)), type=pa.string())], names=["id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt so that each task sees runs of consecutive ids, each run followed by the row that comes next.

    Ids are cut into ranges at quantiles (as many as there are shuffle partitions; of ids that are no whole numbers, quantiles of a
    bounded sample of smallest hash); each range gets one guest row, the first of the range below, so a row's successor in descending
    order is always the next row of its task.  Ids may be of any type that has an order.
    Columns: part, guest, id, text.
    """
    spark = docs.sparkSession
    whole = docs.schema[id_col].dataType.simpleString() in WHOLE
    docs = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("id", F.col("id").cast("long")) if whole else docs
    kind = docs.schema["id"].dataType.simpleString()
    ranges = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if whole:
        cuts = docs.agg(F.percentile_approx("id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 20 * ranges)).first()[0]
        cuts = np.array(sorted({c for c in cuts or [] if c is not None}), dtype=np.int64)
    else:
        some = docs.filter("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(20 * ranges).toArrow()["id"].to_pylist()
        some.sort()
        cuts = np.empty(len(set(some[20::20])), dtype=object)
        cuts[:] = sorted(set(some[20::20]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if whole:
                ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                part = np.searchsorted(cuts, ids, side="left")
            else:
                part = np.array([0 if i is None else bisect.bisect_left(cuts, i) for i in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", *batch.schema.names])

    part_of = docs.select("id").mapInArrow(place, f"part long, id {kind}").groupBy("part").agg(F.max("id").alias("id"))
    heads = part_of.orderBy("part").collect()  # one row per range
    if not heads:
        return docs.select(F.lit(0).cast("long").alias("part"), F.lit(False).alias("guest"), "id", "text")
    # the first id of a range is a guest of the range above; the topmost is one of the lowest range
    hosts = spark.createDataFrame([(heads[(i + 1) % len(heads)]["part"], h["id"]) for i, h in enumerate(heads)], f"part long, head {kind}")
    guests = docs.join(F.broadcast(hosts), F.col("id").eqNullSafe(F.col("head"))).groupBy("part", "id").agg(F.min("text").alias("text")).select("part", "id", "text")
    rows = docs.mapInArrow(place, f"part long, id {kind}, text string").withColumn("guest", F.lit(False))
    rows = rows.unionByName(guests.withColumn("guest", F.lit(True)))
    return rows.repartition(ranges, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), "text").select("part", "guest", "id", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, in which the last half of its code points is replaced by
    the first as many of the next document's in descending id (the topmost's for the lowest), with both likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part, guest = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, texts = batch.column(2), batch.column(3).to_pylist()
            equal, like = _vectors(batch.column(3))
            if held:
                part, guest, ids, texts = held[0] + part, held[1] + guest, pa.concat_arrays([held[2], ids]), held[3] + texts
                equal, like = np.concatenate([held[4], equal]), np.concatenate([held[5], like])
            held = (part[-1:], guest[-1:], ids[-1:], texts[-1:], equal[-1:], like[-1:])
            at = np.array([i for i in range(len(ids) - 1) if not guest[i]], dtype=np.int64)
            for lo in range(0, len(at), 512):
                own = at[lo : lo + 512]
                if any(part[i] != part[i + 1] for i in own):
                    raise ValueError("a range without a guest")
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
                eq, li = _vectors(pa.array(edited, type=pa.large_string()))
                mine = (equal[own], like[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own)),
                        pa.array([len(texts[i]) for i in own], type=pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                        pa.array(encode(*mine)),
                        pa.array(encode(eq, li)),
                        pa.array(likeness(mine, (eq, li))),
                        pa.array(likeness(mine, (equal[own + 1], like[own + 1]))),
                    ],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    dealt = with_next(docs, id_col, text_col)
    return dealt.mapInArrow(run, f"id {dealt.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
