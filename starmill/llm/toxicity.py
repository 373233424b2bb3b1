"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of its hashed lower-cased words, word beginnings of four and
five bytes (so that inflected forms meet), word pairs and pairs with one word between.  The
model is fitted on at most ``max_rows`` labelled rows: those of smallest hash of the id, a bound that
does not grow with the corpus.  Features are extracted on the executors; one task makes
the passes, since FTRL is sequential, and returns the non-zero weights only, which are at most
2**BITS rows and are broadcast to score every text.

Defined results: a null or empty text scores by the intercept alone; rows with a null label
and repeated labels are not learnt from twice (the highest label of an id counts); with no
usable label at all every score is 0.5; repeated rows are repeated; an empty table gives an empty
result; of rows of one id the least text is learnt from.  Only id and text of documents and id and label of labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textnp as tn
from .ftrl import Ftrl
from .store import col, id_and_text

BITS = 20
BIAS = 0
STEMS = (4, 5)
MAX_ROWS, PASSES, THRESHOLD = 12_000, 5, 0.7
ALPHA, L1 = 0.5, 3.0


def _prefix(data: np.ndarray, w: tn.Words, size: int) -> np.ndarray:
    at = w.start[:, None] + np.arange(size)
    code = np.where(at < w.end[:, None], tn.BYTE_CODE[data[np.minimum(at, max(len(data) - 1, 0))]], np.uint64(0))
    return (code * tn.powers(size)).sum(1, dtype=np.uint64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature index) arrays, one pair for each kind of feature; repeats are not removed."""
    data = tn.lower_ascii(data)
    w = tn.words(data, offsets, tn.is_separator(data))
    shift, kind = np.uint64(64 - BITS), tn.constants(8, 5)

    def index(h: np.ndarray, k: int) -> np.ndarray:
        return np.maximum((tn.mix64(h * kind[k]) >> shift).astype(np.int64), 1)

    yield w.doc, index(w.hash, 0)
    for k, size in enumerate(STEMS, 1):
        yield w.doc, index(_prefix(data, w, size), k)
    for k, gap in ((3, 1), (4, 2)):
        a, b = w.hash[:-gap], w.hash[gap:]
        same = w.doc[:-gap] == w.doc[gap:]
        yield w.doc[:-gap][same], index(a[same] * kind[5] + b[same] * kind[6], k)


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct feature indices of each document of a chunk."""
    pairs = [*zip(*features(data, offsets), strict=True)]
    doc, at = tn.distinct_per_doc(np.concatenate(pairs[0]), np.concatenate(pairs[1]))
    return np.split(at, np.searchsorted(doc, np.arange(1, len(offsets) - 1)))


def held_out(id_col: Column) -> Column:
    """The third of the ids that no label is learnt from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, passes: int = PASSES, usable: Column | None = None) -> np.ndarray:
    """Weights of all 2**BITS coordinates; coordinate 0 is the intercept."""
    known = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull())
    known = known.filter(usable) if usable is not None else known
    known = known.select(col(id_col).alias("id"), col(label_col).alias("label")).groupBy("id").agg(F.max("label").cast("double").alias("_label"))
    known = known.withColumn("_order", F.xxhash64(F.col("id").cast("string"))).orderBy("_order", "id").limit(max_rows)
    # of rows of one id the least text, so that there are no more rows than labels
    sample = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(known), "id")
    sample = sample.groupBy("id", "_order", "_label").agg(F.min("text").alias("_text")).select("_order", "_label", "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for _, _, data, offsets in tn.chunks(batch.column(2)):
                sets += [x.astype("<u4").tobytes() for x in feature_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, type=pa.binary())], names=["_order", "_label", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, y, np.frombuffer(at, "<u4")) for b in batches for o, y, at in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = Ftrl(1 << BITS, alpha=ALPHA, l1=L1)
        for _ in range(passes):
            for _, y, at in rows:
                model.step(np.concatenate([[BIAS], at]).astype(np.int64), 1.0, y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["at", "w"])

    rows = sample.mapInArrow(extract, "_order long, _label double, at binary").repartition(1).mapInArrow(train, "at long, w double").toArrow()
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[rows["at"].to_numpy()] = rows["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted for every row. weights: 2**BITS floats, broadcast (4 MB whatever the corpus)."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, dtype=np.float64)
        table[shared.value[0]] = shared.value[1]
        for batch in batches:
            total = np.full(batch.num_rows, table[BIAS])
            for a, b, data, offsets in tn.chunks(batch.column(1)):
                docs_, at_ = [], []
                for doc, at in features(data, offsets):
                    live = np.flatnonzero(table[at])  # most coordinates weigh nothing
                    docs_.append(doc[live])
                    at_.append(at[live])
                doc, at = tn.distinct_per_doc(np.concatenate(docs_), np.concatenate(at_))
                total[a:b] += np.bincount(doc, table[at], b - a)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
