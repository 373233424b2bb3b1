"""Quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, bad or nothing on every document.  Votes form
at most 3**8 patterns; their counts over all documents are all that expectation-maximisation
needs to estimate, without any gold label, how often each labeller is right about good documents
and about each kind of bad ones (Dawid and Skene) and the posterior of each pattern.  Posteriors are the
soft labels of a linear scorer over hashed shapes of words and word pairs (letter case, length,
closing signs, repetition), which scores every document; it is fitted on at most
``max_rows`` documents, those of smallest hash of the id, so the bound does not grow with the corpus.

Defined results: a null or empty text, like any text of fewer than ``MIN_WORDS`` words, gets no vote
from labellers that need words and is judged by the scorer; repeated rows are repeated; an empty
table gives an empty result; rows with null id are scored but never sampled.  All columns are kept by
``keep_good``; ``classify`` reads only id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as tn
from .ftrl import Ftrl
from .store import col, id_and_text, plain

MIN_WORDS = 8
MAX_ROWS, PASSES, BITS, KEEP = 12_000, 6, 18, 0.4
LABELLERS = ("signs", "capitals", "repeats", "variety", "columns", "closing", "length", "letters")
GOOD, BAD, NONE = 1, 0, 2
#: For each labeller: bad from here, good up to here. Both ends may abstain between.
LIMITS = {"signs": (0.12, 0.06), "capitals": (0.40, 0.20), "repeats": (0.20, 0.03), "variety": (0.85, 0.65), "columns": (0.15, 0.02), "closing": (0.20, 0.03), "letters": (0.35, 0.20)}
_sign = np.zeros(256, dtype=bool)
_sign[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _count(doc: np.ndarray, mask: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc[mask], minlength=docs)


def word_facts(data: np.ndarray, offsets: np.ndarray) -> tuple[tn.Words, dict[str, np.ndarray]]:
    """Words of a chunk and, for each, what the labellers and shapes are made of."""
    w = tn.words(data, offsets)
    size = w.end - w.start
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    span = lambda s: s[w.end] - s[w.start]
    upper = span(sums((data >= 65) & (data <= 90)))
    letter = span(sums(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0)))
    sign = span(sums(_sign[data]))
    last = _sign[data[w.end - 1]] if len(size) else np.zeros(0, bool)
    before = last & (size > 1) & _sign[data[np.maximum(w.end - 2, 0)]] if len(size) else last
    same = np.zeros(len(size), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return w, {"size": size, "upper": upper, "letter": letter, "sign": sign, "last": last, "closing": before, "same": same, "lone": (size == sign)}


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x labellers of GOOD, BAD or NONE."""
    docs = len(offsets) - 1
    w, f = word_facts(data, offsets)
    n = np.diff(w.first)
    safe = np.maximum(n, 1)
    per_doc = lambda x: np.bincount(w.doc, x, docs)
    solid = np.maximum(per_doc(f["size"]), 1)
    letters = np.maximum(per_doc(f["letter"]), 1)
    d, _ = tn.distinct_per_doc(w.doc, w.hash)
    distinct = np.bincount(d, minlength=docs)
    mean = solid / safe
    # share of repeated words; long texts repeat more in any language, so its scale is the square root of the length
    expected = np.minimum(safe, 8 * np.sqrt(safe))
    share = {
        "signs": per_doc(f["sign"]) / solid,
        "capitals": per_doc(f["upper"]) / letters,
        "repeats": _count(w.doc, f["same"], docs) / safe,
        "variety": 1 - distinct / expected,
        "columns": _count(w.doc, f["lone"], docs) / safe,
        "closing": _count(w.doc, f["closing"], docs) / safe,
        "letters": 1 - per_doc(f["letter"]) / solid,
    }
    out = np.full((docs, len(LABELLERS)), NONE, dtype=np.int8)
    enough = n >= MIN_WORDS
    for k, name in enumerate(LABELLERS):
        if name == "length":
            out[enough & (mean >= 3) & (mean <= 12), k] = GOOD
            out[enough & ((mean < 2) | (mean > 20)), k] = BAD
        else:
            bad, good = LIMITS[name]
            out[enough & (share[name] <= good), k] = GOOD
            out[enough & (share[name] >= bad), k] = BAD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each pattern, class x labeller accuracy tables) by expectation-maximisation.

    Bad documents are bad in different ways, so labellers agree within a way and not across: besides the good class
    there is a bad class for each labeller's fault.  A labeller that does not vote says nothing.  The start gives a
    pattern's odds to the classes whose labellers vote bad, which also fixes which class is the good one."""
    k = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(k) % 3
    bad, good = (v == BAD).astype(float), (v == GOOD).astype(float)
    ours = 0.95 * 0.2 ** bad.sum(1)
    fault = np.where(bad.any(1)[:, None], bad, 1.0)
    resp = np.column_stack([ours, (1 - ours)[:, None] * fault / fault.sum(1)[:, None]])
    rate = np.zeros((k + 1, k))
    for _ in range(rounds):
        weight = resp * counts[:, None]
        # prior votes: a labeller is right about its own fault, and seldom calls a good document bad
        prior_bad = np.vstack([np.full(k, 0.02), np.eye(k) + 0.2])
        prior_good = np.vstack([np.full(k, 2.0), np.full((k, k), 0.3)])
        seen_bad, seen_good = weight.T @ bad + prior_bad, weight.T @ good + prior_good
        rate = seen_bad / (seen_bad + seen_good)
        share = (weight.sum(0) + 0.1) / (weight.sum() + 0.1 * (k + 1))
        log = np.log(share) + bad @ np.log(rate).T + good @ np.log(1 - rate).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - resp).max() < 1e-9
        resp = new
        if done:
            break
    return resp[:, 0], rate


def shapes(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each document: shares of hashed word shapes and shape pairs, at length 1."""
    docs = len(offsets) - 1
    w, f = word_facts(data, offsets)
    if not len(w.hash):
        return [(np.zeros(0, np.int64), np.zeros(0))] * docs
    case = np.where(f["upper"] == 0, 0, np.where(f["upper"] < np.maximum(f["letter"], 2), 1, 2))
    shape = case + 3 * np.minimum(f["size"] // 4, 3) + 12 * np.minimum(f["sign"], 3) + 48 * f["closing"] + 96 * f["same"] + 192 * f["lone"] + 384 * (f["letter"] == 0)
    kind = tn.constants(4, 9)
    h = tn.mix64(shape.astype(np.uint64) + kind[0])
    pair = tn.mix64(h[:-1] * kind[1] + h[1:] * kind[2])
    within = w.doc[1:] == w.doc[:-1]
    doc = np.concatenate([w.doc, w.doc[1:][within]])
    at = (np.concatenate([h, pair[within]]) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(doc * (1 << BITS) + at, return_counts=True)
    doc, at = key >> BITS, key & ((1 << BITS) - 1)
    value = np.sqrt(count)
    value /= np.sqrt(np.bincount(doc, value**2, docs))[doc]
    cut = np.searchsorted(doc, np.arange(docs + 1))
    return [(np.maximum(at[a:b], 1), value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) by pattern, NaN where unseen; weights of the scorer). Both of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tn.chunks(batch.column(0)):
                total += np.bincount(pattern(votes(data, offsets)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    docs = id_and_text(docs, id_col, text_col)
    seen = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    by_pattern = np.full(3 ** len(LABELLERS), np.nan)
    at, n = seen["pattern"].to_numpy(), seen["n"].to_numpy()
    if len(at):
        by_pattern[at] = posterior(at, n)[0]

    chosen = docs.filter("id IS NOT NULL").select("id").distinct().withColumn("_order", F.xxhash64(F.col("id").cast("string"))).orderBy("_order", "id").limit(max_rows)
    # of rows of one id the least text, so that there are no more rows than chosen ids
    sample = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(chosen), "id").groupBy("id", "_order").agg(F.min("text").alias("text")).select("_order", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label: list[float] = []
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for _, _, data, offsets in tn.chunks(batch.column(1)):
                label += by_pattern[pattern(votes(data, offsets))].tolist()
                found += shapes(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array([a.astype("<i4").tobytes() for a, _ in found], type=pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], type=pa.binary())], names=["_order", "label", "at", "value"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        model = Ftrl(1 << BITS, alpha=0.5, l1=0.5, l2=0.1)
        for _ in range(passes):
            for _, y, at, value in rows:
                at, value = np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(value, "<f4").astype(float)
                # a text too short for votes is no evidence against; the intercept (coordinate 0) learns from it
                model.step(np.concatenate([[0], at]), np.concatenate([[1.0], value]), y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["at", "w"])

    rows = sample.mapInArrow(extract, "_order long, label double, at binary, value binary").repartition(1).mapInArrow(train, "at long, w double").toArrow()
    weights = np.zeros(1 << BITS)
    weights[rows["at"].to_numpy()] = rows["w"].to_numpy()
    return by_pattern, weights


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, all_columns: bool = False) -> DataFrame:
    """id, weak_score (posterior of the votes), score (linear scorer), good (score >= keep) of every row.

    all_columns: the input's columns come first (the pipeline's filter)."""
    by_pattern, weights = model or fit(docs, id_col, text_col)
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((by_pattern, at, weights[at]))
    docs = docs.drop("_weak", "_score", "_good") if all_columns else docs
    kept = docs.columns if all_columns else [id_col]
    added = ["_weak", "_score", "_good"] if all_columns else ["weak_score", "score", "good"]

    chosen, inner, kinds = plain(docs, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern_p, live, w = shared.value
        table = np.zeros(1 << BITS)
        table[live] = w
        for batch in batches:
            weak, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, data, offsets in tn.chunks(batch.column(len(kept))):
                weak[a:b] = pattern_p[pattern(votes(data, offsets))]
                score[a:b] = [table[0] + (table[i] * v).sum() for i, v in shapes(data, offsets)]
            p = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(weak), pa.array(p), pa.array(p >= keep)], names=[*inner, *added])

    found = docs.select(*chosen, col(text_col).alias("__sm_text")).mapInArrow(run, f"{kinds}, {added[0]} double, {added[1]} double, {added[2]} boolean")
    return found.toDF(*kept, *added)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows the classifier does not reject, with all their columns."""
    return classify(docs, None, id_col, text_col, keep, all_columns=True).filter("_good").drop("_weak", "_score", "_good")
