"""Best-fit decreasing packing of token sequences into bins of a fixed capacity.

* Every text becomes token ids with an end token; only documents longer than a bin are cut, into whole bins and a first piece
  that may be shorter.  Pieces are found once and written; texts are never shuffled.
* Lengths are whole numbers up to the capacity, so best-fit decreasing over all pieces of the corpus depends only on how many
  pieces have each length: at most ``limit`` rows, whatever the size of the corpus.  The packing takes lengths from the longest;
  a segment tree over remaining capacities finds the tightest class of open bins in logarithmic time, and as many pieces as fit
  go there at once, which is where one piece after the other would go.  The outcome is a plan of rows (length, first rank, bins,
  pieces a bin, first bin, offset) whose number is bounded by the capacity alone.
* Every piece then gets its rank among those of its length (sums of buckets, so that a length which most pieces have is
  nobody's single task) and looks its bin and offset up in the plan.

Defined results: a null text is empty and has the end token only; repeated rows are packed as often as they stand; null ids
are kept; an empty table gives an empty result; a piece longer than the capacity or without tokens is an error.  Columns other
than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .pretokens import encoder, packed
from .store import Store, col

LEAST_ROWS, MOST_ROWS, BUCKETS = 256, 1 << 20, 512
BATCH_TOKENS = 1 << 20


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of every piece of at most limit tokens."""
    extra = [("ids", pa.list_(pa.int32()))] if with_ids else []
    names = ["id", "piece", "start", "length", "ids_crc32", *(n for n, _ in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder(tokenizer), packed([end])
        for batch in batches:
            row, piece, start, length, crc, ids, held = [], [], [], [], [], [], 0
            for i in range(batch.num_rows):
                raw = coder.ids(batch.column(1)[i].as_py() or "") + last
                n = len(raw) // 4
                at = 0
                for k in range(-(-n // limit)):
                    size = (n - 1) % limit + 1 if not k else limit
                    own = raw[4 * at : 4 * (at + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
                        held += size
                    at += size
                if held > BATCH_TOKENS or i + 1 == batch.num_rows:
                    arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                    if with_ids:
                        ends = np.cumsum([0, *length], dtype=np.int32)
                        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    row, piece, start, length, crc, ids, held = [], [], [], [], [], [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return found.withColumnRenamed("id", id_col)


class Capacities:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.open = [False] * (2 * self.width)

    def put(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.width
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, size: int) -> int:
        """The least capacity of size or more that has an open bin; 0 if none has."""
        at = size + self.width
        while not self.open[at]:
            while at & 1:
                at //= 2
                if at <= 1:
                    return 0
            at += 1
        while at < self.width:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.width


def best_fit(counts: dict[int, int], limit: int) -> np.ndarray:
    """Rows (length, first rank, bins, pieces a bin, first bin, offset) of best-fit decreasing over so many pieces of each length."""
    tree, bins, rows, used = Capacities(limit), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room:
                first, n = bins[room].pop()
            else:
                room, first, n = limit, used, -(-left // (limit // length))
                used += n
            each = min(room // length, left)
            take = min(n, left // each)
            rows.append((length, rank, take, each, first, limit - room))
            rank += take * each
            left -= take * each
            for capacity, at, many in ((room, first + take, n - take), (room - each * length, first, take)):
                if many and capacity:
                    bins[capacity].append((at, many))
                    tree.put(capacity, True)
            if not bins[room]:
                tree.put(room, False)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pack(rows: DataFrame, limit: int = 1024, length_col: str = "length") -> DataFrame:
    """rows with sequence_id and offset: each row a piece of length_col tokens, in as few sequences of at most limit as best-fit decreasing gives.

    rows are read three times and must be the same each time: a stored table."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    length = col(length_col).cast("long")
    length = F.when(length.between(1, limit), length).otherwise(F.raise_error(F.lit("a piece has no token, or more than a sequence holds")))
    spread = [col(c) for c in names if "map<" not in rows.schema[c].dataType.simpleString() and c != "ids"]
    n = rows.count()
    a_bucket = min(MOST_ROWS, max(LEAST_ROWS, n // BUCKETS))
    kept = rows.select(F.struct(*map(col, names)).alias("row"), length.alias("length"), F.xxhash64(*spread).alias("hash"))
    kept = kept.withColumn("bucket", F.pmod("hash", F.lit(1 + n // a_bucket)))
    counts = kept.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("length", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("hash"))
    ranked = kept.withColumn("place", place).join(before, ["bucket", "length"]).select("row", "length", (F.col("before") + F.col("place") - 1).alias("rank"))
    plan = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    # a row's place in the plan: the last one of its length that starts at its rank or before
    starts = np.searchsorted(-plan[:, 0], -np.arange(limit + 2), side="left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            low, high = starts[length].copy(), starts[length - 1].copy()
            while np.any(open_ := high - low > 1):
                mid = (low + high) // 2
                later = plan[np.minimum(mid, len(plan) - 1), 1] <= rank
                low, high = np.where(open_ & later, mid, low), np.where(open_ & ~later, mid, high)
            _, first_rank, _, each, first, offset = plan[low].T
            by, within = np.divmod(rank - first_rank, each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first + by), pa.array(offset + within * length)], names=["row", "sequence_id", "offset"])

    schema = ranked.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in names), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    store = Store(docs.sparkSession, "packing")
    return pack(store.keep(pieces(docs, tokenizer, id_col, text_col, limit, end, with_ids), "pieces"), limit)


def sequences(packed_rows: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of every sequence, from packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_rows.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
