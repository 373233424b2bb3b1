"""Fill-in-middle transformation over an index of distinct texts.

* Equal texts are grouped by a digest of their content; a group keeps the set of its texts, compared by content, and fails
  unless that is one text.
* Documents are joined to their group by the digest.  A text moves once for each group (combined before the shuffle), however
  many documents have it; documents move without their text.  Groups of over ``PART`` documents are dealt to parts of that size.
* The ends of a text's units (blanks and the word after them, or blanks at the end) are found once for each group and held as
  an Elias-Fano list of code point positions: about two bits and the logarithm of the mean unit length each.  Every document
  of the group selects its two cuts from the list.

Defined results: a null text is empty, an empty text is plain; a null id is the empty string in the seed; rows of one id and
text share their cuts, and rows of one id and different texts are cut apart; repeated rows are repeated; an empty table gives
an empty result.  Other columns are kept; columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textnp as tn
from .store import col

PART, HOT_GROUPS = 256, 50_000
BATCH_BYTES = 8 << 20
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = ("_n", "_form", "_prefix_chars", "_middle_chars", "_output")


class EliasFano:
    """A non-decreasing list of whole numbers up to a bound: low bits side by side, high bits in unary."""

    def __init__(self, values: np.ndarray, bound: int):
        self.size = len(values)
        self.shift = max(0, (max(1, bound // max(1, self.size))).bit_length() - 1)
        high = (values >> self.shift) + np.arange(self.size)
        bits = np.zeros(((bound >> self.shift) + self.size + 64) // 64 * 64, dtype=np.uint8)
        bits[high] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        low = (values[:, None] >> np.arange(self.shift)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")

    def select(self, i: int) -> int:
        """The value at place i."""
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        left, rest = i - int(self.before[word]), int(self.high[word])
        for _ in range(left):
            rest &= rest - 1
        high = word * 64 + (rest & -rest).bit_length() - 1 - i
        first = i * self.shift
        window = int.from_bytes(self.low[first // 8 : (first + self.shift) // 8 + 1].tobytes(), "little")
        return high << self.shift | window >> first % 8 & (1 << self.shift) - 1


def boundaries(text: str) -> EliasFano:
    """Ends of the units of a text, in code points."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    blank = tn.is_blank(data)
    last = np.append(blank[1:], True) & ~blank
    if len(data) and blank[-1]:
        last[-1] = True
    lead = (data & 0xC0) != 0x80
    ends = np.cumsum(lead)[last]
    return EliasFano(ends, len(text))


def cut(text: str, ends: EliasFano, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, code points of the prefix and of the middle, output) of one document."""
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    a, b = sorted(x % (ends.size + 1) for x in h[:2])
    a, b = (ends.select(x - 1) if x else 0 for x in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    mark = len(MIDDLE)
    # the second mark and the third; the first stands at the start
    a, b = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output)), F.locate(MIDDLE, output)
    one, two = F.substring(output, F.lit(mark + 1), a - mark - 1), F.substring(output, a + mark, b - a - mark)
    middle = F.substring(output, b + mark, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs (null texts empty) with _n (units), _form (plain, psm, spm), _prefix_chars and _middle_chars (null if plain), _output.

    Of 100 documents, rate are cut, and of 100 cut ones, spm have the suffix first."""
    docs = docs.select(*(col(c) for c in docs.columns if c not in RESULT))
    text = F.coalesce(col(text_col), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    spread = [col(c) for c in others if "map<" not in docs.schema[c].dataType.simpleString()]
    keyed = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), text.alias("text"), F.struct(*map(col, others)).alias("row"), F.xxhash64(*spread).alias("salt"))
    # at most HOT_GROUPS groups can be as large as this
    large = max(PART, docs.count() // HOT_GROUPS)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > large).select("key", F.ceil(F.col("n") / PART).alias("parts"))
    keyed = keyed.join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.pmod("salt", "parts"), F.lit(0)))
    groups = keyed.groupBy("key", "part").agg(F.collect_set("text").alias("texts"))
    groups = groups.select("key", "part", F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts of one digest"))).alias("text"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256)
    hashes = [F.conv(F.substring(draw, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = keyed.select("key", "part", "row", *hashes).join(groups.hint("merge"), ["key", "part"]).select("row", "text", *(f"h{i}" for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = None, None
        for batch in batches:
            done, first, size = [], 0, 0
            texts = batch.column(1)
            seeds = zip(*(batch.column(2 + i).to_pylist() for i in range(4)), strict=True)
            for at, h in enumerate(seeds):
                now = texts[at].as_py()
                if now != held:
                    held, ends = now, boundaries(now)
                done.append((ends.size, *cut(held, ends, h, rate, spm)))
                size += len(now)
                if size > BATCH_BYTES or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first : at + 1], texts[first : at + 1], *map(pa.array, zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["row", "text", *RESULT])
                    done, first, size = [], at + 1, 0

    schema = rows.select("row", "text").schema.add("_n", "long").add("_form", "string").add("_prefix_chars", "long").add("_middle_chars", "long").add("_output", "string")
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns), *RESULT)
