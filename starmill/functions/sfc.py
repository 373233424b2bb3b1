"""Space-filling-curve keys: grid coordinates, Morton and Peano-Hilbert."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

LEVELS = 30
WORD = 30
# Octal digit of each octant (x, y, z bits) of the Hilbert curve.
HILBERT_DIGIT = (0, 1, 7, 6, 3, 2, 4, 5)


def bounding_box(p: DataFrame) -> DataFrame:
    return p.agg(*[f(c).alias(f"{c}{f.__name__}") for c in "xyz" for f in (F.min, F.max)])


def cube(p: DataFrame, pad: float = 1.001) -> DataFrame:
    """One row: corner_x, corner_y, corner_z and size of the padded cube around all bodies."""
    box = bounding_box(p)
    size = F.greatest(*[F.col(f"{c}max") - F.col(f"{c}min") for c in "xyz"]) * pad
    box = box.withColumn("size", size)
    return box.select(*[((F.col(f"{c}min") + F.col(f"{c}max")) * 0.5 - F.col("size") * 0.5).alias(f"corner_{c}") for c in "xyz"], "size")


def grid_coordinates(p: DataFrame, bits: int = LEVELS, exact: bool = False) -> DataFrame:
    """p with integer coordinates ix, iy, iz of 2**bits cells a side; rounded to the nearest, or truncated if exact."""
    cell = F.col("size") / float(1 << bits)
    step = F.floor if exact else F.round
    where = {f"i{c}": step((F.col(c) - F.col(f"corner_{c}")) / cell).cast("long") for c in "xyz"}
    return p.crossJoin(F.broadcast(cube(p))).withColumns(where).drop("corner_x", "corner_y", "corner_z", "size")


def dilate(v: Column, bits: int = 21) -> Column:
    """Bits of v at every third place."""
    x = v.bitwiseAND((1 << bits) - 1)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def undilate(v: Column) -> Column:
    x = v.bitwiseAND(0x1249249249249249)
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(mask)
    return x


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    return F.shiftleft(dilate(ix), 2).bitwiseOR(F.shiftleft(dilate(iy), 1)).bitwiseOR(dilate(iz))


def morton_inverse(key: Column) -> tuple[Column, Column, Column]:
    return undilate(F.shiftrightunsigned(key, 2)), undilate(F.shiftrightunsigned(key, 1)), undilate(key)


def morton_checked(ix: Column, iy: Column, iz: Column) -> Column:
    """The key of coordinates below 2**21, 63 bits; fails on larger or negative ones."""
    fits = (F.greatest(ix, iy, iz) < (1 << 21)) & (F.least(ix, iy, iz) >= 0)
    return F.when(fits, morton(ix, iy, iz)).otherwise(F.raise_error(F.lit("a coordinate does not fit into 21 bits")))


def morton_position(key: Column, corner: dict[str, Column], cell: Column) -> dict[str, Column]:
    """Place of the corner of a key's cell."""
    return {c: corner[c] + i * cell for c, i in zip("xyz", morton_inverse(key), strict=True)}


def octant(key: Column, level: int, levels: int = 20) -> Column:
    """Octal digit of a key of that many levels at a level from 1."""
    return F.shiftright(key, 3 * (levels - level)).bitwiseAND(7).cast("int")


def hilbert_words(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first 20 digits, last 10 digits) of the curve through 2**30 cells a side; y and z change places first."""
    x, y, z = x.astype(np.int64), z.astype(np.int64), y.astype(np.int64)
    full = (1 << LEVELS) - 1
    digits = np.array(HILBERT_DIGIT, dtype=np.int64)
    words = np.zeros((2, len(x)), dtype=np.int64)
    for level, b in enumerate(range(LEVELS - 1, -1, -1)):
        o = ((x >> b & 1) << 2) | ((y >> b & 1) << 1) | (z >> b & 1)
        w = int(level >= 20)
        words[w] = words[w] << 3 | digits[o]
        turn = [o == 0, (o == 1) | (o == 5), (o == 4) | (o == 6), (o == 3) | (o == 7)]
        x, y, z = (
            np.select(turn, [x, y, full - x, full - y], x),
            np.select(turn, [z, x, y, full - x], full - z),
            np.select(turn, [y, z, full - z, z], full - y),
        )
    return words[0], words[1]


@F.pandas_udf(T.StructType([T.StructField("key_hi", T.LongType()), T.StructField("key_lo", T.LongType())]))
def hilbert(ix: pd.Series, iy: pd.Series, iz: pd.Series) -> pd.DataFrame:
    hi, lo = hilbert_words(ix.to_numpy(), iy.to_numpy(), iz.to_numpy())
    return pd.DataFrame({"key_hi": hi, "key_lo": lo})


def sfc_keys(p: DataFrame) -> DataFrame:
    """p with key_hi (60 bits) and key_lo (30 bits) of its place on the Hilbert curve."""
    placed = grid_coordinates(p).withColumn("_key", hilbert("ix", "iy", "iz"))
    return placed.select(*p.columns, "_key.key_hi", "_key.key_lo")


def prefix(level: Column | int) -> tuple[Column, Column]:
    """(prefix_hi, prefix_lo) of key_hi, key_lo at a level: equal within a node of the tree."""
    level = F.lit(level) if isinstance(level, int) else level
    hi = F.expr("0L")
    high = F.when(level >= 20, F.col("key_hi")).otherwise(F.call_function("shiftright", F.col("key_hi"), F.lit(3) * (F.lit(20) - level)))
    low = F.when(level <= 20, hi).otherwise(F.call_function("shiftright", F.col("key_lo"), F.lit(3) * (F.lit(30) - level)))
    return high, low
