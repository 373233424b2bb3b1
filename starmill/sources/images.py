"""24-bit pictures and colour maps: a 54-byte header, then three bytes a pixel, row by row."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import write_stream

HEAD = "<2siHHiiiiHHiiiiii"
HEAD_SIZE = struct.calcsize(HEAD)


def write_image(spark: SparkSession, path: str, pixels: DataFrame, width: int, height: int) -> int:
    """One picture of width by height pixels (ix, iy, r, g, b; others are black); a bounded array, whatever the number of rows."""
    area = np.zeros((height, width, 3), np.uint8)
    inside = pixels.filter(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1)).select(*[F.col(c).cast("int") for c in ("ix", "iy", "r", "g", "b")])
    t = inside.toArrow()
    at = t["iy"].to_numpy(), t["ix"].to_numpy()
    for k, c in enumerate("rgb"):
        area[(*at, k)] = t[c].to_numpy()
    size = width * height * 3
    return write_stream(spark, path, [struct.pack(HEAD, b"BM", size + HEAD_SIZE, 0, 0, HEAD_SIZE, 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0), area.tobytes()])


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """file, ix, iy, r, g, b of every pixel; raises ValueError on other kinds of pictures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, _, _, _, offset, _, width, height, _, bits, *_ = struct.unpack_from(HEAD, c)
                if kind != b"BM" or bits != 24:
                    raise ValueError("not a picture of 24 bits")
                area = np.frombuffer(c, np.uint8, width * height * 3, offset).reshape(height, width, 3)
                iy, ix = np.indices((height, width)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(ix), type=pa.string()), pa.array(ix.astype(np.int64)), pa.array(iy.astype(np.int64)), *(pa.array(area[:, :, k].ravel().astype(np.int32)) for k in range(3))], names=["file", "ix", "iy", "r", "g", "b"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, ix long, iy long, r int, g int, b int")


def palette(spark: SparkSession, path: str) -> DataFrame:
    """i (row), j (column), r, g, b of a colour map, for ``imaging.map_colours``."""
    return read_image(spark, path).select(F.col("iy").cast("int").alias("i"), F.col("ix").cast("int").alias("j"), "r", "g", "b")
