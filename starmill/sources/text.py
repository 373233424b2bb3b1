"""Text tables: particle lists, density-tool input, camera paths, profile tables, snapshot lists."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import type_of
from ..operators.cut import numbered
from ..operators.merging import relative_to
from .files import write_stream
from .views import BULGE_BASE, DARK_BASE

_NUMBERS = r"[ \t]+"


def write_lines(rows: DataFrame, folder: str, order: str, *head: str, parts: int | None = None) -> None:
    """Column value of rows as text, dealt by order to a folder of files (so many, if parts is given) whose names sort as their lines do; each begins with the lines of head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows and head:
                yield pa.RecordBatch.from_arrays([pa.array(head, b.schema.field(0).type)], schema=b.schema)
            first = first and not b.num_rows
            yield b

    dealt = rows.repartitionByRange(parts, order) if parts else rows.repartitionByRange(order)
    dealt.sortWithinPartitions(order).select("value").mapInArrow(run, "value string").write.mode("overwrite").text(folder)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, at (1-based over all files), no (1-based in its file) of the lines of a file or a folder, by name of the file; blank lines included."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    rows = numbered(spark.read.text(path).select(F.trim("value").alias("line"), *place), "file", "_block", "_at", name="at")
    first = rows.groupBy("file").agg(F.min("at").alias("_first"))
    return rows.join(first, "file").select("line", "at", (F.col("at") - F.col("_first") + 1).alias("no"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """no (its line over all files) and file names of a snapshot list, in order, blank lines skipped."""
    return _lines(spark, path).filter("line <> ''").select(F.col("at").alias("no"), F.col("line").alias("file"))


def read_ascii(spark: SparkSession, path: str, reduce: int = 1, kind: str | None = None) -> DataFrame:
    """id, mass, v, x of `mass vx vy vz x y z` lines after two header lines a file; every k-th line from the first, mass times k, ids over kept lines.

    kind (dark, bulge or disk) gives typed ids besides, as gid, and ptype."""
    rows = _lines(spark, path).filter("no > 2 AND line <> ''")
    rows = numbered(rows, "at", name="_rn").filter((F.col("_rn") - 1) % reduce == 0)
    cols = ["mass", "vx", "vy", "vz", "x", "y", "z"]
    parts = F.split("line", _NUMBERS)
    values = [parts[i].cast("double").alias(c) for i, c in enumerate(cols)]
    out = rows.select(F.floor((F.col("_rn") - 1) / reduce).cast("long").alias("id"), *values)
    out = out.withColumn("mass", F.col("mass") * float(reduce))
    if kind is None:
        return out
    base = {"dark": DARK_BASE, "bulge": BULGE_BASE, "disk": 0}[kind]
    return out.withColumn("gid", F.col("id") + F.lit(base).cast("long")).withColumn("ptype", type_of(F.col("gid")))


def read_component_numbers(spark: SparkSession, path: str) -> DataFrame:
    """halo, bulge, disk: the whole numbers of the first line; what follows is not read."""
    parts = F.split("line", _NUMBERS)
    return _lines(spark, path).filter("at = 1").select(*[parts[i].cast("long").alias(c) for i, c in enumerate(("halo", "bulge", "disk"))])


def organise(p: DataFrame, folder: str, by: str = "time", rows: int = 1_000_000) -> None:
    """Rows as Parquet, a folder for each value of by and files of at most so many rows; the rows of a value are dealt to a task for each so many of them."""
    sizes = p.groupBy(by).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    spread = p.withColumn("_spread", F.monotonically_increasing_id()).join(sizes, p[by].eqNullSafe(sizes[by])).drop(sizes[by])
    spread.withColumn("_spread", F.pmod(F.xxhash64("_spread"), "_parts")).repartition(by, "_spread").drop("_spread", "_parts").write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(by).parquet(folder)


def gather_logs(logs: DataFrame, folder: str, per: int) -> None:
    """Log lines (rank, line, text) as text, one folder for each row of per ranks, in order of rank and line."""
    rows = logs.withColumn("row", F.floor(F.col("rank") / per).cast("long"))
    rows.repartition("row").sortWithinPartitions("row", "rank", "line").select("row", "text").write.mode("overwrite").partitionBy("row").text(folder)


def read_density_input(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, h, nnb after a first line of two integers a file; ids count the other lines."""
    parts = F.split("line", _NUMBERS)
    rows = numbered(_lines(spark, path).filter("no > 1 AND line <> ''"), "at", name="_rn")
    return rows.select((F.col("_rn") - 1).alias("id"), *[parts[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "h", "nnb"))])


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """frame, tx .. rz of a camera path: a header line, then index, translation, rotation in degrees; rotations become radians with their sign turned."""
    parts = F.split("line", _NUMBERS)
    shift = [parts[1 + i].cast("double").alias(f"t{c}") for i, c in enumerate("xyz")]
    turn = [(-F.radians(parts[4 + i].cast("double"))).alias(f"r{c}") for i, c in enumerate("xyz")]
    return _lines(spark, path).filter("no > 1 AND line <> ''").select(parts[0].cast("long").alias("frame"), *shift, *turn)


def write_ascii(p: DataFrame, path: str, origin: str = "id = 0", order: str = "id") -> None:
    """`id mass vx vy vz x y z` lines, relative to the last row that satisfies origin."""
    rel = relative_to(p, origin, order)
    rel.select(F.concat_ws(" ", "id", *[F.format_string("%.9g", F.col(c).cast("double")) for c in ("mass", "vx", "vy", "vz", "x", "y", "z")]).alias("value")).write.mode("overwrite").text(path)


def write_dump(p: DataFrame, path: str) -> None:
    """`ID type m x y z vx vy vz rho h` lines, dark matter first."""
    cols = ["gid", "ptype", "mass", "x", "y", "z", "vx", "vy", "vz", "rho", "h"]
    p.orderBy(F.col("ptype") != 0, "gid").select(*cols).write.mode("overwrite").csv(path, sep=" ")


def profile_lines(profile: DataFrame) -> DataFrame:
    """The radial table as text, a line a bin and population, numbers scientific with six digits."""
    cols = [c for c in profile.columns if c not in ("pop", "bin")]
    return profile.orderBy("pop", "bin").select(F.concat_ws(" ", "pop", *[F.format_string("%.6e", F.col(c).cast("double")) for c in cols]).alias("value"))


def write_radial_table(table: DataFrame, folder: str, time: float) -> None:
    """The table of ``profiles.radial_table`` as one text file: two comment lines, then 29 numbers with six digits a bin; as many lines as there are bins, whatever the bodies."""
    cols = [c for c in table.columns if c != "bin"]
    names = [[c.split("_")[0] for c in cols if c.endswith(end) and (end or "_" not in c)] for end in ("", "_b", "_d")]
    head = [f"# T = {time:.6e} (Gyr)", "#" + " ".join(n for part in names for n in part)]
    # a number that has none (of an empty bin) is written as nan
    numbers = F.concat_ws("  ", *[F.format_string("%.6e", F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))) for c in cols])
    write_lines(table.select("bin", F.regexp_replace(numbers, "NaN", "nan").alias("value")), folder, "bin", *head, parts=1)


def snapshot_name(base: str, t: float, rank: int = 0) -> str:
    return f"{base}_{t:010.4f}-{rank}"


GRID_HEAD = "<4i6d"


def write_grid(spark: SparkSession, path: str, grids: dict[str, DataFrame], bins: int, time: float = 0.0) -> None:
    """Header -1, n, n, 1, time and five zeros, then five floats a cell: top mass and v2, front mass and v2, polar ratio (-1 outside its table).

    grids: top, front (ix, iy, mass, v2) and polar (iphi, ir, ratio); at most bins squared rows each."""
    cells = np.zeros((bins, bins, 5), "<f4")
    cells[:, :, 4] = -1
    for k, name in enumerate(("top", "front")):
        for r in grids[name].toLocalIterator():
            cells[r["iy"], r["ix"], 2 * k : 2 * k + 2] = r["mass"], r["v2"]
    cells[:20, :128, 4] = 0
    for r in grids["polar"].toLocalIterator():
        cells[r["ir"], r["iphi"], 4] = r["ratio"]
    write_stream(spark, path, [struct.pack(GRID_HEAD, -1, bins, bins, 1, time, 0, 0, 0, 0, 0), cells.tobytes()])


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """ix, iy and the five values of every cell, with the file's time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                _, nx, ny, _, time, *_ = struct.unpack_from(GRID_HEAD, c)
                cells = np.frombuffer(c, "<f4", nx * ny * 5, struct.calcsize(GRID_HEAD)).reshape(ny, nx, 5)
                iy, ix = np.indices((ny, nx)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ix), pa.array(iy), pa.array(np.full(nx * ny, time)), *(pa.array(cells[:, :, i].ravel()) for i in range(5))], names=["ix", "iy", "time", "top_mass", "top_v2", "front_mass", "front_v2", "polar"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "ix long, iy long, time double, top_mass float, top_v2 float, front_mass float, front_v2 float, polar float")
