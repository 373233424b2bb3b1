"""Self-describing columnar snapshots: named arrays with row counts per writer, the header at the end and its place in the first eight bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import ids
from . import files
from .snapshots import LATE, SnapshotReader, SnapshotSource, Stretch, arrow_types, base_of, load, write_parts

INFO = struct.Struct("<256sQqi4x")
VERSION = b"V2".ljust(16, b"\0")
STEP = 1 << 20
#: Fields of a population and what they hold.
FIELDS = {"IDType": ("<u8", 1), "POS:real4": ("<f4", 4), "VEL:float[3]": ("<f4", 3), "RHOH:float[2]": ("<f4", 2)}


def fields(content: bytes) -> tuple[float, dict[str, tuple[int, int, int]]]:
    """(time, name -> (element size, offset, writers))."""
    at = struct.unpack_from("<q", content)[0]
    version = content[at : at + 16].rstrip(b"\0")
    n = struct.unpack_from("<i", content, at + 16)[0]
    at += 20
    found = {}
    for _ in range(n):
        name, size, offset, ranks = INFO.unpack_from(content, at)
        found[name.rstrip(b"\0").decode()] = (size, offset, ranks)
        at += INFO.size
    return struct.unpack_from("<f" if version == b"V1" else "<d", content, at)[0], found


def encode(arrays: dict[str, np.ndarray], time: float) -> bytes:
    """One file; raises ValueError on a repeated name (names are compared without their case)."""
    if len({k.lower() for k in arrays}) < len(arrays):
        raise ValueError("field names must differ")
    body, infos, at = [], [], 8
    for name, a in arrays.items():
        raw = struct.pack("<q", len(a)) + np.ascontiguousarray(a).tobytes()
        infos.append(INFO.pack(name.encode(), a.itemsize * (a.shape[1] if a.ndim > 1 else 1), at, 1))
        body.append(raw)
        at += len(raw)
    return struct.pack("<q", at) + b"".join(body) + VERSION + struct.pack("<i", len(infos)) + b"".join(infos) + struct.pack("<d", time)


def list_fields(spark: SparkSession, path: str) -> DataFrame:
    """file, name, element_size, rows of every field; of each file only the ends and the counts are read where executors can seek."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())

    def table(path: str, f: pa.NativeFile) -> pa.RecordBatch:
        rows = [(path, k, info[0], _row_counts(f, info)) for k, info in header_of(f)[1].items()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=t) for i, t in enumerate(kinds)], names=["file", "name", "element_size", "rows"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with files.open_input(p) as f:
                    yield table(p, f)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield table(p, pa.BufferReader(c))

    schema = "file string, name string, element_size long, rows long"
    if files.direct(path):
        return files.file_table(spark, path).select("file").mapInArrow(seek, schema)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, schema)


def header_of(f: pa.NativeFile) -> tuple[float, dict[str, tuple[int, int, int]]]:
    """``fields`` of an open file, reading its first bytes and its end only."""
    at = struct.unpack("<q", f.read_at(8, 0))[0]
    return fields(struct.pack("<q", 8) + f.read_at(f.size() - at, at))


def header(path: str) -> tuple[float, dict[str, tuple[int, int, int]]]:
    with files.open_input(path) as f:
        return header_of(f)


def _row_counts(f: pa.NativeFile, info: tuple[int, int, int]) -> int:
    return int(np.frombuffer(f.read_at(8 * info[2], info[1]), "<i8").sum())


SCHEMA = "gid long, ptype int, x double, y double, z double, vx double, vy double, vz double, mass double, rho double, h double, time double, is_dark boolean, file string, pos long"
#: Where a column stands: its field and its place in it.
PLACES = {"gid": ("IDType", 0), "ptype": ("IDType", 0), **{c: ("POS:real4", i) for i, c in enumerate(("x", "y", "z", "mass"))}, **{c: ("VEL:float[3]", i) for i, c in enumerate(("vx", "vy", "vz"))}, "rho": ("RHOH:float[2]", 0), "h": ("RHOH:float[2]", 1)}
PREFIXES = (("DM:", True), ("Stars:", False))


class Columnar:
    """How the files are read and written: a named array for each field of each population. pos counts the rows of a population from 0."""

    label, suffix, schema = "columnar", ".snap", SCHEMA
    types = arrow_types(SCHEMA)
    wanted = ("gid", "ptype", "x", "y", "z", "vx", "vy", "vz", "mass")

    @staticmethod
    def head(system, path: str) -> tuple:
        with system.open_input_file(path) as f:
            return Columnar.head_of(f)

    @staticmethod
    def head_of(f: pa.NativeFile) -> tuple:
        """(time, fields, rows of each population)."""
        time, found = header_of(f)
        return time, found, {dark: _row_counts(f, found[p + "IDType"]) for p, dark in PREFIXES if p + "IDType" in found}

    @staticmethod
    def time(head: tuple) -> float:
        return 0.0 if abs(head[0]) > LATE else head[0]

    @staticmethod
    def populations(head: tuple) -> list[tuple[bool, int, int]]:
        return [(dark, n, 0) for dark, n in head[2].items()]

    @staticmethod
    def read(f, part: Stretch, names: set[str]) -> dict:
        """The named columns; only their arrays are read, and one that is missing or of another size gives none."""
        prefix, arrays, found = next(p for p, dark in PREFIXES if dark == part.dark), {}, {}
        for c in names & set(PLACES):
            field, i = PLACES[c]
            kind, width = FIELDS[field]
            info = part.head[1].get(prefix + field)
            if info is None or info[0] != np.dtype(kind).itemsize * width:
                continue
            if field not in arrays:
                arrays[field] = np.frombuffer(f.read_at((part.hi - part.lo) * info[0], info[1] + 8 * info[2] + part.lo * info[0]), kind).reshape(-1, width)
                if len(arrays[field]) != part.hi - part.lo:
                    raise ValueError(f"{part.path} ends before its last row")
            found[c] = arrays[field][:, i]
            if field == "IDType":
                found[c] = KIND_BASE[np.minimum(found[c] >> np.uint64(ids.ID_BITS), 3)] + (found[c] & np.uint64((1 << ids.ID_BITS) - 1)).astype(np.int64) if c == "gid" else (found[c] >> np.uint64(ids.ID_BITS)).astype(np.int32)
        return found

    @staticmethod
    def blocks(batch: pa.RecordBatch, options: dict) -> tuple[np.ndarray, ...]:
        """The arrays of both populations of some rows."""
        n = batch.num_rows
        col = lambda c: batch[c].to_numpy(zero_copy_only=False) if c in batch.schema.names else np.zeros(n)
        kind, gid = col("ptype").astype(np.int64), col("gid").astype(np.int64)
        packed = (kind << ids.ID_BITS) | ((gid - base_of(gid)) & ((1 << ids.ID_BITS) - 1))
        pos, vel, rho = (np.column_stack([col(c) for c in names]).astype("<f4") for names in (("x", "y", "z", "mass"), ("vx", "vy", "vz"), ("rho", "h")))
        return tuple(a[ok] for ok in (kind == 0, kind != 0) for a in (packed.view("<u8"), pos, vel, rho))

    @staticmethod
    def encode(groups: list[tuple[np.ndarray, ...]], options: dict) -> Iterator[bytes]:
        names = [p + f for p, _ in PREFIXES for f in FIELDS]
        yield encode({n: np.concatenate(g) for n, g in zip(names, groups, strict=True)}, float(options.get("time", 0.0)))


class ColumnarSource(SnapshotSource):
    form = Columnar


#: What an id's range starts with, by kind.
KIND_BASE = np.array([ids.DARK_BASE, ids.BULGE_BASE, 0, 0], dtype=np.int64)


def read_columnar(spark: SparkSession, path: str, reduce: int = 1, reduce_dark: int = 1, reduce_star: int = 1, scale_mass: bool = True, step: int = STEP) -> DataFrame:
    """gid, ptype, x .. vz, mass, rho, h, time of both populations; fields that are missing or of another size give NULL.

    Rows 0, k, 2 k ... of each population of a file are kept (0 drops it); their mass is scaled by k unless scale_mass is False. Where executors
    can seek, a task reads step rows of each field that is wanted, however large the file and however many writers it had."""
    names = [n for n in Columnar.types if n not in ("is_dark", "file", "pos")]
    options = {"reduce": reduce, "reduce_dark": reduce_dark, "reduce_star": reduce_star, "scale_mass": str(scale_mass), "step": step}
    if files.direct(path):
        return load(spark, path, Columnar, **options).select(*names)
    reader = SnapshotReader({"path": path} | {k: str(v) for k, v in options.items()}, StructType.fromDDL(SCHEMA), Columnar)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = Columnar.head_of(pa.BufferReader(c))
                for dark, n, first in Columnar.populations(head):
                    if reader.every[dark]:
                        for lo in range(0, n, step):
                            yield reader.rows_of(pa.BufferReader(c), Stretch(p, head, dark, lo, min(n, lo + step), first))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, SCHEMA).select(*names)


def write_columnar(p: DataFrame, path: str, time: float = 0.0) -> list[tuple[str, int]]:
    """A folder of files, one for each partition or group (``files.dealt``) and written by its task, each with the dark and star populations of its rows; returns names and sizes of the folder's files."""
    return write_parts(p.select(*Columnar.wanted, *[c for c in ("rho", "h", files.GROUP) if c in p.columns]), path, Columnar, {"time": str(time)})


#: A body of a gas dump, packed.
GAS = np.dtype([*[(n, "<f8") for n in ("x", "y", "z", "am", "hp", "rho", "vx", "vy", "vz", "vxdot", "vydot", "vzdot", "u", "udot", "grpot", "mmu")], ("cc", "<i4"), ("divv", "<f8")])
GAS_FIELD = "SPH:data:"


def read_gas(spark: SparkSession, path: str, reduce: int = 1, step: int = STEP) -> DataFrame:
    """file, row, packed id (row number of the kept rows, type 1), x, y, z, speed, rho, h of the gas bodies of dump files, whatever their type is called; every reduce-th row from the first."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with files.open_input(p) as f:
                    info = next((i for name, i in header_of(f)[1].items() if name.startswith(GAS_FIELD)), None)
                    if info is None or info[0] != GAS.itemsize:
                        raise ValueError(f"{p} holds no gas bodies")
                    n = _row_counts(f, info)
                lows = list(range(0, n, step))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(lows), type=pa.string()), pa.array(lows, type=pa.int64()), pa.array([min(a + step, n) for a in lows], type=pa.int64()), pa.array([info[1] + 8 * info[2]] * len(lows), type=pa.int64())], names=["file", "lo", "hi", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lo = r["lo"] + -r["lo"] % reduce
                rows = np.frombuffer(files.read_range(r["file"], r["base"] + lo * GAS.itemsize, max(0, r["hi"] - lo) * GAS.itemsize), GAS)[::reduce]
                speed = np.sqrt(rows["vx"] ** 2 + rows["vy"] ** 2 + rows["vz"] ** 2)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(rows), type=pa.string()), pa.array(lo // reduce + np.arange(len(rows))), *(pa.array(rows[c].copy()) for c in "xyz"), pa.array(speed), pa.array(rows["rho"].copy()), pa.array(rows["hp"].copy())], names=["file", "row", "x", "y", "z", "speed", "rho", "h"])

    spans = files.file_table(spark, path).select("file").mapInArrow(plan, "file string, lo long, hi long, base long")
    rows = files.spread(spans, path, step * GAS.itemsize).mapInArrow(run, "file string, row long, x double, y double, z double, speed double, rho double, h double")
    return rows.withColumn("packed", ids.pack(F.lit(1), F.col("row")))
