"""Tipsy snapshots: a 32-byte header, dark records, then star records; ids of 64 bits (version 2) or 32 (others)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cut import numbered
from ..operators.sampling import sample_every
from . import files
from .files import write_stream
from .snapshots import LATE, SnapshotSource, Stretch, arrow_types, kind_of, load, write_parts
from .views import BULGE_BASE, DARK_BASE

HEADER = np.dtype([("time", "<f8"), ("n", "<i4"), ("ndim", "<i4"), ("nsph", "<i4"), ("ndark", "<i4"), ("nstar", "<i4"), ("version", "<i4")])
_COMMON = [("mass", "<f4"), ("pos", "<f4", 3), ("vel", "<f4", 3)]
DARK_RECORD = np.dtype([*_COMMON, ("id", "<u8")])
STAR_RECORD = np.dtype([*_COMMON, ("metals", "<f4"), ("tform", "<f4"), ("id", "<u8")])
FAR, STEP = -1e11, 1 << 20
#: Bulge ids of old files begin here.
V1_BULGE = 100_000_000
SCHEMA = "gid long, ptype int, x double, y double, z double, vx double, vy double, vz double, mass double, time double, is_dark boolean, file string, pos long"


def parse_header(content: bytes) -> np.void:
    """The header; raises ValueError if the counts do not fit."""
    head = np.frombuffer(content, HEADER, 1)[0]
    if head["nsph"] != 0 or head["n"] != head["ndark"] + head["nstar"]:
        raise ValueError("gas records or inconsistent counts in a snapshot header")
    return head


class Tipsy:
    """How the files are read and written: a header, dark records, star records."""

    label, suffix, schema = "tipsy", ".tipsy", SCHEMA
    types = arrow_types(SCHEMA)
    wanted = ("gid", "ptype", "mass", "x", "y", "z", "vx", "vy", "vz")

    @staticmethod
    def head(system, path: str) -> bytes:
        with system.open_input_file(path) as f:
            head = f.read_at(HEADER.itemsize, 0)
        parse_header(head)
        return head

    @staticmethod
    def time(head: bytes) -> float:
        t = float(parse_header(head)["time"])
        return 0.0 if abs(t) > LATE else t

    @staticmethod
    def populations(head: bytes) -> list[tuple[bool, int, int]]:
        """(dark, rows, position in the file from 1) of each kind."""
        h = parse_header(head)
        return [(True, int(h["ndark"]), 1), (False, int(h["nstar"]), 1 + int(h["ndark"]))]

    @staticmethod
    def read(f, part: Stretch, names: set[str]) -> dict:
        record = DARK_RECORD if part.dark else STAR_RECORD
        at = HEADER.itemsize + (0 if part.dark else int(parse_header(part.head)["ndark"]) * DARK_RECORD.itemsize) + part.lo * record.itemsize
        raw = f.read_at((part.hi - part.lo) * record.itemsize, at)
        if len(raw) != (part.hi - part.lo) * record.itemsize:
            raise ValueError(f"{part.path} ends before its last record")
        return Tipsy.columns(np.frombuffer(raw, record), part.head, part.dark, names)

    @staticmethod
    def columns(rows: np.ndarray, head: bytes, dark: bool, names: set[str]) -> dict:
        """The named columns of records."""
        found = {"mass": rows["mass"].astype(float)} if "mass" in names else {}
        found |= {f"{v}{c}": rows[kind][:, i].astype(float) for v, kind in (("", "pos"), ("v", "vel")) for i, c in enumerate("xyz") if f"{v}{c}" in names}
        if names & {"gid", "ptype"}:
            gid = rows["id"].astype(np.int64)
            if parse_header(head)["version"] != 2:  # the second of the two words; kinds by the older ranges
                old = (rows["id"] >> np.uint64(32)).astype(np.int64)
                gid = old + (DARK_BASE if dark else np.where(old >= V1_BULGE, BULGE_BASE, 0))
            found |= {"gid": gid, "ptype": kind_of(gid)}
        return found

    @staticmethod
    def blocks(batch: pa.RecordBatch, options: dict) -> tuple[np.ndarray, np.ndarray]:
        """Dark and star records of some rows."""
        star = batch["ptype"].to_numpy(zero_copy_only=False) != 0
        found = []
        for ok, record in ((~star, DARK_RECORD), (star, STAR_RECORD)):
            block = np.zeros(int(ok.sum()), record)
            raw = batch["gid"].to_numpy(zero_copy_only=False)[ok].astype(np.int64).view(np.uint64)
            block["id"] = raw if int(options.get("version", 2)) == 2 else raw << np.uint64(32)
            block["mass"] = batch["mass"].to_numpy(zero_copy_only=False)[ok]
            for i, c in enumerate("xyz"):
                block["pos"][:, i], block["vel"][:, i] = (batch[n].to_numpy(zero_copy_only=False)[ok] for n in (c, f"v{c}"))
            found.append(block)
        return tuple(found)

    @staticmethod
    def encode(groups: list[tuple[np.ndarray, ...]], options: dict) -> Iterator[bytes]:
        """One file of blocks of dark and of star records."""
        head = np.zeros(1, HEADER)
        head["time"], head["ndim"], head["version"] = float(options.get("time", 0.0)), 3, int(options.get("version", 2))
        head["ndark"], head["nstar"] = (sum(map(len, g)) for g in groups)
        head["n"] = head["ndark"] + head["nstar"]
        yield head.tobytes()
        for g in groups:
            yield from (b.tobytes() for b in g if len(b))


class TipsySource(SnapshotSource):
    form = Tipsy


def _records(spark: SparkSession, path: str, step: int) -> DataFrame:
    """All records of all files. Where executors can seek, a task reads a stretch of records, whatever the size of the file."""
    if files.direct(path):
        return load(spark, path, Tipsy, step=step)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = content[: HEADER.itemsize]
                for dark, n, first in Tipsy.populations(head):
                    for lo in range(0, n, step):
                        part = Stretch(p, head, dark, lo, min(n, lo + step), first)
                        found = Tipsy.read(pa.BufferReader(content), part, set(Tipsy.types)) | {"time": Tipsy.time(head), "is_dark": dark, "file": p, "pos": np.arange(first + lo, first + part.hi)}
                        yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v := found[c], np.ndarray) else pa.repeat(pa.scalar(v, t), part.hi - lo) for c, t in Tipsy.types.items()], names=list(Tipsy.types))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, SCHEMA)


def read_tipsy(spark: SparkSession, path: str, reduce: int = 1, reduce_dark: int | None = None, reduce_star: int | None = None, step: int = STEP) -> DataFrame:
    """gid, ptype, x .. vz, mass, time of one file, a folder or a glob; tasks read stretches of at most step records.

    Rows with z below -1e11 are dropped, and absurd times are 0. reduce: every k-th row by file position, mass times k; reduce_dark and reduce_star count each kind apart and 0 drops the kind."""
    rows = _records(spark, path, step).filter(F.col("z") >= FAR)
    if reduce > 1:
        rows = rows.filter(F.col("pos") % reduce == 0).withColumn("mass", F.col("mass") * float(reduce))
    if reduce_dark is not None or reduce_star is not None:
        kinds = [sample_every(rows.filter(F.col("is_dark") == dark).withColumn("_o", F.struct("file", "pos")), 1 if k is None else k, "_o") for dark, k in ((True, reduce_dark), (False, reduce_star))]
        rows = kinds[0].unionByName(kinds[1]).drop("_o")
    return rows.select("gid", "ptype", "x", "y", "z", "vx", "vy", "vz", "mass", "time")


def count_tipsy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each kind over all files, by their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                counts = Tipsy.populations(files.read_range(p, 0, HEADER.itemsize))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in counts]), pa.array([n for _, n, _ in counts], pa.int64())], names=["is_dark", "n"])

    if files.direct(path):
        rows = files.file_table(spark, path).select("file").mapInArrow(run, "is_dark boolean, n long")
    else:
        rows = _records(spark, path, STEP).select("is_dark", F.lit(1).cast("long").alias("n"))
    return rows.groupBy("is_dark").agg(F.sum("n").alias("n")).filter("n > 0")


def write_tipsy_parts(p: DataFrame, folder: str, time: float = 0.0, version: int = 2) -> list[tuple[str, int]]:
    """A file for each partition or group (``files.dealt``), written by its task; returns names and sizes of the folder's files. Version 1 keeps ids (gid) of 32 bits in the older place."""
    return write_parts(p.select(*Tipsy.wanted, *[c for c in (files.GROUP,) if c in p.columns]), folder, Tipsy, {"time": str(time), "version": str(version)})


def write_tipsy(p: DataFrame, path: str, time: float = 0.0) -> None:
    """One version 2 file: dark rows, then star rows, each by id (gid). Partitions are encoded on the executors and appended in order."""
    rows = p.withColumn("_star", (F.col("ptype") != 0).cast("int")).select("_star", "gid", "mass", "x", "y", "z", "vx", "vy", "vz")
    counts = dict(rows.groupBy("_star").count().collect())
    head = np.zeros(1, HEADER)
    head["time"], head["ndim"], head["version"] = time, 3, 2
    head["ndark"], head["nstar"] = counts.get(0, 0), counts.get(1, 0)
    head["n"] = sum(counts.values())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            star = b.column(0).to_numpy()
            out, keys = [], []
            for kind, record in ((0, DARK_RECORD), (1, STAR_RECORD)):
                ok = np.flatnonzero(star == kind)
                if len(ok):
                    block = np.zeros(len(ok), record)
                    block["id"] = b.column(1).to_numpy()[ok].view(np.uint64)
                    block["mass"] = b.column(2).to_numpy()[ok]
                    for i in range(3):
                        block["pos"][:, i] = b.column(3 + i).to_numpy()[ok]
                        block["vel"][:, i] = b.column(6 + i).to_numpy()[ok]
                    out.append(block.tobytes())
                    keys.append(int(b.column(9).to_numpy()[ok[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(out, type=pa.binary())], names=["at", "block"])

    blocks = numbered(rows, "_star", "gid").select("_star", "gid", "mass", "x", "y", "z", "vx", "vy", "vz", "rn").repartitionByRange("rn").sortWithinPartitions("rn").mapInArrow(encode, "at long, block binary")
    write_stream(p.sparkSession, path, [head.tobytes()], (r["block"] for r in blocks.orderBy("at").toLocalIterator()))
