"""Both snapshot formats as Spark data sources: ``spark.read.format("tipsy")``, ``df.write.format("columnar")``.

After ``register(spark)`` a path (a file, a folder or a glob on a file system that Arrow opens) is read in stretches of
records; a task takes short ones together and seeks to their bytes.  Only the columns of the schema that a reader is given are made, so
``.schema("gid long, x double")`` reads two of a columnar file's arrays.  Filters on time, is_dark, pos and file reach the plan of
stretches: files and populations that they rule out are never opened beyond their header.

Writers encode a partition as it comes, a file for at most ``maxRecordsPerFile`` rows (and, where rows have a group, for the rows of one), under a folder of the job; a commit gives
the files of the tasks that count their names, and deletes the folder with whatever failed or repeated tasks have left there.
"""

from __future__ import annotations

import fnmatch
import operator
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby, pairwise
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files
from .views import BULGE_BASE, DARK_BASE

STEP, RECORDS, THREADS = 1 << 20, 1 << 22, 32
#: Records and files from which a task takes no further stretch, and tasks among which fewer records are dealt.
TASK, TASK_FILES, TASKS = 1 << 16, 256, 32
#: Times beyond this are taken for 0.
LATE = 1e11
PLACED = ("time", "is_dark", "pos", "file")
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda v, among: v in among}


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def arrow_types(schema: str) -> dict[str, pa.DataType]:
    """Column -> Arrow type of a schema of plain columns."""
    return {name: _ARROW[kind] for name, kind in (c.split() for c in schema.split(", "))}


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def visible_files(path: str) -> list[tuple[str, int]]:
    """(inner path, bytes) of the files of a path, a folder or a glob, by name; hidden ones are left out."""
    system, inner = system_of(path)
    if any(c in inner for c in "*?["):
        folder, _, pattern = inner.rpartition("/")
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = [x for x in found if fnmatch.fnmatchcase(x.base_name, pattern)]
    else:
        info = system.get_file_info(inner)
        found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")


@dataclass
class Stretch:
    """Rows lo to hi (from 0) of one population of a file."""

    path: str
    head: object
    dark: bool
    lo: int
    hi: int
    first: int


@dataclass
class Task(InputPartition):
    """Stretches that are read one after another."""

    stretches: list[Stretch]


def bundled(stretches: list[Stretch]) -> list[Task]:
    """Stretches in tasks of at most about TASK records and TASK_FILES files, however short the stretches and files are."""
    most = min(TASK, -(-sum(s.hi - s.lo for s in stretches) // TASKS))
    found, rows, files = [], 0, 0
    for s in stretches:
        if not found or rows + s.hi - s.lo > most or (files == TASK_FILES and s.path != found[-1].stretches[-1].path):
            found.append(Task([]))
            rows = files = 0
        files += not found[-1].stretches or s.path != found[-1].stretches[-1].path
        rows += s.hi - s.lo
        found[-1].stretches.append(s)
    return found


class SnapshotReader(DataSourceReader):
    """Plans stretches of files whose headers are read side by side; formats say what a header holds and how rows are read."""

    def __init__(self, options: dict, schema: StructType, form):
        self.root, self.form, self.names = options["path"], form, schema.names
        self.step = int(options.get("step", STEP))
        self.every = {dark: int(options.get("reduce", 1)) * int(options.get(kind, 1)) for dark, kind in ((True, "reduce_dark"), (False, "reduce_star"))}
        self.scale = options.get("scale_mass", "true").lower() == "true"
        self.held: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Filters on where a row stands are settled here: wholly by the plan for time, is_dark and file, by rows for pos."""
        rest = []
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _COMPARE and name in PLACED:
                self.held.append((name, type(f), f.value))
            else:
                rest.append(f)
        return rest

    def _keeps(self, name: str, value: object) -> bool:
        return all(_COMPARE[kind](value, wanted) for n, kind, wanted in self.held if n == name)

    def partitions(self) -> list[Task]:
        return bundled(self.stretches()) or [Task([])]

    def stretches(self) -> list[Stretch]:
        files = [(p, n) for p, n in visible_files(self.root)]
        if not files:
            raise FileNotFoundError(self.root)
        system, _ = system_of(self.root)
        with ThreadPoolExecutor(THREADS) as pool:
            heads = list(pool.map(lambda f: self.form.head(system, f[0]), files))
        # all positions that a filter allows lie between these
        low = max([0, *(v + (k is GreaterThan) for n, k, v in self.held if n == "pos" and k in (EqualTo, GreaterThan, GreaterThanOrEqual))])
        high = min([1 << 62, *(v - (k is LessThan) for n, k, v in self.held if n == "pos" and k in (EqualTo, LessThan, LessThanOrEqual))])
        found = []
        for (path, _), head in zip(files, heads, strict=True):
            if self._keeps("time", self.form.time(head)) and self._keeps("file", path):
                for dark, rows, first in self.form.populations(head):
                    if self.every[dark] and self._keeps("is_dark", dark):
                        lo, hi = max(0, low - first), min(rows, high - first + 1)
                        found += [Stretch(path, head, dark, a, min(a + self.step, hi), first) for a in range(lo, hi, self.step)]
        return found

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        system, _ = system_of(self.root)
        for path, held in groupby(partition.stretches, lambda s: s.path):
            with system.open_input_file(path) as f:
                for s in held:
                    yield self.rows_of(f, s)

    def rows_of(self, f: pa.NativeFile, partition: Stretch) -> pa.RecordBatch:
        """The rows of a stretch of an open file."""
        columns = self.form.read(f, partition, set(self.names)) | {"time": self.form.time(partition.head), "is_dark": partition.dark, "file": partition.path}
        pos = columns["pos"] = np.arange(partition.first + partition.lo, partition.first + partition.hi)
        keep = np.ones(len(pos), dtype=bool)
        if (every := self.every[partition.dark]) > 1:
            keep &= pos % every == 0
            if self.scale and columns.get("mass") is not None:
                columns["mass"] = columns["mass"] * float(every)
        for name, kind, wanted in self.held:
            if name == "pos":
                keep &= np.isin(pos, wanted) if kind is In else _COMPARE[kind](pos, wanted)
        whole = bool(keep.all())
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([_column(columns.get(c), keep, whole, n, self.form.types[c]) for c in self.names], names=self.names)


def _column(value: object, keep: np.ndarray, whole: bool, n: int, kind: pa.DataType) -> pa.Array:
    """An array of a column: NULL where a file lacks it, one value for all rows, or rows of an array."""
    if not isinstance(value, np.ndarray):
        return pa.repeat(pa.scalar(value, kind), n) if value is not None else pa.nulls(n, kind)
    return pa.array(value if whole else value[keep]).cast(kind)


def _by_group(rows: pa.RecordBatch) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """(group, rows) of each stretch of rows of one group; all of them where rows have none."""
    if not rows.num_rows:
        return
    if files.GROUP not in rows.schema.names:
        yield None, rows
        return
    group = rows[files.GROUP].to_numpy()
    ends = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), rows.num_rows]
    for lo, hi in pairwise(ends):
        yield int(group[lo]), rows.slice(lo, hi - lo)


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, int]]


class SnapshotWriter(DataSourceArrowWriter):
    """Files of encoded rows under a folder of the job, named by the commit."""

    def __init__(self, options: dict, overwrite: bool, form):
        self.root, self.form, self.overwrite = options["path"].rstrip("/"), form, overwrite
        self.options = {k: options[k] for k in ("time", "version") if k in options}
        self.records = int(options.get("maxRecordsPerFile", RECORDS))
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = system_of(self.root)
        folder, part = f"{inner}/{self.job}", TaskContext.get().partitionId()
        system.create_dir(folder)
        files: list[tuple[str, int]] = []
        held, rows = [], 0

        def flush() -> None:
            content = self.form.encode(list(zip(*held, strict=True)), self.options)
            at = f"{folder}/{part:05d}-{len(files):05d}-{uuid.uuid4().hex}"
            size = 0
            with system.open_output_stream(at) as out:
                for block in content:
                    out.write(block)
                    size += len(block)
            files.append((at, size))

        group = None
        for whole in iterator:
            for of, batch in _by_group(whole):
                if held and of != group:
                    flush()
                    held, rows = [], 0
                group = of
                for lo in range(0, batch.num_rows, self.records):
                    piece = batch.slice(lo, self.records)
                    if held and rows + piece.num_rows > self.records:
                        flush()
                        held, rows = [], 0
                    # encoded at once, so that a task holds its records as they go to the file and no table beside them
                    held.append(self.form.blocks(piece, self.options))
                    rows += piece.num_rows
        if rows:
            flush()
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = system_of(self.root)
        old = [p for p, _ in visible_files(self.root)]
        if self.overwrite:
            for p in old:
                system.delete_file(p)
            old = []
        taken, number, moves = set(old), len(old), []
        for _, at in sorted((m.part, at) for m in messages if m for at, _ in m.files):
            while (target := f"{inner}/part-{number:05d}{self.form.suffix}") in taken:
                number += 1
            taken.add(target)
            moves.append((at, target))
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda m: system.move(*m), moves))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the job's folder stays."""
        system, inner = system_of(self.root)
        if system.get_file_info(f"{inner}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.job}")


def base_of(gid: np.ndarray) -> np.ndarray:
    """What a typed id's range starts with."""
    return np.where(gid >= DARK_BASE, DARK_BASE, np.where(gid >= BULGE_BASE, BULGE_BASE, 0))


def kind_of(gid: np.ndarray) -> np.ndarray:
    """0 dark matter, 1 bulge, 2 disk by the range the id lies in; 3 for negative ids."""
    return np.select([gid >= DARK_BASE, gid >= BULGE_BASE, gid >= 0], [0, 1, 2], 3).astype(np.int32)


class SnapshotSource(DataSource):
    """A format's class says its columns and how its bytes are read and written. A stream has the number of the frame besides."""

    form = None

    @classmethod
    def name(cls) -> str:
        return cls.form.label

    def schema(self) -> str:
        return self.form.schema

    def reader(self, schema: StructType) -> SnapshotReader:
        odd = [f.name for f in schema if f.name not in self.form.types]
        if odd:
            raise ValueError(f"a {self.form.label} snapshot has no columns {odd}")
        return SnapshotReader(self.options, schema, self.form)

    def streamReader(self, schema: StructType) -> ReplayReader:
        self.reader(StructType([f for f in schema if f.name != "frame"]))
        return ReplayReader(self.options, schema, self.form)

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        missing = [c for c in self.form.wanted if c not in schema.names]
        if missing:
            raise ValueError(f"a {self.form.label} snapshot needs columns {missing}")
        return SnapshotWriter(self.options, overwrite, self.form)


@dataclass
class Shown(InputPartition):
    """Stretches of the file that a frame shows."""

    frame: int
    task: Task


class ReplayReader(DataSourceStreamReader):
    """Snapshots shown one after the other, over and over: an offset is a number of frames.

    loop: how often the files are gone through; delay: milliseconds from a frame to the next, all at once without one; reduce_dark and reduce_star: every so manieth row of a kind, none for 0.
    Frames appear as time goes by from start (seconds of the epoch; a query that is to go on after a restart gives it)."""

    def __init__(self, options: dict, schema: StructType, form):
        self.inner = SnapshotReader(options, StructType([f for f in schema if f.name != "frame"]), form)
        self.names = schema.names
        self.delay = float(options.get("delay", 0)) / 1000
        self.start = float(options.get("start", time.time()))
        by: dict[str, list[Stretch]] = {}
        for s in self.inner.stretches():
            by.setdefault(s.path, []).append(s)
        # a snapshot without rows of a wanted kind is a frame without rows
        self.files = [by.get(p, []) for p, _ in visible_files(options["path"])]
        self.frames = int(options.get("loop", 1)) * len(self.files)

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        shown = self.frames if not self.delay else int(max(0.0, time.time() - self.start) / self.delay) + 1
        return {"frames": min(self.frames, shown)}

    def partitions(self, start: dict, end: dict) -> list[Shown]:
        found = [Shown(f, t) for f in range(start["frames"], end["frames"]) for t in bundled(self.files[f % len(self.files)])]
        return found or [Shown(0, Task([]))]

    def read(self, partition: Shown) -> Iterator[pa.RecordBatch]:
        for batch in self.inner.read(partition.task):
            frame = pa.repeat(pa.scalar(partition.frame, pa.int64()), batch.num_rows)
            yield pa.RecordBatch.from_arrays([frame if n == "frame" else batch[n] for n in self.names], names=self.names)


def load(spark: SparkSession, path: str, form, **options) -> DataFrame:
    """The files of a path in a format; raises FileNotFoundError if there is none."""
    if not files.list_files(spark, path):
        raise FileNotFoundError(path)
    register(spark)
    return spark.read.format(form.label).options(**options).load(path)


def write_parts(rows: DataFrame, folder: str, form, options: dict[str, str]) -> list[tuple[str, int]]:
    """Write rows in a format, a file for each partition or, of rows that ``files.dealt`` has grouped, for each group; returns (address, bytes) of the folder's files."""
    spark = rows.sparkSession
    if files.direct(folder):
        register(spark)
        rows.write.format(form.label).options(**options).mode("append").save(folder)
        return files.list_files(spark, folder)

    def content(t: pa.Table) -> bytes:
        return b"".join(form.encode(list(zip(*(form.blocks(b, options) for b in t.to_batches()), strict=True)), options))

    return files.write_partitions(rows, folder, f"part-{{:05d}}{form.suffix}", content)


def register(spark: SparkSession) -> None:
    """Make the formats tipsy and columnar known to a session, and let filters reach them."""
    from . import columnar, tipsy

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (tipsy.TipsySource, columnar.ColumnarSource):
        spark.dataSource.register(source)
