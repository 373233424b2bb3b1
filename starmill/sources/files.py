"""Byte ranges and streams of files on any file system that Spark, or on the executors Arrow, knows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Schemes that executors read and write by themselves; other files pass through Spark's reader whole, and through the driver.
DIRECT = ("", "file", "hdfs", "s3", "gs")
#: The column of the group of rows that are to be in a file of their own, and how many groups a task writes.
GROUP, GROUPS_A_TASK = "_group", 64
#: Rows of a file where nothing else says how many.
ROWS_A_FILE = 1 << 18


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files of a path, a folder or a glob, by name; hidden ones are left out."""
    p, system = _hadoop(spark, path)
    found = []
    for status in system.globStatus(p) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(str(s.getPath()), int(s.getLen())) for s in inner if s.isFile() and str(s.getPath().getName())[0] not in "._"]
    return sorted(found)


def direct(path: str) -> bool:
    return urlparse(path).scheme in DIRECT


def open_input(path: str) -> pa.NativeFile:
    """A file that can seek, on the executor."""
    system, inner = fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")
    return system.open_input_file(inner)


def read_range(path: str, offset: int, size: int) -> bytes:
    with open_input(path) as f:
        return f.read_at(size, offset)


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """file, size: a row a file, a task each up to the cluster's cores; raises FileNotFoundError if there is none."""
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    return spark.createDataFrame(files, "file string, size long").repartition(len(files))


def spread(spans: DataFrame, path: str, size: int) -> DataFrame:
    """Rows that stand for stretches of about size bytes of the files, dealt to as many partitions as there are stretches; a number, so that rows this small are not put together again."""
    total = sum(-(-n // max(size, 1)) for _, n in list_files(spans.sparkSession, path))
    return spans.repartition(max(1, min(100_000, total)))


def dealt(rows: DataFrame, group: Column, *order: str | Column) -> DataFrame:
    """rows with their group (a whole number from 0) as GROUP, a group's rows together and in order; a partition has GROUPS_A_TASK groups."""
    placed = rows.withColumn(GROUP, group.cast("int"))
    groups = placed.agg(F.coalesce(F.max(GROUP), F.lit(0))).first()[0] + 1
    each = max(1, min(GROUPS_A_TASK, groups // rows.sparkSession.sparkContext.defaultParallelism))
    part = F.floor(F.col(GROUP) / each).cast("int")
    return placed.withColumn("_part", part).repartitionById(-(-groups // each), "_part").sortWithinPartitions(GROUP, *order).drop("_part")


def spread_rows(rows: DataFrame, key: str, least: int) -> DataFrame:
    """rows dealt by a key to a partition for each ROWS_A_FILE of them, and to least at least."""
    return rows.repartition(max(least, -(-rows.count() // ROWS_A_FILE)), key)


def write_stream(spark: SparkSession, path: str, *parts: Iterable[bytes]) -> int:
    """Write the parts one after another to one file, by the driver; returns the bytes written."""
    target, system = _hadoop(spark, path)
    out = system.create(target, True)
    total = 0
    try:
        for block in chain(*parts):
            out.write(bytearray(block))
            total += len(block)
    finally:
        out.close()
    return total


def write_partitions(df: DataFrame, folder: str, name: str, encode: Callable[[pa.Table], bytes]) -> list[tuple[str, int]]:
    """A file for each partition that has rows or, of rows with GROUP, for each group, encoded and written where the partition is; returns (address, bytes) of all.

    A task writes under a name of its own in a folder of the job; the driver gives the files of the tasks that count their names and deletes the folder, so a
    repeated or lost task leaves no second copy. Only names and sizes reach the driver."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    job = f"{folder}/_temporary-{uuid.uuid4().hex}"
    p, system = _hadoop(spark, job)
    system.mkdirs(p)
    by_task = direct(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table, number = pa.Table.from_batches(whole), TaskContext.get().partitionId()
        ends = [0, table.num_rows]
        if GROUP in table.schema.names:
            group = table[GROUP].to_numpy()
            ends[1:1] = (np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()
        for place, (lo, hi) in enumerate(pairwise(ends)):
            content, at = encode(table.slice(lo, hi - lo)), f"{job}/{uuid.uuid4().hex}"
            if by_task:
                target, inner = fs.FileSystem.from_uri(at if urlparse(at).scheme else f"file://{at}")
                with target.open_output_stream(inner) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), pa.array([place], type=pa.int64()), pa.array([at]), pa.array([len(content)], type=pa.int64()), pa.array([None if by_task else content], type=pa.binary())], names=["part", "place", "file", "size", "content"])

    made = df.mapInArrow(run, "part long, place long, file string, size long, content binary")
    written = []
    try:
        # names and sizes are few; contents come a partition at a time, in the order of partitions
        for i, r in enumerate(sorted(made.drop("content").collect()) if by_task else made.toLocalIterator()):
            target = f"{folder}/{name.format(i)}"
            if by_task:
                system.rename(_hadoop(spark, r["file"])[0], _hadoop(spark, target)[0])
            else:
                write_stream(spark, target, [bytes(r["content"])])
            written.append((target, r["size"]))
    finally:
        system.delete(p, True)
    return written
