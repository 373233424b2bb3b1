"""Cutting lineage through the shared checkpoint folder, and global row numbers without a single sorting task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where none is set and one machine does everything.

    Raises RuntimeError on a cluster without one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="starmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """df with a 1-based row number in the given order.

    Rows are dealt by range and numbered within their partition; the sizes of earlier partitions (one row each) are added."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


#: Bits of the row number below a block, a block of blocks and a block of those; the topmost sum sees one row for 2**40.
LEVELS = (16, 28, 40)


def running_sum(df: DataFrame, value: str, name: str, rn: str = "rn") -> DataFrame:
    """df with the sum of value over all rows of number up to its own.

    A tree of sums: blocks of rows, blocks of blocks and blocks of those; what lies before a block is what lies before its parent and its elder siblings."""
    at = lambda bits: F.shiftright(F.col(rn).cast("long") - 1, bits)
    blocked = df.withColumn("_k0", at(LEVELS[0]))
    sums, down = [blocked.groupBy("_k0").agg(F.sum(value).alias("_s"))], None
    for i in range(1, len(LEVELS)):
        sums[-1] = sums[-1].withColumn(f"_k{i}", F.shiftright(f"_k{i - 1}", LEVELS[i] - LEVELS[i - 1]))
        sums.append(sums[-1].groupBy(f"_k{i}").agg(F.sum("_s").alias("_s")))
    for i in reversed(range(len(LEVELS))):
        parent = [f"_k{i + 1}"] if down is not None else []
        elder = (Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))).orderBy(f"_k{i}").rowsBetween(Window.unboundedPreceding, -1)
        level = sums[i].withColumn("_e", F.coalesce(F.sum("_s").over(elder), F.lit(0))).drop("_s")
        level = level.join(down, parent[0]) if parent else level.withColumn("_b", F.lit(0))
        down = level.select(f"_k{i}", (F.col("_b") + F.col("_e")).alias("_b"))
    inner = Window.partitionBy("_k0").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(down, "_k0").withColumn(name, F.col("_b") + F.sum(value).over(inner)).drop("_k0", "_b")
