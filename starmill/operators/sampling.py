"""Systematic sampling, compaction, splits and scans over numbered rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.physics import hash31
from .cut import numbered, running_sum


def sample_every(p: DataFrame, k: int, order: str = "id", scale_mass: bool = True, by: str | None = None, phase: int = 0) -> DataFrame:
    """Every k-th row in the given order, with mass times k; by: counted for each value apart. phase 0 keeps rows k, 2k, ...; 1 keeps 1, k + 1, ...

    k = 0 drops everything."""
    if k == 0:
        return p.limit(0)
    if by:
        # numbers within a value are global numbers less those before it, so a frequent value is not one task's work
        rows = numbered(p, by, order, name="_n")
        first = rows.groupBy(by).agg(F.min("_n").alias("_first"))
        rows = rows.join(F.broadcast(first) if first.limit(10_001).count() <= 10_000 else first, by).withColumn("_rn", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")
    else:
        rows = numbered(p, order, name="_rn")
    kept = rows.filter((F.col("_rn") - phase) % k == 0).drop("_rn")
    return kept.withColumn("mass", F.col("mass") * float(k)) if scale_mass else kept


def quick_dump(p: DataFrame, ratio: float, order: str = "id") -> DataFrame:
    """The rows of a quick output: positions 0, dn, 2 dn ... with dn = floor(1 / ratio); masses unchanged."""
    return sample_every(p, max(1, math.floor(1.0 / ratio)), order, scale_mass=False, phase=1)


def sample_stride(p: DataFrame, stride: float, order: str = "id") -> DataFrame:
    """One row each time the row number passes a multiple of a real stride."""
    rows = numbered(p, order, name="_rn")
    return rows.filter(F.floor(F.col("_rn") / stride) != F.floor((F.col("_rn") - 1) / stride)).drop("_rn")


def compacted(p: DataFrame, flag: str, order: str = "id") -> DataFrame:
    """Flagged rows in order, numbered from 1."""
    return numbered(p.filter(flag), order, name="pos")


def split(p: DataFrame, flag: str, order: str = "id") -> DataFrame:
    """All rows numbered from 1: the flagged first, then the others, each in order."""
    return numbered(p.withColumn("_last", F.when(F.expr(flag), 0).otherwise(1)), "_last", order, name="pos").drop("_last")


def exclusive_scan(p: DataFrame, value: str, order: str = "id", name: str = "scan") -> DataFrame:
    """Sum of value over all rows before each."""
    rows = numbered(p, order, name="_rn")
    return running_sum(rows, value, "_sum", "_rn").withColumn(name, F.col("_sum") - F.col(value)).drop("_sum", "_rn")


def shuffled(p: DataFrame, seed: int = 0, order: str = "id") -> DataFrame:
    """p with place, its number in an order that a hash of the id (and the seed) gives; the same on every run."""
    mixed = hash31(F.col(order) + seed)
    return numbered(p.withColumn("_mix", mixed), "_mix", order, name="place").drop("_mix")


def admitted(p: DataFrame, cost: str, limit: float, order: str = "id") -> DataFrame:
    """p with admitted: whether the running cost up to the row stays within limit; the first row always is."""
    rows = numbered(p, order, name="_rn")
    return running_sum(rows, cost, "_sum", "_rn").withColumn("admitted", (F.col("_sum") <= limit) | (F.col("_rn") == 1)).drop("_sum", "_rn")
