"""Range cuts along the curve, orthogonal recursive bisection, domain look-up and halo replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.views import COORDS
from .cut import numbered, running_sum


def range_cuts(keyed: DataFrame, parts: int, key: str = "key_hi") -> DataFrame:
    """part, low: the first key of each of parts equal stretches of keyed rows (with rn)."""
    n = keyed.agg(F.count("*").alias("n"))
    at = keyed.sparkSession.range(parts).crossJoin(F.broadcast(n)).select(F.col("id").alias("part"), (F.floor(F.col("id") * F.col("n") / parts) + 1).cast("long").alias("rn"))
    return at.join(keyed.select("rn", F.col(key).alias("low")), "rn").select("part", "low")


def weights(load: DataFrame, spare: float = 0.3) -> DataFrame:
    """part, seconds, n -> f: share of time over share of bodies, at least 1 / (1 + spare). One row a part."""
    total = load.agg(F.sum("seconds").alias("_s"), F.count("*").alias("_p"), F.avg("n").alias("_n"))
    f = F.col("seconds") / F.col("_s") * F.col("_p") * (F.col("_n") / F.col("n"))
    return load.crossJoin(F.broadcast(total)).withColumn("f", F.greatest(f, F.lit(1.0 / (1.0 + spare)))).drop("_s", "_p", "_n")


def domain_of(keyed: DataFrame, cuts: DataFrame, key: str = "key_hi") -> DataFrame:
    """keyed with part, the last cut at or below the key, -1 below all. Cuts are one row a domain; each key is looked up in their sorted array."""
    rows = sorted((r["low"], r["part"]) for r in cuts.select("low", "part").collect())
    low, part = np.array([r[0] for r in rows], np.int64), np.array([-1, *[r[1] for r in rows]], np.int64)

    @F.pandas_udf("long")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(part[np.searchsorted(low, k.to_numpy(), side="right")])

    return keyed.withColumn("part", place(F.col(key)))


def exchange_matrix(moved: DataFrame) -> DataFrame:
    return moved.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _cut_axis(p: DataFrame, axis: str, n: int, within: list[str]) -> DataFrame:
    """p with i<axis>: which of n slices of equal count along the axis, inside each combination of within."""
    if within:
        # ranks are global numbers minus those of the groups before: one sort, no group on one task
        rows = numbered(p, *within, axis, "id", name="_rn")
        sizes = rows.groupBy(*within).agg(F.min("_rn").alias("_first"), F.count("*").alias("_n"))
        rows = rows.join(F.broadcast(sizes), within)
    else:
        rows = numbered(p, axis, "id", name="_rn").withColumn("_first", F.lit(1)).crossJoin(F.broadcast(p.agg(F.count("*").alias("_n"))))
    return rows.withColumn(f"i{axis}", F.floor((F.col("_rn") - F.col("_first")) * n / F.col("_n")).cast("long")).drop("_rn", "_first", "_n")


def bisect(p: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """p with ix, iy, iz and box = (ix ny + iy) nz + iz: x slices of equal count, y slices within each, z slices within those."""
    out = _cut_axis(_cut_axis(_cut_axis(p, "x", nx, []), "y", ny, ["ix"]), "z", nz, ["ix", "iy"])
    return out.withColumn("box", (F.col("ix") * ny + F.col("iy")) * nz + F.col("iz"))


def orb_boxes(cut: DataFrame) -> DataFrame:
    """box, n, low_*, high_*: slices meet midway between their neighbouring bodies and the outer ones are open (NULL)."""
    out = cut.groupBy("ix", "iy", "iz", "box").agg(F.count("*").alias("n"))
    for axis, within in (("x", []), ("y", ["ix"]), ("z", ["ix", "iy"])):
        ends = cut.groupBy(*within, f"i{axis}").agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
        w = Window.partitionBy(*within).orderBy(f"i{axis}") if within else Window.orderBy(f"i{axis}")
        ends = ends.select(*within, f"i{axis}", (0.5 * (F.lag("_hi").over(w) + F.col("_lo"))).alias(f"low_{axis}"), (0.5 * (F.col("_hi") + F.lead("_lo").over(w))).alias(f"high_{axis}"))
        out = out.join(F.broadcast(ends), [*within, f"i{axis}"])
    return out.select("box", "n", *[f"{s}_{c}" for c in COORDS for s in ("low", "high")])


MAX_BOXES = 1 << 20


class BoxTree:
    """The boxes of a bisection as slices of x, of y within each, and of z within those; every look-up is by binary search.

    Boxes are one row a domain; ValueError beyond MAX_BOXES."""

    def __init__(self, boxes: DataFrame):
        rows = boxes.select("box", *[f"{s}_{c}" for c in COORDS for s in ("low", "high")]).limit(MAX_BOXES + 1).toPandas()
        if len(rows) > MAX_BOXES:
            raise ValueError(f"more than {MAX_BOXES} boxes")
        ends = [rows[f"{s}_{c}"].to_numpy(float) for c in COORDS for s in ("low", "high")]
        for i, e in enumerate(ends):  # an open side has no end
            e[np.isnan(e)] = np.inf if i % 2 else -np.inf
        self.box = rows["box"].to_numpy(np.int64)
        order = np.lexsort((ends[4], ends[3], ends[2], ends[1], ends[0]))
        self.box, ends = self.box[order], [e[order] for e in ends]
        # first[k][i]: the boxes of slice i of axis k begin there; a slice ends where its bounds or its parent change
        new, self.axes = np.zeros(len(order), dtype=bool), []
        new[:1] = True
        for low, high in zip(ends[::2], ends[1::2], strict=True):
            parent = np.cumsum(new) - 1 if self.axes else np.zeros(len(order), dtype=np.int64)
            new = new.copy()
            new[1:] |= (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (len(self.axes) == 2)
            at = np.flatnonzero(new)
            self.axes.append((low[at], high[at], np.searchsorted(parent[at], np.arange(parent[-1] + 2 if len(at) else 1))))

    def meets(self, low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of a box) of every box with low < its high side and high >= its low side, along every axis; row after row."""
        row, node = np.arange(len(low[0])), np.zeros(len(low[0]), dtype=np.int64)
        for k, (lows, highs, first) in enumerate(self.axes):
            a, b = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order], prepend=-1, append=-2))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                mine, n = order[i:j], node[order[i]]
                s = slice(first[n], first[n + 1])
                a[mine] = first[n] + np.searchsorted(highs[s], low[k][row[mine]], side="right")
                b[mine] = first[n] + np.searchsorted(lows[s], high[k][row[mine]], side="right")
            count = np.maximum(b - a, 0)
            node = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(row, count)
        return row, node


def _meeting(p: DataFrame, boxes: DataFrame, reach: F.Column) -> DataFrame:
    """id, box, own of every body and each box that a cube of reach about it meets; bodies that meet none have box NULL."""
    tree = BoxTree(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *place, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 5))
            row, at = tree.meets([c - r for c in place], [c + r for c in place]) if len(tree.box) else (np.zeros(0, np.int64),) * 2
            inside = np.ones(len(row), dtype=bool)
            last, parents = at, []
            for lows, highs, first in reversed(tree.axes):
                parents.append((lows[last], highs[last]))
                last = np.searchsorted(first, last, side="right") - 1
            for c, (lo, hi) in zip(place, reversed(parents), strict=True):
                inside &= (c[row] >= lo) & (c[row] < hi)
            alone = np.setdiff1d(np.arange(batch.num_rows), row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate([row, alone]))), pa.concat_arrays([pa.array(tree.box[at]), pa.nulls(len(alone), pa.int64())]), pa.concat_arrays([pa.array(inside), pa.nulls(len(alone), pa.bool_())])], names=["id", "box", "own"])

    schema = f"id {p.schema['id'].dataType.simpleString()}, box long, own boolean"
    return p.select("id", *COORDS, reach.cast("double").alias("_r")).mapInArrow(run, schema)


def replicate_halo(p: DataFrame, boxes: DataFrame, hfac: float = 2.0) -> DataFrame:
    """A row (box, id, own) for every box that a body's ball of hfac h overlaps; own: the body lies in it (low <= x < high)."""
    return _meeting(p, boxes, F.lit(hfac) * F.col("h")).filter("box IS NOT NULL").select("box", "id", "own")


def box_of(p: DataFrame, boxes: DataFrame) -> DataFrame:
    """id, box that holds the body, -1 if none."""
    return _meeting(p, boxes, F.lit(0.0)).select("id", F.coalesce("box", F.lit(-1).cast("long")).alias("box"))


def visibility(boxes: DataFrame, eye: tuple[float, float, float]) -> DataFrame:
    """box, place: order of the boxes from the eye, by the distance to the nearest point of each."""
    d2 = F.lit(0.0)
    for c, e in zip(COORDS, eye, strict=True):
        gap = F.greatest(F.coalesce(F.col(f"low_{c}") - e, F.lit(0.0)), F.coalesce(e - F.col(f"high_{c}"), F.lit(0.0)), F.lit(0.0))
        d2 = d2 + gap * gap
    return boxes.withColumn("d2", d2).select("box", "d2", F.row_number().over(Window.orderBy("d2", "box")).cast("long").alias("place"))


def visibility_by_splits(boxes: DataFrame, eye: tuple[float, float, float], ny: int, nz: int) -> DataFrame:
    """box, place: front to back through the splits of a bisection into so many y and z slices.

    Along each axis the slice that holds the eye (or the nearest one) comes first, then those below it downwards, then those above it upwards."""
    rows = boxes.withColumns({"ix": F.floor(F.col("box") / (ny * nz)), "iy": F.floor(F.col("box") / nz) % ny, "iz": F.col("box") % nz})
    within: list[str] = []
    for c, e in zip(COORDS, eye, strict=True):
        i, below = F.col(f"i{c}"), F.col(f"low_{c}").isNull() | (F.col(f"low_{c}") <= e)
        ends = rows.groupBy(*within).agg(F.coalesce(F.max(F.when(below, i)), F.min(i)).alias("_eye"))
        rows = rows.join(ends, within) if within else rows.crossJoin(ends)
        rows = rows.withColumn(f"k{c}", F.when(i <= F.col("_eye"), F.col("_eye") - i).otherwise(i)).drop("_eye")
        within.append(f"i{c}")
    return numbered(rows.select("box", "kx", "ky", "kz"), "kx", "ky", "kz", name="place").select("box", "place")


def weighted_cuts(keyed: DataFrame, parts: int, weight: str, key: str = "key_hi") -> DataFrame:
    """part, low: cuts of keyed rows (with rn) into stretches of equal weight; a part begins with the first row before which its share of the weight lies."""
    rows = running_sum(keyed.select("rn", F.col(key).alias("low"), F.col(weight).alias("_w")), "_w", "_sum").withColumn("_before", F.col("_sum") - F.col("_w"))
    total = rows.agg(F.sum("_w").alias("_all"))
    part = F.least(F.floor(F.col("_before") * parts / F.col("_all")).cast("long"), F.lit(parts - 1))
    placed = rows.crossJoin(F.broadcast(total)).withColumn("part", part)
    return placed.groupBy("part").agg(F.min(F.struct("rn", "low")).alias("_m")).select("part", F.col("_m.low").alias("low"))


def two_stage_cuts(keyed: DataFrame, first: int, second: int, key: str = "key_hi") -> DataFrame:
    """stage1, stage2, low: keyed rows (with rn) cut into first stretches, and each of those into second ones, all by equal counts."""
    n = keyed.agg(F.count("*").alias("n"))
    rows = keyed.sparkSession.range(first * second).crossJoin(F.broadcast(n))
    a, b = F.floor(F.col("id") / second).cast("long"), F.col("id") % second
    lo, hi = F.floor(a * F.col("n") / first).cast("long"), F.floor((a + 1) * F.col("n") / first).cast("long")
    rows = rows.select(a.alias("stage1"), b.alias("stage2"), (lo + F.floor(b * (hi - lo) / second).cast("long") + 1).alias("rn"))
    return rows.join(keyed.select("rn", F.col(key).alias("low")), "rn").select("stage1", "stage2", "low")


def distribute(p: DataFrame, boxes: DataFrame, parts: int | None = None, hfac: float = 2.0) -> DataFrame:
    """All columns of p (with h) with box and own: every body in each box its ball meets, rows dealt to partitions by box."""
    placed = replicate_halo(p, boxes, hfac)
    rows = p.join(placed, "id")
    return rows.repartition(parts, "box") if parts else rows.repartition("box")


def domain_bounds(distributed: DataFrame) -> DataFrame:
    """box, its own and foreign bodies, and the range of all of them."""
    own = F.col("own").cast("long")
    return distributed.groupBy("box").agg(F.sum(own).alias("n_own"), F.sum(1 - own).alias("n_halo"), *[f(c).alias(f"{c}{f.__name__}") for c in COORDS for f in (F.min, F.max)])
