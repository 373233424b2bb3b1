"""Surface maps, polar histograms and radial profiles of the stars of a disk."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import physics
from ..sources.views import BULGE, DARK, DISK
from .cut import cut

MASS_UNIT, SURFACE_UNIT = 2.33e9, 2300.0


def density_map(p: DataFrame, plane: str = "xy", xmax: float = 20.0, bins: int = 1024) -> DataFrame:
    """ix, iy, mass (in suns), v2 of the stars seen along the third axis; bins 0 and beyond the last are not counted."""
    a, b = plane
    width = 2 * xmax / bins
    stars = p.filter(F.col("ptype") != DARK)
    at = {f"i{k}": F.floor((F.col(c) + xmax) / width).cast("long") for k, c in zip("xy", (a, b), strict=True)}
    inside = stars.withColumns(at).filter(f"ix > 0 AND ix < {bins} AND iy > 0 AND iy < {bins}")
    v2 = F.col(f"v{a}") * F.col(f"v{a}") + F.col(f"v{b}") * F.col(f"v{b}")
    return inside.groupBy("ix", "iy").agg(F.sum(F.col("mass") * MASS_UNIT).alias("mass"), F.sum(v2).alias("v2"))


def density_rphi(p: DataFrame, nphi: int = 128, nr: int = 20, dr: float = 1.0) -> DataFrame:
    """iphi, ir, n, mass and ratio of the cell's density to its ring's mean."""
    r, phi = physics.polar(F.col("x"), F.col("y"))
    stars = p.filter(F.col("ptype") != DARK).withColumns({"ir": F.floor(r / dr).cast("long"), "iphi": F.floor((phi + 180.0) / (360.0 / nphi)).cast("long")})
    cells = stars.filter(f"ir >= 0 AND ir < {nr} AND iphi >= 0 AND iphi < {nphi}").groupBy("iphi", "ir").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    ring = 2 * math.pi * (F.col("ir") + 0.5) * dr * dr
    rings = cells.groupBy("ir").agg((F.sum("mass") / ring).alias("_mean"))
    return cells.join(F.broadcast(rings), "ir").select("iphi", "ir", "n", "mass", F.try_divide(F.col("mass") / (ring / nphi), F.col("_mean")).alias("ratio"))


def radial_bins(p: DataFrame, rmax: float = 30.0, bins: int = 600) -> DataFrame:
    """pop (all, bulge, disk), bin, n, mass and sums of v_r, v_phi, v_z, their squares and z squared; radius 0 and rmax are outside."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    stars = p.filter(F.col("ptype") != DARK).withColumn("r", r).filter(f"r > 0 AND r < {rmax}")
    vr, vphi = (F.col("x") * F.col("vx") + F.col("y") * F.col("vy")) / F.col("r"), (F.col("x") * F.col("vy") - F.col("y") * F.col("vx")) / F.col("r")
    rows = stars.withColumns({"bin": F.floor(F.col("r") / (rmax / bins)).cast("long"), "v_r": vr, "v_phi": vphi, "v_z": F.col("vz")})
    rows = rows.withColumn("pop", F.explode(F.array(F.lit("all"), F.when(F.col("ptype") == BULGE, "bulge").when(F.col("ptype") == DISK, "disk"))))
    sums = [F.sum(v).alias(f"s_{v[2:]}") for v in ("v_r", "v_phi", "v_z")] + [F.sum(F.col(v) * F.col(v)).alias(f"q_{v[2:]}") for v in ("v_r", "v_phi", "v_z")]
    return rows.groupBy("pop", "bin").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), *sums, F.sum(F.col("z") * F.col("z")).alias("q_height"))


def radial_profile(p: DataFrame, rmax: float = 30.0, bins: int = 600) -> DataFrame:
    """The table of radial_bins for every bin, empty ones too, with surface density, means, dispersions, Omega, cumulative mass, kappa, Gamma, Q, m and X.

    The profile has bins x 3 rows however many bodies there are. Divisions by an empty bin give NULL."""
    dr = rmax / bins
    spark = p.sparkSession
    grid = spark.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(spark.createDataFrame([("all",), ("bulge",), ("disk",)], "pop string")))
    full = grid.join(radial_bins(p, rmax, bins), ["pop", "bin"], "left").na.fill(0)
    full = full.withColumns({"n": F.col("n").cast("long"), "r": (F.col("bin") + 0.5) * dr})
    n = F.col("n")
    full = full.withColumn("sigma", F.col("mass") / (2 * math.pi * F.col("r") * dr))
    for v in ("r", "phi", "z"):
        mean = F.when(n > 0, F.col(f"s_{v}") / n).otherwise(0.0)
        full = full.withColumn(f"mean_{v}", mean).withColumn(f"disp_{v}", F.when(n > 0, F.sqrt(F.greatest(F.col(f"q_{v}") / n - F.col(f"mean_{v}") * F.col(f"mean_{v}"), F.lit(0.0)))).otherwise(0.0))
    full = full.withColumns({"omega": F.col("mean_phi") / F.col("r"), "z_rms": F.when(n > 0, F.sqrt(F.col("q_height") / n)).otherwise(0.0)})
    w = Window.partitionBy("pop").orderBy("bin")
    full = full.withColumn("mass_cum", F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    up, down, om = F.lead("omega").over(w), F.lag("omega").over(w), F.col("omega")
    inner_k = F.sqrt(F.greatest(0.5 * F.col("r") * (up * up - down * down) / dr + 4.0 * om * om, F.lit(0.0)))
    inner_g = F.try_divide(-F.col("r") * 0.5 * (up - down) / dr, om)
    full = full.withColumns({"_k": inner_k, "_g": inner_g})
    first, last = F.col("bin") == 0, F.col("bin") == bins - 1
    full = full.withColumns({"kappa": F.when(first, 2.0 * om).when(last, F.lag("_k").over(w)).otherwise(F.col("_k")), "gamma": F.when(first, F.lead("_g").over(w)).when(last, F.lag("_g").over(w)).otherwise(F.col("_g"))}).drop("_k", "_g")
    k2 = F.col("kappa") * F.col("kappa")
    return full.withColumns({"m": F.try_divide(k2, F.col("sigma")), "q": F.try_divide(F.col("disp_r") * F.col("kappa"), 3.36 * F.col("sigma")), "x": F.try_divide(k2 * F.col("r"), 2 * math.pi * F.col("sigma")) / 4.0})


#: The columns of the radial table: of all stars, of the bulge, of the disk.
TABLE = ("r", "vas", "drs", "das", "dzs", "omg", "kapp", "q", "gam", "mx", "sigs", "mass", "m", "zrms", "n")
TABLE_PART = ("r", "vas", "drs", "das", "dzs", "sigs", "mass")


def radial_table(profile: DataFrame, velocity: float = 1.0, time: float = 1.0, surface: float = SURFACE_UNIT, mass: float = MASS_UNIT) -> DataFrame:
    """bin and the 29 values of the radial table: a row a bin of ``radial_profile``, TABLE of all stars, TABLE_PART of bulge (_b) and disk (_d).

    Speeds and kappa are scaled by velocity, Omega divided by time, surface densities and masses (those inside the bin's outer edge) scaled to their units."""
    v, n = (lambda c: F.col(c) * velocity), F.col
    values = {"r": n("r"), "vas": v("mean_phi"), "drs": v("disp_r"), "das": v("disp_phi"), "dzs": v("disp_z"), "omg": n("omega") / time, "kapp": v("kappa"), "q": n("q"), "gam": n("gamma"), "mx": n("x"), "sigs": n("sigma") * surface, "mass": n("mass_cum") * mass, "m": n("m"), "zrms": n("z_rms"), "n": n("n").cast("double")}
    one = lambda pop, names, end: [F.max(F.when(F.col("pop") == pop, values[c])).alias(c + end) for c in names]
    return profile.groupBy("bin").agg(*one("all", TABLE, ""), *one("bulge", TABLE_PART, "_b"), *one("disk", TABLE_PART, "_d"))


def rotation_curve(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, v of disk bodies in nearly flat motion; one row: n, mass, angular momentum by mass lx, ly, lz, rmin, rmax)."""
    v = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    flat = p.filter(F.col("ptype") == DISK).withColumns({"v": v, "r": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))}).filter(0.01 * F.col("v") > F.abs("vz"))
    m = F.col("mass")
    cross = {"lx": F.col("y") * F.col("vz") - F.col("z") * F.col("vy"), "ly": F.col("z") * F.col("vx") - F.col("x") * F.col("vz"), "lz": F.col("x") * F.col("vy") - F.col("y") * F.col("vx")}
    total = flat.agg(F.count("*").alias("n"), F.sum(m).alias("mass"), *[F.try_divide(F.sum(m * e), F.sum(m)).alias(k) for k, e in cross.items()], F.min("r").alias("rmin"), F.max("r").alias("rmax"))
    return flat.select("id", "r", "v"), total


def vertical_extent(p: DataFrame, rmin: float, rmax: float) -> DataFrame:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return p.withColumn("r", r).filter((F.col("r") >= rmin) & (F.col("r") <= rmax)).agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


def interpolate_curve(p: DataFrame, curve: DataFrame) -> DataFrame:
    """p (with r) with v_curve, linear between the last curve point below r and the one after the first at or above r; NULL outside the curve, and where r is NULL.

    An as-of join by range: bodies and points are dealt together by radius, a body before a point of its radius; a task walks its stretch in order, and
    the points it lacks at its ends come from the other stretches' ends, three points each."""
    points = curve.filter("r IS NOT NULL").groupBy("r").agg(F.avg("v").alias("v"))
    whole = F.struct(*p.columns)
    kind = p.select(whole.alias("row")).schema["row"].dataType
    both = p.select(F.col("r").cast("double").alias("r"), F.lit(False).alias("point"), F.lit(None).cast("double").alias("v"), F.monotonically_increasing_id().alias("tie"), whole.alias("row"))
    both = both.unionByName(points.select(F.col("r").cast("double").alias("r"), F.lit(True).alias("point"), F.col("v").cast("double").alias("v"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(kind).alias("row")))
    order = ("r", "point", "tie")
    dealt = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())).drop("tie")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, part = [], None, None
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            r, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first += list(zip(r[: 2 - len(first)].tolist(), v[: 2 - len(first)].tolist(), strict=True)) if len(first) < 2 else []
            last = (float(r[-1]), float(v[-1])) if len(r) else last
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([[x for p in first for x in p]], pa.list_(pa.float64())), pa.array([list(last)], pa.list_(pa.float64()))], names=["part", "first", "last"])

    # a row for each partition that holds points
    known = sorted(dealt.filter("point").select("r", "v", "part").mapInArrow(ends, "part int, first array<double>, last array<double>").collect())
    parts = np.array([k["part"] for k in known], np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # bodies, their radii, the number of points before them
        rs, vs, seen, part = [], [], 0, None  # points from the last one that a waiting body can need

        def settle(r: np.ndarray, v: np.ndarray, base: int, end: bool) -> Iterator[pa.RecordBatch]:
            """Bodies whose two next points are known (all at the end); the others wait on."""
            held, waiting[:] = waiting[:], []
            for rows, x, before in held:
                at = before - base  # of r, the place of the first point at or above x
                ready = len(x) if end else int(np.searchsorted(at, len(r) - 2, side="right"))
                if ready:
                    i = at[:ready]
                    ok = (i > 0) & (i + 1 < len(r)) & ~np.isnan(x[:ready])
                    lo, up = np.clip(i - 1, 0, max(len(r) - 1, 0)), np.clip(i + 1, 0, max(len(r) - 1, 0))
                    with np.errstate(all="ignore"):
                        found = v[lo] + (x[:ready] - r[lo]) * ((v[up] - v[lo]) / (r[up] - r[lo])) if len(r) else np.zeros(ready)
                    yield pa.RecordBatch.from_arrays([rows[:ready], pa.array(found, mask=~ok)], names=["row", "v_curve"])
                if ready < len(x):
                    waiting.append((rows[ready:], x[ready:], before[ready:]))

        base = 0
        for b in batches:
            if not b.num_rows:
                continue
            r, point, v = b.column(0).to_numpy(zero_copy_only=False).astype(float), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            if part is None:
                part = b.column(4)[0].as_py()
                at = int(np.searchsorted(parts, part)) - 1
                if at >= 0:
                    rs, vs, seen = [known[at]["last"][0]], [known[at]["last"][1]], 1
            body = np.flatnonzero(~point)
            if len(body):
                waiting.append((b.column(3).take(pa.array(body)), r[body], seen + np.cumsum(point)[body]))
            rs, vs = [*rs, *r[point].tolist()], [*vs, *v[point].tolist()]
            seen += int(point.sum())
            yield from settle(np.array(rs), np.array(vs), base, False)
            # points before all that wait are done with, but for the last one
            low = max(base, min([seen, *(int(w[2][0]) for w in waiting)]) - 1)
            rs, vs, base = rs[low - base :], vs[low - base :], low
        if part is not None:
            after = [x for k in known[int(np.searchsorted(parts, part, side="right")) :][:2] for x in k["first"]][:4]
            yield from settle(np.array([*rs, *after[::2]]), np.array([*vs, *after[1::2]]), base, True)

    found = dealt.select("r", "point", "v", "row", "part").mapInArrow(walk, StructType().add("row", kind).add("v_curve", "double"))
    return found.select("row.*", "v_curve")
