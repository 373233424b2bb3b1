"""Synthetic models over a table of ids: every draw is a hash of a seed, a body's id and the number of the draw, so a body is the same on every run and in any partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.physics import axis_angle
from .merging import recentre, rotated
from .profiles import interpolate_curve

PHASE = ("x", "y", "z", "vx", "vy", "vz")
TRIES = 16


def draw(seed: int, k: int, key: str = "id") -> Column:
    """Draw number k of each row, between 0 and 1: the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _direction(r: Column, u: Column, v: Column) -> dict[str, Column]:
    c = 1.0 - 2.0 * u
    s, phi = F.sqrt(1.0 - c * c), 2 * math.pi * v
    return {"x": r * s * F.cos(phi), "y": r * s * F.sin(phi), "z": r * c}


def plummer(spark: SparkSession, n: int, seed: int = 19810614, rmax: float = 100.0) -> DataFrame:
    """``plummer_over`` of the ids 0 to n - 1."""
    return plummer_over(spark.range(n), seed, rmax)


def plummer_over(ids: DataFrame, seed: int = 19810614, rmax: float = 100.0) -> DataFrame:
    """A body of a Plummer sphere for each id (unique), in virial units (total mass 1), cut at rmax, the centre of mass at rest.

    The speed is the first accepted of sixteen draws of the rejection method; a body none of whose draws is accepted (about one in 10**7) takes the most likely speed."""
    u = lambda k: draw(seed, k)
    top = (1.0 + rmax**-2.0) ** -1.5  # share of the mass inside rmax
    rows = ids.select("id", (1.0 / F.sqrt(F.pow(F.greatest(u(0), F.lit(1e-10)) * top, F.lit(-2.0 / 3.0)) - 1.0)).alias("_r"), *[u(k).alias(f"_u{k}") for k in range(1, 5)], *[u(5 + k).alias(f"_q{k}") for k in range(2 * TRIES)])
    tried = [(F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")) for i in range(TRIES)]
    q = F.coalesce(*[F.when(0.1 * g < x * x * F.pow(1.0 - x * x, F.lit(3.5)), x) for x, g in tried], F.lit(math.sqrt(2.0) / 3.0))
    rows = rows.withColumn("_v", q * math.sqrt(2.0) * F.pow(1.0 + F.col("_r") * F.col("_r"), F.lit(-0.25)))
    length = 3.0 * math.pi / 16.0
    place = {c: e * length for c, e in _direction(F.col("_r"), F.col("_u1"), F.col("_u2")).items()}
    speed = {f"v{c}": e / math.sqrt(length) for c, e in _direction(F.col("_v"), F.col("_u3"), F.col("_u4")).items()}
    total = ids.agg((1.0 / F.count("*")).alias("mass"))
    return recentre(rows.withColumns(place | speed).crossJoin(F.broadcast(total)).select("id", *PHASE, "mass"))


def sphere(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``sphere_over`` of the ids 0 to n - 1."""
    return sphere_over(spark.range(n), seed)


def sphere_over(ids: DataFrame, seed: int = 1) -> DataFrame:
    """A body of a uniform unit sphere at rest for each id, total mass 1."""
    rows = ids.select("id", *[draw(seed, k).alias(f"_u{k}") for k in range(3)])
    total = ids.agg((1.0 / F.count("*")).alias("_m"))
    return _at_rest(rows.withColumns(_direction(F.cbrt("_u0"), F.col("_u1"), F.col("_u2"))).crossJoin(F.broadcast(total)), F.col("_m"))


def cube(spark: SparkSession, n: int, seed: int = 1, mass: float | None = None) -> DataFrame:
    """``cube_over`` of the ids 0 to n - 1."""
    return cube_over(spark.range(n), seed, mass)


def cube_over(ids: DataFrame, seed: int = 1, mass: float | None = None) -> DataFrame:
    """A body of a uniform cube of side 2 at rest for each id; each has mass 1 / n**2 unless given."""
    rows = ids.select("id", *[(2.0 * draw(seed, k) - 1.0).alias(c) for k, c in enumerate("xyz")])
    total = ids.agg((1.0 / (F.count("*").cast("double") * F.count("*"))).alias("_m"))
    return _at_rest(rows.crossJoin(F.broadcast(total)), F.col("_m") if mass is None else F.lit(mass))


def _at_rest(p: DataFrame, mass: Column) -> DataFrame:
    return p.withColumns({f"v{c}": F.lit(0.0) for c in "xyz"} | {"mass": mass}).select("id", *PHASE, "mass")


def shuffled_disk(p: DataFrame, seed: int = 1, jitter: float = 1e-3) -> DataFrame:
    """p with every body turned about the z axis by an angle of its own and moved by up to jitter."""
    rows = p.withColumn("_a", draw(seed, 0) * 2 * math.pi).withColumns({"_s": F.sin("_a"), "_c": F.cos("_a")} | {f"_j{i}": (draw(seed, 1 + i) - 0.5) * 2 * jitter for i in range(3)})
    turn = {f"{v}x": F.col(f"{v}x") * F.col("_c") - F.col(f"{v}y") * F.col("_s") for v in ("", "v")} | {f"{v}y": F.col(f"{v}x") * F.col("_s") + F.col(f"{v}y") * F.col("_c") for v in ("", "v")}
    rows = rows.withColumns(turn)
    return rows.withColumns({c: F.col(c) + F.col(f"_j{i}") for i, c in enumerate("xyz")}).select(*p.columns)


def dust_ring(spark: SparkSession, n: int, radius: float, d: float, h: float, inclination: float = 0.0, node: float = math.pi / 2, torus: bool = False, scales: float = 3.0, seed: int = 1, curve: DataFrame | None = None) -> DataFrame:
    """``dust_ring_over`` of the ids 0 to n - 1."""
    return dust_ring_over(spark.range(n), radius, d, h, inclination, node, torus, scales, seed, curve)


def dust_ring_over(ids: DataFrame, radius: float, d: float, h: float, inclination: float = 0.0, node: float = math.pi / 2, torus: bool = False, scales: float = 3.0, seed: int = 1, curve: DataFrame | None = None) -> DataFrame:
    """A massless body of a ring for each id: Gaussian in R about radius and in z, within scales times d and h (torus: within their ellipse), on a circle with the speed that
    curve (r, v) has at its radius, at rest without one; then inclined.

    The place is the first of sixteen draws that lies within; a body none of whose draws does (about one in 10**30, or 10**15 for a torus) takes the middle. ValueError if the curve does not reach over the ring."""
    if curve is not None:
        low, high = curve.agg(F.min("r"), F.max("r")).first()
        if low is None or not (low < radius - scales * d and radius + scales * d < high):
            raise ValueError("the curve does not reach over the ring")
    rows = ids.select("id", draw(seed, 0).alias("_phi"), *[draw(seed, 1 + k).alias(f"_u{k}") for k in range(2 * TRIES)])
    tried = []
    for i in range(TRIES):
        far, turn = F.sqrt(-2.0 * F.log(F.greatest(F.col(f"_u{2 * i}"), F.lit(1e-300)))), 2 * math.pi * F.col(f"_u{2 * i + 1}")
        a, b = far * F.cos(turn), far * F.sin(turn)
        inside = (a * a + b * b < scales * scales) if torus else (F.abs(a) <= scales) & (F.abs(b) <= scales)
        tried.append(F.when(inside & (radius + d * a > 0), F.struct(a.alias("a"), b.alias("b"))))
    rows = rows.withColumn("_at", F.coalesce(*tried, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))))
    rows = rows.select("id", (radius + d * F.col("_at.a")).alias("r"), (h * F.col("_at.b")).alias("z"), (2 * math.pi * F.col("_phi")).alias("_phi"))
    rows = rows.withColumn("v_curve", F.lit(0.0)) if curve is None else interpolate_curve(rows, curve)
    place = {"x": F.col("r") * F.cos("_phi"), "y": F.col("r") * F.sin("_phi")}
    out = rows.withColumns(place | {"vx": -F.col("v_curve") * F.sin("_phi"), "vy": F.col("v_curve") * F.cos("_phi"), "vz": F.lit(0.0), "mass": F.lit(0.0)}).select("id", *PHASE, "mass")
    return rotated(out, axis_angle((math.cos(node), math.sin(node), 0.0), inclination))
