"""Boxes, vectors, rotations about single axes, cameras, units and colour factors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

AXES = "xyz"
Vector = dict[str, Column]
# G in cgs, a kiloparsec in cm, a solar mass in g, a year in s.
G_CGS, KPC_CM, MSUN_G, YEAR_S = 6.674e-8, 3.086e21, 1.989e33, 3.1536e7


def vector(prefix: str = "") -> Vector:
    return {a: F.col(prefix + a) for a in AXES}


def dot(u: Vector, v: Vector) -> Column:
    return u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]


def cross(u: Vector, v: Vector) -> Vector:
    return {a: u[b] * v[c] - u[c] * v[b] for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}


def length(u: Vector) -> Column:
    return F.sqrt(dot(u, u))


def boxes_gap2(c1: Vector, h1: Vector, c2: Vector, h2: Vector) -> Column:
    """Squared distance between two boxes given by centre and half size; 0 if they meet."""
    gap = {a: F.greatest(F.abs(c1[a] - c2[a]) - (h1[a] + h2[a]), F.lit(0.0)) for a in AXES}
    return dot(gap, gap)


def opened_by_box(cell: tuple[Vector, Vector], group: tuple[Vector, Vector], open2: Column) -> Column:
    """Whether a cell must be opened for a group by the distance of their boxes."""
    return boxes_gap2(*group, *cell) <= F.abs(open2)


def merged_boxes(c1: Vector, h1: Vector, c2: Vector, h2: Vector) -> tuple[Vector, Vector]:
    """Centre and half size of the box around two boxes."""
    low = {a: F.least(c1[a] - h1[a], c2[a] - h2[a]) for a in AXES}
    high = {a: F.greatest(c1[a] + h1[a], c2[a] + h2[a]) for a in AXES}
    return {a: (low[a] + high[a]) * 0.5 for a in AXES}, {a: (high[a] - low[a]) * 0.5 for a in AXES}


def padded(low: Column, high: Column, share: float = 0.01) -> tuple[Column, Column]:
    """A range widened by a share of its ends, each moved outwards by its sign."""
    out, into = 1.0 + share, 1.0 - share
    return F.when(low < 0, low * out).otherwise(low * into), F.when(high < 0, high * into).otherwise(high * out)


def node_h(n: Column, level: Column, size: Column, number: float) -> Column:
    """Radius of a ball that holds number bodies at the mean density of a node, whose volume is that of its cell."""
    return F.cbrt(F.lit(number) / (n / (F.pow(size, 3.0) / F.pow(F.lit(8.0), level))))


def about_z(angle: float) -> list[list[float]]:
    """Rotation in the xy plane."""
    s, c = math.sin(angle), math.cos(angle)
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]


def about_x(angle: float) -> list[list[float]]:
    """Rotation in the yz plane."""
    s, c = math.sin(angle), math.cos(angle)
    return [[1.0, 0.0, 0.0], [0.0, c, -s], [0.0, s, c]]


def camera_fit(low: Vector, high: Vector, aspect: float) -> dict[str, Column]:
    """Centre and radius of a box, the distance from which a view of 60 degrees (times the aspect) holds it, the camera's shift, and the near and far planes."""
    radius = F.greatest(length(high), length(low))
    away = radius / math.sin(0.5 * aspect * math.pi / 3.0)
    mid = {a: (low[a] + high[a]) * 0.5 for a in AXES}
    shift = mid | {"z": mid["z"] - away * 0.2}
    return {"radius": radius, "distance": away, "near": away * 1e-4, "far": (radius + away) * 4.0} | {f"t{a}": shift[a] for a in AXES}


def time_unit_gyr(length_kpc: float, mass_msun: float) -> float:
    """The unit of time, in 10**9 years, where G = 1 for lengths in so many kiloparsecs and masses in so many solar ones."""
    return math.sqrt((length_kpc * KPC_CM) ** 3 / (G_CGS * mass_msun * MSUN_G)) * 1e-9 / YEAR_S


def blend_rgba(src: tuple[Column, ...], dst: tuple[Column, ...], f_src: str, f_dst: str) -> tuple[Column, ...]:
    """Each of four channels: source times its factor plus destination times its own; the last channel of the source is its alpha."""
    alpha = src[3]
    factor = {"ONE": F.lit(1.0), "ZERO": F.lit(0.0), "SRC_ALPHA": alpha, "ONE_MINUS_SRC_ALPHA": 1.0 - alpha}
    return tuple(s * factor[f_src] + d * factor[f_dst] for s, d in zip(src, dst, strict=True))
