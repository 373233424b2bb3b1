"""Forces, kernels and other scalar formulas as column expressions (G = 1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

QUARTIC_NORM = 3465.0 / (512.0 * math.pi)
M4_NORM = 8.0 / math.pi


def body_body(d: dict[str, Column], mass: Column, eps: float) -> dict[str, Column]:
    """Softened pull of a point mass at offset d (source minus target)."""
    r2 = sum((d[c] * d[c] for c in "xyz"), F.lit(eps * eps))
    r = F.sqrt(r2)
    return {"ax": mass * d["x"] / (r2 * r), "ay": mass * d["y"] / (r2 * r), "az": mass * d["z"] / (r2 * r), "pot": -mass / r}


def body_cell(d: dict[str, Column], mass: Column, q: dict[str, Column], eps: float) -> dict[str, Column]:
    """Pull of a cell up to its quadrupole; d is target minus centre of mass, q the central moments per unit mass."""
    r2 = sum((d[c] * d[c] for c in "xyz"), F.lit(eps * eps))
    d0 = mass / F.sqrt(r2)
    d1 = -d0 / r2
    d2 = -3.0 * d1 / r2
    d3 = -5.0 * d2 / r2
    trace = q["q11"] + q["q22"] + q["q33"]
    u = {"x": q["q11"] * d["x"] + q["q12"] * d["y"] + q["q13"] * d["z"], "y": q["q12"] * d["x"] + q["q22"] * d["y"] + q["q23"] * d["z"], "z": q["q13"] * d["x"] + q["q23"] * d["y"] + q["q33"] * d["z"]}
    w = sum((d[c] * u[c] for c in "xyz"), F.lit(0.0))
    radial = d1 + 0.5 * (d2 * trace + d3 * w)
    return {"pot": -(d0 + 0.5 * (d1 * trace + d2 * w))} | {f"a{c}": radial * d[c] + d2 * u[c] for c in "xyz"}


def quartic(r2: Column, h: Column) -> Column:
    """(1 - r2/h2)^4 of unit integral; no mass enters."""
    k = F.greatest(1.0 - r2 / (h * h), F.lit(0.0))
    return QUARTIC_NORM / (h * h * h) * k * k * k * k


def m4(r: Column, h: Column) -> Column:
    """Cubic spline on [0, h] of unit integral."""
    q = r / h
    inner, outer = 1.0 - 6.0 * q * q * (1.0 - q), 2.0 * (1.0 - q) * (1.0 - q) * (1.0 - q)
    return M4_NORM / (h * h * h) * F.when(q < 0.5, inner).when(q < 1.0, outer).otherwise(0.0)


def adjusted_h(h: Column, nnb: Column, target: float = 32.0, lo: float = 0.5, hi: float = 2.0) -> Column:
    """h times half of one plus the cube root of wanted over found neighbours, clamped."""
    factor = 0.5 * (1.0 + F.cbrt(target / nnb))
    return F.when(nnb > 0, h * F.least(F.greatest(factor, F.lit(lo)), F.lit(hi))).otherwise(h * hi)


def initial_h(n: Column, dx: Column, dy: Column, dz: Column, floor: Column, wanted: float = 42.0) -> Column:
    """First radius from a leaf's box: cube root of wanted over n per cube root of the volume, not below floor."""
    vol = F.cbrt(dx * dy * dz)
    return F.greatest(F.when(vol > 0, F.cbrt(wanted / (n / vol))).otherwise(0.0), floor)


def opening_radius2(mass: Column, n: Column, half: dict[str, Column], offset2: Column, theta: float) -> Column:
    """Squared distance below which a cell is opened; never reached by accepting a single body."""
    size = F.greatest(2.0 * F.greatest(*half.values()), F.lit(1e-6))
    s = F.when(mass < 1e-10, 0.0).otherwise(F.sqrt(offset2))
    r = size / theta + s
    return F.when(n == 1, F.lit(1e11)).otherwise(r * r)


def arc_cosine(v: Column) -> Column:
    """acos, to the nearest double close to 45 and 135 degrees, where the JVM's is a unit off and bodies on a diagonal lie on the border of two bins.

    There it is a quarter or three quarters of pi, each a double and its rest, less or more sqrt(2) t + t * t with t = abs(v) - sqrt(1/2)."""
    t = F.abs(v) - math.sqrt(0.5) + 4.833646656726457e-17
    step = math.sqrt(2.0) * t + t * t
    near = F.when(v > 0, math.pi / 4 + (3.061616997868383e-17 - step)).otherwise(3 * math.pi / 4 + (9.184850993605148e-17 + step))
    return F.when(F.abs(t) < 1e-9, near).otherwise(F.acos(v))


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Radius and angle in degrees, negative where y is not above 0."""
    r = F.sqrt(x * x + y * y)
    turn = F.degrees(arc_cosine(F.when(r > 0, x / r).otherwise(1.0)))
    return r, F.when(y > 0, turn).otherwise(-turn)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def rescale(v: Column, old_lo: Column, old_hi: Column, lo: float, hi: float) -> Column:
    """Linear map of [old_lo, old_hi] to [lo, hi]; lo where the old range is empty."""
    return F.when(old_hi > old_lo, (v - old_lo) / (old_hi - old_lo) * (hi - lo) + lo).otherwise(lo)


def rotate(v: tuple[Column, Column, Column], m: list[list[float]]) -> tuple[Column, ...]:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)


def euler(a: float, b: float, c: float) -> list[list[float]]:
    """Rotation about z by a, then x by b, then z by c (radians)."""
    (sa, ca), (sb, cb), (sc, cc) = ((math.sin(t), math.cos(t)) for t in (a, b, c))
    return [[ca * cc - sa * cb * sc, sa * cc + ca * cb * sc, sb * sc], [-ca * sc - sa * cb * cc, -sa * sc + ca * cb * cc, sb * cc], [sa * sb, -ca * sb, cb]]


def axis_angle(axis: tuple[float, float, float], angle: float) -> list[list[float]]:
    n = math.sqrt(sum(c * c for c in axis))
    x, y, z = (c / n for c in axis)
    s, c = math.sin(angle), math.cos(angle)
    k = 1 - c
    return [[c + x * x * k, x * y * k - z * s, x * z * k + y * s], [y * x * k + z * s, c + y * y * k, y * z * k - x * s], [z * x * k - y * s, z * y * k + x * s, c + z * z * k]]


def galactic(l_deg: float, b_deg: float) -> list[list[float]]:
    """Latitude rotation after longitude rotation."""
    l_, b = math.radians(l_deg), math.radians(b_deg)
    return [[math.cos(b) * math.cos(l_), math.cos(b) * math.sin(l_), math.sin(b)], [-math.sin(l_), math.cos(l_), 0.0], [-math.sin(b) * math.cos(l_), -math.sin(b) * math.sin(l_), math.cos(b)]]


def tone_map(c: Column) -> Column:
    return 1.0 - F.exp(-F.sqrt(0.05 * c))


# Fixed values of the integer hash: shift, multiplier, first and second addend.
HASH_VALUES = (13, 15731, 789221, 1376312589)
_M32 = 0xFFFFFFFF


def _times32(a: Column, b: Column) -> Column:
    """Product of two 32-bit numbers carried in longs, modulo 2**32, without overflow of a long."""
    low = a * b.bitwiseAND(0xFFFF)
    high = F.shiftleft((a * F.shiftrightunsigned(b, 16)).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(_M32)


def hash31(v: Column) -> Column:
    """31-bit hash of the lower 32 bits: a cubic of the number xored with itself shifted, wrapping at 32 bits."""
    shift, k, a, b = HASH_VALUES
    x = v.bitwiseAND(_M32)
    x = F.shiftleft(x, shift).bitwiseXOR(x).bitwiseAND(_M32)
    inner = (_times32(_times32(x, x), F.lit(k).cast("long")) + a).bitwiseAND(_M32)
    return (_times32(x, inner) + b).bitwiseAND(0x7FFFFFFF)


def uniform(v: Column) -> Column:
    """Between 0 and 1."""
    return hash31(v) / 2147483647.0
