"""Kernel density by a radius self-join on grid buckets, adaptive radii, leaf densities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import physics
from ..sources.views import COORDS
from .cut import cut


PART = 1024
#: Into how many parts bodies are dealt while a block, or a part of one, keeps within LEAST_PART and SUMMED_PART askers; doublings of a block's side; rows that a task takes at once.
PARTS, LEAST_PART, SUMMED_PART, WIDEST, ROWS = 12, 2048, 262_144, 8, 50_000
#: Bodies of a cell, askers that look up cells together, and pairs of a tile.
CELL, ASKERS, TILE = 16, 128, 1 << 15
#: Bodies of a part of a bucket, and pairs of a tile, where radii differ much.
BUCKET_PART, BUCKET_TILE = 16_384, 1 << 16
KEY = ("level", *[f"b{c}" for c in COORDS], "at_pa", "at_ph")


def _dealt(p: DataFrame, cell: float, part: int) -> tuple[DataFrame, DataFrame]:
    """(askers: id, h, x, y, z; bodies: jd, jx, jy, jz, jm), both with KEY: the bucket and the part of it in which they meet.

    Buckets come in levels of doubled sides, the least ones of side cell; a body asks at the level whose side its radius fills between a half and the
    whole, so that it meets at most 27 buckets whatever its radius, and a bucket holds the bodies in it at every level that is asked at all. Buckets of more than part bodies, or asked by
    more, are dealt: parts of the askers meet parts of the bodies, and no pair of parts is larger than part squared."""
    level = F.greatest(F.ceil(F.log2(F.col("h") / cell)), F.lit(-60)).cast("int")
    side = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    asks = p.filter("h > 0").select("id", "h", *COORDS, level.alias("level"))
    # as many as there are doublings between the least and the greatest radius
    levels = asks.agg(F.collect_set("level").alias("_levels"))
    for c in COORDS:
        asks = asks.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(c) - F.col("h")) / side).cast("long"), F.floor((F.col(c) + F.col("h")) / side).cast("long"))))
    holds = p.select(F.col("id").alias("jd"), *[F.col(c).alias(f"j{c}") for c in COORDS], F.col("mass").alias("jm")).crossJoin(F.broadcast(levels))
    holds = holds.withColumn("level", F.explode("_levels")).drop("_levels").withColumns({f"b{c}": F.floor(F.col(f"j{c}") / side).cast("long") for c in COORDS})
    key = list(KEY[:4])
    counts = asks.groupBy(*key).agg(F.count("*").alias("_asks")).join(holds.groupBy(*key).agg(F.count("*").alias("_holds")), key)
    dense = counts.filter((F.col("_asks") > part) | (F.col("_holds") > part)).select(*key, F.ceil(F.col("_asks") / part).alias("_pa"), F.ceil(F.col("_holds") / part).alias("_ph"))
    one = F.lit(1).cast("long")
    sides = []
    for rows, own, other, name in ((asks, "_pa", "_ph", "id"), (holds, "_ph", "_pa", "jd")):
        rows = rows.join(dense, key, "left").withColumns({"_pa": F.coalesce("_pa", one), "_ph": F.coalesce("_ph", one)})
        mine, theirs = F.pmod(F.xxhash64(name), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        sides.append(rows.withColumn(f"at{own}", mine).withColumn(f"at{other}", theirs).drop("_pa", "_ph"))
    return sides[0], sides[1]


def bucket_pairs(p: DataFrame, cell: float, part: int = PART) -> DataFrame:
    """(id, h, x, y, z; jd, jx, jy, jz, jm) of bodies and the bodies of the buckets that their balls meet."""
    asks, holds = _dealt(p, cell, part)
    return asks.join(holds, list(KEY))


def neighbours(p: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs (id, h, r2, jm, jd) of every body with all bodies within its own radius h, itself included. cell: side of the least bucket; any gives the same pairs.

    Bodies without a radius above zero have none."""
    r2 = sum(((F.col(c) - F.col(f"j{c}")) * (F.col(c) - F.col(f"j{c}")) for c in COORDS), F.lit(0.0))
    return bucket_pairs(p, cell).withColumn("r2", r2).filter("r2 < h * h").select("id", "h", "r2", "jm", "jd")


def _blocks(p: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(askers: id, h, x, y, z; bodies: jd, jx, jy, jz, jm), both with KEY: the block and the part of it in which they meet.

    Levels are those of buckets, but a block has 2**k buckets a side, as many as its bodies allow: an asker goes to its own block alone, and a body besides to those within the greatest radius
    of the level. So rows go by bodies and the rims of blocks. Blocks that are too large with one bucket are dealt in parts."""
    level = F.greatest(F.ceil(F.log2(F.col("h") / cell)), F.lit(-60)).cast("int")
    asks = p.filter("h > 0").select("id", "h", *COORDS, level.alias("level"))
    # as many as there are doublings between the least and the greatest radius
    reach = {r["level"]: r["h"] for r in asks.groupBy("level").agg(F.max("h").alias("h")).collect()}
    limit = min(max(LEAST_PART, -(-p.count() // PARTS)), SUMMED_PART)
    sides = {v: cell * 2.0**v for v in reach}
    of = lambda values, kind: F.element_at(F.create_map(*[F.lit(x).cast(t) for v in sorted(values) for x, t in ((v, "int"), (values[v], kind))]), F.col("level")) if values else F.lit(None).cast(kind)
    each = F.array(*map(F.lit, sorted(reach))) if reach else F.array().cast("array<int>")
    holds = p.select(F.col("id").alias("jd"), *[F.col(c).alias(f"j{c}") for c in COORDS], F.col("mass").alias("jm"), F.explode(each).alias("level"))
    key, place = list(KEY[:4]), list(KEY[1:4])
    counts = holds.select("level", *[F.floor(F.col(f"j{c}") / of(sides, "double")).alias(f"b{c}") for c in COORDS]).groupBy(*key).agg(F.count("*").alias("n"))
    wider = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WIDEST)))).select("level", "k", *[F.call_function("shiftright", c, F.col("k")).alias(c) for c in place], "n")
    largest = wider.groupBy("level", "k", *place).agg(F.sum("n").alias("n")).groupBy("level", "k").agg(F.max("n").alias("n")).collect()
    wide = {v: max((r["k"] for r in largest if r["level"] == v and r["n"] <= limit), default=0) for v in reach}
    side = of({v: sides[v] * 2.0 ** wide[v] for v in reach}, "double")
    asks = asks.withColumns({f"b{c}": F.floor(F.col(c) / side) for c in COORDS}).dropna(subset=key)
    for c in COORDS:
        j = F.col(f"j{c}")
        # a little farther than any ball, for places that are rounded
        pad = of(reach, "double") * (1 + 1e-9) + F.abs(j) * 1e-15
        holds = holds.withColumn(f"b{c}", F.explode(F.sequence(F.floor((j - pad) / side), F.floor((j + pad) / side))))
    many = asks.groupBy(*key).agg(F.count("*").alias("_asks")).join(holds.groupBy(*key).agg(F.count("*").alias("_holds")), key)
    dense = many.filter((F.col("_asks") > limit) | (F.col("_holds") > 4 * limit)).select(*key, F.ceil(F.col("_asks") / limit).alias("_pa"), F.ceil(F.col("_holds") / (4 * limit)).alias("_ph"))
    # a row for so many bodies
    dense = F.broadcast(cut(dense))
    one, found = F.lit(1).cast("long"), []
    for rows, own, other, name in ((asks, "_pa", "_ph", "id"), (holds, "_ph", "_pa", "jd")):
        rows = rows.join(dense, key, "left").withColumns({"_pa": F.coalesce("_pa", one), "_ph": F.coalesce("_ph", one)})
        mine, theirs = F.pmod(F.xxhash64(name), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        found.append(rows.withColumn(f"at{own}", mine).withColumn(f"at{other}", theirs).drop("_pa", "_ph"))
    return found[0], found[1]


def _celled(place: list[np.ndarray], side: float) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings the bodies of a cell together, where each cell begins and, last, their number). Cells of few bodies are made larger."""
    n = len(place[0])
    low = [c.min() for c in place]
    span = max(max(c.max() - m for c, m in zip(place, low, strict=True)), 1e-300)
    # no more cells a side than there are CELL bodies a cell, were they even
    side = max(side, span / max(1.0, np.ceil((n / CELL) ** (1 / 3))), span / 1024)
    at = [np.minimum((c - m) / side, 1023).astype(np.int64) for c, m in zip(place, low, strict=True)]
    code = (at[0] << 20) | (at[1] << 10) | at[2]
    order = np.argsort(code, kind="stable")
    code = code[order]
    return order, np.append(np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), n)


def _sums(kernel: str):
    """The function that sums what the bodies of the blocks of a group add to its askers."""
    m4_norm, quartic_norm = physics.M4_NORM, physics.QUARTIC_NORM
    # arrays of a tile, made once: new ones cost more than what is worked out in them
    held = [np.empty(max(TILE, ASKERS)) for _ in range(3)]

    def parts(t: pa.Table) -> tuple[np.ndarray, dict[tuple, tuple[int, int]]]:
        """(order that brings the rows of a block's part together, from and to of each)."""
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in KEY])
        order = np.lexsort(key)
        key = key[:, order]
        new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if t.num_rows else np.zeros(0, int)
        return order, dict(zip(map(tuple, key[:, new].T.tolist()), zip(new.tolist(), np.append(new, t.num_rows)[1:].tolist(), strict=True), strict=True))

    def m4(r2: np.ndarray, near: np.ndarray, h: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Densities: 2 (1 - q)^3 within h, less (1 - 2 q)^3 within half of it, is the cubic spline."""
        w, cube = (x[: r2.size].reshape(r2.shape) for x in held[1:])
        q = np.sqrt(r2, out=r2)
        np.multiply(q, (1.0 / h)[:, None], out=q)
        inside = q.min() < 0.5
        np.subtract(1.0, q, out=w)
        np.maximum(w, 0.0, out=w)
        np.multiply(w, w, out=cube)
        np.multiply(w, cube, out=w)
        if inside:
            # (1 - 2 q)^3
            np.multiply(q, -2.0, out=q)
            np.add(q, 1.0, out=q)
            np.maximum(q, 0.0, out=q)
            np.multiply(q, q, out=cube)
            np.multiply(cube, q, out=cube)
            np.multiply(cube, 0.5, out=cube)
            np.subtract(w, cube, out=w)
        with np.errstate(invalid="ignore"):
            # a mass that is no number counts where it is near only
            total = np.einsum("ij,j->i", w, mass) if np.isfinite(mass).all() else np.where(near, w * mass, 0.0).sum(1)
        return 2.0 * m4_norm / (h * h * h) * total

    def quartic(r2: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number density and smoothed count of each row of distances; what is farther than h adds nothing to either."""
        near = np.divide(r2, (h * h)[:, None], out=r2)
        np.subtract(1.0, near, out=near)
        np.maximum(near, 0.0, out=near)
        np.multiply(near, near, out=near)
        count = np.ceil(near, out=held[1][: near.size].reshape(near.shape)).sum(1)
        return quartic_norm / (h * h * h) * np.einsum("ij,ij->i", near, near), count

    def tile(place: list[np.ndarray], h: np.ndarray, other: list[np.ndarray], mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, numbers and whether any was near, of askers by bodies."""
        r2, d = (x[: len(h) * len(mass)].reshape(len(h), len(mass)) for x in held[:2])
        for k, (t, o) in enumerate(zip(place, other, strict=True)):
            out = d if k else r2
            np.subtract(t[:, None], o[None], out=out)
            np.multiply(out, out, out=out)
            if k:
                np.add(r2, d, out=r2)
        near = r2 < (h * h)[:, None]
        number = np.count_nonzero(near, axis=1)
        met = number > 0
        if kernel == "quartic":
            term, number = quartic(r2, h)
        elif kernel == "m4" and met.any():
            term = m4(r2, near, h, mass)
        else:
            term = 0.0
        return term, number, met

    def inner(place: list[np.ndarray], h: np.ndarray, other: list[np.ndarray], mass: np.ndarray) -> np.ndarray:
        """Densities by bodies within half of h alone, where the spline is 1 - 6 q^2 + 6 q^3: squares of distances, as a product of matrices, are summed at once and only their cubes by pairs."""
        centre = [c.mean() for c in place]
        a, b = ([c - m for c, m in zip(xyz, centre, strict=True)] for xyz in (place, other))
        left = np.stack([*(-2.0 * c for c in a), sum(c * c for c in a), np.ones(len(h))], 1)
        right = np.stack([*b, np.ones(len(mass)), sum(c * c for c in b)])
        cubes, width = np.zeros(len(h)), max(1, TILE // len(h))
        for at in range(0, len(mass), width):
            weight = mass[at : at + width]
            r2, r = (x[: len(h) * len(weight)].reshape(len(h), len(weight)) for x in held[:2])
            np.matmul(left, right[:, at : at + width], out=r2)
            np.maximum(r2, 0.0, out=r2)
            np.sqrt(r2, out=r)
            np.multiply(r2, r, out=r2)
            cubes += np.einsum("ij,j->i", r2, weight)
        h3 = h * h * h
        return m4_norm / h3 * (mass.sum() - 6.0 * (left @ (right @ mass)) / (h * h) + 6.0 * cubes / h3)

    def block(place: list[np.ndarray], h: np.ndarray, other: list[np.ndarray], mass: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        """Adds to found what bodies give to askers. Cells of bodies out of reach of a cell of askers are passed over; those wholly within are counted at once where only numbers are asked, and take the cheaper form of the spline within half of the radius."""
        rho, nnb, met = found
        side = h.min() / 4
        order, starts = _celled(other, side)
        other, mass = [c[order] for c in other], mass[order]
        low, high = ([f.reduceat(c, starts[:-1]) for c in other] for f in (np.minimum, np.maximum))
        size, finite = np.diff(starts), bool(np.isfinite(mass).all())
        mine, own = _celled(place, side)
        for i, j in zip(own[:-1], own[1:], strict=True):
            for a in range(i, j, ASKERS):
                rows = mine[a : min(j, a + ASKERS)]
                at, radius = [c[rows] for c in place], h[rows]
                gap2, far2 = 0.0, 0.0
                for c, lo, hi in zip(at, low, high, strict=True):
                    least, most = c.min(), c.max()
                    gap = np.maximum(np.maximum(lo - most, least - hi), 0.0)
                    far = np.maximum(hi - least, most - lo)
                    gap2, far2 = gap2 + gap * gap, far2 + far * far
                # what rounding could turn is compared pair by pair
                meets = gap2 <= radius.max() ** 2 * (1 + 1e-9)
                if kernel == "count":
                    within = far2 < radius.min() ** 2 * (1 - 1e-9)
                    number = size[within].sum()
                    nnb[rows] += number
                    met[rows] |= number > 0
                    meets &= ~within
                elif kernel == "m4" and finite:
                    half = far2 < (radius.min() / 2) ** 2 * (1 - 1e-9)
                    if half.any():
                        chosen = np.flatnonzero(np.repeat(half, size))
                        rho[rows] += inner(at, radius, [c[chosen] for c in other], mass[chosen])
                        nnb[rows] += len(chosen)
                        met[rows] = True
                        meets &= ~half
                if meets.all():
                    near, weight = other, mass
                else:
                    chosen = np.flatnonzero(np.repeat(meets, size))
                    near, weight = [c[chosen] for c in other], mass[chosen]
                width = max(1, TILE // len(rows))
                for b in range(0, len(weight), width):
                    term, number, any_ = tile(at, radius, [c[b : b + width] for c in near], weight[b : b + width])
                    rho[rows] += term
                    nnb[rows] += number
                    met[rows] |= any_

    def run(asks: pa.Table, holds: pa.Table) -> pa.Table:
        order, mine = parts(asks)
        at, theirs = parts(holds)
        place, h = [asks[c].to_numpy()[order] for c in COORDS], asks["h"].to_numpy()[order]
        other, mass = [holds[f"j{c}"].to_numpy()[at] for c in COORDS], holds["jm"].to_numpy()[at]
        rho, nnb, met = np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h), bool)
        # what has no finite place is near nothing
        known, held = (np.logical_and.reduce([np.isfinite(c) for c in xyz]) for xyz in (place, other))
        for key in mine.keys() & theirs.keys():
            rows, cols = (lo + np.flatnonzero(ok[lo:hi]) for ok, (lo, hi) in ((known, mine[key]), (held, theirs[key])))
            if len(rows) and len(cols):
                found = rho[rows], nnb[rows], met[rows]
                block([c[rows] for c in place], h[rows], [c[cols] for c in other], mass[cols], found)
                rho[rows], nnb[rows], met[rows] = found
        return pa.table([asks["id"].take(pa.array(order[met])), pa.array(h[met]), pa.array(rho[met]), pa.array(nnb[met])], names=["id", "h", "rho", "nnb"])

    return run


def neighbour_density(p: DataFrame, cell: float, kernel: str = "m4") -> DataFrame:
    """id, h, rho, nnb. m4: mass density and number of neighbours; quartic: number density and its smoothed neighbour count; count: the number of neighbours alone, rho is 0.

    Blocks of buckets are summed where they meet, so rows go by bodies and blocks and not by pairs."""
    asks, holds = _blocks(p.withColumns({c: F.col(c).cast("double") for c in (*COORDS, "h")} | {"mass": F.coalesce(F.col("mass").cast("double"), F.lit(0.0))}), cell)
    groups = 1 + (asks.count() + holds.count()) // ROWS
    group = F.pmod(F.xxhash64(*KEY), F.lit(groups)).cast("int")
    # a task a group: they are few bytes and much work
    sides = [rows.withColumn("_g", group).repartition(groups, "_g").groupBy("_g") for rows in (asks, holds.drop("jd"))]
    schema = f"id {p.schema['id'].dataType.simpleString()}, h double, rho double, nnb double"
    found = sides[0].cogroup(sides[1]).applyInArrow(_sums(kernel), schema)
    return found.groupBy("id", "h").agg(F.sum("rho").alias("rho"), F.sum("nnb").alias("nnb"))


def _bucket_sums(kernel: str):
    """The function that sums what the bodies of the buckets of a group add to its askers."""
    m4_norm, quartic_norm = physics.M4_NORM, physics.QUARTIC_NORM

    def parts(t: pa.Table) -> tuple[np.ndarray, dict[tuple, tuple[int, int]]]:
        """(order that brings the rows of a bucket's part together, from and to of each)."""
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in KEY])
        order = np.lexsort(key)
        key = key[:, order]
        new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if t.num_rows else np.zeros(0, int)
        return order, dict(zip(map(tuple, key[:, new].T.tolist()), zip(new.tolist(), np.append(new, t.num_rows)[1:].tolist(), strict=True), strict=True))

    def m4(r2: np.ndarray, h: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Terms of the density."""
        q = np.sqrt(r2) / h
        rest = 1.0 - q
        return mass * (m4_norm / (h * h * h) * np.where(q < 0.5, 1.0 - 6.0 * q * q * rest, 2.0 * rest * rest * rest))

    def quartic(r2: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number density and smoothed count of each row of distances; what is farther than h adds nothing to either."""
        near = r2 / (h * h)[:, None]
        np.subtract(1.0, near, out=near)
        np.maximum(near, 0.0, out=near)
        np.multiply(near, near, out=near)
        count = np.ceil(near).sum(1)
        return quartic_norm / (h * h * h) * np.einsum("ij,ij->i", near, near), count

    def run(asks: pa.Table, holds: pa.Table) -> pa.Table:
        order, mine = parts(asks)
        at, theirs = parts(holds)
        place, h = [asks[c].to_numpy()[order] for c in COORDS], asks["h"].to_numpy()[order]
        other, mass = [holds[f"j{c}"].to_numpy()[at] for c in COORDS], holds["jm"].to_numpy()[at]
        rho, nnb, met = np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h), bool)
        for key in mine.keys() & theirs.keys():
            (lo, hi), (a, b) = mine[key], theirs[key]
            width = min(b - a, BUCKET_TILE)
            for i in range(lo, hi, max(1, BUCKET_TILE // width)):
                rows = slice(i, min(hi, i + max(1, BUCKET_TILE // width)))
                for j in range(a, b, width):
                    cols = slice(j, min(b, j + width))
                    d = [t[rows, None] - o[None, cols] for t, o in zip(place, other, strict=True)]
                    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                    near = r2 < (h[rows] * h[rows])[:, None]
                    found = np.count_nonzero(near, axis=1)
                    met[rows] |= found > 0
                    if kernel == "quartic":
                        term, found = quartic(r2, h[rows])
                        rho[rows] += term
                    elif kernel == "m4" and found.any():
                        of, by = np.nonzero(near)
                        rho[rows] += np.bincount(of, m4(r2[of, by], h[rows][of], mass[cols][by]), rows.stop - rows.start)
                    nnb[rows] += found
        return pa.table([asks["id"].take(pa.array(order[met])), pa.array(h[met]), pa.array(rho[met]), pa.array(nnb[met])], names=["id", "h", "rho", "nnb"])

    return run


def bucket_density(p: DataFrame, cell: float, kernel: str = "m4") -> DataFrame:
    """As neighbour_density, for radii that differ much: an asker goes to the buckets that its ball meets.

    Parts of buckets are summed where they meet, so rows go by bodies and buckets and not by pairs."""
    asks, holds = _dealt(p.withColumns({c: F.col(c).cast("double") for c in (*COORDS, "h")} | {"mass": F.coalesce(F.col("mass").cast("double"), F.lit(0.0))}), cell, BUCKET_PART)
    holds = holds.dropna(subset=list(KEY))
    groups = 1 + (asks.count() + holds.count()) // ROWS
    group = F.pmod(F.xxhash64(*KEY), F.lit(groups)).cast("int")
    # a task a group: they are few bytes and much work
    sides = [rows.withColumn("_g", group).repartition(groups, "_g").groupBy("_g") for rows in (asks, holds)]
    schema = f"id {p.schema['id'].dataType.simpleString()}, h double, rho double, nnb double"
    found = sides[0].cogroup(sides[1]).applyInArrow(_bucket_sums(kernel), schema)
    return found.groupBy("id", "h").agg(F.sum("rho").alias("rho"), F.sum("nnb").alias("nnb"))


def solve_h(p: DataFrame, cell: float, target: float = 32.0, rounds: int = 10, lo: float = 0.8, hi: float = 2.0) -> DataFrame:
    """p (with h) after rounds of counting neighbours and adjusting h, with rho and nnb of the last count."""
    for i in range(rounds):
        found = bucket_density(p, cell, "m4" if i == rounds - 1 else "count")
        if i == rounds - 1:
            return p.drop("h").join(found, "id")
        adjusted = found.select("id", physics.adjusted_h(F.col("h"), F.col("nnb"), target, lo, hi).alias("h"))
        p = cut(p.drop("h").join(adjusted, "id"))
    return p


def neighbour_statistics(d: DataFrame, least: int = 3, outlier: int = 128) -> DataFrame:
    """Over rows with at least least neighbours: count, least, most, mean, spread and the number above outlier."""
    n = F.col("nnb")
    kept = d.filter(n >= least)
    return kept.agg(F.count("*").alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.sqrt(F.greatest(F.avg(n * n) - F.avg(n) * F.avg(n), F.lit(0.0))).alias("sigma"), F.sum((n > outlier).cast("long")).alias("outliers"))


def leaf_density(placed: DataFrame, size: float) -> DataFrame:
    """Per leaf (level, prefix) of placed bodies: mean place and velocity by mass, n, mass over the volume of its cell. size: side of the root."""
    m = F.col("mass")
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    out = placed.groupBy("level", "prefix_hi", "prefix_lo").agg(F.count("*").alias("n"), F.sum(m).alias("mass"), *[F.sum(m * F.col(c)).alias(f"s{c}") for c in (*COORDS, "vx", "vy", "vz")])
    return out.select("level", "prefix_hi", "prefix_lo", "n", "mass", *[F.try_divide(f"s{c}", "mass").alias(c) for c in (*COORDS, "vx", "vy", "vz")], (F.col("mass") / (side * side * side)).alias("rho"), side.alias("side"))
