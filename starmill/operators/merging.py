"""Frames of reference, unions of models and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import physics
from ..sources.views import COORDS
from .cut import numbered
from .steps import parabolic_encounter

PHASE = (*COORDS, "vx", "vy", "vz")


def centre_of_mass(p: DataFrame) -> DataFrame:
    m = F.col("mass")
    return p.agg(F.sum(m).alias("com_mass"), *[F.try_divide(F.sum(m * F.col(c)), F.sum(m)).alias(f"com_{c}") for c in PHASE])


def recentre(p: DataFrame) -> DataFrame:
    """p with centre of mass at rest in the origin."""
    return p.crossJoin(F.broadcast(centre_of_mass(p))).withColumns({c: F.col(c) - F.col(f"com_{c}") for c in PHASE}).select(*p.columns)


def rotated(p: DataFrame, matrix: list[list[float]]) -> DataFrame:
    place = physics.rotate(tuple(F.col(c) for c in COORDS), matrix)
    speed = physics.rotate(tuple(F.col(f"v{c}") for c in COORDS), matrix)
    return p.withColumns(dict(zip(PHASE, (*place, *speed), strict=True)))


def relative_to(p: DataFrame, where: str, order: str = "id") -> DataFrame:
    """Places and velocities relative to the last row (in order) that satisfies where."""
    ref = p.filter(where).agg(F.max(F.struct(order, *PHASE)).alias("_r")).select(*[F.col(f"_r.{c}").alias(f"_{c}") for c in PHASE])
    return p.crossJoin(F.broadcast(ref)).withColumns({c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in PHASE}).select(*p.columns)


def merge(a: DataFrame, b: DataFrame, pericentre: float, separation: float, mass_scale: float = 1.0, size_scale: float = 1.0, speed_scale: float = 1.0, spin_a=None, spin_b=None, new_ids: bool = False) -> DataFrame:
    """Both galaxies, each centred and turned, on a parabola in the frame of their common centre of mass; column galaxy is 1 or 2.

    With new_ids the second one's ids continue from the largest of the first, in order."""
    m1 = a.agg(F.sum("mass")).first()[0]
    m2 = b.agg(F.sum("mass")).first()[0] * mass_scale
    orbit = parabolic_encounter(m1, m2, pericentre, separation)
    sides = []
    for p, spin, mu, ms, ds, vs, number in ((a, spin_a, m2 / (m1 + m2), 1.0, 1.0, 1.0, 1), (b, spin_b, -m1 / (m1 + m2), mass_scale, size_scale, speed_scale, 2)):
        p = recentre(p)
        p = rotated(p, physics.euler(*spin)) if spin else p
        shift = {"x": orbit["x"], "y": orbit["y"], "z": 0.0, "vx": orbit["vx"], "vy": orbit["vy"], "vz": 0.0}
        moved = {c: F.col(c) * (vs if c[0] == "v" else ds) + mu * shift[c] for c in PHASE}
        sides.append(p.withColumns(moved | {"mass": F.col("mass") * ms}).withColumn("galaxy", F.lit(number)))
    return renumber(*sides) if new_ids else sides[0].unionByName(sides[1])


def merge_tagged(a: DataFrame, b: DataFrame, turn_a: list[list[float]], turn_b: list[list[float]], offset: dict[str, float], sun: str | Column, centre: str | Column, sun_id: int = 29_999_999, centre_id: int = 29_999_998, required: bool = True) -> DataFrame:
    """Two galaxies, each turned, the second moved by offset (x .. vz), all about the common centre of mass; column galaxy is 1 or 2.

    The first row of a (in order of id, before it is turned) that satisfies sun and the first of b that satisfies centre get ids of their own;
    with required, ValueError is raised where a set has no such row, otherwise its ids stay."""
    one = rotated(tag_first(a, sun, sun_id, required=required), turn_a).withColumn("galaxy", F.lit(1))
    two = rotated(tag_first(b, centre, centre_id, required=required), turn_b).withColumns({c: F.col(c) + offset[c] for c in PHASE}).withColumn("galaxy", F.lit(2))
    return recentre(one.unionByName(two))


def attribute_ranges(p: DataFrame, columns: list[str]) -> DataFrame:
    """name, least, most of each attribute, in one pass."""
    ends = p.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)])
    return ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_min").cast("double").alias("least"), F.col(f"{c}_max").cast("double").alias("most")) for c in columns])).alias("r")).select("r.*")


#: Rows of one id are told apart by what else they hold.
ORDER = ("id", "mass", *PHASE)


def renumber(a: DataFrame, b: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """a as it is and b with ids that continue from a's largest, in order; rows alike in all of order take their numbers in any order."""
    top = a.agg(F.max("id").alias("_top"))
    new = numbered(b, *[c for c in order if c in b.columns], name="_rn").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_rn")).select(*b.columns)
    return a.unionByName(new)


def renumber_by_class(a: DataFrame, b: DataFrame, by: str = "ptype", order: tuple[str, ...] = ORDER) -> DataFrame:
    """b's ids continue from a's largest of the same class, in order within the class; classes are few."""
    top = a.groupBy(by).agg(F.max("id").alias("_top"))
    rows = numbered(b, by, *[c for c in order if c in b.columns], name="_rn")
    first = rows.groupBy(by).agg(F.min("_rn").alias("_first"))
    rows = rows.join(F.broadcast(first), by).join(F.broadcast(top), by, "left")
    new = rows.withColumn("id", F.coalesce("_top", F.lit(-1).cast("long")) + F.col("_rn") - F.col("_first") + 1).select(*b.columns)
    return a.unionByName(new)


def tag_first(p: DataFrame, where: str | Column, new_id: int, order: str = "id", required: bool = True) -> DataFrame:
    """p with new_id given to the first row in order that satisfies where; if there is none, ValueError is raised or, unless required, ids stay."""
    first = p.filter(where).agg(F.min(order).alias("_at"))
    if required and first.first()[0] is None:
        raise ValueError("no row satisfies the condition")
    return p.crossJoin(F.broadcast(first)).withColumn("id", F.when(F.col(order) == F.col("_at"), F.lit(new_id).cast("long")).otherwise(F.col("id"))).drop("_at")


def quality(p: DataFrame) -> DataFrame:
    """Number of rows with a NaN or null, with mass not above zero, and in all."""
    odd = F.lit(False)
    for c in (*PHASE, "mass"):
        odd = odd | F.col(c).isNull() | F.isnan(c)
    return p.agg(F.coalesce(F.sum(odd.cast("long")), F.lit(0)).alias("odd"), F.coalesce(F.sum((~odd & (F.col("mass") <= 0)).cast("long")), F.lit(0)).alias("massless"), F.count("*").alias("n"))


def renderable(p: DataFrame, largest: float = 100.0) -> DataFrame:
    """Rows with a density, a radius, and none too large."""
    return p.filter(F.col("rho").isNotNull() & F.col("h").isNotNull() & (F.col("rho") != 0) & (F.col("h") != 0) & (F.col("h") <= largest))


def whole_snapshot(stars: DataFrame, dark: DataFrame) -> DataFrame:
    """Stars then dark matter with speed, and density and radius 0 where they are missing."""
    rows = stars.unionByName(dark, allowMissingColumns=True)
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    fill = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in ("rho", "h")}
    return rows.withColumns({"speed": speed} | fill)


def sane_time(t: Column) -> Column:
    return F.when(F.abs(t) > 1e11, 0.0).otherwise(t)
