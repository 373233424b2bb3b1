"""Queries over densities, maps and profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import physics, sfc
from ..operators import density, profiles, steps, tree
from ..operators.imaging import grid_colour
from ..sources.views import CORE_SQL, DISK_SQL, core, disk
from .registry import query
from .trees import _CORE_KEYS, _LEVELS, core_keys, r_sql, rounded

H = 0.9
_C = f"WITH c AS MATERIALIZED (SELECT * FROM {CORE_SQL})"
_D = f"WITH d AS MATERIALIZED (SELECT * FROM {DISK_SQL})"


def _pairs_sql(h: str) -> str:
    return f"pr AS MATERIALIZED (SELECT p.id, {h} AS h, pow(p.x - j.x, 2) + pow(p.y - j.y, 2) + pow(p.z - j.z, 2) AS r2, j.mass FROM p, c j WHERE pow(p.x - j.x, 2) + pow(p.y - j.y, 2) + pow(p.z - j.z, 2) < {h} * {h})"


_M4 = f"8e0 / {math.pi!r} / (h * h * h) * CASE WHEN sqrt(r2) / h < 0.5e0 THEN 1 - 6 * pow(sqrt(r2) / h, 2) * (1 - sqrt(r2) / h) WHEN sqrt(r2) / h < 1 THEN 2 * pow(1 - sqrt(r2) / h, 3) ELSE 0 END"
_ROW_H = f"({H}e0 + 0.01e0 * (p.id % 7))"


def _with_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(spark, sf_dir).withColumn("h", F.lit(H) + 0.01 * (F.col("id") % 7))


@query(f"{_C}, p AS (SELECT * FROM c), {_pairs_sql(_ROW_H)} SELECT id, " + r_sql("h", "h") + ", " + r_sql(f"sum(mass * ({_M4}))", "rho") + ", CAST(count(*) AS DOUBLE) AS nnb FROM pr GROUP BY id, h")
def sph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.neighbour_density(_with_h(spark, sf_dir), H), "h", "rho")


_Q4 = f"{3465 / (512 * math.pi)!r}e0 / (h * h * h) * pow(1 - r2 / (h * h), 4)"


@query(f"{_C}, p AS (SELECT * FROM c), {_pairs_sql(_ROW_H)} SELECT id, " + r_sql(f"sum({_Q4})", "rho", 3) + ", sum(ceil(pow(1 - r2 / (h * h), 2))) AS nnb FROM pr GROUP BY id, h")
def quartic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.neighbour_density(_with_h(spark, sf_dir), H, "quartic").drop("h"), "rho", digits=3)


@query(f"{_C}, p AS (SELECT * FROM c), {_pairs_sql(_ROW_H)}, n AS (SELECT id, CAST(count(*) AS DOUBLE) AS nnb FROM pr GROUP BY 1) SELECT count(*) AS rows, min(nnb) AS least, max(nnb) AS most, " + r_sql("avg(nnb)", "mean") + ", " + r_sql("sqrt(greatest(avg(nnb * nnb) - avg(nnb) * avg(nnb), 0))", "sigma") + ", sum(CAST(nnb > 128 AS BIGINT))::BIGINT AS outliers FROM n WHERE nnb >= 3")
def nnb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.neighbour_statistics(density.neighbour_density(_with_h(spark, sf_dir), H, "count")), "mean", "sigma")


_DISK_H = "(0.35e0 + 0.01e0 * (p.id % 11))"


@query(f"{_D}, c AS (SELECT id, x, y, z, mass FROM d), p AS (SELECT * FROM c), " + _pairs_sql(_DISK_H).replace("FROM p, c j WHERE ", "FROM p, c j WHERE j.x BETWEEN p.x - 0.5e0 AND p.x + 0.5e0 AND ") + " SELECT id, " + r_sql("h", "h") + ", " + r_sql(f"sum(mass * ({_M4}))", "rho") + ", CAST(count(*) AS DOUBLE) AS nnb FROM pr GROUP BY id, h")
def disk_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density at every body of the disk."""
    p = disk(spark, sf_dir).withColumn("h", 0.35 + 0.01 * (F.col("id") % 11))
    return rounded(density.neighbour_density(p, 0.45), "h", "rho")


_CLUSTERS = f"SELECT id, mass, x / pow(10e0, id % 4) AS x, y / pow(10e0, id % 4) AS y, z / pow(10e0, id % 4) AS z FROM {CORE_SQL}"
_CLUSTER_H = "(1e0 / pow(10e0, p.id % 4) * (1 + 0.1e0 * (p.id % 5)))"


@query(f"WITH c AS MATERIALIZED ({_CLUSTERS}), p AS (SELECT * FROM c), {_pairs_sql(_CLUSTER_H)} SELECT id, " + r_sql("h", "h", 9) + ", " + r_sql(f"sum(mass * ({_M4}))", "rho", 3) + ", CAST(count(*) AS DOUBLE) AS nnb FROM pr GROUP BY id, h")
def clustered_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters inside one another, with radii over three decades."""
    ten = F.pow(F.lit(10.0), F.col("id") % 4)
    p = core(spark, sf_dir).withColumns({c: F.col(c) / ten for c in "xyz"} | {"h": 1.0 / ten * (1 + 0.1 * (F.col("id") % 5))})
    return rounded(rounded(density.bucket_density(p, 0.01), "rho", digits=3), "h", digits=9)


_ADJ = "h * CASE WHEN nnb > 0 THEN least(greatest(0.5e0 * (1 + cbrt(32e0 / nnb)), {lo}e0), 2e0) ELSE 2e0 END"


@query(f"{_C}, p AS (SELECT * FROM c), {_pairs_sql(_ROW_H)}, n AS (SELECT id, h, CAST(count(*) AS DOUBLE) AS nnb FROM pr GROUP BY 1, 2) SELECT id, " + r_sql(_ADJ.format(lo="0.5"), "h") + " FROM n")
def h_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = density.neighbour_density(_with_h(spark, sf_dir), H, "count")
    return rounded(d.select("id", physics.adjusted_h(F.col("h"), F.col("nnb")).alias("h")), "h")


@query(f"{_C}, p AS (SELECT * FROM c), {_pairs_sql(_ROW_H)}, n AS (SELECT id, h, CAST(count(*) AS DOUBLE) AS nnb FROM pr GROUP BY 1, 2) SELECT id, " + r_sql(f"CASE WHEN id % 3 = 0 THEN h ELSE {_ADJ.format(lo='0.5')} END", "h") + ", CAST(CASE WHEN id % 3 = 0 THEN 0.5e0 ELSE 0.35e0 END AS DOUBLE) AS t_end FROM n")
def corrector_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrector moves the radii of bodies whose step ends towards their wanted neighbours; the others wait."""
    p = _with_h(spark, sf_dir).withColumns({c: F.lit(0.0) for c in ("ax", "ay", "az", "pot", "t_beg")} | {"t_end": F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.25)})
    counts = density.neighbour_density(p, H, "count").select("id", "nnb")
    return rounded(steps.correct(p, p.select("id", "ax", "ay", "az", "pot"), 0.25, 0.1, counts).select("id", "h", "t_end"), "h")


def _solve_sql(rounds: int) -> str:
    out = f"{_C}, p AS (SELECT * FROM c), " + _pairs_sql(_ROW_H).replace("pr AS", "pr0 AS") + ", n0 AS MATERIALIZED (SELECT id, h, CAST(count(*) AS DOUBLE) AS nnb FROM pr0 GROUP BY 1, 2)"
    for i in range(1, rounds):
        out += f", h{i} AS MATERIALIZED (SELECT c.*, {_ADJ.format(lo='0.8')} AS h FROM c JOIN n{i - 1} USING (id)), pr{i} AS MATERIALIZED (SELECT p.id, p.h, pow(p.x - j.x, 2) + pow(p.y - j.y, 2) + pow(p.z - j.z, 2) AS r2, j.mass FROM h{i} p, c j WHERE pow(p.x - j.x, 2) + pow(p.y - j.y, 2) + pow(p.z - j.z, 2) < p.h * p.h), n{i} AS MATERIALIZED (SELECT id, h, CAST(count(*) AS DOUBLE) AS nnb FROM pr{i} GROUP BY 1, 2)"
    last = rounds - 1
    return out + " SELECT id, " + r_sql("h", "h") + ", " + r_sql(f"sum(mass * ({_M4}))", "rho") + f", CAST(count(*) AS DOUBLE) AS nnb FROM pr{last} GROUP BY id, h"


@query(_solve_sql(10))
def solve_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.solve_h(_with_h(spark, sf_dir), H).select("id", "h", "rho", "nnb")
    return rounded(found, "h", "rho")


@query(_CORE_KEYS + _LEVELS + ", s AS (SELECT size FROM cube) SELECT level, prefix AS prefix_hi, n, " + r_sql("m / pow(size / pow(2e0, level), 3)", "rho", 5) + ", " + ", ".join(r_sql(f"com_{c}", c) for c in "xyz") + " FROM nodes, s WHERE is_leaf")
def leaf_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = core_keys(spark, sf_dir)
    size = sfc.cube(keys).first()["size"]
    placed = tree.leaf_of(keys, tree.build_nodes(keys))
    out = density.leaf_density(placed, size).select("level", "prefix_hi", "n", "rho", "x", "y", "z")
    return rounded(rounded(out, "rho", digits=5), "x", "y", "z")


@query(_CORE_KEYS + _LEVELS + ", s AS (SELECT greatest(xmax - xmin, ymax - ymin, zmax - zmin) / 2 / 1048576e0 AS least FROM (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM keys)), v AS (SELECT level, prefix, n, cbrt((2 * hx) * (2 * hy) * (2 * hz)) AS vol FROM nodes WHERE is_leaf) SELECT level, prefix AS prefix_hi, " + r_sql("greatest(CASE WHEN vol > 0 THEN cbrt(42e0 / (n / vol)) ELSE 0 END, least)", "h") + " FROM v, s")
def initial_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = core_keys(spark, sf_dir)
    nodes = tree.node_properties(tree.build_nodes(keys), keys).filter("is_leaf")
    box = sfc.bounding_box(keys)
    least = box.select((F.greatest(*[F.col(f"{c}max") - F.col(f"{c}min") for c in "xyz"]) / 2 / float(1 << 20)).alias("least"))
    h = physics.initial_h(F.col("n"), 2 * F.col("hx"), 2 * F.col("hy"), 2 * F.col("hz"), F.col("least"))
    return rounded(nodes.crossJoin(F.broadcast(least)).select("level", "prefix_hi", h.alias("h")), "h")


def _map_sql(a: str, b: str) -> str:
    d = 40 / 1024
    at = lambda c: f"CAST(floor(({c} + 20e0) / {d!r}e0) AS BIGINT)"
    return f"{_D}, g AS (SELECT {at(a)} AS ix, {at(b)} AS iy, mass, v{a} * v{a} + v{b} * v{b} AS w FROM d WHERE ptype <> 0) SELECT ix, iy, " + r_sql("sum(mass * 2.33e9)", "mass", 0) + ", " + r_sql("sum(w)", "v2") + " FROM g WHERE ix > 0 AND ix < 1024 AND iy > 0 AND iy < 1024 GROUP BY ALL"


@query(_map_sql("x", "y"))
def density_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(profiles.density_map(disk(spark, sf_dir), "xy"), "mass", digits=0), "v2")


@query(_map_sql("x", "z"))
def density_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(profiles.density_map(disk(spark, sf_dir), "xz"), "mass", digits=0), "v2")


_TURN = "degrees(acos(CASE WHEN r > 0 THEN x / r ELSE 1 END))"


@query(f"{_D}, q AS (SELECT *, sqrt(x * x + y * y) AS r FROM d WHERE ptype <> 0), g AS (SELECT CAST(floor(r / 1e0) AS BIGINT) AS ir, CAST(floor((CASE WHEN y > 0 THEN {_TURN} ELSE -{_TURN} END + 180e0) / 2.8125e0) AS BIGINT) AS iphi, mass FROM q), k AS (SELECT iphi, ir, count(*) AS n, sum(mass) AS m FROM g WHERE ir >= 0 AND ir < 20 AND iphi >= 0 AND iphi < 128 GROUP BY ALL) SELECT iphi, ir, n, " + r_sql("m", "mass", 9) + ", " + r_sql("m * 128 / sum(m) OVER (PARTITION BY ir)", "ratio") + " FROM k")
def density_rphi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(profiles.density_rphi(disk(spark, sf_dir)), "mass", digits=9), "ratio")


_PROFILE = f"""{_D}, q AS (SELECT *, sqrt(x * x + y * y) AS r FROM d WHERE ptype <> 0), q2 AS (SELECT *, CAST(floor(r / 0.05e0) AS BIGINT) AS bin, (x * vx + y * vy) / r AS v_r, (x * vy - y * vx) / r AS v_phi, vz AS v_z FROM q WHERE r > 0 AND r < 30),
 q3 AS (SELECT 'all' AS pop, * FROM q2 UNION ALL SELECT CASE ptype WHEN 1 THEN 'bulge' ELSE 'disk' END, * FROM q2),
 s AS (SELECT pop, bin, count(*) AS n, sum(mass) AS mass, sum(v_r) AS s_r, sum(v_phi) AS s_phi, sum(v_z) AS s_z, sum(v_r * v_r) AS q_r, sum(v_phi * v_phi) AS q_phi, sum(v_z * v_z) AS q_z, sum(z * z) AS q_h FROM q3 GROUP BY ALL),
 f AS (SELECT p.pop, b.range AS bin, (b.range + 0.5e0) * 0.05e0 AS r, coalesce(n, 0) AS n, coalesce(mass, 0) AS mass, coalesce(s_r, 0) AS s_r, coalesce(s_phi, 0) AS s_phi, coalesce(s_z, 0) AS s_z, coalesce(q_r, 0) AS q_r, coalesce(q_phi, 0) AS q_phi, coalesce(q_z, 0) AS q_z, coalesce(q_h, 0) AS q_h FROM range(600) b CROSS JOIN (VALUES ('all'), ('bulge'), ('disk')) p(pop) LEFT JOIN s ON s.pop = p.pop AND s.bin = b.range),
 g AS (SELECT *, mass / (2 * pi() * r * 0.05e0) AS sigma, {", ".join(f"CASE WHEN n > 0 THEN s_{v} / n ELSE 0 END AS mean_{v}, CASE WHEN n > 0 THEN sqrt(greatest(q_{v} / n - (s_{v} / n) * (s_{v} / n), 0)) ELSE 0 END AS disp_{v}" for v in ("r", "phi", "z"))}, CASE WHEN n > 0 THEN sqrt(q_h / n) ELSE 0 END AS z_rms FROM f),
 o AS (SELECT *, mean_phi / r AS omega FROM g), w AS (SELECT *, sum(mass) OVER (PARTITION BY pop ORDER BY bin) AS mass_cum, lead(omega) OVER v AS up, lag(omega) OVER v AS dn FROM o WINDOW v AS (PARTITION BY pop ORDER BY bin)),
 k0 AS (SELECT *, sqrt(greatest(0.5e0 * r * (up * up - dn * dn) / 0.05e0 + 4 * omega * omega, 0)) AS k, CASE WHEN omega <> 0 THEN -r * 0.5e0 * (up - dn) / 0.05e0 / omega END AS g FROM w),
 k1 AS (SELECT *, CASE bin WHEN 0 THEN 2 * omega WHEN 599 THEN lag(k) OVER v ELSE k END AS kappa, CASE bin WHEN 0 THEN lead(g) OVER v WHEN 599 THEN lag(g) OVER v ELSE g END AS gamma FROM k0 WINDOW v AS (PARTITION BY pop ORDER BY bin))"""


@query(_PROFILE + " SELECT pop, bin, n, " + ", ".join(r_sql(c, c, 8) for c in ("mass", "sigma", "mean_r", "mean_phi", "mean_z", "disp_r", "disp_phi", "disp_z", "omega", "z_rms", "mass_cum")) + " FROM k1")
def disk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("mass", "sigma", "mean_r", "mean_phi", "mean_z", "disp_r", "disp_phi", "disp_z", "omega", "z_rms", "mass_cum")
    return rounded(profiles.radial_profile(disk(spark, sf_dir)).select("pop", "bin", "n", *cols), *cols, digits=8)


@query(_PROFILE + " SELECT pop, bin, " + r_sql("kappa", "kappa", 5) + ", " + r_sql("gamma", "gamma", 4) + " FROM k1")
def profile_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles.radial_profile(disk(spark, sf_dir))
    return rounded(rounded(p.select("pop", "bin", "kappa", "gamma"), "kappa", digits=5), "gamma", digits=4)


@query(_PROFILE + " SELECT pop, bin, " + ", ".join(r_sql(e, n, 4) for e, n in (("CASE WHEN sigma <> 0 THEN kappa * kappa / sigma END", "m"), ("CASE WHEN sigma <> 0 THEN disp_r * kappa / (3.36e0 * sigma) END", "q"), ("CASE WHEN sigma <> 0 THEN kappa * kappa * r / (2 * pi() * sigma) / 4 END", "x"))) + " FROM k1")
def toomre_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.radial_profile(disk(spark, sf_dir)).select("pop", "bin", "m", "q", "x"), "m", "q", "x", digits=4)


_TABLE = {"r": "r", "vas": "mean_phi * 0.5e0", "drs": "disp_r * 0.5e0", "das": "disp_phi * 0.5e0", "dzs": "disp_z * 0.5e0", "omg": "omega / 2e0", "kapp": "kappa * 0.5e0", "q": "CASE WHEN sigma <> 0 THEN disp_r * kappa / (3.36e0 * sigma) END", "gam": "gamma", "mx": "CASE WHEN sigma <> 0 THEN kappa * kappa * r / (2 * pi() * sigma) / 4 END",
 "sigs": "sigma * 2300e0", "mass": "mass_cum * 2.33e9 / 1e9", "m": "CASE WHEN sigma <> 0 THEN kappa * kappa / sigma END", "zrms": "z_rms", "n": "n"}


def _digits(c: str) -> int:
    return 4 if c in ("q", "gam", "mx", "m") else 8


def _table_sql(pop: str, names: tuple[str, ...], end: str) -> str:
    return ", ".join(r_sql(f"max(CASE WHEN pop = '{pop}' THEN {_TABLE[c]} END)", c + end, _digits(c)) for c in names)


@query(_PROFILE + f" SELECT bin, {_table_sql('all', profiles.TABLE, '')}, {_table_sql('bulge', profiles.TABLE_PART, '_b')}, {_table_sql('disk', profiles.TABLE_PART, '_d')} FROM k1 GROUP BY bin")
def radial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 29 values a bin of the radial table, masses in thousand millions of suns."""
    found = profiles.radial_table(profiles.radial_profile(disk(spark, sf_dir)), velocity=0.5, time=2.0, mass=profiles.MASS_UNIT / 1e9)
    for digits in (4, 8):
        found = rounded(found, *[c for c in found.columns if c != "bin" and _digits(c.split("_")[0]) == digits], digits=digits)
    return found


_CURVE = f"{_D}, cv0 AS (SELECT id, mass, x, y, z, vx, vy, vz, sqrt(x * x + y * y) AS r, sqrt(vx * vx + vy * vy) AS v FROM d WHERE ptype = 2), cv AS (SELECT * FROM cv0 WHERE 0.01e0 * v > abs(vz))"


@query(_CURVE + " SELECT count(*) AS n, " + r_sql("sum(mass)", "mass") + ", " + ", ".join(r_sql(f"sum(mass * ({e})) / sum(mass)", n) for e, n in (("y * vz - z * vy", "lx"), ("z * vx - x * vz", "ly"), ("x * vy - y * vx", "lz"))) + ", " + r_sql("min(r)", "rmin") + ", " + r_sql("max(r)", "rmax") + " FROM cv")
def rotation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.rotation_curve(disk(spark, sf_dir))[1], "mass", "lx", "ly", "lz", "rmin", "rmax")


@query(f"{_D} SELECT count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM d WHERE sqrt(x * x + y * y) BETWEEN 5 AND 6")
def vertical_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.vertical_extent(disk(spark, sf_dir), 5.0, 6.0)


@query(_CURVE + ", c1 AS MATERIALIZED (SELECT r, avg(v) AS v, row_number() OVER (ORDER BY r) AS i FROM cv GROUP BY r), p AS (SELECT id, sqrt(x * x + y * y) AS r FROM d WHERE ptype = 1), b AS (SELECT p.*, (SELECT count(*) FROM c1 WHERE c1.r < p.r) AS i FROM p) SELECT b.id, " + r_sql("lo.v + (b.r - lo.r) * (up.v - lo.v) / (up.r - lo.r)", "v_curve") + " FROM b LEFT JOIN c1 lo ON lo.i = b.i LEFT JOIN c1 up ON up.i = b.i + 2")
def asof_velocity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = disk(spark, sf_dir)
    p = d.filter("ptype = 1").select("id", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("r"))
    return rounded(profiles.interpolate_curve(p, profiles.rotation_curve(d)[0]).select("id", "v_curve"), "v_curve")


@query(_map_sql("x", "y").replace(_D, _D, 1).replace("SELECT ix, iy, ", ", k AS (SELECT ix, iy, ", 1).replace(" GROUP BY ALL", " GROUP BY ALL)", 1) + " SELECT ix, iy, " + r_sql("(ln(v2 + 1) - min(ln(v2 + 1)) OVER ()) / (max(ln(v2 + 1)) OVER () - min(ln(v2 + 1)) OVER ()) * 255", "c", 3) + " FROM k")
def grid_colour_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rounded(profiles.density_map(disk(spark, sf_dir), "xy"), "v2")
    return rounded(grid_colour(g, "v2", log=True).select("ix", "iy", "c"), "c", digits=3)
