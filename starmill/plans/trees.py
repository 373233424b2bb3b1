"""Queries over keys, the octree and gravity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sfc
from ..operators import gravity, tree
from ..operators.cut import cut
from ..sources.views import CORE_SQL, DISK_SQL, core, disk
from .registry import query

AXES = "xyz"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """df with float columns rounded, and -0.0 as 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in cols})


def r_sql(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def cube_sql(view: str) -> str:
    return f"""cube AS (SELECT size, (xmin + xmax) * 0.5e0 - size * 0.5e0 AS cx, (ymin + ymax) * 0.5e0 - size * 0.5e0 AS cy, (zmin + zmax) * 0.5e0 - size * 0.5e0 AS cz FROM
 (SELECT *, greatest(xmax - xmin, ymax - ymin, zmax - zmin) * 1.001e0 AS size FROM (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM {view})))"""


def grid_sql(view: str, bits: int = 30) -> str:
    cell = f"(size / {float(1 << bits)!r}e0)"
    return f"grid AS MATERIALIZED (SELECT p.*, " + ", ".join(f"CAST(round(({c} - c{c}) / {cell}) AS BIGINT) AS i{c}" for c in AXES) + f" FROM {view} p, cube)"


def keys_sql(view: str) -> str:
    """CTEs up to keys(p.*, key_hi, key_lo)."""
    full = (1 << 30) - 1
    o = "(((x >> (b - 1)) & 1) * 4 + ((y >> (b - 1)) & 1) * 2 + ((z >> (b - 1)) & 1))"
    digit = "[0, 1, 7, 6, 3, 2, 4, 5][o + 1]"
    return f"""WITH RECURSIVE {cube_sql(view)}, {grid_sql(view)},
 curve AS (SELECT id, 30 AS b, ix AS x, iz AS y, iy AS z, CAST(0 AS BIGINT) AS hi, CAST(0 AS BIGINT) AS lo FROM grid
  UNION ALL SELECT id, b - 1,
   CASE WHEN o IN (1, 5) THEN y WHEN o IN (4, 6) THEN {full} - x WHEN o IN (3, 7) THEN {full} - y ELSE x END,
   CASE WHEN o = 0 THEN z WHEN o IN (1, 5) THEN x WHEN o IN (4, 6) THEN y WHEN o IN (3, 7) THEN {full} - x ELSE {full} - z END,
   CASE WHEN o = 0 THEN y WHEN o IN (1, 5) THEN z WHEN o IN (4, 6) THEN {full} - z WHEN o IN (3, 7) THEN z ELSE {full} - y END,
   CASE WHEN b > 10 THEN hi * 8 + {digit} ELSE hi END, CASE WHEN b > 10 THEN lo ELSE lo * 8 + {digit} END
   FROM (SELECT *, {o} AS o FROM curve WHERE b > 0)),
 keys AS MATERIALIZED (SELECT g.* EXCLUDE (ix, iy, iz), hi AS key_hi, lo AS key_lo FROM grid g JOIN curve c USING (id) WHERE b = 0)"""


_LEVELS = """,
 lev AS MATERIALIZED (SELECT keys.*, l.level, key_hi >> CAST(3 * (20 - l.level) AS BIGINT) AS prefix FROM keys, (SELECT CAST(range AS INTEGER) AS level FROM range(21)) l),
 cnt AS MATERIALIZED (SELECT level, prefix, count(*) AS n FROM lev GROUP BY ALL),
 start AS (SELECT coalesce(min(level), 0) AS s FROM (SELECT level, count(*) AS c FROM cnt GROUP BY 1) WHERE c > 16),
 leafat AS MATERIALIZED (SELECT id, min(level) AS leaf FROM lev JOIN cnt USING (level, prefix) WHERE n <= 16 AND level > (SELECT s FROM start) GROUP BY 1),
 inside AS MATERIALIZED (SELECT lev.*, leaf FROM lev JOIN leafat USING (id) WHERE level <= leaf),
 nodes0 AS MATERIALIZED (SELECT level, prefix, count(*) AS n, bool_and(level = leaf) AS is_leaf, sum(mass) AS m, sum(mass * x) AS mx, sum(mass * y) AS my, sum(mass * z) AS mz,
  sum(mass * x * x) AS sxx, sum(mass * y * y) AS syy, sum(mass * z * z) AS szz, sum(mass * x * y) AS sxy, sum(mass * x * z) AS sxz, sum(mass * y * z) AS syz,
  (min(x) + max(x)) * 0.5e0 AS bx, (min(y) + max(y)) * 0.5e0 AS by_, (min(z) + max(z)) * 0.5e0 AS bz, (max(x) - min(x)) * 0.5e0 AS hx, (max(y) - min(y)) * 0.5e0 AS hy, (max(z) - min(z)) * 0.5e0 AS hz FROM inside GROUP BY ALL),
 nodes1 AS MATERIALIZED (SELECT a.*, coalesce(k.n_child, 0) AS n_child, mx / m AS com_x, my / m AS com_y, mz / m AS com_z FROM nodes0 a LEFT JOIN (SELECT level - 1 AS level, prefix >> 3 AS prefix, count(*) AS n_child FROM nodes0 WHERE level > 0 GROUP BY ALL) k USING (level, prefix)),
 nodes AS MATERIALIZED (SELECT *, sxx / m - com_x * com_x AS q11, syy / m - com_y * com_y AS q22, szz / m - com_z * com_z AS q33, sxy / m - com_x * com_y AS q12, sxz / m - com_x * com_z AS q13, syz / m - com_y * com_z AS q23,
  CASE WHEN n = 1 THEN 1e11 ELSE pow(greatest(2e0 * greatest(hx, hy, hz), 1e-6) / 0.75e0 + sqrt((bx - com_x) * (bx - com_x) + (by_ - com_y) * (by_ - com_y) + (bz - com_z) * (bz - com_z)), 2) END AS open2 FROM nodes1)"""

_GROUPS = """,
 num AS MATERIALIZED (SELECT keys.*, row_number() OVER (ORDER BY key_hi, key_lo, id) AS rn, key_hi >> CAST(3 * (20 - (SELECT s + 1 FROM start)) AS BIGINT) AS gp FROM keys),
 cuts AS MATERIALIZED (SELECT *, CAST((rn - 1) % 64 = 0 OR rn = min(rn) OVER (PARTITION BY gp) AS BIGINT) AS c FROM num),
 grouped AS MATERIALIZED (SELECT *, CAST(sum(c) OVER (ORDER BY rn) AS BIGINT) AS group_id FROM cuts),
 boxes AS MATERIALIZED (SELECT group_id, min(rn) AS first_rn, max(rn) AS last_rn, count(*) AS n, (min(x) + max(x)) * 0.5e0 AS gx, (min(y) + max(y)) * 0.5e0 AS gy, (min(z) + max(z)) * 0.5e0 AS gz, (max(x) - min(x)) * 0.5e0 AS ex, (max(y) - min(y)) * 0.5e0 AS ey, (max(z) - min(z)) * 0.5e0 AS ez FROM grouped GROUP BY 1)"""

_FAR = "pow(greatest(abs(gx - com_x) - ex, 0), 2) + pow(greatest(abs(gy - com_y) - ey, 0), 2) + pow(greatest(abs(gz - com_z) - ez, 0), 2) > open2"
_WALK = f""",
 walk AS (SELECT group_id, level, prefix, is_leaf, {_FAR} AS far FROM boxes, nodes WHERE level = (SELECT s FROM start)
  UNION ALL SELECT w.group_id, k.level, k.prefix, k.is_leaf, {_FAR.replace("gx", "g.gx").replace("open2", "k.open2")} FROM walk w JOIN boxes g ON g.group_id = w.group_id JOIN nodes k ON k.level = w.level + 1 AND k.prefix >> 3 = w.prefix WHERE NOT w.far AND NOT w.is_leaf)"""

_CORE_KEYS = keys_sql(CORE_SQL)


def core_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies with their keys, found once: every level of a tree reads them."""
    return cut(sfc.sfc_keys(core(spark, sf_dir)))


@query("SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM " + DISK_SQL)
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sfc.bounding_box(disk(spark, sf_dir))


@query(_CORE_KEYS + " SELECT id, key_hi, key_lo FROM keys")
def hilbert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sfc.sfc_keys(core(spark, sf_dir)).select("id", "key_hi", "key_lo")


def _interleave(bits: int) -> str:
    return " + ".join(f"(((i{c} >> {b}) & 1) << {3 * b + s})" for b in range(bits) for c, s in (("x", 2), ("y", 1), ("z", 0)))


_MORTON = f"WITH {cube_sql(DISK_SQL)}, {grid_sql(DISK_SQL, 10)}, k AS (SELECT id, ix, iy, iz, {_interleave(11)} AS key FROM grid) "


@query(_MORTON + "SELECT id, key, row_number() OVER (ORDER BY key, id) AS place FROM k")
def morton_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cut import numbered

    g = sfc.grid_coordinates(disk(spark, sf_dir), 10)
    return numbered(g.select("id", sfc.morton(F.col("ix"), F.col("iy"), F.col("iz")).alias("key")), "key", "id", name="place").select("id", "key", "place")


@query(_MORTON + "SELECT id, ix, iy, iz FROM k")
def morton_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid coordinates recovered from the keys."""
    g = sfc.grid_coordinates(disk(spark, sf_dir), 10).select("id", sfc.morton(F.col("ix"), F.col("iy"), F.col("iz")).alias("key"))
    return g.select("id", *[c.alias(f"i{a}") for a, c in zip(AXES, sfc.morton_inverse(F.col("key")), strict=True)])


@query(_CORE_KEYS + ", l AS (SELECT CAST(range AS INTEGER) AS level FROM range(1, 9)) SELECT level, CAST((key_hi >> CAST(3 * (20 - level) AS BIGINT)) & 7 AS INTEGER) AS octant, count(*) AS n FROM keys, l GROUP BY ALL")
def octant_counts_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sfc.sfc_keys(core(spark, sf_dir)).select(F.explode(F.array(*[F.struct(F.lit(i).alias("level"), sfc.octant(F.col("key_hi"), i).alias("octant")) for i in range(1, 9)])).alias("o"))
    return keys.groupBy("o.level", "o.octant").agg(F.count("*").alias("n"))


@query(_CORE_KEYS + _LEVELS + " SELECT level, prefix AS prefix_hi, CAST(0 AS BIGINT) AS prefix_lo, n, is_leaf FROM nodes")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.build_nodes(core_keys(spark, sf_dir).select("id", "key_hi", "key_lo"))


_PROPS = ["mass", "com_x", "com_y", "com_z", "q11", "q22", "q33", "q12", "q13", "q23"]


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = core_keys(spark, sf_dir)
    return tree.node_properties(tree.build_nodes(keys), keys)


@query(_CORE_KEYS + _LEVELS + " SELECT level, prefix AS prefix_hi, n, n_child, " + r_sql("m", "mass") + ", " + ", ".join(r_sql(c, c) for c in _PROPS[1:]) + " FROM nodes")
def multipoles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_props(spark, sf_dir).select("level", "prefix_hi", "n", "n_child", *_PROPS), *_PROPS)


@query(_CORE_KEYS + _LEVELS + " SELECT level, prefix AS prefix_hi, is_leaf, " + ", ".join(r_sql(a, b) for a, b in (("bx", "cx"), ("by_", "cy"), ("bz", "cz"), ("hx", "hx"), ("hy", "hy"), ("hz", "hz"), ("open2", "open2"))) + " FROM nodes")
def opening_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["cx", "cy", "cz", "hx", "hy", "hz", "open2"]
    return rounded(_props(spark, sf_dir).select("level", "prefix_hi", "is_leaf", *cols), *cols)


@query(_CORE_KEYS + _LEVELS + ", num AS (SELECT id, row_number() OVER (ORDER BY key_hi, key_lo, id) AS rn FROM keys) SELECT level, prefix AS prefix_hi, min(rn) AS first_rn, max(rn) AS last_rn FROM inside JOIN num USING (id) WHERE level = leaf GROUP BY ALL")
def leaf_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = tree.ordered(sfc.sfc_keys(core(spark, sf_dir)))
    return tree.level_ranges(keyed, tree.build_nodes(keyed)).select("level", "prefix_hi", "first_rn", "last_rn")


@query(_CORE_KEYS + ", num AS (SELECT id, row_number() OVER (ORDER BY key_hi, key_lo, id) AS rn, key_hi >> 51 AS p FROM keys) SELECT id, rn, rn = min(rn) OVER (PARTITION BY p) AS head, rn = max(rn) OVER (PARTITION BY p) AS tail FROM num")
def key_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and tail flags of the runs of one node at level 3."""
    return tree.runs_of(tree.ordered(sfc.sfc_keys(core(spark, sf_dir))), 3).select("id", "rn", "head", "tail")


_BOX = ["gx", "gy", "gz", "ex", "ey", "ez"]


@query(_CORE_KEYS + _LEVELS + _GROUPS + " SELECT group_id, first_rn, last_rn, n, " + ", ".join(r_sql(c, c) for c in _BOX) + " FROM boxes")
def group_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = tree.ordered(sfc.sfc_keys(core(spark, sf_dir)))
    return rounded(tree.group_boxes(tree.make_groups(keyed, tree.start_level(keyed))), *_BOX)


@query(_CORE_KEYS + _LEVELS + _GROUPS + _WALK + " SELECT group_id, sum(CAST(far AS BIGINT))::BIGINT AS accepted, sum(CAST(NOT far AND is_leaf AS BIGINT))::BIGINT AS opened FROM walk GROUP BY 1")
def walk_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, grouped, start = gravity.plan_tree(core(spark, sf_dir))
    a, o = gravity.walk(props, tree.group_boxes(grouped), start)
    rows = a.select("group_id", F.lit(1).alias("a"), F.lit(0).alias("o")).union(o.select("group_id", F.lit(0), F.lit(1)))
    return rows.groupBy("group_id").agg(F.sum("a").alias("accepted"), F.sum("o").alias("opened"))


_PULL = "(pow(j.x - p.x, 2) + pow(j.y - p.y, 2) + pow(j.z - p.z, 2) + 0.05e0 * 0.05e0)"
_ACC = ["ax", "ay", "az", "pot"]
_DIRECT_TERMS = ", ".join(f"j.mass * (j.{c} - p.{c}) / ({_PULL} * sqrt({_PULL})) AS a{c}" for c in AXES) + f", -j.mass / sqrt({_PULL}) AS pot"
_D = {c: f"(p.{c} - k.com_{c})" for c in AXES}
_U = {"x": f"(q11 * {_D['x']} + q12 * {_D['y']} + q13 * {_D['z']})", "y": f"(q12 * {_D['x']} + q22 * {_D['y']} + q23 * {_D['z']})", "z": f"(q13 * {_D['x']} + q23 * {_D['y']} + q33 * {_D['z']})"}
_CELL = f"""cell AS (SELECT p.id, k.m, {", ".join(f"{_D[c]} AS d{c}, {_U[c]} AS u{c}" for c in AXES)}, q11 + q22 + q33 AS tr, {" + ".join(f"{_D[c]} * {_D[c]}" for c in AXES)} + 0.05e0 * 0.05e0 AS r2 FROM walk w JOIN nodes k USING (level, prefix) JOIN grouped p ON p.group_id = w.group_id WHERE w.far),
 cell2 AS (SELECT *, m / sqrt(r2) AS d0, -m / (r2 * sqrt(r2)) AS d1, 3 * m / (r2 * r2 * sqrt(r2)) AS d2, -15 * m / (r2 * r2 * r2 * sqrt(r2)) AS d3, dx * ux + dy * uy + dz * uz AS w FROM cell),
 terms AS (SELECT id, {", ".join(f"(d1 + 0.5e0 * (d2 * tr + d3 * w)) * d{c} + d2 * u{c} AS a{c}" for c in AXES)}, -(d0 + 0.5e0 * (d1 * tr + d2 * w)) AS pot, 1 AS na, 0 AS nd FROM cell2
  UNION ALL SELECT p.id, {_DIRECT_TERMS}, 0, 1 FROM walk w JOIN inside j ON j.level = w.level AND j.prefix = w.prefix JOIN grouped p ON p.group_id = w.group_id WHERE NOT w.far AND w.is_leaf)"""


@query(_CORE_KEYS + _LEVELS + _GROUPS + _WALK + ", " + _CELL + " SELECT id, " + ", ".join(r_sql(f"sum({c})", c) for c in _ACC) + ", sum(na)::BIGINT AS n_approx, sum(nd)::BIGINT AS n_direct FROM terms GROUP BY 1")
def tree_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = core(spark, sf_dir)
    props, grouped, start = gravity.plan_tree(bodies)
    return rounded(gravity.tree_gravity(bodies, props, grouped, start), *_ACC)


@query(_CORE_KEYS + _LEVELS + _GROUPS + _WALK + ", " + _CELL + ", per AS (SELECT id, sum(na) AS na, sum(nd) AS nd FROM terms GROUP BY 1) SELECT sum(na)::BIGINT AS n_approx, sum(nd)::BIGINT AS n_direct, " + r_sql("avg(na)", "mean_approx") + ", " + r_sql("avg(nd)", "mean_direct") + ", (65 * sum(na) + 23 * sum(nd))::BIGINT AS flops FROM per")
def interaction_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = core(spark, sf_dir)
    props, grouped, start = gravity.plan_tree(bodies)
    return rounded(gravity.interaction_flops(gravity.tree_gravity(bodies, props, grouped, start)), "mean_approx", "mean_direct")


@query(_CORE_KEYS + _LEVELS + """, cutn AS (SELECT *, n_child = 8 OR is_leaf OR level = 3 AS truncated FROM nodes),
 bt AS (SELECT level, prefix, n, truncated FROM cutn WHERE level = 0 UNION ALL SELECT c.level, c.prefix, c.n, c.truncated FROM bt JOIN cutn c ON c.level = bt.level + 1 AND c.prefix >> 3 = bt.prefix WHERE NOT bt.truncated)
 SELECT level, prefix AS prefix_hi, n, truncated FROM bt""")
def boundary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.boundary_tree(_props(spark, sf_dir), 3).select("level", "prefix_hi", "n", "truncated")


@query(_CORE_KEYS + _LEVELS + " SELECT level, prefix AS prefix_hi, max(0.01e0 * (1 + id % 7)) AS eps FROM inside GROUP BY 1, 2")
def node_softening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest softening of the bodies of every node."""
    keys = core_keys(spark, sf_dir).withColumn("eps", 0.01 * (1 + F.col("id") % 7))
    return tree.node_properties(tree.build_nodes(keys), keys).select("level", "prefix_hi", "eps")


@query()
def disk_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull of the tree on every body of the disk; too many pairs for SQL, and held against the direct sum in the tests."""
    props, grouped, start = gravity.plan_tree(disk(spark, sf_dir).select("id", "x", "y", "z", "mass"))
    return gravity.tree_gravity(grouped, props, grouped, start)


_BOUNDARY = """, cutn AS (SELECT *, n_child = 8 OR is_leaf OR level = 6 AS truncated FROM nodes),
 bt AS MATERIALIZED (SELECT level, prefix, n, truncated, is_leaf, m, com_x, com_y, com_z FROM cutn WHERE level = 0 UNION ALL SELECT c.level, c.prefix, c.n, c.truncated, c.is_leaf, c.m, c.com_x, c.com_y, c.com_z FROM bt JOIN cutn c ON c.level = bt.level + 1 AND c.prefix >> 3 = bt.prefix WHERE NOT bt.truncated)"""


@query(_CORE_KEYS + _LEVELS + _BOUNDARY + " SELECT 'node' AS kind, level, prefix AS prefix_hi, n, truncated, NULL::BIGINT AS id, " + r_sql("m", "mass", 9) + ", " + ", ".join(r_sql(f"com_{c}", c, 5) for c in "xyz") + " FROM bt UNION ALL SELECT 'body', bt.level, bt.prefix, 1, true, i.id, " + r_sql("i.mass", "mass", 9) + ", " + ", ".join(r_sql(f"i.{c}", c, 5) for c in "xyz") + " FROM bt JOIN inside i ON i.level = bt.level AND i.prefix = bt.prefix AND i.leaf = i.level WHERE bt.is_leaf AND bt.n = 1")
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary tree down to level 6, with the bodies of its single leaves."""
    keys = core_keys(spark, sf_dir)
    rows = tree.boundary_rows(cut(tree.node_properties(tree.build_nodes(keys), keys)), keys, 6).drop("prefix_lo")
    return rounded(rounded(rows, "mass", digits=9), "x", "y", "z", digits=5)


@query(_CORE_KEYS.replace("round(", "floor(") + """, lev AS MATERIALIZED (SELECT id, l.level, key_hi >> CAST(3 * (20 - l.level) AS BIGINT) AS prefix FROM keys, (SELECT CAST(range AS INTEGER) AS level FROM range(21)) l), cnt AS MATERIALIZED (SELECT level, prefix, count(*) AS n FROM lev GROUP BY ALL),
 leafat AS MATERIALIZED (SELECT id, min(level) AS leaf FROM lev JOIN cnt USING (level, prefix) WHERE n <= 8 AND level > 1 GROUP BY 1) SELECT level, prefix AS prefix_hi, count(*) AS n, bool_and(level = leaf) AS is_leaf FROM lev JOIN leafat USING (id) WHERE level <= leaf GROUP BY 1, 2""")
def top_level_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over cells that the bodies stand for, on truncated keys."""
    return tree.top_level_tree(core(spark, sf_dir).select("id", "x", "y", "z"))[0].select("level", "prefix_hi", "n", "is_leaf")


_CORE2 = f"WITH c AS MATERIALIZED (SELECT * FROM {CORE_SQL})"


@query(_CORE2 + f", t AS (SELECT p.id, {_DIRECT_TERMS} FROM c p, c j) SELECT id, " + ", ".join(r_sql(f"sum({c})", c) for c in _ACC) + " FROM t GROUP BY 1")
def direct_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gravity.direct_gravity(core(spark, sf_dir)), *_ACC)


@query(_CORE2 + f", t AS (SELECT p.id, {_DIRECT_TERMS} FROM c p, c j WHERE p.id <> j.id) SELECT id, " + r_sql("sum(pot)", "pot") + " FROM t GROUP BY 1")
def direct_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potential without the self term."""
    return rounded(gravity.direct_gravity(core(spark, sf_dir), exclude_self=True).select("id", "pot"), "pot")


_ENERGY = f", t AS (SELECT p.id, {_DIRECT_TERMS} FROM c p, c j), a AS (SELECT id, sum(ax) AS ax, sum(ay) AS ay, sum(az) AS az, sum(pot) AS pot FROM t GROUP BY 1)"


@query(_CORE2 + _ENERGY + " SELECT " + r_sql("ek", "ekin") + ", " + r_sql("ep", "epot") + ", " + r_sql("ek + ep", "etot") + " FROM (SELECT sum(0.5e0 * mass * (vx * vx + vy * vy + vz * vz)) AS ek, sum(0.5e0 * mass * pot) AS ep FROM c JOIN a USING (id))")
def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)
    return rounded(gravity.energies(p.join(gravity.direct_gravity(p).select("id", "pot"), "id")), "ekin", "epot", "etot")
