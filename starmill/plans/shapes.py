"""Queries over boxes, vectors, small trees, cuts, merged models and logs."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry, physics, sfc
from ..operators import gravity, imaging, merging, partition, sampling, steps, tree
from ..sources.views import CORE_SQL, DISK_SQL, FRAMES_SQL, core, disk, frames
from .registry import query
from .trees import _CORE_KEYS, _GROUPS, _LEVELS, _WALK, _props, core_keys, cube_sql, grid_sql, keys_sql, r_sql, rounded

_D = f"WITH d AS MATERIALIZED (SELECT * FROM {DISK_SQL})"
_C = f"WITH c AS MATERIALIZED (SELECT * FROM {CORE_SQL})"
_PH = ("x", "y", "z", "vx", "vy", "vz")


def _cols(prefix: str) -> dict[str, F.Column]:
    return geometry.vector(prefix)


@query(f"{_D} SELECT id, " + ", ".join(r_sql(e, n) for e, n in (("y * vz - z * vy", "lx"), ("z * vx - x * vz", "ly"), ("x * vy - y * vx", "lz"), ("x * vx + y * vy + z * vz", "rv"), ("sqrt(x * x + y * y + z * z)", "r"))) + " FROM d")
def angular_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, v = _cols(""), _cols("v")
    turn = geometry.cross(r, v)
    out = disk(spark, sf_dir).select("id", *[turn[a].alias(f"l{a}") for a in "xyz"], geometry.dot(r, v).alias("rv"), geometry.length(r).alias("r"))
    return rounded(out, "lx", "ly", "lz", "rv", "r")


@query(_CORE_KEYS + _LEVELS + _GROUPS + " SELECT group_id, prefix AS prefix_hi, pow(greatest(abs(gx - bx) - (ex + hx), 0), 2) + pow(greatest(abs(gy - by_) - (ey + hy), 0), 2) + pow(greatest(abs(gz - bz) - (ez + hz), 0), 2) <= open2 AS opened FROM boxes, nodes WHERE level = 2")
def box_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells of a level each group opens by the distance of their boxes."""
    props, grouped, _ = gravity.plan_tree(core(spark, sf_dir))
    pairs = tree.group_boxes(grouped).crossJoin(F.broadcast(props.filter("level = 2")))
    return pairs.select("group_id", "prefix_hi", geometry.opened_by_box((_cols("c"), _cols("h")), (_cols("g"), _cols("e")), F.col("open2")).alias("opened"))


_MERGED = ", ".join([*(r_sql(f"(least(a.g{c} - a.e{c}, b.g{c} - b.e{c}) + greatest(a.g{c} + a.e{c}, b.g{c} + b.e{c})) * 0.5e0", f"c{c}") for c in "xyz"), *(r_sql(f"(greatest(a.g{c} + a.e{c}, b.g{c} + b.e{c}) - least(a.g{c} - a.e{c}, b.g{c} - b.e{c})) * 0.5e0", f"h{c}") for c in "xyz")])


@query(_CORE_KEYS + _LEVELS + _GROUPS + f" SELECT a.group_id, {_MERGED} FROM boxes a JOIN boxes b ON b.group_id = a.group_id + 1")
def merged_group_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each group and the next."""
    box = tree.group_boxes(gravity.plan_tree(core(spark, sf_dir))[1])
    both = box.join(box.select((F.col("group_id") - 1).alias("group_id"), *[F.col(f"{p}{c}").alias(f"n{p}{c}") for p in "ge" for c in "xyz"]), "group_id")
    mid, half = geometry.merged_boxes(_cols("g"), _cols("e"), _cols("ng"), _cols("ne"))
    names = [f"{p}{c}" for p in "ch" for c in "xyz"]
    return rounded(both.select("group_id", *[v[c].alias(f"{p}{c}") for p, v in (("c", mid), ("h", half)) for c in "xyz"]), *names)


@query(f"{_D}, b AS (SELECT ptype, " + ", ".join(f"{f}({c}) AS {c}{f}" for c in "xyz" for f in ("min", "max")) + " FROM d GROUP BY 1) SELECT ptype, " + ", ".join([*(r_sql(f"{c}min * CASE WHEN {c}min < 0 THEN 1.01e0 ELSE 0.99e0 END", f"{c}min", 9) for c in "xyz"), *(r_sql(f"{c}max * CASE WHEN {c}max < 0 THEN 0.99e0 ELSE 1.01e0 END", f"{c}max", 9) for c in "xyz")]) + " FROM b")
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = disk(spark, sf_dir).groupBy("ptype").agg(*[f(c).alias(f"{c}{f.__name__}") for c in "xyz" for f in (F.min, F.max)])
    ends = {c: geometry.padded(F.col(f"{c}min"), F.col(f"{c}max")) for c in "xyz"}
    names = [f"{c}{k}" for c in "xyz" for k in ("min", "max")]
    return rounded(box.select("ptype", *[e.alias(f"{c}{k}") for c in "xyz" for k, e in zip(("min", "max"), ends[c], strict=True)]), *names, digits=9)


@query(f"{_D}, t AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed FROM d) " + " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS least, max({c}) AS most FROM t" for c in ("x", "y", "z", "mass", "speed")))
def attribute_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir).withColumn("speed", geometry.length(_cols("v")))
    return merging.attribute_ranges(p, ["x", "y", "z", "mass", "speed"])


_RAD = "greatest(sqrt(pow(xmin, 2) + pow(ymin, 2) + pow(zmin, 2)), sqrt(pow(xmax, 2) + pow(ymax, 2) + pow(zmax, 2)))"
_AWAY = f"{_RAD} / sin(0.5e0 * (1.6e0 * pi() / 3e0))"


@query(f"{_D}, b AS (SELECT " + ", ".join(f"{f}({c}) AS {c}{f}" for c in "xyz" for f in ("min", "max")) + " FROM d) SELECT " + ", ".join(r_sql(e, n) for e, n in ((_RAD, "radius"), (_AWAY, "distance"), (f"{_AWAY} * 1e-4", "near"), (f"({_RAD} + {_AWAY}) * 4", "far"), ("(xmin + xmax) * 0.5e0", "tx"), ("(ymin + ymax) * 0.5e0", "ty"), (f"(zmin + zmax) * 0.5e0 - {_AWAY} * 0.2e0", "tz"))) + " FROM b")
def camera_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = sfc.bounding_box(disk(spark, sf_dir))
    found = geometry.camera_fit({c: F.col(f"{c}min") for c in "xyz"}, {c: F.col(f"{c}max") for c in "xyz"}, 1.6)
    return rounded(box.select(*[v.alias(k) for k, v in found.items()]), *found)


_TURNS = {"z": geometry.about_z(0.7), "x": geometry.about_x(-0.4), "a": physics.axis_angle((1.0, 2.0, -1.0), 1.3)}


@query(f"{_D} SELECT id, " + ", ".join(r_sql(" + ".join(f"({m!r}) * {c}" for m, c in zip(row, "xyz", strict=True)), f"{n}{a}") for n, m3 in _TURNS.items() for a, row in zip("xyz", m3, strict=True)) + " FROM d")
def rotate_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the z axis, the x axis, and an axis of choice."""
    out = {f"{n}{a}": v for n, m in _TURNS.items() for a, v in zip("xyz", physics.rotate((F.col("x"), F.col("y"), F.col("z")), m), strict=True)}
    return rounded(disk(spark, sf_dir).select("id", *[v.alias(k) for k, v in out.items()]), *out)


_GYR = geometry.time_unit_gyr(1.0, 2.3262e9)


@query(f"WITH f AS (SELECT * FROM {FRAMES_SQL}) SELECT t, " + r_sql(f"(t - min(t) OVER ()) * {_GYR!r}e0", "gyr", 9) + " FROM f")
def physical_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frames(spark, sf_dir)
    first = log.agg(F.min("t").alias("_t"))
    return rounded(log.crossJoin(F.broadcast(first)).select("t", ((F.col("t") - F.col("_t")) * _GYR).alias("gyr")), "gyr", digits=9)


_FACTORS = ("ONE", "ZERO", "SRC_ALPHA", "ONE_MINUS_SRC_ALPHA")
_FACTOR_SQL = {"ONE": "1e0", "ZERO": "0e0", "SRC_ALPHA": "sa", "ONE_MINUS_SRC_ALPHA": "(1 - sa)"}
_RGBA = "SELECT id, mass AS sr, mass * 0.5e0 AS sg, mass * 0.25e0 AS sb, (id % 5) / 5e0 AS sa, 0.3e0 AS dr, 0.6e0 AS dg, 0.9e0 AS db, (id % 3) / 3e0 AS da FROM d"


@query(f"{_D}, q AS ({_RGBA}) " + " UNION ALL ".join(f"SELECT id, '{a} {b}' AS factors, " + ", ".join(r_sql(f"s{c} * {_FACTOR_SQL[a]} + d{c} * {_FACTOR_SQL[b]}", c, 9) for c in "rgba") + " FROM q" for a in _FACTORS for b in _FACTORS))
def blend_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen pairs of factors."""
    m = F.col("mass")
    src = (m, m * 0.5, m * 0.25, (F.col("id") % 5).cast("double") / 5.0)
    dst = (F.lit(0.3), F.lit(0.6), F.lit(0.9), (F.col("id") % 3).cast("double") / 3.0)
    rows = [F.struct(F.lit(f"{a} {b}").alias("factors"), *[v.alias(c) for c, v in zip("rgba", geometry.blend_rgba(src, dst, a, b), strict=True)]) for a in _FACTORS for b in _FACTORS]
    return rounded(disk(spark, sf_dir).select("id", F.explode(F.array(*rows)).alias("q")).select("id", "q.*"), *"rgba", digits=9)


_MAP = "t AS (SELECT a.range AS i, b.range AS j, CAST((a.range * 7 + b.range * 5) % 16 AS DOUBLE) AS v FROM range(16) a, range(12) b)"


@query(f"{_D}, {_MAP}, a AS (SELECT id, least(greatest(mass / 5e0, 0), 1) * 14 AS s, least(greatest((z + 1) / 2e0, 0), 1) * 10 AS t FROM d), b AS (SELECT *, floor(s) AS i, floor(t) AS j FROM a) SELECT b.id, " + r_sql("p.v * (1 - (s - b.i)) * (1 - (b.t - b.j)) + q.v * (s - b.i) * (1 - (b.t - b.j)) + r.v * (1 - (s - b.i)) * (b.t - b.j) + u.v * (s - b.i) * (b.t - b.j)", "c", 8) + " FROM b JOIN t p ON p.i = b.i AND p.j = b.j JOIN t q ON q.i = b.i + 1 AND q.j = b.j JOIN t r ON r.i = b.i AND r.j = b.j + 1 JOIN t u ON u.i = b.i + 1 AND u.j = b.j + 1")
def surface_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.range(16).select(F.col("id").alias("i")).crossJoin(F.broadcast(spark.range(12).select(F.col("id").alias("j")))).withColumn("v", ((F.col("i") * 7 + F.col("j") * 5) % 16).cast("double"))
    p = disk(spark, sf_dir).select("id", (F.col("mass") / 5.0).alias("s"), ((F.col("z") + 1.0) / 2.0).alias("t"))
    return rounded(imaging.surface_lookup(p, "s", "t", table, 16, 12).select("id", "c"), "c", digits=8)


@query("WITH l AS (SELECT o_custkey AS pixel, (o_orderkey % 11) / 11e0 AS r, (o_orderkey % 4) / 4.3e0 AS a FROM orders) SELECT pixel, " + r_sql("sum(r)", "r", 7) + ", " + r_sql("least(sum(a), 1)", "alpha", 7) + " FROM l GROUP BY 1")
def add_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    layers = o.select(F.col("o_custkey").alias("pixel"), ((F.col("o_orderkey") % 11).cast("double") / 11.0).alias("r"), ((F.col("o_orderkey") % 4).cast("double") / 4.3).alias("a"))
    return rounded(imaging.add_layers(layers), "r", "alpha", digits=7)


def _interleave(bits: int) -> str:
    return " + ".join(f"(((i{c} >> {b}) & 1) << {3 * b + s})" for b in range(bits) for c, s in (("x", 2), ("y", 1), ("z", 0)))


_M20 = f"WITH {cube_sql(DISK_SQL)}, grid AS MATERIALIZED (SELECT p.*, " + ", ".join(f"CAST(floor(({c} - c{c}) / (size / {float(1 << 20)!r}e0)) AS BIGINT) AS i{c}" for c in "xyz") + f" FROM {DISK_SQL} p, cube), k AS MATERIALIZED (SELECT id, mass, {_interleave(20)} AS key FROM grid)"


@query(_M20 + " SELECT id, key FROM k")
def morton_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of truncated coordinates; coordinates that do not fit fail."""
    g = sfc.grid_coordinates(disk(spark, sf_dir), 20, exact=True)
    return g.select("id", sfc.morton_checked(F.col("ix"), F.col("iy"), F.col("iz")).alias("key"))


_CELL10 = f"(size / {float(1 << 10)!r}e0)"


@query(f"WITH {cube_sql(DISK_SQL)}, {grid_sql(DISK_SQL, 10)} SELECT id, " + ", ".join(r_sql(f"c{c} + i{c} * {_CELL10}", c) for c in "xyz") + " FROM grid, cube")
def morton_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places recovered from the keys."""
    p = disk(spark, sf_dir)
    g = sfc.grid_coordinates(p, 10).select("id", sfc.morton(F.col("ix"), F.col("iy"), F.col("iz")).alias("key")).crossJoin(F.broadcast(sfc.cube(p)))
    found = sfc.morton_position(F.col("key"), {c: F.col(f"corner_{c}") for c in "xyz"}, F.col("size") / 1024.0)
    return rounded(g.select("id", *[v.alias(c) for c, v in found.items()]), "x", "y", "z")


_SPLIT = _M20 + """, lev AS MATERIALIZED (SELECT id, mass, l.range AS level, key >> CAST(3 * (20 - l.range) AS BIGINT) AS prefix FROM k, range(21) l),
 cnt AS MATERIALIZED (SELECT level, prefix, count(*) AS n FROM lev GROUP BY ALL),
 nodes AS MATERIALIZED (SELECT CAST(a.level AS INTEGER) AS level, a.prefix, a.n, a.n < 32 AS is_leaf FROM cnt a LEFT JOIN cnt b ON b.level = a.level - 1 AND b.prefix = a.prefix >> 3 WHERE a.level = 0 OR b.n >= 32)"""


@query(_SPLIT + " SELECT level, prefix AS prefix_hi, n, is_leaf, " + r_sql("CASE WHEN is_leaf THEN cbrt(42e0 / (n / (pow(size, 3) / pow(8e0, level)))) END", "h") + " FROM nodes, cube")
def insertion_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of up to 31 bodies, and the first radius that the volume of each gives its bodies."""
    p = disk(spark, sf_dir)
    nodes = tree.insertion_tree(p).crossJoin(F.broadcast(sfc.cube(p).select("size")))
    h = F.when(F.col("is_leaf"), geometry.node_h(F.col("n"), F.col("level").cast("double"), F.col("size"), 42.0))
    return rounded(nodes.select("level", "prefix_hi", "n", "is_leaf", h.alias("h")), "h")


@query(_SPLIT + ", f AS (SELECT a.level, a.prefix, a.n FROM nodes a LEFT JOIN nodes b ON b.level = a.level - 1 AND b.prefix = a.prefix >> 3 WHERE a.n < 100 AND (a.level = 0 OR b.n >= 100)) SELECT level, prefix AS prefix_hi, n FROM f")
def small_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.small_nodes(tree.insertion_tree(disk(spark, sf_dir)), 100).select("level", "prefix_hi", "n")


@query(_CORE_KEYS + _LEVELS + ", k AS (SELECT level, row_number() OVER (ORDER BY level, prefix) AS i FROM nodes) SELECT level, min(i) AS first, max(i) AS last FROM k GROUP BY 1")
def level_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.level_list(tree.build_nodes(core_keys(spark, sf_dir).select("id", "key_hi", "key_lo")))


@query(_CORE_KEYS + _LEVELS + " SELECT level, prefix AS prefix_hi, " + ", ".join(r_sql(a, b) for a, b in (("bx", "cx"), ("by_", "cy"), ("bz", "cz"), ("hx", "hx"), ("hy", "hy"), ("hz", "hz"))) + " FROM nodes WHERE level BETWEEN 1 AND 2")
def level_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the nodes of a range of levels."""
    cols = ["cx", "cy", "cz", "hx", "hy", "hz"]
    return rounded(_props(spark, sf_dir).filter(F.col("level").between(1, 2)).select("level", "prefix_hi", *cols), *cols)


_GROUP_VIEW = f"({_CORE_KEYS}{_LEVELS}{_GROUPS} SELECT group_id AS id, gx AS x, gy AS y, gz AS z, ex, ey, ez, mass, com_x, com_y, com_z FROM boxes JOIN (SELECT group_id, sum(mass) AS mass, " + ", ".join(f"sum(mass * {c}) / sum(mass) AS com_{c}" for c in "xyz") + " FROM grouped GROUP BY 1) USING (group_id))"
_GROUP_NODES = _LEVELS.replace("WHERE c > 16", "WHERE c > 8").split(",\n nodes0 AS")[0]


@query(keys_sql(_GROUP_VIEW) + _GROUP_NODES + " SELECT level, prefix AS prefix_hi, count(*) AS n, bool_and(level = leaf) AS is_leaf, " + r_sql("sum(mass)", "mass") + ", " + ", ".join([*(r_sql(f"sum(mass * com_{c}) / sum(mass)", f"com_{c}") for c in "xyz"), *(r_sql(f"min({c} - e{c})", f"low_{c}") for c in "xyz"), *(r_sql(f"max({c} + e{c})", f"high_{c}") for c in "xyz")]) + " FROM inside GROUP BY ALL")
def group_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree over groups of bodies with its moments and boxes."""
    grouped = gravity.plan_tree(core(spark, sf_dir))[1]
    m = F.col("mass")
    sums = grouped.groupBy("group_id").agg(F.sum(m).alias("mass"), *[(F.sum(m * F.col(c)) / F.sum(m)).alias(f"com_{c}") for c in "xyz"])
    found = tree.group_tree(tree.group_boxes(grouped).join(sums, "group_id"))
    cols = ["mass", *[f"{k}_{c}" for k in ("com", "low", "high") for c in "xyz"]]
    return rounded(found.select("level", "prefix_hi", "n", "is_leaf", *cols), *cols)


_DOMAINS = ", boxes AS MATERIALIZED (SELECT CAST((x > 0) AS BIGINT) * 4 + CAST((y > 0) AS BIGINT) * 2 + CAST((z > 0) AS BIGINT) AS group_id, " + ", ".join([*(f"(min({c}) + max({c})) * 0.5e0 AS g{c}" for c in "xyz"), *(f"(max({c}) - min({c})) * 0.5e0 AS e{c}" for c in "xyz")]) + " FROM keys GROUP BY 1)"


def _octants(p: DataFrame) -> DataFrame:
    """The boxes of the bodies of eight domains, one for each combination of signs."""
    number = (F.col("x") > 0).cast("long") * 4 + (F.col("y") > 0).cast("long") * 2 + (F.col("z") > 0).cast("long")
    box = p.groupBy(number.alias("group_id")).agg(*[f(c).alias(f"{c}{f.__name__}") for c in "xyz" for f in (F.min, F.max)])
    return box.select("group_id", *[((F.col(f"{c}min") + F.col(f"{c}max")) * 0.5).alias(f"g{c}") for c in "xyz"], *[((F.col(f"{c}max") - F.col(f"{c}min")) * 0.5).alias(f"e{c}") for c in "xyz"])


@query(_CORE_KEYS + _LEVELS + _DOMAINS + _WALK + " SELECT w.group_id, sum(CAST(far AS BIGINT))::BIGINT AS cells, sum(CAST(NOT far AND w.is_leaf AS BIGINT))::BIGINT AS leaves, coalesce(sum(CASE WHEN NOT far AND w.is_leaf THEN n END), 0)::BIGINT AS bodies FROM walk w JOIN nodes USING (level, prefix) GROUP BY 1")
def essential_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of eight domains needs of the tree: cells, leaves, and the bodies of those leaves."""
    p = core(spark, sf_dir)
    props, _, start = gravity.plan_tree(p)
    cells, leaves = gravity.essential_cells(props, _octants(p), start)
    key = ["level", "prefix_hi", "prefix_lo"]
    sent = leaves.join(props.select(*key, "n"), key).select("group_id", F.lit(0).cast("long").alias("cells"), F.lit(1).cast("long").alias("leaves"), F.col("n").alias("bodies"))
    rows = cells.select("group_id", F.lit(1).cast("long").alias("cells"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("bodies")).unionByName(sent)
    return rows.groupBy("group_id").agg(F.sum("cells").alias("cells"), F.sum("leaves").alias("leaves"), F.sum("bodies").alias("bodies"))


_FAR_K = "pow(greatest(abs(gx - k.com_x) - ex, 0), 2) + pow(greatest(abs(gy - k.com_y) - ey, 0), 2) + pow(greatest(abs(gz - k.com_z) - ez, 0), 2) > k.open2"


@query(_CORE_KEYS + _LEVELS + _DOMAINS + f""", cutn AS (SELECT *, n_child = 8 OR is_leaf OR level = 2 AS truncated FROM nodes),
 visit AS (SELECT g.group_id, k.level, k.prefix, k.truncated, k.is_leaf, {_FAR_K} AS far FROM boxes g, cutn k WHERE k.level = 0
  UNION ALL SELECT v.group_id, k.level, k.prefix, k.truncated, k.is_leaf, {_FAR_K} FROM visit v JOIN boxes g ON g.group_id = v.group_id JOIN cutn k ON k.level = v.level + 1 AND k.prefix >> 3 = v.prefix WHERE NOT v.far AND NOT v.truncated)
 SELECT group_id, NOT bool_or(NOT far AND truncated AND NOT is_leaf) AS enough FROM visit GROUP BY 1""")
def boundary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tree cut at level 2 or at full nodes answers each of eight domains."""
    p = core(spark, sf_dir)
    return gravity.boundary_is_enough(tree.boundary_tree(_props(spark, sf_dir), 2), _octants(p))


_NUM = _CORE_KEYS + ", num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY key_hi, key_lo, id) AS rn FROM keys)"


@query(_NUM + ", w AS (SELECT *, sum(1 + id % 5) OVER (ORDER BY rn) - (1 + id % 5) AS b FROM num), p AS (SELECT *, least(CAST(floor(b * 12 / (SELECT sum(1 + id % 5) FROM num)) AS BIGINT), 11) AS part FROM w) SELECT part, arg_min(key_hi, rn) AS low FROM p GROUP BY 1")
def weighted_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts along the curve by a weight of each body."""
    keyed = tree.ordered(sfc.sfc_keys(core(spark, sf_dir))).withColumn("w", 1 + F.col("id") % 5)
    return partition.weighted_cuts(keyed, 12, "w")


@query(_NUM + ", c AS (SELECT count(*) AS n FROM num), s AS (SELECT a.range AS stage1, b.range AS stage2, a.range * n // 4 AS lo, (a.range + 1) * n // 4 AS hi FROM range(4) a, range(3) b, c) SELECT stage1, stage2, key_hi AS low FROM s JOIN num ON rn = lo + stage2 * (hi - lo) // 3 + 1")
def two_stage_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.two_stage_cuts(tree.ordered(sfc.sfc_keys(core(spark, sf_dir))), 4, 3)


def _domain_sql() -> str:
    from .layout import _ORB, _meets

    return _ORB + f", h AS (SELECT box, {_meets('0')} AS own, x, y, z FROM c, bx WHERE {_meets('2e0 * 0.1e0')}) SELECT box, sum(CAST(own AS BIGINT))::BIGINT AS n_own, sum(CAST(NOT own AS BIGINT))::BIGINT AS n_halo, " + ", ".join(f"{f}({c}) AS {c}{f}" for c in "xyz" for f in ("min", "max")) + " FROM h GROUP BY 1"


@query(_domain_sql())
def domain_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies dealt to their boxes with the halo, and the bounds after that."""
    p = core(spark, sf_dir)
    boxes = partition.orb_boxes(partition.bisect(p, 3, 2, 2))
    return partition.domain_bounds(partition.distribute(p.withColumn("h", F.lit(0.1)), boxes))


_HASH = "CAST((n * ((n * n * 15731 + 789221) % 4294967296) + 1376312589) % 2147483648 AS BIGINT)"


@query(f"{_D}, h AS (SELECT id, CAST(xor((o << 13) & 4294967295, o) AS HUGEINT) AS n FROM (SELECT id, CAST((id + 7) % 4294967296 AS BIGINT) AS o FROM d)) SELECT id, row_number() OVER (ORDER BY {_HASH}, id) AS place FROM h")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(disk(spark, sf_dir), 7).select("id", "place")


@query(f"{_D}, r AS (SELECT id, CASE id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN NULL ELSE mass END AS rho, CAST((id * 7) % 130 AS DOUBLE) AS h FROM d) SELECT id FROM r WHERE rho <> 0 AND h <> 0 AND h <= 100")
def renderable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho = F.when(F.col("id") % 4 == 0, 0.0).when(F.col("id") % 4 == 1, None).otherwise(F.col("mass"))
    return merging.renderable(disk(spark, sf_dir).select("id", rho.alias("rho"), ((F.col("id") * 7) % 130).cast("double").alias("h"))).select("id")


@query(f"{_D} SELECT id, x FROM d WHERE ptype = 1 UNION ALL SELECT (SELECT max(id) FROM d WHERE ptype = 1) + row_number() OVER (ORDER BY id) AS id, x FROM d WHERE ptype <> 1")
def renumber_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir)
    return merging.renumber(p.filter("ptype = 1"), p.filter("ptype <> 1")).select("id", "x")


@query(f"WITH v AS (SELECT t, (t % 5 - 2) * 1e11 AS v FROM {FRAMES_SQL}) SELECT t, CASE WHEN abs(v) > 1e11 THEN 0 ELSE v END AS sane FROM v")
def sane_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times about the bound beyond which they are taken for 0."""
    return frames(spark, sf_dir).select("t", merging.sane_time((F.col("t") % 5 - 2) * 1e11).alias("sane"))


_LOG = f"WITH f AS (SELECT t, greatest(abs(e), 1e-3) AS seconds, n FROM {FRAMES_SQL})"


def _step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("t", F.greatest(F.abs("e"), F.lit(1e-3)).alias("seconds"), "n")


@query(_LOG + " SELECT t, " + r_sql("n / seconds", "rate", 5) + ", " + r_sql("(65 * n * 300 + 23 * n * 40) / 1e12 / seconds", "tflops", 12) + " FROM f")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _step_log(spark, sf_dir).withColumns({"n_approx": F.col("n") * 300, "n_direct": F.col("n") * 40})
    return rounded(rounded(gravity.throughput(log).select("t", "rate", "tflops"), "rate", digits=5), "tflops", digits=12)


@query(_LOG + " SELECT t // 12 AS step, " + r_sql("max(seconds)", "longest") + ", " + r_sql("avg(seconds)", "mean") + ", " + r_sql("max(seconds) / avg(seconds)", "imbalance") + " FROM f GROUP BY 1")
def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _step_log(spark, sf_dir).withColumn("step", F.floor(F.col("t") / 12).cast("long"))
    return rounded(gravity.load_statistics(log), "longest", "mean", "imbalance")


_ORBIT = {"x": 30.0, "y": -12.0, "z": 4.0, "vx": -0.9, "vy": 0.2, "vz": 0.1}
_M, _T, _EPS = 50.0, 1.5, 0.01
_START = ", ".join(f"{v!r}e0 AS {k}" for k, v in _ORBIT.items())
_RELATIVE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT * FROM {DISK_SQL}), o AS (SELECT 0e0 AS t, {_START}
  UNION ALL SELECT t + dt, x + (vx + f * x) * dt * 0.5e0, y + (vy + f * y) * dt * 0.5e0, z + (vz + f * z) * dt * 0.5e0, vx + f * x, vy + f * y, vz + f * z
   FROM (SELECT *, -{_M}e0 / pow(x * x + y * y + z * z, 1.5e0) * dt AS f FROM (SELECT t, dt, x + vx * dt * 0.5e0 AS x, y + vy * dt * 0.5e0 AS y, z + vz * dt * 0.5e0 AS z, vx, vy, vz FROM (SELECT *, {_EPS}e0 * sqrt(pow(x * x + y * y + z * z, 1.5e0) / {_M}e0) AS dt FROM o WHERE t < {_T}e0)))),
 e AS (SELECT * FROM o WHERE t >= {_T}e0)"""
_TURN_A, _TURN_B = physics.galactic(121.0, -21.0), physics.axis_angle((0.0, 1.0, 1.0), 0.8)
_SUN, _CENTRE = "abs(z) < 0.1 AND abs(sqrt(x * x + y * y + z * z) - 8.27) < 0.0827", "sqrt(x * x + y * y + z * z) < 3"


def _turned(m: list[list[float]], shift: bool) -> str:
    return ", ".join(f"{' + '.join(f'({k!r}) * {v}{c}' for k, c in zip(row, 'xyz', strict=True))}{f' + (SELECT {v}{a} FROM e)' if shift else ''} AS {v}{a}" for v in ("", "v") for a, row in zip("xyz", m, strict=True))


@query(_RELATIVE + f""", a AS (SELECT * FROM d WHERE ptype = 1), b AS (SELECT * FROM d WHERE ptype = 2),
 u AS MATERIALIZED (SELECT CASE WHEN id = (SELECT min(id) FROM a WHERE {_SUN}) THEN 29999999 ELSE id END AS id, CAST(1 AS INTEGER) AS galaxy, mass, {_turned(_TURN_A, False)} FROM a
  UNION ALL SELECT CASE WHEN id = (SELECT min(id) FROM b WHERE {_CENTRE}) THEN 29999998 ELSE id END, 2, mass, {_turned(_TURN_B, True)} FROM b),
 k AS (SELECT {", ".join(f"sum(mass * {c}) / sum(mass) AS k{c}" for c in _PH)} FROM u) SELECT id, galaxy, """ + ", ".join(r_sql(f"{c} - k{c}", c, 5) for c in _PH) + " FROM u, k")
def tagged_merger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two galaxies at the end of their relative orbit, with the ids of one body of each set."""
    p = disk(spark, sf_dir)
    pair = spark.createDataFrame([(0, *_ORBIT.values(), _M)], "id long, x double, y double, z double, vx double, vy double, vz double, m double")
    offset = steps.kepler(pair, _T, _EPS).first().asDict()
    found = merging.merge_tagged(p.filter("ptype = 1"), p.filter("ptype = 2"), _TURN_A, _TURN_B, offset, _SUN, _CENTRE, required=False)
    return rounded(found.select("id", "galaxy", *_PH), *_PH, digits=5)


@query(f"{_D}, a AS (SELECT id % 1000 AS id, mass FROM d WHERE ptype = 1), b AS (SELECT id % 1000 AS id, mass FROM d WHERE ptype = 2) SELECT id, CAST(1 AS INTEGER) AS galaxy, mass FROM a UNION ALL SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY id, mass) AS id, 2, mass FROM b")
def merge_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two galaxies whose ids both begin at nought, and repeat."""
    p = disk(spark, sf_dir).withColumn("id", F.col("id") % 1000)
    return merging.merge(p.filter("ptype = 1"), p.filter("ptype = 2"), 0.5, 6.0, new_ids=True).select("id", "galaxy", "mass")
