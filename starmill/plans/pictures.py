"""Queries over colours, pixels, depth order and cameras."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import physics
from ..operators import imaging
from ..sources.views import CORE_SQL, DISK_SQL, FRAMES_SQL, core, disk, frames
from .registry import query
from .trees import r_sql, rounded

_D = f"WITH d AS MATERIALIZED (SELECT * FROM {DISK_SQL})"
_C = f"WITH c AS MATERIALIZED (SELECT * FROM {CORE_SQL})"


@query(f"{_D}, v AS (SELECT id, x * 0.6e0 + y * -0.48e0 + z * 0.64e0 + 20e0 AS depth FROM d) SELECT id, row_number() OVER (ORDER BY depth, id) AS place FROM v")
def depth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.depth_order(disk(spark, sf_dir), (0.6, -0.48, 0.64, 20.0)).select("id", "place")


@query(f"{_D}, e AS (SELECT min(mass) AS lo, max(mass) AS hi FROM d) SELECT id, " + ", ".join(r_sql(e, n, 7) for e, n in (("least(greatest((mass - lo) / (hi - lo) * 510 - 100, 0), 255)", "c"), ("ln(mass + 0.5e0)", "l"), ("exp(least(mass, 1)) - 0.5e0", "x"))) + " FROM d, e")
def rescale_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir)
    ends = p.agg(F.min("mass").alias("lo"), F.max("mass").alias("hi"))
    c = physics.clamp(physics.rescale(F.col("mass"), F.col("lo"), F.col("hi"), -100.0, 410.0), 0.0, 255.0)
    out = p.crossJoin(F.broadcast(ends)).select("id", c.alias("c"), F.log(F.col("mass") + 0.5).alias("l"), (F.exp(F.least(F.col("mass"), F.lit(1.0))) - 0.5).alias("x"))
    return rounded(out, "c", "l", "x", digits=7)


_HASH = "CAST((n * ((n * n * 15731 + 789221) % 4294967296) + 1376312589) % 2147483648 AS BIGINT)"


@query(f"{_D}, h AS (SELECT id, CAST(xor((o << 13) & 4294967295, o) AS HUGEINT) AS n FROM (SELECT id, CAST((id * 2654435) % 4294967296 AS BIGINT) AS o FROM d)) SELECT id, {_HASH} AS h, " + r_sql(f"{_HASH} / 2147483647e0", "u", 12) + " FROM h")
def hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("id") * 2654435) % 4294967296
    return rounded(disk(spark, sf_dir).select("id", physics.hash31(n).alias("h"), physics.uniform(n).alias("u")), "u", digits=12)


_K = -1.35
_MASSES = "CASE " + " ".join(f"WHEN m >= {v}e0 THEN {i}" for i, v in enumerate(imaging.STAR_MASSES[1:-1])) + f" ELSE {len(imaging.STAR_COLOURS) - 1} END"
_TINTS = [f"[{', '.join(str(c[k]) for c in imaging.STAR_COLOURS)}][cls + 1]" for k in range(3)]


@query(f"{_D}, s AS (SELECT id, pow(((id % 9973) / 9973e0) * ({150.0**_K - 0.05**_K!r}) + {0.05**_K!r}, {1 / _K!r}) AS m FROM d), k AS (SELECT id, m, CAST({_MASSES} AS INTEGER) AS cls FROM s) SELECT id, cls, CAST({_TINTS[0]} AS INTEGER) AS red, CAST({_TINTS[1]} AS INTEGER) AS green, CAST({_TINTS[2]} AS INTEGER) AS blue, " + r_sql("m", "m", 5) + " FROM k")
def star_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir).withColumn("m", imaging.star_mass((F.col("id") % 9973).cast("double") / 9973.0))
    cls = imaging.star_class(F.col("m"))
    return rounded(p.select("id", cls.alias("cls"), *[c.alias(n) for c, n in zip(imaging.star_colour(cls), ("red", "green", "blue"), strict=True)], "m"), "m", digits=5)


@query(f"{_D}, v AS (SELECT (id * 15013) % 250000000 AS o FROM d) SELECT CASE WHEN o < 40000000 THEN CASE WHEN o % 100 <> 0 THEN 'star' WHEN (o // 100) % 2 = 1 THEN 'second' ELSE 'third' END WHEN o < 50000000 THEN CASE WHEN o % 4 = 0 THEN 'fourth' ELSE 'third' END WHEN o < 70000000 THEN 'dust' WHEN o < 100000000 THEN 'third' WHEN o < 200000000 THEN 'bulge' ELSE 'dark' END AS colour, count(*) AS n FROM v GROUP BY 1")
def colour_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (F.col("id") * 15013) % 250_000_000
    return disk(spark, sf_dir).groupBy(imaging.colour_kind(old).alias("colour")).agg(F.count("*").alias("n"))


_LOOKS = {"dust": (80.0, 40.0, 20.0, 0.5), "haze": (160.0, 30.0, 200.0, 1.0), "dark": (20.0, 20.0, 60.0, 0.25)}


def _star_sql(first: int, n: int, slope: float, k: int) -> str:
    low, high, e = imaging.STAR_MASSES[first + n - 1], imaging.STAR_MASSES[first], slope + 1
    last = min(first + n, len(imaging.STAR_COLOURS)) - 1
    mass = f"pow(u * ({high**e!r} - {low**e!r}) + {low**e!r}, {1 / e!r})"
    return "CASE " + " ".join(f"WHEN {mass} >= {imaging.STAR_MASSES[i + 1]}e0 THEN {imaging.STAR_COLOURS[i][k]}" for i in range(first, last)) + f" ELSE {imaging.STAR_COLOURS[last][k]} END"


def _live_sql(k: int) -> str:
    star = {name: _star_sql(*v, k) for name, v in imaging.STARS.items()} if k < 3 else dict.fromkeys(imaging.STARS)
    if k == 3:
        return f"CASE kind WHEN 'disk' THEN 1 WHEN 'glow' THEN 0.6e0 WHEN 'bulge' THEN 2 WHEN 'dust' THEN {_LOOKS['dust'][3]} WHEN 'haze' THEN {_LOOKS['haze'][3]} ELSE {_LOOKS['dark'][3]} END"
    return f"CASE kind WHEN 'disk' THEN CASE WHEN gid % 1024 = 0 THEN {star['glow']} ELSE 0.01e0 * ({star['disk']}) END WHEN 'glow' THEN 0.8e0 * ({star['glow']}) WHEN 'bulge' THEN 0.01e0 * ({star['bulge']}) WHEN 'dust' THEN {_LOOKS['dust'][k]}e0 * u WHEN 'haze' THEN {_LOOKS['haze'][k]}e0 ELSE {_LOOKS['dark'][k]}e0 END"


@query(f"{_D}, g AS (SELECT CASE WHEN ptype = 2 THEN (id * 15013) % 100000000 ELSE gid END AS gid FROM d), o AS (SELECT gid, CAST(gid % 4294967296 AS BIGINT) AS o FROM g), h AS (SELECT gid, CAST(xor((o << 13) & 4294967295, o) AS HUGEINT) AS n FROM o), u AS (SELECT gid, {_HASH} / 2147483647e0 AS u, CASE WHEN gid >= 3000000000000000000 THEN 'dark' WHEN gid >= 2000000000000000000 THEN 'bulge' WHEN gid >= 70000000 THEN 'haze' WHEN gid >= 50000000 THEN 'dust' WHEN gid >= 40000000 THEN 'glow' ELSE 'disk' END AS kind FROM h) SELECT gid, kind, " + ", ".join(r_sql(_live_sql(k), n, 5) for k, n in enumerate(imaging.RGBA)) + " FROM u")
def live_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of every body of the disk as the live picture draws them, its disk ids spread over disk, glowing, dust and haze."""
    gid = F.when(F.col("ptype") == 2, (F.col("id") * 15013) % 100_000_000).otherwise(F.col("gid"))
    found = imaging.live_colours(disk(spark, sf_dir).select(gid.alias("gid")), **_LOOKS, brightness=0.8, glow_alpha=0.6)
    return rounded(found, *imaging.RGBA, digits=5)


_SEEN = f"""{_C}, p AS (SELECT *, 10e0 - z AS depth FROM c WHERE 10e0 - z > 0), q AS (SELECT *, (x / depth + 1) * 32 AS px, (y / depth + 1) * 32 AS py, least(sqrt(pow(2e0 * 0.5e0 * 64 / depth, 2) + 0.25e0), 16) AS radius FROM p),
 s AS (SELECT * FROM q WHERE px - radius <= 64 AND px + radius >= 0 AND py - radius <= 64 AND py + radius >= 0)"""


@query(_SEEN + ", g AS (SELECT CAST(range AS BIGINT) AS i FROM range(64)), w AS (SELECT a.i AS ix, b.i AS iy, mass, 1 - (pow(a.i + 0.5e0 - px, 2) + pow(b.i + 0.5e0 - py, 2)) / (radius * radius) AS w FROM s, g a, g b WHERE a.i BETWEEN floor(px - radius) AND floor(px + radius) AND b.i BETWEEN floor(py - radius) AND floor(py + radius)) SELECT ix, iy, " + r_sql("sum(mass * w)", "light") + " FROM w WHERE w > 0 GROUP BY 1, 2")
def splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = imaging.project(core(spark, sf_dir).withColumn("h", F.lit(2.0)), 64, 64)
    return rounded(imaging.splat(seen, 64, 64), "light")


@query("WITH l AS (SELECT o_custkey AS pixel, o_orderkey AS depth, (o_orderkey % 11) / 11e0 AS r, (o_orderkey % 4) / 4.3e0 AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), t AS (SELECT pixel, i, r, a, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY pixel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS left_ FROM l) SELECT pixel, " + r_sql("sum(left_ * a * r)", "r", 7) + ", " + r_sql("1 - exp(sum(ln(1 - a)))", "alpha", 7) + " FROM t GROUP BY 1")
def compose_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    layers = o.select(F.col("o_custkey").alias("pixel"), F.col("o_orderkey").alias("depth"), ((F.col("o_orderkey") % 11).cast("double") / 11.0).alias("r"), ((F.col("o_orderkey") % 4).cast("double") / 4.3).alias("a"))
    return rounded(imaging.compose(layers), "r", "alpha", digits=7)


_PATH = ", ".join(f"CAST((t * {k}) % 13 AS DOUBLE) AS {c}" for k, c in enumerate(("tx", "ty", "tz", "rx", "ry", "rz"), 2))


@query(f"WITH p AS (SELECT t - min(t) OVER () AS frame, {_PATH} FROM {FRAMES_SQL}), n AS (SELECT *, {', '.join(f'coalesce(lead({c}) OVER (ORDER BY frame), {c}) AS n{c}' for c in ('tx', 'ty', 'tz', 'rx', 'ry', 'rz'))} FROM p), f AS (SELECT range * 0.37e0 AS f FROM range(300)), h AS (SELECT f, least(greatest(f, (SELECT min(frame) FROM p)), (SELECT max(frame) FROM p)) AS g FROM f) SELECT f, " + ", ".join(r_sql(f"{c} + (g - frame) * (n{c} - {c})", c) for c in ("tx", "ty", "tz", "rx", "ry", "rz")) + " FROM h JOIN n ON frame = CAST(floor(g) AS BIGINT)")
def camera_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("tx", "ty", "tz", "rx", "ry", "rz")
    log = frames(spark, sf_dir)
    path = log.crossJoin(F.broadcast(log.agg(F.min("t").alias("_t")))).select((F.col("t") - F.col("_t")).alias("frame"), *[((F.col("t") * k) % 13).cast("double").alias(c) for k, c in enumerate(cols, 2)])
    at = spark.range(300).select((F.col("id") * 0.37).alias("f"))
    return rounded(imaging.camera_frames(path, at), *cols)


@query(f"{_D}, t AS (SELECT range AS i, CAST((range * 7) % 16 AS DOUBLE) AS v FROM range(16)), a AS (SELECT id, least(greatest(mass / 5e0, 0), 1) * 15 AS spot FROM d) SELECT id, " + r_sql("lo.v + (spot - lo.i) * (coalesce(hi.v, lo.v) - lo.v)", "c", 9) + " FROM a JOIN t lo ON lo.i = CAST(floor(spot) AS BIGINT) LEFT JOIN t hi ON hi.i = lo.i + 1")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.range(16).select(F.col("id").alias("i"), ((F.col("id") * 7) % 16).cast("double").alias("v"))
    p = disk(spark, sf_dir).withColumn("s", F.col("mass") / 5.0)
    return rounded(imaging.table_lookup(p, "s", table, 16).select("id", "c"), "c", digits=9)


@query(f"{_D} SELECT id, " + r_sql("1 - exp(-sqrt(0.05e0 * mass))", "tone", 9) + ", " + r_sql("mass * ((id % 5) / 5e0) + 0.3e0 * (1 - (id % 5) / 5e0)", "over_", 9) + " FROM d")
def tone_and_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = (F.col("id") % 5).cast("double") / 5.0
    out = disk(spark, sf_dir).select("id", physics.tone_map(F.col("mass")).alias("tone"), imaging.blend(F.col("mass"), F.lit(0.3), alpha).alias("over_"))
    return rounded(out, "tone", "over_", digits=9)
