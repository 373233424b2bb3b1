"""Queries over time integration, orbits, mergers and logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import physics
from ..operators import generators, gravity, merging, profiles, steps
from ..operators.cut import cut, scratch
from ..sources.views import CORE_SQL, DISK_SQL, FRAMES_SQL, core, disk, frames
from ..sources import columnar
from ..streaming.frames import each_frame, replay, sent_frames, windowed_counts
from .registry import query
from .trees import _CELL, _CORE2, _CORE_KEYS, _DIRECT_TERMS, _ENERGY, _GROUPS, _LEVELS, _WALK, keys_sql, r_sql, rounded

_PH = ("x", "y", "z", "vx", "vy", "vz")
DT = 0.0625
_D = f"WITH d AS MATERIALIZED (SELECT * FROM {DISK_SQL})"


@query(f"WITH f AS (SELECT * FROM {FRAMES_SQL}), g AS (SELECT t, e, (e - first(e) OVER w) / first(e) OVER w AS a, coalesce((e - lag(e) OVER w) / first(e) OVER w, 0) AS b FROM f WINDOW w AS (ORDER BY t)) SELECT t, " + ", ".join(r_sql(e, n) for e, n in (("a", "de"), ("b", "dde"), ("max(abs(a)) OVER (ORDER BY t)", "de_max"), ("max(abs(b)) OVER (ORDER BY t)", "dde_max"))) + " FROM g")
def energy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gravity.energy_drift(frames(spark, sf_dir)).select("t", "de", "dde", "de_max", "dde_max"), "de", "dde", "de_max", "dde_max")


_PRED = ", ".join([*(f"{c} + v{c} * {DT} + 0.5e0 * a{c} * {DT} * {DT} AS {c}" for c in "xyz"), *(f"v{c} + a{c} * {DT} AS v{c}" for c in "xyz")])


@query(_CORE2 + _ENERGY + f", q AS (SELECT c.id, {_PRED} FROM c JOIN a USING (id)) SELECT id, " + ", ".join(r_sql(c, c) for c in _PH) + " FROM q")
def predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)
    state = p.join(gravity.direct_gravity(p), "id").withColumn("t_beg", F.lit(0.0))
    return rounded(steps.predict(state, DT).select("id", *_PH), *_PH)


_STEP = _CORE2 + _ENERGY + f", q AS MATERIALIZED (SELECT c.id, c.mass, a.ax AS ox, a.ay AS oy, a.az AS oz, {_PRED} FROM c JOIN a USING (id)), t2 AS (SELECT p.id, {_DIRECT_TERMS} FROM q p, q j), n AS (SELECT id, sum(ax) AS ax, sum(ay) AS ay, sum(az) AS az, sum(pot) AS pot FROM t2 GROUP BY 1), e AS (SELECT id, q.mass, x, y, z, n.pot, " + ", ".join(f"v{c} + 0.5e0 * (n.a{c} - o{c}) * {DT} AS v{c}" for c in "xyz") + " FROM q JOIN n USING (id))"


@query(_STEP + " SELECT id, " + ", ".join(r_sql(c, c) for c in (*_PH, "pot")) + " FROM e")
def corrector(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)
    state = p.join(gravity.direct_gravity(p), "id").withColumns({"t_beg": F.lit(0.0), "t_end": F.lit(DT)})
    moved = cut(steps.predict(state, DT))
    return rounded(steps.correct(moved, gravity.direct_gravity(moved), DT, DT).select("id", *_PH, "pot"), *_PH, "pot")


@query(_STEP + f" SELECT CAST({DT} AS DOUBLE) AS t, " + r_sql("sum(0.5e0 * mass * (vx * vx + vy * vy + vz * vz))", "ekin") + ", " + r_sql("sum(0.5e0 * mass * pot)", "epot") + " FROM e")
def integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies after one step of the driving loop."""
    return rounded(steps.integrate(core(spark, sf_dir), 1, DT)[1].filter("t > 0").select("t", "ekin", "epot"), "ekin", "epot")


_PULLS = ", ".join(f"sum({c}) AS {c}" for c in ("ax", "ay", "az", "pot"))
_TREE_FORCE = _LEVELS + _GROUPS + _WALK + ", " + _CELL
_MOVED = f"(SELECT c.id, c.ptype, c.mass, a.ax AS ox, a.ay AS oy, a.az AS oz, {_PRED} FROM {CORE_SQL} c JOIN ({_CORE_KEYS}{_TREE_FORCE} SELECT id, {_PULLS} FROM terms GROUP BY 1) a USING (id))"


@query(keys_sql(_MOVED) + _TREE_FORCE + f", n AS (SELECT id, {_PULLS} FROM terms GROUP BY 1), e AS (SELECT k.mass, n.pot, " + ", ".join(f"k.v{c} + 0.5e0 * (n.a{c} - k.o{c}) * {DT} AS v{c}" for c in "xyz") + f" FROM keys k JOIN n USING (id)) SELECT CAST({DT} AS DOUBLE) AS t, " + r_sql("sum(0.5e0 * mass * (vx * vx + vy * vy + vz * vz))", "ekin") + ", " + r_sql("sum(0.5e0 * mass * pot)", "epot") + " FROM e")
def tree_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies after a step of the driving loop with the pull of a tree that is built anew."""
    history = steps.integrate(core(spark, sf_dir), 1, DT, gravity.TreeForce())[1]
    return rounded(history.filter("t > 0").select("t", "ekin", "epot"), "ekin", "epot")


@query(f"{_D}, t AS (SELECT CAST(id % 8 AS DOUBLE) / 8 + 0.125e0 AS t_end FROM d) SELECT min(t_end) AS t_next, (SELECT count(*) FROM t WHERE t_end = (SELECT min(t_end) FROM t)) AS n_active FROM t")
def next_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.next_time(disk(spark, sf_dir).withColumn("t_end", (F.col("id") % 8).cast("double") / 8.0 + 0.125))


@query(f"{_D} SELECT id % 97 AS group_id, CAST(max(CAST(id % 8 = 0 AS INTEGER)) AS INTEGER) AS active FROM d GROUP BY 1")
def active_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir).withColumns({"t_end": (F.col("id") % 8).cast("double") / 8.0, "group_id": F.col("id") % 97})
    return steps.active_groups(p, 0.0)


@query(_CORE2 + _ENERGY + ", s AS (SELECT id, sqrt(ax * ax + ay * ay + az * az + 1e-30) AS a FROM a) SELECT id, least(pow(2e0, floor(log2(0.1e0 * sqrt(0.05e0 / a)))), 0.0625e0) AS dt_next FROM s")
def step_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion that the constant step replaces by default."""
    return steps.step_criterion(gravity.direct_gravity(core(spark, sf_dir)), DT, fixed=False).select("id", "dt_next")


_PAIR = f"{_D}, o AS (SELECT id, x, y, z, vx, vy, vz, mass * 20 AS m FROM d WHERE x * x + y * y > 1)"


@query(_PAIR + """, k AS (SELECT *, sqrt(x * x + y * y + z * z) AS r, 0.5e0 * (vx * vx + vy * vy + vz * vz) AS ek, pow(y * vz - z * vy, 2) + pow(z * vx - x * vz, 2) + pow(x * vy - y * vx, 2) AS l2, abs(x * vx + y * vy + z * vz) AS rv FROM o), e AS (SELECT *, ek - m / r AS e FROM k)
 SELECT id, CASE WHEN e > 0 THEN 'hyperbolic' WHEN e < 0 THEN 'elliptic' ELSE 'parabolic' END AS orbit, """ + ", ".join(r_sql(e, n, d) for e, n, d in (("l2 / (m + sqrt(greatest(m * m + 2 * e * l2, 0)))", "peri", 6), ("2e0 / 3 * r / sqrt(2 * m / r)", "t_ff", 6))) + " FROM e")
def orbit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir).filter("x * x + y * y > 1").withColumn("m", F.col("mass") * 20.0)
    return rounded(steps.orbit_diagnostics(p).select("id", "orbit", "peri", "t_ff"), "peri", "t_ff")


def _kick_sql() -> str:
    return _PAIR + ", s AS (SELECT id, 0 AS k, x, y, z, vx, vy, vz, m FROM o)" + "".join(
        f""", h{i} AS (SELECT id, m, x + vx * {dt} AS x, y + vy * {dt} AS y, z + vz * {dt} AS z, vx, vy, vz FROM {src}), g{i} AS (SELECT *, -m / pow(x * x + y * y + z * z, 1.5e0) * {2 * dt} AS f FROM h{i}), s{i} AS (SELECT id, m, x + (vx + f * x) * {dt} AS x, y + (vy + f * y) * {dt} AS y, z + (vz + f * z) * {dt} AS z, vx + f * x AS vx, vy + f * y AS vy, vz + f * z AS vz FROM g{i})"""
        for i, (src, dt) in enumerate((("s", 0.005), ("s0", 0.005), ("s1", 0.005)))
    ) + " SELECT id, " + ", ".join(r_sql(c, c) for c in _PH) + " FROM s2"


@query(_kick_sql())
def kick_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three drift-kick-drift steps of 0.01 in a point potential, of every body."""
    p = disk(spark, sf_dir).filter("x * x + y * y > 1").withColumn("m", F.col("mass") * 20.0)
    return rounded(steps.drift_kick_drift(p, 3, 0.01).select("id", *_PH), *_PH)


def _merge_sql() -> str:
    spin = physics.euler(0.3, 0.5, 0.7)
    com = lambda v: ", ".join(f"sum(mass * {c}) / sum(mass) AS k{c}" for c in _PH) + f", sum(mass) AS mt FROM {v}"
    turn = ", ".join(f"{' + '.join(f'({m!r}) * ({p}{c} - k{p}{c})' for m, c in zip(row, 'xyz', strict=True))} AS {p}{a}" for p in ("", "v") for a, row in zip("xyz", spin, strict=True))
    side = "sqrt(0.5e0 * (6e0 - 0.5e0))"
    orbit = f"SELECT m1, m2, 2 * 0.5e0 - 6e0 AS x, -2 * {side} AS y, {side} * sqrt(2 * (m1 + m2) / 0.5e0) / 6e0 AS vx, 0.5e0 * sqrt(2 * (m1 + m2) / 0.5e0) / 6e0 AS vy"
    put = lambda mu, s: ", ".join(f"g.{c} * {s} + {mu} * {f'o.{c}' if c[-1] != 'z' else '0'} AS {c}" for c in _PH)
    return f"""{_D}, a AS (SELECT * FROM d WHERE ptype = 1), b AS (SELECT * FROM d WHERE ptype = 2), ka AS (SELECT {com('a')}), kb AS (SELECT {com('b')}),
 ga AS (SELECT id, mass, {turn} FROM a, ka), gb AS (SELECT id, mass, {', '.join(f'{c} - k{c} AS {c}' for c in _PH)} FROM b, kb),
 o AS ({orbit} FROM (SELECT ka.mt AS m1, kb.mt AS m2 FROM ka, kb)),
 u AS (SELECT id, CAST(1 AS INTEGER) AS galaxy, {put('m2 / (m1 + m2)', '1')} FROM ga g, o UNION ALL SELECT id, 2, {put('(-m1 / (m1 + m2))', '1')} FROM gb g, o) SELECT id, galaxy, """ + ", ".join(r_sql(c, c, 5) for c in _PH) + " FROM u"


@query(_merge_sql())
def merge_galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir)
    found = merging.merge(p.filter("ptype = 1"), p.filter("ptype = 2"), 0.5, 6.0, spin_a=(0.3, 0.5, 0.7))
    return rounded(found.select("id", "galaxy", *_PH), *_PH, digits=5)


_GAL = physics.galactic(120.0, -30.0)


@query(f"{_D} SELECT id, " + ", ".join(r_sql(" + ".join(f"({m!r}) * {c}" for m, c in zip(row, "xyz", strict=True)), a) for a, row in zip("xyz", _GAL, strict=True)) + " FROM d")
def rotate_galactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(merging.rotated(disk(spark, sf_dir), _GAL).select("id", "x", "y", "z"), "x", "y", "z")


_EUL = physics.euler(0.2, 1.1, -0.4)


@query(f"{_D} SELECT id, " + ", ".join(r_sql(" + ".join(f"({m!r}) * {c}" for m, c in zip(row, "xyz", strict=True)), a) for a, row in zip("xyz", _EUL, strict=True)) + " FROM d")
def rotate_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(merging.rotated(disk(spark, sf_dir), _EUL).select("id", "x", "y", "z"), "x", "y", "z")


@query("SELECT CAST(epoch(s.b + INTERVAL (i.range) MINUTE) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, date_trunc('minute', ts) - INTERVAL 4 MINUTE AS b FROM events) s, range(5) i GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows over the event table: the batch twin of the streaming operator."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windowed_counts(e).withColumn("start", F.unix_seconds(F.col("start").cast("timestamp")))


@query(f"{_D}, l AS (SELECT range AS loop FROM range(2)) SELECT loop, count(*) AS n, " + r_sql("sum(CAST(CAST(mass AS FLOAT) AS DOUBLE))", "mass", 3) + " FROM d, l WHERE ptype <> 0 GROUP BY 1")
def replayed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots shown twice as a stream, without their dark matter; bodies and mass of each round."""
    folder, out = scratch(spark, "shown"), scratch(spark, "seen")
    shown = len(columnar.write_columnar(disk(spark, sf_dir).repartition(3, "id"), folder, 1.0))
    feed = replay(spark, folder, "mass double, is_dark boolean", loop=2, reduce_dark=0)
    each_frame(feed, lambda batch, number: batch.write.mode("append").parquet(out), scratch(spark, "ck"))
    rows = spark.read.parquet(out).groupBy(F.floor(F.col("frame") / shown).alias("loop")).agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    return rounded(rows, "mass", digits=3)


@query(f"WITH RECURSIVE f AS MATERIALIZED (SELECT t, t % 3 AS producer, 1 + n % 5 AS busy FROM {FRAMES_SQL}), s AS (SELECT producer, min(t) AS t FROM f GROUP BY 1 UNION ALL SELECT s.producer, (SELECT min(g.t) FROM f g WHERE g.producer = s.producer AND g.t >= s.t + f.busy) FROM s JOIN f ON f.producer = s.producer AND f.t = s.t WHERE s.t IS NOT NULL) SELECT producer, t, f.busy FROM s JOIN f USING (producer, t)")
def frames_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three producers that never wait for what is under way."""
    log = frames(spark, sf_dir).select((F.col("t") % 3).alias("producer"), "t", (1 + F.col("n") % 5).alias("busy"))
    return sent_frames(log, "producer")


def _u(seed: int, k: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{k}:' || id), 1, 13) AS BIGINT) / 4503599627370496e0)"


def _draws(seed: int, n: int) -> str:
    return f"{_D}, u AS MATERIALIZED (SELECT id, {', '.join(f'{_u(seed, k)} AS u{k}' for k in range(n))} FROM d)"


def _way(r: str, u: str, v: str) -> list[str]:
    flat = f"{r} * sqrt(1 - (1 - 2 * {u}) * (1 - 2 * {u}))"
    return [f"{flat} * cos({2 * math.pi!r}e0 * {v})", f"{flat} * sin({2 * math.pi!r}e0 * {v})", f"{r} * (1 - 2 * {u})"]


_LENGTH = 3 * math.pi / 16
_TRIED = ", ".join(f"CASE WHEN 0.1e0 * u{6 + 2 * i} < u{5 + 2 * i} * u{5 + 2 * i} * pow(1 - u{5 + 2 * i} * u{5 + 2 * i}, 3.5e0) THEN u{5 + 2 * i} END" for i in range(generators.TRIES))
_PLUMMER = _draws(19810614, 5 + 2 * generators.TRIES) + f""", r AS (SELECT *, 1 / sqrt(pow(greatest(u0, 1e-10) * {(1 + 100.0**-2) ** -1.5!r}e0, -2e0 / 3) - 1) AS r FROM u),
 v AS (SELECT *, coalesce({_TRIED}, {math.sqrt(2) / 3!r}e0) * sqrt(2e0) * pow(1 + r * r, -0.25e0) AS v FROM r),
 p AS MATERIALIZED (SELECT id, {", ".join(f"({e}) * {_LENGTH!r}e0 AS {c}" for c, e in zip("xyz", _way("r", "u1", "u2"), strict=True))}, {", ".join(f"({e}) / {math.sqrt(_LENGTH)!r}e0 AS v{c}" for c, e in zip("xyz", _way("v", "u3", "u4"), strict=True))} FROM v)"""


@query(_PLUMMER + " SELECT id, " + ", ".join(r_sql(f"{c} - avg({c}) OVER ()", c, 5) for c in _PH) + ", " + r_sql("1e0 / count(*) OVER ()", "mass", 9) + " FROM p")
def plummer_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Plummer sphere with the ids of the disk."""
    return rounded(rounded(generators.plummer_over(disk(spark, sf_dir).select("id")), *_PH, digits=5), "mass", digits=9)


@query(_draws(1, 3) + " SELECT id, " + ", ".join(r_sql(e, c, 9) for c, e in zip("xyz", _way("cbrt(u0)", "u1", "u2"), strict=True)) + ", 0e0 AS vx, 0e0 AS vy, 0e0 AS vz, " + r_sql("1e0 / count(*) OVER ()", "mass", 9) + " FROM u")
def sphere_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generators.sphere_over(disk(spark, sf_dir).select("id")), "x", "y", "z", "mass", digits=9)


@query(_draws(1, 3) + " SELECT id, " + ", ".join(f"2 * u{k} - 1 AS {c}" for k, c in enumerate("xyz")) + ", 0e0 AS vx, 0e0 AS vy, 0e0 AS vz, " + r_sql("1e6 / (CAST(count(*) OVER () AS DOUBLE) * count(*) OVER ())", "mass", 9) + " FROM u")
def cube_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generators.cube_over(disk(spark, sf_dir).select("id")).withColumn("mass", F.col("mass") * 1e6), "mass", digits=9)


@query(_draws(1, 4) + f", t AS (SELECT d.*, cos({2 * math.pi!r}e0 * u0) AS c, sin({2 * math.pi!r}e0 * u0) AS s, u1, u2, u3 FROM d JOIN u USING (id)) SELECT id, " + ", ".join(r_sql(e, n) for n, e in (("x", "x * c - y * s + (u1 - 0.5e0) * 0.002e0"), ("y", "x * s + y * c + (u2 - 0.5e0) * 0.002e0"), ("z", "z + (u3 - 0.5e0) * 0.002e0"), ("vx", "vx * c - vy * s"), ("vy", "vx * s + vy * c"))) + ", vz, mass FROM t")
def shuffled_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generators.shuffled_disk(disk(spark, sf_dir)).select("id", *_PH, "mass"), *_PH[:5])


_RING = (6.0, 0.5, 0.1, 0.2)
_FAR = [(f"sqrt(-2 * ln(greatest(u{1 + 2 * i}, 1e-300)))", f"{2 * math.pi!r}e0 * u{2 + 2 * i}") for i in range(generators.TRIES)]
_IN_RING = ", ".join(f"CASE WHEN abs({f} * cos({t})) <= 3 AND abs({f} * sin({t})) <= 3 AND {_RING[0]} + {_RING[1]} * {f} * cos({t}) > 0 THEN [{f} * cos({t}), {f} * sin({t})] END" for f, t in _FAR)
_TILT = physics.axis_angle((math.cos(math.pi / 2), math.sin(math.pi / 2), 0.0), _RING[3])


@query(_draws(1, 1 + 2 * generators.TRIES) + f""", w AS (SELECT id, {2 * math.pi!r}e0 * u0 AS phi, coalesce({_IN_RING}, [0e0, 0e0]) AS w FROM u), q AS (SELECT id, phi, {_RING[0]} + {_RING[1]} * w[1] AS r, {_RING[2]} * w[2] AS z FROM w),
 cv AS (SELECT r, avg(v) AS v FROM (SELECT sqrt(x * x + y * y) AS r, sqrt(vx * vx + vy * vy) AS v, vz FROM d WHERE ptype = 2) WHERE 0.01e0 * v > abs(vz) GROUP BY r), c1 AS MATERIALIZED (SELECT r, v, row_number() OVER (ORDER BY r) AS i FROM cv),
 b AS (SELECT q.*, (SELECT count(*) FROM c1 WHERE c1.r < q.r) AS i FROM q), e AS (SELECT b.id, b.r * cos(phi) AS x, b.r * sin(phi) AS y, b.z, lo.v + (b.r - lo.r) * (up.v - lo.v) / (up.r - lo.r) AS v, phi FROM b JOIN c1 lo ON lo.i = b.i JOIN c1 up ON up.i = b.i + 2),
 f AS (SELECT id, x, y, z, -v * sin(phi) AS vx, v * cos(phi) AS vy, 0e0 AS vz FROM e) SELECT id, """ + ", ".join(r_sql(" + ".join(f"({k!r}) * {v}{c}" for k, c in zip(row, "xyz", strict=True)), f"{v}{a}", 5) for v in ("", "v") for a, row in zip("xyz", _TILT, strict=True)) + ", 0e0 AS mass FROM f")
def dust_ring_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring with the ids of the disk, turning as its velocity curve says."""
    d = disk(spark, sf_dir)
    curve = profiles.rotation_curve(d)[0].select("r", "v")
    return rounded(generators.dust_ring_over(d.select("id"), *_RING, curve=curve), *_PH, digits=5)


_KEPLER = _PAIR.replace("WITH d", "WITH RECURSIVE d", 1) + """, k AS (SELECT id, m, 0e0 AS t, x, y, z, vx, vy, vz FROM o
  UNION ALL SELECT id, m, t + dt, x + (vx + f * x) * dt * 0.5e0, y + (vy + f * y) * dt * 0.5e0, z + (vz + f * z) * dt * 0.5e0, vx + f * x, vy + f * y, vz + f * z
   FROM (SELECT *, -m / pow(x * x + y * y + z * z, 1.5e0) * dt AS f FROM (SELECT id, m, t, dt, x + vx * dt * 0.5e0 AS x, y + vy * dt * 0.5e0 AS y, z + vz * dt * 0.5e0 AS z, vx, vy, vz FROM (SELECT *, 0.01e0 * sqrt(pow(x * x + y * y + z * z, 1.5e0) / m) AS dt FROM k WHERE t < 0.2e0))))"""


@query(_KEPLER + " SELECT id, " + ", ".join(r_sql(c, c) for c in _PH) + " FROM k WHERE t >= 0.2e0")
def kepler_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-body orbits over 0.2 with adaptive steps."""
    p = disk(spark, sf_dir).filter("x * x + y * y > 1").select("id", *_PH, (F.col("mass") * 20.0).alias("m"))
    return rounded(steps.kepler(p, 0.2, 0.01), *_PH)
