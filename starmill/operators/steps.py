"""Time integration: predictor, corrector, active sets, step criteria, the driving loop, and two-body orbits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import physics
from ..sources.views import COORDS
from . import gravity
from .cut import cut


def predict(p: DataFrame, t: float | Column) -> DataFrame:
    """Positions and velocities at time t from those at t_beg with acceleration ax, ay, az."""
    dt = (F.lit(t) if isinstance(t, float | int) else t) - F.col("t_beg")
    moved = {c: F.col(c) + F.col(f"v{c}") * dt + 0.5 * F.col(f"a{c}") * dt * dt for c in COORDS} | {f"v{c}": F.col(f"v{c}") + F.col(f"a{c}") * dt for c in COORDS}
    return p.withColumns(moved)


def correct(p: DataFrame, acc: DataFrame, t: float, dt: float, counts: DataFrame | None = None, target: float = 32.0) -> DataFrame:
    """Predicted rows of p that end at t take the mean of old and new acceleration (acc: id, ax, ay, az, pot); then the step [t, t + dt] begins.

    With counts (id, nnb: neighbours within h) the radius h of those rows moves towards target neighbours."""
    new = acc.select("id", *[F.col(f"a{c}").alias(f"_n{c}") for c in COORDS], F.col("pot").alias("_pot"))
    rows = p.join(new, "id")
    if counts is not None:
        rows = rows.join(counts.select("id", F.col("nnb").alias("_nnb")), "id", "left")
        adjusted = physics.adjusted_h(F.col("h"), F.coalesce("_nnb", F.lit(0.0)), target)
        rows = rows.withColumn("h", F.when(F.col("t_end") == t, adjusted).otherwise(F.col("h")))
    live = F.col("t_end") == t
    step = t - F.col("t_beg")
    kick = {f"v{c}": F.when(live, F.col(f"v{c}") + 0.5 * (F.col(f"_n{c}") - F.col(f"a{c}")) * step).otherwise(F.col(f"v{c}")) for c in COORDS}
    rows = rows.withColumns(kick)
    rows = rows.withColumns({f"a{c}": F.when(live, F.col(f"_n{c}")).otherwise(F.col(f"a{c}")) for c in COORDS} | {"pot": F.col("_pot")})
    return rows.withColumns({"t_beg": F.when(live, F.lit(float(t))).otherwise(F.col("t_beg")), "t_end": F.when(live, F.lit(float(t + dt))).otherwise(F.col("t_end"))}).select(*p.columns)


def next_time(p: DataFrame) -> DataFrame:
    """t_next and the number of bodies that end there."""
    return p.groupBy("t_end").agg(F.count("*").alias("n")).agg(F.min(F.struct("t_end", "n")).alias("m")).select(F.col("m.t_end").alias("t_next"), F.col("m.n").alias("n_active"))


def active_groups(grouped: DataFrame, t: float) -> DataFrame:
    return grouped.groupBy("group_id").agg(F.max((F.col("t_end") == t).cast("int")).alias("active"))


def step_criterion(p: DataFrame, dt: float, eta: float = 0.1, eps: float = gravity.EPS, fixed: bool = True) -> DataFrame:
    """p with dt_next: the constant step, or the power of two at or below eta times the softening time."""
    a = F.sqrt(sum((F.col(f"a{c}") * F.col(f"a{c}") for c in COORDS), F.lit(1e-30)))
    wish = eta * F.sqrt(F.lit(eps) / a)
    return p.withColumn("dt_next", F.lit(dt) if fixed else F.least(F.pow(F.lit(2.0), F.floor(F.log2(wish))), F.lit(dt)))


def integrate(p: DataFrame, steps: int, dt: float, acceleration: Callable[[DataFrame], DataFrame] | None = None, each: Callable[[int, float, DataFrame], None] | None = None, t_end: float = math.inf) -> tuple[DataFrame, DataFrame]:
    """(final state, history of t, ekin, epot, etot). acceleration: DataFrame -> id, ax, ay, az, pot; exact gravity by default.

    Every step's state is written to the checkpoint folder, so lineage stays one step long."""
    find = acceleration or gravity.direct_gravity
    state = p.join(find(p), "id").withColumns({"t_beg": F.lit(0.0), "t_end": F.lit(dt)})
    state = cut(state)
    log = [(0.0, *gravity.energies(state).first())]
    t = 0.0
    for i in range(1, steps + 1):
        if t >= t_end:
            break
        t = i * dt
        moved = cut(predict(state, t))
        state = cut(correct(moved, find(moved), t, dt))
        log.append((t, *gravity.energies(state).first()))
        if each:
            each(i, t, state)
    return state, p.sparkSession.createDataFrame(log, "t double, ekin double, epot double, etot double")


def parabolic_encounter(m1: float, m2: float, b: float, sep: float) -> dict[str, float]:
    """Relative place and velocity of two galaxies on a parabola of pericentre b at separation sep, and the time to the encounter."""
    if b > 0:
        vp = math.sqrt(2.0 * (m1 + m2) / b)
        side = math.sqrt(b * (sep - b))
        x, y, vx, vy = 2 * b - sep, -2 * side, side * vp / sep, b * vp / sep
        half = math.tan(0.5 * math.atan2(y, x))
        return {"x": x, "y": y, "vx": vx, "vy": vy, "t_coll": (0.5 * half + half**3 / 6.0) * 4 * b / vp}
    v = math.sqrt(2.0 * (m1 + m2) / sep)
    return {"x": -sep, "y": 0.0, "vx": v, "vy": 0.0, "t_coll": -(sep**1.5) / (1.5 * math.sqrt(2.0 * (m1 + m2)))}


def orbit_diagnostics(pairs: DataFrame) -> DataFrame:
    """pairs (id, x, y, z, vx, vy, vz relative, m total) with energy, class, angular momentum, pericentre, free-fall and drift times."""
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in COORDS), F.lit(0.0)))
    v2 = sum((F.col(f"v{c}") * F.col(f"v{c}") for c in COORDS), F.lit(0.0))
    cross = [F.col("y") * F.col("vz") - F.col("z") * F.col("vy"), F.col("z") * F.col("vx") - F.col("x") * F.col("vz"), F.col("x") * F.col("vy") - F.col("y") * F.col("vx")]
    out = pairs.withColumns({"r": r, "e": 0.5 * v2 - F.col("m") / r, "l2": cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2], "rv": F.abs(sum((F.col(c) * F.col(f"v{c}") for c in COORDS), F.lit(0.0)))})
    out = out.withColumn("orbit", F.when(F.col("e") > 0, "hyperbolic").when(F.col("e") < 0, "elliptic").otherwise("parabolic"))
    peri = F.col("l2") / (F.col("m") + F.sqrt(F.greatest(F.col("m") * F.col("m") + 2.0 * F.col("e") * F.col("l2"), F.lit(0.0))))
    return out.withColumns({"peri": peri, "t_ff": 2.0 / 3.0 * F.col("r") / F.sqrt(2.0 * F.col("m") / F.col("r")), "t_drift": F.try_divide(F.col("r") * F.col("r"), F.col("rv"))})


def drift_kick_drift(pairs: DataFrame, steps: int, dt: float) -> DataFrame:
    """pairs (id, x, y, z, vx, vy, vz relative, m total) after so many steps of constant dt, as columns."""
    for _ in range(steps):
        pairs = pairs.withColumns({c: F.col(c) + F.col(f"v{c}") * (dt / 2) for c in COORDS})
        pairs = pairs.withColumn("_f", -F.col("m") / F.pow(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"), F.lit(1.5)) * dt)
        pairs = pairs.withColumns({f"v{c}": F.col(f"v{c}") + F.col("_f") * F.col(c) for c in COORDS})
        pairs = pairs.withColumns({c: F.col(c) + F.col(f"v{c}") * (dt / 2) for c in COORDS}).drop("_f")
    return pairs


def kepler(pairs: DataFrame, duration: float, eps: float = 1e-3) -> DataFrame:
    """id and relative place and velocity after duration, by drift-kick-drift with steps of eps times the local dynamical time.

    All rows of a batch step together; those that have reached the duration rest."""

    def run(batches):
        for b in batches:
            pos, vel, m = b[["x", "y", "z"]].to_numpy(float), b[["vx", "vy", "vz"]].to_numpy(float), b["m"].to_numpy(float)
            t = np.zeros(len(b))
            while len(live := np.flatnonzero(t < duration)):
                r, v = pos[live], vel[live]
                dt = eps * np.sqrt((r * r).sum(1) ** 1.5 / m[live])
                r += v * (dt * 0.5)[:, None]
                v -= r * (m[live] / (r * r).sum(1) ** 1.5 * dt)[:, None]
                r += v * (dt * 0.5)[:, None]
                pos[live], vel[live] = r, v
                t[live] += dt
            yield pd.DataFrame({"id": b["id"], **{c: pos[:, i] for i, c in enumerate(COORDS)}, **{f"v{c}": vel[:, i] for i, c in enumerate(COORDS)}})

    return pairs.select("id", *COORDS, *[f"v{c}" for c in COORDS], "m").mapInPandas(run, "id long, x double, y double, z double, vx double, vy double, vz double")
