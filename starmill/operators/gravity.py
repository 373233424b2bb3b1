"""Exact and tree-approximated gravity, energies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import physics
from ..sources.views import COORDS
from . import tree
from .cut import cut

EPS, THETA = 0.05, 0.75
SOURCES = 1024
#: Into how many parts bodies are dealt while the parts keep within SIDE (least, most), and the bodies of either part in a tile.
PARTS, SIDE, TILE = 12, (1024, 32_768), (64, 1024)
QUADRUPOLE = ("q11", "q22", "q33", "q12", "q13", "q23")


def _one_way(place: list[np.ndarray], other: list[np.ndarray], mass: np.ndarray, eps: float, own: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """ax, ay, az, pot of bodies at place by those at other, tile by tile; pairs whose own and of are equal are left out."""
    total = np.zeros((4, len(place[0])))
    held = [np.empty(TILE) for _ in range(6)]
    for lo in range(0, len(place[0]) if len(mass) else 0, TILE[0]):
        rows = slice(lo, lo + TILE[0])
        for at in range(0, len(mass), TILE[1]):
            cols = slice(at, at + TILE[1])
            pull = mass[cols]
            *d, r2, r, w = (h[: len(place[0][rows]), : len(pull)] for h in held)
            r2.fill(eps * eps)
            for k in range(3):
                np.subtract(other[k][None, cols], place[k][rows, None], out=d[k])
                np.multiply(d[k], d[k], out=w)
                np.add(r2, w, out=r2)
            if own is not None:
                r2[own[rows, None] == of[None, cols]] = np.inf
            np.sqrt(r2, out=r)
            np.divide(1.0, r, out=r)
            total[3, rows] -= r @ pull
            np.multiply(r, r, out=w)
            np.multiply(w, r, out=w)
            np.multiply(w, pull, out=w)
            for k in range(3):
                total[k, rows] += np.einsum("ij,ij->i", w, d[k])
    return total


def _both_ways(place: list[np.ndarray], mine: np.ndarray, other: list[np.ndarray], mass: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """ax, ay, az, pot of two sets of bodies by each other: the distance of a pair is found once for both."""
    total, back = np.zeros((4, len(mine))), np.zeros((4, len(mass)))
    held = [np.empty(TILE) for _ in range(6)]
    for lo in range(0, len(mine), TILE[0]):
        rows = slice(lo, lo + TILE[0])
        own = mine[rows]
        for at in range(0, len(mass), TILE[1]):
            cols = slice(at, at + TILE[1])
            pull = mass[cols]
            *d, r2, r, w = (h[: len(own), : len(pull)] for h in held)
            r2.fill(eps * eps)
            for k in range(3):
                np.subtract(other[k][None, cols], place[k][rows, None], out=d[k])
                np.multiply(d[k], d[k], out=w)
                np.add(r2, w, out=r2)
            np.sqrt(r2, out=r)
            np.divide(1.0, r, out=r)
            total[3, rows] -= r @ pull
            back[3, cols] -= own @ r
            np.multiply(r, r, out=w)
            np.multiply(w, r, out=w)
            for k in range(3):
                np.multiply(w, d[k], out=d[k])
                total[k, rows] += d[k] @ pull
                back[k, cols] -= own @ d[k]
    return total, back


def _direct(eps: float, exclude_self: bool):
    """The function that sums the pull of two parts on each other, or of a part on itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one = bool(left.num_rows and right.num_rows and left["_a"][0] == right["_b"][0])
        sides = [left] if one else [left, right]
        place = [[t[c].to_numpy() for c in COORDS] for t in sides]
        mass = [t["mass"].to_numpy() for t in sides]
        # a source without place or mass pulls nothing
        full = [~np.logical_or.reduce([np.isnan(c) for c in (*xyz, m)]) for xyz, m in zip(place, mass, strict=True)]
        held = [([c[f] for c in xyz], m[f]) for xyz, m, f in zip(place, mass, full, strict=True)]
        if one:
            ids = left["id"].to_pandas().to_numpy() if exclude_self else None
            totals = [_one_way(place[0], *held[0], eps, ids, ids[full[0]] if exclude_self else None)]
        else:
            # equal ids are of one part
            totals = [np.zeros((4, t.num_rows)) for t in sides]
            for total, f, got in zip(totals, full, _both_ways(*held[0], *held[1], eps), strict=True):
                total[:, f] = got
            for total, f, xyz, by in zip(totals, full, place, reversed(held), strict=True):
                if not f.all():
                    total[:, ~f] = _one_way([c[~f] for c in xyz], *by, eps)
        found = []
        for t, total in zip(sides, totals, strict=True):
            unknown = np.logical_or.reduce([t[c].is_null().to_numpy() for c in COORDS])
            found.append(pa.table([t["id" if t is left else "jd"], *(pa.array(x, mask=unknown) for x in total)], names=["id", "ax", "ay", "az", "pot"]))
        return pa.concat_tables(found)

    return run


def direct_gravity(p: DataFrame, eps: float = EPS, exclude_self: bool = False) -> DataFrame:
    """id, ax, ay, az, pot of every body by every body, the self pair included unless excluded.

    All pairs are the definition here. Bodies are dealt in parts of at most SIDE; each two parts meet in a group of their own, which sums what they pull at each other tile by tile,
    and so does each part with itself: rows go by bodies and parts and not by pairs. A source without place or mass pulls nothing."""
    n = p.count()
    sides = -(-n // max(min(-(-n // PARTS), SIDE[1]), SIDE[0])) or 1
    own, last = F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int"), F.lit(sides - 1)
    cols = [F.col(c).cast("double").alias(c) for c in (*COORDS, "mass")]
    left = p.select("id", *cols, own.alias("_a")).withColumn("_b", F.explode(F.sequence("_a", last)))
    right = p.select(F.col("id").alias("jd"), *cols, own.alias("_b")).withColumn("_a", F.explode(F.sequence(F.lit(0), "_b")))
    # a task a group: they are few bytes and much work
    sided = [r.repartition(sides * sides, "_a", "_b") for r in (left, right)]
    schema = f"id {p.schema['id'].dataType.simpleString()}, ax double, ay double, az double, pot double"
    found = sided[0].groupBy("_a", "_b").cogroup(sided[1].groupBy("_a", "_b")).applyInArrow(_direct(eps, exclude_self), schema)
    return found.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("ax", "ay", "az", "pot")])


def walk(nodes: DataFrame, groups: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """(group_id with the cells it accepts, group_id with the leaves it opens).

    The frontier starts with all nodes of the start level and goes down a level a round; leaves of higher levels cannot exist. Each round is one equi-join of the opened nodes with their
    children and is written to the checkpoint folder."""
    key = ["level", "prefix_hi", "prefix_lo"]
    cells = nodes.select(*key, "is_leaf", "com_x", "com_y", "com_z", "open2")
    box = groups.select("group_id", *[f"g{c}" for c in COORDS], *[f"e{c}" for c in COORDS])
    first = cells.filter(F.col("level") == start)
    frontier = box.crossJoin(F.broadcast(first))
    accepted, opened = [], []
    for _ in range(start, tree.DEEPEST + 2):
        gap = [F.greatest(F.abs(F.col(f"g{c}") - F.col(f"com_{c}")) - F.col(f"e{c}"), F.lit(0.0)) for c in COORDS]
        far = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] > F.col("open2")
        now = cut(frontier.withColumn("far", far))
        accepted.append(now.filter("far").select("group_id", *key))
        opened.append(now.filter("NOT far AND is_leaf").select("group_id", *key))
        inner = now.filter("NOT far AND NOT is_leaf")
        if inner.isEmpty():
            break
        up = inner.select("group_id", *[f"g{c}" for c in COORDS], *[f"e{c}" for c in COORDS], (F.col("level") + 1).alias("level"), F.col("prefix_hi").alias("u_hi"), F.col("prefix_lo").alias("u_lo"))
        p_hi, p_lo = tree.parent()
        down = cells.withColumns({"u_hi": p_hi, "u_lo": p_lo})
        frontier = up.join(down, ["level", "u_hi", "u_lo"]).drop("u_hi", "u_lo")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(accepted), union(opened)


def _pull(eps: float):
    """The function that sums the pull of the sources of a group (mass, place, moments, which are 0 for bodies) on its members."""

    def run(sources: pa.Table, members: pa.Table) -> pa.Table:
        target, n = [members[c].to_numpy()[:, None] for c in COORDS], members.num_rows
        total = np.zeros((4, n))
        is_cell = sources["cell"].to_numpy(zero_copy_only=False)
        held = [np.empty((n, SOURCES)) for _ in range(6)] if n else []

        def near(part: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            """Ways to members, one over the softened distance and over its square, in the arrays held."""
            *d, r2, r, w = (h[:, : len(part["mass"])] for h in held)
            r2.fill(eps * eps)
            for k, c in enumerate(COORDS):
                np.subtract(target[k], part[c][None], out=d[k])
                np.multiply(d[k], d[k], out=w)
                np.add(r2, w, out=r2)
            np.sqrt(r2, out=r)
            np.divide(1.0, r, out=r)
            np.multiply(r, r, out=w)
            return d, r, w

        for kind, names in ((~is_cell, ("mass", *COORDS)), (is_cell, ("mass", *COORDS, *QUADRUPOLE))):
            held_by = {c: sources[c].to_numpy()[kind] for c in names}
            for lo in range(0, len(held_by["mass"]) if n else 0, SOURCES):
                col = {c: v[lo : lo + SOURCES] for c, v in held_by.items()}
                d, r, inverse = near(col)
                mass = col["mass"]
                if "q11" not in col:
                    # a body has no moments
                    total[3] -= r @ mass
                    np.multiply(inverse, r, out=r)
                    for k in range(3):
                        np.multiply(d[k], r, out=d[k])
                        total[k] -= d[k] @ mass
                    continue
                d0 = mass * r
                d1 = -d0 * inverse
                d2 = -3.0 * d1 * inverse
                d3 = -5.0 * d2 * inverse
                u = [sum(col[q] * x for q, x in zip(row, d, strict=True)) for row in (("q11", "q12", "q13"), ("q12", "q22", "q23"), ("q13", "q23", "q33"))]
                w = d[0] * u[0] + d[1] * u[1] + d[2] * u[2]
                trace = col["q11"] + col["q22"] + col["q33"]
                radial = d1 + 0.5 * (d2 * trace + d3 * w)
                for k in range(3):
                    total[k] += (radial * d[k] + d2 * u[k]).sum(1)
                total[3] -= (d0 + 0.5 * (d1 * trace + d2 * w)).sum(1)
        cells = int(np.count_nonzero(is_cell))
        counts = [pa.array(np.full(members.num_rows, n)) for n in (cells, sources.num_rows - cells)]
        return pa.table([members["id"], *(pa.array(t) for t in total), *counts], names=["id", "ax", "ay", "az", "pot", "n_approx", "n_direct"])

    return run


def tree_gravity(bodies: DataFrame, nodes: DataFrame, grouped: DataFrame, start: int, eps: float = EPS) -> DataFrame:
    """id, ax, ay, az, pot, n_approx, n_direct. nodes: with properties; grouped: bodies with keys and group_id.

    Cells and bodies are sent once to a group of bodies, whose members sum them together: rows go by groups and not by pairs of bodies."""
    accepted, opened = walk(nodes, tree.group_boxes(grouped), start)
    key = ["level", "prefix_hi", "prefix_lo"]
    cells = nodes.select(*key, F.lit(True).alias("cell"), "mass", *[F.col(f"com_{c}").alias(c) for c in COORDS], *QUADRUPOLE)
    leafy = tree.leaf_of(grouped, nodes).select(*key, F.lit(False).alias("cell"), "mass", *COORDS, *[F.lit(0.0).alias(q) for q in QUADRUPOLE])
    sources = accepted.join(cells, key).drop(*key).unionByName(opened.join(leafy, key).drop(*key))
    members = grouped.select(F.col("group_id").alias("member_of"), "id", *COORDS)
    schema = f"id {grouped.schema['id'].dataType.simpleString()}, ax double, ay double, az double, pot double, n_approx long, n_direct long"
    return sources.groupBy("group_id").cogroup(members.groupBy("member_of")).applyInArrow(_pull(eps), schema)


def plan_tree(bodies: DataFrame, theta: float = THETA, nleaf: int = tree.LEAF, ncrit: int = tree.GROUP) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with properties, bodies with keys, rn and group_id, start level)."""
    from ..functions.sfc import sfc_keys

    keyed = tree.ordered(sfc_keys(bodies))
    start = tree.start_level(keyed)
    nodes = tree.build_nodes(keyed, nleaf, start=start)
    props = cut(tree.node_properties(nodes, keyed, theta))
    return props, cut(tree.make_groups(keyed, start, ncrit)), start


class TreeForce:
    """The pull of the tree, for the driving loop: keys, nodes and groups are made anew every rebuild calls, and their moments and boxes at each call."""

    def __init__(self, theta: float = THETA, eps: float = EPS, rebuild: int = 1, nleaf: int = tree.LEAF, ncrit: int = tree.GROUP):
        self.theta, self.eps, self.rebuild, self.nleaf, self.ncrit = theta, eps, rebuild, nleaf, ncrit
        self.calls = 0

    def _plan(self, p: DataFrame) -> None:
        from ..functions.sfc import sfc_keys

        keyed = tree.ordered(sfc_keys(p))
        self.start = tree.start_level(keyed)
        self.nodes = tree.build_nodes(keyed, self.nleaf, start=self.start)
        self.keys = cut(tree.make_groups(keyed, self.start, self.ncrit).select("id", "key_hi", "key_lo", "rn", "group_id"))

    def __call__(self, p: DataFrame) -> DataFrame:
        """id, ax, ay, az, pot of every body of p (id, x, y, z, mass)."""
        if self.calls % self.rebuild == 0:
            self._plan(p)
        self.calls += 1
        bodies = cut(p.select("id", *COORDS, "mass").join(self.keys, "id"))
        props = cut(tree.node_properties(self.nodes, bodies, self.theta))
        return tree_gravity(bodies, props, bodies, self.start, self.eps).select("id", "ax", "ay", "az", "pot")


def energies(p: DataFrame) -> DataFrame:
    """ekin, epot, etot of bodies with mass, velocity and pot."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return p.agg(F.sum(0.5 * F.col("mass") * v2).alias("ekin"), F.sum(0.5 * F.col("mass") * F.col("pot")).alias("epot")).withColumn("etot", F.col("ekin") + F.col("epot"))


def energy_drift(history: DataFrame, time: str = "t", energy: str = "e") -> DataFrame:
    """history with de to the first, dde to the previous value, both relative to the first, and running maxima of their sizes. One row a step: a small table."""
    w = Window.orderBy(time)
    first, last = F.first(energy).over(w), F.lag(energy).over(w)
    out = history.withColumns({"de": F.try_divide(F.col(energy) - first, first), "dde": F.coalesce(F.try_divide(F.col(energy) - last, first), F.lit(0.0))})
    return out.withColumns({"de_max": F.max(F.abs("de")).over(w), "dde_max": F.max(F.abs("dde")).over(w)})


def interaction_flops(found: DataFrame) -> DataFrame:
    """Totals and means of interactions and the floating-point work they stand for (65 a cell, 23 a body)."""
    return found.agg(F.sum("n_approx").alias("n_approx"), F.sum("n_direct").alias("n_direct"), F.avg("n_approx").alias("mean_approx"), F.avg("n_direct").alias("mean_direct")).withColumn("flops", 65 * F.col("n_approx") + 23 * F.col("n_direct"))


def throughput(log: DataFrame) -> DataFrame:
    """log (seconds, n, n_approx, n_direct: a row a step) with bodies and 10**12 operations a second (65 a cell, 23 a body)."""
    return log.withColumns({"rate": F.try_divide("n", "seconds"), "tflops": F.try_divide((65 * F.col("n_approx") + 23 * F.col("n_direct")) / 1e12, F.col("seconds"))})


def load_statistics(log: DataFrame, step: str = "step", seconds: str = "seconds") -> DataFrame:
    """step, longest and mean time over the parts of each step, and the first over the second."""
    per = log.groupBy(step).agg(F.max(seconds).alias("longest"), F.avg(seconds).alias("mean"))
    return per.withColumn("imbalance", F.try_divide("longest", "mean"))


def essential_cells(nodes: DataFrame, domains: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """What domains (group_id, centre g*, half size e*) need of a tree: (cells taken whole, leaves whose bodies are sent), one row a domain and node."""
    return walk(nodes, domains, start)


def boundary_is_enough(boundary: DataFrame, domains: DataFrame) -> DataFrame:
    """group_id, enough: whether a tree cut short (nodes with truncated) answers a domain without finer data: no cut node that isn't a leaf would be opened."""
    cells = boundary.withColumnsRenamed({"is_leaf": "_leaf"}).withColumn("is_leaf", F.col("truncated"))
    _, opened = walk(cells, domains, 0)
    finer = opened.join(boundary.filter("truncated AND NOT is_leaf").select("level", "prefix_hi", "prefix_lo"), ["level", "prefix_hi", "prefix_lo"], "left_semi").select("group_id").distinct().withColumn("_finer", F.lit(True))
    return domains.join(finer, "group_id", "left").select("group_id", F.col("_finer").isNull().alias("enough"))
