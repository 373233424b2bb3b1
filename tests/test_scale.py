"""Operators whose plans must hold at any size, at sizes where their levels, parts and stretches all come into play."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starmill.operators import cut, density, gravity, partition, profiles
from starmill.plans import registry
from starmill.sources.views import disk


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sum_over_all_levels(spark, monkeypatch):
    monkeypatch.setattr(cut, "LEVELS", (2, 4, 6))
    n = 700
    rows = spark.range(n).select((F.col("id") + 1).alias("rn"), (F.col("id") * 7919 % 31).alias("v")).repartition(5)
    got = {r["rn"]: r["s"] for r in cut.running_sum(rows, "v", "s").collect()}
    want = np.cumsum([i * 7919 % 31 for i in range(n)])
    assert [got[i + 1] for i in range(n)] == want.tolist()


@pytest.mark.parametrize("points", [0, 1, 2, 3, 40])
def test_asof_across_stretches(spark, points):
    rng = np.random.default_rng(points)
    curve = [(float(r), float(v)) for r, v in zip(rng.integers(0, 300, points) / 10, rng.random(points), strict=True)]
    bodies = [(i, float(r)) for i, r in enumerate(rng.integers(0, 320, 900) / 10)] + [(9000, None), (9001, float("nan"))] + [(9100 + i, 15.0) for i in range(200)]
    c = spark.createDataFrame(curve, "r double, v double").repartition(3)
    found = {r["id"]: r["v_curve"] for r in profiles.interpolate_curve(spark.createDataFrame(bodies, "id long, r double").repartition(4), c).collect()}
    assert len(found) == len(bodies)
    by: dict[float, list[float]] = {}
    for r, v in curve:
        by.setdefault(r, []).append(v)
    rs = sorted(by)
    for i, r in bodies:
        at = int(np.searchsorted(rs, r)) if r is not None and r == r else 0
        if not 0 < at < len(rs) - 1:
            assert found[i] is None
            continue
        lo, up = rs[at - 1], rs[at + 1]
        a, b = np.mean(by[lo]), np.mean(by[up])
        assert found[i] == pytest.approx(a + (r - lo) * (b - a) / (up - lo), abs=1e-9)


def test_boxes_by_binary_search(spark):
    """The same boxes as comparing each body with every box, open sides, ties and bodies without a place included."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, np.round(rng.normal(size=3), 1)), 0.3) for i in range(800)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double, h double")
    boxes = cut.cut(partition.orb_boxes(partition.bisect(p, 5, 4, 3)))
    odd = p.unionByName(spark.createDataFrame([(9000, None, 0.0, 0.0, 0.1), (9001, 1e9, -1e9, 0.0, 0.1)], p.schema))
    table = boxes.collect()
    inside = lambda q, b, pad: all((b[f"low_{c}"] is None or q[c] + pad >= b[f"low_{c}"]) and (b[f"high_{c}"] is None or q[c] - pad < b[f"high_{c}"]) for c in "xyz")
    bodies = odd.filter("x IS NOT NULL").collect()
    want = {(b["box"], q["id"], inside(q, b, 0)) for q in bodies for b in table if inside(q, b, 2 * q["h"])}
    assert {tuple(r) for r in partition.replicate_halo(odd, boxes).collect()} == want
    held = {r["id"]: r["box"] for r in partition.box_of(odd, boxes).collect()}
    assert held[9000] == -1 and len(held) == 802
    assert all(held[q["id"]] in [b["box"] for b in table if inside(q, b, 0)] or held[q["id"]] == -1 for q in bodies)
    assert "NestedLoop" not in _plan(partition.replicate_halo(odd, boxes)) + _plan(partition.box_of(odd, boxes))
    assert partition.box_of(p, boxes.limit(0)).filter("box <> -1").isEmpty()


def test_dense_buckets_are_dealt(spark):
    """Half of the bodies in one bucket: the same pairs, and no pair of parts larger than its bound."""
    rng = np.random.default_rng(6)
    place = np.concatenate([rng.random((300, 3)) * 0.01, rng.random((300, 3)) * 4])
    rows = [(i, *map(float, x), 1.0, float(h)) for i, (x, h) in enumerate(zip(place, 10.0 ** -rng.random(600) * 3, strict=True))]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double, mass double, h double")
    d2 = ((place[:, None] - place[None]) ** 2).sum(2)
    h = np.array([r[5] for r in rows])
    want = {(i, j) for i, j in zip(*np.nonzero(d2 < (h * h)[:, None]), strict=True)}
    for cell, part in ((1.0, 1024), (0.05, 16)):
        pairs = density.bucket_pairs(p, cell, part)
        r2 = sum(((F.col(c) - F.col(f"j{c}")) * (F.col(c) - F.col(f"j{c}")) for c in "xyz"), F.lit(0.0))
        assert {tuple(r) for r in pairs.filter(r2 < F.col("h") * F.col("h")).select("id", "jd").collect()} == want
    # parts are dealt by hash, so one may be somewhat larger than the mean
    largest = pairs.groupBy("level", "bx", "by", "bz", "at_pa", "at_ph").count().agg(F.max("count")).first()[0]
    assert largest <= (3 * 16) ** 2
    assert density.bucket_pairs(p.withColumn("h", F.lit(0.0)), 1.0).isEmpty()


def test_disk_gravity_is_near_the_direct_sum(spark):
    """The tree's pull on the disk of the small tables within a hundredth of the exact one, for nearly all bodies."""
    found = {r["id"]: r for r in registry.queries()["disk_gravity"](spark, "/root/testdata/sf0.001").collect()}
    p = disk(spark, "/root/testdata/sf0.001").select("id", "x", "y", "z", "mass").toPandas()
    place, mass = p[["x", "y", "z"]].to_numpy(), p["mass"].to_numpy()
    d = place[None] - place[:, None]
    r2 = (d * d).sum(2) + gravity.EPS**2
    exact = (mass[None, :, None] * d / (r2 * np.sqrt(r2))[..., None]).sum(1)
    got = np.array([[found[i][f"a{c}"] for c in "xyz"] for i in p["id"]])
    error = np.linalg.norm(got - exact, axis=1) / np.linalg.norm(exact, axis=1)
    assert len(found) == len(p) and np.quantile(error, 0.95) < 0.01
    pot = np.array([found[i]["pot"] for i in p["id"]])
    assert np.allclose(pot, -(mass / np.sqrt(r2)).sum(1), rtol=5e-3)


def test_direct_gravity_by_parts(spark, monkeypatch):
    """Parts and tiles far smaller than the bodies: the plain sum, and no join of pairs in the plan."""
    monkeypatch.setattr(gravity, "SIDE", (16, 16))
    monkeypatch.setattr(gravity, "TILE", (5, 7))
    rng = np.random.default_rng(7)
    place, mass = rng.normal(size=(90, 3)), rng.random(90)
    rows = [(i, *map(float, x), float(m)) for i, (x, m) in enumerate(zip(place, mass, strict=True))]
    p = spark.createDataFrame([*rows, (90, 0.1, 0.2, 0.3, None), (91, None, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, mass double").repartition(3)
    for own in (False, True):
        found = gravity.direct_gravity(p, 0.1, exclude_self=own)
        assert "Cartesian" not in _plan(found) and "NestedLoop" not in _plan(found)
        got = {r["id"]: r for r in found.collect()}
        assert set(got) == set(range(92)) and got[91]["ax"] is None and got[91]["pot"] is None
        d = place[None] - place[:, None]
        w = 1 / np.sqrt((d * d).sum(2) + 0.01)
        if own:
            np.fill_diagonal(w, 0)
        assert np.allclose([got[i]["pot"] for i in range(90)], -(w @ mass), rtol=1e-12)
        want = ((w**3 * mass)[..., None] * d).sum(1)
        assert np.allclose([[got[i][f"a{c}"] for c in "xyz"] for i in range(90)], want, rtol=1e-9, atol=1e-12)


def test_neighbours_are_counted_without_a_kernel(spark, monkeypatch):
    """Where only the number is asked, it equals that of the density's, and no density is worked out."""
    rng = np.random.default_rng(12)
    rows = [(i, *map(float, x), 1.0, 0.3 + 0.1 * (i % 4)) for i, x in enumerate(rng.random((150, 3)) * 2)]
    p = spark.createDataFrame([*rows, (150, 50.0, 50.0, 50.0, 1.0, 0.2)], "id long, x double, y double, z double, mass double, h double")
    want = {r["id"]: r["nnb"] for r in density.neighbour_density(p, 0.3).collect()}
    got = density.neighbour_density(p, 0.3, "count").collect()
    assert {r["id"]: r["nnb"] for r in got} == want and want[150] == 1
    assert all(r["rho"] == 0 for r in got)


def test_two_parts_pull_each_other_at_once(monkeypatch):
    """A group of two parts gives the sums of both, so a pair is not found twice; bodies without mass are pulled and pull nothing."""
    monkeypatch.setattr(gravity, "TILE", (5, 7))
    rng = np.random.default_rng(9)
    place, mass = rng.normal(size=(60, 3)), rng.random(60)
    mass[[3, 40]] = np.nan
    cols = {c: place[:, k] for k, c in enumerate("xyz")} | {"mass": mass}
    part = lambda rows, name, a, b: pa.table({name: np.arange(60)[rows]} | {c: pa.array(v[rows], from_pandas=True) for c, v in cols.items()} | {"_a": np.full(60, a)[rows], "_b": np.full(60, b)[rows]})
    found = gravity._direct(0.1, False)(part(slice(0, 25), "id", 0, 1), part(slice(25, 60), "jd", 0, 1)).to_pydict()
    assert found["id"] == list(range(60))
    d = place[None] - place[:, None]
    w = 1 / np.sqrt((d * d).sum(2) + 0.01) * np.nan_to_num(mass)
    w[:25, :25] = w[25:, 25:] = 0
    assert np.allclose(found["pot"], -w.sum(1), rtol=1e-12)
    w *= 1 / ((d * d).sum(2) + 0.01)
    assert np.allclose(np.stack([found[f"a{c}"] for c in "xyz"], 1), (w[..., None] * d).sum(1), rtol=1e-9, atol=1e-12)


def test_density_by_parts(spark, monkeypatch):
    """Parts, groups and tiles far smaller than the bodies of a bucket: the plain sums, and no row for each pair."""
    monkeypatch.setattr(density, "SUMMED_PART", 16)
    monkeypatch.setattr(density, "ROWS", 100)
    monkeypatch.setattr(density, "TILE", 12)
    rng = np.random.default_rng(8)
    place = np.concatenate([rng.random((80, 3)) * 0.2, rng.random((80, 3)) * 3])
    h, mass = np.where(np.arange(160) % 9 == 0, 0.0, 0.1 + rng.random(160)), rng.random(160)
    p = spark.createDataFrame([(i, *map(float, x), float(m), float(k)) for i, (x, m, k) in enumerate(zip(place, mass, h, strict=True))], "id long, x double, y double, z double, mass double, h double")
    r2 = ((place[:, None] - place[None]) ** 2).sum(2)
    near = r2 < (h * h)[:, None]
    k = np.where(h > 0, h, 1.0)[:, None]
    q, u = np.sqrt(r2) / k, np.maximum(1 - r2 / (k * k), 0)
    m4 = np.where(near, 8 / np.pi / k**3 * np.where(q < 0.5, 1 - 6 * q * q * (1 - q), 2 * (1 - q) ** 3) * mass, 0).sum(1)
    quartic = np.where(near, 3465 / (512 * np.pi) / k**3 * u**4, 0).sum(1)
    for kernel, rho, nnb in (("m4", m4, near.sum(1)), ("quartic", quartic, np.where(near, np.ceil(u * u), 0).sum(1))):
        found = density.neighbour_density(p, 0.3, kernel)
        # the pairs themselves are no join any more
        assert "CoGroup" in _plan(found).replace("Cogroup", "CoGroup")
        got = {r["id"]: r for r in found.collect()}
        assert set(got) == set(np.flatnonzero(h > 0).tolist())
        assert all(np.isclose(r["rho"], rho[i], rtol=1e-10) and r["nnb"] == nnb[i] and r["h"] == h[i] for i, r in got.items())


def test_bodies_of_leaves_take_no_moments(monkeypatch):
    """Of sources that are bodies nothing is worked out for moments they lack; with cells among them the sums are those of the expansion."""
    monkeypatch.setattr(gravity, "SOURCES", 7)
    rng = np.random.default_rng(11)
    cell = np.arange(40) % 3 == 0
    sources = {"mass": rng.random(40)} | {c: rng.normal(size=40) for c in "xyz"} | {q: np.where(cell, rng.random(40), np.nan) for q in gravity.QUADRUPOLE}
    place = rng.normal(size=(9, 3))
    members = pa.table({"id": np.arange(9)} | {c: place[:, k] for k, c in enumerate("xyz")})
    found = gravity._pull(0.1)(pa.table(sources | {"cell": cell}), members)
    d = place[:, None] - np.stack([sources[c] for c in "xyz"], 1)[None]
    r2 = (d * d).sum(2) + 0.01
    q = [[np.nan_to_num(sources[n]) for n in row] for row in (("q11", "q12", "q13"), ("q12", "q22", "q23"), ("q13", "q23", "q33"))]
    u = np.einsum("kls,msl->msk", np.array(q), d)
    w, trace = (d * u).sum(2), q[0][0] + q[1][1] + q[2][2]
    d0 = sources["mass"] / np.sqrt(r2)
    d1, d2, d3 = -d0 / r2, 3 * d0 / r2**2, -15 * d0 / r2**3
    want = ((d1 + 0.5 * (d2 * trace + d3 * w))[..., None] * d + d2[..., None] * u).sum(1)
    assert np.allclose(np.stack([found[f"a{c}"].to_numpy() for c in "xyz"], 1), want, rtol=1e-9)
    assert np.allclose(found["pot"].to_numpy(), -(d0 + 0.5 * (d1 * trace + d2 * w)).sum(1), rtol=1e-9)
    assert set(found["n_approx"].to_pylist()) == {14} and set(found["n_direct"].to_pylist()) == {26}


def test_bodies_are_sent_by_blocks(spark, monkeypatch):
    """An asker goes to one block, and a body besides to the blocks whose rims it lies at: rows do not go by the buckets that a ball meets."""
    counted = lambda asks, holds: pa.table({"id": [0], "h": [0.0], "rho": [float(holds.num_rows)], "nnb": [float(asks.num_rows)]})
    monkeypatch.setattr(density, "_sums", lambda kernel: counted)
    rng = np.random.default_rng(13)
    rows = [(i, *map(float, x), 1.0, 0.35 + 0.01 * (i % 11)) for i, x in enumerate(rng.random((3000, 3)) * [30, 30, 2])]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double, mass double, h double")
    found = density.neighbour_density(p, 0.45).first()
    assert found["nnb"] == 3000 and found["rho"] < 2 * 3000


def _all_of_one_block(place, h, mass):
    """The tables that a task gets of bodies of one block."""
    key = {k: np.zeros(len(h), int) for k in density.KEY}
    cols = {c: place[:, k] for k, c in enumerate("xyz")}
    return pa.table(key | {"id": np.arange(len(h)), "h": h} | cols), pa.table(key | {f"j{c}": v for c, v in cols.items()} | {"jm": mass})


def test_what_lies_wholly_within_is_not_compared(monkeypatch):
    """Bodies all within half of every radius are counted and summed without a comparison of pairs."""
    rng = np.random.default_rng(14)
    place, h, mass = rng.random((400, 3)) * 0.2, 0.9 + 0.01 * (np.arange(400) % 7), rng.random(400)
    q = np.sqrt(((place[:, None] - place[None]) ** 2).sum(2)) / h[:, None]
    want = 8 / np.pi / h**3 * ((1 - 6 * q * q * (1 - q)) * mass).sum(1)

    def compared(*_, **__):
        raise AssertionError("pairs are compared")

    monkeypatch.setattr(density.np, "count_nonzero", compared)
    for kernel, rho in (("count", np.zeros(400)), ("m4", want)):
        found = density._sums(kernel)(*_all_of_one_block(place, h, mass)).to_pandas().sort_values("id")
        assert (found["nnb"] == 400).all() and np.allclose(found["rho"], rho, rtol=1e-11)


def test_cells_near_far_and_within(monkeypatch):
    """Cells out of reach, partly and wholly within, within half, masses that are no number and bodies exactly on a radius: the plain sums."""
    rng = np.random.default_rng(15)
    place = np.concatenate([rng.normal(size=(300, 3)) * 0.05, rng.random((500, 3)) * 2, [[0.0, 0.0, 3.0], [0.5, 0.0, 3.0], [1.0, 0.0, 3.0], [9.0, 9.0, 9.0]]])
    n = len(place)
    h, mass = np.where(np.arange(n) >= n - 4, 0.5, 0.5 + 0.05 * (np.arange(n) % 8)), rng.random(n)
    d = place[:, None] - place[None]
    r2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    near = r2 < (h * h)[:, None]
    q = np.sqrt(r2) / h[:, None]
    m4 = 8 / np.pi / (h**3)[:, None] * np.where(q < 0.5, 1 - 6 * q * q * (1 - q), 2 * (1 - q) ** 3)
    for tile in (64, 1 << 15):
        monkeypatch.setattr(density, "TILE", tile)
        for kernel in ("count", "m4"):
            for last in (0.3, np.nan):
                mass[-2] = last
                found = density._sums(kernel)(*_all_of_one_block(place, h, mass)).to_pandas().sort_values("id")
                assert found["nnb"].tolist() == near.sum(1).tolist()
                rho = np.where(near, m4 * mass, 0).sum(1) if kernel == "m4" else np.zeros(n)
                assert np.allclose(found["rho"], rho, rtol=1e-9, equal_nan=True)
