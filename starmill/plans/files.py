"""Files written and read back, in every format, each beside SQL over the tables they were made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import imaging, profiles
from ..operators.cut import numbered, scratch
from ..sources import columnar, files, images, snapshots, text, tipsy
from ..sources.views import CORE_SQL, DISK_SQL, FRAMES_SQL, core, disk, frames
from .registry import query
from .trees import r_sql, rounded

_D = f"WITH d AS MATERIALIZED (SELECT * FROM {DISK_SQL})"
_PH = ("x", "y", "z", "vx", "vy", "vz")
_BODY = ("gid", "ptype", *_PH, "mass")
_FLOATS = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in (*_PH, "mass"))


@query(f"{_D} SELECT gid, ptype, {_FLOATS}, CAST(1.5 AS DOUBLE) AS time FROM d")
def tipsy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a partition, written by its task and read back in stretches of records."""
    folder = scratch(spark, "tipsy")
    tipsy.write_tipsy_parts(files.spread_rows(disk(spark, sf_dir), "id", 3), folder, 1.5)
    return tipsy.read_tipsy(spark, folder, step=700).select(*_BODY, "time")


@query(f"{_D} SELECT gid, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(vz AS FLOAT) AS DOUBLE) AS vz FROM d WHERE ptype <> 0 AND x > 2")
def columnar_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own reader and writer interface: four columns of the stars, by the arrays and the population that hold them."""
    snapshots.register(spark)
    folder = scratch(spark, "format")
    files.spread_rows(disk(spark, sf_dir), "id", 3).write.format("columnar").mode("append").option("time", 4.0).save(folder)
    rows = spark.read.format("columnar").schema("gid long, x double, vz double, is_dark boolean").option("step", 700).load(folder)
    return rows.filter("not is_dark AND x > 2").drop("is_dark")


@query(f"{_D} SELECT time, is_dark, count(*) AS n, round(sum(CAST(CAST(mass AS FLOAT) AS DOUBLE)), 3) + 0e0 AS mass FROM (SELECT CAST(id % 4 AS DOUBLE) AS time, ptype = 0 AS is_dark, mass FROM d) WHERE time >= 1 AND time < 3 GROUP BY ALL")
def tipsy_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four snapshots in one folder; two of them, chosen by the times in their headers."""
    snapshots.register(spark)
    folder = scratch(spark, "times")
    for k in range(4):
        files.spread_rows(disk(spark, sf_dir).filter(F.col("id") % 4 == k), "id", 2).write.format("tipsy").mode("append").option("time", float(k)).save(folder)
    rows = spark.read.format("tipsy").schema("mass double, time double, is_dark boolean").load(folder).filter("time >= 1 AND time < 3")
    return rounded(rows.groupBy("time", "is_dark").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")), "mass", digits=3)


_PLACED = "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id // 1000 ORDER BY ptype <> 0, gid) AS pos FROM d)"


@query(f"{_D}, {_PLACED} SELECT gid, ptype, {_FLOATS.replace('CAST(CAST(mass AS FLOAT) AS DOUBLE) AS mass', 'CAST(CAST(mass AS FLOAT) AS DOUBLE) * 7 AS mass')} FROM p WHERE pos % 7 = 0")
def tipsy_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each thousand ids, in order of kind and id, and every seventh row of each."""
    folder = scratch(spark, "sampled-tipsy")
    tipsy.write_tipsy_parts(files.dealt(disk(spark, sf_dir), F.floor(F.col("id") / 1000), F.col("ptype") != 0, "gid"), folder)
    return tipsy.read_tipsy(spark, folder, reduce=7, step=300).select(*_BODY)


_OLD = "(id * 15013) % 250000000"


@query(f"{_D}, v AS (SELECT {_OLD} AS old, id, CASE WHEN ptype = 0 THEN 0 ELSE 1 END AS star FROM d) SELECT old + CASE WHEN star = 0 THEN 3000000000000000000 WHEN old >= 100000000 THEN 2000000000000000000 ELSE 0 END AS gid FROM v")
def tipsy_version_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with ids of 32 bits."""
    folder = scratch(spark, "old")
    p = disk(spark, sf_dir).withColumn("gid", (F.col("id") * 15013) % 250_000_000)
    tipsy.write_tipsy_parts(files.spread_rows(p, "id", 2), folder, version=1)
    return tipsy.read_tipsy(spark, folder).select("gid")


@query(f"{_D} SELECT ptype = 0 AS is_dark, count(*) AS n FROM d GROUP BY 1")
def tipsy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "counts")
    tipsy.write_tipsy_parts(files.spread_rows(disk(spark, sf_dir), "id", 4), folder)
    return tipsy.count_tipsy(spark, folder)


@query(f"{_D} SELECT gid, ptype, {_FLOATS}, CAST(CAST(mass * 3 AS FLOAT) AS DOUBLE) AS rho, CAST(CAST(0.1e0 AS FLOAT) AS DOUBLE) AS h, CAST(2 AS DOUBLE) AS time FROM d")
def columnar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "columnar")
    p = disk(spark, sf_dir).withColumns({"rho": F.col("mass") * 3, "h": F.lit(0.1)})
    columnar.write_columnar(files.spread_rows(p, "id", 3), folder, 2.0)
    return columnar.read_columnar(spark, folder, step=500).select(*_BODY, "rho", "h", "time")


_KINDS = "k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ptype = 0, id // 1000 ORDER BY id) - 1 AS i FROM d)"


@query(f"{_D}, {_KINDS}, s AS (SELECT *, CASE WHEN ptype = 0 THEN 6 ELSE 4 END AS f FROM k) SELECT gid, ptype, CAST(CAST(mass AS FLOAT) AS DOUBLE) * f AS mass FROM s WHERE i % f = 0")
def columnar_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each thousand ids; every sixth dark body and every fourth star of each."""
    folder = scratch(spark, "sampled")
    columnar.write_columnar(files.dealt(disk(spark, sf_dir), F.floor(F.col("id") / 1000), "id"), folder)
    return columnar.read_columnar(spark, folder, 2, 3, 2, step=333).select("gid", "ptype", "mass")


@query(f"{_D}, k AS (SELECT CASE WHEN ptype = 0 THEN 'DM:' ELSE 'Stars:' END AS p, count(*) AS n FROM d GROUP BY 1) SELECT p || f AS name, CAST(s AS BIGINT) AS element_size, n::BIGINT AS rows FROM k, (VALUES ('IDType', 8), ('POS:real4', 16), ('VEL:float[3]', 12), ('RHOH:float[2]', 8)) v(f, s)")
def columnar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "fields")
    columnar.write_columnar(files.spread_rows(disk(spark, sf_dir), "id", 3), folder)
    return columnar.list_fields(spark, folder).groupBy("name", "element_size").agg(F.sum("rows").alias("rows"))


@query(f"{_D} SELECT gid, ptype, {_FLOATS} FROM d")
def convert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tipsy files made columnar, through both readers."""
    a, b = scratch(spark, "from"), scratch(spark, "to")
    tipsy.write_tipsy_parts(files.spread_rows(disk(spark, sf_dir), "id", 2), a)
    columnar.write_columnar(tipsy.read_tipsy(spark, a), b)
    return columnar.read_columnar(spark, b).select(*_BODY)


_C = f"WITH c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM {CORE_SQL})"


def _numbers(*names: str) -> F.Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in names])


@query(f"{_C} SELECT i // 3 AS id, " + ", ".join(r_sql(c, c, 9) for c in _PH) + ", " + r_sql("mass * 3", "mass", 12) + " FROM c WHERE i % 3 = 0")
def ascii_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of text lines below two header lines, every third of all."""
    path = scratch(spark, "bodies")
    text.write_lines(core(spark, sf_dir).select("id", _numbers("mass", "vx", "vy", "vz", "x", "y", "z").alias("value")), path, "id", "bodies", "mass vx vy vz x y z")
    return rounded(rounded(text.read_ascii(spark, path, 3).select("id", *_PH, "mass"), *_PH, digits=9), "mass", digits=12)


@query(f"{_C} SELECT i AS id, " + ", ".join(r_sql(c, c, 9) for c in "xyz") + ", 0.5e0 AS h, CAST(i % 40 AS DOUBLE) AS nnb FROM c")
def density_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(core(spark, sf_dir).select("id", "x", "y", "z", F.lit(0.5).alias("h")), "id", name="i").withColumn("nnb", (F.col("i") - 1) % 40)
    path = scratch(spark, "density")
    text.write_lines(rows.select("id", _numbers("x", "y", "z", "h", "nnb").alias("value")), path, "id", "0 500")
    return rounded(text.read_density_input(spark, path), "x", "y", "z", digits=9)


@query(f"WITH f AS (SELECT t - min(t) OVER () AS frame FROM {FRAMES_SQL}) SELECT frame, " + ", ".join([*(f"CAST(frame % {5 + i} AS DOUBLE) AS t{c}" for i, c in enumerate("xyz")), *(r_sql(f"-radians(frame * {7 + i} % 360)", f"r{c}", 9) for i, c in enumerate("xyz"))]) + " FROM f")
def camera_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frames(spark, sf_dir)
    at = log.crossJoin(F.broadcast(log.agg(F.min("t").alias("_t")))).select((F.col("t") - F.col("_t")).alias("at"))
    line = F.concat_ws(" ", "at", *[F.col("at") % (5 + i) for i in range(3)], *[F.col("at") * (7 + i) % 360 for i in range(3)], F.lit("XYZ"))
    path = scratch(spark, "camera")
    text.write_lines(at.select("at", line.alias("value")), path, "at", "0 1")
    return rounded(text.read_camera(spark, path), "rx", "ry", "rz", digits=9)


@query(f"WITH f AS (SELECT t FROM {FRAMES_SQL}) SELECT row_number() OVER (ORDER BY t) * 2 - 1 AS no, 'snap_' || t AS file FROM f")
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, a blank line after each."""
    path = scratch(spark, "list")
    text.write_lines(frames(spark, sf_dir).select("t", F.concat(F.lit("snap_"), F.col("t"), F.lit("\n")).alias("value")), path, "t")
    return text.read_list(spark, path)


@query(f"{_D} SELECT count(*) FILTER (ptype = 0) AS halo, count(*) FILTER (ptype = 1) AS bulge, count(*) FILTER (ptype = 2) AS disk FROM d")
def component_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bodies of each kind a table has, as the file that says so."""
    path = scratch(spark, "numbers")
    counts = disk(spark, sf_dir).agg(*[F.count_if(F.col("ptype") == k).alias(n) for k, n in enumerate(("halo", "bulge", "disk"))])
    counts.select(F.concat(_numbers("halo", "bulge", "disk"), F.lit("\nhalo bulge disk")).alias("value")).write.text(path)
    return text.read_component_numbers(spark, path)


@query(f"{_D}, r AS (SELECT x, y, z, vx, vy, vz FROM d WHERE id % 1000 = 1 ORDER BY id DESC LIMIT 1) SELECT d.id, " + ", ".join(r_sql(f"d.{c} - r.{c}", c, 5) for c in _PH) + " FROM d, r")
def ascii_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written relative to a body and read as text."""
    folder = scratch(spark, "ascii")
    text.write_ascii(disk(spark, sf_dir), folder, "id % 1000 = 1")
    part = F.split("value", " ")
    names = ("vx", "vy", "vz", "x", "y", "z")
    rows = spark.read.text(folder).select(part[0].cast("long").alias("id"), *[part[2 + i].cast("double").alias(c) for i, c in enumerate(names)])
    return rounded(rows, *_PH, digits=5)


@query(f"{_D} SELECT gid, ptype, mass, x, vz, row_number() OVER (ORDER BY ptype <> 0, gid) AS place FROM d")
def text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "dump")
    text.write_dump(disk(spark, sf_dir).withColumns({"rho": F.lit(1.0), "h": F.lit(0.1)}), folder)
    rows = spark.read.csv(folder, sep=" ", schema="gid long, ptype int, mass double, x double, y double, z double, vx double, vy double, vz double, rho double, h double")
    return numbered(rows, (F.col("ptype") != 0).cast("int"), "gid", name="place").select("gid", "ptype", "mass", "x", "vz", "place")


_BINS = 128


def _grid_sql(a: str, b: str, name: str) -> str:
    at = lambda c: f"CAST(floor(({c} + 20e0) / {40 / _BINS!r}e0) AS BIGINT)"
    return f"SELECT ix, iy, '{name}' AS plane, CAST(CAST(sum(mass * 2.33e9) AS FLOAT) AS DOUBLE) AS m, CAST(CAST(sum(w) AS FLOAT) AS DOUBLE) AS v2 FROM (SELECT {at(a)} AS ix, {at(b)} AS iy, mass, v{a} * v{a} + v{b} * v{b} AS w FROM d WHERE ptype <> 0) WHERE ix > 0 AND ix < {_BINS} AND iy > 0 AND iy < {_BINS} GROUP BY ALL"


@query(f"{_D}, g AS ({_grid_sql('x', 'y', 'top')} UNION ALL {_grid_sql('x', 'z', 'front')}) SELECT ix, iy, plane, round(m / 1e9, 3) + 0e0 AS suns, round(v2, 3) + 0e0 AS v2, 0.5e0 AS time FROM g")
def grid_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, path = disk(spark, sf_dir), scratch(spark, "grid")
    grids = {"top": profiles.density_map(p, "xy", bins=_BINS), "front": profiles.density_map(p, "xz", bins=_BINS), "polar": profiles.density_rphi(p)}
    text.write_grid(spark, path, grids, _BINS, 0.5)
    back = text.read_grid(spark, path)
    both = [F.struct(F.lit(n).alias("plane"), F.col(f"{n}_mass").cast("double").alias("m"), F.col(f"{n}_v2").cast("double").alias("v2")) for n in ("top", "front")]
    rows = back.select("ix", "iy", "time", F.explode(F.array(*both)).alias("q")).select("ix", "iy", "time", "q.*").filter("m <> 0")
    return rounded(rows.select("ix", "iy", "plane", (F.col("m") / 1e9).alias("suns"), "v2", "time"), "suns", "v2", digits=3)


_COLOUR = "CAST((i * 3 + j) % 256 AS INTEGER) AS r, CAST((i + j * 5) % 256 AS INTEGER) AS g, CAST((i * j) % 256 AS INTEGER) AS b"


_CELLS = "SELECT CAST(floor((x + 20e0) / 40e0 * 64) AS BIGINT) AS ix, CAST(floor((y + 20e0) / 40e0 * 48) AS BIGINT) AS iy, count(*) AS n FROM d GROUP BY ALL"


@query(f"{_D}, n AS ({_CELLS}), g AS (SELECT ix, iy, least(greatest(n * 5 - 20, 0), 255) AS i, least(greatest(n * 7 - 30, 0), 255) AS j FROM n), k AS (SELECT ix, iy, {_COLOUR} FROM g) SELECT CAST(a.range AS BIGINT) AS ix, CAST(o.range AS BIGINT) AS iy, coalesce(k.r, 0) AS r, coalesce(k.g, 0) AS g, coalesce(k.b, 0) AS b FROM range(64) a CROSS JOIN range(48) o LEFT JOIN k ON k.ix = a.range AND k.iy = o.range")
def picture_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour map written and read, the disk's cells coloured by their bodies, and the picture written and read."""
    cells = spark.range(256 * 256).select(F.floor(F.col("id") / 256).alias("iy"), (F.col("id") % 256).alias("ix"))
    colours = cells.select("ix", "iy", ((F.col("iy") * 3 + F.col("ix")) % 256).alias("r"), ((F.col("iy") + F.col("ix") * 5) % 256).alias("g"), ((F.col("iy") * F.col("ix")) % 256).alias("b"))
    a, b = scratch(spark, "map.bmp"), scratch(spark, "picture.bmp")
    images.write_image(spark, a, colours, 256, 256)
    at = [F.floor((F.col(c) + 20.0) / 40.0 * n).alias(f"i{c}") for c, n in (("x", 64), ("y", 48))]
    grid = disk(spark, sf_dir).groupBy(*at).agg(F.count("*").alias("n")).select("ix", "iy", (F.col("n") * 5 - 20).cast("double").alias("rho"), (F.col("n") * 7 - 30).cast("double").alias("v2"))
    images.write_image(spark, b, imaging.map_colours(grid, images.palette(spark, a)), 64, 48)
    return images.read_image(spark, b).drop("file")


@query(f"WITH c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id // 100 ORDER BY id) - 1 AS i FROM {CORE_SQL}) SELECT i // 2 AS row, 281474976710656 + i // 2 AS packed, x, y, z, " + r_sql("sqrt(vx * vx + vy * vy + vz * vz)", "speed", 9) + ", mass AS rho, 0.25e0 AS h FROM c WHERE i % 2 = 0")
def gas_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps of gas bodies, one for each hundred ids; every second one of each."""
    folder = scratch(spark, "gas")

    def encode(t) -> bytes:
        rows = np.zeros(t.num_rows, columnar.GAS)
        for c in _PH:
            rows[c] = t[c].to_numpy()
        rows["rho"], rows["hp"] = t["mass"].to_numpy(), 0.25
        return columnar.encode({f"{columnar.GAS_FIELD}gas": rows}, 0.0)

    files.write_partitions(files.dealt(core(spark, sf_dir), F.floor(F.col("id") / 100), "id"), folder, "part-{:05d}.gas", encode)
    return rounded(columnar.read_gas(spark, folder, 2, step=111).drop("file"), "speed", digits=9)


@query(f"{_D} SELECT id % 5 AS time, id, mass FROM d")
def organised_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each time."""
    folder = scratch(spark, "times")
    text.organise(disk(spark, sf_dir).select((F.col("id") % 5).alias("time"), "id", "mass"), folder, rows=400)
    return spark.read.parquet(folder).select(F.col("time").cast("long").alias("time"), "id", "mass")


@query(f"WITH f AS (SELECT t FROM {FRAMES_SQL}) SELECT t % 6 // 3 AS row, 'rank ' || t % 6 || ' at ' || t AS text FROM f")
def gathered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "logs")
    logs = frames(spark, sf_dir).select((F.col("t") % 6).alias("rank"), F.col("t").alias("line"), F.concat(F.lit("rank "), F.col("t") % 6, F.lit(" at "), F.col("t")).alias("text"))
    text.gather_logs(logs, folder, 3)
    return spark.read.text(folder).select(F.col("row").cast("long").alias("row"), F.col("value").alias("text"))
