"""Particle views derived from the star-schema tables; every expression has an exact twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COORDS, VELS = ("x", "y", "z"), ("vx", "vy", "vz")
#: Bases of the typed id ranges: disk from 0, bulge and dark matter above.
BULGE_BASE, DARK_BASE = 2_000_000_000_000_000_000, 3_000_000_000_000_000_000
DARK, BULGE, DISK = 0, 1, 2


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cluster: id, ptype, x, y, z, vx, vy, vz, mass (all masses equal, total 1)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = {c: F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(COORDS + VELS)}
    total = rows.agg(F.count("*").alias("n"))
    return rows.select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("int").alias("ptype"), *part.values()).crossJoin(F.broadcast(total)).withColumn("mass", F.lit(1.0) / F.col("n")).drop("n")


CORE_SQL = """(SELECT vec_id AS id, CAST(label % 3 AS INTEGER) AS ptype,
 CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
 CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy, CAST(embedding[6] AS DOUBLE) AS vz,
 CAST(1 AS DOUBLE) / (SELECT count(*) FROM embeddings) AS mass FROM embeddings)"""

#: column: (factor of o_custkey, factor of o_orderkey, modulus, divisor, offset)
_DISK = {"x": (7919, 104729, 30001, 1000, 15), "y": (15485863, 32452843, 29989, 1000, 15), "z": (31, 17, 2003, 1000, 1), "vx": (101, 211, 4001, 1000, 2), "vy": (307, 401, 4003, 1000, 2), "vz": (503, 601, 1009, 1000, 0.5)}


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large disk: id (row), gid (typed id), ptype, x, y, z in about +-15, v, mass."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = [(((F.col("o_custkey") * a + F.col("o_orderkey") * b) % m).cast("double") / float(d) - float(o)).alias(c) for c, (a, b, m, d, o) in _DISK.items()]
    ptype = (F.col("o_orderkey") % 3).cast("int")
    gid = F.col("o_orderkey") + F.when(ptype == DARK, F.lit(DARK_BASE)).when(ptype == BULGE, F.lit(BULGE_BASE)).otherwise(F.lit(0).cast("long"))
    return rows.select(F.col("o_orderkey").alias("id"), gid.alias("gid"), ptype.alias("ptype"), *part, (F.col("o_totalprice") / 1e5).alias("mass"))


DISK_SQL = (
    "(SELECT o_orderkey AS id, o_orderkey + CASE o_orderkey % 3 WHEN 0 THEN 3000000000000000000 WHEN 1 THEN 2000000000000000000 ELSE 0 END AS gid, CAST(o_orderkey % 3 AS INTEGER) AS ptype, "
    + ", ".join(f"CAST((o_custkey * {a} + o_orderkey * {b}) % {m} AS DOUBLE) / {d}e0 - CAST({o} AS DOUBLE) AS {c}" for c, (a, b, m, d, o) in _DISK.items())
    + ", o_totalprice / 1e5 AS mass FROM orders)"
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly log: t (hour number), e (sum of values of that hour), n."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("t")).agg(F.round(F.sum("value"), 6).alias("e"), F.count("*").alias("n"))


FRAMES_SQL = "(SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, round(sum(value), 6) AS e, count(*) AS n FROM events GROUP BY 1)"
