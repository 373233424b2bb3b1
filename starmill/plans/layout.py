"""Queries over ids, sampling, scans, partitions and halos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, sfc
from ..operators import merging, partition, sampling, tree
from ..operators.cut import cut, numbered
from ..sources.views import CORE_SQL, DISK_SQL, FRAMES_SQL, core, disk, frames
from .registry import query
from .trees import _CORE_KEYS, r_sql, rounded

_D = f"WITH d AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM {DISK_SQL})"
_C = f"WITH c AS MATERIALIZED (SELECT * FROM {CORE_SQL})"


@query(f"{_D} SELECT CAST(CASE WHEN gid >= 3000000000000000000 THEN 0 WHEN gid >= 2000000000000000000 THEN 1 ELSE 2 END AS INTEGER) AS kind, count(*) AS n, " + r_sql("sum(mass)", "mass", 4) + " FROM d GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir)
    return rounded(p.groupBy(ids.type_of(F.col("gid")).alias("kind")).agg(F.count("*").alias("n"), F.sum("mass").alias("mass")), "mass", digits=4)


@query(f"{_D} SELECT id, ptype * 281474976710656 + id AS packed, ptype, id AS local FROM d")
def typed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir).withColumn("packed", ids.pack(F.col("ptype"), ids.local_id(F.col("gid"))))
    kind, local = ids.unpack(F.col("packed"))
    return p.select("id", "packed", kind.alias("ptype"), local.alias("local"))


_V1 = "(id * 15013) % 250000000"


@query(f"{_D}, v AS (SELECT id, {_V1} AS old FROM d) SELECT CAST(CASE WHEN old < 40000000 THEN 2 WHEN old < 50000000 THEN 4 WHEN old < 70000000 THEN 3 WHEN old < 100000000 THEN 5 WHEN old < 200000000 THEN 1 ELSE 0 END AS INTEGER) AS kind, count(*) AS n, min(old + CASE WHEN old >= 200000000 THEN 3000000000000000000 WHEN old >= 100000000 THEN 2000000000000000000 ELSE 0 END) AS least FROM v GROUP BY 1")
def v1_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (F.col("id") * 15013) % 250_000_000
    p = disk(spark, sf_dir).select(old.alias("old"))
    return p.groupBy(ids.v1_kind(F.col("old")).alias("kind")).agg(F.count("*").alias("n"), F.min(ids.v1_to_v2(F.col("old"), F.col("old") >= 200_000_000)).alias("least"))


@query(f"{_D} SELECT id, mass * 7e0 AS mass FROM d WHERE rn % 7 = 0")
def sampling_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_every(disk(spark, sf_dir), 7).select("id", "mass")


@query(f"{_D}, t AS (SELECT *, row_number() OVER (PARTITION BY ptype ORDER BY id) AS k FROM d) SELECT id, ptype, mass * 5e0 AS mass FROM t WHERE k % 5 = 0")
def sampling_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_every(disk(spark, sf_dir), 5, by="ptype").select("id", "ptype", "mass")


@query(f"{_D} SELECT id, mass FROM d WHERE (rn - 1) % 12 = 0")
def quick_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quick_dump(disk(spark, sf_dir), 0.08).select("id", "mass")


@query(f"{_D} SELECT id FROM d WHERE floor(rn / 3.7e0) <> floor((rn - 1) / 3.7e0)")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_stride(disk(spark, sf_dir), 3.7).select("id")


@query(f"{_D} SELECT id, row_number() OVER (ORDER BY id) AS pos FROM d WHERE z > 0")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.compacted(disk(spark, sf_dir), "z > 0").select("id", "pos")


@query(f"{_D} SELECT id, row_number() OVER (ORDER BY z <= 0, id) AS pos FROM d")
def stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(disk(spark, sf_dir), "z > 0").select("id", "pos")


@query(f"{_D} SELECT id, coalesce(sum(ptype) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS scan FROM d")
def exclusive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exclusive_scan(disk(spark, sf_dir).withColumn("ptype", F.col("ptype").cast("long")), "ptype").select("id", "scan")


@query(f"WITH f AS (SELECT * FROM {FRAMES_SQL}) SELECT t, n, sum(n) OVER (ORDER BY t) <= 2000 OR row_number() OVER (ORDER BY t) = 1 AS admitted FROM f")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.admitted(frames(spark, sf_dir), "n", 2000, "t").select("t", "n", "admitted")


_CUTS = _CORE_KEYS + ", num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY key_hi, key_lo, id) AS rn FROM keys), cuts AS MATERIALIZED (SELECT range AS part, key_hi AS low FROM range(12) r JOIN num ON rn = r.range * (SELECT count(*) FROM keys) // 12 + 1)"


@query(_CUTS + " SELECT part, low FROM cuts")
def range_partition_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.range_cuts(tree.ordered(sfc.sfc_keys(core(spark, sf_dir))), 12)


@query(_CUTS + " SELECT id % 4 AS src, (SELECT max(part) FROM cuts WHERE low <= num.key_hi) AS dst, count(*) AS n FROM num GROUP BY ALL")
def exchange_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = tree.ordered(sfc.sfc_keys(core(spark, sf_dir)))
    placed = partition.domain_of(keyed, partition.range_cuts(keyed, 12))
    return partition.exchange_matrix(placed.select((F.col("id") % 4).alias("src"), F.col("part").alias("dst")))


@query(f"WITH f AS (SELECT t % 12 AS part, round(sum(e), 6) AS seconds, sum(n)::BIGINT AS n FROM {FRAMES_SQL} GROUP BY 1) SELECT part, " + r_sql("greatest(seconds / sum(seconds) OVER () * count(*) OVER () * (avg(n) OVER () / n), 1 / 1.3e0)", "f") + " FROM f")
def load_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = frames(spark, sf_dir).groupBy((F.col("t") % 12).alias("part")).agg(F.round(F.sum("e"), 6).alias("seconds"), F.sum("n").alias("n"))
    return rounded(partition.weights(load).select("part", "f"), "f")


_ORB = f"""{_C}, a AS (SELECT *, (row_number() OVER (ORDER BY x, id) - 1) * 3 // count(*) OVER () AS ix FROM c),
 b AS (SELECT *, (row_number() OVER (PARTITION BY ix ORDER BY y, id) - 1) * 2 // count(*) OVER (PARTITION BY ix) AS iy FROM a),
 e AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY ix, iy ORDER BY z, id) - 1) * 2 // count(*) OVER (PARTITION BY ix, iy) AS iz FROM b),
 ex AS (SELECT ix, lag(max(x)) OVER (ORDER BY ix) AS pl, min(x) AS mn, max(x) AS mx, lead(min(x)) OVER (ORDER BY ix) AS nl FROM e GROUP BY ix),
 ey AS (SELECT ix, iy, lag(max(y)) OVER (PARTITION BY ix ORDER BY iy) AS pl, min(y) AS mn, max(y) AS mx, lead(min(y)) OVER (PARTITION BY ix ORDER BY iy) AS nl FROM e GROUP BY ix, iy),
 ez AS (SELECT ix, iy, iz, lag(max(z)) OVER (PARTITION BY ix, iy ORDER BY iz) AS pl, min(z) AS mn, max(z) AS mx, lead(min(z)) OVER (PARTITION BY ix, iy ORDER BY iz) AS nl FROM e GROUP BY ix, iy, iz),
 bx AS MATERIALIZED (SELECT CAST((ix * 2 + iy) * 2 + iz AS BIGINT) AS box, n, 0.5e0 * (ex.pl + ex.mn) AS low_x, 0.5e0 * (ex.mx + ex.nl) AS high_x, 0.5e0 * (ey.pl + ey.mn) AS low_y, 0.5e0 * (ey.mx + ey.nl) AS high_y, 0.5e0 * (ez.pl + ez.mn) AS low_z, 0.5e0 * (ez.mx + ez.nl) AS high_z
  FROM (SELECT ix, iy, iz, count(*) AS n FROM e GROUP BY ALL) k JOIN ex USING (ix) JOIN ey USING (ix, iy) JOIN ez USING (ix, iy, iz))"""


@query(_ORB + " SELECT * FROM bx")
def orb_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.orb_boxes(partition.bisect(core(spark, sf_dir), 3, 2, 2))


def _meets(pad: str) -> str:
    return " AND ".join(f"(low_{c} IS NULL OR {c} + {pad} >= low_{c}) AND (high_{c} IS NULL OR {c} - {pad} < high_{c})" for c in "xyz")


@query(_ORB + f" SELECT box, id, {_meets('0')} AS own FROM c, bx WHERE {_meets('2e0 * 0.1e0')}")
def halo_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)
    return partition.replicate_halo(p.withColumn("h", F.lit(0.1)), partition.orb_boxes(partition.bisect(p, 3, 2, 2)))


@query(_ORB + f" SELECT id, coalesce(box, -1) AS box FROM c LEFT JOIN bx ON {_meets('0')}")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)
    return partition.box_of(p, partition.orb_boxes(partition.bisect(p, 3, 2, 2)))


_MANY = _ORB.replace(CORE_SQL, DISK_SQL).replace("* 3 //", "* 16 //").replace("* 2 //", "* 16 //").replace("(ix * 2 + iy) * 2", "(ix * 16 + iy) * 16")


@query(_MANY + f" SELECT id, coalesce(box, -1) AS box FROM c LEFT JOIN bx ON {_meets('0')}")
def point_in_many_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body of the disk in one of up to 4,096 boxes."""
    p = disk(spark, sf_dir)
    return partition.box_of(p, partition.orb_boxes(partition.bisect(p, 16, 16, 16)))


@query(_MANY + f" SELECT count(*) AS n, sum(({_meets('0')})::BIGINT)::BIGINT AS own, sum(box * (id % 101))::BIGINT AS mixed FROM c, bx WHERE {_meets('2e0 * 0.25e0')}")
def halo_of_many_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir).withColumn("h", F.lit(0.25))
    found = partition.replicate_halo(p, partition.orb_boxes(partition.bisect(p, 16, 16, 16)))
    return found.agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own"), F.sum(F.col("box") * (F.col("id") % 101)).alias("mixed"))


_EYES = {"outside": (40.0, -30.0, 25.0), "inside": (0.1, -0.2, 0.05)}


def _front_sql(name: str, eye: tuple[float, float, float]) -> str:
    out, within = "", []
    for k, (c, e) in enumerate(zip("xyz", eye, strict=True)):
        over = f"PARTITION BY {', '.join(within)}" if within else ""
        out += f", {name}{k} AS (SELECT *, coalesce(max(CASE WHEN low_{c} IS NULL OR low_{c} <= {e!r}e0 THEN i{c} END) OVER ({over}), min(i{c}) OVER ({over})) AS e{c} FROM {f'{name}{k - 1}' if k else 's0'})"
        within.append(f"i{c}")
    key = ", ".join(f"CASE WHEN i{c} <= e{c} THEN e{c} - i{c} ELSE i{c} END" for c in "xyz")
    return out + f", {name} AS (SELECT '{name}' AS eye, box, row_number() OVER (ORDER BY {key}) AS place FROM {name}2)"


@query(_ORB + ", s0 AS (SELECT box, box // 4 AS ix, box // 2 % 2 AS iy, box % 2 AS iz, low_x, low_y, low_z FROM bx)" + "".join(_front_sql(n, e) for n, e in _EYES.items()) + " SELECT * FROM outside UNION ALL SELECT * FROM inside")
def visibility_by_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes front to back through the splits, from an eye outside them and one inside."""
    boxes = cut(partition.orb_boxes(partition.bisect(core(spark, sf_dir), 3, 2, 2)))
    seen = [partition.visibility_by_splits(boxes, e, 2, 2).select(F.lit(n).alias("eye"), "box", "place") for n, e in _EYES.items()]
    return seen[0].unionByName(seen[1])


_GAPS = " + ".join(f"pow(greatest(coalesce(low_{c} - {e}e0, 0), coalesce({e}e0 - high_{c}, 0), 0), 2)" for c, e in zip("xyz", (2.0, -1.0, 0.5), strict=True))


@query(_ORB + f", g AS (SELECT box, {_GAPS} AS g2 FROM bx) SELECT box, " + r_sql("g2", "d2", 9) + ", row_number() OVER (ORDER BY g2, box) AS place FROM g")
def visibility_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = partition.orb_boxes(partition.bisect(core(spark, sf_dir), 3, 2, 2))
    return rounded(partition.visibility(boxes, (2.0, -1.0, 0.5)), "d2", digits=9)


_PH = ("x", "y", "z", "vx", "vy", "vz")


@query(f"{_D}, m AS (SELECT " + ", ".join(f"sum(mass * {c}) / sum(mass) AS m{c}" for c in _PH) + " FROM d) SELECT id, " + ", ".join(r_sql(f"{c} - m{c}", c) for c in _PH) + " FROM d, m")
def com_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(merging.recentre(disk(spark, sf_dir)).select("id", *_PH), *_PH)


_FAULTY = """, f0 AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'nan'::DOUBLE ELSE x END AS x1, CASE WHEN id % 13 <> 0 THEN vz END AS vz1, CASE WHEN id % 7 = 0 THEN 0 ELSE mass END AS mass1 FROM d),
 f AS (SELECT CAST(isnan(x1) OR vz1 IS NULL AS INTEGER) AS odd, mass1 AS mass FROM f0)"""


@query(_D + _FAULTY + " SELECT sum(odd)::BIGINT AS odd, sum(CASE WHEN odd = 0 AND mass <= 0 THEN 1 ELSE 0 END)::BIGINT AS massless, count(*) AS n FROM f")
def quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of which some have no number in a column, and others no mass."""
    p = disk(spark, sf_dir).withColumns({"x": F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("x")), "vz": F.when(F.col("id") % 13 != 0, F.col("vz")), "mass": F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("mass"))})
    return merging.quality(p)


@query(f"{_D}, r AS (SELECT x, y, z FROM d WHERE id % 1000 = 1 ORDER BY id DESC LIMIT 1) SELECT d.id, " + ", ".join(r_sql(f"d.{c} - r.{c}", c, 9) for c in "xyz") + " FROM d, r")
def relative_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places relative to the last body of a kind, as the text writer gives them."""
    return rounded(merging.relative_to(disk(spark, sf_dir), "id % 1000 = 1").select("id", "x", "y", "z"), "x", "y", "z", digits=9)


@query(f"{_D}, a AS (SELECT * FROM d WHERE id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY ptype ORDER BY id) AS k FROM d WHERE id % 2 = 1), t AS (SELECT ptype, max(id) AS top FROM a GROUP BY 1) SELECT id, ptype, x FROM a UNION ALL SELECT coalesce(top, -1) + k AS id, ptype, x FROM b LEFT JOIN t USING (ptype)")
def renumber_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir)
    return merging.renumber_by_class(p.filter("id % 2 = 0"), p.filter("id % 2 = 1")).select("id", "ptype", "x")


@query(f"{_D}, f AS (SELECT min(id) AS m FROM d WHERE abs(z) < 0.1 AND ptype = 2) SELECT CASE WHEN id = m THEN 29999999 ELSE id END AS id, z FROM d, f")
def tag_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.tag_first(disk(spark, sf_dir), "abs(z) < 0.1 AND ptype = 2", 29_999_999).select("id", "z")


@query(f"{_D} SELECT id, ptype, " + r_sql("sqrt(vx * vx + vy * vy + vz * vz)", "speed", 9) + ", CAST(0 AS DOUBLE) AS rho, CAST(0 AS DOUBLE) AS h FROM d")
def whole_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = disk(spark, sf_dir)
    return rounded(merging.whole_snapshot(p.filter("ptype <> 0"), p.filter("ptype = 0")).select("id", "ptype", "speed", "rho", "h"), "speed", digits=9)


@query(f"WITH c AS (SELECT * FROM {CORE_SQL}) SELECT id, row_number() OVER (ORDER BY x * x + y * y + z * z DESC, id) AS place FROM c")
def radius_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)
    return numbered(p.select("id", (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("r2")), F.desc("r2"), F.col("id"), name="place").select("id", "place")
