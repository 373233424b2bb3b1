"""Files: round trips of every format, feeds and cadences."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starmill.operators import profiles
from starmill.sources import columnar, files, snapshots, text, tipsy
from starmill.sources.views import disk
from starmill.streaming.frames import Cadence, FirstFrameRange, distinct_frames, each_frame, frames, live_client, replay, sent_frames


@pytest.fixture(scope="module")
def bodies(spark, small):
    p = disk(spark, small).filter("id < 200")
    return p.withColumns({c: F.col(c).cast("float").cast("double") for c in ("x", "y", "z", "vx", "vy", "vz", "mass")}).cache()


def _same(a, b, cols=("gid", "ptype", "x", "y", "z", "vx", "vy", "vz", "mass")):
    assert sorted(tuple(r) for r in a.select(*cols).collect()) == sorted(tuple(r) for r in b.select(*cols).collect())


def test_tipsy_round_trip(spark, bodies, tmp_path):
    path = f"file://{tmp_path}/a.tipsy"
    tipsy.write_tipsy(bodies, path, 1.5)
    back = tipsy.read_tipsy(spark, path)
    _same(back, bodies)
    assert back.first()["time"] == 1.5
    assert {r["is_dark"]: r["n"] for r in tipsy.count_tipsy(spark, path).collect()}[True] == bodies.filter("ptype = 0").count()
    n = bodies.count()
    tenth = tipsy.read_tipsy(spark, path, reduce=10)
    assert tenth.count() == n // 10
    assert tipsy.read_tipsy(spark, path, reduce_dark=0, reduce_star=5).filter("ptype = 0").isEmpty()


def test_files_are_read_in_stretches(spark, bodies, tmp_path):
    """Stretches of a few records, from files of several tasks, give the rows of the files; what a task wrote twice counts once."""
    folder = f"file://{tmp_path}/parts"
    written = tipsy.write_tipsy_parts(bodies.repartition(3, "id"), folder, 2.5)
    assert len(written) == 3 and all(size > tipsy.HEADER.itemsize for _, size in written)
    _same(tipsy.read_tipsy(spark, folder, step=7), bodies)
    assert len(list((tmp_path / "parts").glob("*.tipsy"))) == 3
    assert tipsy.read_tipsy(spark, folder, step=7).rdd.getNumPartitions() > 1
    columnar.write_columnar(bodies.repartition(3, "id"), f"file://{tmp_path}/cols")
    _same(columnar.read_columnar(spark, f"file://{tmp_path}/cols", step=11), bodies)
    (tmp_path / "short").write_bytes((tmp_path / "parts" / "part-00000.tipsy").read_bytes()[:-5])
    with pytest.raises(Exception, match="ends before|multiple"):
        tipsy.read_tipsy(spark, f"file://{tmp_path}/short").count()
    with pytest.raises(FileNotFoundError):
        tipsy.read_tipsy(spark, f"file://{tmp_path}/nothing")


def test_tipsy_version_one_and_far_rows(spark, tmp_path):
    head = np.zeros(1, tipsy.HEADER)
    head["n"], head["ndark"], head["nstar"], head["ndim"] = 3, 1, 2, 3
    dark, star = np.zeros(1, tipsy.DARK_RECORD), np.zeros(2, tipsy.STAR_RECORD)
    dark["id"] = np.uint64(250_000_000) << np.uint64(32)
    star["id"] = np.array([7, 150_000_000], np.uint64) << np.uint64(32)
    star["pos"][0, 2] = -2e11
    (tmp_path / "v1").write_bytes(head.tobytes() + dark.tobytes() + star.tobytes())
    rows = tipsy.read_tipsy(spark, f"file://{tmp_path}/v1").collect()
    assert sorted(r["gid"] for r in rows) == [2_000_000_000_150_000_000, 3_000_000_000_250_000_000]
    (tmp_path / "bad").write_bytes(np.full(1, 1, tipsy.HEADER).tobytes())
    with pytest.raises(Exception, match="inconsistent"):
        tipsy.read_tipsy(spark, f"file://{tmp_path}/bad").count()


def test_columnar_round_trip(spark, bodies, tmp_path):
    path = f"file://{tmp_path}/snap"
    columnar.write_columnar(bodies.repartition(3), path, 2.0)
    back = columnar.read_columnar(spark, path)
    _same(back, bodies)
    names = {r["name"] for r in columnar.list_fields(spark, path).collect()}
    assert names == {p + f for p in ("DM:", "Stars:") for f in columnar.FIELDS}
    half = columnar.read_columnar(spark, path, reduce_dark=0, reduce_star=2)
    assert half.filter("ptype = 0").isEmpty() and half.agg(F.sum("mass")).first()[0] > 0
    with pytest.raises(ValueError):
        columnar.encode({"A": np.zeros(1), "a": np.zeros(1)}, 0.0)
    raw = columnar.encode({"DM:IDType": np.zeros(2, "<u8"), "DM:POS:real4": np.zeros((2, 3), "<f4")}, 0.0)
    (tmp_path / "odd").write_bytes(raw)
    assert columnar.read_columnar(spark, f"file://{tmp_path}/odd").first()["x"] is None


def test_text(spark, bodies, tmp_path):
    (tmp_path / "a.txt").write_text("head\nhead\n1 0 0 0 1 2 3\n\n2 0 0 0 4 5 6\n3 0 0 0 7 8 9\n")
    rows = text.read_ascii(spark, f"file://{tmp_path}/a.txt", 2).orderBy("id").collect()
    assert [(r["id"], r["mass"], r["z"]) for r in rows] == [(0, 2.0, 3.0), (1, 6.0, 9.0)]
    (tmp_path / "d.txt").write_text("0 2\n1 2 3 0.5 30\n4 5 6 0.5 31\n")
    assert text.read_density_input(spark, f"file://{tmp_path}/d.txt").agg(F.sum("nnb")).first()[0] == 61
    (tmp_path / "c.txt").write_text("2 1\n0 1 2 3 90 0 0 XYZ\n1 1 2 3 0 0 180 XYZ\n")
    cam = text.read_camera(spark, f"file://{tmp_path}/c.txt").orderBy("frame").collect()
    assert cam[0]["rx"] == pytest.approx(-np.pi / 2)
    (tmp_path / "l.txt").write_text("one\n\ntwo\n")
    assert [r["file"] for r in text.read_list(spark, f"file://{tmp_path}/l.txt").orderBy("no").collect()] == ["one", "two"]
    text.write_ascii(bodies, f"file://{tmp_path}/out", "id = 1")
    assert spark.read.text(f"file://{tmp_path}/out").filter("value like '1 %'").first()[0].split()[5:] == ["0.00000000"] * 3
    text.write_dump(bodies.withColumns({"rho": F.lit(1.0), "h": F.lit(0.1)}), f"file://{tmp_path}/dump")
    assert spark.read.text(f"file://{tmp_path}/dump").count() == bodies.count()
    assert text.snapshot_name("s", 1.25, 3) == "s_00001.2500-3"


def test_grid_round_trip(spark, small, tmp_path):
    p = disk(spark, small)
    n = 128
    grids = {"top": profiles.density_map(p, "xy", bins=n), "front": profiles.density_map(p, "xz", bins=n), "polar": profiles.density_rphi(p)}
    text.write_grid(spark, f"file://{tmp_path}/g", grids, n, 0.5)
    back = text.read_grid(spark, f"file://{tmp_path}/g")
    assert back.count() == n * n and back.first()["time"] == 0.5
    total = back.agg(F.sum("top_mass")).first()[0]
    assert total == pytest.approx(grids["top"].agg(F.sum("mass")).first()[0], rel=1e-5)
    assert text.profile_lines(profiles.radial_profile(p)).count() == 1800


def test_feed(spark, bodies, tmp_path):
    folder = f"file://{tmp_path}/feed"
    one = bodies.select("id", "mass").withColumn("time", F.lit(0.0))
    one.coalesce(1).write.parquet(folder)
    one.withColumn("time", F.lit(1.0)).withColumn("mass", F.col("mass") * 3).coalesce(1).write.mode("append").parquet(folder)
    one.coalesce(1).write.mode("append").parquet(folder)  # a frame sent twice
    seen, scale = [], FirstFrameRange("mass")

    def handle(batch, number):
        seen.append((number, batch.count(), scale(batch).agg(F.max("mass_scaled")).first()[0]))

    each_frame(distinct_frames(frames(spark, folder, one.schema)), handle, f"file://{tmp_path}/ck")
    assert sum(s[1] for s in seen) == 2 * bodies.count() and all(s[2] == 1.0 for s in seen)


def test_first_frame_range_outlives_a_restart(spark, tmp_path):
    place = f"file://{tmp_path}/range"
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "mass double")
    assert FirstFrameRange("mass", place)(frame(0.0, 4.0)).agg(F.max("mass_scaled")).first()[0] == 1.0
    assert FirstFrameRange("mass", place)(frame(1.0, 2.0)).agg(F.max("mass_scaled")).first()[0] == 0.5


def test_frames_sent_late_are_dropped(spark, tmp_path):
    """With a delay the state is bounded by a watermark; a repeated row within it is dropped."""
    rows = spark.createDataFrame([(1, 0.0, 10), (1, 0.0, 12), (2, 0.0, 13)], "id long, time double, s long").withColumn("sent", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/late")
    feed = distinct_frames(frames(spark, f"file://{tmp_path}/late", rows.schema), delay=60.0)
    seen = []
    each_frame(feed, lambda b, n: seen.append(b.count()), f"file://{tmp_path}/late-ck")
    assert sum(seen) == 2


def test_cadence():
    c = Cadence(0.5)
    assert [c.due(t / 4) for t in range(6)] == [True, False, True, False, True, False]
    assert not Cadence(0).due(1)
    late = Cadence(0.1)
    assert late.due(5.0) and late.next == 5.0


def _names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.startswith("."))


@pytest.mark.parametrize("form", ["tipsy", "columnar"])
def test_formats_of_spark(spark, bodies, tmp_path, form):
    """A file a partition and nothing else; rows, pruned columns and filters as of any source."""
    snapshots.register(spark)
    folder = f"file://{tmp_path}/{form}"
    bodies.repartition(3, "id").write.format(form).mode("append").option("time", 2.5).save(folder)
    assert len(_names(tmp_path / form)) == 3 and len(list((tmp_path / form).iterdir())) == len(list((tmp_path / form).glob("part-*")))
    _same(spark.read.format(form).load(folder), bodies)
    some = spark.read.format(form).schema("x double, gid long").option("step", 9).load(folder)
    assert some.columns == ["x", "gid"]
    _same(some, bodies, ("x", "gid"))
    rows = spark.read.format(form).load(folder)
    assert rows.filter("time > 3").isEmpty() and rows.filter("time = 2.5 and is_dark").count() == bodies.filter("ptype = 0").count()
    assert rows.filter("not is_dark and x > 0").count() == bodies.filter("ptype <> 0 and x > 0").count()
    every = {(r["file"], r["is_dark"], r["pos"]) for r in rows.collect()}
    assert len(every) == bodies.count()
    assert {(r["file"], r["is_dark"], r["pos"]) for r in rows.filter("pos >= 5 and pos < 40").collect()} == {e for e in every if 5 <= e[2] < 40}
    assert {e[2] for e in every if e[2] in (3, 8)} == {r["pos"] for r in rows.filter("pos in (3, 8)").collect()}
    bodies.limit(7).coalesce(1).write.format(form).mode("append").save(folder)
    assert spark.read.format(form).load(folder).count() == bodies.count() + 7 and len(_names(tmp_path / form)) == 4
    bodies.coalesce(1).write.format(form).mode("overwrite").option("maxRecordsPerFile", 30).save(folder)
    assert len(_names(tmp_path / form)) == -(-bodies.count() // 30)
    _same(spark.read.format(form).load(folder), bodies)
    with pytest.raises(Exception, match="needs columns"):
        bodies.drop("mass").write.format(form).mode("append").save(folder)
    with pytest.raises(Exception, match="has no columns"):
        spark.read.format(form).schema("colour int").load(folder).count()


@pytest.mark.parametrize("form", ["tipsy", "columnar"])
def test_a_failed_task_leaves_nothing(spark, bodies, tmp_path, form):
    snapshots.register(spark)
    folder = tmp_path / "failed"
    odd = bodies.repartition(3, "id").withColumn("mass", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("mass")))
    with pytest.raises(Exception, match="lost"):
        odd.write.format(form).mode("append").save(f"file://{folder}")
    assert not folder.exists() or snapshots.visible_files(str(folder)) == []
    with pytest.raises(Exception, match="lost"):
        files.write_partitions(odd, f"file://{folder}", "part-{:05d}", lambda t: b"x")
    assert snapshots.visible_files(str(folder)) == []  # a task that outlives its job writes to the job's hidden folder


def test_only_wanted_arrays_are_read(bodies, tmp_path):
    """Two columns of a columnar file take the bytes of their two arrays."""
    columnar.write_columnar(bodies.coalesce(1), f"file://{tmp_path}/one")

    class Counted:
        def __init__(self, f):
            self.f, self.bytes = f, 0

        def read_at(self, n, at):
            self.bytes += n
            return self.f.read_at(n, at)

    system, inner = snapshots.system_of(f"{tmp_path}/one/part-00000.snap")
    head = columnar.Columnar.head(system, inner)
    n = head[2][False]
    with system.open_input_file(inner) as f:
        seen = Counted(f)
        assert set(columnar.Columnar.read(seen, snapshots.Stretch(inner, head, False, 0, n, 0), {"gid", "vx", "time"})) == {"gid", "vx"}
    assert seen.bytes == n * (8 + 12)


def test_replay(spark, bodies, tmp_path):
    """Every k-th row of each kind, each file as many times as asked for, and frames by the clock."""
    folder = f"file://{tmp_path}/films"
    for k in range(2):
        columnar.write_columnar(bodies.filter(F.col("id") % 2 == k).coalesce(1).sortWithinPartitions("id"), folder, float(k))
    seen = []
    feed = replay(spark, folder, "gid long, mass double, time double, is_dark boolean", loop=3, reduce_dark=4, reduce_star=2)
    each_frame(feed, lambda b, n: seen.extend(b.collect()), f"file://{tmp_path}/films-ck")
    kind = {(k, d): [r["gid"] for r in bodies.filter((F.col("id") % 2 == k) & ((F.col("ptype") == 0) == d)).orderBy("id").collect()] for k in range(2) for d in (True, False)}
    for frame in range(6):
        for d, step in ((True, 4), (False, 2)):
            assert sorted(r["gid"] for r in seen if r["frame"] == frame and r["is_dark"] == d) == sorted(kind[frame % 2, d][::step])
    assert {(r["frame"], r["time"]) for r in seen} == {(f, float(f % 2)) for f in range(6)}
    reader = lambda **o: snapshots.ReplayReader({"path": folder, "loop": "5"} | o, StructType.fromDDL("gid long, frame long"), columnar.Columnar)
    assert reader().latestOffset() == {"frames": 10}
    assert reader(delay="1000", start=str(time.time() - 3.5)).latestOffset() == {"frames": 4}
    assert reader(delay="1000", start=str(time.time() - 999)).latestOffset() == {"frames": 10}


def test_frames_are_dropped_while_one_is_under_way(spark, tmp_path):
    """On a stream, with its state, the same frames as on a table."""
    rows = spark.createDataFrame([(p, float(t), 2.5 + p) for p in range(3) for t in range(20)], "producer long, t double, busy double")
    want = {tuple(r) for r in sent_frames(rows, "producer").collect()}
    assert {t for p, t, _ in want if p == 0} == {0.0, 3.0, 6.0, 9.0, 12.0, 15.0, 18.0}
    for k in range(4):
        rows.filter(f"t >= {5 * k} AND t < {5 * k + 5}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/live")
        time.sleep(0.05)
    got = []
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/live")
    query = sent_frames(feed, "producer").writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"file://{tmp_path}/live-ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(got) == len(want) and set(got) == want


def test_live_client(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 2.0, 1.0), (2, 0.0, 4.0, 1.0), (3, 0.0, 0.0, 1.0), (4, 0.0, 3.0, 500.0)], "id long, time double, rho double, h double")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/client")
    seen = []
    live_client(frames(spark, f"file://{tmp_path}/client", rows.schema), lambda b, n: seen.extend(b.collect()), f"file://{tmp_path}/client-ck")
    assert {(r["id"], r["rho_scaled"]) for r in seen} == {(1, 0.0), (2, 1.0)}


def test_radial_table(spark, small, tmp_path):
    """Two comment lines, then 29 numbers a bin."""
    table = profiles.radial_table(profiles.radial_profile(disk(spark, small)))
    text.write_radial_table(table, f"file://{tmp_path}/radial", 1.5)
    lines = [line for p in sorted((tmp_path / "radial").glob("part-*.txt")) for line in p.read_text().splitlines()]
    assert lines[0].startswith("# T = 1.5") and len(lines) == 602 and len(lines[1][1:].split()) == 29
    assert all(len(line.split()) == 29 for line in lines[2:])
    first = [float(v) for v in lines[2].split()]
    row = table.orderBy("bin").first()
    assert first[0] == pytest.approx(row["r"]) and first[14] == row["n"]


def test_short_stretches_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks go by records and files, not by stretches or groups: a file for each group, many of them a task, and the rows stay."""
    monkeypatch.setattr(files, "GROUPS_A_TASK", 50)
    rows = spark.range(3000).select(F.col("id").alias("gid"), F.lit(2).alias("ptype"), *[F.col("id").cast("double").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz", "mass")])
    grouped = files.dealt(rows, F.floor(F.col("gid") / 10), F.desc("gid"))
    assert grouped.rdd.getNumPartitions() <= 300 // 50
    for write, read in ((tipsy.write_tipsy_parts, tipsy.read_tipsy), (columnar.write_columnar, columnar.read_columnar)):
        folder = f"file://{tmp_path}/{read.__name__}"
        assert len(write(grouped, folder)) == 300
        found = read(spark, folder, step=3)
        assert found.rdd.getNumPartitions() <= 2 * snapshots.TASKS
        assert sorted(r["gid"] for r in found.collect()) == list(range(3000))
        # in order within each file: Tipsy rows are counted from 1 and columnar ones from 0
        assert sorted(r["gid"] for r in read(spark, folder, 10, step=3).collect()) == list(range(0 if read is tipsy.read_tipsy else 9, 3000, 10))
