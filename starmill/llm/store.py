"""Tables written to the folder all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and one machine does everything.

    Raises RuntimeError on a cluster without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="starmill-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


WHOLE = ("tinyint", "smallint", "int", "bigint")


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_key(df: DataFrame, id_col: str) -> Column:
    """An id to group and order by, nulls last: a long for whole numbers, else (whether null, value)."""
    if df.schema[id_col].dataType.simpleString() in WHOLE:
        return F.coalesce(col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("value"))


def id_hash(df: DataFrame, id_col: str) -> Column:
    """An id as a long: itself, or a hash of one that is no whole number; the least long for NULL."""
    whole = df.schema[id_col].dataType.simpleString() in WHOLE
    return F.coalesce(col(id_col).cast("long") if whole else F.when(col(id_col).isNotNull(), F.xxhash64(col(id_col))), F.lit(-(1 << 63)))


def plain(df: DataFrame, names: list[str]) -> tuple[list[Column], list[str], str]:
    """(the columns of those names under plain ones, the plain names, their schema): mapInArrow takes a dot in a name for a field."""
    inner = [f"__sm_c{i}" for i in range(len(names))]
    return [col(n).alias(i) for n, i in zip(names, inner, strict=True)], inner, ", ".join(f"{i} {df.schema[n].dataType.simpleString()}" for n, i in zip(names, inner, strict=True))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns as id and text, whatever they are called."""
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text"))


#: Whether the files of a query's shuffles go when it ends, not when the driver next collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """A folder of its own under the shared one; with release, shuffles of a table that is kept free their disk once it is written."""

    def __init__(self, spark: SparkSession, name: str, release: bool = False):
        self.spark, self.release = spark, release
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df once, with the writer's options, and read it back."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(RELEASE, None)
        if self.release:
            self.spark.conf.set(RELEASE, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            if self.release:
                self.spark.conf.unset(RELEASE) if before is None else self.spark.conf.set(RELEASE, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._starmill_path = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            if path := getattr(t, "_starmill_path", None):
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


FILTER_BITS = 26


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of two bits a key over 2**FILTER_BITS bits: 8 MB whatever the number of keys.

    Only a pre-filter: what passes it must still be joined exactly."""
    rest = F.col(column)
    place = F.explode(F.array(rest.bitwiseAND((1 << FILTER_BITS) - 1), F.shiftrightunsigned(rest, 64 - FILTER_BITS)))
    words = keys.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    table[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Mask of uint64 keys that may be in the filter."""
    ok = np.ones(len(key), dtype=bool)
    for bit in (key & np.uint64((1 << FILTER_BITS) - 1), key >> np.uint64(64 - FILTER_BITS)):
        ok &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok
