"""Connected components by alternating large and small stars, DataFrame operations only.

Every round rewires each node to the smallest neighbour it knows; a graph of n nodes ends in O(log n)
rounds in practice.  Rounds are written to the shared folder, so neither lineage nor driver memory grows.
A node with very many neighbours is one key of a join whose large side can be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .store import Store

ROWS, PART, MAX_BROADCAST = 100_000, 1024, 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is short."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def across(rows: DataFrame, allowed: Callable[[str, str], Column], part: int = PART, at: Callable[[str, str, str, str], Column] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """a < b: nodes that share a key but no component. rows: key, node, size, comp; allowed says whether two sizes may be linked, and at the same of
    the sizes and the places (column at of rows) of the key in both; keep may write what is counted of the keys, which else is counted twice.

    Nodes outside the largest component of their key meet the others of the key, dealt by parts of it; what is linked already is never paired."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
    per = per.filter("kinds > 1").select("key", F.col("top.comp").alias("top"), F.ceil(F.col("n") / part).alias("parts"))
    per = small(keep(per) if keep else per)
    mixed = (rows if at else rows.withColumn("at", F.lit(0))).join(per, "key")
    right = mixed.select("key", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.col("node").alias("b"), F.col("size").alias("d"), F.col("at").alias("q"), F.col("comp").alias("e"), (F.col("comp") == F.col("top")).alias("large"))
    left = mixed.filter("comp <> top").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("a"), F.col("size").alias("c"), F.col("at").alias("p"), F.col("comp").alias("f"))
    found = left.join(right, ["key", "part"]).filter((F.col("e") != F.col("f")) & (F.col("large") | (F.col("a") < F.col("b"))) & allowed("c", "d"))
    found = found.filter(at("c", "d", "p", "q")) if at else found
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, store: Store, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node that occurs in an edge."""
    now = store.keep(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(now)
    # as many partitions as the edges need: their number never grows
    parts = 1 + state[0] // ROWS
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store.keep(large.coalesce(parts), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        new = store.keep(small.coalesce(parts), "small")
        store.drop(now, large)
        now, old = new, state
        state = _state(now)
        if state == old:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    """Two counts that change when an edge does."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
