"""The octree as a hierarchical group-by on key prefixes, its moments and particle groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import physics
from ..functions.sfc import grid_coordinates, hilbert, morton, prefix, sfc_keys
from .cut import cut, numbered, running_sum

LEAF, MIN_NODES, GROUP, DEEPEST = 16, 16, 64, 29
STRIDE, BROADCAST_LEAVES = 5, 200_000
MOMENTS = ("mass", "mx", "my", "mz", "sxx", "syy", "szz", "sxy", "sxz", "syz")


def _at_levels(keys: DataFrame, first: int, last: int) -> DataFrame:
    rows = keys.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last))))
    hi, lo = prefix(F.col("level"))
    return rows.withColumns({"prefix_hi": hi, "prefix_lo": lo})


def start_level(keys: DataFrame, min_nodes: int = MIN_NODES) -> int:
    """First level with more than min_nodes nodes; 0 if there is none."""
    for first in range(0, DEEPEST + 1, STRIDE):
        last = min(first + STRIDE - 1, DEEPEST)
        nodes = _at_levels(keys, first, last).select("level", "prefix_hi", "prefix_lo").distinct().groupBy("level").count()
        found = nodes.filter(F.col("count") > min_nodes).agg(F.min("level")).first()[0]
        if found is not None:
            return found
    return 0


def build_nodes(keys: DataFrame, nleaf: int = LEAF, min_nodes: int = MIN_NODES, start: int | None = None) -> DataFrame:
    """level, prefix_hi, prefix_lo, n, is_leaf of the octree over keys (id, key_hi, key_lo).

    A node of up to nleaf bodies is a leaf once a level above it had more than min_nodes nodes. Levels are built a few at a time from the bodies that no leaf holds yet.
    Raises ValueError if bodies that coincide leave a larger node at the last level."""
    start = start_level(keys, min_nodes) if start is None else start
    alive, parts = keys.select("key_hi", "key_lo"), []
    for first in range(0, DEEPEST + 1, STRIDE):
        last = min(first + STRIDE - 1, DEEPEST)
        rows = _at_levels(alive, first, last)
        counts = rows.groupBy("level", "prefix_hi", "prefix_lo").agg(F.count("*").alias("n"))
        counts = counts.withColumn("is_leaf", (F.col("n") <= nleaf) & (F.col("level") > start))
        leaf = counts.filter("is_leaf").select("level", "prefix_hi", "prefix_lo")
        # the shallowest leaf over each deeper node of the stretch closes it
        inside = counts.alias("c")
        for up in range(first, last):
            above = leaf.filter(F.col("level") == up).select(F.col("prefix_hi").alias("u_hi"), F.col("prefix_lo").alias("u_lo"))
            u_hi, u_lo = _ancestor(up)
            inside = inside.join(above, (F.col("level") > up) & (u_hi == F.col("u_hi")) & (u_lo == F.col("u_lo")), "left_anti")
        nodes = cut(inside.select("level", "prefix_hi", "prefix_lo", "n", "is_leaf"))
        parts.append(nodes)
        open_ = nodes.filter((F.col("level") == last) & ~F.col("is_leaf"))
        if open_.isEmpty():
            break
        if last == DEEPEST:
            raise ValueError("bodies coincide down to the last level of the tree; remove duplicates or far outliers")
        hi, lo = prefix(last)
        alive = alive.join(open_.select("prefix_hi", "prefix_lo"), (hi == F.col("prefix_hi")) & (lo == F.col("prefix_lo")), "left_semi")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ancestor(up: int):
    """Prefix at level up of a node given by level, prefix_hi, prefix_lo (level above up)."""
    shift_hi = F.lit(3) * (F.least(F.col("level"), F.lit(20)) - min(up, 20))
    hi = F.call_function("shiftright", F.col("prefix_hi"), shift_hi)
    lo = F.when(F.lit(up) <= 20, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("prefix_lo"), F.lit(3) * (F.col("level") - up)))
    return hi, lo


def parent(level: str = "level"):
    """Prefix of the parent node."""
    deep = F.col(level) > 20
    return F.when(deep, F.col("prefix_hi")).otherwise(F.shiftright("prefix_hi", 3)), F.when(deep & (F.col(level) > 21), F.shiftright("prefix_lo", 3)).otherwise(F.lit(0).cast("long"))


def leaf_of(bodies: DataFrame, nodes: DataFrame) -> DataFrame:
    """bodies (with key_hi, key_lo) with the level and prefix of their leaf: one equi-join over the levels that have leaves.

    Leaves hold up to a leaf's bodies each and are broadcast while there are few."""
    leaves = nodes.filter("is_leaf").select("level", "prefix_hi", "prefix_lo")
    n, first, last = leaves.agg(F.count("*"), F.min("level"), F.max("level")).first()
    rows = bodies.withColumn("level", F.explode(F.sequence(F.lit(first or 0), F.lit(last or 0))))
    hi, lo = prefix(F.col("level"))
    return rows.withColumns({"prefix_hi": hi, "prefix_lo": lo}).join(F.broadcast(leaves) if n <= BROADCAST_LEAVES else leaves, ["level", "prefix_hi", "prefix_lo"])


def node_properties(nodes: DataFrame, bodies: DataFrame, theta: float = 0.75) -> DataFrame:
    """nodes with n_child, mass, centre of mass, central second moments per unit mass, tight box, squared opening radius and, where bodies have a softening eps, the largest of it.

    Bodies are summed into leaves once; leaves, far fewer, are then summed into all their ancestors in one aggregation."""
    placed = leaf_of(bodies, nodes)
    m = F.col("mass")
    sums = {"mass": m} | {f"m{c}": m * F.col(c) for c in "xyz"} | {f"s{a}{b}": m * F.col(a) * F.col(b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    soft = [F.max("eps").alias("eps")] if "eps" in bodies.columns else []
    boxes = [f(c).alias(f"{c}{f.__name__}") for c in "xyz" for f in (F.min, F.max)] + soft
    leaves = placed.groupBy("level", "prefix_hi", "prefix_lo").agg(*[F.sum(v).alias(k) for k, v in sums.items()], *boxes)
    up = leaves.withColumnRenamed("level", "_leaf").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_leaf"))))
    shift = F.lit(3) * (F.least(F.col("_leaf"), F.lit(20)) - F.least(F.col("level"), F.lit(20)))
    lo = F.when(F.col("level") <= 20, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("prefix_lo"), F.lit(3) * (F.col("_leaf") - F.col("level"))))
    up = up.withColumns({"prefix_hi": F.call_function("shiftright", F.col("prefix_hi"), shift), "prefix_lo": lo})
    merged = up.groupBy("level", "prefix_hi", "prefix_lo").agg(*[F.sum(k).alias(k) for k in MOMENTS], *[f(f"{c}{f.__name__}").alias(f"{c}{f.__name__}") for c in "xyz" for f in (F.min, F.max)], *soft)
    p_hi, p_lo = parent()
    children = nodes.filter("level > 0").select((F.col("level") - 1).alias("level"), p_hi.alias("prefix_hi"), p_lo.alias("prefix_lo")).groupBy("level", "prefix_hi", "prefix_lo").agg(F.count("*").alias("n_child"))
    key = ["level", "prefix_hi", "prefix_lo"]
    out = nodes.join(merged, key).join(children, key, "left").withColumn("n_child", F.coalesce("n_child", F.lit(0).cast("long")))
    com = {f"com_{c}": F.when(F.col("mass") > 0, F.col(f"m{c}") / F.col("mass")).otherwise(0.0) for c in "xyz"}
    out = out.withColumns(com)
    q = {f"q{i}{j}": F.when(F.col("mass") > 0, F.col(f"s{a}{b}") / F.col("mass") - F.col(f"com_{a}") * F.col(f"com_{b}")).otherwise(0.0) for (i, a), (j, b) in (((1, "x"), (1, "x")), ((2, "y"), (2, "y")), ((3, "z"), (3, "z")), ((1, "x"), (2, "y")), ((1, "x"), (3, "z")), ((2, "y"), (3, "z")))}
    out = out.withColumns(q | {f"c{c}": 0.5 * (F.col(f"{c}min") + F.col(f"{c}max")) for c in "xyz"} | {f"h{c}": 0.5 * (F.col(f"{c}max") - F.col(f"{c}min")) for c in "xyz"})
    gap2 = sum(((F.col(f"c{c}") - F.col(f"com_{c}")) * (F.col(f"c{c}") - F.col(f"com_{c}")) for c in "xyz"), F.lit(0.0))
    out = out.withColumn("open2", physics.opening_radius2(F.col("mass"), F.col("n"), {c: F.col(f"h{c}") for c in "xyz"}, gap2, theta))
    return out.select(*key, "n", "is_leaf", "n_child", "mass", *com, *q, "cx", "cy", "cz", "hx", "hy", "hz", "open2", *(["eps"] if soft else []))


def ordered(keys: DataFrame) -> DataFrame:
    """keys with rn, the 1-based place on the curve; ties by id."""
    return numbered(keys, "key_hi", "key_lo", "id")


def level_ranges(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """level, prefix, first and last rn of every node's bodies (keyed: with rn and leaf columns)."""
    return leaf_of(keyed, nodes).groupBy("level", "prefix_hi", "prefix_lo").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


def make_groups(keyed: DataFrame, start: int, ncrit: int = GROUP) -> DataFrame:
    """keyed (with rn) with group_id: a new group starts every ncrit rows and at every node of the level after the start level."""
    hi, lo = prefix(min(start + 1, DEEPEST))
    tagged = keyed.withColumns({"_hi": hi, "_lo": lo})
    firsts = tagged.groupBy("_hi", "_lo").agg(F.min("rn").alias("_first"))
    cutp = ((F.col("rn") - 1) % ncrit == 0) | (F.col("rn") == F.col("_first"))
    return running_sum(tagged.join(firsts, ["_hi", "_lo"]).withColumn("_cut", cutp.cast("long")), "_cut", "group_id").drop("_hi", "_lo", "_first", "_cut")


def group_boxes(grouped: DataFrame) -> DataFrame:
    """group_id, first and last rn, n, centre and half size of its box."""
    box = grouped.groupBy("group_id").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.count("*").alias("n"), *[f(c).alias(f"{c}{f.__name__}") for c in "xyz" for f in (F.min, F.max)])
    return box.select("group_id", "first_rn", "last_rn", "n", *[(0.5 * (F.col(f"{c}min") + F.col(f"{c}max"))).alias(f"g{c}") for c in "xyz"], *[(0.5 * (F.col(f"{c}max") - F.col(f"{c}min"))).alias(f"e{c}") for c in "xyz"])


def boundary_tree(props: DataFrame, limit: int) -> DataFrame:
    """Nodes kept when the tree is cut at nodes of eight children, at leaves and at level limit; truncated marks where it was cut."""
    stop = (F.col("n_child") == 8) | F.col("is_leaf") | (F.col("level") == limit)
    kept = props.filter(F.col("level") == 0).withColumn("truncated", stop)
    layer, parts = kept, [kept]
    for level in range(1, limit + 1):
        p_hi, p_lo = parent()
        above = layer.filter(~F.col("truncated")).select(F.col("prefix_hi").alias("u_hi"), F.col("prefix_lo").alias("u_lo"))
        layer = props.filter(F.col("level") == level).withColumns({"_h": p_hi, "_l": p_lo}).join(above, (F.col("_h") == F.col("u_hi")) & (F.col("_l") == F.col("u_lo")), "left_semi").drop("_h", "_l").withColumn("truncated", stop)
        parts.append(layer)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boundary_rows(props: DataFrame, bodies: DataFrame, limit: int) -> DataFrame:
    """What a boundary tree sends: its nodes (kind node: level, prefix, n, truncated, mass, com_*) and the body of every leaf that holds just one (kind body: id, with its mass and place), which need not be asked for."""
    key = ["level", "prefix_hi", "prefix_lo"]
    kept = boundary_tree(props, limit)
    place = {c: f"com_{c}" for c in "xyz"}
    nodes = kept.select(F.lit("node").alias("kind"), *key, "n", "truncated", F.lit(None).cast("long").alias("id"), "mass", *[F.col(v).alias(c) for c, v in place.items()])
    single = kept.filter("is_leaf AND n = 1").select(*key)
    own = leaf_of(bodies, props).join(single, key, "left_semi")
    return nodes.unionByName(own.select(F.lit("body").alias("kind"), *key, F.lit(1).cast("long").alias("n"), F.lit(True).alias("truncated"), F.col("id").cast("long").alias("id"), "mass", "x", "y", "z"))


def top_level_tree(cells: DataFrame, nleaf: int = 8, start: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, cells with their keys) of a tree over cells (id, x, y, z) that stand for the domains' trees: keys of truncated coordinates, leaves of up to nleaf cells below the start level."""
    placed = grid_coordinates(cells, exact=True).withColumn("_key", hilbert("ix", "iy", "iz"))
    keys = cut(placed.select(*cells.columns, "_key.key_hi", "_key.key_lo"))
    return build_nodes(keys, nleaf, start=start), keys


def runs_of(keyed: DataFrame, level: int) -> DataFrame:
    """keyed (with rn) with head and tail flags of each run of equal prefix."""
    hi, lo = prefix(level)
    tagged = keyed.withColumns({"_hi": hi, "_lo": lo})
    ends = tagged.groupBy("_hi", "_lo").agg(F.min("rn").alias("_a"), F.max("rn").alias("_b"))
    return tagged.join(ends, ["_hi", "_lo"]).withColumns({"head": F.col("rn") == F.col("_a"), "tail": F.col("rn") == F.col("_b")}).drop("_hi", "_lo", "_a", "_b")


def insertion_tree(p: DataFrame, limit: int = 32) -> DataFrame:
    """level, prefix_hi, prefix_lo, n, is_leaf of the tree that splits a node as soon as it has limit bodies, on truncated Morton keys of 20 levels. Nodes without bodies have no row."""
    grid = grid_coordinates(p, 20, exact=True)
    keys = cut(grid.select("id", morton(F.col("ix"), F.col("iy"), F.col("iz")).alias("key_hi"), F.lit(0).cast("long").alias("key_lo")))
    return build_nodes(keys, limit - 1, start=-1)


def small_nodes(nodes: DataFrame, ncrit: int) -> DataFrame:
    """The highest nodes of fewer than ncrit bodies: those whose parent, if any, has as many or more."""
    p_hi, p_lo = parent()
    up = nodes.filter(F.col("n") >= ncrit).select((F.col("level") + 1).alias("level"), F.col("prefix_hi").alias("u_hi"), F.col("prefix_lo").alias("u_lo"))
    few = nodes.filter(F.col("n") < ncrit).withColumns({"u_hi": p_hi, "u_lo": p_lo})
    return few.filter("level = 0").drop("u_hi", "u_lo").unionByName(few.filter("level > 0").join(up, ["level", "u_hi", "u_lo"], "left_semi").drop("u_hi", "u_lo"))


def level_list(nodes: DataFrame) -> DataFrame:
    """level, first and last number of its nodes when all are numbered level by level along the curve."""
    counts = nodes.groupBy("level").agg(F.count("*").alias("n"))
    # one row a level
    before = F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("level", (before + 1).alias("first"), (before + F.col("n")).alias("last"))


def group_tree(boxes: DataFrame, nleaf: int = LEAF, min_nodes: int = 8) -> DataFrame:
    """Tree over groups (boxes of ``group_boxes`` with their mass and com_*): nodes with mass, centre of mass and the box around the groups' boxes."""
    centres = boxes.select(F.col("group_id").alias("id"), *[F.col(f"g{c}").alias(c) for c in "xyz"], *[F.col(f"e{c}") for c in "xyz"], "mass", *[F.col(f"com_{c}") for c in "xyz"])
    keys = cut(sfc_keys(centres))
    nodes = build_nodes(keys, nleaf, min_nodes)
    placed = leaf_of(keys, nodes)
    up = placed.withColumnRenamed("level", "_leaf").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_leaf"))))
    hi, lo = prefix(F.col("level"))
    m = F.col("mass")
    sums = up.withColumns({"prefix_hi": hi, "prefix_lo": lo}).groupBy("level", "prefix_hi", "prefix_lo").agg(
        F.sum(m).alias("mass"), *[F.try_divide(F.sum(m * F.col(f"com_{c}")), F.sum(m)).alias(f"com_{c}") for c in "xyz"], *[F.min(F.col(c) - F.col(f"e{c}")).alias(f"low_{c}") for c in "xyz"], *[F.max(F.col(c) + F.col(f"e{c}")).alias(f"high_{c}") for c in "xyz"]
    )
    return nodes.join(sums, ["level", "prefix_hi", "prefix_lo"])
