"""Near-duplicate documents with an LSH forest of MinHash signatures.

* A text is the set of its five-word shingles; equal sets are one *class* from the start, so
  thousands of exact copies cost one row for each task.
* **Forest.** ``TREES`` orders of a ``HASHES``-fold MinHash signature; each class stands in every tree at the place its own
  order of coordinates gives it.  A *region* is a run of classes that agree on the first two
  coordinates.  All trees together are dealt by range of (region, deeper coordinates), so
  a hot region spreads over many tasks.
* **Adaptive depth.** A region of up to ``REGION`` classes is compared whole; a larger one is divided by
  further coordinates until its parts are that small, and each class in it is also compared with those
  around it in sorted order, its neighbours of longest common prefix.
* In a first turn regions are compared by signature: ``AGREE`` of ``HASHES`` coordinates, about five
  standard deviations below what a pair at the threshold has.  A region returns a spanning
  forest of its candidates, not its pairs; they are verified on full sets and joined to
  components.  In a second turn the regions that still hold several components get the full sets
  of their classes and return a spanning forest of the links between components.  Neither turn returns more
  edges than it has rows.
* Regions of more than ``REGION`` classes that still hold several components after that are finished exactly: their classes are joined
  on the rarest shingles of their full sets, of which two sets at the threshold must share one (prefix filter).
* Two classes at similarity 0.75 share a region of a tree with probability 0.56, so all
  sixteen trees miss them with probability 2e-6, however large the regions.

Shingles are hashes of 64 bits.  Defined results: a text without words, empty or null has an empty set and is linked with nothing; with fewer than
five words the whole sequence is its one shingle; rows of equal id and text share their component; ids may be of any type that has an
order, a null id counts as larger than all others, and a component without any other has a null id, of which all rows are kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textnp as tn
from .components import across, components, small
from .store import Store, bit_filter, col, may_hold

SHINGLE, HASHES, TREES, DEPTH, LEAST = 5, 128, 16, 8, 2
REGION, NEXT, AGREE = 512, 16, 72
NUMERATOR, DENOMINATOR = 75, 100
_ORDER = np.array([[(4 * t + i) % 64 if i < 4 else 64 + (4 * t + i) % 64 for i in range(DEPTH)] for t in range(TREES)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs of a chunk, sorted."""
    w = tn.words(tn.lower_ascii(data), offsets)
    h, at = tn.grams(w, size)
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < size))
    acc = np.zeros(len(few), np.uint64)
    for i in range(size - 1):
        has = n[few] > i
        acc[has] += w.hash[w.first[few[has]] + i] * tn.constants(size, 91)[i]
    return tn.distinct_per_doc(np.concatenate([w.doc[at], few]), np.concatenate([h, tn.mix64(acc + n[few].astype(np.uint64))]))


def _id(docs: DataFrame, id_col: str) -> Column:
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int")
    return col(id_col).cast("long") if whole else col(id_col)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (shingles), d1, d2 (digest of the set), sig (16 bits of each MinHash)."""
    mult = tn.constants(HASHES, 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tn.chunks(batch.column(1)):
                docs_ = b - a
                doc, h = shingle_sets(data, offsets)
                n = np.bincount(doc, minlength=docs_)
                digest = np.zeros((2, docs_), np.uint64)
                sig = np.zeros((docs_, HASHES), np.uint16)
                if len(doc):
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    has = doc[first]
                    digest[0, has] = np.add.reduceat(tn.mix64(h ^ mult[0]), first)
                    digest[1, has] = np.add.reduceat(tn.mix64(h ^ mult[1]), first)
                    for k in range(HASHES):
                        sig[has, k] = tn.mix64(np.minimum.reduceat(h * mult[k], first)) >> np.uint64(48)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, docs_), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), pa.array([s.astype("<u2").tobytes() for s in sig], type=pa.binary())],
                    names=["id", "n", "d1", "d2", "sig"],
                )

    kind = docs.select(_id(docs, id_col)).schema[0].dataType.simpleString()
    return docs.select(_id(docs, id_col).alias("id"), col(text_col)).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _region_keys(sig: np.ndarray) -> np.ndarray:
    """classes x trees of the region each class stands in."""
    mult = tn.constants(LEAST, 41)
    out = np.zeros((len(sig), TREES), np.uint64)
    for i in range(LEAST):
        out += (sig[:, _ORDER[:, i]].astype(np.uint64) + np.uint64(1)) * mult[i]
    return tn.mix64(out * np.uint64(TREES) + np.arange(TREES, dtype=np.uint64))


def _regions(classes: DataFrame) -> DataFrame:
    """key, n (classes), lo and hi (components) of every region of every tree."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_region_keys(_signatures(batch.column(0))).view(np.int64).ravel()), batch.column(1).take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))], names=["key", "comp"])

    return classes.select("sig", "comp").mapInArrow(keys, "key long, comp long").groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))


def _tree_rows(classes: DataFrame, wanted: DataFrame, payload: str) -> DataFrame:
    """key, spread, deep (further coordinates, sortable), rep, n, comp, payload of each class in each tree, for the wanted regions (key, n).

    A large region is dealt by its deeper coordinates (spread), others stay whole."""
    shared = classes.sparkSession.sparkContext.broadcast((bit_filter(wanted, "key"), bit_filter(wanted.filter(F.col("n") > REGION), "key")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, large = shared.value
        for batch in batches:
            sig = _signatures(batch.column(3))
            key = _region_keys(sig)
            at, tree = np.nonzero(may_hold(some, key.ravel()).reshape(key.shape))
            wide = may_hold(large, key[at, tree])
            deep = [x.tobytes() for x in np.take_along_axis(sig[at], _ORDER[tree][:, LEAST:], axis=1).astype(">u2")]
            take = pa.array(at)
            load = batch.column(4).take(take) if payload != "sig" else pa.array([x.tobytes() for x in (sig[at] & 255).astype(np.uint8)], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at, tree].view(np.int64)), pa.array([d if w else b"" for d, w in zip(deep, wide.tolist(), strict=True)], type=pa.binary()), pa.array(deep, type=pa.binary()), *(batch.column(i).take(take) for i in range(3)), load],
                names=["key", "spread", "deep", "rep", "n", "comp", "load"],
            )

    return classes.select("rep", "n", "comp", "sig", F.col(payload).alias("load")).mapInArrow(rows, "key long, spread binary, deep binary, rep long, n long, comp long, load binary")


def _agreement(n: np.ndarray, load: list[bytes]) -> np.ndarray:
    """Agreeing coordinates of all pairs, 0 where sizes alone rule the pair out."""
    sig = np.frombuffer(b"".join(load), np.uint8).reshape(-1, HASHES)
    agree = np.zeros((len(n), len(n)), np.int16)
    for lo in range(0, len(n), 64):
        agree[lo : lo + 64] = (sig[lo : lo + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.int16)
    agree[DENOMINATOR * np.minimum(n[:, None], n[None, :]) < NUMERATOR * np.maximum(n[:, None], n[None, :])] = 0
    return agree


def _values(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _similar(n: np.ndarray, load: list[bytes]) -> np.ndarray:
    """Whether each pair of full sets reaches the threshold: products of their incidence over the shingles that two or more have."""
    sets = [_values(x) for x in load]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    live = count[shingle] > 1
    shingle, owner = rank[shingle[live]], owner[live]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 13
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(shingle, (lo, lo + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], shingle[a:b] - lo] = 1
        common += part @ part.T
    size = np.array([len(x) for x in sets])
    common = np.rint(common).astype(np.int64)
    return DENOMINATOR * common >= NUMERATOR * (size[:, None] + size[None, :] - common)


def _spanning(score: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Greatest spanning forest of the pairs of at least that score, grown node by node."""
    m = len(score)
    best, source = score[0].copy(), np.zeros(m, np.int64)
    best[0] = -1
    edges = []
    for _ in range(m - 1):
        u = int(best.argmax())
        if best[u] >= least:
            edges.append((int(source[u]), u))
        row = score[u]
        better = (row > best) & (best >= 0)
        best[better], source[better] = row[better], u
        best[u] = -1
    return edges


def _compare(rep: np.ndarray, n: np.ndarray, comp: np.ndarray, deep: list[bytes], load: list[bytes], exact: bool, out: list[tuple[int, int]]) -> None:
    """Edges of one sorted region (or the part of it that a task holds): a spanning forest of its likely pairs, or, exact, of its links between components."""
    m = len(rep)
    if m < 2 or exact and (comp == comp[0]).all():
        return
    if m <= REGION:
        if exact:
            # classes of one component count as linked already
            score = np.where(comp[:, None] == comp[None, :], 2, _similar(n, load).astype(np.int8)).astype(np.int8)
            edges = [(i, j) for i, j in _spanning(score, 1) if comp[i] != comp[j]]
        else:
            agree = _agreement(n, load)
            np.fill_diagonal(agree, 0)
            edges = _spanning(agree, AGREE)
        out += ((int(rep[i]), int(rep[j])) for i, j in edges)
        return
    # neighbours in order, by overlapping stretches
    for a in range(0, m, NEXT):
        z = a + 2 * NEXT
        _compare(rep[a:z], n[a:z], comp[a:z], deep[a:z], load[a:z], exact, out)
    if len(deep[0]) >= 2:
        head = [d[:2] for d in deep]
        cut = [0, *(i for i in range(1, m) if head[i] != head[i - 1]), m]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            _compare(rep[a:b], n[a:b], comp[a:b], [d[2:] for d in deep[a:b]], load[a:b], exact, out)
    else:  # no coordinates left
        for a in range(0, m, REGION // 2):
            z = a + REGION
            _compare(rep[a:z], n[a:z], comp[a:z], deep[a:z], load[a:z], exact, out)


def region_edges(trees: DataFrame, exact: bool) -> DataFrame:
    """Edges (a, b) between class representatives from all regions of all trees."""
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held_rows = (16 if exact else 64) * REGION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            key = rows["key"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            rep, n, comp = (rows[c].to_numpy() for c in ("rep", "n", "comp"))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1 and not (exact and (comp[a:b] == comp[a]).all()):
                    part = rows.slice(a, b - a)
                    _compare(rep[a:b], n[a:b], comp[a:b], part["deep"].to_pylist(), part["load"].to_pylist(), exact, out)
            pairs = sorted({(min(p), max(p)) for p in out if p[0] != p[1]})
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1], side="left"))
            if last:
                yield done(rows.slice(0, last))
            held = rows.slice(last).to_batches()
            # a region longer than a task should hold is worked off in overlapping stretches of its sorted order
            if len(key) - last > held_rows:
                tail = rows.slice(last)
                yield done(tail)
                held = tail.slice(len(tail) - REGION).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = trees.repartitionByRange(parts, "key", "spread").drop("spread").sortWithinPartitions("key", "deep")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def set_bytes(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, shingles (sorted hashes) of the classes in needed (rep, id, d1, d2); one of a class's documents has that id."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(needed.select(F.xxhash64("id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = tn.constants(HASHES, 31)
        for batch in batches:
            ok = may_hold(shared.value, batch.column(0).to_numpy().view(np.uint64))
            some = batch.filter(pa.array(ok))
            for a, b, data, offsets in tn.chunks(some.column(1)):
                doc, h = shingle_sets(data, offsets)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                live = [i for i in range(b - a) if cut[i] < cut[i + 1]]
                d = [[int(tn.mix64(h[cut[i] : cut[i + 1]] ^ m).sum(dtype=np.uint64).view(np.int64)) for i in live] for m in mult[:2]]
                raw = [h[cut[i] : cut[i + 1]].astype("<u8").tobytes() for i in live]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, type=pa.int64()) for x in d), pa.array(raw, type=pa.binary())], names=["d1", "d2", "shingles"])

    found = docs.select(F.xxhash64(_id(docs, id_col)).alias("key"), col(text_col)).mapInArrow(run, "d1 long, d2 long, shingles binary")
    return found.join(small(needed.select("d1", "d2", "rep")), ["d1", "d2"]).dropDuplicates(["rep"]).select("rep", "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(batch.num_rows):
                p, q = _values(x[i]), _values(y[i])
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if DENOMINATOR * common >= NUMERATOR * (len(p) + len(q) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in good], type=pa.int64()) for v in (a, b)], names=["a", "b"])

    left = sets.withColumnsRenamed({"rep": "a", "shingles": "x"})
    right = sets.withColumnsRenamed({"rep": "b", "shingles": "y"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sizes(a: str, b: str) -> Column:
    """Whether the sizes of two sets alone allow the threshold."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def _overlap(a: str, b: str, i: str, j: str) -> Column:
    """Whether sets of a and b shingles whose first common one is the i-th and j-th rarest can still reach the threshold."""
    least = F.ceil((F.col(a) + F.col(b)) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    return 1 + F.least(F.col(a) - F.col(i), F.col(b) - F.col(j)) >= least


def large_regions(classes: DataFrame, regions: DataFrame, comps: DataFrame) -> DataFrame:
    """rep, n, id, d1, d2, comp of the classes in regions of more than REGION classes that hold several components. comps: rep, comp where it isn't rep."""
    large = regions.filter(F.col("n") > REGION).select("key")
    shared = classes.sparkSession.sparkContext.broadcast(bit_filter(large, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _region_keys(_signatures(batch.column(1)))
            at, tree = np.nonzero(may_hold(shared.value, key.ravel()).reshape(key.shape))
            yield pa.RecordBatch.from_arrays([pa.array(key[at, tree].view(np.int64)), batch.column(0).take(pa.array(at))], names=["key", "rep"])

    rows = classes.select("rep", "sig").mapInArrow(run, "key long, rep long").join(small(large), "key", "left_semi").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return rows.join(small(mixed), "key", "left_semi").select("rep", "comp").distinct().join(classes.select("rep", "n", "id", "d1", "d2"), "rep")


def rare_pairs(some: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles: every pair at the threshold does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                h = _values(raw).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(0)[i].as_py())), pa.array(h)], names=["rep", "key"])

    tokens = sets.mapInArrow(run, "rep long, key long")
    often = tokens.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    order = Window.partitionBy("rep").orderBy("f", "key")
    # shingles of one set only come first and match nothing
    prefix = tokens.join(often, "key", "left").withColumn("at", F.row_number().over(order)).join(some.select("rep", "n", "comp"), "rep")
    least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    prefix = prefix.filter((F.col("at") <= F.col("n") - least + 1) & (F.col("f") > 1))
    return across(prefix.select("key", F.col("rep").alias("node"), F.col("n").alias("size"), "comp", "at"), _sizes, at=_overlap)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id) of every row."""
    store = Store(docs.sparkSession, "forest")
    drawn = store.keep(sketches(docs, id_col, text_col), "sketches")
    classes = drawn.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # written once, so the number of a class is the same for all readers
    classes = store.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    alone = classes.withColumn("comp", F.col("rep"))
    regions = store.keep(_regions(alone).filter("n > 1").select("key", "n"), "regions")
    pairs = store.keep(region_edges(_tree_rows(alone, regions, "sig"), False), "pairs")
    active = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    near = store.keep(classes.join(active, "rep", "left_semi"), "near")
    sets = store.keep(set_bytes(docs, near.select("rep", "id", "d1", "d2"), id_col, text_col), "sets")
    links = store.keep(verified(pairs, sets), "links")
    first = store.keep(components(links, store), "first")
    near = near.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    near = store.keep(near.select("rep", "n", "comp", "sig").join(sets, "rep"), "near2")
    more = region_edges(_tree_rows(near, store.keep(_regions(near).filter("lo < hi").select("key", "n"), "mixed"), "shingles"), True)
    links = store.keep(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "links2")
    store.drop(sets, near)
    found = store.keep(components(links, store).toDF("rep", "comp"), "second")
    if not regions.filter(F.col("n") > REGION).isEmpty():
        some = store.keep(large_regions(classes, regions, found), "large")
        if not some.isEmpty():
            sets = store.keep(set_bytes(docs, some.select("rep", "id", "d1", "d2"), id_col, text_col), "sets")
            links = found.toDF("a", "b").union(verified(store.keep(rare_pairs(some, sets), "rare"), sets))
            found = store.keep(components(links, store).toDF("rep", "comp"), "third")
            store.drop(sets)
    # the smallest id of each component, whatever the numbers of its classes
    grouped = classes.select("rep", "id", "d1", "d2").join(found, "rep")
    least = grouped.groupBy("comp").agg(F.min("id").alias("component"))
    labels = grouped.join(least, "comp").select("d1", "d2", "component")
    labels = labels.unionByName(classes.join(found, "rep", "left_anti").select("d1", "d2", F.col("id").alias("component")))
    out = drawn.select("id", "n", "d1", "d2").join(labels, ["d1", "d2"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group, with all their columns."""
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(col(id_col).cast(docs.schema[id_col].dataType).alias("__sm_kept")).distinct()
    return docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["__sm_kept"]), "left_semi")
