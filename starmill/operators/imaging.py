"""Projections of bodies to pixels: splats, compositing, depth order, camera paths and colour tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import physics
from ..sources.views import COORDS
from .cut import numbered

# Mass limits of the spectral classes, heaviest first, each class between a limit and the next, and their colours.
STAR_MASSES = (150.0, 40.0, 18.0, 6.5, 3.2, 2.1, 1.7, 1.29, 1.1, 1.0, 0.93, 0.78, 0.69, 0.47, 0.21, 0.1, 0.05)
STAR_COLOURS = (
    (32, 78, 255), (62, 108, 255), (68, 114, 255), (87, 133, 255), (124, 165, 255), (156, 189, 255), (177, 204, 255), (212, 228, 255),
    (237, 244, 255), (253, 254, 255), (255, 246, 233), (255, 233, 203), (255, 203, 145), (255, 174, 98), (255, 138, 56), (240, 0, 0),
)


def depth_order(p: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """id, depth (place along the view axis), place: 1 for the least depth."""
    depth = sum((F.col(c) * k for c, k in zip(COORDS, view, strict=False)), F.lit(0.0)) + view[3]
    return numbered(p.select("id", depth.alias("depth")), "depth", "id", name="place")


def project(p: DataFrame, width: int, height: int, distance: float = 10.0, scale: float = 1.0, smallest: float = 0.5, largest: float = 16.0) -> DataFrame:
    """p with px, py, radius (pixels) and depth for a camera on the z axis; bodies behind it or off the picture drop out."""
    depth = F.lit(distance) - F.col("z")
    rows = p.withColumn("depth", depth).filter("depth > 0")
    w = F.lit(scale) / F.col("depth")
    radius = F.least(F.sqrt(F.pow(F.col("h") * 0.5 * width * w, 2) + smallest * smallest), F.lit(largest))
    rows = rows.withColumns({"px": (F.col("x") * w + 1.0) * 0.5 * width, "py": (F.col("y") * w + 1.0) * 0.5 * height, "radius": radius})
    return rows.filter((F.col("px") - F.col("radius") <= width) & (F.col("px") + F.col("radius") >= 0) & (F.col("py") - F.col("radius") <= height) & (F.col("py") + F.col("radius") >= 0))


def splat(seen: DataFrame, width: int, height: int, value: str = "mass") -> DataFrame:
    """ix, iy, light: each body adds value times (1 - r2/radius2) to the pixels its disk covers."""
    span = {a: (F.greatest(F.floor(F.col(f"p{a}") - F.col("radius")), F.lit(0)).cast("long"), F.least(F.floor(F.col(f"p{a}") + F.col("radius")), F.lit(n - 1)).cast("long")) for a, n in (("x", width), ("y", height))}
    rows = seen.filter((span["x"][0] <= span["x"][1]) & (span["y"][0] <= span["y"][1]))
    rows = rows.withColumn("ix", F.explode(F.sequence(*span["x"]))).withColumn("iy", F.explode(F.sequence(*span["y"])))
    dx, dy = F.col("ix") + 0.5 - F.col("px"), F.col("iy") + 0.5 - F.col("py")
    near = 1.0 - (dx * dx + dy * dy) / (F.col("radius") * F.col("radius"))
    return rows.withColumn("_w", near).filter("_w > 0").groupBy("ix", "iy").agg(F.sum(F.col(value) * F.col("_w")).alias("light"))


def compose(layers: DataFrame) -> DataFrame:
    """pixel, r, alpha of layers (pixel, depth, r, a) laid over each other from front to back; alpha ends at 1. One row a layer and pixel: few for a pixel."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("depth", "r", "a"))),
        F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("alpha")),
        lambda acc, x: F.struct((acc["r"] + (1.0 - acc["alpha"]) * x["a"] * x["r"]).alias("r"), F.least(F.lit(1.0), acc["alpha"] + (1.0 - acc["alpha"]) * x["a"]).alias("alpha")),
    )
    return layers.groupBy("pixel").agg(fold.alias("_c")).select("pixel", F.col("_c.r").alias("r"), F.col("_c.alpha").alias("alpha"))


def blend(src: Column, dst: Column, alpha: Column, fsrc: str = "SRC_ALPHA", fdst: str = "ONE_MINUS_SRC_ALPHA") -> Column:
    factor = {"ONE": F.lit(1.0), "ZERO": F.lit(0.0), "SRC_ALPHA": alpha, "ONE_MINUS_SRC_ALPHA": 1.0 - alpha}
    return src * factor[fsrc] + dst * factor[fdst]


def camera_frames(path: DataFrame, frames: DataFrame) -> DataFrame:
    """frames (f double) with tx, ty, tz, rx, ry, rz between the frames of path (frame long); f is held inside the path."""
    cols = ("tx", "ty", "tz", "rx", "ry", "rz")
    w = Window.orderBy("frame")
    nxt = path.select("frame", *cols, *[F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"_{c}") for c in cols])
    ends = path.agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))
    f = F.least(F.greatest(F.col("f"), F.col("_lo").cast("double")), F.col("_hi").cast("double"))
    rows = frames.crossJoin(F.broadcast(ends)).withColumn("_f", f).withColumn("frame", F.floor("_f").cast("long")).join(F.broadcast(nxt), "frame")
    part = F.col("_f") - F.col("frame")
    return rows.select("f", *[(F.col(c) + part * (F.col(f"_{c}") - F.col(c))).alias(c) for c in cols])


def table_lookup(p: DataFrame, s: str, table: DataFrame, size: int) -> DataFrame:
    """p with c, the table's value (i, v) at s in 0..1, linear between entries and held at both ends."""
    at = F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(1.0)) * (size - 1)
    rows = p.withColumn("_at", at).withColumn("_i", F.floor("_at").cast("long"))
    low = table.select(F.col("i").alias("_i"), F.col("v").alias("_v0"))
    high = table.select((F.col("i") - 1).alias("_i"), F.col("v").alias("_v1"))
    rows = rows.join(F.broadcast(low), "_i").join(F.broadcast(high), "_i", "left")
    return rows.withColumn("c", F.col("_v0") + (F.col("_at") - F.col("_i")) * (F.coalesce("_v1", "_v0") - F.col("_v0"))).drop("_at", "_i", "_v0", "_v1")


def surface_lookup(p: DataFrame, s: str, t: str, table: DataFrame, width: int, height: int) -> DataFrame:
    """p with c, the table's value (i, j, v) at s and t in 0..1: bilinear between four entries; the last column and row are only neighbours."""
    at = {n: F.least(F.greatest(F.col(v), F.lit(0.0)), F.lit(1.0)) * (size - 2) for n, v, size in (("_s", s, width), ("_t", t, height))}
    rows = p.withColumns(at)
    rows = rows.withColumns({"_i": F.floor("_s").cast("long"), "_j": F.floor("_t").cast("long")})
    for a in (0, 1):
        for b in (0, 1):
            corner = table.select((F.col("i") - a).alias("_i"), (F.col("j") - b).alias("_j"), F.col("v").alias(f"_v{a}{b}"))
            rows = rows.join(F.broadcast(corner), ["_i", "_j"])
    x, y = F.col("_s") - F.col("_i"), F.col("_t") - F.col("_j")
    c = F.col("_v00") * (1 - x) * (1 - y) + F.col("_v10") * x * (1 - y) + F.col("_v01") * (1 - x) * y + F.col("_v11") * x * y
    return rows.withColumn("c", c).select(*p.columns, "c")


def add_layers(layers: DataFrame) -> DataFrame:
    """pixel, r, alpha: the plain sums of all layers of a pixel, alpha at most 1."""
    return layers.groupBy("pixel").agg(F.sum("r").alias("r"), F.least(F.sum("a"), F.lit(1.0)).alias("alpha"))


def map_colours(grid: DataFrame, palette: DataFrame, size: int = 256, rows: str = "rho", columns: str = "v2") -> DataFrame:
    """grid with r, g, b of the palette (i, j, r, g, b) at its two values, cut to whole numbers from 0 to size - 1."""
    index = {k: F.least(F.greatest(F.col(v).cast("int"), F.lit(0)), F.lit(size - 1)) for k, v in (("i", rows), ("j", columns))}
    return grid.withColumns(index).join(F.broadcast(palette), ["i", "j"]).drop("i", "j")


def star_mass(u: Column, slope: float = -2.35, low: float = STAR_MASSES[-1], high: float = STAR_MASSES[0]) -> Column:
    """Mass of a power law between low and high at the quantile u."""
    k = slope + 1.0
    return F.pow(u * (high**k - low**k) + low**k, F.lit(1.0 / k))


def star_class(mass: Column, first: int = 0, n: int = len(STAR_COLOURS)) -> Column:
    """Index of the spectral class between whose limits the mass lies, of n classes from the first; the last of them for smaller masses, the first for larger ones."""
    last = min(first + n, len(STAR_COLOURS)) - 1
    out = F.lit(last)
    for i in range(last - 1, first - 1, -1):
        out = F.when(mass >= STAR_MASSES[i + 1], i).otherwise(out)
    return out.cast("int")


def star_colour(cls: Column) -> tuple[Column, Column, Column]:
    return tuple(F.element_at(F.array(*[F.lit(c[k]) for c in STAR_COLOURS]), cls + 1).cast("int") for k in range(3))


def colour_kind(old: Column, bright: int = 100) -> Column:
    """Name of the colour of a body by the range of its old id."""
    disk = F.when(old % bright != 0, "star").when(F.floor(old / bright) % 2 == 1, "second").otherwise("third")
    glow = F.when(old % 4 == 0, "fourth").otherwise("third")
    return F.when(old < 40_000_000, disk).when(old < 50_000_000, glow).when(old < 70_000_000, "dust").when(old < 100_000_000, "third").when(old < 200_000_000, "bulge").otherwise("dark")


# Where the live picture's kinds of bodies begin among typed ids, and the mass functions of its stars (first class, classes, exponent of the
# number by mass: the slope of the mass function plus that of light to mass, less one).
KINDS = (("disk", 0), ("glow", 40_000_000), ("dust", 50_000_000), ("haze", 70_000_000), ("bulge", 2_000_000_000_000_000_000), ("dark", 3_000_000_000_000_000_000))
STARS = {"bulge": (10, 7, -1.35 + 4.0 - 1), "disk": (2, 15, -1.35 + 3.5 - 1), "glow": (0, 6, -1.35 + 1.0 - 1)}
GLOWING, DIM = 1024, 0.01
RGBA = ("red", "green", "blue", "alpha")


def live_colours(p: DataFrame, dust: tuple[float, ...], haze: tuple[float, ...], dark: tuple[float, ...], brightness: float = 1.0, glow_alpha: float = 1.0, gid: str = "gid") -> DataFrame:
    """p with kind, red, green, blue, alpha of the live picture. dust, haze and dark are colours of four numbers.

    Stars draw a mass by a hash of their id from the mass function of their kind and take the colour of its class: disk stars dimmed but one id in 1,024, which glows; glowing
    ones times brightness; bulge stars dimmed. Dust takes its colour times the hash."""
    g, u = F.col(gid), physics.uniform(F.col(gid))
    kind = F.lit(KINDS[0][0])
    for name, low in KINDS[1:]:
        kind = F.when(g >= low, name).otherwise(kind)
    rows = p.drop("kind", *RGBA).withColumns({"kind": kind, "_u": u})
    for name, (first, n, slope) in STARS.items():
        mass = star_mass(F.col("_u"), slope, STAR_MASSES[first + n - 1], STAR_MASSES[first])
        rows = rows.withColumn(f"_{name}", F.array(*star_colour(star_class(mass, first, n))).cast("array<double>"))
    shade = lambda c, k, a: F.array(*[F.col(c)[i] * k for i in range(3)], F.lit(float(a)))
    given = lambda c: F.array(*[F.lit(float(v)) for v in c])
    disk = F.when(g % GLOWING == 0, shade("_glow", 1.0, 1.0)).otherwise(shade("_disk", DIM, 1.0))
    dusty = F.array(*[F.lit(float(v)) * (F.col("_u") if i < 3 else 1.0) for i, v in enumerate(dust)])
    by = {"disk": disk, "glow": shade("_glow", brightness, glow_alpha), "dust": dusty, "haze": given(haze), "bulge": shade("_bulge", DIM, 2.0), "dark": given(dark)}
    colour = F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in by.items()])
    rows = rows.withColumn("_c", colour)
    return rows.withColumns({n: F.col("_c")[i] for i, n in enumerate(RGBA)}).drop("_u", "_c", *[f"_{n}" for n in STARS])


def grid_colour(grid: DataFrame, value: str, lo: float = 0.0, hi: float = 255.0, log: bool = False) -> DataFrame:
    """grid with c: value (or log(value + 1)) scaled over its own range to lo..hi and clamped."""
    v = F.log(F.col(value) + 1.0) if log else F.col(value)
    rows = grid.withColumn("_v", v)
    ends = rows.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn("c", physics.clamp(physics.rescale(F.col("_v"), F.col("_lo"), F.col("_hi"), lo, hi), lo, hi)).drop("_v", "_lo", "_hi")
