"""Points in a table of regions: cells first, then the exact test.

Each ring is covered with cells of a grid whose width suits its size, at most
SPAN or so along each side; points are joined with regions on the cell they lie
in, and only those pairs are tested by ray casting. No point meets a region that
is not near it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along the longer side of a region, and bounds of the cell widths 2^-level.
SPAN = 16
LEVELS = (-9, 40)
#: Rings, of at most (SPAN + 1)^2 cells each, whose cells are broadcast.
BROADCAST_RINGS = 500


def _points(ring: str) -> Column:
    """A ring of ``lon lat`` points, comma-separated, as an array of (x, y)."""
    pair = F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(pair, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the east of (x, y) crosses an odd number of edges."""
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * ((e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))),
    )
    return F.size(crossed) % 2 == 1


def with_shape(regions: DataFrame, ring: str = "ring") -> DataFrame:
    """``regions`` with ``_shape``: edges, bounds, whether it is a box, level.
    Rings that cannot be read have no shape and are left out."""
    p = F.col("_p")
    read = regions.withColumn("_p", _points(ring)).where(F.size("_p") > 2).where(
        F.forall("_p", lambda q: q["x"].isNotNull() & q["y"].isNotNull())
    )
    ends = F.zip_with(
        F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    bounds = {f"{side}_{c}": f(F.transform(p, lambda q: q[c])) for c in "xy" for side, f in (("low", F.array_min), ("high", F.array_max))}
    read = read.withColumns({"_edges": ends, **{f"_{k}": v for k, v in bounds.items()}})
    width = F.greatest(F.col("_high_x") - F.col("_low_x"), F.col("_high_y") - F.col("_low_y"), F.lit(2.0 ** -LEVELS[1]))
    level = F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.floor(F.log2(SPAN / width)).cast("int")))
    corner = F.forall("_p", lambda q: q["x"].isin(F.col("_low_x"), F.col("_high_x")) & q["y"].isin(F.col("_low_y"), F.col("_high_y")))
    straight = F.forall("_edges", lambda e: (e["x1"] == e["x2"]) != (e["y1"] == e["y2"]))
    box = (F.size("_edges") == 4) & straight & corner & (F.size(F.array_distinct("_p")) == 4)
    shape = F.struct(
        F.col("_edges").alias("edges"), *[F.col(f"_{k}").alias(k) for k in bounds], box.alias("box"), level.alias("level")
    )
    return read.select(*regions.columns, shape.alias("_shape"))


def covering(shaped: DataFrame) -> DataFrame:
    """``shaped`` once for each cell (_level, _cx, _cy) that its ring may touch:
    an edge comes near it or its centre lies inside."""
    scale = F.pow(F.lit(2.0), F.col("_shape.level"))

    def along(c):
        return F.sequence(*[F.floor(F.col(f"_shape.{side}_{c}") * scale) for side in ("low", "high")])

    cells = shaped.select("*", F.col("_shape.level").alias("_level"), scale.alias("_scale"), F.explode(along("x")).alias("_cx"))
    cells = cells.select("*", F.explode(along("y")).alias("_cy"))
    low = {c: F.col(f"_c{c}") / F.col("_scale") for c in "xy"}
    high = {c: (F.col(f"_c{c}") + 1) / F.col("_scale") for c in "xy"}
    near = F.exists(
        "_shape.edges",
        lambda e: (F.least(e["x1"], e["x2"]) <= high["x"]) & (F.greatest(e["x1"], e["x2"]) >= low["x"])
        & (F.least(e["y1"], e["y2"]) <= high["y"]) & (F.greatest(e["y1"], e["y2"]) >= low["y"]),
    )
    centre = [(F.col(f"_c{c}") + 0.5) / F.col("_scale") for c in "xy"]
    return cells.where(near | _odd(F.col("_shape.edges"), *centre)).drop("_scale")


def _within(points: DataFrame, covered: DataFrame, levels: list[int], x: Column, y: Column) -> DataFrame:
    """Every row of ``points`` with every ring of ``covered`` it lies in."""
    scales = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(2.0**n).alias("scale")) for n in levels or [0]])
    placed = points.where(x.isNotNull() & y.isNotNull()).select("*", F.explode(scales).alias("_s")).select(
        *[F.col(f"`{c}`") for c in points.columns], F.col("_s.level").alias("_level"),
        F.floor(x * F.col("_s.scale")).alias("_cx"), F.floor(y * F.col("_s.scale")).alias("_cy"),
    )
    near = placed.join(covered, ["_level", "_cx", "_cy"])
    s = F.col("_shape")
    inside = x.between(s["low_x"], s["high_x"]) & y.between(s["low_y"], s["high_y"]) & (s["box"] | _odd(s["edges"], x, y))
    return near.where(inside).drop("_level", "_cx", "_cy", "_shape")


def join_regions(
    df: DataFrame, regions: DataFrame, lon: str = "lon", lat: str = "lat", ring: str = "ring",
    broadcast_rings: int = BROADCAST_RINGS,
) -> DataFrame:
    """Every row of ``df`` with every region it lies in, as ``filter_region``
    tells: a box with its border, other rings by ray casting. The columns of
    both, without the ring. Rows without coordinates lie in no region.

    A row goes to one cell of each level that regions have (LEVELS bounds their
    number). The cells of up to ``broadcast_rings`` rings are sent to the rows.
    More of them are shuffled, as the planner takes them for as small as the
    rings; rows at one place are then tested once and joined with the outcome.
    """
    shaped = with_shape(regions, ring)
    rings = {r[0]: r[1] for r in shaped.groupBy("_shape.level").count().collect()}
    x, y = F.col(f"`{lon}`").cast("double"), F.col(f"`{lat}`").cast("double")
    if sum(rings.values()) <= broadcast_rings:
        return _within(df, F.broadcast(covering(shaped)), sorted(rings), x, y).drop(ring)
    spots = df.select(x.alias("_x"), y.alias("_y")).distinct()
    found = _within(spots, covering(shaped).hint("merge"), sorted(rings), F.col("_x"), F.col("_y")).drop(ring)
    return df.join(found.hint("merge"), (x == F.col("_x")) & (y == F.col("_y"))).drop("_x", "_y")
