"""Filters that a source would otherwise apply on request."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv


def filter_price(df: DataFrame, low=fv.MIN_PRICE_DEFAULT, high=fv.MAX_PRICE_DEFAULT) -> DataFrame:
    """Inclusive price range; a missing price is outside it."""
    return df.where(F.col("price").between(low, high))


def parse_ring(text: str) -> list[tuple[float, float]]:
    return [tuple(float(v) for v in point.split()) for point in text.split(",")]


def filter_region(df: DataFrame, ring: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside a closed ring of ``lon lat`` points.

    An axis-aligned box becomes two range tests, which reach the scan; other
    rings first test the box, then count the edges a ray to the east crosses.
    """
    points = parse_ring(ring)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x, y = F.col(lon), F.col(lat)
    boxed = df.where(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)))
    corners = {(a, b) for a in (min(xs), max(xs)) for b in (min(ys), max(ys))}
    edges = list(zip(points, points[1:]))
    straight = all((a[0] == b[0]) != (a[1] == b[1]) for a, b in edges)
    if straight and set(points) == corners and len(edges) == 4:
        return boxed
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in edges:
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return boxed.where(crossings % 2 == 1)


def filter_type_codes(df: DataFrame, codes=tuple(fv.PROPERTY_TYPE_CODES), col="type_code") -> DataFrame:
    return df.where(F.col(col).isin(*codes))
