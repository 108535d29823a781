"""One packing of positions into a long, for every kind of raw listing.

A raw listing's ordinal sorts like (location, place within the location). The
location takes the top LOCATION_BITS of ORDINAL_BITS, the parts of the place
share the rest. A part that does not fit is an error, never a wrong order.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDINAL_BITS = 62
LOCATION_BITS = 6
PLACE_BITS = ORDINAL_BITS - LOCATION_BITS


def packed(*parts: tuple) -> Column:
    """Long of (column or name, bits) parts, the first one highest."""
    if sum(bits for _, bits in parts) > ORDINAL_BITS:
        raise ValueError("the parts do not fit into a long")
    whole, fits = F.lit(0).cast("bigint"), F.lit(True)
    for part, bits in parts:
        part = (F.col(part) if isinstance(part, str) else part).cast("bigint")
        whole = whole * (1 << bits) + part
        fits = fits & F.coalesce(part.between(0, (1 << bits) - 1), F.lit(False))
    return F.when(fits, whole).otherwise(F.raise_error(F.lit("position out of range")).cast("bigint"))


def page_ordinal(location="location_idx", keyword="keyword_idx", offset="offset", fetch=None, position="position"):
    """Position of a search result: location, keyword, offset, number of the
    fetch among those of the same page, place on the page."""
    fetch = F.lit(0) if fetch is None else fetch
    return packed((location, LOCATION_BITS), (keyword, 8), (offset, 24), (fetch, 12), (position, 12))


def payload_ordinal(location="location_idx", number="payload_no", position="pos"):
    """Position of a home: location, number of the payload, place in it."""
    return packed((location, LOCATION_BITS), (number, 36), (position, 20))


def in_part(number: int, ordinal: str = "ordinal") -> Column:
    """Ordinal of a row in the part ``number`` of several put one after
    another; the parts' own ordinals must leave the location at 0."""
    return packed((F.lit(number), LOCATION_BITS), (ordinal, PLACE_BITS))


def check_unique(df, ordinal: str = "ordinal"):
    """``df``, or an error when two rows share an ordinal."""
    twice = df.groupBy(ordinal).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    first = twice.limit(1).collect()
    if first:
        raise ValueError(f"ordinal {first[0][0]} stands for {first[0][1]} rows; it has to be unique")
    return df
