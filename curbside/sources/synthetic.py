"""Repeatable synthetic listings for fixtures and load tests.

Every value is arithmetic on an md5 of location, index and column name, so any
partition can produce its rows alone and a rerun produces the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside.functions.order import LOCATION_BITS, PLACE_BITS, packed
from curbside.functions import urls
from curbside.session import once
from curbside.sources.locations import join_location


def draw(name: str) -> Column:
    """A number below 2**32 for this row and column name."""
    digest = F.md5(F.concat(F.col("_key"), F.lit("-" + name)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def between(name: str, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return low + draw(name) % (high - low + 1)


def choice(name: str, values: Column) -> Column:
    return F.element_at(values, (draw(name) % F.size(values) + 1).cast("int"))


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by_type(i: int) -> Column:
    return F.coalesce(*[F.when(F.col("property_type") == t[0], F.lit(t[i])) for t in fv.SYNTH_TYPES])


def _title(template: str) -> Column:
    filled = F.lit(template)
    for mark, value in (
        ("{bd}", F.col("_beds")), ("{ba}", F.col("_baths").cast("int")),
        ("{ty}", F.initcap("property_type")), ("{nb}", F.col("_hood")), ("{sf}", F.col("_sqft")),
    ):
        filled = F.replace(filled, F.lit(mark), value.cast("string"))
    return filled


def synth_from(
    indexes: DataFrame, as_of: str, min_price=fv.MIN_PRICE_DEFAULT, max_price=fv.MAX_PRICE_DEFAULT
) -> DataFrame:
    """A listing for each ``idx`` and location. Types whose price range is
    empty after clamping give no row."""
    keys = _literals([location[0] for location in fv.LOCATIONS])
    keyed = join_location(
        indexes.select(F.col("idx").cast("bigint"), F.explode(keys).alias("location_key"))
    )
    keyed = once(keyed, _key=F.md5(F.concat_ws("-", "location_key", F.col("idx"))))
    roll, reached, kind = draw("type") % 100, 0, None
    for name, weight, *_ in fv.SYNTH_TYPES:
        reached += weight
        kind = F.when(roll < reached, name) if kind is None else kind.when(roll < reached, name)
    typed = once(keyed, property_type=kind)
    ranged = once(
        typed,
        _low=F.greatest(_by_type(2), F.lit(min_price)).cast("bigint"),
        _high=F.least(_by_type(3), F.lit(max_price)).cast("bigint"),
        _beds=between("bedrooms", _by_type(4), _by_type(5)),
        _baths=choice("bathrooms", _literals(fv.SYNTH_BATHROOMS)),
        _hood=choice("neighborhood", F.col("neighborhoods")),
    ).where("_low <= _high")
    base = F.coalesce(*[F.when(F.col("_beds") == b, F.lit(s)) for b, s in fv.SYNTH_BASE_SQFT.items()])
    sized = once(
        ranged,
        _price=(F.bround(between("price", F.col("_low"), F.col("_high")) / 1000) * 1000).cast("bigint"),
        _sqft=base + between("sqft", *fv.SYNTH_SQFT_SPREAD),
        _template=(draw("title") % len(fv.SYNTH_TITLES)).cast("int"),
    )
    title = F.coalesce(
        *[F.when(F.col("_template") == i, _title(t)) for i, t in enumerate(fv.SYNTH_TITLES)]
    )
    shuffled = F.transform(
        F.array_sort(
            F.transform(
                _literals(fv.SYNTH_FEATURES),
                lambda f, i: F.struct(
                    F.md5(F.concat(F.col("_key"), F.lit("-feature-"), i.cast("string"))).alias("at"),
                    f.alias("name"),
                ),
            )
        ),
        lambda s: s["name"],
    )
    count = between("features", *fv.SYNTH_FEATURE_COUNT).cast("int")
    picked = once(sized, title=title, _features=F.slice(shuffled, 1, count))
    lit, col = F.lit, F.col
    dollars = F.concat(lit("$"), F.format_number("_price", 0))
    baths_text = F.regexp_replace(col("_baths").cast("string"), r"\.0$", "")
    posted = F.lit(as_of).cast("timestamp") - F.make_dt_interval(
        between("days", 0, fv.SYNTH_MAX_DAYS_AGO).cast("int")
    )
    return picked.select(
        packed(("location_idx", LOCATION_BITS), ("idx", PLACE_BITS)).alias("ordinal"),
        col("title"),
        dollars.alias("raw_price"),
        F.concat(
            between("number", *fv.SYNTH_STREET_NUMBERS).cast("string"), lit(" "),
            choice("street", col("streets")), lit(", "), col("_hood"), lit(", "), col("dim_city"),
            lit(", "), F.upper("dim_state"), lit(" "), choice("zip", col("zip_codes")),
        ).alias("raw_address"),
        F.concat(col("_beds"), lit("br - "), col("_sqft"), lit("ft² - "), col("property_type")).alias(
            "raw_housing_info"
        ),
        F.concat(
            lit("Beautiful "), col("_beds"), lit(" bedroom, "), baths_text, lit(" bath "),
            col("property_type"), lit(" in the heart of "), col("_hood"), lit(". This "), col("_sqft"),
            lit(" sq ft property features "),
            F.array_join(F.slice("_features", 1, F.size("_features") - 1), ", "), lit(", and "),
            F.element_at("_features", -1), lit(". Priced to sell at "), dollars,
            lit(". Don't miss this opportunity!"),
        ).alias("description"),
        F.date_format(posted, "yyyy-MM-dd'T'HH:mm:ss").alias("posted_date"),
        F.concat(
            col("base_url"), lit("/rea/d/"),
            F.substring(F.replace(F.lower("title"), lit(" "), lit("-")), 1, 30), lit("/"),
            between("post", *fv.SYNTH_POST_IDS).cast("string"), lit(".html"),
        ).alias("url"),
        urls.location_key(col("location_key"), col("dim_state")).alias("location"),
        lit(fv.SYNTH_SOURCE).alias("source"),
        col("property_type"),
    )


def synth_listings(spark: SparkSession, n: int, as_of: str, **prices) -> DataFrame:
    """``n`` listings per location."""
    return synth_from(spark.range(n).withColumnRenamed("id", "idx"), as_of, **prices)
