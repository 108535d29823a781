"""Raw listings to validated listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside import schema
from curbside.functions import text as text_fn


def _text(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def to_listing(raw: DataFrame, prefer_raw_type: bool = False) -> DataFrame:
    """The twelve listing columns (and ``ordinal``, where there is one).

    A null source or location counts as missing and takes its default. The
    property type comes from the housing text; ``prefer_raw_type`` takes the
    source's own type where it has one.
    """
    housing = text_fn.housing_info(_text(raw, "raw_housing_info"))
    kind = F.col("_h.property_type")
    if prefer_raw_type:
        kind = F.coalesce(_text(raw, "property_type"), kind)
    keep = ["ordinal"] if "ordinal" in raw.columns else []
    return raw.withColumn("_h", housing).select(
        *keep,
        F.coalesce(F.nullif(_text(raw, "title"), F.lit("")), F.lit(fv.DEFAULT_TITLE)).alias("title"),
        text_fn.clean_price(_text(raw, "raw_price")).alias("price"),
        text_fn.clean_address(_text(raw, "raw_address")).alias("address"),
        F.col("_h.bedrooms").alias("bedrooms"),
        F.col("_h.bathrooms").alias("bathrooms"),
        F.col("_h.sqft").alias("sqft"),
        F.coalesce(_text(raw, "url"), F.lit("")).alias("url"),
        _text(raw, "description").alias("description"),
        _text(raw, "posted_date").alias("posted_date"),
        F.coalesce(_text(raw, "source"), F.lit(fv.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(_text(raw, "location"), F.lit(fv.DEFAULT_LOCATION)).alias("location"),
        kind.alias("property_type"),
    )


_VALID = (
    f"(price is null or (price > 0 and price <= {fv.MAX_PRICE})) and "
    f"(bedrooms is null or bedrooms between 0 and {fv.MAX_BEDROOMS}) and "
    "(sqft is null or sqft >= 0)"
)


def validate(listings: DataFrame) -> DataFrame:
    """Valid rows. A size beyond every long passes, as sizes have no upper
    bound, but its stand-in does not: it becomes null."""
    return listings.where(_VALID).withColumn("sqft", F.nullif("sqft", F.lit(text_fn.LONG_MAX)))


def validate_strict(listings: DataFrame) -> DataFrame:
    (low, high), (small, large) = fv.STRICT_PRICE, fv.STRICT_SQFT
    return listings.where(
        f"price between {low} and {high} and (sqft is null or sqft between {small} and {large})"
    )


_MODEL = "title is not null and url is not null and location is not null and source is not null"


def model_check(listings: DataFrame) -> DataFrame:
    return listings.where(_MODEL)


def listing_rejects(listings: DataFrame) -> DataFrame:
    """Rows that ``validate`` or ``model_check`` leave out: stage, key, reason."""
    reason = (
        F.when(~F.expr(_MODEL), "missing field")
        .when(F.expr(f"not (price is null or (price > 0 and price <= {fv.MAX_PRICE}))"), "price")
        .when(F.expr(f"not (bedrooms is null or bedrooms between 0 and {fv.MAX_BEDROOMS})"), "bedrooms")
        .when(F.expr("sqft < 0"), "sqft")
    )
    return listings.select(
        F.lit("clean").alias("stage"), F.col("url").alias("key"), reason.alias("reason")
    ).where("reason is not null")


def as_listing_schema(listings: DataFrame) -> DataFrame:
    """Exactly the listing columns in export order."""
    return listings.select(*[F.col(f.name).cast(f.dataType) for f in schema.LISTING])
