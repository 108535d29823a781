"""Stored JSON payloads to raw listings. Native expressions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside import schema
from curbside.functions import payload as fn
from curbside.functions import urls
from curbside.session import compile_methods, once


def payload_homes(payloads: DataFrame) -> DataFrame:
    """One row per home with its position ``pos`` in the payload's array.
    Unreadable bodies and null payloads have no homes."""
    parsed = F.from_json(fn.strip_json_prefix(F.col("body")), schema.PAYLOAD)
    homes = once(payloads, _homes=parsed["payload"]["homes"])
    kept = [c for c in payloads.columns if c != "body"]
    return homes.select(*kept, F.posexplode("_homes").alias("pos", "home"))


def cap_payload(homes: DataFrame, n: int | None = fv.LISTINGS_PER_LOCATION) -> DataFrame:
    """First ``n`` homes of each payload, counted before any is found unusable;
    all of them for None."""
    return homes if n is None else homes.where(F.col("pos") < n)


#: Parts whose kind matters: as a whole, or that of their value.
KINDS = [*schema.SUB_OBJECTS, "city", "state", "zip", "listingId", "mlsStatus", "propertyType", "beds", "baths"]


def _parsed(homes: DataFrame) -> DataFrame:
    """Each home read once as a struct ``_p`` and once as a variant, and from it
    the kind ``_k_<name>`` of each part.

    Plain columns, one step after the other: the optimizer leaves a costly one
    alone that the next step uses several times. Only the flag is kept apart by
    ``once``, as the filter on it would read the home again.
    """
    compile_methods(homes.sparkSession)
    tree = F.col("_v")
    paths = {name: f"$.{name}.value" if name in schema.SUB_OBJECTS else f"$.{name}" for name in KINDS}
    shapeless = [fn.misshapen(F.col(f"_p.{name}"), tree, name) for name in schema.SUB_OBJECTS]
    known = homes.withColumns({"_p": F.from_json("home", schema.PAYLOAD_HOME), "_v": F.try_parse_json("home")}).withColumns({
        **{f"_k_{name}": fn.kind_of(tree, path) for name, path in paths.items()},
        "_shapeless": reduce(Column.__or__, shapeless),
    }).drop("_v")
    broken = [fn.not_a_number(F.col(f"_p.{name}.value"), F.col(f"_k_{name}")) for name in ("price", "sqFt", "lotSize")]
    known = known.withColumn("_unfit", reduce(Column.__or__, broken, F.col("_shapeless")))
    return once(known, _broken=F.col("_unfit"))


def payload_rejects(homes: DataFrame) -> DataFrame:
    """Homes that cannot be normalised: stage, key, reason."""
    return _parsed(homes).where("_broken").select(
        F.lit("payload").alias("stage"), F.col("home").alias("key"),
        F.lit("null or misshapen part").alias("reason"),
    )


def normalize_home(homes: DataFrame, payload_baths: bool = False) -> DataFrame:
    """Raw listings of homes already joined to the location dimension
    (``location_key``, ``dim_city``, ``dim_state``)."""

    def f(name):
        return F.col(f"_p.{name}.value" if name in schema.SUB_OBJECTS else f"_p.{name}")

    def kind(name):
        return F.col(f"_k_{name}")

    def text(name, default=None):
        return fn.spelled(f(name), kind(name), default)

    def nonzero(name):
        return F.when(fn.truthy(f(name), kind(name)), fn.number_text(f(name)))

    # Each part once; the texts below use them several times.
    lit, col = F.lit, F.col
    parts = _parsed(homes).where("not _broken").withColumns({
        "_beds": fn.number_text(text("beds")),
        "_baths": fn.number_text(text("baths")),
        "_street": text("streetLine", ""),
        "_city": text("city", F.col("dim_city")),
        "_state": text("state", F.upper("dim_state")),
        "_type": fn.payload_type(f("propertyType"), kind("propertyType")),
        "_mls": text("mlsId", ""),
        "_status": text("mlsStatus", ""),
        "_size": nonzero("sqFt"),
        "_year": nonzero("yearBuilt"),
        "_lot": nonzero("lotSize"),
        "_fee": nonzero("hoa"),
        "_days": nonzero("dom"),
    })

    def part(name, default):
        return F.coalesce(name, lit(default))

    def clause(*pieces):
        return F.coalesce(F.concat(*pieces), lit(""))

    baths = [lit(" / "), part("_baths", ""), lit("ba")] if payload_baths else []
    description = F.concat(
        part("_beds", "?"), lit(" bed, "), part("_baths", "?"), lit(" bath "),
        part("_type", "property"), lit(" at "), col("_street"), lit(", "), col("_city"), lit(", "),
        col("_state"), lit(". "),
        clause(fn.grouped(col("_size")), lit(" sqft. ")),
        clause(lit("Built "), col("_year"), lit(". ")),
        clause(lit("Lot: "), fn.grouped(col("_lot")), lit(" sqft. ")),
        clause(lit("HOA: $"), col("_fee"), lit("/mo. ")),
        clause(col("_days"), lit(" days on market. ")),
        lit("MLS# "), col("_mls"), lit(". Status: "), col("_status"), lit("."),
    )
    keep = ["ordinal"] if "ordinal" in homes.columns else []
    return parts.select(
        *keep,
        F.concat(
            part("_beds", "?"), lit("BR/"), part("_baths", "?"), lit("BA "),
            part("_type", "Property"), lit(" in "), col("_city"),
        ).alias("title"),
        fn.money(f("price"), kind("price")).alias("raw_price"),
        fn.payload_address(col("_street"), col("_city"), col("_state"), text("zip", "")).alias(
            "raw_address"
        ),
        F.concat(
            part("_beds", ""), lit("br"), *baths, lit(" - "), part("_size", ""), lit("ft2 - "),
            part("_type", ""),
        ).alias("raw_housing_info"),
        description.alias("description"),
        lit(None).cast("string").alias("posted_date"),
        fn.payload_url(f("url")).alias("url"),
        urls.location_key(col("location_key"), col("dim_state")).alias("location"),
        lit(fv.DEFAULT_SOURCE).alias("source"),
        col("_type").alias("property_type"),
        F.nullif(col("_mls"), lit("None")).alias("mls_id"),
        F.when(fn.truthy(f("listingId"), kind("listingId")), f("listingId")).alias("listing_id"),
        f("yearBuilt").try_cast("bigint").alias("year_built"),
        f("lotSize").try_cast("double").alias("lot_size"),
        f("hoa").try_cast("double").alias("hoa"),
        f("dom").try_cast("bigint").alias("days_on_market"),
        F.nullif(col("_status"), lit("None")).alias("mls_status"),
    )
