"""Column expressions that clean prices, addresses and housing texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside import fixed_values as fv

_SPACE = r"[\s\x1c-\x1f]"
_NUMBER = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
LONG_MAX = 2**63 - 1


def strip(c: Column) -> Column:
    """Trim every kind of white space, no-break spaces included."""
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def capture(c: Column, pattern: str) -> Column:
    """First group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def digits_to_long(c: Column) -> Column:
    """Digits as a long; more than a long can hold becomes the largest long,
    so that a later range test still sees a huge value rather than null."""
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("bigint"), F.lit(LONG_MAX)))


def clean_price(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^\d.]", ""), F.lit("")).try_cast("double")


def clean_price_k(c: Column) -> Column:
    """Whole-number price with the ``k`` suffix; 0 when there is no price."""
    text = strip(F.translate(F.lower(c), "$,", ""))
    thousands = F.contains(text, F.lit("k"))
    number = strip(F.replace(text, F.lit("k"), F.lit("")))
    value = F.when(F.regexp_like(number, F.lit(_NUMBER)), number.try_cast("double"))
    value = F.when(thousands, value * 1000).otherwise(value)
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def clean_address(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


def title_address(c: Column) -> Column:
    """Trim, then upper-case each letter that follows a non-letter."""
    pieces = F.regexp_extract_all(strip(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.coalesce(F.array_join(F.transform(pieces, F.initcap), ""), F.lit(""))


def bedrooms(c: Column) -> Column:
    return digits_to_long(capture(c, fv.BEDROOMS_PATTERN))


def bathrooms(c: Column) -> Column:
    return capture(c, fv.BATHROOMS_PATTERN).try_cast("double")


def sqft(c: Column) -> Column:
    return digits_to_long(capture(c, fv.SQFT_PATTERN))


def property_type(c: Column) -> Column:
    text = F.lower(c)
    return F.coalesce(
        *[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in fv.PROPERTY_TYPES_IN_ORDER]
    )


def housing_info(c: Column) -> Column:
    return F.struct(
        bedrooms(c).alias("bedrooms"),
        bathrooms(c).alias("bathrooms"),
        sqft(c).alias("sqft"),
        property_type(c).alias("property_type"),
    )


def housing_info_split(c: Column) -> Column:
    """Bedrooms and square feet from the parts between hyphens; of several
    parts with a usable number the last one counts."""
    parts = F.transform(F.split(F.lower(c), "-"), strip)

    def is_bedrooms(p):
        return F.contains(p, F.lit("br"))

    def is_sqft(p):
        return ~is_bedrooms(p) & (
            F.contains(p, F.lit("ft2")) | F.contains(p, F.lit("ft²")) | F.contains(p, F.lit("sqft"))
        )

    def last_number(wanted, *units):
        def number(p):
            for unit in units:
                p = F.replace(p, F.lit(unit), F.lit(""))
            p = strip(p)
            whole = F.regexp_like(p, F.lit(r"\A\+?\d+(?:_\d+)*\z"))
            return F.when(whole, digits_to_long(F.translate(p, "+_", "")))

        numbers = F.filter(F.transform(F.filter(parts, wanted), number), lambda n: n.isNotNull())
        return F.try_element_at(numbers, F.lit(-1))

    return F.struct(
        last_number(is_bedrooms, "br").alias("bedrooms"),
        last_number(is_sqft, "ft2", "ft²", "sqft").alias("sqft"),
    )


def strip_boilerplate(c: Column) -> Column:
    return strip(F.replace(c, F.lit(fv.BOILERPLATE), F.lit("")))
