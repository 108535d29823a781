"""Column expressions that turn one home of a JSON payload into a raw listing."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside import fixed_values as fv


def strip_json_prefix(body: Column) -> Column:
    """Drop the shortest opening text that ends in ``&&`` on the first line."""
    return F.regexp_replace(body, r"(?d)\A.*?&&", "")


def number_text(raw: Column) -> Column:
    """The plain spelling of a JSON number, without an exponent."""
    plain = F.call_function("format_number", raw.try_cast("double"), F.lit("0.0###############"))
    exponent = F.contains(raw, F.lit("E")) & F.regexp_like(raw, F.lit(r"\A-?[\d.]+E"))
    return F.when(exponent, plain).otherwise(raw)


def grouped(raw: Column) -> Column:
    """A JSON number with thousands separators, decimals as spelled."""
    text = number_text(raw)
    whole = F.format_number(F.split_part(text, F.lit("."), F.lit(1)).try_cast("decimal(38,0)"), 0)
    decimals = F.regexp_extract(text, r"(\.\d+)", 1)
    return F.concat(whole, decimals)


def kind_of(tree: Column, path: str) -> Column:
    """Type of a part of a home given as a variant: STRING, BIGINT, ARRAY<...>;
    null where the part is missing."""
    return F.schema_of_variant(F.try_variant_get(tree, path, "variant"))


def _starts(kind: Column, *names: str) -> Column:
    return reduce(Column.__or__, [F.startswith(kind, F.lit(n)) for n in names])


def is_number(kind: Column) -> Column:
    return F.coalesce(_starts(kind, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False))


def truthy(raw: Column, kind: Column) -> Column:
    """Whether a part says anything: no zero, no false, no empty text, list or
    object. The text "0" does; ``kind`` tells it from the number."""
    text = F.coalesce(raw, F.lit(""))
    empty = (
        F.when(is_number(kind), F.coalesce(raw.try_cast("double") == 0, F.lit(False)))
        .when(F.startswith(kind, F.lit("BOOLEAN")), text == "false")
        .when(_starts(kind, "ARRAY", "OBJECT"), F.translate(text, " ", "").isin("[]", "{}"))
        .otherwise(text == "")
    )
    return raw.isNotNull() & kind.isNotNull() & (kind != "VOID") & ~empty


def money(raw: Column, kind: Column) -> Column:
    """``$`` and the grouped number; null for zero and for nothing."""
    return F.when(truthy(raw, kind), F.concat(F.lit("$"), grouped(raw)))


def payload_type(raw: Column, kind: Column) -> Column:
    """Name of a type code, which is a number; other values as spelled."""
    code = F.when(is_number(kind), raw.try_cast("double"))
    name = F.coalesce(
        *[F.when(code == k, F.lit(v)) for k, v in fv.PAYLOAD_TYPE_NAMES.items()]
    )
    return F.coalesce(name, F.when(truthy(raw, kind), number_text(raw)))


def payload_url(path: Column) -> Column:
    return F.when(F.length(path) > 0, F.concat(F.lit(fv.PAYLOAD_HOST), path)).otherwise("")


def payload_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    line = F.concat(street, F.lit(", "), city, F.lit(", "), state, F.lit(" "), zip_code)
    return F.btrim(line, F.lit(", "))


def spelled(value: Column, kind: Column, default) -> Column:
    """A part as text: a null is spelled ``None``, a missing part takes the
    default. ``kind`` tells the two apart."""
    if default is not None:
        value = F.coalesce(value, default if isinstance(default, Column) else F.lit(default))
    return F.when(kind == "VOID", "None").otherwise(value)


def misshapen(value: Column, tree: Column, name: str) -> Column:
    """The part is there but is not an object."""
    return value.isNull() & F.try_variant_get(tree, f"$.{name}", "variant").isNotNull()


def not_a_number(value: Column, kind: Column) -> Column:
    """The part's value says something and is no number, so that it cannot be
    written with separators. An empty text, list or object is just missing."""
    return F.coalesce(truthy(value, kind) & ~is_number(kind) & (kind != "BOOLEAN"), F.lit(False))
