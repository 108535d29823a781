"""Column expressions over links and location keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside import fixed_values as fv


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    resolved = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.array_append(done, s)),
    )
    return F.concat(F.lit("/"), F.array_join(F.concat(resolved, tail), "/"))


def absolute_url(url: Column, base: Column) -> Column:
    """Resolve a link against a base of the form ``scheme://host``."""
    relative = F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    path = F.regexp_extract(relative, r"(?s)\A([^?#]*)", 1)
    rest = F.regexp_extract(relative, r"(?s)\A[^?#]*(.*)", 1)
    path = F.when(F.contains(path, F.lit("/.")), _without_dot_segments(path)).otherwise(path)
    return (
        F.when(url.isNull() | (url == "") | url.startswith("http"), url)
        .when(F.regexp_like(url, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"\A([^/]*)", 1), url))
        .when(url.startswith("?") | url.startswith("#"), F.concat(base, url))
        .otherwise(F.concat(base, path, rest))
    )


def absolute_post_url(url: Column) -> Column:
    return F.when(url.startswith("/"), F.concat(F.lit(fv.POST_HOST), url)).otherwise(url)


def location_key(key: Column, state: Column) -> Column:
    return F.concat_ws("_", key, F.lower(state))
