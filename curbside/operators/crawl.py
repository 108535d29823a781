"""Order, limits and joins over rows of stored search and detail pages."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside.functions.order import in_part
from curbside.operators.dedup import first_per
from curbside.session import cut_lineage


def truncate_short_pages(pages: DataFrame, size: int = fv.RESULTS_PER_PAGE) -> DataFrame:
    """Search pages up to the one where paging ends: the first with fewer than
    ``size`` results, an empty or a missing one. Landing pages always stay.

    ``pages`` has one row per fetch of a page with ``results``. Of several
    fetches of one page the fullest counts: a page is short when every fetch of
    it was. The end of each sequence is an aggregate, so no sequence has to fit
    into one task.
    """
    keys = ["location", "keyword_idx"]
    fetched = pages.where("kind = 'search'")
    search = fetched.groupBy(*keys, "offset").agg(F.max(F.coalesce("results", F.lit(0))).alias("results"))
    nexts = search.select(*keys, (F.col("offset") - size).alias("offset")).distinct()
    broken = search.join(nexts, [*keys, "offset"], "left_anti").select(*keys, "offset")
    short = search.where(F.col("results") < size).select(*keys, "offset")
    ends = broken.unionByName(short).groupBy(*keys).agg(F.min("offset").alias("_end"))
    starts = search.where(F.col("offset") == 0).select(*keys).distinct()
    kept = fetched.join(ends.join(starts, keys, "left_semi"), keys).where("offset <= _end").drop("_end")
    return pages.where("kind = 'landing'").unionByName(kept.select(*pages.columns))


def page_yield(rows: DataFrame) -> DataFrame:
    """Results and new results per page; a result is new where its url appears
    for the first time in its location. The rows are used twice and stored."""
    rows = cut_lineage(rows.select("location", "url", "keyword_idx", "offset", "ordinal"))
    first = rows.groupBy("location", "url").agg(F.min("ordinal").alias("_first"))
    marked = rows.join(first, ["location", "url"])
    return marked.groupBy("location", "keyword_idx", "offset").agg(
        F.count("*").alias("results"),
        F.count_if(F.col("ordinal") == F.col("_first")).alias("new_results"),
    )


def cap_per_location(df: DataFrame, n: int | None = fv.LISTINGS_PER_LOCATION, order=("ordinal",)) -> DataFrame:
    """First ``n`` rows of each location; all of them for None.

    There are few locations, so the limit is taken in two steps: first within
    parts of a location, by a hash of the order, then among what is left.
    """
    if n is None:
        return df
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(256)))
    some = first_per(dealt, ["location", "_part"], list(order), n).drop("_part")
    return first_per(some, ["location"], list(order), n)


def cap_posts(df: DataFrame, n: int = fv.POSTS_PER_SESSION, order=("ordinal",)) -> DataFrame:
    """First ``n`` rows of all."""
    return df.orderBy(*order).limit(n)


def sample_exact(df: DataFrame, key: str, n: int, seed: str, limit: int | None = None) -> DataFrame:
    """``n`` rows without replacement (0 means ``limit``, which also bounds
    it), the same ones for the same seed; 0 without a limit gives no rows."""
    n = n or limit or 0
    n = n if limit is None else min(n, limit)
    at = F.md5(F.concat(F.col(key).cast("string"), F.lit("-" + seed)))
    return df.orderBy(at, F.col(key)).limit(n)


def join_details(search: DataFrame, detail: DataFrame) -> DataFrame:
    """Search rows with what their detail page adds. The search row's own
    columns win, null or not; a row without a detail page stays."""
    added = [c for c in detail.columns if c == "url" or c not in search.columns]
    return search.join(detail.select(*added), "url", "left").select(
        *search.columns, *[c for c in added if c != "url"]
    )


def latest_detail(pages: DataFrame) -> DataFrame:
    """(url, page_id) of one stored detail page per url: the last fetched. No
    other column is read, so the pages themselves are not moved."""
    details = pages.where("kind = 'detail'").select("url", "fetched_at", "page_id")
    return first_per(details, ["url"], [F.desc("fetched_at"), F.desc("page_id")]).select("url", "page_id")


def union_locations(parts: list[DataFrame]) -> DataFrame:
    """Append in the order given; ``ordinal`` keeps the parts apart."""
    placed = [p.withColumn("ordinal", in_part(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def union_keywords(landing: DataFrame, searches: list[DataFrame]) -> DataFrame:
    """The landing page's rows, then the rows of each keyword in turn."""
    numbered = [landing, *searches]
    placed = [p.withColumn("keyword_idx", F.lit(i)) for i, p in enumerate(numbered)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
