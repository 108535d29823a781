"""The three whole jobs: stored pages, stored payloads, stored snapshots.

Each job gives its rows and, from the same pass, what it had to leave out:
``*_job`` returns both, the function without that ending the rows alone.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside.functions import urls
from curbside.functions.markup import html_rows
from curbside.functions.order import page_ordinal, payload_ordinal
from curbside.operators import clean, crawl, dedup, html, metrics, payload, similar
from curbside.session import cut_lineage, ship_package
from curbside.sources.locations import join_location, unknown_locations

#: Detail pages are fetched by a broadcast of up to so many page ids (16 bytes
#: each); for more of them every detail page is read first and its short record
#: joined, so that no page travels either way.
BROADCAST_PAGES = 500_000


class Job(NamedTuple):
    rows: DataFrame
    rejects: DataFrame  # stage, key, reason


def _cleaned(raw: DataFrame, mode: str, funnel: metrics.Funnel | None) -> tuple[DataFrame, DataFrame]:
    """The valid listings, and the cleaned ones, stored, that they come from."""

    def watch(df, stage):
        return funnel.watch(df, stage) if funnel else df

    unique = cut_lineage(watch(dedup.dedup_url(watch(raw, "raw")), "url_unique"))
    distinct = watch(similar.dedup_similar(unique, mode), "similar_unique")
    cleaned = cut_lineage(clean.to_listing(distinct))
    return watch(clean.model_check(clean.validate(cleaned)), "valid"), cleaned


def clean_job(raw: DataFrame, mode: str = "fuzzy", funnel: metrics.Funnel | None = None) -> Job:
    """Duplicates out, cleaned, validated: raw listings with ``ordinal`` to
    listings. The url-unique rows are stored once, as they are read twice, and
    so are the cleaned ones, which give the rows and the rejects."""
    valid, cleaned = _cleaned(raw, mode, funnel)
    rejects = clean.listing_rejects(cleaned)
    return Job(valid, funnel.watch(rejects, "rejected") if funnel else rejects)


def clean_all(raw: DataFrame, mode: str = "fuzzy", funnel: metrics.Funnel | None = None) -> DataFrame:
    """The rows of ``clean_job`` alone; the funnel has no rejects then."""
    return _cleaned(raw, mode, funnel)[0]


# --- pages ------------------------------------------------------------------

_SLOT = ["location_key", "keyword_idx", "offset"]


def search_job(pages: DataFrame, profile=html.SEARCH) -> Job:
    """Rows of the landing and search pages that paging would have reached;
    the pages that could not be read, and the locations that are not known.

    The HTML is read once; what is stored in between is the extracted rows. A
    page may be stored several times: its fetches are numbered by time and page
    id, and their rows follow each other in that order. A page that cannot be
    read does not end its keyword, as nothing is known of its results.
    """
    ship_package(pages.sparkSession)
    searched = pages.where("kind in ('landing', 'search')").withColumnRenamed("location", "location_key")
    listed = join_location(searched).select(
        *_SLOT, "location_idx", "base_url", "kind", "source", "fetched_at", "page_id",
        urls.location_key(F.col("location_key"), F.col("dim_state")).alias("location"),
        html_rows(F.col("html"), profile).alias("_page"),
    )
    usable = F.filter("_page.rows", lambda r: r["url"].isNotNull() & (r["url"] != ""))
    found = listed.withColumn("rows", usable).withColumn(
        "results", F.when(F.col("_page.error").isNull(), F.size("rows")).otherwise(fv.RESULTS_PER_PAGE)
    )
    read = cut_lineage(found.withColumn("error", F.col("_page.error")).drop("_page"))
    rejects = read.where("error is not null").select(
        F.lit("html").alias("stage"), F.col("page_id").cast("string").alias("key"), F.col("error").alias("reason")
    ).unionByName(unknown_locations(searched))
    fetch = [*_SLOT, "fetched_at", "page_id"]
    number = F.expr("row_number() over (partition by location_key, keyword_idx, `offset` order by fetched_at, page_id) - 1")
    fetches = cut_lineage(read.select(*fetch).distinct().withColumn("fetch_no", number))
    reached = crawl.truncate_short_pages(read.drop("error").dropDuplicates(fetch))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in fetch]
    numbered = reached.alias("p").join(fetches.alias("f"), same).select("p.*", "f.fetch_no")
    rows = numbered.select("*", F.posexplode("rows").alias("position", "_r")).drop("rows")
    return Job(rows.select(
        page_ordinal(fetch="fetch_no").alias("ordinal"), "location", "keyword_idx", "offset", "position", "source",
        urls.absolute_url(F.col("_r.url"), F.col("base_url")).alias("url"),
        F.col("_r.title").alias("title"), F.col("_r.raw_price").alias("raw_price"),
    ), rejects)


def search_results(pages: DataFrame, profile=html.SEARCH) -> DataFrame:
    return search_job(pages, profile).rows


def _detail_records(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Details of the pages ``wanted`` (url, page_id), and the unreadable ones.
    No page is shuffled: either the ids of the wanted ones go to the pages, or
    the records read from the pages go on without them."""
    stored = pages.where("kind = 'detail'").select("url", "page_id", "html")
    few = wanted.count() <= BROADCAST_PAGES
    if few:
        names = wanted.select(F.col("url").alias("_url"), F.col("page_id").alias("_id"))
        ids = F.broadcast(names.select(F.xxhash64("_url", "_id").alias("_hash")).distinct())
        stored = stored.join(ids, F.xxhash64("url", "page_id") == F.col("_hash"), "left_semi")
    parsed = cut_lineage(html.parse_pages(stored, html.DETAIL))
    parsed = parsed.join(wanted, ["url", "page_id"], "left_semi")
    return html.detail_records(html.page_rows(parsed)).drop("page_id"), html.page_rejects(parsed)


def raw_pages_job(pages: DataFrame, max_listings: int | None = None) -> Job:
    """Raw listings: the first of each url in its location, capped per location
    where a cap is given, with details. Only the detail pages of the rows that
    are left are used."""
    found = search_job(pages)
    first = dedup.dedup_in_location(found.rows, order=("ordinal",))
    first = cut_lineage(crawl.cap_per_location(first, max_listings).drop("keyword_idx", "offset", "position"))
    latest = crawl.latest_detail(pages).join(first.select("url").distinct(), "url", "left_semi")
    details, unread = _detail_records(pages, cut_lineage(latest))
    rows = crawl.join_details(first, details.drop("title", "raw_price"))
    return Job(rows, found.rejects.unionByName(unread))


def raw_from_pages(pages: DataFrame, max_listings: int | None = None) -> DataFrame:
    return raw_pages_job(pages, max_listings).rows


def pages_job(pages: DataFrame, max_listings: int | None = None, mode: str = "fuzzy", funnel=None) -> Job:
    raw = raw_pages_job(pages, max_listings)
    listings = clean_job(raw.rows, mode, funnel)
    return Job(listings.rows, raw.rejects.unionByName(listings.rejects))


def listings_from_pages(
    pages: DataFrame, max_listings: int | None = None, mode: str = "fuzzy", funnel=None
) -> DataFrame:
    return clean_all(raw_from_pages(pages, max_listings), mode, funnel)


# --- payloads ---------------------------------------------------------------


def raw_payloads_job(payloads: DataFrame, max_listings: int | None = None) -> Job:
    """Raw listings of payload texts (``location_key``, ``payload_no``,
    ``body``). ``payload_no`` numbers the texts of a location in their order;
    without it there may be one text for each location."""
    if "payload_no" not in payloads.columns:
        payloads = payloads.withColumn("payload_no", F.lit(0).cast("bigint"))
    homes = payload.cap_payload(payload.payload_homes(payloads), max_listings)
    placed = join_location(homes).withColumn("ordinal", payload_ordinal())
    rejects = payload.payload_rejects(homes).unionByName(unknown_locations(payloads))
    return Job(payload.normalize_home(placed), rejects)


def raw_from_payloads(payloads: DataFrame, max_listings: int | None = None) -> DataFrame:
    return raw_payloads_job(payloads, max_listings).rows


def payloads_job(payloads: DataFrame, max_listings: int | None = None, mode: str = "fuzzy", funnel=None) -> Job:
    raw = raw_payloads_job(payloads, max_listings)
    listings = clean_job(raw.rows, mode, funnel)
    return Job(listings.rows, raw.rejects.unionByName(listings.rejects))


def listings_from_payloads(
    payloads: DataFrame, max_listings: int | None = None, mode: str = "fuzzy", funnel=None
) -> DataFrame:
    return clean_all(raw_from_payloads(payloads, max_listings), mode, funnel)


# --- posts ------------------------------------------------------------------


def posts_from_snapshots(
    snapshots: DataFrame, as_of: str, max_posts: int | None = None, feed: str = "feed"
) -> DataFrame:
    """Posts of stored snapshots (``feed``, ``snapshot_no``, ``html``): first
    sightings up to the stale run; of each feed the first ``max_posts``, where
    that is given."""
    seen = cut_lineage(html.extract_posts(snapshots, as_of))
    reached = metrics.truncate_stale(seen, feed=feed)
    fresh = dedup.dedup_posts(reached, within=(feed,))
    return fresh if max_posts is None else dedup.first_per(fresh, [feed], ["snapshot_no", "position"], max_posts)
