"""Listing and post records from stored pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside.functions import posts as post_fn
from curbside.functions import text as text_fn
from curbside.functions import urls
from curbside.functions.markup import Field, Profile, html_profiles, html_rows
from curbside.session import ship_package

SEARCH = Profile(
    rows=tuple(fv.SEARCH_ROW_SELECTORS),
    fields=(
        Field("url", tuple(fv.SEARCH_LINK_SELECTORS), attr="href"),
        Field("title", tuple(fv.SEARCH_LINK_SELECTORS)),
        Field("raw_price", tuple(fv.SEARCH_PRICE_SELECTORS)),
    ),
)
SEARCH_SIMPLE = Profile(
    rows=tuple(fv.SIMPLE_ROW_SELECTORS),
    fields=(
        Field("title", tuple(fv.SIMPLE_LINK_SELECTORS)),
        Field("price", tuple(fv.SIMPLE_PRICE_SELECTORS)),
        Field("url", tuple(fv.SIMPLE_LINK_SELECTORS), attr="href"),
    ),
)
DETAIL = Profile(
    fields=(
        Field("title", (fv.DETAIL_TITLE,)),
        Field("raw_price", (fv.DETAIL_PRICE,)),
        Field("raw_address", (fv.DETAIL_ADDRESS,)),
        Field("housing", (fv.DETAIL_HOUSING,), many=True),
        Field("description", (fv.DETAIL_BODY,), drop=fv.DETAIL_BODY_DROP),
        Field("posted_date", (fv.DETAIL_DATE,), attr="datetime"),
    ),
)
ATTRIBUTES = Profile(
    fields=(
        Field("description", (fv.DESCRIPTION_BODY,)),
        Field("spans", (fv.ATTRIBUTE_SPANS,), many=True),
    ),
)
POSTS = Profile(
    rows=(fv.POST_CARD,),
    fields=(
        Field("author", (fv.POST_AUTHOR,), lines=True),
        Field("text", (fv.POST_TEXT,), lines=True),
        Field("full_text", (), lines=True),
        Field("timestamp", (fv.POST_TIME,), lines=True),
        Field("url", (fv.POST_LINK,), attr="href"),
        Field("reactions_label", (fv.POST_REACTIONS,), attr="aria-label"),
        Field("comments_label", (fv.POST_COMMENTS,), lines=True),
    ),
)


def parse_pages(pages: DataFrame, profile: Profile, html_col: str = "html") -> DataFrame:
    """The pages with ``_page``, what the profile finds in each. Only the HTML
    itself travels to Python. Store this to take rows and rejects from it."""
    ship_package(pages.sparkSession)
    kept = [F.col(c) for c in pages.columns if c != html_col]
    return pages.select(*kept, html_rows(F.col(html_col), profile).alias("_page"))


def parse_profiles(pages: DataFrame, profiles: dict[str, Profile], html_col: str = "html") -> DataFrame:
    """The pages with ``_profiles``, what each of several profiles finds in
    them: every page is parsed once. Store this and read each profile from it
    with ``profile_pages``, by column expressions alone."""
    ship_package(pages.sparkSession)
    kept = [F.col(c) for c in pages.columns if c != html_col]
    return pages.select(*kept, html_profiles(F.col(html_col), profiles).alias("_profiles"))


def profile_pages(parsed: DataFrame, name: str) -> DataFrame:
    """What one profile found, as ``parse_pages`` gives it."""
    return parsed.withColumn("_page", F.col(f"_profiles.{name}")).drop("_profiles")


def page_rows(parsed: DataFrame) -> DataFrame:
    """One row per record of each page with its ``position``; the page's other
    columns stay, unless a field has the same name."""
    fields = parsed.schema["_page"].dataType["rows"].dataType.elementType.fieldNames()
    kept = [c for c in parsed.columns if c != "_page" and c not in fields]
    rows = parsed.select(*kept, F.posexplode("_page.rows").alias("position", "_row"))
    return rows.select(*kept, "position", "_row.*")


def page_rejects(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that could not be read: stage, key, reason."""
    return parsed.where("_page.error is not null").select(
        F.lit("html").alias("stage"), F.col(key).cast("string").alias("key"),
        F.col("_page.error").alias("reason"),
    )


def extract_html(pages: DataFrame, profile: Profile, html_col: str = "html") -> DataFrame:
    return page_rows(parse_pages(pages, profile, html_col))


def extract_search_rows(pages: DataFrame, profile: Profile = SEARCH) -> DataFrame:
    """Rows of search pages; a row without a link or target is skipped."""
    return extract_html(pages, profile).where("url is not null and url <> ''")


def extract_search_rows_simple(pages: DataFrame) -> DataFrame:
    """Old-style rows under the key ``price``; the link target may be null."""
    return extract_html(pages, SEARCH_SIMPLE).where("title is not null")


def extract_details(pages: DataFrame, profile: Profile = DETAIL) -> DataFrame:
    """One record per detail page."""
    return detail_records(extract_html(pages, profile))


def detail_records(rows: DataFrame) -> DataFrame:
    """The housing texts as one, the description without line breaks."""
    found = rows.drop("position")
    housing = F.when(
        F.size("housing") > 0, F.concat(F.lit(" "), F.array_join("housing", " "))
    ).otherwise(F.lit(""))
    return found.withColumns(
        {"raw_housing_info": housing, "description": F.translate("description", "\n", " ")}
    ).drop("housing")


def extract_attributes(pages: DataFrame) -> DataFrame:
    """Description without boilerplate, and the ``key: value`` spans as a map
    in which a later key wins."""
    return attribute_records(extract_html(pages, ATTRIBUTES))


def attribute_records(rows: DataFrame) -> DataFrame:
    """The same of rows that are read already."""
    found = rows.drop("position")
    named = F.filter("spans", lambda s: F.contains(s, F.lit(":")))
    entries = F.transform(
        named,
        lambda s: F.struct(
            text_fn.strip(F.regexp_extract(s, r"(?s)\A([^:]*):", 1)).alias("k"),
            text_fn.strip(F.regexp_extract(s, r"(?s)\A[^:]*:(.*)", 1)).alias("v"),
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]
        ),
    )
    return found.select(
        *[c for c in found.columns if c not in ("spans", "description")],
        text_fn.strip_boilerplate(F.col("description")).alias("description"),
        F.map_from_entries(last).alias("attributes"),
    )


def post_records(cards: DataFrame, as_of: str) -> DataFrame:
    """Post rows from card texts. ``likes`` is null where the reaction label
    cannot be read; see ``split_posts``."""
    text = F.coalesce("text", F.lit(""))
    text = F.when(text == "", post_fn.text_fallback(F.coalesce("full_text", F.lit("")))).otherwise(text)
    author = F.coalesce("author", F.lit(""))
    url = urls.absolute_post_url(F.coalesce("url", F.lit("")))
    shaped = cards.withColumns(
        {
            "author": author,
            "text": text,
            "url": url,
            "timestamp": F.coalesce("timestamp", F.lit("")),
            "likes": post_fn.reaction_count(F.col("reactions_label")),
            "comments_count": post_fn.comment_count(F.col("comments_label")),
            "shares": F.lit(0).cast("bigint"),
            "scraped_at": F.lit(as_of),
        }
    )
    return shaped.withColumn(
        "id", post_fn.post_id(F.col("url"), F.col("author"), F.col("text"))
    ).drop("full_text", "reactions_label", "comments_label")


def keep_posts(posts: DataFrame) -> DataFrame:
    """Posts with a text or an author whose counts could be read."""
    return posts.where("(text <> '' or author <> '') and likes is not null")


def post_rejects(posts: DataFrame) -> DataFrame:
    """Posts whose reaction label holds no number in its digits."""
    return posts.where("likes is null").select(
        F.lit("posts").alias("stage"), F.col("id").alias("key"),
        F.lit("unreadable reaction label").alias("reason"),
    )


def extract_posts(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Post rows of stored page snapshots, in document order by ``position``."""
    return keep_posts(post_records(extract_html(snapshots, POSTS), as_of))
