"""Record types. Every reader states its schema; nothing is inferred."""

from pyspark.sql import types as T

STR, LONG, DBL, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


def _nullable(names, kind=STR):
    return [(n, kind, True) for n in names]


PAGES = _struct(
    ("page_id", LONG, True),
    ("kind", STR, True),
    ("url", STR, True),
    ("location", STR, True),
    ("source", STR, True),
    ("keyword_idx", T.IntegerType(), True),
    ("offset", T.IntegerType(), True),
    ("fetched_at", T.TimestampType(), True),
    ("html", STR, True),
)

RAW_LISTING = _struct(
    ("ordinal", LONG, False),
    *_nullable(
        ["title", "raw_price", "raw_address", "raw_housing_info", "description",
         "posted_date", "url", "location", "source", "property_type", "mls_id",
         "listing_id"]
    ),
    ("year_built", LONG, True),
    ("lot_size", DBL, True),
    ("hoa", DBL, True),
    ("days_on_market", LONG, True),
    ("mls_status", STR, True),
)

# The column order is also the column order of the CSV export.
LISTING = _struct(
    ("title", STR, False),
    ("price", DBL, True),
    ("address", STR, True),
    ("bedrooms", LONG, True),
    ("bathrooms", DBL, True),
    ("sqft", LONG, True),
    ("url", STR, False),
    ("description", STR, True),
    ("posted_date", STR, True),
    ("source", STR, True),
    ("location", STR, False),
    ("property_type", STR, True),
)

POST = _struct(
    *_nullable(["id", "author", "text", "timestamp"]),
    *_nullable(["likes", "comments_count", "shares"], LONG),
    *_nullable(["url", "scraped_at"]),
)

POSTS_FILE = _struct(
    ("metadata", _struct(("scraped_at", STR, True), ("total_posts", LONG, True),
                         ("source", STR, True)), True),
    ("posts", T.ArrayType(POST), True),
)

ACTION = _struct(
    *_nullable(["action", "text", "timestamp"]),
    ("action_number", LONG, True),
    ("success", BOOL, True),
    ("error", STR, True),
)

ACTION_FILE = _struct(
    ("metadata", _struct(("session_start", STR, True), ("total_actions", LONG, True),
                         ("daily_limit", LONG, True)), True),
    ("actions", T.ArrayType(ACTION), True),
)


def with_ordinal(struct: T.StructType) -> T.StructType:
    return T.StructType([*struct.fields, T.StructField("ordinal", LONG)])


SUB_OBJECTS = ["price", "sqFt", "streetLine", "mlsId", "dom", "lotSize", "yearBuilt", "hoa"]
# One home of a payload. Numbers are read as texts, in the JSON's spelling.
PAYLOAD_HOME = _struct(
    *_nullable(SUB_OBJECTS, _struct(("value", STR, True))),
    *_nullable(["city", "state", "zip", "url", "listingId", "mlsStatus",
                "propertyType", "beds", "baths"]),
)
PAYLOAD = _struct(
    ("payload", _struct(("homes", T.ArrayType(STR), True)), True),
)
