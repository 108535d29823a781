"""Names, lists, ranges and markup that results depend on.

Everything in this module is data that has to be exactly so for results to
come out right; no logic lives here.
"""

# --- fixed values: locations -------------------------------------------------
# key, base url, state, city, map ring of "lon lat" points
LOCATIONS = [
    (
        "milwaukee",
        "https://milwaukee.craigslist.org",
        "wi",
        "Milwaukee",
        "-88.07 42.84,-87.82 42.84,-87.82 43.19,-88.07 43.19,-88.07 42.84",
    ),
    (
        "columbus",
        "https://columbus.craigslist.org",
        "oh",
        "Columbus",
        "-83.20 39.87,-82.77 39.87,-82.77 40.16,-83.20 40.16,-83.20 39.87",
    ),
]

NEIGHBORHOODS = {
    "milwaukee": [
        "Bay View", "Riverwest", "Walker's Point", "Third Ward", "East Side",
        "Sherman Park", "Washington Heights", "Wauwatosa", "West Allis",
        "Shorewood", "Whitefish Bay", "Greenfield", "South Milwaukee", "Cudahy",
        "Oak Creek", "Franklin", "Brookfield", "Pewaukee", "Menomonee Falls",
        "Glendale",
    ],
    "columbus": [
        "Short North", "German Village", "Clintonville", "Grandview Heights",
        "Upper Arlington", "Westerville", "Dublin", "Hilliard", "Reynoldsburg",
        "Gahanna", "Grove City", "Worthington", "Bexley", "Whitehall", "Linden",
        "Franklinton", "Italian Village", "Old North", "Victorian Village",
        "Harrison West",
    ],
}

STREETS = {
    "milwaukee": [
        "N Oakland Ave", "S Kinnickinnic Ave", "W National Ave", "N Farwell Ave",
        "E Brady St", "W Wisconsin Ave", "S Layton Blvd", "N 76th St",
        "W Bluemound Rd", "S 13th St", "N Sherman Blvd", "W Vliet St",
        "E North Ave", "S 27th St", "W Lincoln Ave",
    ],
    "columbus": [
        "N High St", "E Broad St", "W Fifth Ave", "S Third St", "N Fourth St",
        "E Main St", "W Lane Ave", "S Hamilton Rd", "N Cassady Ave",
        "E Livingston Ave", "W Mound St", "Olentangy River Rd", "Sawmill Rd",
        "Bethel Rd", "Henderson Rd",
    ],
}

ZIP_CODES = {
    "milwaukee": [
        "53202", "53203", "53204", "53205", "53206", "53207", "53208", "53209",
        "53210", "53211", "53212", "53213", "53214", "53215", "53216", "53217",
        "53218", "53219", "53220", "53221", "53222", "53223", "53224", "53225",
        "53226", "53227", "53228", "53233", "53235",
    ],
    "columbus": [
        "43201", "43202", "43203", "43204", "43205", "43206", "43207", "43209",
        "43210", "43211", "43212", "43213", "43214", "43215", "43216", "43217",
        "43219", "43220", "43221", "43222", "43223", "43224", "43227", "43228",
        "43229", "43230", "43231", "43232", "43235",
    ],
}

# --- fixed values: cleaning --------------------------------------------------
DEFAULT_TITLE = "No Title"
DEFAULT_SOURCE = "redfin"
DEFAULT_LOCATION = "unknown"
PROPERTY_TYPES_IN_ORDER = [
    "house", "apartment", "condo", "duplex", "townhouse", "loft", "land",
]
BEDROOMS_PATTERN = r"(\d+)\s*[bB][rR]"
BATHROOMS_PATTERN = r"(\d+(?:\.\d+)?)\s*[bB][aA]"
SQFT_PATTERN = r"(?i)(\d+)\s*(?:ft|ft2|sqft)"
MAX_PRICE = 100_000_000
MAX_BEDROOMS = 30
STRICT_PRICE = (100, 100_000_000)
STRICT_SQFT = (50, 50_000)
SIMILAR_CUTOFF = 90

# --- fixed values: requests and limits ---------------------------------------
MIN_PRICE_DEFAULT = 50_000
MAX_PRICE_DEFAULT = 250_000
RESULTS_PER_PAGE = 120
LISTINGS_PER_LOCATION = 100
PROPERTY_TYPE_CODES = [1, 2, 3, 4, 5, 6]
POSTS_PER_SESSION = 20
STALE_SNAPSHOTS = 5
ACTION_LIMIT = 10

# --- fixed values: payload ---------------------------------------------------
PAYLOAD_HOST = "https://www.redfin.com"
PAYLOAD_TYPE_NAMES = {
    1: "house", 2: "condo", 3: "townhouse", 4: "multi-family", 5: "land",
    6: "other",
}

# --- fixed values: posts -----------------------------------------------------
POST_HOST = "https://www.facebook.com"
POSTS_SOURCE = "facebook_feed"
BOILERPLATE = "QR Code Link to This Post"

# --- fixed values: markup ----------------------------------------------------
SEARCH_ROW_SELECTORS = ["li.cl-search-result", "li.result-row"]
SEARCH_LINK_SELECTORS = ["a.cl-app-anchor", "a.result-title"]
SEARCH_PRICE_SELECTORS = ["span.priceinfo", "span.result-price"]
SIMPLE_ROW_SELECTORS = ["li.result-row"]
SIMPLE_LINK_SELECTORS = [".result-title"]
SIMPLE_PRICE_SELECTORS = [".result-price"]
DETAIL_TITLE = "span#titletextonly"
DETAIL_PRICE = "span.price"
DETAIL_ADDRESS = "div.mapaddress"
DETAIL_HOUSING = "p.attrgroup"
DETAIL_BODY = "section#postingbody"
DETAIL_BODY_DROP = "div.print-information"
DETAIL_DATE = 'time[class="date timeago"]'
ATTRIBUTE_SPANS = ".attrgroup span"
DESCRIPTION_BODY = "#postingbody"
POST_CARD = (
    'div[role="article"][aria-posinset], div[data-pagelet^="FeedUnit"], '
    'div[role="article"]'
)
POST_AUTHOR = 'h2 a, h3 a, h4 a, a[role="link"] strong, span.x1lliihq a'
POST_TEXT = (
    'div[data-ad-preview="message"], div[dir="auto"][style*="text-align"], '
    'div.xdj266r, div[data-ad-comet-preview="message"]'
)
POST_TIME = 'a[href*="/posts/"] span, a[role="link"] span[id]'
POST_LINK = 'a[href*="/posts/"], a[href*="/permalink/"], a[href*="story_fbid"]'
POST_REACTIONS = (
    'span[aria-label*="reaction"], span[aria-label*="like"], '
    'span[aria-label*="people reacted"]'
)
POST_COMMENTS = 'span:has-text("comment"), span:has-text("Comment")'

# --- fixed values: synthetic listings ----------------------------------------
SYNTH_SOURCE = "craigslist"
# type, weight in percent, price range, bedroom range
SYNTH_TYPES = [
    ("house", 50, 65_000, 245_000, 2, 5),
    ("duplex", 15, 85_000, 230_000, 3, 6),
    ("condo", 15, 55_000, 180_000, 1, 3),
    ("townhouse", 10, 70_000, 200_000, 2, 4),
    ("apartment", 10, 50_000, 150_000, 1, 3),
]
SYNTH_BATHROOMS = [1.0, 1.0, 1.5, 2.0, 2.0, 2.5, 3.0]
SYNTH_BASE_SQFT = {1: 600, 2: 900, 3: 1200, 4: 1600, 5: 2000, 6: 2400}
SYNTH_SQFT_SPREAD = (-200, 400)
SYNTH_STREET_NUMBERS = (100, 9999)
SYNTH_POST_IDS = (7_700_000_000, 7_799_999_999)
SYNTH_MAX_DAYS_AGO = 30
SYNTH_FEATURE_COUNT = (3, 7)
# {bd} bedrooms, {ba} whole bathrooms, {ty} type in title case, {nb}
# neighborhood, {sf} square feet
SYNTH_TITLES = [
    "{bd}BR/{ba}BA {ty} in {nb}",
    "Charming {bd} Bed {ty} — {nb}",
    "MUST SEE! {bd}br - {sf}ft² ({nb})",
    "{ty} for Sale | {bd}BR {ba}BA | {nb}",
    "Investment Opportunity — {bd}BR {ty} {nb}",
    "Renovated {bd} Bedroom {ty} Near Downtown",
    "Great {ty} in {nb} — {sf} sqft",
    "Move-In Ready {bd}BR/{ba}BA in {nb}",
]
SYNTH_FEATURES = [
    "hardwood floors throughout", "updated kitchen with granite countertops",
    "new roof (2023)", "central air conditioning", "attached garage",
    "fenced backyard", "stainless steel appliances", "finished basement",
    "close to parks and schools", "quiet neighborhood", "near public transit",
    "washer/dryer included", "new furnace", "fresh paint throughout",
    "large master bedroom", "walk-in closets", "open floor plan",
    "natural light", "recently renovated bathroom", "energy efficient windows",
]
