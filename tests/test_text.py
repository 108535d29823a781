"""Expression tables: each operator with its edge values."""

import pytest
from pyspark.sql import functions as F

from curbside.functions import payload, posts, text, urls

MAX = 2**63 - 1


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def _of_number(fn):
    """A function of a part and its kind, for parts that are numbers."""
    return lambda c: fn(c, F.when(c.isNotNull(), "DOUBLE"))


CASES = [
    (text.clean_price, {"$150K": 150.0, "$1.2.3": None, ".": None, "1.": 1.0, "-5": 5.0,
                        "$100,000 - $150,000": 100000150000.0, "": None, None: None, "call": None}),
    (text.clean_price_k, {"$150,000": 150000, "150000": 150000, "$150K": 150000, " $1,234.56 ": 1234,
                          "Contact for price": 0, "": 0, None: 0, "1.5k": 1500, "junk k": 0, "-2.9": -2,
                          "nan": 0, "150d": 0, "1e3": 1000}),
    (text.clean_address, {"  1   Main\n St ": "1 Main St", "1  Main": "1 Main", "": "", None: None,
                          "a\x1cb c": "a b c"}),
    (text.title_address, {" 123 MAIN ST ": "123 Main St", "apt 4b, new york, ny": "Apt 4B, New York, Ny",
                          "": "", None: "", "o'neil rd": "O'Neil Rd", "élan vital": "Élan Vital"}),
    (text.bedrooms, {"3br": 3, "2.5br": 5, "3.0br": 0, "4 bedrooms": None, "4 BR": 4, None: None,
                     "99999999999999999999999br": MAX, "x 2Br 3br": 2}),
    (text.bathrooms, {"1.5ba": 1.5, "3 Bath": 3.0, "2br": None, "1.5 BA / 2ba": 1.5, None: None}),
    (text.sqft, {"1500ft²": 1500, "1,500 ft": 500, "1500 sq ft": None, "900SQFT": 900, None: None}),
    (text.property_type, {"townhouse": "house", "multi-family": None, "Portland": "land", "Loft condo": "condo",
                          "DUPLEX": "duplex", None: None}),
    (text.strip_boilerplate, {" QR Code Link to This Post\n a QR Code Link to This Postb ": "a b", None: None}),
    (posts.reaction_count, {"1,234 people reacted": 1234, "likes": 0, "Like, love: 5": None, None: 0, "": 0}),
    (posts.comment_count, {"1,234 comments": 1, "Comment": 0, None: 0, "45 comments": 45}),
    (posts.text_fallback, {"short\n  eleven chars \nx\nsecond long line": "eleven chars\nsecond long line",
                           "\n".join(f"line number {i:02d}" for i in range(8)):
                               "\n".join(f"line number {i:02d}" for i in range(5)),
                           "0123456789": "", "": ""}),
    (urls.absolute_post_url, {"/a": "https://www.facebook.com/a", "https://x/y": "https://x/y", "": "", None: None}),
    (payload.strip_json_prefix, {"{}&&[1]": "[1]", "a&&b&&c": "b&&c", "[1]": "[1]", "a\n&&b": "a\n&&b",
                                 "a b&&c": "c"}),
    (_of_number(payload.money), {"150000": "$150,000", "0": None, "0.0": None, None: None, "1234.5": "$1,234.5", "999": "$999",
                     "1.5E7": "$15,000,000.0"}),
    (_of_number(payload.payload_type), {"1": "house", "4": "multi-family", "9": "9", "0": None, None: None}),
    (payload.number_text, {"3.0": "3.0", "3": "3", "1.0E7": "10000000.0", None: None}),
    (payload.payload_url, {"/h/1": "https://www.redfin.com/h/1", "": "", None: ""}),
]


@pytest.mark.parametrize("fn,table", CASES, ids=lambda v: getattr(v, "__name__", ""))
def test_expression(spark, fn, table):
    got = apply(spark, fn, list(table))
    assert dict(zip(table, got)) == table


def test_housing_info_split(spark):
    table = {"3br - 1500ft²": (3, 1500), "2br": (2, None), "1000sqft": (None, 1000), "x": (None, None), "": (None, None),
             "2br - xbr - 4br": (4, None), "5br - nobr": (5, None), "br 3 - 900ft2 - 800 sqft": (3, 800), None: (None, None)}
    got = apply(spark, text.housing_info_split, list(table))
    assert {k: tuple(g) for k, g in zip(table, got)} == table


def test_housing_info(spark):
    got = apply(spark, text.housing_info, ["3br / 1.5ba - 900ft2 - Duplex", "", None])
    assert [tuple(g) for g in got] == [(3, 1.5, 900, "duplex"), (None,) * 4, (None,) * 4]


def test_absolute_url(spark):
    base = "https://columbus.craigslist.org"
    table = {"/d/1": base + "/d/1", "d/1": base + "/d/1", "//h/x": "https://h/x", "?q=1": base + "?q=1",
             "#top": base + "#top", "http://a/b": "http://a/b", "mailto:x": "mailto:x", "": "", None: None,
             "/a/../b/./c": base + "/b/c", "../x": base + "/x", "/a/b/..": base + "/a/", "/a?x=/../y": base + "/a?x=/../y"}
    got = apply(spark, lambda c: urls.absolute_url(c, F.lit(base)), list(table))
    assert dict(zip(table, got)) == table


def test_location_key(spark):
    df = spark.createDataFrame([("milwaukee", "WI")], "k string, s string")
    assert df.select(urls.location_key(F.col("k"), F.col("s"))).first()[0] == "milwaukee_wi"


def test_payload_address(spark):
    df = spark.createDataFrame([("1 Main", "X", "WI", "5"), ("", "", "", ""), ("", "X", "WI", "")],
                               "a string, b string, c string, d string")
    got = [r[0] for r in df.select(payload.payload_address(*[F.col(c) for c in "abcd"])).collect()]
    assert got == ["1 Main, X, WI 5", "", "X, WI"]


def test_post_id(spark):
    df = spark.createDataFrame(
        [("/p/1", "a", "t"), (None, "a", "t" * 150), ("", "a", "t" * 100 + "u"), ("", "a", ""), ("", "", "t")],
        "u string, a string, t string")
    got = [r[0] for r in df.select(posts.post_id(F.col("u"), F.col("a"), F.col("t"))).collect()]
    assert got[0] == "/p/1" and got[1] == got[2] and got[1].startswith("a_")
    assert got[3].startswith("post_") and got[4].startswith("post_") and got[3] != got[4]
