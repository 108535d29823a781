from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside import schema
from curbside.operators import clean, dedup, filters, metrics
from curbside.plans import flows


def raw(spark, rows):
    cols = "ordinal long, title string, raw_price string, raw_address string, raw_housing_info string, url string, location string, source string"
    return spark.createDataFrame(rows, cols)


def test_to_listing_defaults(spark):
    df = raw(spark, [(1, "", "$1", None, None, "u", None, None), (2, None, None, " a  b ", "2br", "v", "l", "s")])
    got = {r["url"]: r for r in clean.to_listing(df).collect()}
    assert (got["u"]["title"], got["u"]["source"], got["u"]["location"]) == ("No Title", "redfin", "unknown")
    assert (got["v"]["address"], got["v"]["bedrooms"], got["v"]["source"]) == ("a b", 2, "s")
    bare = spark.createDataFrame([("u", "t")], "url string, title string")
    assert clean.to_listing(bare).columns == [f.name for f in schema.LISTING]


def test_prefer_raw_type(spark):
    df = spark.createDataFrame([("u", "townhouse", "2br - townhouse")], "url string, property_type string, raw_housing_info string")
    assert clean.to_listing(df).first()["property_type"] == "house"
    assert clean.to_listing(df, prefer_raw_type=True).first()["property_type"] == "townhouse"


def test_validate_bounds(spark):
    rows = [(1, "$0"), (2, "$100000000"), (3, "$100000001"), (4, None)]
    df = spark.createDataFrame(rows, "ordinal long, raw_price string").withColumn("url", F.lit("u"))
    kept = {r["ordinal"] for r in clean.validate(clean.to_listing(df)).collect()}
    assert kept == {2, 4}
    beds = spark.createDataFrame([(1, "30br"), (2, "31br"), (3, "99999999999br"), (4, "9" * 40 + "br")],
                                 "ordinal long, raw_housing_info string").withColumn("url", F.lit("u"))
    assert {r["ordinal"] for r in clean.validate(clean.to_listing(beds)).collect()} == {1}
    assert clean.listing_rejects(clean.to_listing(beds)).count() == 3


def test_validate_strict(spark):
    df = spark.createDataFrame([(1, 150000.0, 1500), (2, 10.0, 1500), (3, 150000.0, 10), (4, 100.0, None), (5, None, 900)],
                               "i int, price double, sqft long")
    assert {r["i"] for r in clean.validate_strict(df).collect()} == {1, 4}


def test_first_seen_and_dedup_url(spark):
    df = spark.createDataFrame([(1, "id_123"), (2, "id_456"), (3, "id_123"), (4, None), (5, None), (6, "")],
                               "ordinal long, url string").repartition(3)
    flags = {r["ordinal"]: r["is_duplicate"] for r in dedup.first_seen(df, "url").collect()}
    assert flags == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert {r["ordinal"] for r in dedup.dedup_url(df).collect()} == {1, 2}


def test_not_yet_published(spark):
    df = spark.createDataFrame([("a",), ("b",)], "url string")
    assert [r[0] for r in dedup.not_yet_published(df, df.where("url = 'a'")).collect()] == ["b"]


def test_filters(spark):
    df = spark.createDataFrame([(1, 50000.0), (2, 250000.0), (3, 250000.5), (4, None)], "i int, price double")
    assert {r["i"] for r in filters.filter_price(df).collect()} == {1, 2}
    places = spark.createDataFrame([(1, -88.0, 43.0), (2, -88.0, 42.0), (3, -83.0, 40.0)], "i int, lon double, lat double")
    for key, want in (("milwaukee", {1}), ("columbus", {3})):
        ring = {l[0]: l[4] for l in fv.LOCATIONS}[key]
        inside = filters.filter_region(places, ring)
        assert {r["i"] for r in inside.collect()} == want
        assert "CASE" not in inside._jdf.queryExecution().optimizedPlan().toString()
    triangle = "0 0,4 0,0 4,0 0"
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 0.5, 3.0)], "i int, lon double, lat double")
    assert {r["i"] for r in filters.filter_region(pts, triangle).collect()} == {1, 3}


def test_clean_all_and_funnel(spark):
    df = raw(spark, [
        (1, "Nice house on the hill", "$5", "a", "3br", "u1", "l", "s"),
        (2, "Nice house on the hill", "$5", "a", "3br", "u1", "l", "s"),
        (3, "Nice house on the hills", "$5", "a", "3br", "u3", "l", "s"),
        (4, "Nice house on the hills", "$6", "a", "31br", "u4", "l", "s"),
        (5, "Other", "$6", "a", "3br", "", "l", "s"),
        (6, "Other", "$6", "a", "3br", "u6", "m", "s"),
    ])
    funnel = metrics.Funnel()
    kept = flows.clean_all(df, "fuzzy", funnel)
    assert {r["ordinal"] for r in kept.collect()} == {1, 6}
    assert funnel.counts() == {"raw": 6, "url_unique": 4, "similar_unique": 3, "valid": 2}
    assert {r["ordinal"] for r in flows.clean_all(df, "exact").collect()} == {1, 3, 6}
    totals = {r["location"]: r["listings"] for r in metrics.count_by_location(kept).collect()}
    assert totals == {"l": 1, "m": 1, None: 2}


def test_funnel_can_be_asked_at_any_time(spark):
    df = raw(spark, [(n, f"Title {n % 7}", f"${n % 5}00", "a", "40br" if n % 4 == 0 else "3br", f"u{n % 20}", "l", "s") for n in range(60)])
    funnel = metrics.Funnel()
    assert funnel.counts() == {}
    job = flows.clean_job(df, "exact", funnel)
    before = funnel.counts(0.2)
    assert "valid" not in before and "rejected" not in before
    rows = job.rows.count()
    assert funnel.counts(0.5)["valid"] == rows and "rejected" not in funnel.counts(0.2)
    bad = job.rejects.count()
    assert bad > 0 and funnel.counts() == {
        "raw": 60, "url_unique": 20, "similar_unique": rows + bad, "valid": rows, "rejected": bad
    }
