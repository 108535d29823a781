"""Payloads, crawl order, posts, ledgers, sinks, sources and streams."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside import schema
from curbside.functions.order import check_unique, page_ordinal
from curbside.operators import crawl, dedup, html, metrics, payload, quota
from curbside.plans import flows
from curbside.sinks import files
from curbside.sources import stored
from curbside.sources.locations import join_location, location_dim
from curbside.sources.synthetic import synth_listings
from curbside.streaming import streams

FULL = {
    "price": {"value": 150000}, "sqFt": {"value": 1500}, "streetLine": {"value": "1 Main"}, "city": "Racine",
    "state": "IL", "zip": "53202", "url": "/WI/1", "listingId": 77, "mlsId": {"value": "M1"}, "dom": {"value": 3},
    "lotSize": {"value": 12000}, "yearBuilt": {"value": 1950}, "hoa": {"value": 250}, "mlsStatus": "Active",
    "propertyType": 1, "beds": 3, "baths": 1.5,
}


def without(*names, **changes):
    return {**{k: v for k, v in FULL.items() if k not in names}, **changes}


def normal(spark, *homes, **options):
    body = "{}&&" + json.dumps({"payload": {"homes": homes}})
    df = spark.createDataFrame([("milwaukee", body)], "location_key string, body string")
    joined = join_location(payload.payload_homes(df)).withColumn("ordinal", F.col("pos").cast("long"))
    return [r.asDict() for r in payload.normalize_home(joined, **options).orderBy("ordinal").collect()]


def test_full_home(spark):
    r = normal(spark, FULL)[0]
    assert r["title"] == "3BR/1.5BA house in Racine" and r["raw_price"] == "$150,000"
    assert r["raw_address"] == "1 Main, Racine, IL 53202" and r["raw_housing_info"] == "3br - 1500ft2 - house"
    assert r["description"] == (
        "3 bed, 1.5 bath house at 1 Main, Racine, IL. 1,500 sqft. Built 1950. Lot: 12,000 sqft. "
        "HOA: $250/mo. 3 days on market. MLS# M1. Status: Active."
    )
    assert r["url"] == "https://www.redfin.com/WI/1" and r["location"] == "milwaukee_wi"
    assert (r["mls_id"], r["listing_id"], r["year_built"], r["lot_size"], r["hoa"], r["days_on_market"]) == (
        "M1", "77", 1950, 12000.0, 250.0, 3)


def test_home_variants(spark):
    got = normal(
        spark, without("price"), without(price=None), without(price={"value": 0}), without(price={"value": 99.5}),
        without("beds", "baths", "city", "state", "propertyType"), without(beds=3.0, baths=None, propertyType=0),
        without(propertyType=9, url=""), without("streetLine", "zip"), without(sqFt=7), without(price={"value": "7"}),
        without(streetLine={"value": None}, mlsId={"value": None}, mlsStatus=None, propertyType=4), without("url"),
        without(price={"value": 25000000.0}),
    )
    assert [r["ordinal"] for r in got] == [0, 2, 3, 4, 5, 6, 7, 10, 11, 12]
    by = {r["ordinal"]: r for r in got}
    assert by[0]["raw_price"] is None and by[2]["raw_price"] is None and by[3]["raw_price"] == "$99.5"
    assert by[4]["title"] == "?BR/?BA Property in Milwaukee" and by[4]["raw_address"] == "1 Main, Milwaukee, WI 53202"
    assert by[4]["raw_housing_info"] == "br - 1500ft2 - "
    assert by[5]["title"] == "3.0BR/NoneBA Property in Racine" and by[5]["raw_housing_info"] == "3.0br - 1500ft2 - "
    assert by[6]["property_type"] == "9" and by[6]["url"] == "" and by[11]["url"] == ""
    assert by[7]["raw_address"] == "Racine, IL"
    assert by[10]["raw_address"] == "None, Racine, IL 53202" and by[10]["mls_id"] is None
    assert "MLS# None. Status: None." in by[10]["description"] and by[10]["property_type"] == "multi-family"
    assert by[12]["raw_price"] == "$25,000,000.0"


def test_what_says_nothing(spark):
    """Empty texts, lists and objects count as missing; the text "0" and the
    text "1" are no numbers."""
    got = normal(
        spark, without(price={"value": ""}), without(price={"value": []}), without(sqFt={"value": ""}), without(lotSize={"value": {}}),
        without(listingId="0"), without(propertyType="1"), without(listingId=0), without(propertyType=1.0), without(price={"value": "7"}),
        without(sqFt={"value": [1]}), without(hoa={"value": ""}, dom={"value": False}),
    )
    by = {r["ordinal"]: r for r in got}
    assert sorted(by) == [0, 1, 2, 3, 4, 5, 6, 7, 10]
    assert by[0]["raw_price"] is None and by[1]["raw_price"] is None
    assert by[2]["raw_housing_info"] == "3br - ft2 - house" and "Lot:" not in by[3]["description"]
    assert by[4]["listing_id"] == "0" and by[6]["listing_id"] is None
    assert by[5]["property_type"] == "1" and by[7]["property_type"] == "house"
    assert "HOA" not in by[10]["description"] and "days on market" not in by[10]["description"]


def test_payload_baths(spark):
    assert normal(spark, FULL, payload_baths=True)[0]["raw_housing_info"] == "3br / 1.5ba - 1500ft2 - house"


def test_payload_kinds_are_looked_up_once(spark):
    """Each kind is one expression of the plan, whatever uses it."""
    df = spark.createDataFrame([("milwaukee", json.dumps({"payload": {"homes": [FULL]}}))], "location_key string, body string")
    rows = payload.normalize_home(join_location(payload.payload_homes(df)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("schemaOfVariant(") + plan.count("schema_of_variant(") <= len(payload.KINDS)


def test_payload_bodies_and_cap(spark):
    homes = [without(listingId=i, url=f"/h/{i}", beds=i % 9) for i in range(1, 12)]
    bodies = [("milwaukee", 0, "{}&&" + json.dumps({"payload": {"homes": homes}})), ("columbus", 0, '{"payload": null}'),
              ("columbus", 1, "not json"), ("columbus", 2, '{"payload": {"homes": null}}'),
              ("nowhere", 0, json.dumps({"payload": {"homes": homes}})),
              ("columbus", 3, json.dumps({"payload": {"homes": [without(price=None)] + homes}}))]
    df = spark.createDataFrame(bodies, "location_key string, payload_no long, body string")
    raw = flows.raw_from_payloads(df, 3)
    got = {(r["location"], r["url"][-2:]) for r in raw.collect()}
    assert got == {("milwaukee_wi", "/1"), ("milwaukee_wi", "/2"), ("milwaukee_wi", "/3"),
                   ("columbus_oh", "/1"), ("columbus_oh", "/2")}
    assert payload.payload_rejects(payload.payload_homes(df)).count() == 1
    assert flows.listings_from_payloads(df, 3, "exact").count() == 3


def stored_pages(spark, rows):
    full = [(i, kind, url, loc, "redfin", kw, off, datetime.datetime(2024, 1, 1), text)
            for i, (kind, url, loc, kw, off, text) in enumerate(rows)]
    return spark.createDataFrame(full, schema.PAGES)


def result_page(numbers, prefix="/d/"):
    return "<ul>" + "".join(
        f'<li class="cl-search-result"><a class="cl-app-anchor" href="{prefix}{n}">House number {n * 7919 % 100003}x{n}</a>'
        f'<span class="priceinfo">${n}</span></li>' for n in numbers) + "</ul>"


def test_pages_job(spark):
    detail = '<span id="titletextonly">other title</span><span class="price">$0</span><div class="mapaddress"> 1  Elm </div>'
    base = "https://milwaukee.craigslist.org"
    rows = [
        ("landing", base, "milwaukee", 0, 0, result_page([1, 2, 3])),
        ("search", base, "milwaukee", 1, 0, result_page(range(3, 123))),
        ("search", base, "milwaukee", 1, 120, result_page(range(200, 319))),  # 119 rows: the last one
        ("search", base, "milwaukee", 1, 240, result_page(range(400, 520))),
        ("search", base, "milwaukee", 2, 0, None),
        ("search", base, "milwaukee", 2, 120, result_page([900])),
        ("search", base, "columbus", 1, 0, result_page([1], "https://milwaukee.craigslist.org/d/")),
        ("search", base, "nowhere", 1, 0, result_page([5])),
        ("detail", base + "/d/2", "milwaukee", 0, 0, detail),
    ]
    pages = stored_pages(spark, rows).repartition(4)
    found = flows.search_results(pages)
    assert {r["location"]: r["n"] for r in found.groupBy("location").agg(F.count("*").alias("n")).collect()} == {
        "milwaukee_wi": 3 + 120 + 119, "columbus_oh": 1}
    raw = {r["url"]: r for r in flows.raw_from_pages(pages, 130).collect()}
    assert len(raw) == 130
    assert raw[base + "/d/2"]["raw_address"] == "1  Elm" and raw[base + "/d/2"]["raw_price"] == "$2"
    assert raw[base + "/d/3"]["raw_address"] is None
    out = {r["url"]: r for r in flows.listings_from_pages(pages, 130, "exact").collect()}
    assert len(out) == 130 and out[base + "/d/2"]["address"] == "1 Elm" and out[base + "/d/1"]["location"] == "milwaukee_wi"
    yields = {(r["location"], r["keyword_idx"], r["offset"]): (r["results"], r["new_results"])
              for r in crawl.page_yield(found).collect()}
    assert yields[("milwaukee_wi", 1, 0)] == (120, 119)


def test_unknown_locations_are_rejects(spark):
    rows = [("landing", "u", "milwaukee", 0, 0, result_page([1])), ("search", "u", "nowhere", 1, 0, result_page([5])),
            ("search", "u", "nowhere", 1, 120, result_page([6])), ("detail", "u", "elsewhere", 0, 0, "<p>x</p>")]
    found = flows.search_job(stored_pages(spark, rows))
    assert [tuple(r) for r in found.rejects.collect()] == [("location", "nowhere", "unknown location")]
    assert found.rows.count() == 1
    body = json.dumps({"payload": {"homes": [FULL]}})
    texts = spark.createDataFrame([("milwaukee", body), ("atlantis", body)], "location_key string, body string")
    job = flows.raw_payloads_job(texts)
    assert job.rows.count() == 1 and [tuple(r) for r in job.rejects.collect()] == [("location", "atlantis", "unknown location")]


def test_pages_stored_twice(spark):
    """A later fetch of a page adds its new urls and loses none."""
    base = "https://milwaukee.craigslist.org"

    def page(*rows):
        return "".join(f'<li class="cl-search-result"><a class="cl-app-anchor" href="{u}">{t}</a><span class="priceinfo">{p}</span></li>'
                       for u, t, p in rows)

    first = page(("/1", "A house with a garden and a view", "$1000"), ("/2", "A house with a garden and a view!", "$1000"))
    second = page(("/3", "A house with a garden and a view", "$2000"), ("/4", "Completely different thing", "$1000"))
    day = datetime.datetime
    rows = [(1, "landing", base, "milwaukee", "redfin", 0, 0, day(2024, 1, 1), first), (2, "landing", base, "milwaukee", "redfin", 0, 0, day(2024, 1, 2), second),
            (3, "landing", base, "milwaukee", "redfin", 0, 0, day(2024, 1, 3), "<![bad[x]]>")]
    pages = spark.createDataFrame(rows, schema.PAGES)
    found, rejects = flows.pages_job(pages)
    assert {r["url"][-1] for r in found.collect()} == {"1", "3", "4"}
    assert [(r["stage"], r["key"]) for r in rejects.collect()] == [("html", "3")]


def test_payloads_keep_their_order(spark):
    homes = [without(listingId=i, url=f"/h/{i}", beds=i) for i in range(1, 3)]
    texts = [("milwaukee", 0, json.dumps({"payload": {"homes": homes}})),
             ("milwaukee", 1, json.dumps({"payload": {"homes": [homes[0], without(url="/h/9", beds=1), without(url="/h/8", city="Elsewhere", beds=7)]}}))]
    df = spark.createDataFrame(texts, "location_key string, payload_no long, body string")
    for mode in ("fuzzy", "exact"):
        assert {r["url"][-1] for r in flows.listings_from_payloads(df, mode=mode).collect()} >= {"1", "8"}
        assert flows.listings_from_payloads(df, mode=mode).where("url like '%/9'").count() == 0
    many = json.dumps({"payload": {"homes": [without(url=f"/h/{i}") for i in range(500)]}})
    one = spark.createDataFrame([("milwaukee", many)], "location_key string, body string")
    assert flows.raw_from_payloads(one).count() == 500 and flows.raw_from_payloads(one, 1000).count() == 500


def test_ordinals_have_to_be_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "ordinal long, url string")
    with pytest.raises(ValueError, match="unique"):
        check_unique(df)


def test_no_page_is_shuffled(spark, monkeypatch):
    """Neither way of reading details sends html through an exchange."""
    base = "https://milwaukee.craigslist.org"
    rows = [("landing", base, "milwaukee", 0, 0, result_page([1, 2]))] + [
        ("detail", f"{base}/d/{n}", "milwaukee", 0, 0, f'<div class="mapaddress">{n} Elm</div>') for n in range(1, 5)]
    pages = stored_pages(spark, rows).repartition(4)
    plans = []
    parse = html.parse_pages

    def watched(df, profile, html_col="html"):
        if profile is html.DETAIL:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return parse(df, profile, html_col)

    monkeypatch.setattr(html, "parse_pages", watched)
    results = []
    for limit in (500_000, 0):
        monkeypatch.setattr(flows, "BROADCAST_PAGES", limit)
        results.append({(r["url"], r["raw_address"]) for r in flows.raw_from_pages(pages).collect()})
    assert results[0] == results[1] == {(f"{base}/d/{n}", f"{n} Elm") for n in (1, 2)}
    assert "strategy=broadcast" in plans[0] and "Join" not in plans[1]


def test_page_ordinal_range(spark):
    df = spark.createDataFrame([(0, 1, 120, 70000)], "location_idx int, keyword_idx int, offset int, position int")
    with pytest.raises(Exception, match="out of range"):
        df.select(page_ordinal()).collect()


def test_caps_unions_samples(spark):
    df = spark.range(100).selectExpr("id as ordinal", "if(id % 3 = 0, 'a', 'b') as location", "cast(id as string) as url")
    assert {r["ordinal"] for r in crawl.cap_per_location(df.repartition(7), 2).collect()} == {0, 3, 1, 2}
    assert [r["ordinal"] for r in crawl.cap_posts(df.repartition(7), 3).collect()] == [0, 1, 2]
    a = {r["ordinal"] for r in crawl.sample_exact(df, "url", 10, "s").collect()}
    b = {r["ordinal"] for r in crawl.sample_exact(df.repartition(9), "url", 10, "s").collect()}
    assert a == b and len(a) == 10
    assert crawl.sample_exact(df, "url", 0, "s", 5).count() == 5 and crawl.sample_exact(df, "url", 9, "s", 5).count() == 5
    two = crawl.union_locations([df.where("location = 'b'"), df.where("location = 'a'").withColumn("more", F.lit(1))])
    assert [r["location"] for r in two.orderBy("ordinal").collect()] == ["b"] * 66 + ["a"] * 34
    assert crawl.union_keywords(df, [df, df]).where("keyword_idx = 2").count() == 100
    plan = crawl.cap_per_location(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and crawl.cap_per_location(df, None).count() == 100


def test_quota(spark):
    t = datetime.datetime
    rows = [("a", t(2024, 1, 1, 23), 1, True), ("a", t(2024, 1, 1, 23, 30), 2, False), ("a", t(2024, 1, 2), 3, True),
            ("a", t(2024, 1, 2, 1), 4, False), ("a", t(2024, 1, 3), 5, True), ("b", t(2024, 1, 1), 6, False)]
    df = spark.createDataFrame(rows, "session string, ts timestamp, event_id long, success boolean").repartition(3)
    got = {r["event_id"]: (r["action_number"], r["remaining"]) for r in quota.quota_ledger(df, 2).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (2, 0), 6: (1, 2)}
    assert metrics.ledger_totals(quota.quota_ledger(df, 2)).first().asDict() == {"attempts": 4, "total_actions": 2}


def test_stale_and_yield(spark):
    seen = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "b"), (6, "b"), (7, "b"), (7, "a"), (8, "late")]
    df = spark.createDataFrame([("f", n, i) for n, i in seen] + [("g", 1, "x"), ("g", 6, "y"), ("g", 7, "z")],
                               "feed string, snapshot_no int, id string")
    kept = metrics.truncate_stale(df).collect()
    assert {r["snapshot_no"] for r in kept if r["feed"] == "f"} == {1, 2, 3, 4, 5, 6, 7}
    assert {r["id"] for r in kept if r["feed"] == "g"} == {"x", "y", "z"}
    y = [(r["snapshot_no"], r["new_posts"], r["total_posts"]) for r in
         metrics.snapshot_yield(df.where("feed = 'f'")).orderBy("snapshot_no").collect()]
    assert y[:3] == [(1, 1, 1), (2, 1, 2), (3, 0, 2)] and y[-1] == (8, 1, 3)
    first = dedup.dedup_posts(df.withColumn("position", F.lit(0)), within=("feed",))
    assert metrics.post_totals(first).first()[0] == 6


def test_running_total_in_blocks(spark):
    rows = [(g, n, n % 3) for g in "ab" for n in range(1, 50) if n % 7]
    df = spark.createDataFrame(rows, "g string, n int, v int").repartition(3)
    got = {(r["g"], r["n"]): r["t"] for r in metrics.running_total(df, "g", "n", "v", "t", 5).collect()}
    assert got == {(g, n): sum(v for h, m, v in rows if h == g and m <= n) for g, n, _ in rows}


def test_posts_job(spark):
    card = '<div role="article"><h3><a>{0}</a></h3><div class="xdj266r">{1}</div></div>'

    def shot(feed, no, *names):
        return feed, no, "".join(card.format(n, f"text of {n}") for n in names)

    rows = [shot("f", 1, "a", "b"), shot("f", 2, "b", "c")] + [shot("f", n, "c") for n in range(3, 8)] + [shot("f", 8, "d")]
    df = spark.createDataFrame(rows, "feed string, snapshot_no int, html string").repartition(3)
    got = flows.posts_from_snapshots(df, "now", 20).orderBy("snapshot_no", "position").collect()
    assert [r["author"] for r in got] == ["a", "b", "c"]
    assert [r["author"] for r in flows.posts_from_snapshots(df, "now", 2).orderBy("snapshot_no", "position").collect()] == ["a", "b"]


LISTING = [("A \"big\" house, é", 10000000.0, None, 3, 1.5, None, "u1", "line\nbreak", None, "s", "milwaukee_wi", "house"),
           ("B", 150000.0, "x", None, None, 900, "u2", "", None, "s", "columbus_oh", None)]


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame(LISTING, schema.LISTING)
    files.export_all(df, str(tmp_path / "out"))
    csv = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "out/listings.csv").glob("*.csv")))
    header = ",".join(f.name for f in schema.LISTING)
    assert header in csv and '"A ""big"" house, é",10000000.0,,3,1.5,,u1,"line\nbreak",,s,milwaukee_wi,house' in csv
    assert "B,150000.0,x,,,900,u2,,,s,columbus_oh," in csv
    lines = [json.loads(l) for p in (tmp_path / "out/listings.json").glob("*.json") for l in p.read_text("ascii").splitlines()]
    assert sorted(lines, key=lambda r: r["url"]) == [dict(zip([f.name for f in schema.LISTING], r)) for r in LISTING]
    back = spark.read.parquet(str(tmp_path / "out/listings.parquet"))
    assert back.count() == 2
    empty = df.limit(0)
    assert not files.write_csv(empty, str(tmp_path / "e.csv")) and not files.write_json(empty, str(tmp_path / "e.json"))
    assert not os.path.exists(tmp_path / "e.csv")


def test_posts_round_trip(spark, tmp_path):
    posts = spark.createDataFrame([("i2", "b", "é", "2h", 1, 2, 0, "", "now"), ("i1", "a", "t", "", 0, 0, 0, "u", "now")], schema.POST)
    placed = posts.withColumn("ordinal", F.when(F.col("id") == "i2", 1).otherwise(2))
    one, many, none = str(tmp_path / "one"), str(tmp_path / "many"), str(tmp_path / "none")
    files.write_posts(placed, one, "facebook_feed", "now", document_limit=1000)
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "one").glob("*.json"))
    doc = json.loads(text)
    assert "é" in text and doc["metadata"] == {"scraped_at": "now", "total_posts": 2, "source": "facebook_feed"}
    assert [p["id"] for p in doc["posts"]] == ["i2", "i1"]
    assert [(r["ordinal"], r["id"]) for r in stored.read_posts(spark, one, as_lines=False).collect()] == [(0, "i2"), (1, "i1")]
    files.write_posts(placed, many, "facebook_feed", "now")
    assert {(r["ordinal"], r["id"]) for r in stored.read_posts(spark, many).collect()} == {(1, "i2"), (2, "i1")}
    with pytest.raises(ValueError, match="more than 1 rows"):
        files.write_posts(placed, str(tmp_path / "few"), "facebook_feed", "now", document_limit=1)
    files.write_posts(placed.limit(0), none, "facebook_feed", "now", document_limit=1000)
    assert stored.read_posts(spark, none, as_lines=False).count() == 0
    (tmp_path / "bare.json").write_text("{}")
    assert stored.read_posts(spark, str(tmp_path / "bare.json"), as_lines=False).count() == 0
    with pytest.raises(Exception):
        stored.read_posts(spark, str(tmp_path / "absent.json")).count()


def test_one_document_for_each_feed(spark, tmp_path):
    names = schema.POST.fieldNames()
    rows = [(*(f"i{k}", "a", "é", "2h", 1, 2, 0, "", "now"), 100 - k, k % 3) for k in range(30)]
    posts = spark.createDataFrame(rows, T.StructType([*schema.POST.fields, *schema.with_ordinal(schema.POST).fields[len(names):]]).add("feed", "long"))
    path = str(tmp_path / "feeds")
    files.write_posts(posts.repartition(5), path, "facebook_feed", "now", document_by="feed")
    docs = [json.loads(line) for p in (tmp_path / "feeds").glob("*.json") for line in p.read_text("utf-8").splitlines()]
    assert sorted(d["feed"] for d in docs) == [0, 1, 2]
    for d in docs:
        assert d["metadata"] == {"scraped_at": "now", "total_posts": 10, "source": "facebook_feed"}
        assert [p["id"] for p in d["posts"]] == [f"i{k}" for k in range(29, -1, -1) if k % 3 == d["feed"]]
    back = {(r["feed"], r["ordinal"]): r["id"] for r in stored.read_posts_by(spark, path, "feed").collect()}
    assert back == {(d["feed"], n): p["id"] for d in docs for n, p in enumerate(d["posts"])} and len(back) == 30
    files.write_posts(posts.limit(0), str(tmp_path / "none"), "facebook_feed", "now", document_by="feed")
    assert stored.read_posts_by(spark, str(tmp_path / "none"), "feed").count() == 0


def test_ledger_round_trip(spark, tmp_path):
    rows = [("comment", "x", "t2", 2, False, "boom"), ("comment", "x", "t1", 1, True, None)]
    df = spark.createDataFrame(rows, schema.ACTION)
    files.write_action_ledger(df, str(tmp_path / "l"), "start", 5, document_limit=1000)
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "l").glob("*.json")))
    assert doc["metadata"] == {"session_start": "start", "total_actions": 1, "daily_limit": 5}
    assert [a["action_number"] for a in doc["actions"]] == [1, 2]
    assert stored.read_actions(spark, str(tmp_path / "l"), as_lines=False).where("error = 'boom'").count() == 1
    files.write_action_ledger(df, str(tmp_path / "m"), "start", 5)
    assert sorted(map(tuple, stored.read_actions(spark, str(tmp_path / "m")).collect()), key=repr) == sorted(rows, key=repr)


def test_readers(spark, tmp_path):
    os.makedirs(tmp_path / "pay")
    (tmp_path / "pay/milwaukee.json").write_text('{}&&{"payload":\n{"homes":[]}}')
    got = stored.read_payloads(spark, str(tmp_path / "pay")).first()
    assert got["location_key"] == "milwaukee" and got["payload_no"] == 0 and got["body"].endswith("}}")
    (tmp_path / "pay/milwaukee.12.json").write_text("{}")
    assert {r["payload_no"] for r in stored.read_payloads(spark, str(tmp_path / "pay")).collect()} == {0, 12}
    os.makedirs(tmp_path / "html")
    (tmp_path / "html/a.html").write_text("<p>x\n</p>")
    page = stored.read_page_files(spark, str(tmp_path / "html"), "detail", "milwaukee").first()
    assert page["html"] == "<p>x\n</p>" and page["kind"] == "detail"
    stored_pages(spark, [("detail", "u", "milwaukee", 0, 0, "x")]).withColumn("source", F.lit(None).cast("string")).write.parquet(str(tmp_path / "pages"))
    assert stored.read_pages(spark, str(tmp_path / "pages"), "craigslist").first()["source"] == "craigslist"


def test_dimension_and_synthetic(spark):
    assert location_dim(spark).count() == 2
    df = synth_listings(spark, 400, "2024-06-01T00:00:00")
    rows = df.collect()
    assert len(rows) == 800 and df.select("ordinal").distinct().count() == 800
    assert {r["ordinal"]: r for r in rows} == {r["ordinal"]: r for r in synth_listings(spark, 400, "2024-06-01T00:00:00").repartition(3).collect()}
    prices = [int(r["raw_price"].replace("$", "").replace(",", "")) for r in rows]
    assert min(prices) >= 50000 and max(prices) <= 245000 and all(p % 1000 == 0 for p in prices)
    share = sum(r["property_type"] == "house" for r in rows) / 800
    assert 0.4 < share < 0.6
    cheap = synth_listings(spark, 100, "2024-06-01T00:00:00", min_price=200000).collect()
    assert 0 < len(cheap) < 200 and {r["property_type"] for r in cheap} <= {"house", "duplex", "townhouse"}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    ts = datetime.datetime(2024, 1, 1)
    for i in range(3):
        spark.createDataFrame([("milwaukee", ts, result_page(range(i * 5, i * 5 + 10)))],
                              "location string, fetched_at timestamp, html string").coalesce(1).write.mode("append").parquet(src)
    stream = streams.file_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    streams.run_available(streams.stream_listings(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("location = 'milwaukee_wi' and url like 'https://milwaukee.craigslist.org/d/%'").count() == 19
    # A price of $0 is not valid.
    assert got.count() == got.select("url").distinct().count() == 19


def test_stream_quota_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(n % 2, t0 + datetime.timedelta(minutes=n), n, n % 3 > 0) for n in range(40)]
    cols = "session long, ts timestamp, event_id long, success boolean"
    for part in (rows[:11], rows[11:25], rows[25:]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(src)
    order = sorted(os.listdir(src))
    assert len([f for f in order if f.endswith(".parquet")]) == 3
    stream = streams.file_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    streams.run_quota(stream, out, str(tmp_path / "ck"), 4)
    want = quota.quota_ledger(spark.createDataFrame(rows, cols), 4)
    key = ["event_id", "action_number", "remaining"]
    got = {tuple(r) for r in streams.read_ledger(spark, out).select(*key).collect()}
    assert got == {tuple(r) for r in want.select(*key).collect()} and len(got) < 40


def test_stream_posts(spark, tmp_path):
    src = str(tmp_path / "p")
    df = html.keep_posts(spark.createDataFrame(
        [("a", "x", "t", 0, datetime.datetime(2024, 1, 1)), ("a", "x", "t", 0, datetime.datetime(2024, 1, 1)),
         ("b", "", "", 0, datetime.datetime(2024, 1, 1))], "id string, author string, text string, likes long, at timestamp"))
    df.write.parquet(src)
    stream = streams.file_stream(spark, src, df.schema)
    streams.run_available(streams.stream_posts(stream, "at"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_payload_texts_in_a_table(spark, tmp_path):
    from curbside.sinks import files

    rows = [("milwaukee", n, f'{{}}&&{{"payload":\n{{"homes":[{n}]}}}}') for n in range(300)] + [("columbus", 7, None)]
    df = spark.createDataFrame(rows, "location_key string, payload_no long, body string").coalesce(2)
    path = tmp_path / "texts"
    files.write_payloads(df, str(path))
    assert len(list(path.rglob("*.parquet"))) <= 2
    assert sorted(map(tuple, stored.read_payload_table(spark, str(path)).collect())) == sorted(rows)
