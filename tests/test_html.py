import pytest
from pyspark.sql import functions as F

from curbside.functions.markup import Field, Profile, read_page
from curbside.operators import html


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


NEW = """<ul><li class="x cl-search-result"><a class="cl-app-anchor" href="/d/1"> One &amp; only </a>
 <span class="priceinfo"> $1,000 </span></li>
 <li class="cl-search-result"><a class="result-title" href="https://h/2">Two</a></li>
 <li class="cl-search-result"><a class="cl-app-anchor">no target</a><a class="result-title" href="/d/9">unused</a></li>
 <li class="cl-search-result"><p>no link</p></li></ul>"""
OLD = """<ul><li class="result-row"><a class="result-title" href="/o/1">Old one<!-- x --></a>
 <span class="result-meta"><span class="result-price">$9</span></span></li>
 <li class="result-row"><a class="result-title">bare</a></li></ul>"""


def test_search_rows(spark):
    got = html.extract_search_rows(pages(spark, [NEW, OLD, OLD + NEW, "", None, "<p>nothing"])).collect()
    rows = {(r["page_id"], r["position"]): (r["url"], r["title"], r["raw_price"]) for r in got}
    assert rows == {
        (0, 0): ("/d/1", "One & only", "$1,000"), (0, 1): ("https://h/2", "Two", None),
        (1, 0): ("/o/1", "Old one", "$9"),
        (2, 0): ("/d/1", "One & only", "$1,000"), (2, 1): ("https://h/2", "Two", None),
    }


def test_simple_rows(spark):
    got = html.extract_search_rows_simple(pages(spark, [OLD, "<div>Nothing</div>"])).collect()
    assert [(r["title"], r["price"], r["url"]) for r in got] == [("Old one", "$9", "/o/1"), ("bare", None, None)]


DETAIL = """<html><body><h1><span id="titletextonly"> A house </span> <span class="price">$5</span></h1>
<div class="mapaddress"> 1 Main St </div><p class="attrgroup"> <span>3BR / 2Ba</span> <p class="attrgroup">900ft2</p>
<section id="postingbody"><div class="print-information print-qrcode-container"><p>QR Code Link to This Post</p></div>
First line
second<script>var t = "</p>";</script> part<br>end
<div class="print-information">kept</div></section>
<time class="date" datetime="no"></time><time class="date timeago" datetime="2024-01-02T03:04:05">x</time>
<time class="timeago date" datetime="other"></time></body></html>"""


def test_details(spark):
    got = {r["page_id"]: r for r in html.extract_details(pages(spark, [DETAIL, "<p>x", ""])).collect()}
    assert set(got) == {0, 1}
    r = got[0]
    assert (r["title"], r["raw_price"], r["raw_address"]) == ("A house", "$5", "1 Main St")
    assert r["raw_housing_info"] == " 3BR / 2Ba 900ft2"
    assert r["description"] == "First line second partend kept"
    assert r["posted_date"] == "2024-01-02T03:04:05"
    assert (got[1]["title"], got[1]["raw_housing_info"], got[1]["description"]) == (None, "", None)


def test_attributes(spark):
    text = """<p class="attrgroup"><span>dogs OK</span><span> fee : $50 </span><span>at: 1:30</span></p>
    <div class="attrgroup"><b><span>fee: $60</span></b></div><section id="postingbody">
    QR Code Link to This Post
    A place. </section>"""
    got = {r["page_id"]: r for r in html.extract_attributes(pages(spark, [text, "<div>Nothing</div>"])).collect()}
    assert got[0]["attributes"] == {"fee": "$60", "at": "1:30"} and got[0]["description"] == "A place."
    assert got[1]["attributes"] == {} and got[1]["description"] is None


POSTS = """<div role="feed"><div role="article" aria-posinset="1"><h3><a href="/ann">Ann</a></h3>
<div dir="auto" style="text-align:start">Hello<br>world</div><a href="/posts/7"><span>2h</span></a>
<span aria-label="1,234 people reacted"></span><span>12 Comments</span></div>
<div data-pagelet="FeedUnit_3"><div role="article"><span>a line long enough here</span><div>short</div>
<div>another line long enough</div></div></div>
<div role="article"><h4><a>Bob</a></h4><span aria-label="Like, love: 5 reactions"></span></div>
<div role="article"><i></i></div></div>"""


def test_posts(spark):
    snapshots = pages(spark, [POSTS])
    cards = html.post_records(html.extract_html(snapshots, html.POSTS), "now")
    got = html.extract_posts(snapshots, "now").orderBy("position").collect()
    first = got[0]
    assert (first["author"], first["text"], first["timestamp"]) == ("Ann", "Hello\nworld", "2h")
    assert (first["url"], first["id"]) == ("https://www.facebook.com/posts/7",) * 2
    assert (first["likes"], first["comments_count"], first["shares"]) == (1234, 12, 0)
    # A pagelet and the article inside are two matches with one id.
    assert [g["text"] for g in got[1:]] == ["a line long enough here\nanother line long enough"] * 2
    assert got[1]["id"] == got[2]["id"] and len(got) == 3
    assert html.post_rejects(cards).count() == 1


def test_damaged_markup():
    profile = Profile(rows=("li",), fields=(Field("t", ()),))
    deep = "<b>" * 3000 + "x"
    assert read_page("<ul><li>a<li>b<b>c</ul><p>d<p>e", profile) == [{"t": "a"}, {"t": "bc"}]
    assert read_page(f"<li>{deep}</li>", profile) == [{"t": "x"}]
    assert read_page("</p></li><li>a</b>b", profile) == [{"t": "ab"}]
    assert read_page("<ul><li>a<ul><li>b</ul>c</ul>", profile) == [{"t": "abc"}, {"t": "b"}]
    nested = Profile(rows=("p",), fields=(Field("t", ()),))
    assert read_page("<p>a<div>b</div><p>c", nested) == [{"t": "a"}, {"t": "c"}]


def test_selectors():
    page = '<div data-x="abc" role="a"><a id="i" class="k l" href="/posts/1"><strong>s</strong></a><span>Some Text</span></div>'

    def first(selector, attr=None):
        return read_page(page, Profile(fields=(Field("t", (selector,), attr=attr),)))[0]["t"]

    assert first("#i strong") == "s" and first('a[href*="/posts/"]') == "s" and first('div[data-x^="ab"] .k.l') == "s"
    assert first('div[data-x^="b"]') is None and first('span:has-text("some text")') == "Some Text"
    assert first("p, span") == "Some Text" and first("a", "href") == "/posts/1" and first("a[id][class]", "id") == "i"


def test_rejects(spark):
    parsed = html.parse_pages(pages(spark, [NEW, "", None]), html.SEARCH)
    assert html.page_rejects(parsed).count() == 0 and html.page_rows(parsed).count() == 4
    broken = parsed.withColumn("_page", F.expr("named_struct('rows', _page.rows, 'error', if(page_id = 1, 'x', null))"))
    assert [tuple(r) for r in html.page_rejects(broken).collect()] == [("html", "1", "x")]


@pytest.mark.parametrize("parts", [1, 4])
def test_partitioning_does_not_matter(spark, parts):
    df = pages(spark, [NEW, OLD] * 10).repartition(parts)
    got = html.extract_search_rows(df).groupBy("url").agg(F.count("*").alias("n")).collect()
    assert {(r["url"], r["n"]) for r in got} == {("/d/1", 10), ("https://h/2", 10), ("/o/1", 10)}


def test_several_profiles_of_one_reading(spark):
    pages = spark.createDataFrame(
        [(1, '<ul><li class="cl-search-result"><a class="cl-app-anchor" href="/1">One</a></li></ul><span id="titletextonly">T</span>'),
         (2, '<span class="price">$5</span><p class="attrgroup"><span>fee: 3</span></p>'), (3, None), (4, ""), (5, "<![bad[x]]>")],
        "page_id int, html string",
    )
    profiles = {"search": html.SEARCH, "detail": html.DETAIL, "attributes": html.ATTRIBUTES}
    parsed = html.parse_profiles(pages, profiles)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for name, profile in profiles.items():
        one, own = html.profile_pages(parsed, name), html.parse_pages(pages, profile)
        assert sorted(map(str, one.collect())) == sorted(map(str, own.collect()))
        assert one.dtypes == own.dtypes
        assert [r["key"] for r in html.page_rejects(one).collect()] == ["5"]
    assert {r["page_id"] for r in html.page_rows(html.profile_pages(parsed, "search")).collect()} == {1}


def test_detail_pages_stay_dealt_out(spark, tmp_path):
    """A few bytes a row, but a page to parse for each."""
    from curbside.plans import derived

    rows = [(k, f"name {k}", "PROMO", 1 + k % 50, "Brand#1") for k in range(400)]
    columns = "p_partkey long, p_name string, p_type string, p_size int, p_brand string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = derived.detail_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pages.count() == sum(k % 9 > 0 for k in range(400))
