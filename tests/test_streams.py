"""Streams against the batch operators: details, quotas, published keys."""

import datetime
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from curbside.operators import clean, crawl, dedup, html, metrics, quota
from curbside.sources.locations import join_location
from curbside.functions import urls
from curbside.streaming import measures, published, sequences, streams

T0 = datetime.datetime(2024, 1, 1)
PAGE = "page_id long, location string, source string, fetched_at timestamp, url string, html string"


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def search_page(numbers):
    items = "".join(
        f'<li class="cl-search-result"><a class="cl-app-anchor" href="/d/{n}">House {n}</a><span class="priceinfo">${n}00</span></li>'
        for n in numbers
    )
    return f"<html><ul>{items}</ul></html>"


def detail_page(n):
    return (
        f'<html><span id="titletextonly">Other title {n}</span><span class="price">$1</span><div class="mapaddress"> {n}  Main </div>'
        f'<p class="attrgroup"><span>{n % 5}br / 900ft2 house</span></p><section id="postingbody">Text {n}</section></html>'
    )


def url(n):
    return f"https://milwaukee.craigslist.org/d/{n}"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(folder)


def run_details(spark, place, **options):
    search, details = (
        streams.file_stream(spark, f"{place}/{kind}", spark.read.parquet(f"{place}/{kind}").schema, files_per_trigger=1)
        for kind in ("search", "details")
    )
    listed = streams.stream_listings(search, details=details, **options)
    streams.run_available(listed, f"{place}/out", f"{place}/checkpoint")
    return {r["url"]: r for r in spark.read.parquet(f"{place}/out").collect()}


def test_details_join_as_in_the_batch(spark, tmp_path):
    place = str(tmp_path)
    search = [(k, "milwaukee", "s", at(k), None, search_page(range(k * 6, k * 6 + 10))) for k in range(1, 4)]
    details = [(100 + n, "milwaukee", "s", at(n % 5), url(n), detail_page(n)) for n in range(6, 28) if n % 4]
    arrive(spark, f"{place}/search", search[:2])
    arrive(spark, f"{place}/details", details[::2])
    first = run_details(spark, place)
    assert all(r["address"] for r in first.values())  # rows without a page still wait
    arrive(spark, f"{place}/details", details[1::2])
    arrive(spark, f"{place}/search", search[2:])
    second = run_details(spark, place)
    assert set(first) < set(second) and all(r["address"] for r in second.values())
    for kind in ("search", "details"):
        arrive(spark, f"{place}/{kind}", [(0, "milwaukee", "s", at(400), "https://x.example/later", "<html></html>")])
    got = run_details(spark, place)

    placed = join_location(spark.createDataFrame(search, PAGE).drop("url").withColumnRenamed("location", "location_key"))
    rows = html.extract_search_rows(placed).select(
        F.expr("page_id * 100 + position").alias("ordinal"), urls.absolute_url(F.col("url"), F.col("base_url")).alias("url"),
        "title", "raw_price", "source", urls.location_key(F.col("location_key"), F.col("dim_state")).alias("location"),
    )
    found = html.extract_details(spark.createDataFrame(details, PAGE).select("url", "html"))
    batch = clean.validate(clean.to_listing(crawl.join_details(dedup.dedup_in_location(rows, ("ordinal",)), found)))
    want = {r["url"]: r for r in batch.drop("ordinal").collect()}
    assert got == want and len(got) == 22 and sum(r["address"] is None for r in got.values()) == 5


def test_details_beyond_the_wait_do_not_join(spark, tmp_path):
    place = str(tmp_path)
    arrive(spark, f"{place}/search", [(1, "milwaukee", "s", at(10), None, search_page([1, 2, 3])), (2, "milwaukee", "s", at(900), None, search_page([]))])
    arrive(spark, f"{place}/details", [
        (3, "milwaukee", "s", at(12), url(1), detail_page(1)), (4, "milwaukee", "s", at(13), url(2), detail_page(2)),
        (5, "milwaukee", "s", at(900), url(4), detail_page(4)),
    ])
    got = run_details(spark, place, wait="2 hours")
    assert {u: r["address"] for u, r in got.items()} == {url(1): "1 Main", url(2): None, url(3): None}


# --- quotas -----------------------------------------------------------------

EVENT = "session long, ts timestamp, event_id long, success boolean"


def test_quota_state_over_arrivals_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (rng.choice([0, 0, 0, 1, 2, 3, None]), T0 + datetime.timedelta(seconds=n // 3), n, rng.choice([True, False, None])) for n in range(300)
    ]
    rows += [(9, T0 + datetime.timedelta(seconds=n // 3), n, False) for n in range(300, 320)]
    src, out = str(tmp_path / "events"), str(tmp_path / "out")
    edges = [0, 40, 41, 200, 320]
    for low, high in zip(edges, edges[1:]):
        part = rows[low:high]
        rng.shuffle(part)
        spark.createDataFrame(part, EVENT).repartition(3).write.mode("append").parquet(src)
        events = streams.file_stream(spark, src, spark.read.parquet(src).schema)
        streams.run_quota(events, out, str(tmp_path / "checkpoint"), 7)
    want = quota.quota_ledger(spark.createDataFrame(rows, EVENT), 7)
    key = ["session", "ts", "event_id", "success", "action_number", "remaining"]
    got = sorted(map(tuple, streams.read_ledger(spark, out).select(*key).collect()), key=repr)
    assert got == sorted(map(tuple, want.select(*key).collect()), key=repr) and len(got) < len(rows)
    # By one loop over the events in order.
    used, plain = {}, []
    for s, ts, e, success in sorted(rows, key=lambda r: r[1:3]):
        if used.get(s, 0) < 7:
            plain.append((s, ts, e, success, used.get(s, 0) + 1, None if success is None else 7 - used.get(s, 0) - success))
            used[s] = used.get(s, 0) + bool(success)
    assert got == sorted(plain, key=repr)


def test_quota_state_is_kept_by_session(spark):
    events = spark.readStream.format("rate").load().selectExpr("value as session", "timestamp as ts", "value as event_id", "true as success")
    ledger = streams.stream_quota(events, 3, forget_after_ms=1000)
    assert "FlatMapGroupsInPandasWithState" in ledger._jdf.queryExecution().analyzed().toString()
    assert ledger.columns == ["session", "ts", "event_id", "success", "action_number", "remaining"]


def test_open_attempts_in_order():
    """Ties, missing times and missing outcomes; ids that are no numbers."""
    ts = pd.to_datetime(["2024-01-02", "2024-01-01", None, "2024-01-01", "2024-01-01"])
    for ids in ([5, 4, 3, 2, 1], ["5", "4", "3", "2", "1"]):
        frame = pd.DataFrame({"ts": ts, "event_id": ids, "success": [True, True, True, None, True]})
        got, before = streams._open_attempts(frame, 3)
        assert [int(e) for e in got["event_id"]] == [1, 2, 4, 5] and before.tolist() == [0, 1, 1, 2]


# --- published keys ---------------------------------------------------------

ROW = "url string, location string, seen timestamp, title string"


def arriving_rows(spark, folder):
    return streams.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


def test_late_repeats_go(spark, tmp_path):
    src, out, keys, checkpoint = (str(tmp_path / n) for n in ("src", "out", "keys", "checkpoint"))
    rng = random.Random(5)
    want = {}
    for part in range(4):
        rows = [(f"u{rng.randrange(40)}", rng.choice("ab"), at(part * 1000 + n), f"t{part}-{n:02d}") for n in range(30)]
        for u, l, _, t in sorted(rows, key=lambda r: r[2]):
            want.setdefault((l, u), t)
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(src)
        if part % 2:
            published.run_unpublished(arriving_rows(spark, src), out, checkpoint, keys, ["location", "url"], ["seen"], buckets=4)
    got = published.read_unpublished(spark, out).collect()
    assert {(r["location"], r["url"]): r["title"] for r in got} == want and len(got) == len(want)
    # The files are the table: another session enters them anew.
    other = spark.newSession()
    name = published.published_keys(other, keys, {"location": "string", "url": "string"}, 4)
    assert other.table(name).count() == len(want)


def test_repeated_micro_batch(spark, tmp_path):
    name = published.published_keys(spark, str(tmp_path / "keys"), {"url": "string"}, 4)
    spark.createDataFrame([("a", 0), ("b", 1), ("b", 1), ("c", 2)], "url string, batch long").write.insertInto(name)
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")

    def left(batch):
        return {r[0] for r in published.unpublished(rows, name, ["url"], batch).collect()}

    assert (left(0), left(1), left(2), left(None)) == ({"a", "b", "c", "d"}, {"b", "c", "d"}, {"c", "d"}, {"d"})


def test_history_is_not_shuffled(spark, tmp_path):
    name = published.published_keys(spark, str(tmp_path / "keys"), {"location": "string", "url": "string"}, 8)
    spark.range(5000).selectExpr("'a' as location", "string(id) as url", "0L as batch").write.insertInto(name)
    rows = spark.createDataFrame([("a", str(n * 77)) for n in range(100)], "location string, url string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = published.unpublished(rows, name, ["location", "url"], 5)
        assert len(left.collect()) == sum(n * 77 >= 5000 for n in range(100))
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # One exchange, that of the rows; the scan of the history is read by bucket.
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", final)) == 1 and "SortMergeJoin" in final
    assert re.search(r"FileScan parquet [^\n]*Bucketed: true", final)
    assert "Exchange" not in final[final.rindex("Filter", 0, final.index("FileScan")) :]


# --- stop rules -------------------------------------------------------------


def paging_cases(rng):
    """Fetches (offset, results, page_id) of one keyword: gaps, short, null and
    empty pages, pages fetched again with more or fewer results."""
    rows = []
    for n in range(rng.randint(1, 9)):
        for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
            rows.append((n * 10, rng.choice([10, 10, 10, 10, 12, 9, 0, None]), len(rows)))
    rng.shuffle(rows)
    return rows


def test_paging_in_any_order():
    rng = random.Random(2)
    for _ in range(300):
        rows = paging_cases(rng)
        best = {}
        for o, r, _ in rows:
            best[o] = max(best.get(o, 0), r or 0)
        end = 0
        while best.get(end, 0) >= 10:
            end += 10
        paging, out, at = sequences.Paging(10), [], 0
        while at < len(rows):
            step = rng.randint(1, 4)
            out += paging.add(rows[at : at + step])
            at += step
        assert sorted(out, key=lambda r: r[2]) == sorted((r for r in rows if r[0] <= end), key=lambda r: r[2])


def test_scrolling_like_a_plain_loop():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randint(1, 4)
        rows, pool = [], 1
        for n in range(1, 25):
            if rng.random() < 0.15:
                continue
            for _ in range(rng.randint(1, 3)):
                pool += rng.random() < 0.25
                rows.append((n, f"p{rng.randint(1, pool)}", n * 100 + rng.randint(0, 40)))
        last, seen, want = 0, set(), []
        for n in sorted({r[0] for r in rows}):
            if n > last + k:
                break
            own = [r for r in rows if r[0] == n]
            want += own
            if any(r[1] not in seen for r in own):
                last = n
            seen |= {r[1] for r in own}
        scrolling, out = sequences.Scrolling(k), []
        # Rows come up to two snapshots late; the watermark follows behind.
        for now in range(0, 2900, 50):
            scrolling.waiting += [r for r in rows if now - 50 <= r[2] + (r[2] % 5) * 40 < now] if not scrolling.closed else []
            out += scrolling.take(now - 220)
        assert sorted(out) == sorted(want)


def test_reached_pages_as_in_the_batch(spark, tmp_path):
    rng = random.Random(7)
    kinds = "kind string, location string, keyword_idx int, offset int, results int, page_id long, fetched_at timestamp"
    rows = [("landing", "a", 0, 0, 3, 999, at(1))]
    for keyword in range(1, 13):
        rows += [("search", rng.choice("ab"), keyword, o * 12, r and r * 12, 1000 * keyword + p, at(o / 10)) for o, r, p in paging_cases(rng)]
    rows += [("search", "b", 50, 12, 120, 7, at(1))]  # its first page never comes
    rng.shuffle(rows)
    src = str(tmp_path / "pages")
    for part in range(4):
        spark.createDataFrame(rows[part::4], kinds).repartition(2).write.mode("append").parquet(src)
        if part % 2:
            pages = streams.file_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=2)
            streams.run_available(sequences.reached_pages(pages), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    batch = crawl.truncate_short_pages(spark.createDataFrame(rows, kinds))
    columns = ["location", "keyword_idx", "offset", "results", "page_id"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()), key=repr)
    assert got == sorted(map(tuple, batch.select(*columns).collect()), key=repr) and 10 < len(got) < len(rows)


def test_keywords_close(spark, tmp_path):
    """What waits is forgotten when the watermark has passed; a page that comes
    after that begins anew."""
    kinds = "kind string, location string, keyword_idx int, offset int, results int, page_id long, fetched_at timestamp"
    src, out = str(tmp_path / "pages"), str(tmp_path / "out")
    for part in (
        [("search", "a", 1, 120, 120, 1, at(0))], [("landing", "a", 0, 0, 1, 2, at(200))],
        [("search", "a", 1, 0, 120, 3, at(201)), ("landing", "a", 0, 0, 1, 4, at(400))],
    ):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(src)
        pages = streams.file_stream(spark, src, spark.read.parquet(src).schema)
        streams.run_available(sequences.reached_pages(pages), out, str(tmp_path / "checkpoint"))
    assert {r["page_id"] for r in spark.read.parquet(out).collect()} == {2, 3, 4}


def test_fresh_sightings_as_in_the_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for feed in range(12):
        pool = 1
        for n in range(1, rng.randint(4, 30)):
            if rng.random() < 0.2:
                continue
            for _ in range(rng.randint(1, 3)):
                pool += rng.random() < 0.2
                rows.append((feed, n, f"p{rng.randint(1, pool)}", at(n)))
    rng.shuffle(rows)
    kinds = "feed long, snapshot_no int, id string, seen_at timestamp"
    src, out = str(tmp_path / "seen"), str(tmp_path / "out")
    for part in (rows[::2], rows[1::2] + [(-1, 1, "", at(2000))]):
        spark.createDataFrame(part, kinds).repartition(2).write.mode("append").parquet(src)
        seen = streams.file_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
        streams.run_available(sequences.fresh_sightings(seen, delay="2 days"), out, str(tmp_path / "checkpoint"))
    batch = metrics.truncate_stale(spark.createDataFrame(rows, kinds))
    columns = ["feed", "snapshot_no", "id"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert got == sorted(map(tuple, batch.select(*columns).collect())) and 50 < len(got) < len(rows)


# --- counts -----------------------------------------------------------------


def test_stream_funnel_over_runs(spark, tmp_path):
    funnel, src, total = measures.StreamFunnel(), str(tmp_path / "pages"), 0
    assert funnel.counts() == {}
    spark.streams.addListener(funnel)
    try:
        for part, numbers in enumerate([range(1, 9), range(5, 15), range(0, 3)]):
            arrive(spark, src, [(part, "milwaukee", "s", at(part), None, search_page(numbers))])
            pages = streams.file_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
            listed = streams.stream_listings(pages, funnel=funnel)
            funnel.settle(streams.run_available(listed, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
            total += len(numbers)
            assert funnel.counts()["raw"] == total
    finally:
        spark.streams.removeListener(funnel)
    valid = spark.read.parquet(str(tmp_path / "out")).count()
    assert funnel.counts() == {"raw": 21, "url_unique": 15, "valid": valid} and valid == 14  # one costs $0


def test_yields_by_window(spark, tmp_path):
    kinds = "location string, keyword_idx int, offset int, fetched_at timestamp, url string"
    parts = [
        [("a", 1, 0, at(0.1), "u1"), ("a", 1, 0, at(0.1), "u2"), ("a", 1, 0, at(0.9), "u2"), ("b", 1, 0, at(0.2), "u1")],
        [("a", 2, 0, at(1.5), "u1"), ("a", 2, 0, at(1.6), "u3"), ("a", 1, 0, at(0.3), "u4")],
        [("z", 0, 0, at(100), "z")],
    ]
    src, out = str(tmp_path / "rows"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(src)
        rows = streams.file_stream(spark, src, spark.read.parquet(src).schema)
        streams.run_available(measures.page_yield_windows(rows), out, str(tmp_path / "checkpoint"))
    got = {(r["window_start"], r["location"], r["keyword_idx"]): (r["results"], r["new_results"]) for r in spark.read.parquet(out).collect()}
    assert got == {(at(0), "a", 1): (4, 3), (at(0), "b", 1): (1, 1), (at(1), "a", 2): (2, 1)}


def test_stream_posts_of_a_table_in_several_files(spark, tmp_path):
    from curbside.plans.queries import REGISTRY

    rows = [(n % 3, n, "user", f"text {n % 7}") for n in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.repartition(4).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    turns.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    written = next((tmp_path / "one").glob("*.parquet"))
    (tmp_path / "file" / "conversations.parquet").write_bytes(written.read_bytes())
    for kind in ("folder", "file"):
        got = REGISTRY["stream_posts"](spark, str(tmp_path / kind)).collect()
        assert sorted(r["text"] for r in got) == sorted({r[3] for r in rows})


def test_stream_listings_of_a_crawl_of_several_days(spark, tmp_path):
    """Pages far apart in time, in files whose order says nothing: none is late,
    and there are more files than lots."""
    from pathlib import Path

    from curbside.plans.queries import REGISTRY
    from curbside.session import shared_dir

    keys = [n * 997 for n in range(1800)]
    rows = [(k, f"name {k}", "PROMO", 1 + k % 50, "Brand#1") for k in keys]
    columns = "p_partkey long, p_name string, p_type string, p_size int, p_brand string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "part.parquet"))
    before = set(Path(shared_dir(spark)).glob("run-*"))
    got = sorted(r["url"] for r in REGISTRY["stream_listings"](spark, str(tmp_path)).collect())
    assert sorted(int(u.rsplit("/", 1)[1]) for u in got) == [k for k in keys if k % 389 != 5]
    run = (set(Path(shared_dir(spark)).glob("run-*")) - before).pop()
    assert len(list((run / "pages").glob("*.parquet"))) > 3
