"""Token files, top-k search, URL lists, main text."""

import datetime
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import ODD, documents
from tokenizers import Tokenizer

from curbside.llm import main_text, topk, url_lists, wavelet

# --- token files ------------------------------------------------------------


def expected_files(rows):
    coder = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCABULARY))
    coded = [(i, coder.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    out, start = [], 0
    for i, ids in coded:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rng = random.Random(1)
    rows = [(k * 3, " ".join(rng.choice(["the", "Über", "cat!", "12 3", "\n"]) for _ in range(rng.randint(0, 300)))) for k in range(200)]
    for chars in (1 << 20, 2000):
        out = wavelet.token_files(documents(spark, rows), range_chars=chars)
        assert sorted(map(tuple, out.collect())) == expected_files(rows)
    odd = wavelet.token_files(documents(spark, ODD).selectExpr("*", "1 as range", "2 as file"), range_chars=50_000)
    assert sorted(map(tuple, odd.collect()), key=repr) == sorted(expected_files(ODD), key=repr)
    assert wavelet.token_files(documents(spark, [])).count() == 0


def test_matrix_answers_like_the_array():
    rng = np.random.default_rng(2)
    for size, top in ((0, 1), (1, 2), (64, 3), (1000, 50_000), (4097, 7)):
        ids = rng.integers(0, top, size).astype("<u2")
        names, sizes, matrix = wavelet.from_file(wavelet.to_file([None, 5], [size, 0], ids))
        assert names == [None, 5] and sizes.tolist() == [size, 0]
        assert (matrix.all_ids() == ids).all() and (matrix.access(np.arange(size)) == ids).all()
        for value in {0, 6, 70_000, *ids[:5].tolist()}:
            places = np.flatnonzero(ids == value)
            assert matrix.count(value) == len(places)
            assert matrix.count(value, size // 3, size // 2) == (ids[size // 3 : size // 2] == value).sum()
            assert [matrix.select(value, k) for k in range(len(places) + 1)] == places.tolist() + [-1]


def test_words_are_the_librarys():
    """Marks, cases, scripts, white space; memories so small that they turn."""
    path = public_tokenizers.path(wavelet.VOCABULARY)
    library, coder = Tokenizer.from_file(path), wavelet.WordCoder(path, words=40, pieces=15)
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("abcABC'sStT 019.,<|>_é ßÄü你😀\t\n\u00a0ªıİ-") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(coder.words) <= 40 and len(coder.pieces) <= 15
    coder.encode(["x" * 100_000])
    assert max(map(len, {**coder.words, **coder.words.old})) <= wavelet.KNOWN_CHARS


def library_ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCABULARY))
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_letters_whose_small_one_is_phonetic():
    """Every character that is not left to the library, between letters."""
    coder = wavelet.WordCoder(public_tokenizers.path(wavelet.VOCABULARY))
    texts = [f"a{chr(k)}b{chr(k)}{chr(k)} {chr(k)}'s1" for k in [*range(9, 14), *range(28, 0x7F), *range(0xC0, 0x250)]]
    texts += ["Əli", "ƎƏƐ", "Ⱥx Ⱦ Ʉ"]
    assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(texts)] == library_ids(texts)


def test_different_words_of_a_column_are_coded_once():
    """Whatever the memory holds, and however often and in whatever case words come."""
    coder = wavelet.WordCoder(public_tokenizers.path(wavelet.VOCABULARY), words=1, pieces=1)
    made = []
    for known in (coder.words, coder.pieces):
        known.make = lambda key, make=known.make: made.append(key) or make(key)
    texts = ["Red green, blue red\u00a0green \U0001f600 x " * 50] * 20
    assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(texts)] == library_ids(texts)
    assert len(made) == len(set(made)) <= 8


def test_columns_of_texts():
    coder = wavelet.WordCoder(public_tokenizers.path(wavelet.VOCABULARY))
    whole = ["cut off", None, "", " \n", "\u00a0", "two words", "😀 <|endoftext|>x", None]
    for kind in (pa.string(), pa.large_string()):
        for part in (whole, whole[:0], [None], ["", ""], ["\u00a0"], ["😀"], ["a"]):
            column = pa.array(["before it", *part, "behind"], kind)[1:-1]
            ids, ends = coder.encode_column(column, [1])
            assert [p.tolist() for p in np.split(ids, ends)[:-1]] == [i + [1] for i in library_ids(part)]
            assert len(ends) == len(part) and ids.dtype == np.dtype("<u2")


# --- top-k ------------------------------------------------------------------


def brute_top(rows, k):
    whole = [
        (i, [math.floor(float(np.float32(x)) * 64) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (q, a) in enumerate(whole):
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return table.selectExpr("*", "1 as v", "2 as nth", "3 as q").repartition(3)


def test_top_k_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(150)]
    rows += [(k, [0.5] * 6) for k in range(150, 200)]  # many ties
    rows += [(5, [0.1] * 6), (7, [0.5] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (210, None), (215, [1.0, None]), (220, [float("nan")] * 6),
             (225, [float("inf"), 1.0]), (230, []), (235, [2.0]), (240, [30.0] * 6)]
    out = topk.top_k(vectors(spark, rows), "vec_id % 5 = 0", 20)
    assert sorted(map(tuple, out.collect())) == brute_top(rows, 20)


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(20, [1.0]), (20, [2.0]), (21, [3.0])]
    want = [(20, 1, 21, 64 * 192), (20, 1, 21, 128 * 192), (20, 2, 20, 64 * 128), (20, 2, 20, 64 * 128)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows), "vec_id % 5 = 0").collect())) == sorted(want)


def test_top_k_of_few(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows), "vec_id % 5 = 0").collect())) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    assert topk.top_k(vectors(spark, rows[:1]), "vec_id % 5 = 0").count() == 0
    assert topk.top_k(vectors(spark, []), "vec_id % 5 = 0").count() == 0


# --- URL lists --------------------------------------------------------------


def day(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)


def plain_decision(url, time, entries):
    if url is None or time is None or "://" not in url:
        return ("allow", None, None)
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    path = "/" + rest.split("?")[0].split("#")[0].partition("/")[2]
    best = None
    for pattern in {p.lower() for p, _, d in entries if p is not None and d is not None}:
        parts = [s for s in path.split("/") if s]
        near = host == pattern or host.endswith("." + pattern)
        near = near or any(pattern == "/".join([host, *parts[:n]]) for n in range(1, len(parts) + 1))
        if not near:
            continue
        past = {}
        for p, action, d in entries:
            if p is not None and p.lower() == pattern and d is not None and d <= time and action in url_lists.ACTIONS:
                past[d] = max(past.get(d, 0), url_lists.ACTIONS.index(action))
        if past and past[max(past)] > 0:
            here = (len(pattern), pattern, url_lists.ACTIONS[past[max(past)]], max(past))
            best = max(best, here) if best else here
    return (best[2], best[1], best[3]) if best else ("allow", None, None)


def test_decisions_like_plain_python(spark):
    rng = random.Random(5)
    hosts = ["a.b.test", "b.test", "test", "x.b.test", "other.example"]
    entries = [
        (rng.choice(hosts) + rng.choice(["", "", "/p", "/p/q"]), rng.choice([*url_lists.ACTIONS, "unknown"]), day(rng.randint(0, 400)))
        for _ in range(120)
    ] + [(None, "block", day(1)), ("test", "block", None), ("B.test", "block", day(7)), ("b.test", "allow", day(7))]
    captures = [
        (k, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts).upper()}{rng.choice(['', ':80'])}"
            f"{rng.choice(['', '/', '/p', '/p/q/r', '/p?x=/q', '/pp'])}", day(rng.randint(-10, 450)))
        for k in range(300)
    ] + [(900, None, day(3)), (901, "https://b.test/", None), (902, "no url", day(9)), (903, "https://b.test/", day(50)), (903, "https://b.test/", day(50))]
    table = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").selectExpr("*", "'x' as pattern", "1 as month", "2 as action")
    lists = spark.createDataFrame(entries, "pattern string, action string, dated timestamp").selectExpr("*", "1 as strength")
    out = url_lists.decide(table, lists)
    got = sorted(((r["page_id"], r["url"], r["fetched_at"], r["decision"], r["pattern"], r["listed_since"]) for r in out.collect()), key=repr)
    expected = sorted(((*c, *plain_decision(c[1], c[2], entries)) for c in captures), key=repr)
    assert got == expected
    assert url_lists.decide(table, lists.where("false")).where("decision = 'allow'").count() == len(captures)
    assert url_lists.decide(table.where("false"), lists).count() == 0


def test_paths_of_entries_keep_their_capitals(spark):
    lists = spark.createDataFrame([("Example.com/Docs", "block", day(0))], "pattern string, action string, dated timestamp")
    urls = ["https://example.com/Docs/x", "https://EXAMPLE.com/Docs", "https://example.com/docs/x", "https://example.com/"]
    table = spark.createDataFrame([(u, day(1)) for u in urls], "url string, fetched_at timestamp")
    got = {r["url"]: (r["decision"], r["pattern"]) for r in url_lists.decide(table, lists).collect()}
    assert got == {u: ("block", "example.com/Docs") if "/Docs" in u else ("allow", None) for u in urls}


# --- main text --------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><div class="ad">Buy</div>
<article><header><h2>Head &amp; line</h2><p>By X</p></header><p>One<b>two</b>
 three&nbsp;four<p>Next<br>line <!-- note --> on<div class="comments"><p>Nice!</p></div><aside>Side</aside>
<form><p>Name</p></form><ul><li>item 1<li>item 2</ul>tail &am</article><div id="cookie-notice">Cookies</div><footer>&copy; us</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as page", "1 as host", "2 as p").repartition(3)


def test_article_by_structure():
    inside = [t for k, t in main_text.blocks_of(PAGE) if k == main_text.ARTICLE]
    assert inside == ["Head & line", "Onetwo three four", "Next line on", "item 1", "item 2", "tail &am"]


ARTICLE = "<article><h1>T</h1><p>Body</p></article>"


@pytest.mark.parametrize("page,want", [
    (f'<div class="layout has-sidebar">{ARTICLE}</div>', ["T", "Body"]),
    (f'<form id="aspnetForm"><main>{ARTICLE}</main></form>', ["T", "Body"]),
    (f'<div id="search"><main>{ARTICLE}</main></div>', ["T", "Body"]),
    (f'<nav>{ARTICLE}</nav><div class="comments">{ARTICLE}</div><aside>{ARTICLE}</aside><div class="reader-comments">{ARTICLE}</div>', []),
    (f'<div hidden>{ARTICLE}</div><div class="sidebar">{ARTICLE}</div><div role="complementary">{ARTICLE}</div>', []),
    ('<article><p class="market-share">a</p><p id="search-results">b</p><h2 id="comment-on-method">c</h2>'
     '<p class="notice-theorem">d</p><p class="notice">no</p><div class="share-buttons">no</div></article>', ["a", "b", "c", "d"]),
    ('<article><p>a<svg viewBox="0"/>b</p><iframe src="x"/><p>c</p></article>', ["a", "b", "c"]),
    ("<article><noscript><p>a</p><textarea>b</article>", ["a", "b"]),
    ("<article><svg><text>no</text></svg><iframe>no</iframe><p>a</p></article>", ["a"]),
    ("<article><p title=\"it's>one</p><p title='a > b'>two</p><p x\"y>three</p><p data-x=\"a<b>c\">four</p></article>", ["one", "two", "three", "four"]),
    ("<main><header><div><h1>Title</h1><p>by me</p></div></header><p>x</p></main>", ["Title", "x"]),
    ("<article><header><h1>H</h1><span>by me</span></header><p>x</p><footer>f</footer></article>", ["H", "x"]),
])
def test_wrappers_and_broken_markup(page, want):
    assert [t for k, t in main_text.blocks_of(page) if k == main_text.ARTICLE] == want


@pytest.mark.parametrize("piece", [
    '<p title="x" ', '<p title="x ', "<p title='", "<svg ", "<svg>", "<noscript>", '<p a="x>y', "<", "<p>", "<h1>", "<div class=ad>",
    "<b></i>", "<li><b></ul>", "<section></p>", "<!--", "<![CDATA[", "</", "<title></titles>", "<a ='",
])
def test_markup_that_never_ends(piece):
    """A megabyte of it takes seconds, whatever is left open."""
    begin = time.process_time()
    main_text.blocks_of(piece * (1_000_000 // len(piece)))
    assert time.process_time() - begin < 20


def test_main_text_rows(spark):
    shared = "welcome to this site of ours please read all of our rules with care"
    rows = [(1, "http://h.test/1", PAGE), (1, "http://h.test/1", PAGE), (2, "http://h.test/2", None), (3, None, ""), (None, "http://h.test/4", "<p>alone")]
    rows += [(10 + k, f"http://g.test/{k}", f"<div>{shared}</div><p>own words {k}<p>{shared} and {k}</p><nav>{shared}</nav>") for k in range(4)]
    rows += [(20, "http://other.test/", f"<div>{shared}</div>"), (21, "http://h.test/21", "<!-- <article> --><p>plain</p>")]
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.main_texts(pages(spark, rows)).collect()), key=repr)
    whole = "\n\n".join(["Head & line", "Onetwo three four", "Next line on", "item 1", "item 2", "tail &am"])
    texts = {1: whole, 2: "", 3: "", None: "alone", 20: shared, 21: "plain"} | {10 + k: f"own words {k}\n\n{k}" for k in range(4)}
    assert out == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=repr)
    assert main_text.main_texts(pages(spark, [])).count() == 0


def test_chunks_of_a_host_agree(spark, monkeypatch):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(12)) for _ in range(15)]
    rows = [(k, f"http://h.test/{k}", "".join(f"<p>{rng.choice(lines)}</p><p>page {k} part {n}</p>" for n in range(3))) for k in range(60)]
    one = sorted(map(tuple, main_text.main_texts(pages(spark, rows)).collect()))
    monkeypatch.setattr(main_text, "CHUNK_PAGES", 5)
    assert sorted(map(tuple, main_text.main_texts(pages(spark, rows)).collect())) == one
    counts = {line: len({k for k, _, h in rows if line in h}) for line in lines}
    for k, _, text, _ in one:
        assert f"page {k} part 0" in text
        assert not any(line in text for line in lines if counts[line] > 1)


def test_suffix_order_groups_openings():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 300)
    order, rank = main_text.suffix_order(tokens, 5)
    opening = [tuple(tokens[k : k + 5]) for k in range(len(tokens))]
    assert [opening[k] for k in order] == sorted(opening)
    assert all((rank[a] == rank[b]) == (opening[a] == opening[b]) for a in range(0, 300, 7) for b in range(300))
