"""Main text of web pages: structure, and passages that a host repeats.

A page is cut into blocks. Blocks in menus, headers, footers and the like are
labelled and never kept. Where a page marks its article, the article's other
blocks are its text. Blocks that the markup leaves open are judged by what the
host repeats: token streams of all blocks outside articles go, host by host and
in chunks, through suffix arrays; runs of LEAST or more tokens that stand on
distinct pages are boilerplate, and the unique runs between them stay.

One host may hold a third of all pages, so no task gets a whole host: a chunk's
suffix array finds the repeats inside the chunk and hands on the openings
(LEAST tokens, hashed) of its suffixes, from which one aggregation over the host
finds what repeats between chunks.
"""

import html as html_lib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import small_batches, struct_of, texts
from curbside.llm.url_lists import host_of
from curbside.session import cut_lineage

#: Tokens of the shortest run that counts as repeated.
LEAST = 8
#: Pages of one host in a chunk, in the mean.
CHUNK_PAGES = 2000

# The elements and names that mark what is not main text.
DROPPED = frozenset(
    "script style noscript template head nav footer aside form button select option textarea input iframe svg canvas "
    "object audio video dialog menu".split()
)
SCOPES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"))
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "notice notices alert popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "topbar footer comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup "
    "login search toolbar widget pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

#: Elements that hold a paragraph or a heading, not other blocks: parts of their
#: names ("market-share") say what they are about, whole names what they are for.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption summary".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())
#: Raw elements that a browser, too, takes for closed at the end of their tag.
SELF_CLOSED = frozenset(("svg", "iframe"))

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)|[^<]+|<", re.S
)
UNQUOTED = re.compile(r"[^<>\"']*")
MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Za-z0-9]+")
#: What an end tag may close at most, and what a start tag closes by itself.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
FENCES = frozenset("ul ol dl table article main section div body html aside nav footer header form".split())

ARTICLE, OPEN, LABELLED = 0, 1, 2

#: Open elements that an end tag, or a start tag that closes others, looks back at.
DEPTH = 128

#: How firmly an element is left out: not at all; unless an article or main
#: begins inside it; unless a main does; with all that it holds.
KEPT, SOFT, FIRM, HARD = 0, 1, 2, 3


def tag_end(page: str, at: int) -> tuple[int, int]:
    """Where the attributes end that begin at ``at``, and where the tag does. A
    quote opens a value only behind an equals sign, and only if it is closed
    before another tag seems to begin; a tag that is never closed ends where the
    next one begins. Every character is looked at a bounded number of times."""
    while True:
        m = UNQUOTED.match(page, at)
        at = m.end()
        if at == len(page) or page[at] == "<":
            return at, at
        quote = page[at]
        if quote == ">":
            return at, at + 1
        if m[0].rstrip().endswith("="):
            end = page.find(quote, at + 1)
            closed = page.find(">", at + 1, end) if end >= 0 else 0
            if closed < 0 or end >= 0 and page.find("<", closed, end) < 0:
                at = end
        at += 1


def firmness(tag: str, attributes: str, in_scope: bool) -> int:
    """How firmly the element is left out, by its tag, role, classes and id."""
    found = KEPT
    if tag in DROPPED:
        found = SOFT if tag == "form" else HARD
    elif tag == "header" and not in_scope:
        found = FIRM
    if found == HARD or not attributes or tag in ("html", "body") or tag in SCOPES and not in_scope:
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id"):
            whole = value.lower().split()
            parts = {w for token in whole for w in NAME.findall(token)}
            if any(token in NAMES for token in whole):
                found = max(found, FIRM)
            elif not (in_scope and tag in TEXT_BLOCKS) and parts & NAMES:
                found = max(found, FIRM if parts & COMMENTS else SOFT)
        elif name == "role" and value.strip().lower() in ROLES:
            found = max(found, SOFT if value.strip().lower() == "form" else HARD)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HARD
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HARD
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order, none of them empty.

    An article or main, wherever it begins, ends what its wrappers left out by
    a part of their names or as forms; a main also what they left out by a whole
    name. Nothing begins in menus, asides, footers or what is hidden.
    """
    out: list[tuple[int, str]] = []
    # Open elements, each with the state outside it: how firmly its inside is
    # left out, whether that is by the header of an article alone, scopes.
    stack: list[tuple[str, int, bool, int]] = []
    level, by_header, scopes = KEPT, False, 0
    parts: list[str] = []
    kind = OPEN
    unclosed: set[str] = set()

    def flush():
        nonlocal parts
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts = []

    at, size = 0, len(page)
    while at < size:
        m = PIECE.match(page, at)
        at = m.end()
        tag, ends = m[2], bool(m[1])
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
            continue
        tag = tag.lower()
        attributes_end, behind = tag_end(page, at)
        attributes, at = page[at:attributes_end], behind
        block = tag in BLOCKS or tag in DROPPED
        if not block and not ends:
            # Inline: only what hides its content matters.
            if tag == "br":
                parts.append(" ")
                continue
            if tag in VOID:
                continue
            if not attributes or not firmness(tag, attributes, scopes > 0):
                stack.append((tag, level, by_header, scopes))
                continue
        if ends and not block and not (stack and stack[-1][0] == tag and stack[-1][1] != level):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                if stack[k][0] == tag:
                    if stack[k][1] != level:
                        flush()
                    level, by_header, scopes = stack[k][1:]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        else:
            flush()
            if ends:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                    if stack[k][0] == tag:
                        level, by_header, scopes = stack[k][1:]
                        del stack[k:]
                        break
                    if stack[k][0] in FENCES and tag not in FENCES:
                        break
            else:
                closing = CLOSES.get(tag, ()) + (("p",) if tag in BLOCKS else ())
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                    if stack[k][0] in closing:
                        level, by_header, scopes = stack[k][1:]
                        del stack[k:]
                    elif stack[k][0] in FENCES:
                        break
                own_end = attributes.rstrip().endswith("/")
                if tag not in VOID and not own_end:
                    stack.append((tag, level, by_header, scopes))
                    is_main = tag == "main" or bool(MAIN_ROLE.search(attributes))
                    found = firmness(tag, attributes, scopes > 0)
                    if (is_main or tag == "article") and found == KEPT:
                        if level <= (FIRM if is_main else SOFT):
                            level, by_header = KEPT, False
                        scopes += 1
                    elif found:
                        level, by_header = max(level, found), False
                    elif tag == "header" and level == KEPT:
                        level, by_header = FIRM, True
                    elif tag in HEADINGS and by_header:
                        level, by_header = KEPT, False
                if tag in RAW and not (own_end and tag in SELF_CLOSED) and tag not in unclosed:
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    if end:
                        at = end.start()
                    elif tag in ("script", "style"):
                        at = size
                    else:  # never closed: it ends at once, and so do all after it
                        unclosed.add(tag)
                if tag in unclosed and stack and stack[-1][0] == tag:
                    level, by_header, scopes = stack.pop()[1:]
        if not parts:
            kind = LABELLED if level else ARTICLE if scopes else OPEN
    flush()
    return out


@F.arrow_udf(struct_of(article=T.StringType(), kinds=T.ArrayType(T.ByteType()), outside=T.ArrayType(T.StringType())))
def parsed(html: pa.Array) -> pa.Array:
    """The article's text, null where the page marks none, and the blocks
    outside it with their kinds."""
    article, kinds, outside = [], [], []
    for page in texts(html):
        blocks = blocks_of(page)
        inside = [t for k, t in blocks if k == ARTICLE]
        article.append("\n\n".join(inside) if inside else None)
        rest = [(k, t) for k, t in blocks if k != ARTICLE]
        kinds.append([k for k, _ in rest])
        outside.append([t for _, t in rest])
    return pa.StructArray.from_arrays(
        [pa.array(article, pa.string()), pa.array(kinds, pa.list_(pa.int8())), pa.array(outside, pa.list_(pa.string()))],
        names=["article", "kinds", "outside"],
    )


# --- what hosts repeat ------------------------------------------------------


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``tokens`` in order of their first ``depth`` tokens or more,
    and the rank of each suffix, equal for equal openings: prefix doubling."""
    _, rank = np.unique(tokens, return_inverse=True)
    length = 1
    while length < depth:
        # The second half starts so that exactly ``depth`` is reached at last.
        step = min(length, depth - length)
        behind = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)])[: len(rank)]
        _, rank = np.unique(rank.astype(np.int64) * (len(tokens) + 2) + behind, return_inverse=True)
        length += step
    return np.argsort(rank, kind="stable"), rank


def repeated_places(rank: np.ndarray, order: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Whether the opening at each place stands on another page as well."""
    sorted_rank, sorted_page = rank[order], page[order]
    first = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])
    low = np.minimum.reduceat(sorted_page, first)
    high = np.maximum.reduceat(sorted_page, first)
    group = np.cumsum(np.r_[False, sorted_rank[1:] != sorted_rank[:-1]])
    out = np.zeros(len(rank), bool)
    out[order] = (low != high)[group]
    return out


def _hash(words) -> np.ndarray:
    known: dict[str, int] = {}
    out = np.empty(len(words), np.int64)
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode()) >> 1
        out[k] = h
    return out


def openings(tokens: np.ndarray) -> np.ndarray:
    """A hash of the LEAST tokens from each place on, wrapping as integers do."""
    out = np.zeros(max(0, len(tokens) - LEAST + 1), np.uint64)
    for k in range(LEAST):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + len(out)].astype(np.uint64)
    return out.view(np.int64)


def _chunk(table: pa.Table) -> pa.Table:
    """One chunk of a host: for each page its openings as (opening, repeated
    within the chunk), one row for each distinct opening of the chunk."""
    streams = [_hash(" ".join(blocks).split()) for blocks in table.column("outside").to_pylist()]
    pages = table.column("page").to_pylist()
    # A separator that no other page has keeps runs from crossing pages.
    gap = [np.array([-k - 1]) for k in range(len(streams))]
    tokens = np.concatenate([x for s, g in zip(streams, gap) for x in (s, g)])
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    _, names = np.unique(np.array(pages, dtype=object).astype(str), return_inverse=True)
    order, rank = suffix_order(tokens, LEAST)
    again = repeated_places(rank, order, names[page])
    hashed = np.concatenate([np.r_[openings(s), np.zeros(len(s) + 1 - max(0, len(s) - LEAST + 1), np.int64)] for s in streams])
    whole = np.concatenate([np.arange(len(s) + 1) < len(s) - LEAST + 1 for s in streams])
    values, first = np.unique(hashed[whole], return_index=True)
    host = table.column("host")[0].as_py()
    return pa.table({
        "host": pa.array([host] * len(values), pa.string()),
        "opening": pa.array(values, pa.int64()),
        "again": pa.array(again[whole][first], pa.bool_()),
        "page": pa.array([pages[k] for k in page[whole][first]], pa.string()),
    })


def host_repeats(outside: DataFrame, pages_per_host: DataFrame) -> DataFrame:
    """(host, opening) of what stands on two or more pages of a host.

    ``outside``: host, page, outside; hosts with more than CHUNK_PAGES pages
    are dealt out in chunks, by a hash of the page.
    """
    chunk = F.pmod(F.xxhash64("page"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = outside.join(pages_per_host, "host", "left").select("host", chunk.alias("chunk"), "page", "outside")
    # Dealt anew: the join has all pages of a host in one place.
    dealt = dealt.repartition("host", "chunk")
    kind = "host string, opening long, again boolean, page string"
    found = dealt.groupBy("host", "chunk").applyInArrow(_chunk, kind)
    total = found.groupBy("host", "opening").agg(
        F.max("again").alias("again"), F.min("page").alias("low"), F.max("page").alias("high")
    )
    return total.where("again or low <> high").select("host", "opening")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _openings(outside: pa.Array) -> pa.Array:
    return pa.array([openings(_hash(" ".join(b).split())).tolist() for b in outside.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.StringType())
def _unique_runs(kinds: pa.Array, outside: pa.Array, repeated: pa.Array) -> pa.Array:
    """Open blocks without the tokens that repeated openings cover: stretches
    of LEAST tokens or more, and whole blocks; shorter stretches are where a
    repeated run of other blocks ends."""
    out = []
    for ks, blocks, known in zip(kinds.to_pylist(), outside.to_pylist(), repeated.to_pylist()):
        words = [b.split() for b in blocks]
        stream = [w for ws in words for w in ws]
        covered = np.zeros(len(stream) + 1, np.int64)
        hits = np.flatnonzero(np.isin(openings(_hash(stream)), np.array(known or [], np.int64)))
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + LEAST, -1)
        covered = np.cumsum(covered)[:-1] > 0
        kept, at = [], 0
        for k, ws in zip(ks, words):
            own = covered[at : at + len(ws)].copy()
            at += len(ws)
            if k != OPEN:
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a < min(LEAST, len(ws)):  # the end of a run of other blocks
                    own[a:b] = False
            left = [w for w, c in zip(ws, own) if not c]
            if left:
                kept.append(" ".join(left))
        out.append("\n\n".join(kept))
    return pa.array(out, pa.string())


#: Pages that this does not match mark no article.
MARKED = r"(?i)<(article|main)[\s/>]|role\s*=\s*[\"']?main"


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    Null and empty html have the empty text. White space, also coded as a
    reference, becomes one space. Pages with equal url and html count as one
    page in what a host repeats, so repeated rows do not take each other's
    text away; a null url is a host of its own. Markup may be broken: unclosed
    elements end where the next block does or at the end of the page.
    """
    small_batches(pages.sparkSession, 500)
    page = F.md5(F.concat_ws("\x00", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).cast("binary"))
    rows = pages.select("page_id", "url", "html")
    seen = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), page.alias("page"), parsed("html").alias("p"))
    # The article texts are not needed here; what is outside them is small.
    outside = cut_lineage(seen.select(
        "page_id", "url", "host", "page", F.col("p.article").isNotNull().alias("marked"),
        F.col("p.kinds").alias("kinds"), F.col("p.outside").alias("outside"),
    ))
    unmarked = outside.where(~F.col("marked"))
    # Repeats matter where a page of the host leaves blocks open; a page stored
    # several times is one page.
    open_hosts = cut_lineage(unmarked.where(F.size("outside") > 0).select("host").distinct())
    some = outside.where(F.size("outside") > 0).join(open_hosts, "host", "left_semi")
    some = cut_lineage(some.select("host", "page", "marked", "kinds", "outside").dropDuplicates(["page"]))
    large = some.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_PAGES)
    large = cut_lineage(large.select("host", F.ceil(F.col("n") / CHUNK_PAGES).cast("int").alias("chunks")))
    repeats = cut_lineage(host_repeats(some.select("host", "page", "outside"), large))
    open_pages = some.where(~F.col("marked"))
    held = open_pages.select("host", "page", F.explode(F.array_distinct(_openings("outside"))).alias("opening"))
    known = held.join(repeats, ["host", "opening"]).groupBy("page").agg(F.collect_list("opening").alias("repeated"))
    unique = cut_lineage(
        open_pages.join(known, "page", "left").select("page", _unique_runs("kinds", "outside", "repeated").alias("open_text"))
    )
    judged = unmarked.select("page_id", "url", "page").join(unique, "page", "left")
    judged = judged.select("page_id", "url", F.coalesce("open_text", F.lit("")).alias("text"))
    # Only pages whose html names an article at all are read again for its text.
    marked = rows.where(F.coalesce("html", F.lit("")).rlike(MARKED)).select("page_id", "url", parsed("html")["article"].alias("text"))
    return marked.where("text is not null").unionByName(judged).withColumn("n_chars", F.length("text").cast("long"))
