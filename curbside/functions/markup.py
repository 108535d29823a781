"""Helper that runs inside tasks: one page of HTML to the texts of a profile.

Spark has no HTML reader, so the tags are read in Python, in Arrow batches.
The helper only finds elements and returns their texts or attributes; all
rules about the values are column expressions on the result.
"""

import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table td th tr ul".split()
)
# An opening tag ends an open element of its own group, up to the container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "html", "body", "div", "section", "article"}


_EDGE = object()  # where a block element starts or ends


@dataclass(frozen=True)
class Field:
    """One value: the first match of the first selector that matches at all."""

    name: str
    selectors: tuple
    attr: str | None = None  # an attribute instead of the text
    drop: str | None = None  # first match inside is left out of the text
    many: bool = False  # texts of all matches
    lines: bool = False  # block elements start a new line


@dataclass(frozen=True)
class Profile:
    """What to take from a page; ``rows`` empty means one row for the page."""

    fields: tuple
    rows: tuple = ()


class _Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            if node is not self:
                yield node
            stack.extend(n for n in reversed(node.items) if isinstance(n, _Node))

    def texts(self, skip=None, lines=False):
        stack = self.items[::-1]
        while stack:
            item = stack.pop()
            if isinstance(item, str) or item is _EDGE:
                yield item
            elif lines and item.tag == "br":
                yield "\n"
            elif item is not skip and item.tag not in ("script", "style"):
                if lines and item.tag in BLOCK:
                    stack.append(_EDGE)
                    stack.extend(reversed(item.items))
                    stack.append(_EDGE)
                else:
                    stack.extend(reversed(item.items))

    def text(self, skip=None, lines=False):
        pieces = []
        for piece in self.texts(skip, lines):
            if piece is not _EDGE:
                pieces.append(piece)
            elif pieces and not pieces[-1].endswith("\n"):
                pieces.append("\n")
        return "".join(pieces)


class _TreeReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and tag != "br":
            self._close({"p"}, HOLDS)
        if tag in ENDS:
            self._close(ENDS[tag], HOLDS)
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if "class" in attrs:
            attrs["class"] = " ".join(attrs["class"].split())
        node = _Node(tag, attrs, self.here)
        self.here.items.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, ())

    def handle_data(self, data):
        self.here.items.append(data)

    def _close(self, tags, limits):
        node = self.here
        while node.parent is not None and node.tag not in limits:
            if node.tag in tags:
                self.here = node.parent
                return
            node = node.parent
        if node.tag in tags and node.parent is not None:
            self.here = node.parent


_STEP = re.compile(r'(?:[^\s,"\[]|\[(?:[^\]"]|"[^"]*")*\]|"[^"]*")+|,')
_PART = re.compile(
    r'(?P<tag>^[a-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)'
    r'|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)"(?P<val>[^"]*)")?\]|:has-text\("(?P<has>[^"]*)"\)'
)


@lru_cache(maxsize=None)
def _selector(text):
    alternatives, steps = [], []
    for step in _STEP.findall(text) + [","]:
        if step == ",":
            alternatives.append(steps)
            steps = []
        else:
            steps.append([m.groupdict() for m in _PART.finditer(step)])
    return alternatives


def _fits(node, step):
    for part in step:
        if part["tag"]:
            ok = node.tag == part["tag"]
        elif part["id"]:
            ok = node.attrs.get("id") == part["id"]
        elif part["cls"]:
            ok = part["cls"] in node.attrs.get("class", "").split()
        elif part["has"]:
            ok = part["has"].lower() in " ".join(node.text().lower().split())
        else:
            value = node.attrs.get(part["attr"])
            ok = value is not None and (
                part["op"] is None
                or (part["op"] == "=" and value == part["val"])
                or (part["op"] == "^=" and value.startswith(part["val"]))
                or (part["op"] == "*=" and part["val"] in value)
            )
        if not ok:
            return False
    return True


def _matches(node, alternatives):
    for steps in alternatives:
        if not _fits(node, steps[-1]):
            continue
        wanted, above = len(steps) - 2, node.parent
        while wanted >= 0 and above is not None:
            wanted -= _fits(above, steps[wanted])
            above = above.parent
        if wanted < 0:
            return True
    return False


def _select(nodes, selector):
    alternatives = _selector(selector)
    return (n for n in nodes if _matches(n, alternatives))


def _value(node, field, below):
    if field.many:
        return [n.text().strip() for s in field.selectors for n in _select(below, s)]
    found = next((n for s in field.selectors for n in _select(below, s)), None)
    if not field.selectors:
        found = node
    if found is None:
        return None
    if field.attr:
        return found.attrs.get(field.attr)
    skip = next(_select(found.walk(), field.drop), None) if field.drop else None
    return found.text(skip, field.lines).strip()


def _tree(html):
    reader = _TreeReader()
    reader.feed(html)
    reader.close()
    return reader.root


def _records(root, profile, below=None):
    """Rows of one tree; ``below``: its nodes, where they are listed already.
    Fields of one row share the list of its nodes."""
    below = list(root.walk()) if below is None else below
    if not profile.rows:
        return [{f.name: _value(root, f, below) for f in profile.fields}]
    nodes = next((r for r in (list(_select(below, s)) for s in profile.rows) if r), [])
    inner = ((n, list(n.walk())) for n in nodes)
    return [{f.name: _value(n, f, own) for f in profile.fields} for n, own in inner]


def read_page(html, profile):
    """Rows of one page as dictionaries."""
    return _records(_tree(html), profile)


def _kinds(profile: Profile) -> tuple[pa.DataType, str]:
    """Type of what a profile finds in a page, for Arrow and as text."""
    row = pa.struct([(f.name, pa.list_(pa.string()) if f.many else pa.string()) for f in profile.fields])
    fields = ", ".join(f"{f.name}: {'array<string>' if f.many else 'string'}" for f in profile.fields)
    return pa.struct([("rows", pa.list_(row)), ("error", pa.string())]), f"struct<rows: array<struct<{fields}>>, error: string>"


def html_profiles(html: Column, profiles: dict[str, Profile]) -> Column:
    """A struct with ``struct<rows, error>`` for each profile: a page is parsed
    once for all of them. No rows for an empty page; a page that cannot be read
    yields the reason in ``error`` and no rows."""
    kinds = {name: _kinds(profile) for name, profile in profiles.items()}

    def read(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages:
            text = page.as_py()
            found = {name: {"rows": [], "error": None} for name in profiles}
            if text:
                root, below, problem = None, None, None
                try:
                    root = _tree(text)
                    below = list(root.walk())
                except Exception as e:
                    problem = e
                for name, profile in profiles.items():
                    try:
                        if problem:
                            raise problem
                        found[name]["rows"] = _records(root, profile, below)
                    except Exception as e:
                        found[name]["error"] = f"{type(e).__name__}: {e}"
            out.append(found)
        return pa.array(out, type=pa.struct([(name, arrow) for name, (arrow, _) in kinds.items()]))

    # Marked as not deterministic: otherwise the optimizer derives a filter from
    # the explode that follows and reads every page a second time for it.
    reader = F.arrow_udf(read, "struct<" + ", ".join(f"{name}: {text}" for name, (_, text) in kinds.items()) + ">")
    return reader.asNondeterministic()(html)


def html_rows(html: Column, profile: Profile) -> Column:
    """``struct<rows, error>`` of each page, by one profile."""
    return html_profiles(html, {"page": profile})["page"]
