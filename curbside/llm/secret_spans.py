"""Spans of likely secrets in texts.

Base rules find assignments, access keys and hex strings. Beyond them, strings
of key characters are scanned by the Shannon entropy of a sliding window, for
each class of characters with its own threshold; counts are kept up to date as
the window moves. An allow-list takes back what is known to be harmless.
"""

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import small_batches, struct_of, texts

# The base rules and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_NAMES = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX_LEAST = 16
# [0-9a-f]+ with 16 or more characters: runs are maximal, so the shorter ones
# can be left out by the pattern itself.
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)

KINDS = ("assign", "access", "hex", "entropy")

#: Strings that the entropy scan looks at.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Class of characters, least entropy in bits of a window of WINDOW of them.
CLASSES = (
    (frozenset("0123456789abcdefABCDEF"), 3.0),
    (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 3.5),
    (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.7),
)
#: Digits, and letters, that a window must have: words and numbers are neither.
LEAST_OF_EACH = 2
#: Harmless as a whole: identifiers with a fixed form.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}"),
    # A path of two or more names; a number stands at the end of a word only.
    re.compile(r"/?WORD([-_]WORD)*(/WORD([-_]WORD)*)+/?".replace("WORD", r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4})")),
)
#: Samples from manuals: the letters and digits joined to such a word, on each
#: side up to the length of a key, are no part of a hot window.
SAMPLE = re.compile(
    r"[A-Za-z0-9]{0,40}(?:example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh)[A-Za-z0-9]{0,40}", re.I | re.A
)
#: What ends a link, and what begins one.
LINK_END = re.compile(r"""[\s"'`,()\[\]{}<>|\\^]|(?<!&amp);""")
LINK = re.compile(r"//|www\.", re.I)
#: What the user and password of a link end with, or cannot hold.
USER_END = re.compile(r"""[\s/?#@"'`,()\[\]{}<>|\\^]""")

_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(string: str, letters: frozenset, least: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``string`` that lie in the class ``letters``,
    hold both digits and letters and reach the entropy ``least``."""
    found: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, digits, inside = 0.0, 0, 0
    for at, c in enumerate(string):
        if c not in letters:
            counts, total, digits, inside = {}, 0.0, 0, 0
            continue
        if inside == WINDOW:
            old = string[at - WINDOW]
            n = counts[old]
            total += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
            digits -= old.isdigit()
        else:
            inside += 1
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        digits += c.isdigit()
        if inside == WINDOW and LEAST_OF_EACH <= digits <= WINDOW - LEAST_OF_EACH:
            if math.log2(WINDOW) - total / WINDOW >= least - 1e-9:
                begin = at - WINDOW + 1
                if found and begin <= found[-1][1]:
                    found[-1] = (found[-1][0], at + 1)
                else:
                    found.append((begin, at + 1))
    return found


class Links:
    """Where the strings of one text stand in its links, asked from left to
    right. A link may be of any length: what is looked up moves on only."""

    def __init__(self, text: str):
        self.text = text
        self.marks = re.compile(f"(?P<start>{LINK.pattern})|{LINK_END.pattern}", re.I).finditer(text)
        self.mark = next(self.marks, None)
        self.start = None  # of the link that is open, if one is
        self.found: dict[str, int] = {}

    def _first(self, what: str, at: int) -> int:
        """Where the first ``what`` from ``at`` on stands."""
        place = self.found.get(what, -1)
        if place < at:
            place = self.text.find(what, at)
            self.found[what] = place = len(self.text) if place < 0 else place
        return place

    def _user_end(self, at: int) -> int:
        place = self.found.get("user end", -1)
        if place < at:
            m = USER_END.search(self.text, at)
            self.found["user end"] = place = m.start() if m else len(self.text)
        return place

    def harmless(self, begin: int, end: int) -> bool:
        """Whether ``begin`` to ``end`` is a part of a link other than its user,
        password or query."""
        while self.mark and self.mark.end() <= begin:
            self.start = self.mark if self.mark["start"] else None
            self.mark = next(self.marks, None)
        if not self.start:
            return False
        at = self.start.end()
        if min(self._first("?", at), self._first("#", at)) < begin:
            return False
        if self.start["start"] != "//" or self._first("/", at) < begin:
            return True
        head, slash, _ = self.text[begin:end].partition("/")
        if slash and (self._first(":", at) >= begin or head.isdigit()):  # a host or port, then the path
            return True
        place = self._user_end(end)
        return not (place < len(self.text) and self.text[place] == "@")


def allowed(text: str, begin: int, end: int, links: Links | None = None) -> bool:
    """Whether the allow-list covers the candidate at ``begin`` to ``end`` as a
    whole: by its form, or as a harmless part of a link."""
    if any(rule.fullmatch(text, begin, end) for rule in ALLOWED):
        return True
    return (links or Links(text)).harmless(begin, end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, kind as a place in KINDS."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    low = text.lower()
    if any(name in low for name in ASSIGN_NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(spans)


def _joined(spans) -> list[list[int]]:
    """Unions of (begin, end) in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entropy scan, without those that lie wholly
    inside the union of ``known``, which is in order."""
    spans = []
    covered = _joined((s, e) for s, _, e in known)
    links = Links(text)
    for m in CANDIDATE.finditer(text):
        string = m.group()
        if string.isalpha() or string.isdigit() or allowed(text, m.start(), m.end(), links):
            continue
        string = SAMPLE.sub(lambda s: "." * len(s.group()), string)
        for a, b in _joined(sorted(w for letters, least in CLASSES for w in hot_windows(string, letters, least))):
            begin, end = m.start() + a, m.start() + b
            at = bisect.bisect_right(covered, begin, key=lambda c: c[0]) - 1
            if at < 0 or covered[at][1] < end:
                spans.append((begin, 3, end))
    return spans


def find_secrets(text: str) -> tuple[list, list]:
    """Base spans, and all spans, each (start, kind, end) in order."""
    base = base_spans(text)
    more = entropy_spans(text, base)
    return base, sorted(base + more) if more else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, mark: str = "[secret]") -> str:
    """``text`` with every span, overlapping ones as one, written as ``mark``."""
    spans = find_secrets(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


_FOUND = [
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
]


@F.arrow_udf(struct_of(
    n_assign=T.LongType(), n_access=T.LongType(), n_hex=T.LongType(), base_sha256=T.StringType(), spans=T.StringType()
))
def scanned(text: pa.Array) -> pa.Array:
    rows = []
    for t in texts(text):
        base, spans = find_secrets(t)
        kinds = [kind for _, kind, _ in base]
        rows.append((
            kinds.count(0), kinds.count(1), kinds.count(2),
            hashlib.sha256(written(base).encode()).hexdigest(), written(spans),
        ))
    columns = list(zip(*rows)) or [()] * len(_FOUND)
    return pa.StructArray.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, _FOUND)], names=[name for name, _ in _FOUND]
    )


@F.arrow_udf(T.StringType())
def redacted(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redact(t) for t in text.to_pylist()], pa.string())


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    Null texts count as empty and have no spans; repeated rows give a row each;
    spans are in code points, end exclusive; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", scanned("text").alias("r")).select("doc_id", "r.*")


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in its texts marked out and n_chars, where
    there is such a column, counted anew. Null texts stay null; no row goes."""
    small_batches(docs.sparkSession)
    marked = docs.withColumn("text", redacted("text"))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked
