"""Licence notices in texts, by the Dice coefficient over word bigrams.

A text is cut into clauses and lines. Every stretch of them is a segment, list
numbers, stray lines and all; it is compared with a template unless the numbers
of their bigrams already rule out the least coefficient. The stretches of one
beginning are compared together: a bigram counts in all of them but those in
which the template's number of it is used up before. Of each beginning only the
best stretch waits to be taken, and a shorter one when that is no longer free.
"""

import heapq
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import small_batches, texts
from curbside.llm.license_full_texts import FULL_TEXTS
from curbside.llm.license_texts import TEMPLATES

WORD = re.compile(r"\w+")
UNIT_END = re.compile(r"\n+|(?<=[.!?;:,])\s+")
#: Notices and full texts.
ALL_TEMPLATES = {name: TEMPLATES.get(name, []) + FULL_TEXTS.get(name, []) for name in {**TEMPLATES, **FULL_TEXTS}}
#: Least Dice coefficient of a match.
DICE = 0.8


def bigrams(words: list[str]) -> Counter:
    """Word bigrams with their counts; of one word, the word alone."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter(map(tuple, [words] if words else []))


def normalised(text: str) -> list[str]:
    return WORD.findall(text.lower())


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / max(1, a.total() + b.total())


class _Beginnings:
    """The stretches of a text that reach the least coefficient with one
    template, by the unit in which they begin. A key is (coefficient, negated,
    - number of words, first word, name), in the order of preference."""

    def __init__(self, row: tuple, words: list[str], edges: list[int], least: float):
        self.name, grams, self.total = row
        self.edges, self.least = np.array(edges), least
        self.single = all(len(g) == 1 for g in grams)
        if self.single:
            (self.word,) = next(iter(grams))
            self.words = words
            return
        # Of each bigram of the text: whether the template has it, and where the
        # one stands after which its number in the template is used up.
        pairs = list(zip(words, words[1:]))
        self.used_up = np.full(len(pairs), len(words), np.int64)  # never counts
        places = defaultdict(list)
        for at, gram in enumerate(pairs):
            wanted = grams.get(gram)
            if wanted:
                own = places[gram]
                self.used_up[at] = own[-wanted] if len(own) >= wanted else -1
                own.append(at)
        lacking = np.concatenate([[0], np.cumsum(self.used_up == len(words))])
        begins, ends = self.edges[:-1], self.edges[1:]
        near = (ends - begins == 1) | (
            lacking[ends - 1] - lacking[begins] <= self.total * 2 * (1 - least) / least + 1e-9
        )
        # Of each unit, the next one that no match may hold.
        self.stop = np.full(len(near) + 1, len(near))
        for k in range(len(near) - 1, -1, -1):
            self.stop[k] = self.stop[k + 1] if near[k] else k

        # A match shares total * least / (2 - least) bigrams or more, all of them
        # within the longest stretch that a match can be.
        held = np.arange(len(lacking)) - lacking
        reach = np.minimum(begins + int(self.total * (2 - least) / least + 1e-9), len(lacking) - 1)
        some = held[reach] - held[np.minimum(begins, len(held) - 1)]
        self.worth = np.flatnonzero(near & (some >= self.total * least / (2 - least) - 1e-9))

    def best(self):
        for a in range(len(self.edges) - 1) if self.single else self.worth.tolist():
            key = self.best_of(a, int(self.edges[-1]))
            if key:
                yield a, key

    def best_of(self, a: int, free: int) -> tuple | None:
        """Key of the best stretch that begins with unit ``a`` and ends at the
        word ``free`` or before; None if there is none."""
        begin = int(self.edges[a])
        if self.single:
            end = int(self.edges[a + 1])
            alike = end - begin == 1 and end <= free and self.words[begin] == self.word
            return (-1.0, -1, begin, self.name) if alike else None
        highest = min(free, begin + 1 + int(self.total * (2 - self.least) / self.least + 1e-9))
        last = min(int(self.stop[a]), int(np.searchsorted(self.edges, highest, "right")) - 1)
        ends = self.edges[a + 1 : last + 1]
        if not len(ends) or ends[-1] - begin < 2:
            return None
        counted = np.cumsum(self.used_up[begin : ends[-1] - 1] < begin)
        sizes = ends - begin - 1
        shared = np.where(sizes > 0, counted[sizes - 1], 0)
        values = 2 * shared / (self.total + sizes)
        at = len(values) - 1 - int(np.argmax(values[::-1]))  # the longest of the best
        if sizes[at] == 0 or values[at] < self.least:
            return None
        return -float(values[at]), -int(sizes[at]) - 1, begin, self.name


class Templates:
    """Templates as bigrams, and the templates of each bigram."""

    def __init__(self, templates: dict[str, list[str]], least: float = DICE):
        self.least = least
        self.rows = []
        self.of = defaultdict(list)
        for name, notices in templates.items():
            for notice in notices:
                grams = bigrams(normalised(notice))
                if not grams:
                    continue
                for gram, n in grams.items():
                    self.of[gram].append((len(self.rows), n))
                self.rows.append((name, grams, grams.total()))
        self.of = dict(self.of)
        self.single = any(len(g) == 1 for g in self.of)

    def _possible(self, words: list[str]) -> list[int]:
        """Templates of which the text as a whole holds enough bigrams: a match
        shares at least size * least / (2 - least) of them."""
        held = Counter(filter(self.of.__contains__, zip(words, words[1:])))
        if self.single:
            held.update(g for g in zip(words) if g in self.of)
        shared: Counter = Counter()
        for gram, n in held.items():
            for row, wanted in self.of[gram]:
                shared[row] += min(n, wanted)
        return [k for k, n in shared.items() if n >= self.rows[k][2] * self.least / (2 - self.least) - 1e-9]

    def matches(self, text: str) -> list[tuple]:
        """(first word, last word + 1, name, coefficient) of every segment: of
        overlapping ones the best, by coefficient, then the longer, then the
        earlier, then by name."""
        words = normalised(text)
        possible = self._possible(words)
        if not possible:
            return []
        edges = [0]
        for piece in UNIT_END.split(text):
            own = len(normalised(piece))
            if own:
                edges.append(edges[-1] + own)
        beginnings = [_Beginnings(self.rows[row], words, edges, self.least) for row in possible]
        open_ = [(key, which, a) for which, own in enumerate(beginnings) for a, key in own.best()]
        heapq.heapify(open_)
        taken: list[tuple] = []
        starts: list[int] = []  # of the words taken, in order
        ends: dict[int, int] = {}
        while open_:
            (value, size, begin, name), which, a = heapq.heappop(open_)
            k = bisect_left(starts, begin + 1)
            if k and ends[starts[k - 1]] > begin:
                continue  # the beginning itself is taken
            free = starts[k] if k < len(starts) else len(words)
            if begin - size > free:
                key = beginnings[which].best_of(a, free)
                if key:
                    heapq.heappush(open_, (key, which, a))
                continue
            insort(starts, begin)
            ends[begin] = begin - size
            taken.append((begin, begin - size, name, -value))
        return sorted(taken)

    # The rule that ``_Beginnings`` applies to all units at once.
    @staticmethod
    def _near(unit, grams: Counter, least: float = DICE) -> bool:
        """Whether a match may hold the unit: of bigrams that the template lacks
        it has 2 (1 - least) / least of the template's size at most. A word alone
        is only half of bigrams with others."""
        own = unit[2]
        lacking = sum(n for g, n in own.items() if g not in grams)
        return len(unit[1]) == 1 or lacking <= grams.total() * 2 * (1 - least) / least + 1e-9


def _apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches the best one: by coefficient, then the longer,
    then the earlier, then by name."""
    taken: list[tuple] = []
    used = bytearray(max((m[1] for m in found), default=0))
    for m in sorted(found, key=lambda m: (-m[3], m[0] - m[1], m[0], m[2])):
        if not any(used[m[0] : m[1]]):
            used[m[0] : m[1]] = b"\1" * (m[1] - m[0])
            taken.append(m)
    return sorted(taken)


def _scanner(templates: dict[str, list[str]], least: float):
    held = Templates(templates, least)
    kind = [("licenses", pa.list_(pa.string())), ("dice", pa.float64()), ("spans", pa.string())]

    @F.arrow_udf("struct<licenses: array<string>, dice: double, spans: string>")
    def scan(text: pa.Array) -> pa.Array:
        rows = []
        for t in texts(text):
            found = held.matches(t)
            rows.append((
                sorted({m[2] for m in found}), max((m[3] for m in found), default=None),
                ",".join(f"{m[2]}:{m[0]}:{m[1]}" for m in found),
            ))
        columns = list(zip(*rows)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kind)], names=[n for n, _ in kind])

    return scan


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = ALL_TEMPLATES, least: float = DICE) -> DataFrame:
    """doc_id, licenses (sorted names), dice (the best coefficient, null
    without a match) and spans (name:first word:last word + 1) of each row.

    ``templates``: identifier to notices and texts; licences without one there
    are not found. Null and empty texts match nothing; of overlapping matches the best stays;
    repeated rows give a row each; templates without words are left out.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", _scanner(templates, least)("text").alias("r")).select("doc_id", "r.*")
