"""Benchmark passages in training documents, by BM25 with block maxima.

Test items, cut into segments of at most SEGMENT words, are the indexed side;
every window of a training document is a query. Impacts are BM25 weights as a
share of the segment's own full score, so that one threshold holds for all.
Windows are dealt with in batches, in the three steps of block-max WAND: a window
whose term maxima cannot sum up to the threshold has no pivot and is done; the
blocks whose maxima cannot reach it are skipped; what is left is scored in full.
Everything at or above the threshold is then verified word by word.
"""

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import row_key, same_key, small_batches, texts, without_rows
from curbside.session import cut_lineage

WORD = re.compile(r"\w+")
SEGMENT = 64
#: A window of twice a segment's words, moved on by one segment's, holds every
#: passage of a segment's length as a whole.
WINDOW, STRIDE = 2 * SEGMENT, SEGMENT
K1, B = 1.2, 0.75
#: Least share of a segment's own score that is retrieved.
RETRIEVED = 0.5
SHINGLE = 5
#: Least share of the shingles of the question, and of the answer, which are both
#: the item as a whole where nothing tells them apart.
OVERLAP = 0.8
#: Segments in a block of the index.
BLOCK = 8
#: Characters of items in one part of the index; more items make more parts.
PART_CHARS = 4_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments_of(words: list[str]) -> list[list[str]]:
    """Even pieces of at most SEGMENT words."""
    n = -(-len(words) // SEGMENT)
    edges = [len(words) * k // n for k in range(n + 1)] if n else [0]
    return [words[a:b] for a, b in zip(edges, edges[1:])]


def question_answer(words: list[str]) -> tuple[list[str], list[str]]:
    """Both are the item as a whole: its text alone does not tell where an answer
    begins. OVERLAP of the whole cannot be reached without a part of its end.
    Items that come with a question and an answer do not need this."""
    return words, words


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return set(zip(*[words[k:] for k in range(size)]))


class _Terms(dict):
    def __missing__(self, word):
        return -1


class ItemIndex:
    """Inverted index of some items; ``frequency`` (segments that hold a term),
    ``count`` and ``mean`` (number and mean length of segments) are those of
    all items."""

    def __init__(self, items, frequency, count: int, mean: float, overlap: float = OVERLAP):
        """``items``: (item, text), or (item, text, question, answer)."""
        self.parts = {}
        self.overlap = overlap
        self.owner, rows = [], []
        for item, text, *apart in items:
            words = words_of(text)
            if not words:
                continue
            question, answer = map(words_of, apart) if apart else question_answer(words)
            question, answer = question or answer, answer or question
            sides = [self._side(question)]
            sides.append(sides[0] if answer == question else self._side(answer))
            self.parts.setdefault(item, []).append(sides)
            for piece in segments_of(words):
                weights = {}
                for term, tf in Counter(piece).items():
                    df = frequency[term]
                    idf = np.log1p((count - df + 0.5) / (df + 0.5))
                    weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(piece) / mean))
                own = sum(weights.values())
                rows.append({t: w / own for t, w in weights.items()})
                self.owner.append((item, len(self.parts[item]) - 1, own))
        postings = defaultdict(list)
        for number, weights in enumerate(rows):
            for term, share in weights.items():
                postings[term].append((number, share))
        self.terms = _Terms((t, k) for k, t in enumerate(postings))
        lists = list(postings.values())
        self.maxima = np.array([max(s for _, s in p) for p in lists] + [0.0])  # the last: unknown words
        self.segment, self.share, self.first = self._rows(lists)
        blocks = []
        for p in lists:
            most = {}
            for number, share in p:
                most[number // BLOCK] = max(share, most.get(number // BLOCK, 0.0))
            blocks.append(list(most.items()))
        self.block, self.block_max, self.block_first = self._rows(blocks)
        self.blocks = -(-len(rows) // BLOCK)

    @staticmethod
    def _side(words):
        size = min(SHINGLE, len(words))
        return size, shingles(words, size)

    @staticmethod
    def _rows(lists):
        first = np.cumsum([0] + [len(p) for p in lists])
        return (
            np.array([n for p in lists for n, _ in p], dtype=np.int64),
            np.array([s for p in lists for _, s in p], dtype=np.float64), first,
        )

    @staticmethod
    def _expand(terms, first):
        """Places of the postings of ``terms``, and whose they are."""
        size = first[terms + 1] - first[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[terms], size)
        return place, owner

    def retrieve(self, ids: np.ndarray) -> dict[int, float]:
        """Segments that some window of the words ``ids`` scores at or above
        RETRIEVED, with their highest share."""
        n = len(ids)
        starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        ends = np.minimum(starts + WINDOW, n)
        sums = np.concatenate([[0.0], np.cumsum(self.maxima[ids])])
        live = np.flatnonzero(sums[ends] - sums[starts] >= RETRIEVED - 1e-9)
        best: dict[int, float] = {}
        for at in range(0, len(live), 64):
            self._score(ids, [(starts[k], ends[k]) for k in live[at : at + 64]], best)
        return best

    def _score(self, ids, windows, best) -> None:
        known = [np.unique(ids[a:b]) for a, b in windows]
        known = [t[t >= 0] for t in known]
        kept = [k for k, t in enumerate(known) if self.maxima[t].sum() >= RETRIEVED - 1e-9]
        if not kept:
            return
        terms = np.concatenate([known[k] for k in kept])
        window = np.repeat(np.arange(len(kept)), [len(known[k]) for k in kept])
        place, owner = self._expand(terms, self.block_first)
        bound = np.bincount(
            window[owner] * self.blocks + self.block[place], self.block_max[place], len(kept) * self.blocks
        ).reshape(len(kept), self.blocks)
        passing = bound >= RETRIEVED - 1e-9
        if not passing.any():
            return
        some = passing.any(axis=1)[window]
        terms, window = terms[some], window[some]
        place, owner = self._expand(terms, self.first)
        row, segment = window[owner], self.segment[place]
        scored = passing[row, segment // BLOCK]
        codes, inverse = np.unique(row[scored] * len(self.owner) + segment[scored], return_inverse=True)
        shares = np.bincount(inverse, self.share[place][scored])
        for code, share in zip(codes.tolist(), shares.tolist()):
            if share >= RETRIEVED - 1e-9:
                number = code % len(self.owner)
                best[number] = max(share, best.get(number, 0.0))

    def verified(self, text: str) -> list[tuple]:
        """(item, bm25, share of question, share of answer) of the items that
        ``text`` holds."""
        words = words_of(text)
        if not words or not self.owner:
            return []
        found = self.retrieve(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)))
        if not found:
            return []
        own: dict[int, set] = {}
        scores: dict[tuple, float] = {}
        for number, share in found.items():
            item, which, full = self.owner[number]
            scores[item, which] = max(share * full, scores.get((item, which), 0.0))
        out: dict = {}
        for (item, which), score in scores.items():
            shares = []
            for size, wanted in self.parts[item][which]:
                if size not in own:
                    own[size] = shingles(words, size)
                shares.append(len(wanted & own[size]) / len(wanted))
            if min(shares) >= self.overlap and (item not in out or score > out[item][1]):
                out[item] = (item, score, *shares)
        return sorted(out.values())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _segments(text: pa.Array) -> pa.Array:
    return pa.array([segments_of(words_of(t)) for t in texts(text)], pa.list_(pa.list_(pa.string())))


def read_items(items: DataFrame, question: str | None = None, answer: str | None = None) -> DataFrame:
    """(item_id, text), and question and answer where their columns are named;
    the text is then both, one after the other. item_id becomes a bigint where
    it can; items without id or text are left out."""
    named = items.where("item_id is not null").withColumn("item_id", F.expr("try_cast(item_id as bigint)"))
    if question and answer:
        sides = [F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in ((question, "question"), (answer, "answer"))]
        return named.select("item_id", *sides).where("item_id is not null").select(
            "item_id", F.concat_ws("\n", "question", "answer").alias("text"), "question", "answer"
        )
    return named.where("item_id is not null and text is not null").select("item_id", "text")


def build_indexes(items: DataFrame, part_chars: int = PART_CHARS, overlap: float = OVERLAP):
    """Indexes over all rows of ``read_items``, one for each ``part_chars``
    characters or so; counts and statistics are those of all items. Only one
    part at a time passes through the driver."""
    pieces = items.select(F.explode(_segments("text")).alias("words"))
    size = pieces.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not size[0]:
        return
    terms = pieces.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        held = rows.select(F.explode(_segments("text")).alias("words")).select(F.explode("words").alias("term")).distinct()
        frequency = {r["term"]: r["df"] for r in terms.join(held, "term", "left_semi").collect()}
        yield ItemIndex(sorted(map(tuple, rows.distinct().collect())), frequency, *size, overlap)


_HIT = "array<struct<item_id: bigint, bm25: double, question_overlap: double, answer_overlap: double>>"


def hits_columns(spark, items: DataFrame, part_chars: int = PART_CHARS, overlap: float = OVERLAP) -> list:
    """Column functions, one for each part of the index, which is bounded and
    broadcast: text to the items of that part that are found in it."""
    kind = pa.list_(pa.struct([
        ("item_id", pa.int64()), ("bm25", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()),
    ]))

    def one_pass(shared):
        @F.arrow_udf(_HIT)
        def find(text: pa.Array) -> pa.Array:
            names = ("item_id", "bm25", "question_overlap", "answer_overlap")
            rows = [[dict(zip(names, hit)) for hit in shared.value.verified(t)] for t in texts(text)]
            return pa.array(rows, kind)

        return find

    return [one_pass(spark.sparkContext.broadcast(index)) for index in build_indexes(items, part_chars, overlap)]


def contaminated(
    docs: DataFrame, items: DataFrame, part_chars: int = PART_CHARS, question: str | None = None,
    answer: str | None = None, overlap: float = OVERLAP,
) -> DataFrame:
    """doc_id, item_id, bm25, question_overlap, answer_overlap of every item
    found in a row of ``docs``; rows that hold none give no row.

    An item counts as found if a window reaches RETRIEVED of a segment's BM25
    score and the document holds ``overlap`` of the five-word shingles (of shorter
    ones: their whole sequence) of its question and of its answer, which are the
    columns ``question`` and ``answer`` of ``items`` where these are named. An
    item of which only the text is known is both as a whole. Each part of the
    index has tasks of its own, so that a task holds one part. Null and empty
    texts hold nothing; repeated rows give their rows each; items that share an
    item_id count as one, by their best match; without items there are no rows.
    """
    small_batches(docs.sparkSession)
    passes = hits_columns(docs.sparkSession, read_items(items, question, answer), part_chars, overlap)
    none = docs.limit(0).select("doc_id", F.explode(F.array().cast(_HIT)).alias("hit")).select("doc_id", "hit.*")
    found = [docs.select("doc_id", F.explode(hits("text")).alias("hit")).select("doc_id", "hit.*") for hits in passes]
    if len(found) < 2:
        return found[0] if found else none
    # Items that share an id may lie in several parts: by their best match.
    rows = reduce(DataFrame.unionByName, [
        docs.select(row_key().alias("key"), F.explode(hits("text")).alias("hit")) for hits in passes
    ])
    best = rows.groupBy("key", "hit.item_id").agg(F.max_by("hit", "hit.bm25").alias("hit"))
    times = docs.select(row_key().alias("key")).groupBy("key").agg(F.count("*").cast("int").alias("times"))
    again = best.join(times, same_key(best["key"], times["key"])).select(
        best["key"]["doc_id"].alias("doc_id"), "hit", F.explode(F.sequence(F.lit(1), "times"))
    )
    return again.select("doc_id", "hit.*")


def without_benchmarks(
    docs: DataFrame, items: DataFrame, part_chars: int = PART_CHARS, question: str | None = None,
    answer: str | None = None, overlap: float = OVERLAP,
) -> DataFrame:
    """``docs`` without the rows that hold an item, as ``contaminated`` tells."""
    small_batches(docs.sparkSession)
    passes = hits_columns(docs.sparkSession, read_items(items, question, answer), part_chars, overlap)
    if len(passes) < 2:
        return docs.where(F.size(passes[0]("text")) == 0) if passes else docs
    found = [docs.where(F.size(hits("text")) > 0).select(row_key().alias("key")) for hits in passes]
    return without_rows(docs, cut_lineage(reduce(DataFrame.unionByName, found).distinct()))
