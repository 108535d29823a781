"""Token ids in wavelet matrices: compressed files that answer queries.

A shard holds the ids of neighbouring documents as one wavelet matrix: a plane
of bits for each bit of the ids, highest first; behind each plane the ids with a
0 move to the front, those with a 1 behind them, both in order. Ranks kept for
every word of a plane give access to any token, the count of an id in any range
and the places where it occurs, from the file alone.

File of a shard, little-endian: MAGIC, then number of documents, of tokens and of
planes (u32 each); for each document its id (i64), a byte that says whether it
has one, and its number of tokens (u32); then zlib-compressed: the planes, each
padded to whole 64-bit words. Files are the cells of a Parquet table, one row
each, so that they are written and read by any store that Spark reaches.
"""

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curbside.llm.bpe import letter_of_byte
from curbside.llm.common import small_batches, texts
from curbside.session import cut_lineage, shared_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"WVM1"
#: Characters of text that one range of doc_ids has in the mean.
RANGE_CHARS = 1 << 20
#: A shard is closed when it has this many tokens; documents stay whole.
SHARD_TOKENS = 1 << 18
#: Words, and pieces of words, in one of the two generations that a worker keeps.
KNOWN_WORDS = 150_000
KNOWN_PIECES = 300_000
#: Characters of the longest word or piece that is kept.
KNOWN_CHARS = 64


# --- the matrix -------------------------------------------------------------


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], size: int):
        """``planes``: arrays of 64-bit words, first plane for the highest bit."""
        self.planes, self.size = planes, size
        ones = [np.bitwise_count(p).astype(np.int64) for p in planes]
        self.ranks = [np.concatenate([[0], np.cumsum(c)]) for c in ones]
        self.zeros = [size - int(r[-1]) for r in self.ranks]

    @staticmethod
    def planes_of(ids: np.ndarray, count: int) -> list[np.ndarray]:
        planes, now = [], ids
        for bit in range(count - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(ids) // 64) * 8, np.uint8)
            padded[: len(packed)] = packed
            planes.append(padded.view("<u8"))
            if bit:  # nothing follows the last plane
                now = np.concatenate([now.compress(~ones), now.compress(ones)])
        return planes

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        count = max(1, int(ids.max(initial=0)).bit_length())
        return cls(cls.planes_of(ids, count), len(ids))

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        plane = self.planes[level]
        rest = np.where(word < len(plane), plane[np.minimum(word, max(len(plane) - 1, 0))] & ((np.uint64(1) << bit) - np.uint64(1)), 0)
        return self.ranks[level][word] + np.bitwise_count(rest.astype(np.uint64)).astype(np.int64)

    def access(self, places) -> np.ndarray:
        """Ids at the given places."""
        at = np.asarray(places, dtype=np.int64)
        out = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._rank1(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out

    def all_ids(self) -> np.ndarray:
        """All ids in order: the moves behind the planes, undone from the last
        plane to the first."""
        now = np.zeros(self.size, np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little", count=self.size).view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            before[np.flatnonzero(ones)] = now[self.zeros[level] :] | np.uint32(1 << len(self.planes) - 1 - level)
            now = before
        return now

    def _span(self, value: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` in a range stand at the end."""
        if not self.size or value < 0 or value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, np.array([begin, end]))
            if value >> len(self.planes) - 1 - level & 1:
                begin, end = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                begin, end = begin - int(a), end - int(b)
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        a, b = self._span(value, begin, self.size if end is None else end)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """Place of the occurrence number ``nth`` (from 0) of ``value``; -1 if
        there are fewer."""
        begin, end = self._span(value, 0, self.size)
        at = begin + nth
        if not begin <= at < end:
            return -1
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> len(self.planes) - 1 - level & 1
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def _select_bit(self, level: int, one: int, nth: int) -> int:
        ranks = self.ranks[level] if one else np.arange(len(self.ranks[level])) * 64 - self.ranks[level]
        word = int(np.searchsorted(ranks, nth, "right")) - 1
        bits = np.unpackbits(self.planes[level][word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits == one)[nth - int(ranks[word])])


# --- files ------------------------------------------------------------------


def to_file(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    head = struct.pack("<4sIII", MAGIC, len(doc_ids), len(ids), len(matrix.planes))
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    planes = b"".join(p.tobytes() for p in matrix.planes)
    return head + names + known + np.array(sizes, "<u4").tobytes() + zlib.compress(planes, 1)


def from_file(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """doc_ids, tokens of each document, and the matrix of a shard's file."""
    magic, docs, size, count = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = 16
    names = np.frombuffer(data, "<i8", docs, at).tolist()
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs).tolist()
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    words = np.frombuffer(zlib.decompress(data[at + 13 * docs :]), "<u8")
    each = len(words) // count
    matrix = WaveletMatrix([words[k * each : (k + 1) * each] for k in range(count)], size)
    return [n if k else None for n, k in zip(names, known)], sizes, matrix


# --- tokens -----------------------------------------------------------------


# How the vocabulary's pattern splits words in small letters, a line
# for each, for words of ASCII and of Latin letters with accents. Its first steps,
# composing characters and making letters small, change such words as str.lower
# does; of some the small letter is one of phonetic script.
LETTERS = "a-zß-öø-ʯⱥⱦ"
PIECE = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\n0-9{LETTERS}]+|\n")
#: What other words have: other characters, or the vocabulary's own marks such as
#: <|endoftext|>, which are not split.
ODD = r"[^\x21-\x7eÀ-ɏ]|<\|"


class _Known(dict):
    """Ids of entries met before, others made by ``make``, in two generations:
    when the younger is full it takes the place of the older, and entries that
    come again move up. Rare ones fall out, frequent ones stay, long ones are not
    kept at all: the memory is bounded."""

    def __init__(self, keep: int, make):
        super().__init__()
        self.keep, self.make, self.old = keep, make, {}

    def all_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``keys`` one after another, and how many each has."""
        found = list(map(self.get, keys))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        for k in lacking:
            key = keys[k]
            found[k] = ids = self.old.get(key) or self.make(key)
            if len(key) <= KNOWN_CHARS:
                if len(self) >= self.keep:
                    self.old = dict(self)
                    self.clear()
                self[key] = ids
        return np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2


def _in_order(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``ids``, which have the given sizes, one after another in the
    given order, and where each ends."""
    now = sizes[order]
    ends = np.cumsum(now)
    places = np.repeat((np.cumsum(sizes) - sizes)[order] - ends + now, now)
    places += np.arange(len(places))
    return ids[places], ends


def _line(words: pa.Array, mark: str) -> str:
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, pa.scalar(mark, words.type))[0].as_py()


class WordCoder:
    """Ids of words as bytes, by the tokenizers library. Its splitting pattern
    drops white space and cuts there, so that a text's ids are those of its
    words one after another; a word's ids are in turn those of the pieces that
    the pattern makes of it. Each different word of a column, and each different
    piece of these, is dealt with once; pieces, and words that are not cut into
    pieces here, are remembered from column to column."""

    def __init__(self, path: str, words: int = KNOWN_WORDS, pieces: int = KNOWN_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.tokenize = self.coder.model.tokenize
        self.letter = letter_of_byte()
        self.words, self.pieces = _Known(words, self._word), _Known(pieces, self._piece)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece by the tokenizer's model alone: nothing is left to
        compose, to make small or to split."""
        if piece == "\n":  # the end of a word
            return b""
        letters = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))
        return array("H", [token.id for token in self.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("H", self.coder.encode(word, add_special_tokens=False).ids).tobytes()

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that have nothing odd, and how many each has."""
        if not len(words):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        lines = _line(words, "\n").lower() + "\n"
        coded = pa.array(PIECE.findall(lines), pa.string()).dictionary_encode()
        pieces, order = coded.dictionary, coded.indices.to_numpy()
        ids, ends = _in_order(*self.pieces.all_of(_line(pieces, " ").split(" ")), order)
        return ids, np.diff(ends[order == pieces.index("\n").as_py()], prepend=0)

    def encode_column(self, column: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's texts (null: empty), 16 bits each, one text after
        another, ``end`` behind each; and the places where the texts end."""
        words = pc.ascii_split_whitespace(column.fill_null(""))
        coded = words.values.dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, ODD)
        plain_ids, plain_sizes = self._plain(coded.dictionary.filter(pc.invert(odd)))
        odd_ids, odd_sizes = self.words.all_of(coded.dictionary.filter(odd).to_pylist())
        # Plain words come first, then odd ones, then ``end``.
        place = np.empty(len(odd), np.int64)
        place[np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(odd))
        ids = np.concatenate([plain_ids, odd_ids, np.array(end, "<u2")])
        sizes = np.concatenate([plain_sizes, odd_sizes, [len(end)]])
        last = words.offsets.to_numpy()[1:]
        order = np.insert(place[coded.indices.to_numpy()], last, len(place))
        ids, ends = _in_order(ids, sizes, order)
        return ids, ends[last + np.arange(len(last))]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, 16 bits each."""
        ids, ends = self.encode_column(pa.array(batch, pa.string()), [])
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]


_CODERS: dict[str, WordCoder] = {}


def _coded(path: str | None):
    @F.arrow_udf(T.BinaryType())
    def code(text: pa.Array) -> pa.Array:
        """Ids of each text and the end id, 16 bits each."""
        place = path or public_tokenizers.path(VOCABULARY)
        if place not in _CODERS:
            _CODERS[place] = WordCoder(place)
        ids, ends = _CODERS[place].encode_column(text, [END_ID])
        offsets = pa.array(np.concatenate([[0], 2 * ends])).cast(pa.int32())
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(ids)])

    return code


def _shards(batches):
    """Shards of the ranges of one task, in order of range and doc_id."""
    kind = pa.schema([("range", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())])
    now, number, names, parts, size = None, 0, [], [], 0

    def closed():
        ids = np.frombuffer(b"".join(parts), "<u2")
        data = to_file(names, [len(p) // 2 for p in parts], ids)
        return pa.record_batch([pa.array([x]) for x in (now, number, len(ids))] + [pa.array([data], pa.binary())], names=kind.names).cast(kind)

    for batch in batches:
        for range_, doc_id, ids in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if range_ != now or size >= SHARD_TOKENS:
                if names:
                    yield closed()
                number = number + 1 if range_ == now else 0
                now, names, parts, size = range_, [], [], 0
            names.append(doc_id)
            parts.append(ids)
            size += len(ids) // 2
    if names:
        yield closed()


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, range_chars: int = RANGE_CHARS) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in ascending order of doc_id.

    Ranges of doc_id are cut so that each has about ``range_chars`` characters
    of text; within a task they are sorted and streamed into shards, so that a
    task holds one shard. Null doc_ids come first; rows of one doc_id are
    ordered by their ids.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("doc_id").alias("n")).first()
    parts = max(1, -(-(size["chars"] or 0) // range_chars))
    if parts > 1 and size["n"]:
        cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * min(parts, 10_000)).alias("c")).first()["c"]
        cuts = sorted(set(cuts))
    else:
        cuts = []
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.arrow_udf(T.IntegerType())
    def range_of(doc_id: pa.Array) -> pa.Array:
        found = np.searchsorted(bounds.value, doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left")
        return pa.array(found.astype(np.int32))

    coded = docs.select(range_of(F.col("doc_id").cast("long")).alias("range"), F.col("doc_id").cast("long"), _coded(vocabulary)("text").alias("ids"))
    # A range has one task; a task has several ranges, sorted one by one.
    dealt = coded.repartition("range").sortWithinPartitions("range", "doc_id", "ids")
    dealt.mapInArrow(_shards, "range int, number int, n_tokens long, file binary").write.parquet(path)


def _read(batches):
    for batch in batches:
        for range_, number, start, data in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            names, sizes, matrix = from_file(data)
            raw = matrix.all_ids().astype("<u4").tobytes()
            ends = np.cumsum(sizes)
            begins = ends - sizes
            view = memoryview(raw)
            yield pa.record_batch([
                pa.array(names, pa.int64()), pa.array(begins + start), pa.array(sizes),
                pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files at
    ``path``, start counted over all shards. Running totals are taken within a
    range, and over the totals of the ranges in blocks, so that no task holds
    them all."""
    files = spark.read.parquet(path)
    sizes = files.select("range", "number", "n_tokens")
    in_range = Window.partitionBy("range").orderBy("number")
    ranges = cut_lineage(sizes.groupBy("range").agg(F.sum("n_tokens").alias("n")))
    block = F.floor(F.col("range") / 1000).alias("block")
    blocks = ranges.groupBy(block).agg(F.sum("n").alias("n"))
    before_block = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before_block"))
    in_block = Window.partitionBy("block").orderBy("range")
    before = ranges.select("range", "n", block).join(before_block, "block").select(
        "range", (F.col("before_block") + F.sum("n").over(in_block) - F.col("n")).alias("before")
    )
    starts = cut_lineage(
        sizes.join(before, "range").select(
            "range", "number", (F.col("before") + F.sum("n_tokens").over(in_range) - F.col("n_tokens")).alias("start")
        )
    )
    placed = files.select("range", "number", "file").join(starts, ["range", "number"])
    return placed.select("range", "number", "start", "file").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, vocabulary: str | None = None, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, from files written to
    the shared folder. Null and empty texts have the end id alone; a row
    without doc_id comes before all others; no rows give no rows."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_shards(docs.select("doc_id", "text"), path, vocabulary, range_chars)
    return read_shards(spark, path)
