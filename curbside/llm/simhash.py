"""Near duplicates by 64-bit SimHash fingerprints and anchor points.

Two fingerprints link at ``LIMIT`` or fewer differing bits. The 64 bits are cut
into three blocks; some block of a linked pair then differs in one bit at most.
In each block the anchors are a covering code: the words of the perfect
Hamming(15,11) code in the low 15 bits, every value in the bits above. Each
value lies within ``RADIUS`` = 1 of an anchor, its home, and a fingerprint is
replicated to every anchor within RADIUS + 1 of its block, so it meets there
the home of any partner. All pairs are compared per anchor, over all 64 bits.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import may_be_in, place_of, row_key, same_key, small_batches, whole_rows
from curbside.llm.components import components
from curbside.session import cut_lineage

LIMIT = 4
SHINGLE = 4
SEED = 42
RADIUS = 1
BLOCK_LIMIT = 1
#: (first bit, bits) of the blocks: LIMIT differences over three blocks leave
#: BLOCK_LIMIT or fewer in one of them.
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
#: Rows of an anchor that one task compares; larger anchors are cut in tiles.
TILE_ROWS = 8192
#: Pairs that are compared at once.
PAIRS = 1 << 20


# --- fingerprints -----------------------------------------------------------


def fingerprint_of(data: bytes) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 without words."""
    words = data.lower().split()  # of bytes: A-Z alone, at \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[: n - SHINGLE + 1].tolist()
        ends = ends[SHINGLE - 1 :].tolist()
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(begins, ends)), np.uint64, len(begins)
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """Fingerprint of a text column; null counts as the empty text."""
    return pa.array((fingerprint_of(t or b"") for t in text.cast(pa.binary()).to_pylist()), pa.int64())


# --- anchors ----------------------------------------------------------------


def _syndrome(value: int) -> int:
    s = 0
    for bit in range(CODE_BITS):
        if value >> bit & 1:
            s ^= bit + 1
    return s


def flips(bits: int) -> list[list[int]]:
    """By syndrome: the flips of up to RADIUS + BLOCK_LIMIT bits that lead from
    a value with this syndrome to an anchor; the first leads home."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for weight in range(RADIUS + BLOCK_LIMIT + 1):
        for chosen in combinations(range(bits), weight):
            mask = sum(1 << b for b in chosen)
            found[_syndrome(mask)].append(mask)
    return found


def _slots(number: int):
    """Slots of a fingerprint in one block: anchor and block, times 2, and 1
    added at home. Every value is reached, as the code covers all of them."""
    first, bits = BLOCKS[number]
    value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    syndrome = F.lit(0)
    for k in range(4):
        check = sum(1 << b for b in range(CODE_BITS) if (b + 1) >> k & 1)
        syndrome = syndrome + F.bit_count(value.bitwiseAND(F.lit(check))).bitwiseAND(F.lit(1)) * (1 << k)
    lists = F.array(*[F.array(*[F.lit(m) for m in masks]) for masks in flips(bits)])
    return F.transform(
        F.element_at(lists, syndrome + 1),
        lambda mask, i: (F.shiftleft(value.bitwiseXOR(mask), 2) + number) * 2 + F.when(i == 0, 1).otherwise(0),
    )


def anchored(prints: DataFrame) -> DataFrame:
    """(anchor, home, fp): every fingerprint at every anchor in its reach."""
    slots = prints.select("fp", F.explode(F.concat(*[_slots(k) for k in range(len(BLOCKS))])).alias("slot"))
    return slots.select("fp", F.shiftright("slot", 1).alias("anchor"), (F.col("slot") % 2).alias("home"))


def tiled(entries: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(tile, role, fp): anchors with more than ``tile_rows`` rows are cut into
    c parts; home part i meets part j in tile (i, j), so that no pair is missed
    and no task holds more than two parts. Role 1 is home, 2 replica, 3 both.

    The large anchors are broadcast: there are 2^19 anchors in all.
    """
    counted = entries.groupBy("anchor").agg(F.count("*").alias("n"))
    large = counted.where(F.col("n") > tile_rows).select(
        "anchor", F.ceil(F.col("n") / tile_rows).cast("int").alias("c")
    )
    cut = entries.join(F.broadcast(cut_lineage(large)), "anchor", "left")
    part = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("c") - 1)

    def tile(number, role):
        return F.struct(number.cast("long").alias("number"), F.lit(role).alias("role"))

    as_home = F.transform(all_parts, lambda j: tile(part * F.col("c") + j, 1))
    as_replica = F.transform(all_parts, lambda i: tile(i * F.col("c") + part, 2))
    places = (
        F.when(F.col("c").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("number"), (F.col("home") + 2).alias("role"))))
        .when(F.col("home") == 1, F.concat(as_home, as_replica))
        .otherwise(as_replica)
    )
    rows = cut.select("fp", "anchor", F.explode(places).alias("p"))
    return rows.select(
        (F.shiftleft(F.col("anchor").cast("long"), 38) + F.col("p.number")).alias("tile"),
        F.col("p.role").alias("role"), "fp",
    )


# --- comparison per anchor --------------------------------------------------


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as one edge from each node to the smallest it reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if np.array_equal(old, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare(tile: np.ndarray, role: np.ndarray, prints: np.ndarray):
    """Edges among whole tiles, sorted by tile, at most PAIRS pairs at a time."""
    begin = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[begin, len(tile)])
    group = np.repeat(np.arange(len(begin)), size)
    home = np.flatnonzero(role & 1)
    count = size[group[home]]
    home, count = home[count > 1], count[count > 1]
    total = np.cumsum(count)
    at = 0
    while at < len(home):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        h, n = home[at:to], count[at:to]
        left = np.repeat(h, n)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        right = np.repeat(begin[group[h]], n) + offset
        differ = np.bitwise_count((prints[left] ^ prints[right]).view(np.uint64))
        linked = np.flatnonzero((differ <= LIMIT) & (differ > 0) & ((role[right] & 2) > 0))
        if len(linked):
            yield spanning(prints[left[linked]], prints[right[linked]])
        at = to


def _edges(batches):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    kept = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if kept is not None:
            cols = [np.concatenate(pair) for pair in zip(kept, cols)]
        whole = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
        kept = [c[whole:] for c in cols]
        for u, v in compare(*[c[:whole] for c in cols]) if whole else ():
            yield pa.record_batch([pa.array(u), pa.array(v)], schema=schema)
    if kept is not None and len(kept[0]):
        for u, v in compare(*kept):
            yield pa.record_batch([pa.array(u), pa.array(v)], schema=schema)


def link_edges(prints: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (u > v) that connect exactly the linked fingerprints of ``fp``,
    a column of distinct ones: a spanning set, not all the pairs."""
    rows = tiled(anchored(prints), tile_rows)
    dealt = rows.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_edges, "u long, v long")


# --- operator ---------------------------------------------------------------


def _rooted(prints: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fp, first_id, root) of distinct fingerprints: groups have different
    roots, even if they share their smallest doc_id."""
    found = components(link_edges(prints.select("fp"), tile_rows))
    return cut_lineage(
        prints.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )


def _named_prints(docs: DataFrame, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each distinct
    fp."""
    small_batches(docs.sparkSession)
    marks = cut_lineage(docs.select("doc_id", fingerprint("text").alias("fp")))
    rooted = _rooted(cut_lineage(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), tile_rows)
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return marks, cut_lineage(rooted.join(least, "root").select("fp", "root", "component_id"))


def simhash_groups(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Equal fingerprints collapse before any comparison. component_id is the
    smallest doc_id that links lead to, the row's own included. Null and empty
    texts have fingerprint 0 and link like any other; a null doc_id is never
    the smallest (a group without any doc_id has null); repeated rows and
    doc_ids give a row each; no rows give no rows; further columns are ignored.
    """
    marks, named = _named_prints(docs, tile_rows)
    return marks.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each SimHash group: that of the smallest doc_id,
    of a row without doc_id only where the group has no other. Of several rows
    under this doc_id the one with the smallest text stays.

    Groups are told apart by their roots: a doc_id whose rows lie in several
    groups stands for each of them. All is decided on hashes of the texts; of
    the texts only those travel that a set of hashes cannot tell to be the one
    row of their group: the copies that go, and rows stored several times.
    """
    small_batches(docs.sparkSession)
    marks = docs.select(row_key().alias("key"), fingerprint("text").alias("fp")).select("key.*", "fp")
    keys = cut_lineage(marks.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("rows")))
    roots = _rooted(cut_lineage(keys.groupBy("fp").agg(F.min("doc_id").alias("first_id")))).select("fp", "root")
    placed = cut_lineage(keys.join(roots, "fp").withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id")))
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    judged = placed.join(first, "root").withColumn("stays", F.col("place") == F.col("first"))
    several = cut_lineage(judged.where("stays").groupBy("root").agg(F.sum("rows").alias("rows")).where("rows > 1"))
    gone = judged.where("not stays").select("doc_id", "text_hash", F.lit(None).cast("long").alias("root"))
    tied = judged.where("stays").join(several.select("root"), "root", "left_semi").select("doc_id", "text_hash", "root")
    open_keys = cut_lineage(gone.unionByName(tied).select(F.struct("doc_id", "text_hash").alias("key"), "root"))

    whole = whole_rows(docs)
    may_be_open = may_be_in(open_keys, "key")(place_of("key"))
    sure = whole.where(~may_be_open).select("whole.*")
    unsure = whole.where(may_be_open)
    named = same_key(unsure["key"], open_keys["key"])
    alone = unsure.join(open_keys, named, "left_anti").select("whole.*")
    ties = unsure.join(open_keys.where("root is not null"), named).select("whole", "root")
    text = F.coalesce("whole.text", F.lit(""))
    least = ties.groupBy("root").agg(F.min_by("whole", text).alias("row")).select("row.*")
    return sure.unionByName(alone).unionByName(least)
