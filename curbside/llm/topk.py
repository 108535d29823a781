"""Exact top-k search by selection on distributed score histograms.

Every query meets every vector, block by block. In each pass a block adds its
scores to one global histogram per query; the bin in which the k-th score must
lie becomes the range of the next, finer histogram, until a bin is one score
wide. Then a last pass keeps what lies above that score, and of what equals it
the smallest ids that are still needed.

Scores are computed anew in each pass: they are never stored or shuffled. The
blocks of vectors are stored once, in the narrowest whole numbers that hold
them; what goes to each of them are the query blocks, which are few. From each
block a query gets the counts of the bins that can still matter, those at or
above the block's own k-th score. Rows are told apart by a number of their own
(``nth``), as vec_ids may repeat.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curbside.llm.common import small_batches
from curbside.session import cut_lineage

SCALE = 64
K = 20
#: Vectors in a block at most, and queries in one.
BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Blocks that are aimed at where there are fewer vectors.
LEAST_BLOCKS = 24
#: Bins of a histogram.
BINS = 1024


def whole_numbers(vector: str = "embedding"):
    """floor(SCALE * x) of each component as array<bigint>; null for a vector
    that is null or holds a component that is null, infinite or not a number."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return F.when(x.isNotNull() & ~bad, scaled)


#: Kinds of whole numbers, narrowest first.
KINDS = (np.int8, np.int16, np.int32, np.int64)


def _pack(key):
    """Rows of one block as one row: their numbers and ids, the number of
    components, the kind of whole number, the components."""

    def pack(table: pa.Table) -> pa.Table:
        rows = table.column("v").to_pylist()
        wide = max(map(len, rows), default=0)
        matrix = np.zeros((len(rows), wide), np.int64)
        for k, row in enumerate(rows):
            matrix[k, : len(row)] = row
        low, high = matrix.min(initial=0), matrix.max(initial=0)
        kind = next(k for k, t in enumerate(KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        nth = table.column("nth").to_numpy()
        order = np.argsort(nth, kind="stable")
        return pa.table({
            key: pa.array([table.column(key)[0].as_py()], pa.int32()),
            "nth": pa.array([nth[order].tobytes()], pa.binary()),
            "ids": pa.array([table.column("vec_id").to_numpy()[order].tobytes()], pa.binary()),
            "wide": pa.array([wide], pa.int32()),
            "kind": pa.array([kind], pa.int32()),
            "parts": pa.array([matrix[order].astype(KINDS[kind]).tobytes()], pa.binary()),
        })

    return pack


def block_of(number: int):
    return F.pmod(F.xxhash64("nth"), F.lit(number)).cast("int")


def blocks(vectors: DataFrame, key: str, number: int) -> DataFrame:
    """(key, nth, ids, wide, kind, parts): ``number`` blocks of vectors."""
    dealt = vectors.select(block_of(number).alias(key), "nth", "vec_id", "v")
    kind = f"{key} int, nth binary, ids binary, wide int, kind int, parts binary"
    return cut_lineage(dealt.groupBy(key).applyInArrow(_pack(key), kind))


def _unpack(nth: bytes, wide: int, kind: int, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(nth, np.int64)
    return names, np.frombuffer(parts, KINDS[kind]).reshape(len(names), wide).astype(np.int64)


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; a shorter vector counts as filled up with 0.
    Products that fit a double exactly go through floating point."""
    wide = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :wide], vectors[:, :wide]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(wide, 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _pairs(batches):
    """For each query block and vector block: numbers of the queries, their
    ranges, numbers and ids of the vectors, scores."""
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            q, left = _unpack(r["q_nth"], r["q_wide"], r["q_kind"], r["q_parts"])
            v, right = _unpack(r["nth"], r["wide"], r["kind"], r["parts"])
            low, step, need = (np.frombuffer(r[name], np.int64) for name in ("low", "step", "need"))
            yield q, low, step, need, v, np.frombuffer(r["ids"], np.int64), scores_of(left, right)


def _lowest(batches):
    for q, _, _, _, v, _, s in _pairs(batches):
        own = q[:, None] == v[None, :]
        low = np.where(own, np.iinfo(np.int64).max, s).min(axis=1, initial=np.iinfo(np.int64).max)
        high = np.where(own, np.iinfo(np.int64).min, s).max(axis=1, initial=np.iinfo(np.int64).min)
        some = low <= high
        yield pa.record_batch(
            [pa.array(q[some]), pa.array(low[some]), pa.array(high[some]), pa.array((~own).sum(axis=1)[some])],
            names=["query", "low", "high", "n"],
        )


def _histogram(batches):
    for q, low, step, need, v, _, s in _pairs(batches):
        ids, bins, counts = [], [], []
        for k in range(len(q)):
            own = s[k][v != q[k]]
            place = (own[own >= low[k]] - low[k]) // step[k]
            place = np.minimum(place, BINS)  # what lies above the range, as one
            count = np.bincount(place, minlength=1)
            above = np.cumsum(count[::-1])[::-1] - count
            use = np.flatnonzero((count > 0) & (above < need[k]))
            ids.append(np.full(len(use), q[k]))
            bins.append(use)
            counts.append(count[use])
        yield pa.record_batch(
            [pa.array(np.concatenate(x) if x else np.array([], np.int64)) for x in (ids, bins, counts)],
            names=["query", "bin", "n"],
        )


def _winners(batches):
    for q, low, _, need, v, names, s in _pairs(batches):
        queries, ids, scores = [], [], []
        for k in range(len(q)):
            at = np.flatnonzero((s[k] >= low[k]) & (v != q[k]))
            if len(at) > need[k]:
                at = at[np.lexsort((names[at], -s[k][at]))[: need[k]]]
            queries.append(np.full(len(at), q[k]))
            ids.append(names[at])
            scores.append(s[k][at])
        yield pa.record_batch(
            [pa.array(np.concatenate(x) if x else np.array([], np.int64)) for x in (queries, ids, scores)],
            names=["query", "vec_id", "score"],
        )


def _with_ranges(query_blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Query blocks with the range of each of their queries beside it; queries
    that have none (nothing to be compared with) get an empty one."""

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r["query"]: r for r in right.to_pylist()}
        none = {"low": np.iinfo(np.int64).max, "step": 1, "need": 0}
        rows = []
        for block in left.to_pylist():
            own = [found.get(i, none) for i in np.frombuffer(block["q_nth"], np.int64).tolist()]
            for name in ("low", "step", "need"):
                block[name] = np.array([r[name] for r in own], np.int64).tobytes()
            rows.append(block)
        return pa.Table.from_pylist(rows, schema=kind)

    kind = pa.schema([
        ("q", pa.int32()), ("q_nth", pa.binary()), ("q_wide", pa.int32()), ("q_kind", pa.int32()), ("q_parts", pa.binary()),
        ("low", pa.binary()), ("step", pa.binary()), ("need", pa.binary()),
    ])
    spec = "q int, q_nth binary, q_wide int, q_kind int, q_parts binary, low binary, step binary, need binary"
    asked = query_blocks.select("q", *[F.col(c).alias(f"q_{c}") for c in ("nth", "wide", "kind", "parts")])
    return asked.groupBy("q").cogroup(ranges.groupBy("q")).applyInArrow(put, spec)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each row
    for whose vec_id ``is_query`` (a condition) holds, over all rows but itself;
    all, if there are fewer. Ties go to the smaller vec_id.

    Rows with a null vec_id or a vector that ``whole_numbers`` makes null take
    no part. Repeated rows and vec_ids are queries and candidates each by itself:
    the rows of one query_id then hold each rank several times. Shorter vectors
    count as filled up with 0. No vectors give no rows.
    """
    small_batches(vectors.sparkSession, 32)
    usable = vectors.select("vec_id", whole_numbers().alias("v")).where("vec_id is not null and v is not null")
    usable = cut_lineage(usable.select("vec_id", "v", F.monotonically_increasing_id().alias("nth")))
    asking = usable.where(is_query)
    n, n_queries = usable.count(), asking.count()
    vector_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(LEAST_BLOCKS, n))
    query_count = max(1, math.ceil(n_queries / QUERY_ROWS))
    stored = blocks(usable, "c", vector_blocks)
    query_blocks = blocks(asking, "q", query_count)
    own = cut_lineage(asking.select(F.col("nth").alias("query"), "vec_id", block_of(query_count).alias("q")))

    def scored(ranges, task, kind):
        # Every query block goes to every block of vectors: blocks meet, not rows.
        to_all = F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("c")
        asked = _with_ranges(query_blocks, ranges).select("*", to_all)
        met = asked.repartition(vector_blocks, "c").join(stored.repartition(vector_blocks, "c"), "c")
        return met.mapInArrow(task, kind)

    whole = own.select(
        "q", "query", F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("step"), F.lit(k).cast("long").alias("need")
    )
    ends = scored(whole, _lowest, "query long, low long, high long, n long").groupBy("query").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    )
    now = cut_lineage(
        own.join(ends, "query").select(
            "q", "query", "low",
            F.greatest(F.lit(1), F.expr(f"(high - low) div {BINS} + 1")).alias("step"),
            F.least("n", F.lit(k)).alias("need"),
        )
    )
    while True:
        counts = scored(now, _histogram, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query").orderBy(F.desc("bin"))
        reached = counts.withColumn("upto", F.sum("n").over(above))
        held = now.join(reached, "query").where("upto >= need and upto - n < need")
        finer = cut_lineage(held.select(
            "q", "query", (F.col("low") + F.col("bin") * F.col("step")).alias("low"),
            "step", "need",
        ))
        if not finer.where("step > 1").limit(1).count():
            break
        now = cut_lineage(finer.withColumn("step", F.expr(f"(step - 1) div {BINS} + 1")))
    found = scored(finer, _winners, "query long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(own.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
