"""Centroid clustering with a vantage-point tree over the centroids.

In each round the tree is built anew and broadcast with the centroids: K rows,
whatever the number of vectors. Every vector then searches it best first: of the
nodes still open to it, it takes the one with the smallest lower bound, measures
the exact integer distance to the centroids there, and opens the two children
with the bounds that the triangle inequality gives. A node is pruned only when
its bound is above the best distance, so that equal distances are all seen and
the smallest number wins. The vectors of a batch search side by side, each in
its own order; what they have in common is only the numpy call.

New centroids are exact integer sums and counts, added up in each task first.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.topk import whole_numbers
from curbside.session import cut_lineage, ship_package

K = 16
ROUNDS = 3
SIZE = 64
SEED = 1
#: Centroids in a leaf at most.
LEAF = 2
#: Components of which the squared distance of two vectors is sure to be a long.
LIMIT = 1 << 27
#: Vectors that search side by side.
BATCH_ROWS = 4096


# --- the tree ---------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in arrays. A node holds centroid numbers (its vantage point, or
    all those of a leaf; -1 fills up), its two children, and for each child the
    least and greatest distance from the vantage point to what lies below."""

    held: np.ndarray  # node x LEAF
    child: np.ndarray  # node x 2, -1 for none
    near: np.ndarray  # node x 2
    far: np.ndarray  # node x 2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def build_tree(centroids: np.ndarray) -> Tree:
    """A vantage-point tree: the point farthest from the first of a node's
    points is its vantage point, the median distance parts the others."""
    held, child, near, far = [], [], [], []

    def add(points: np.ndarray) -> int:
        node = len(held)
        held.append([-1] * LEAF)
        child.append([-1, -1])
        near.append([0.0, 0.0])
        far.append([0.0, 0.0])
        if len(points) <= LEAF:
            held[node][: len(points)] = points.tolist()
            return node
        at = int(np.argmax(squared(centroids[points], centroids[points[0]])))
        held[node][0] = int(points[at])
        rest = np.delete(points, at)
        distance = np.sqrt(squared(centroids[rest], centroids[points[at]]).astype(np.float64))
        order = np.argsort(distance, kind="stable")
        for side, part in enumerate(np.array_split(order, 2)):
            near[node][side], far[node][side] = float(distance[part].min()), float(distance[part].max())
            child[node][side] = add(rest[part])
        return node

    if len(centroids):
        add(np.arange(len(centroids)))
    return Tree(np.array(held), np.array(child), np.array(near), np.array(far))


def nearest(vectors: np.ndarray, centroids: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, ties to
    the smaller number, and how many distances were measured."""
    n, nodes = len(vectors), len(tree.held)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids), np.int64)
    bound = np.full((n, nodes), np.inf)  # of the open nodes of each vector
    bound[:, 0] = 0
    active, measured = np.arange(n), 0
    while len(active):
        node = bound[active].argmin(axis=1)  # best first
        least = bound[active, node]
        # Bounds are rounded square roots: a little below counts as reached.
        go = np.isfinite(least) & (least * (1 - 1e-9) - 1e-6 <= np.sqrt(best[active].astype(np.float64)))
        active, node, least = active[go], node[go], least[go]
        bound[active, node] = np.inf
        vantage = None
        for slot in range(tree.held.shape[1]):
            chosen = tree.held[node, slot]
            some = np.flatnonzero(chosen >= 0)
            rows, chosen = active[some], chosen[some]
            distance = squared(vectors[rows], centroids[chosen])
            measured += len(rows)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (chosen < number[rows]))
            best[rows[closer]], number[rows[closer]] = distance[closer], chosen[closer]
            if slot == 0:
                vantage = np.sqrt(distance.astype(np.float64))  # every node has a first one
        for side in range(2):
            into = tree.child[node, side]
            some = np.flatnonzero(into >= 0)
            at = node[some]
            gap = np.maximum(vantage[some] - tree.far[at, side], tree.near[at, side] - vantage[some])
            bound[active[some], into[some]] = np.maximum(least[some], gap)
    return number, best, measured


# --- the job ----------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), SIZE) if len(column) else np.zeros((0, SIZE), np.int64)


def _pieces(batch):
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def _sums(shared):
    def add(batches):
        """Of each cluster, the number and the sum of a task's vectors."""
        centroids, tree = shared.value
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                vectors = _matrix(piece.column(0))
                number, _, _ = nearest(vectors, centroids, tree)
                count += np.bincount(number, minlength=len(centroids))
                np.add.at(total, number, vectors)
        used = np.flatnonzero(count)
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return add


def _assign(shared):
    def assign(batches):
        centroids, tree = shared.value
        for batch in batches:
            for piece in _pieces(batch):
                number, distance, _ = nearest(_matrix(piece.column(1)), centroids, tree)
                yield pa.record_batch(
                    [piece.column(0), pa.array(number, pa.int32()), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return assign


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    return vectors.select("vec_id", whole_numbers().alias("v")).where(
        v.isNotNull() & (F.size(v) == SIZE) & F.forall(v, lambda c: (c > -LIMIT) & (c < LIMIT))
    )


def first_centroids(kept: DataFrame, k: int = K) -> np.ndarray:
    """The vectors with the k smallest hashes, ties by their components."""
    name = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = kept.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over all vectors."""
    shared = kept.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids)))
    parts = kept.select("v").mapInArrow(_sums(shared), "cluster int, n bigint, sums array<bigint>")
    places = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(SIZE)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *places).collect():
        out[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(SIZE)]  # floors
    shared.destroy()
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors that are null, hold a null or non-finite component or have not SIZE
    components take no part, nor do those with floor(64 * x) of LIMIT or more in
    size, whose distances need not fit a long. A repeated row counts and is
    returned each time; a null vec_id has its place in the order of hashes as
    the word null. With fewer than ``k`` vectors each one is a centroid; no
    vectors give no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = cut_lineage(kept_vectors(vectors))
    centroids = first_centroids(kept, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    shared = spark.sparkContext.broadcast((centroids, build_tree(centroids)))
    found = cut_lineage(kept.mapInArrow(_assign(shared), "vec_id bigint, cluster int, distance bigint"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row for each cluster: looked up in literals, not joined.
    own = F.create_map(*[x for c, s in sorted(sums.items()) for x in (F.lit(c), F.lit(s).cast("long"))]) if sums else None
    hashed = F.array(*map(F.lit, names)) if names else None
    return found.select(
        "vec_id", "cluster", "distance",
        (own[F.col("cluster")] if sums else F.lit(None).cast("long")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        (F.element_at(hashed, F.col("cluster") + 1) if names else F.lit(None).cast("string")).alias("centroid_sha256"),
    )
