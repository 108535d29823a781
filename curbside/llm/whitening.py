"""Embedding whitening from the covariance of distinct vectors and their counts.

Identical vectors are grouped once; a group counts in the fit as often as it
occurs, or once. Sums and the weighted covariance, whose products are taken of
centred entries, are added up in each task and come to the driver as one matrix
of dimensions by dimensions. Every distinct vector is whitened once, and the
rows are joined back to what was worked out for their vector.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.session import cut_lineage, ship_package

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Eigenvalues up to this share of the greatest are rounding, not variance.
NO_VARIANCE = 1e-13
LONG = 2**63 - 1


def scaled(vector: str = "embedding"):
    """floor(SCALE * c) + SHIFT of each entry as array<bigint>; null for a vector
    that is null, holds a null or non-finite entry or one beyond a long."""
    x = F.col(vector)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * SCALE) >= float(2**62)))
    return F.when(x.isNotNull() & ~bad, F.transform(whole, lambda c: c.cast("bigint") + SHIFT))


def _matrix(column, size: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up as if with 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), size), SHIFT, np.int64)
    out[np.arange(size)[None, :] < lengths[:, None]] = flat
    return out


def _rows(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.arange(len(matrix)), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))],
        names=["at", "row"],
    )


def _collect(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the matrices of all tasks: ``size`` rows to the driver."""
    total = parts.groupBy("at").agg(F.array(*[F.sum(F.col("row")[k]) for k in range(size)]).alias("row"))
    out = np.zeros((size, size))
    for r in total.collect():
        out[r["at"]] = r["row"]
    return out


def _products(size: int, mean: np.ndarray):
    def products(batches):
        total = np.zeros((size, size))
        for batch in batches:
            weight = batch.column(1).to_numpy().astype(np.float64)
            centred = _matrix(batch.column(0), size) - mean
            total += (centred * weight[:, None]).T @ centred
        yield _rows(total)

    return products


def _moments(size: int, mean):
    """The same of whitened vectors, their own mean taken off."""

    def products(batches):
        total = np.zeros((size, size))
        for batch in batches:
            weight = batch.column(1).to_numpy().astype(np.float64)
            y = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, size) - mean
            total += (y * weight[:, None]).T @ y
        yield _rows(total)

    return products


def deviations(matrix: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n * x - S)^2 of each row; null beyond a long."""
    # n * x - S = n * (x - floor(S / n)) - S mod n, in small numbers if possible
    off = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    near = matrix - off
    top = (float(np.abs(near).max(initial=0)) + 1) * n
    if top * top * max(matrix.shape[1], 1) < 2**62:
        d = near * n - rest
        return (d * d).sum(axis=1).tolist()
    out = []
    for row in near.tolist():
        total = sum((n * x - r) ** 2 for x, r in zip(row, rest.tolist()))
        out.append(total if total <= LONG else None)
    return out


def _whiten(size: int, mean, axes, n: int, sums):
    def whiten(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                matrix = _matrix(part.column(0), size)
                y = (matrix - mean) @ axes
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(deviations(matrix, n, sums), pa.int64()),
                     pa.array(list(y), pa.list_(pa.float64()))],
                    names=["x", "weight", "deviation", "y"],
                )

    return whiten


def components_of(covariance: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and the unit vectors in columns, up to ``limit`` of
    them, without those that have no variance."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values[:limit] > NO_VARIANCE * max(values.max(initial=0), 0)
    return values[:limit][some], vectors[:, :limit][:, some]


def whitened(vectors: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    ``weights``: "counts" fits on all rows, "one" on each distinct vector once;
    n is the number of what was fitted on. Vectors that are null or hold a null
    or non-finite entry take no part. The number of dimensions is that of the
    longest vector; shorter ones are filled up as if with entries of 0. Without
    variance there are no components (all vectors alike, one vector, none): no
    rows then. A deviation beyond a long is null. Repeated rows and null vec_ids
    are rows like others; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select("vec_id", scaled().alias("x")).where("x is not null")
    counted = rows.groupBy("x").agg(F.count("*").alias("weight"))
    if weights == "one":
        counted = counted.withColumn("weight", F.lit(1).cast("long"))
    distinct = cut_lineage(counted)
    n, size = distinct.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    places = [
        F.sum((F.coalesce(F.get("x", F.lit(k)), F.lit(SHIFT)) * F.col("weight")).cast("decimal(38,0)")) for k in range(size)
    ]
    sums = [int(s) for s in distinct.agg(*places).first()] if size and n else []
    mean = np.array([s / n for s in sums])
    covariance = np.zeros((size, size))
    if sums:
        parts = distinct.select("x", "weight").mapInArrow(_products(size, mean), "at int, row array<double>")
        covariance = _collect(parts, size) / n
    values, axes = components_of(covariance, components) if sums else (np.zeros(0), None)
    if not len(values):
        return rows.select("vec_id").limit(0).select("vec_id", *[
            F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in kind.split(", ")[1:])
        ])
    done = cut_lineage(distinct.mapInArrow(
        _whiten(size, mean, axes / np.sqrt(values), n, sums),
        "x array<bigint>, weight bigint, deviation bigint, y array<double>",
    ))
    k = len(values)
    means = done.agg(*[F.sum(F.col("y")[c] * F.col("weight")) / n for c in range(k)]).first()
    spread = _collect(done.select("y", "weight").mapInArrow(_moments(k, np.array(means)), "at int, row array<double>"), k)
    error = float(np.abs(spread / n - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e)) for e in values / np.trace(covariance)])
    back = rows.join(done.select("x", "deviation", "y"), "x")
    return back.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
