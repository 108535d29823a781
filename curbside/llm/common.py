"""Small helpers that the operators of this subpackage share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.session import ship_package

#: Bytes of an Arrow batch handed to Python: long texts then cannot pile up.
BATCH_BYTES = 8 << 20
#: Bits of a set of hashed keys (8 MB, whatever the number of keys).
SET_BITS = 1 << 26


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what a Python task holds at once, by rows and by bytes, and sees
    to it that the workers have this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(column):
    """An Arrow column as Python strings, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def struct_of(**fields) -> T.StructType:
    """A struct type; as text, it could not be read before a session exists."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _marks_of(batches):
    """The set of a partition's places, as the words of it that are not 0."""
    bits = np.zeros(SET_BITS // 64, np.uint64)
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        np.bitwise_or.at(bits, at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
    used = np.flatnonzero(bits)
    yield pa.record_batch([pa.array(used, pa.int64()), pa.array(bits[used].view(np.int64))], names=["word", "bits"])


def place_of(*keys):
    """Where a key stands in a set of hashed keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(SET_BITS))


def may_be_in(df: DataFrame, *keys):
    """Column function: false for a ``place_of`` that no row of ``df`` has by its
    columns ``keys``. Of SET_BITS bits each key sets one, so that of few keys
    nearly all others are told apart; for the rest a join has to decide.
    """
    words = df.select(place_of(*keys).alias("place")).mapInArrow(_marks_of, "word bigint, bits bigint")
    bits = np.zeros(SET_BITS // 64, np.int64)
    for batch in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        bits[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf(T.BooleanType())
    def may_be(place: pa.Array) -> pa.Array:
        at = place.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return may_be


def row_key():
    """A struct that tells rows apart by doc_id and a hash of the whole text."""
    return F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def same_key(left, right):
    parts = [left.getField(c).eqNullSafe(right.getField(c)) for c in ("doc_id", "text_hash")]
    return parts[0] & parts[1]


def whole_rows(docs: DataFrame) -> DataFrame:
    """(whole, key): each row as a struct, and its ``row_key``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row_key().alias("key"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``gone`` (key). Texts
    travel only where the set of hashed keys does not say that they stay."""
    whole = whole_rows(docs)
    may_go = may_be_in(gone, "key")(place_of("key"))
    unsure = whole.where(may_go)
    alone = unsure.join(gone, same_key(unsure["key"], gone["key"]), "left_anti")
    return whole.where(~may_go).unionByName(alone).select("whole.*")
