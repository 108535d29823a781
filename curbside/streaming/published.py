"""Keys that were published already, as a bucketed table beside a stream.

A stream's own seen-set ends at its watermark. What comes later is held against
this table: it is bucketed by the key, so that a micro-batch is dealt out to its
buckets and joined there, while the history stays where it is.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.operators.dedup import first_per

BUCKETS = 64


def published_keys(spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = BUCKETS) -> str:
    """Name of the table of published keys that is stored in ``folder``: the
    ``keys`` (name and SQL type) and the micro-batch that brought them. The files
    are the table; the name is entered in the session's catalog if need be."""
    name = "published_" + hashlib.md5(folder.encode()).hexdigest()[:16]
    columns = ", ".join(f"`{k}` {kind}" for k, kind in keys.items())
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"create table if not exists {name} ({columns}, batch bigint) using parquet "
        f"clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{folder}'"
    )
    return name


def unpublished(rows: DataFrame, name: str, keys: list[str], batch: int | None = None) -> DataFrame:
    """Rows whose key the table does not have; with ``batch``, keys that this
    micro-batch or a later one brought do not count, so that it can be repeated.
    """
    known = rows.sparkSession.table(name)
    if batch is not None:
        known = known.where(F.col("batch") < batch)
    return rows.join(known.select(*keys), list(keys), "left_anti")


def run_unpublished(
    rows: DataFrame, out: str, checkpoint: str, folder: str, keys: list[str], order: list[str],
    buckets: int = BUCKETS,
) -> None:
    """Write the rows of a stream whose key was never written before, then stop.

    Of a key's rows in one micro-batch the first by ``order`` counts. Each
    micro-batch writes to a folder of its own and then enters its keys. If it is
    repeated after a failure it overwrites that folder and does not see its own
    keys; entering them twice does no harm. One stream writes to one table.
    """
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}

    def step(frame: DataFrame, batch: int) -> None:
        spark = frame.sparkSession
        name = published_keys(spark, folder, kinds, buckets)
        place = f"{out}/batch={batch}"
        fresh = unpublished(first_per(frame, list(keys), list(order)), name, keys, batch)
        fresh.write.mode("overwrite").parquet(place)
        entered = spark.read.schema(rows.schema).parquet(place).select(*keys, F.lit(batch).cast("bigint").alias("batch"))
        entered.repartition(buckets, *keys).write.insertInto(name)

    (rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
       .trigger(availableNow=True).start().awaitTermination())


def read_unpublished(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")
