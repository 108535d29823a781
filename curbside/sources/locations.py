"""The constant location dimension."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside import fixed_values as fv


def location_dim(spark: SparkSession) -> DataFrame:
    """The dimension as a table of literals, which plans know the size of."""
    names = ["location_idx", "location_key", "base_url", "dim_state", "dim_city", "ring"]
    rows = [
        {**dict(zip(names, (i, *place))), "neighborhoods": fv.NEIGHBORHOODS[place[0]],
         "streets": fv.STREETS[place[0]], "zip_codes": fv.ZIP_CODES[place[0]]}
        for i, place in enumerate(fv.LOCATIONS)
    ]
    texts = pa.list_(pa.string())
    kind = pa.schema(
        [("location_idx", pa.int32()), *[(n, pa.string()) for n in names[1:]],
         ("neighborhoods", texts), ("streets", texts), ("zip_codes", texts)]
    )
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=kind))


def join_location(df: DataFrame) -> DataFrame:
    """Add the dimension by ``location_key``; unknown locations drop out. The
    dimension is a constant of two rows, so it is always broadcast."""
    return df.join(F.broadcast(location_dim(df.sparkSession)), "location_key")


def unknown_locations(df: DataFrame) -> DataFrame:
    """The ``location_key``s that the dimension does not have, one row each:
    stage, key, reason. What ``join_location`` drops does not go unnoticed."""
    known = F.broadcast(location_dim(df.sparkSession).select("location_key"))
    keys = df.select("location_key").distinct().join(known, "location_key", "left_anti")
    return keys.select(
        F.lit("location").alias("stage"), F.col("location_key").alias("key"), F.lit("unknown location").alias("reason")
    )
