"""Connected components over a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u that is not the smallest of its component v.

    ``edges``: u, v longs with u > v; repeated edges do no harm; no edges give
    no rows. In each round a node takes the smallest parent it has, goes on to
    that parent's own parent, and hands its other parents to its smallest one.
    Rounds follow the logarithm of the longest chain. Hubs are only ever
    aggregated with partial sums per task or joined from stored tables, where
    adaptive execution splits them.
    """
    now = cut_lineage(edges.distinct())
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        least = cut_lineage(now.groupBy("u").agg(F.min("v").alias("least")))
        own = least.select("u", F.col("least").alias("mu"))
        above = least.select(F.col("u").alias("v"), F.col("least").alias("mv"))
        both = cut_lineage(now.join(own, "u")).join(above, "v", "left")
        jump = both.select("u", F.coalesce("mv", "v").alias("v"))
        handed = both.where("v <> mu").select(F.col("v").alias("u"), F.col("mu").alias("v"))
        now = cut_lineage(jump.unionByName(handed).distinct())
    return now
