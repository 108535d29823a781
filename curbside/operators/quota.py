"""Attempts against a per-session limit of successes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside.operators.dedup import first_per


def quota_ledger(events: DataFrame, limit: int = fv.ACTION_LIMIT) -> DataFrame:
    """Accepted attempts with ``action_number`` and ``remaining``.

    ``events`` has ``session``, ``ts``, ``event_id`` and ``success``. An attempt
    is accepted while the session has fewer than ``limit`` earlier successes.
    Only the first ``limit`` successes of a session matter: they are taken with
    a group limit and joined as one short list per session, so that a session
    with most of the events is neither sorted nor numbered in one task.
    """
    at = F.struct("ts", "event_id")
    wins = first_per(events.where("success").select("session", "ts", "event_id"),
                     ["session"], ["ts", "event_id"], limit)
    lists = wins.groupBy("session").agg(F.array_sort(F.collect_list(at)).alias("_wins"))
    lists = lists.withColumnRenamed("session", "_session")
    placed = events.join(lists, F.col("session").eqNullSafe(F.col("_session")), "left").withColumn(
        "_before",
        F.when(F.col("_wins").isNull(), 0).otherwise(F.size(F.filter("_wins", lambda w: w < at))),
    )
    accepted = placed.where(F.col("_before") < limit)
    return accepted.select(
        *events.columns,
        (F.col("_before") + 1).cast("bigint").alias("action_number"),
        (F.lit(limit) - F.col("_before") - F.col("success").cast("int")).cast("bigint").alias("remaining"),
    )
