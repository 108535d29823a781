"""Counts along the way."""

import time

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from curbside import fixed_values as fv


def count_by_location(df: DataFrame) -> DataFrame:
    """Rows per location, and in total under a null location."""
    return df.rollup("location").agg(F.count("*").alias("listings"))


class Funnel:
    """Row counts of stages, taken while the job itself runs; ``counts`` can be
    asked at any time and tells of the stages whose action has ended."""

    def __init__(self):
        self._stages: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        self._stages[stage] = Observation(stage)
        return df.observe(self._stages[stage], F.count(F.lit(1)).alias("rows"))

    def counts(self, wait: float = 2.0) -> dict[str, int]:
        """Counts of the stages that have run, in their order. Figures arrive a
        little after the action that took them: where some are missing they are
        waited for ``wait`` seconds, and left out after that."""
        until = time.monotonic() + wait
        while not all(map(self._ended, self._stages.values())) and time.monotonic() < until:
            time.sleep(0.05)
        return {stage: seen.get["rows"] for stage, seen in self._stages.items() if self._ended(seen)}

    @staticmethod
    def _ended(seen: Observation) -> bool:
        # ``get`` would wait for an action that may never come.
        return seen._jo.future().isCompleted()


def running_total(
    df: DataFrame, group: str, step: str, value: str, out: str, width: int = 4096
) -> DataFrame:
    """Running sum of ``value`` over the whole-number ``step`` of each group.

    In two levels: a total per block of ``width`` steps, summed up over the
    blocks, and the sum inside a block. A long group is spread over many tasks;
    the first level has one row per block.
    """
    block = F.floor(F.col(step) / width)
    blocks = df.groupBy(group, block.alias("_block")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        group, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_block").orderBy(step)
    placed = df.withColumn("_block", block).join(offsets, [group, "_block"])
    return placed.withColumn(out, F.col("_before") + F.sum(value).over(inside)).select(*df.columns, out)


def snapshot_yield(posts: DataFrame, feed: str = "feed") -> DataFrame:
    """New and cumulative posts per snapshot of each feed. ``posts`` has every
    sighting with ``snapshot_no`` and ``id``.

    Two aggregations: a post counts in the snapshot of its first sighting, and
    every snapshot counts, with new posts or without.
    """
    first = posts.groupBy(feed, "id").agg(F.min("snapshot_no").alias("snapshot_no"))
    fresh = first.select(feed, "snapshot_no", F.lit(1).alias("new"))
    seen = posts.select(feed, "snapshot_no", F.lit(0).alias("new"))
    counted = fresh.unionByName(seen).groupBy(feed, "snapshot_no").agg(F.sum("new").alias("new_posts"))
    return running_total(counted, feed, "snapshot_no", "new_posts", "total_posts")


def truncate_stale(posts: DataFrame, k: int = fv.STALE_SNAPSHOTS, feed: str = "feed") -> DataFrame:
    """Sightings up to the ``k``-th snapshot in a row without a new post;
    snapshots count from 1.

    A run of ``k`` starts after a snapshot with new posts, or at the start,
    when none of the next ``k`` has any: a lookup of neighbours, not a scan of
    the feed in one task.
    """
    first = posts.groupBy(feed, "id").agg(F.min("snapshot_no").alias("snapshot_no"))
    fresh = first.select(feed, "snapshot_no").distinct()
    starts = fresh.unionByName(
        posts.select(feed).distinct().withColumn("snapshot_no", F.lit(0))
    )
    followed = (
        starts.withColumn("ahead", F.explode(F.expr(f"sequence(snapshot_no + 1, snapshot_no + {k})")))
        .join(fresh.select(F.col(feed), F.col("snapshot_no").alias("ahead")), [feed, "ahead"], "left_semi")
        .select(feed, "snapshot_no").distinct()
    )
    ends = (
        starts.join(followed, [feed, "snapshot_no"], "left_anti")
        .groupBy(feed).agg((F.min("snapshot_no") + k).alias("_end"))
    )
    return posts.join(ends, feed).where("snapshot_no <= _end").drop("_end")


def post_totals(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count("*").alias("total_posts"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count("*").alias("attempts"), F.count_if(F.col("success")).alias("total_actions")
    )
