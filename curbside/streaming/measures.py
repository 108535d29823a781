"""Counts along streams: funnels of their stages, yields over event time."""

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class StreamFunnel(StreamingQueryListener):
    """Row counts of the stages of streams, taken by the micro-batches as they
    run and summed up. Enter it with ``spark.streams.addListener``.

    A micro-batch that is repeated after a failure reports under its own number
    again and counts once. ``counts`` can be asked at any time; it tells of the
    micro-batches that have ended.
    """

    def __init__(self):
        self._stages: list[str] = []
        self._seen: dict[tuple, int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        self._stages.append(stage)
        return df.observe(stage, F.count(F.lit(1)).alias("rows"))

    def _run(self, run) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event):
        self._run(event.runId)

    def onQueryProgress(self, event):
        progress = event.progress
        with self._lock:
            for stage, row in progress.observedMetrics.items():
                if stage in self._stages:
                    self._seen[str(progress.id), progress.batchId, stage] = row["rows"] or 0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._run(event.runId).set()

    def settle(self, query, wait: float = 30.0) -> None:
        """Wait until all that ``query``, which has ended, reported is here."""
        self._run(query.runId).wait(wait)

    def counts(self) -> dict[str, int]:
        with self._lock:
            out = dict.fromkeys(self._stages, 0)
            for (_, _, stage), rows in self._seen.items():
                out[stage] += rows
            return out


def _first_and_all(rows: DataFrame, keys: list[str], time: str, delay: str, columns: list[str]) -> DataFrame:
    """Every row with ``n`` 1, and the first to arrive of each key once more
    with ``fresh`` 1."""
    timed = rows.withWatermark(time, delay)
    every = timed.select(time, *columns, F.lit(1).alias("n"), F.lit(0).alias("fresh"))
    first = timed.dropDuplicatesWithinWatermark(keys).select(time, *columns, F.lit(0).alias("n"), F.lit(1).alias("fresh"))
    return every.unionByName(first)


def page_yield_windows(rows: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Results and new results per window of ``fetched_at``, location, keyword
    and offset: ``page_yield`` over event time. A result is new where its url
    arrives for the first time in its location within the watermark. Windows
    come out once, when the watermark has passed them; their counts are partial
    sums in the state store, so a window with most of the rows stays small.
    """
    places = ["location", "keyword_idx", "offset"]
    counted = _first_and_all(rows, ["location", "url"], "fetched_at", delay, places)
    found = counted.groupBy(F.window("fetched_at", width).alias("window"), *places).agg(
        F.sum("n").alias("results"), F.sum("fresh").alias("new_results")
    )
    return found.select(F.col("window.start").alias("window_start"), *places, "results", "new_results")


def sighting_yield_windows(posts: DataFrame, width: str = "1 hour", delay: str = "1 day", feed: str = "feed") -> DataFrame:
    """Sightings and new posts of each feed per window of ``seen_at``."""
    counted = _first_and_all(posts, [feed, "id"], "seen_at", delay, [feed])
    found = counted.groupBy(F.window("seen_at", width).alias("window"), feed).agg(
        F.sum("n").alias("sightings"), F.sum("fresh").alias("new_posts")
    )
    return found.select(F.col("window.start").alias("window_start"), feed, "sightings", "new_posts")
