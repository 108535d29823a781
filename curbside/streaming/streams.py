"""The same records as streams. State is bounded by watermarks; what comes
later than that is held against the published keys (``published``)."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from curbside import fixed_values as fv
from curbside.functions import urls
from curbside.functions.markup import Profile
from curbside.operators import clean, html
from curbside.session import ship_package
from curbside.sources.locations import join_location
from curbside.streaming.measures import StreamFunnel


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table as it grows, whether ``path`` is one file or a folder of
    files. As a pattern it may be either; a plain path has to be a folder."""
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, files_per_trigger=files_per_trigger)


def stream_listings(
    pages: DataFrame, profile: Profile = html.SEARCH, delay: str = "1 day",
    details: DataFrame | None = None, wait: str = "1 day", funnel: StreamFunnel | None = None,
) -> DataFrame:
    """Arriving search pages (with ``fetched_at`` and ``location``) to valid
    listings, the first sighting of each url in a location. Links and locations
    are resolved as in the batch job, which its rows therefore match.

    ``details``: a stream of detail pages (``url``, ``fetched_at``, ``html``).
    Each row is then joined with the page of its url that was fetched up to
    ``wait`` before or after it, the first to arrive; search values win. A row
    without one comes out alone once the watermarks of both streams have passed
    that time, so both have to go on for rows to come out.

    ``funnel`` counts the rows of the stages raw, url_unique and valid.
    """

    def watch(df, stage):
        return funnel.watch(df, stage) if funnel else df

    placed = join_location(
        pages.withWatermark("fetched_at", delay).withColumnRenamed("location", "location_key")
    )
    rows = html.extract_search_rows(placed, profile)
    resolved = rows.withColumns({
        "url": urls.absolute_url(F.col("url"), F.col("base_url")),
        "location": urls.location_key(F.col("location_key"), F.col("dim_state")),
    })
    first = watch(watch(resolved, "raw").dropDuplicatesWithinWatermark(["location", "url"]), "url_unique")
    if details is not None:
        first = _with_details(first, details, delay, wait)
    return watch(clean.validate(clean.to_listing(first)), "valid")


def _with_details(rows: DataFrame, details: DataFrame, delay: str, wait: str) -> DataFrame:
    """A left outer join of two streams: state holds the rows and the details
    of one ``wait`` on either side of the watermark, spread by url."""
    pages = details.select(
        F.col("url").alias("details_url"), F.col("fetched_at").alias("details_at"), "html"
    ).withWatermark("details_at", delay)
    read = html.extract_details(pages).drop("title", "raw_price")
    first = read.dropDuplicatesWithinWatermark(["details_url"])
    near = F.expr(
        f"url = details_url and details_at >= fetched_at - interval {wait} and details_at <= fetched_at + interval {wait}"
    )
    return rows.join(first, near, "left_outer")


def stream_posts(posts: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """Arriving post rows, the first sighting of each id."""
    return html.keep_posts(posts).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id"])


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write all that has arrived to Parquet, then stop."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


#: Rows of a batch of attempts, which are a few numbers each.
ATTEMPTS_PER_BATCH = 20_000


def _open_attempts(frame: pd.DataFrame, room: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Attempts in order while the successes before each are fewer than
    ``room``, and these numbers. By arrays: one call a session has few rows, and
    pandas takes longer to begin than they take."""
    places = [frame["event_id"].to_numpy(), frame["ts"].to_numpy()]
    if any(p.dtype == object for p in places):
        frame = frame.sort_values(["ts", "event_id"], kind="stable")
        order = np.arange(len(frame))
    else:
        order = np.lexsort(places)
    won = (frame["success"].to_numpy() == True).astype(np.int64)[order]  # noqa: E712
    before = won.cumsum() - won
    open_ = int(np.searchsorted(before, room))
    return frame.take(order[:open_]), before[:open_]


def stream_quota(events: DataFrame, limit: int = fv.ACTION_LIMIT, forget_after_ms: int | None = None) -> DataFrame:
    """Accepted attempts of an event stream with ``action_number`` and
    ``remaining``, as in ``quota_ledger``.

    The state store holds one number for each session: its successes so far. It
    is never reset, unless ``forget_after_ms`` is given: then a session without
    attempts for so long (processing time) is forgotten and starts anew. Order is
    that of arrival between micro-batches and of (ts, event_id) within one.

    A session's attempts of one micro-batch are taken in as they are read; what
    can no longer be accepted is let go at once, and a session that is used up
    costs nothing. What a task holds is bounded by the size of the micro-batch.
    """
    ship_package(events.sparkSession)
    kind = T.StructType([
        *events.schema.fields, T.StructField("action_number", T.LongType()), T.StructField("remaining", T.LongType())
    ])

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        held = None
        for frame in frames:
            if used < limit:
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
                held, before = _open_attempts(held, limit - used)
        if held is not None:
            won = held["success"]
            won = won.astype("int64") if won.dtype == bool else won.astype("boolean").astype("Int64")
            yield held.assign(action_number=used + before + 1, remaining=limit - used - before - won)
            state.update((used + int(won.sum()),))
        elif forget_after_ms is not None:
            state.update((used,))
        if forget_after_ms is not None:
            state.setTimeoutDuration(forget_after_ms)

    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("session").applyInPandasWithState(step, kind, "used long", "append", timeout)


def run_quota(events: DataFrame, out: str, checkpoint: str, limit: int = fv.ACTION_LIMIT) -> None:
    """Write the accepted attempts of all events that have arrived, then stop.
    Counters go on from the checkpoint."""
    attempts = events.select("session", "ts", "event_id", "success")
    # A stream takes the settings it is started with; pages need smaller batches.
    conf, name = events.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    small = conf.get(name)
    conf.set(name, str(ATTEMPTS_PER_BATCH))
    try:
        run_available(stream_quota(attempts, limit), f"{out}/ledger", checkpoint)
    finally:
        conf.set(name, small)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/ledger")
