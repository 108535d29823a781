"""The stop rules of paging and scrolling as state machines over streams.

Each keyword of a location, and each feed, is a sequence with a small state of
its own. Rows arrive in any order. What a rule cannot decide yet waits in the
state; event-time timers, moved on by the watermark, decide or forget it.
"""

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from curbside import fixed_values as fv
from curbside.session import ship_package


def _millis(times: pd.Series) -> list[int]:
    return [int(t.timestamp() * 1000) for t in times]


def _set_timer(state, at: int) -> None:
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


# --- pages ------------------------------------------------------------------


class Paging:
    """Search pages of one keyword. A page is reached when all pages before it
    have arrived with ``size`` results in some fetch. Both only ever come true,
    so that what is reached does not depend on the order of arrival: fetches
    wait for the pages before them and go out at once when these are there."""

    def __init__(self, size: int, front: int = 0, waiting=()):
        self.size, self.front, self.waiting = size, front, list(waiting)

    def add(self, fetches: list[tuple]) -> list[tuple]:
        """``fetches``: (offset, results, ...) that arrive; those reached now."""
        self.waiting += fetches
        out = []
        while True:
            out += [f for f in self.waiting if f[0] <= self.front]
            full = any(f[0] == self.front and (f[1] or 0) >= self.size for f in self.waiting)
            self.waiting = [f for f in self.waiting if f[0] > self.front]
            if not full:
                return out
            self.front += self.size


_REACHED = T.StructType([
    T.StructField("location", T.StringType()), T.StructField("keyword_idx", T.IntegerType()),
    T.StructField("offset", T.IntegerType()), T.StructField("results", T.IntegerType()), T.StructField("page_id", T.LongType()),
])


def reached_pages(pages: DataFrame, size: int = fv.RESULTS_PER_PAGE, delay: str = "1 day", close_after_ms: int = 86_400_000) -> DataFrame:
    """location, keyword_idx, offset, results and page_id of the pages that
    ``truncate_short_pages`` keeps, as soon as that is certain.

    ``pages``: a stream with those columns, ``kind`` and ``fetched_at``. Landing
    pages always go out. A keyword is closed ``close_after_ms`` after its last
    fetch, by the watermark: what waits then had a short or missing page before
    it and is forgotten. Offsets are multiples of ``size``.
    """
    ship_package(pages.sparkSession)
    timed = pages.withWatermark("fetched_at", delay)
    columns = [F.col(f.name).cast(f.dataType) for f in _REACHED]
    landing = timed.where("kind = 'landing'").select(*columns)
    searched = timed.where("kind = 'search'").select(*columns, "fetched_at")

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        front, waiting, last = (*state.get,) if state.exists else (0, "[]", 0)
        paging = Paging(size, front, map(tuple, json.loads(waiting)))
        for frame in frames:
            last = max([last, *_millis(frame["fetched_at"])])
            results = [None if pd.isna(r) else int(r) for r in frame["results"]]
            out = paging.add(list(zip(frame["offset"].tolist(), results, frame["page_id"].tolist())))
            if out:
                yield pd.DataFrame(
                    [(*key, o, r, p) for o, r, p in out], columns=_REACHED.fieldNames()
                ).astype({"results": "Int32"})
        state.update((paging.front, json.dumps(paging.waiting), last))
        _set_timer(state, last + close_after_ms)

    kept = searched.groupBy("location", "keyword_idx").applyInPandasWithState(
        step, _REACHED, "front int, waiting string, last long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return landing.unionByName(kept)


# --- snapshots --------------------------------------------------------------


class Scrolling:
    """Snapshots of one feed, taken in their order: the feed is stale, and
    closed, ``k`` snapshots after the last one that had a new post."""

    def __init__(self, k: int, last: int = 0, closed: bool = False, ids=(), waiting=()):
        self.k, self.last, self.closed = k, last, closed
        self.ids, self.waiting = set(ids), list(waiting)

    def take(self, until: int) -> list[tuple]:
        """Sightings (snapshot_no, id, at) up to the end of the feed, of the
        snapshots that are complete: all of them came before ``until``."""
        out: list[tuple] = []
        open_from = min((n for n, _, at in self.waiting if at > until), default=None)
        ready = sorted((s for s in self.waiting if open_from is None or s[0] < open_from), key=lambda s: s[0])
        self.waiting = [s for s in self.waiting if open_from is not None and s[0] >= open_from]
        fresh: set[str] = set()
        for at, sighting in enumerate(ready):
            if self.closed or sighting[0] > self.last + self.k:
                self.closed = True
                break
            out.append(sighting)
            if sighting[1] not in self.ids:
                fresh.add(sighting[1])
            if at + 1 == len(ready) or ready[at + 1][0] != sighting[0]:  # the snapshot ends
                if fresh:
                    self.last = sighting[0]
                self.ids |= fresh
                fresh = set()
        if self.closed:
            self.ids, self.waiting = set(), []
        return out


_SIGHTING = T.StructType([
    T.StructField("feed", T.LongType()), T.StructField("snapshot_no", T.IntegerType()), T.StructField("id", T.StringType()),
])


def fresh_sightings(sightings: DataFrame, k: int = fv.STALE_SNAPSHOTS, delay: str = "1 day") -> DataFrame:
    """feed, snapshot_no and id of the sightings that ``truncate_stale`` keeps.

    ``sightings``: a stream with those columns and ``seen_at``; later snapshots
    of a feed are seen later. A snapshot is judged when the watermark has passed
    it. State holds the ids of a feed until it is closed, then one flag.
    """
    ship_package(sightings.sparkSession)
    timed = sightings.withWatermark("seen_at", delay).select(*[F.col(f.name).cast(f.dataType) for f in _SIGHTING], "seen_at")

    def step(key, frames, state):
        last, closed, ids, waiting = (*state.get,) if state.exists else (0, False, "[]", "[]")
        scrolling = Scrolling(k, last, closed, json.loads(ids), map(tuple, json.loads(waiting)))
        for frame in frames:
            if not scrolling.closed:
                scrolling.waiting += zip(frame["snapshot_no"].tolist(), frame["id"].tolist(), _millis(frame["seen_at"]))
        out = scrolling.take(state.getCurrentWatermarkMs())
        if out:
            yield pd.DataFrame([(*key, n, i) for n, i, _ in out], columns=_SIGHTING.fieldNames())
        state.update((scrolling.last, scrolling.closed, json.dumps(sorted(scrolling.ids)), json.dumps(scrolling.waiting)))
        if scrolling.waiting:
            _set_timer(state, min(at for _, _, at in scrolling.waiting))

    return timed.groupBy("feed").applyInPandasWithState(
        step, _SIGHTING, "last int, closed boolean, ids string, waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )
