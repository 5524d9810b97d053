"""Streams of page revisions: the latest version per page, and guarded publishing.

A revision row is page_id, version, client, ts, event_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wikiloom.session import WorkFolder
from wikiloom.sources import snapshots

REVISION = "page_id string, version int, client string, ts timestamp, event_id bigint"
VERDICT = (
    "page_id string, event_id bigint, client string, seen int, version int, accepted boolean"
)
LATEST = "latest"
#: Versions of the table of newest revisions that stay readable.
KEPT_VERSIONS = 3
_COLUMNS = ("page_id", "version", "client", "ts", "event_id")
#: How late an attempt may come, in event time.
DELAY = "10 minutes"
#: Groups of pages that the guard judges together; several for each of a stream's partitions. A checkpoint keeps its number.
GROUPS = 1024
_WAITING = ("page_id", "at", "event_id", "client")
#: Attempts in one entry of the waiting list.
_ENTRY = 10_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_revisions(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of revision files as a stream, oldest file first."""
    return (
        spark.readStream.schema(REVISION)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def latest(revisions: DataFrame) -> DataFrame:
    """The revision with the highest version of every page, by a partial aggregate."""
    newest = F.max_by(F.struct("version", "client", "ts", "event_id"), F.col("version"))
    return revisions.groupBy("page_id").agg(newest.alias("_r")).select("page_id", "_r.*")


def follow_latest(revisions: DataFrame, out: str, checkpoint: str) -> None:
    """Keep the newest revision of every page in ``out`` until the stream is used up.

    After every micro-batch the table holds one row for each page: the batch's newest revisions are
    merged into the shards they fall into, as one new version of the table. A batch that is replayed
    finds its version there and changes nothing; versions before the last ones are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = snapshots.Store(batch.sparkSession, out)
        changes = {LATEST: (latest(batch).select(*_COLUMNS), ["page_id"])}
        store.merge(changes, run=f"{checkpoint}/{number}", combine=lambda before, new: latest(before.unionByName(new)).select(*_COLUMNS))
        store.expire(keep=KEPT_VERSIONS)

    (
        revisions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The table that ``follow_latest`` keeps; empty before its first batch."""
    found = snapshots.Store(spark, out).read(LATEST)
    return spark.createDataFrame([], REVISION).select(*_COLUMNS) if found is None else found


class PublishGuard(StatefulProcessor):
    """Judges a page's attempts by (ts, event_id) once the watermark has passed them.

    A key is a group of pages, so that calls to the state, timers and frames of rows are paid for once
    a group. Its state: each page's version with what its clients know, as (client, version, time of its
    last attempt); the attempts that wait for the watermark, as columns, one entry for each frame of
    rows; and the time of its one timer, which stands at the earliest waiting attempt, and with
    ``forget`` (microseconds) at the earliest time a client may be forgotten. Only the pages of due
    attempts are read and written, with ``forget`` all of the group.
    """

    def __init__(self, forget: int | None = None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")
        self.pages = handle.getMapState(
            "pages", "page_id string", "version int, clients array<struct<client: string, seen: int, at: bigint>>"
        )
        self.waiting = handle.getListState(
            "waiting", "page_id array<string>, at array<bigint>, event_id array<bigint>, client array<string>"
        )

    def close(self) -> None:
        pass

    def _wake(self, standing: int | None, at: int) -> None:
        """A timer at the first millisecond that is not before ``at`` microseconds."""
        at = -(-at // 1000)
        if standing is not None:
            if standing <= at:
                return
            self.handle.deleteTimer(standing)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for batch in rows:
            paged = batch[batch["page_id"].notna()]
            if len(paged):
                self.waiting.appendValue(tuple(paged[name].tolist() for name in _WAITING))
                first.append(int(paged["at"].min()))
        if first:
            self._wake(*(self.timer.get() or (None,)), min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # an attempt that was read twice is one attempt
        rows = {row for columns in self.waiting.get() for row in zip(*columns)}
        due = sorted((row for row in rows if row[1] <= now), key=lambda row: row[:3])
        rest = [row for row in rows if row[1] > now]
        if rest:
            parts = (rest[start : start + _ENTRY] for start in range(0, len(rest), _ENTRY))
            self.waiting.put([tuple(map(list, zip(*part))) for part in parts])
        else:
            self.waiting.clear()
        verdicts = []
        for page, attempts in groupby(due, key=lambda row: row[0]):
            version, clients = self.pages.getValue((page,)) or (0, [])
            known = {client: (seen, last) for client, seen, last in clients}
            for _, at, event, client in attempts:
                seen, last = known.get(client) or (0, at)
                if self.forget is not None and last + self.forget < at:
                    seen = 0
                accepted = seen in (0, version)
                version += accepted
                known[client] = version, at
                verdicts.append((page, event, client, seen, version, accepted))
            self.pages.updateValue((page,), (version, [(client, *state) for client, state in known.items()]))
        wake = [row[1] for row in rest]
        if self.forget is not None:
            for (page,), (version, clients) in list(self.pages.iterator()):
                kept = [tuple(state) for state in clients if state[2] + self.forget >= now]
                if len(kept) < len(clients):
                    self.pages.updateValue((page,), (version, kept))
                wake.extend(last + self.forget + 1000 for _, _, last in kept)
        if wake:
            self._wake(None, min(wake))
        else:
            self.timer.clear()
        if verdicts:
            yield pd.DataFrame(verdicts, columns=["page_id", "event_id", "client", "seen", "version", "accepted"])


def guard_versions(attempts: DataFrame, delay: str = DELAY, forget: int | None = None) -> DataFrame:
    """Judge publish attempts: every client publishes with the version it last saw.

    An attempt is accepted if that is the page's current version or 0, and raises the version;
    otherwise it is a conflict, after which the client knows the current version. Attempts are judged
    by (ts, event_id) whatever files they come in, once the watermark, the newest ``ts`` of all pages
    less ``delay``, has passed them. What comes later than that is dropped, as is what is read again
    after its verdict; an attempt that is read again while it waits counts once. ``forget`` seconds
    after its last attempt a client counts as new, and leaves the state; by default never. Attempts
    without a page move the watermark and have no verdict; such a row with a late ``ts`` (``close_feed``)
    brings out the verdicts of a feed's end. An attempt without ``ts`` has none either. The session
    needs the RocksDB state store, which ``run_guard`` sets.

    The state of a page is one number, two for each client, and the attempts of the last ``delay``.
    Pages are judged in ``GROUPS`` groups by the hash of their id.
    """
    timed = attempts.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    group = F.pmod(F.xxhash64("page_id"), F.lit(GROUPS)).cast("int")
    return (
        timed.select(group.alias("group"), "page_id", F.unix_micros("ts").alias("at"), "event_id", "client", "ts")
        .groupBy("group")
        .transformWithStateInPandas(
            PublishGuard(None if forget is None else forget * 1_000_000), VERDICT, "Append", "EventTime"
        )
    )


def run_guard(attempts: DataFrame, out: str, checkpoint: str, delay: str = DELAY, forget: int | None = None) -> None:
    """Write the verdicts of all available attempts to ``out``."""
    conf = attempts.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKSDB)
    try:  # a stream keeps the settings it was started with
        query = (
            guard_versions(attempts, delay, forget)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(_STORE, before)
    query.awaitTermination()


def close_feed(revisions: DataFrame, folder: str, after: str = DELAY) -> None:
    """A last file for a feed: one row without a page, more than ``after`` behind the newest revision.

    It lets the watermark pass all that the feed holds; a feed that goes on later must begin behind it.
    """
    late = F.max("ts") + F.expr(f"interval {after}") + F.expr("interval 1 second")
    end = revisions.agg(late.alias("ts")).where(F.col("ts").isNotNull())
    none = F.lit(None)
    end.select(
        none.cast("string").alias("page_id"), none.cast("int").alias("version"), none.cast("string").alias("client"),
        "ts", none.cast("bigint").alias("event_id"),
    ).coalesce(1).write.mode("append").parquet(folder)


def write_in_time_order(
    revisions: DataFrame, folder: str, ranges: int = 8, files: int = 4
) -> int:
    """Revisions as a folder that a file stream reads range by range; returns a range's length in seconds.

    The rows are cut into ``ranges`` time ranges of equal length, written one after the other, so
    none comes later than that length behind another. Within a range they are in no order, and a
    page's rows in any of the files. ``revisions`` is evaluated once, into a work table.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    work = WorkFolder.scratch(revisions.sparkSession, "feed")
    kept = work.keep(revisions, "revisions")
    bounds = kept.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    if bounds["first"] is None:
        kept.write.mode("append").parquet(folder)
        return 1
    width = (bounds["last"] - bounds["first"]) // ranges + 1
    for number in range(ranges):
        start = bounds["first"] + number * width
        part = kept.where(at.between(start, start + width - 1))
        part.repartition(files, "event_id").write.mode("append").parquet(folder)
    return -(-width // 1_000_000)
