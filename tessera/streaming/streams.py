"""Continuous forms over landing folders. State is bounded by watermarks and by timers in event time, so it also works with queries that end by themselves; the batch
jobs reconcile what comes later."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.functions.store import BucketTable, ship, stored, upsert


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def stream_evidence(landing: DataFrame, key: str = "key", at: str = "discovered_at", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return landing.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def stream_activity(landing: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """person_id, day, n, value by tumbling day; rows later than the watermark are dropped and counted by Spark's metrics."""
    return landing.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), "person_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("person_id", F.col("w.start").alias("day"), "n", "value")


#: Milliseconds of a day.
DAY = 86_400_000


def _millis(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class _Ring(StatefulProcessor):
    """A person's counts of the last days, by day. When the watermark passes a day's end, the window that ends there is final: it is emitted, and the
    day that no later window needs goes."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle) -> None:
        self.handle, self.ring = handle, handle.getValueState("ring", "next long, day array<long>, n array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.ring.exists()
        due, days, counts = self.ring.get() if known else (None, [], [])
        ring, new = dict(zip(days, counts, strict=True)), (_millis(rows)["at"] // DAY).value_counts()
        for day, n in new.items():
            ring[int(day)] = ring.get(int(day), 0) + int(n)
        if due is None or int(new.index.min()) < due:
            due = int(new.index.min())
            self.handle.registerTimer((due + 1) * DAY)
        self.ring.update((due, list(ring), list(ring.values())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ring.exists():
            return
        due, days, counts = self.ring.get()
        ring, out = dict(zip(days, counts, strict=True)), []
        while ring and (due + 1) * DAY <= timerValues.getCurrentWatermarkInMs():
            n = sum(v for d, v in ring.items() if due - self.days < d <= due)
            if n:
                out.append((key[0], pd.Timestamp((due + 1) * DAY, unit="ms"), n))
            due += 1
            ring = {d: v for d, v in ring.items() if d > due - self.days}
        if ring:
            self.ring.update((due, list(ring), list(ring.values())))
            self.handle.registerTimer((due + 1) * DAY)
        else:
            self.ring.clear()
        if out:
            yield pd.DataFrame(out, columns=["person_id", "until", "n"])

    def close(self) -> None:
        pass


def stream_activity_90d(landing: DataFrame, at: str = "ts", late: str = "1 day", days: int = 90) -> DataFrame:
    """person_id, until, n: activity in the `days` days that end at `until`, once a day for who has any, when the watermark has passed it.

    State is a ring of daily counts a person. Days are those of UTC. Needs the RocksDB state store.
    """
    rows = landing.withWatermark(at, late).select("person_id", at, F.unix_millis(at).alias("at"))
    return _by(rows, "person_id").transformWithStateInPandas(statefulProcessor=_Ring(days), outputStructType="person_id long, until timestamp, n long", outputMode="Append", timeMode="EventTime")


class _Best(StatefulProcessor):
    """Keeps a key's best confidence and emits a row when a better one comes. With `keep` (milliseconds) a key without rows for so long goes."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        self.handle, self.best = handle, handle.getValueState("best", "confidence double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, last = self.best.get() if self.best.exists() else (float("-inf"), -1)
        frame = _millis(rows)
        top, now = frame["confidence"].max(), last
        if self.keep:
            now = max(last, int(frame["at"].max()))
            if last < 0:
                self.handle.registerTimer(now + self.keep)
        if top > known or now > last:
            self.best.update((float(max(top, known)), int(now)))
        if top > known:
            yield pd.DataFrame({"key": [key[0]], "confidence": [top]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.best.exists():
            last = self.best.get()[1]
            if last + self.keep <= timerValues.getCurrentWatermarkInMs():
                self.best.clear()
            else:
                self.handle.registerTimer(last + self.keep)
        return iter([])

    def close(self) -> None:
        pass


def _by(rows: DataFrame, key: str) -> GroupedData:
    """Rows grouped for a stateful processor of this module, which is sent to the workers."""
    ship(rows.sparkSession)
    return rows.groupBy(key)


def _mode(days: int | None) -> str:
    return "EventTime" if days else "None"


def stream_best_evidence(landing: DataFrame, days: int | None = None, at: str = "discovered_at", late: str = "1 day") -> DataFrame:
    """(key, confidence) upgrades of each key. With `days`, a key is forgotten when the watermark is so many days past its last row, and starts anew;
    rows later than the watermark are dropped. Without, state grows with the keys and no time is needed. Needs the RocksDB state store."""
    rows = landing.withWatermark(at, late).select("key", "confidence", at, F.unix_millis(at).alias("at")) if days else landing.select("key", "confidence")
    return _by(rows, "key").transformWithStateInPandas(statefulProcessor=_Best(days and days * DAY), outputStructType="key string, confidence double", outputMode="Update", timeMode=_mode(days))


def upserts_to(path: str, keys: list[str], replace: list[str], first: str | None = None, last: str | None = None, buckets: int = 512) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that merges each batch into a BucketTable, of which it reads and rewrites the touched buckets only.

    A batch that runs again changes nothing. If the table is gone that a later batch should go on from, the stream fails and doesn't start
    from an empty one.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = BucketTable(batch.sparkSession, path, keys, buckets)
        if number and not table.versions():
            raise FileNotFoundError(f"{path} has no version before batch {number}; a stream that starts anew needs a new folder")
        # One row a key, also within the first batch.
        table.apply(batch, number, lambda old, new: upsert(old, new.select(old.columns), keys, replace, first, last))

    return write


def research_queue(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """The queue's table: candidate_id, n (changes), next_at (the first of them), claimed_until."""
    return BucketTable(spark, path, ["candidate_id"], buckets)


def stream_research_queue(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """One pending row a changed candidate: the number of changes and the first of them. Each batch adds to the rows of its candidates."""

    def write(batch: DataFrame, number: int) -> None:
        one = batch.groupBy("candidate_id").agg(F.count("*").alias("n"), F.min("discovered_at").alias("next_at"), F.lit(None).cast("timestamp").alias("claimed_until"))
        add = [F.sum("n").alias("n"), F.min("next_at").alias("next_at"), F.max("claimed_until").alias("claimed_until")]
        research_queue(batch.sparkSession, path, buckets).apply(one, number, lambda old, new: old.unionByName(new).groupBy("candidate_id").agg(*add), "changes")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The research queue as it is."""
    return research_queue(spark, path, buckets).rows()


def claim(spark: SparkSession, path: str, number: int, most: int, now: str, until: str, buckets: int = 64) -> DataFrame:
    """The first `most` rows of the queue that nobody holds, by next_at; they are held until `until`. A claim that runs again under its number gives
    the same rows."""
    table, at = research_queue(spark, path, buckets), F.lit(until).cast("timestamp")
    free = table.rows().filter(F.col("claimed_until").isNull() | (F.col("claimed_until") <= F.lit(now).cast("timestamp")))
    taken = stored(free.orderBy("next_at", "candidate_id").limit(most).withColumn("claimed_until", at), "claimed")
    version = table.apply(taken, number, lambda old, new: old.join(new.select("candidate_id"), "candidate_id", "left_anti").unionByName(new), "claims")
    return table.rows(version).join(taken.select("candidate_id"), "candidate_id", "left_semi")


def complete(spark: SparkSession, path: str, number: int, done: DataFrame, buckets: int = 64) -> None:
    """Takes finished candidates (candidate_id, n: the changes that were looked at) off the queue. One that changed meanwhile stays, for the rest."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        left = old.join(new.select("candidate_id", F.col("n").alias("seen")), "candidate_id", "left")
        rest = left.withColumn("n", F.col("n") - F.coalesce("seen", F.lit(0))).filter("n > 0")
        return rest.withColumn("claimed_until", F.when(F.col("seen").isNull(), F.col("claimed_until"))).select(old.columns)

    research_queue(spark, path, buckets).apply(done, number, merge, "completions")


def stream_score_refresh(changes: DataFrame, history: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "person_id") -> StreamingQuery:
    """Rescores only the people that a batch touches, over their whole history."""

    def write(batch: DataFrame, number: int) -> None:
        touched = batch.select(key).distinct()
        score(history().join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Window(StatefulProcessor):
    """Counts requests of a key in fixed windows. With `evict`, a window's state goes when the watermark passes its end: the next request starts anew anyway."""

    def __init__(self, limit: int, seconds: int, evict: bool) -> None:
        self.limit, self.seconds, self.evict = limit, seconds, evict

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.state.get() if self.state.exists() else (-1, 0)
        before, out = start, []
        for at in sorted(x for f in rows for x in f["at"].tolist()):
            own = at // self.seconds * self.seconds
            start, n = (own, 1) if own > start else (start, n + 1)
            out.append((key[0], at, n <= self.limit, max(0, self.limit - n), max(0, start + self.seconds - at) if n > self.limit else 0))
        self.state.update((int(start), int(n)))
        if self.evict and start > before:
            self.handle.registerTimer((int(start) + self.seconds) * 1000)
        yield pd.DataFrame(out, columns=["key", "at", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and (self.state.get()[0] + self.seconds) * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_rate_window(requests: DataFrame, limit: int, seconds: int, days: int | None = None) -> DataFrame:
    """key, at, allowed, remaining, retry_after for requests (key, at: epoch seconds). With `days`, a key's state goes when the watermark, so many days
    behind the newest request, passes its window; later requests are dropped. Without, state grows with the keys. Needs the RocksDB state store."""
    rows = requests.select("key", "at", F.timestamp_seconds("at").alias("moment")).withWatermark("moment", f"{days} days") if days else requests.select("key", "at")
    return _by(rows, "key").transformWithStateInPandas(statefulProcessor=_Window(limit, seconds, bool(days)), outputStructType="key string, at long, allowed boolean, remaining long, retry_after long", outputMode="Append", timeMode=_mode(days))


class _Run(StatefulProcessor):
    """A run fails when the watermark passes its deadline, counted from its start, and no end by then is known. A run that is over leaves a mark until
    `keep` later, so that what it still says doesn't start it anew."""

    def __init__(self, limit: int, keep: int) -> None:
        self.limit, self.keep = limit, keep

    def init(self, handle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "started long, ended long, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, ended, over = self.run.get() if self.run.exists() else (-1, -1, False)
        frame = _millis(rows)
        first = int(frame["at"].min())
        if not over and (started < 0 or first < started):
            self.handle.registerTimer(first + self.limit)
            started = first
        ends = frame.loc[frame["ended"].astype(bool), "at"]
        if len(ends):
            ended = int(ends.min()) if ended < 0 else min(ended, int(ends.min()))
        self.run.update((started, ended, over))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        started, ended, over = self.run.get()
        if over:
            self.run.clear()
            return
        if expiredTimerInfo.getExpiryTimeInMs() != started + self.limit:
            return  # an earlier start came to be known
        self.run.update((started, ended, True))
        self.handle.registerTimer(started + self.limit + self.keep)
        if not 0 <= ended <= started + self.limit:
            yield pd.DataFrame({"run_id": [key[0]], "status": ["failed"], "error": ["WORKER_TIMEOUT"]})

    def close(self) -> None:
        pass


def stream_stale_runs(events: DataFrame, minutes: int = 15, late: str = "0 seconds", keep_days: int = 7) -> DataFrame:
    """run_id, status, error of runs that have not ended so many minutes after their start, however much they say meanwhile.

    events: run_id, started_at (the event's time; a run starts with its first), ended. A timer set at the start fires when the watermark passes
    it; an end after the deadline comes too late. Needs the RocksDB state store.
    """
    rows = events.withWatermark("started_at", late).select("run_id", "started_at", F.coalesce("ended", F.lit(False)).alias("ended"), F.unix_millis("started_at").alias("at"))
    return _by(rows, "run_id").transformWithStateInPandas(statefulProcessor=_Run(minutes * 60_000, keep_days * DAY), outputStructType="run_id string, status string, error string", outputMode="Append", timeMode="EventTime")
