"""Streams of observations, holds and webhooks: deduplicated, merged and watched for changes."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from marram.functions.constants import DELIST_GRACE_DAYS, HOLD_MINUTES
from marram.operators.graph import checkpointed
from marram.operators.history import KEY, listing_history
from marram.operators.upserts import merge
from marram.package import ship
from marram.streaming.tables import BucketTable

DAY_MS = 86_400_000

CHANGES = "source string, source_listing_id string, observed_on date, change string, previous long, current long"


def dedupe_observations(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first observation of each listing and day that arrives, with state kept until the watermark has passed. For the last
    one of a day use stream_upsert. stream: observed_at (timestamp), source, source_listing_id and facts."""
    days = stream.withColumn("observed_on", F.to_date("observed_at"))
    return days.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["source", "source_listing_id", "observed_on"])


def late_observations(stream: DataFrame, history_end: str) -> DataFrame:
    """Observations from before a day that has been closed: for the batch rebuild, which sorts by day."""
    return stream.where(F.to_date("observed_at") <= F.lit(history_end).cast("date"))


def _ready(spark: SparkSession) -> None:
    """State by name with timers needs this provider, whose state may outgrow memory; its Python runs in the executors."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups that the keys of a stream's state are dealt to by hash.
STATE_BUCKETS = 256


def _bucket(*keys: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


class _Bucket(StatefulProcessor):
    """State of a bucket of keys: `open`, its rows, and `due`, the time of the one timer that counts, when the next of them is to be judged.

    A call for each key and a message for each row of its state cost more than the work. Rows are appended as they come; when the bucket is due its
    rows are read once, judge() gives what comes out and what stays open, and that is written once. A batch costs the open rows of the buckets that are due."""

    #: The columns of a row of state, and those that come out.
    kept: str = ""
    out: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.kept)
        self.due = handle.getValueState("due", "due long")

    def taken(self, frame: pd.DataFrame) -> tuple[list[tuple], int]:
        """A frame's rows as rows of state, and when the first of them is due."""
        raise NotImplementedError

    def judge(self, rows: Iterator[tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
        """What comes out by `now`, what stays, and when the first of that is due."""
        raise NotImplementedError

    def _wait_for(self, due: int) -> None:
        self.due.update((due,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                new, due = self.taken(frame)
                self.open.appendList(new)
                first = due if first is None else min(first, due)
        if first is not None and not (self.due.exists() and self.due.get()[0] <= first):
            self._wait_for(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists() or self.due.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier row came after this timer was set
        out, left, due = self.judge(self.open.get(), timerValues.getCurrentWatermarkInMs())
        self.open.clear()
        self.due.clear()
        if left:
            self.open.put(left)
        if due is not None:
            self._wait_for(due)
        if out:
            names = [c.split() for c in self.out.split(", ")]
            columns = zip(names, zip(*out))
            yield pd.DataFrame({n: pd.array(list(v), dtype="Int64") if kind == "long" else pd.to_datetime(list(v), unit="ms") if kind == "timestamp" else list(v) for (n, kind), v in columns})


class _Changes(_Bucket):
    """Rows of state: observations of days that the watermark hasn't passed, and of each listing the last day that was closed (`seq` null)
    with whether it was told as delisted.

    Due are the end of an open day, and the end of the grace."""

    kept = "source string, id string, day long, seq long, price long, gone boolean"
    out = CHANGES

    def __init__(self, grace_days: int) -> None:
        self.grace = grace_days

    def taken(self, frame):
        newest = frame.sort_values("seq", kind="stable").drop_duplicates(["source", "source_listing_id", "day"], keep="last")
        prices = [None if pd.isna(p) else int(p) for p in newest["price"].tolist()]
        days = newest["day"].tolist()
        return list(zip(newest["source"].tolist(), newest["source_listing_id"].tolist(), days, newest["seq"].tolist(), prices, [False] * len(days))), (min(days) + 1) * DAY_MS

    def judge(self, rows, now):
        ends: dict[tuple, tuple] = {}
        days: dict[tuple, dict[int, tuple]] = {}
        for source, id_, day, seq, price, gone in rows:
            if seq is None:
                ends[source, id_] = (day, price, gone)
            else:
                own = days.setdefault((source, id_), {})
                if day not in own or own[day][0] < seq:
                    own[day] = (seq, price)
        out, left, due = [], [], []
        for key in {**ends, **days}:
            last, own = ends.get(key), days.get(key, {})
            silent_until = lambda day: last is not None and not last[2] and day > last[0] + self.grace + 1  # noqa: B023, E731
            gone = lambda: (*key, as_day(last[0]), "delisted", None, last[1])  # noqa: B023, E731
            for day in sorted(own):
                seq, price = own[day]
                if (day + 1) * DAY_MS > now:
                    left.append((*key, day, seq, price, False))
                    due.append((day + 1) * DAY_MS)
                    continue
                if silent_until(day):
                    out.append(gone())
                moved = last is not None and last[1] is not None and price is not None and last[1] != price
                change = "new_listing" if last is None else "price_change" if moved else "unchanged"
                out.append((*key, as_day(day), change, last[1] if moved else None, price))
                last = (day, price, False)
            if silent_until(now // DAY_MS):
                out.append(gone())
                last = (last[0], last[1], True)
            if last is not None:
                left.append((*key, last[0], None, last[1], last[2]))
                if not last[2]:
                    due.append((last[0] + self.grace + 2) * DAY_MS)
        return out, left, min(due, default=None)


def as_day(day: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(day)


def detect_changes_stream(stream: DataFrame, grace_days: int = DELIST_GRACE_DAYS, delay: str = "0 seconds", buckets: int = STATE_BUCKETS) -> DataFrame:
    """The observation of each listing and day as new_listing, price_change or unchanged, and delisted after grace_days and
    a day without one. stream: observed_at (timestamp), source, source_listing_id, advertised_price, and seq, which decides between several of
    a day (without it the later time does).

    A day is judged when the watermark, `delay` behind the newest time, has passed its end, so rows may come in any order
    within the delay and the result is the batch history's. What comes later than that is dropped here without a trace; see
    stream_history, which writes it aside and mends the histories that it touches. A feed without any newer event, of
    whichever listing, closes no day. A delisted listing that is seen again goes on with its last price. Listings' state is kept in
    so many buckets, each of which a task holds while it is judged; a checkpoint goes with its number of them."""
    _ready(stream.sparkSession)
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))) if "seq" in stream.columns else F.unix_micros("observed_at")  # a state row without one is a closed day
    rows = stream.select(_bucket("source", "source_listing_id", buckets=buckets), "source", "source_listing_id", F.unix_date(F.to_date("observed_at")).cast("long").alias("day"), seq.alias("seq"), F.col("advertised_price").cast("double").alias("price"), "observed_at").withWatermark("observed_at", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(_Changes(grace_days), CHANGES, "Append", "EventTime")


def stream_upsert(stream: DataFrame, state_path: str, keys: list[str], checkpoint: str, coalesced: list[str] | None = None, buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Merges each micro-batch into a BucketTable at state_path: only the buckets that a batch's keys lie in are read and rewritten, and a batch
    that runs again changes nothing."""
    table = BucketTable(stream.sparkSession, state_path, keys, buckets, keep)

    def change(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return merge(batch.limit(0).drop("seq") if before is None else before, batch, keys, coalesced=coalesced or [])

    return stream.writeStream.foreachBatch(lambda batch, n: table.update(n, batch, change) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_path: str, below: int | None = None) -> DataFrame | None:
    """The table that stream_upsert keeps, or as it was before a batch; None before the first."""
    return BucketTable(spark, state_path, []).read(below)


def history_changes(history: DataFrame) -> DataFrame:
    """Every observation of a history as new_listing, price_change or unchanged, as CHANGES."""
    order = Window.partitionBy(*KEY).orderBy("observed_on")
    seen = history.select(*KEY, "observed_on", F.col("advertised_price").alias("current"), F.lag("advertised_price").over(order).alias("before"), F.row_number().over(order).alias("nth"))
    moved = F.coalesce(F.col("before") != F.col("current"), F.lit(False))
    change = F.when(F.col("nth") == 1, "new_listing").when(moved, "price_change").otherwise("unchanged")
    return seen.select(*KEY, "observed_on", change.alias("change"), F.when(moved, F.col("before")).alias("previous"), "current")


def stream_history(stream: DataFrame, base: str, checkpoint: str, delay_days: int = 2, buckets: int = 64) -> StreamingQuery:
    """Keeps histories and changes right for any arrival order. stream: source, source_listing_id, observed_on, advertised_price, seq.

    Each batch is merged into the histories (base/observations), and the changes of just the listings that it touches are made anew from them
    (base/changes). Rows of a day more than delay_days before the newest day of earlier batches are also written to base/late. Rows
    without a day are left out. Both tables are BucketTables, so a batch costs the buckets that it touches, and a batch that runs again, after a crash
    between the tables too, gives the same state."""
    spark = stream.sparkSession
    seen = BucketTable(spark, f"{base}/observations", KEY, buckets)
    found = BucketTable(spark, f"{base}/changes", KEY, buckets)

    def history(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        return listing_history(rows if before is None else before.unionByName(rows))

    def write(batch: DataFrame, n: int) -> None:
        if found.done(n):
            return
        rows = checkpointed(batch.select(*KEY, "observed_on", "advertised_price", F.col("seq").cast("long").alias("seq")).where("observed_on is not null"))
        last = found.snapshot(below=n)
        newest = last.facts["newest"] if last else None
        if newest is not None:
            rows.where(F.col("observed_on") < F.date_sub(F.lit(newest).cast("date"), delay_days)).write.mode("overwrite").parquet(f"{base}/late/batch={n}")
        seen.update(n, rows, history)
        keys = rows.select(*KEY).distinct()
        touched = found.touched(rows)
        before = found.read(below=n, only=touched)
        anew = history_changes(seen.read(below=n + 1, only=touched).join(keys, KEY, "left_semi"))
        if before is not None:
            anew = before.join(keys, KEY, "left_anti").unionByName(anew)
        high = rows.agg(F.max("observed_on").cast("string")).first()[0]
        found.commit(n, anew, touched, {"newest": max(filter(None, [newest, high]), default=None)})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, base: str) -> DataFrame | None:
    """The changes that stream_history keeps; None before its first batch."""
    return BucketTable(spark, f"{base}/changes", KEY).read()


def read_late(spark: SparkSession, base: str) -> DataFrame:
    """(source, source_listing_id, observed_on, advertised_price, seq, batch): the rows that came behind the watermark."""
    schema = "source string, source_listing_id string, observed_on date, advertised_price long, seq long, batch int"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/late")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/late")


HOLDS = "hold_id string, status string, at timestamp"


class _Holds(_Bucket):
    """Rows of state: what the watermark hasn't passed, and when the hold that was last opened runs out (`status` null). Due are these times."""

    kept = "hold_id string, at long, status string"
    out = HOLDS

    def __init__(self, minutes: int) -> None:
        self.lasts = minutes * 60_000

    def taken(self, frame):
        times = frame["ms"].tolist()
        return list(zip(frame["hold_id"].tolist(), times, frame["status"].tolist())), min(times)

    def judge(self, rows, now):
        ends: dict[str, int] = {}
        come: dict[str, list[tuple]] = {}
        left, due, out = [], [], []
        for hold, ms, status in rows:
            if status is None:
                ends[hold] = ms
            elif ms <= now:
                come.setdefault(hold, []).append((ms, status))
            else:
                left.append((hold, ms, status))
                due.append(ms)
        for hold in {**ends, **come}:
            end = ends.get(hold)
            for ms, status in sorted(come.get(hold, ())):
                if end is not None and ms >= end:  # what comes now is too late
                    out.append((hold, "EXPIRED", end))
                out.append((hold, status, ms))
                end = ms + self.lasts if status == "ACTIVE" else None
            if end is not None and end <= now:
                out.append((hold, "EXPIRED", end))
            elif end is not None:
                left.append((hold, end, None))
                due.append(end)
        return out, left, min(due, default=None)


def expire_holds(stream: DataFrame, minutes: int = HOLD_MINUTES, delay: str = "0 seconds", buckets: int = STATE_BUCKETS) -> DataFrame:
    """Holds and their releases in time order, (hold_id, status, at): a hold that nothing converts or releases within `minutes`
    of event time comes out EXPIRED, also before a later row of it. stream: hold_id, status (ACTIVE, CONVERTED, RELEASED), at (timestamp).

    A row is judged when the watermark, `delay` behind the newest time, has reached it, so rows may come in any order within the
    delay; at one time a hold is opened before it ends. Later rows are dropped without a trace. Times are in milliseconds. buckets: as in detect_changes_stream."""
    _ready(stream.sparkSession)
    rows = stream.select(_bucket("hold_id", buckets=buckets), "hold_id", "status", F.unix_millis("at").alias("ms"), "at").where("status is not null").withWatermark("at", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(_Holds(minutes), HOLDS, "Append", "EventTime")


class _Once(StatefulProcessor):
    """The first row of a key; that it was seen is forgotten after a time by the clock."""

    def __init__(self, days: int, columns: list[str]) -> None:
        self.lasts, self.columns = days * DAY_MS, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.lasts)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = next((f for f in rows if len(f)), None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first[self.columns].head(1)


def dedupe_webhooks_by_clock(stream: DataFrame, days: int = 7) -> DataFrame:
    """One event of each processor and signature where events bear no time of their own: state has a time to live of so many days by
    the clock of the stream. Columns of stream pass through. A stream with such state always has a next batch, so run it by time or once: with
    availableNow it doesn't end."""
    _ready(stream.sparkSession)
    return stream.groupBy("processor", "signature").transformWithStateInPandas(_Once(days, stream.columns), stream.schema, "Append", "ProcessingTime")


def dedupe_webhooks(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first event of each processor and signature; replays within the delay are dropped. stream: processor, signature, received_at."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["processor", "signature"])


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns its rows, for tests and backfills that fit a memory table."""
    name = f"t_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
