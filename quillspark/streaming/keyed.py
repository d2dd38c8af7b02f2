"""Keyed state over micro-batches: a work queue with release, retries on timers, a cache that cools down after failures.

Each operator is a stateful processor over a stream's groups; state lives in RocksDB under the query's checkpoint, so a
query that stops goes on where it was.  Within a micro-batch a key's rows are taken in order of time and id.

A call from Python to the store costs as much as many rows, so the groups are buckets of keys: a bucket's state is read
once and written once in a micro-batch, if it changed.  A bucket's rows of one micro-batch are held at a time.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.index import shared_root
from ..sources.tables import table

#: Seconds before the second attempt, attempts in all, and seconds without attempts after a failed connection.
BASE_DELAY, ATTEMPTS, COOL_DOWN = 2, 3, 30

#: Groups of keys; fixed, as a checkpoint's state stands under them.
BUCKETS = 2048

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A micro-batch writes what it changed; whole copies of the state are made beside it.
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["t"], r["event_id"]))


def _put(state, before: dict, after: dict) -> None:
    """Writes a bucket's rows (key, ...), if they changed."""
    if after and after != before:
        state.put([(key, *values) for key, values in after.items()])
    elif before and not after:
        state.clear()


_OUTCOME = Row("key", "event_id", "outcome")


class InFlight(StatefulProcessor):
    """Rows (key, t, event_id, kind): a ``start`` is accepted unless its key is in flight; ``done`` releases the key, however the work ended."""

    def init(self, handle) -> None:
        self.busy = handle.getListState("busy", "key long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {key: (event,) for key, event in self.busy.get()}
        busy = dict(before)
        for row in _in_order(rows):
            key, event = row["key"], row["event_id"]
            if row["kind"] == "start":
                outcome = "refused" if key in busy else "accepted"
                busy.setdefault(key, (event,))
            else:
                outcome = "idle" if busy.pop(key, None) is None else "released"
            yield _OUTCOME(key, event, outcome)
        _put(self.busy, before, busy)

    def close(self) -> None:
        pass


IN_FLIGHT = "key long, event_id long, outcome string"

_ATTEMPT = Row("key", "event_id", "attempt", "made_at", "ok")


class Retries(StatefulProcessor):
    """Rows (key, ts, event_id, t in ms, failing): each event is tried up to ``attempts`` times, ``base * 2**(n-1)`` after the n-th failure.

    Attempts that are not due yet wait as the columns of a list's element, one for each micro-batch that adds some, with
    a timer for the first of them, which the watermark sets off; it makes all that are due and leaves one element.
    ``succeeds`` is asked with the number of the attempt and the row's ``failing``.
    """

    def __init__(self, succeeds: Callable[[int, int], bool], base: float = BASE_DELAY, attempts: int = ATTEMPTS):
        self.succeeds, self.base, self.attempts = succeeds, int(1000 * base), attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due array<long>, event_id array<long>, attempt array<int>, failing array<int>, key array<long>")

    def _tried(self, key: int, event: int, attempt: int, due: int, failing: int, now: int, waits: list) -> Iterator[Row]:
        while True:
            ok = self.succeeds(attempt, failing)
            yield _ATTEMPT(key, event, attempt, due, ok)
            if ok or attempt == self.attempts:
                return
            due, attempt = due + self.base * 2 ** (attempt - 1), attempt + 1
            if due > now:
                waits.append((due, event, attempt, failing, key))
                return

    def _wait(self, waits: list, write: Callable[[list], None]) -> None:
        columns = tuple(map(list, zip(*waits, strict=True)))
        write([columns])
        self.handle.registerTimer(min(columns[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, waits = timerValues.getCurrentWatermarkInMs(), []
        for row in _in_order(rows):
            yield from self._tried(row["key"], row["event_id"], 1, row["t"], row["failing"], now, waits)
        if waits:
            self._wait(waits, self.waiting.appendList)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [wait for columns in self.waiting.get() for wait in zip(*columns, strict=True)]
        waits = [wait for wait in held if wait[0] > now]
        if len(waits) == len(held):  # another timer of this micro-batch was first
            return
        for due, event, attempt, failing, key in held:
            if due <= now:
                yield from self._tried(key, event, attempt, due, failing, now, waits)
        if waits:
            self._wait(waits, self.waiting.put)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


RETRIES = "key long, event_id long, attempt int, made_at long, ok boolean"


class Cached(StatefulProcessor):
    """Rows (key, t, event_id, ok): the first request connects; success is kept for good, failure keeps requests away for ``cool_down`` seconds."""

    def __init__(self, cool_down: float = COOL_DOWN):
        self.cool_down = cool_down

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", "key long, known boolean, failed_at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {key: (known, failed) for key, known, failed in self.kept.get()}
        kept = dict(before)
        for row in _in_order(rows):
            key, t = row["key"], row["t"]
            known, failed = kept.get(key, (False, None))
            if known:
                outcome = "cached"
            elif failed is not None and t - failed < self.cool_down:
                outcome = "cooling"
            elif row["ok"]:
                kept[key], outcome = (True, None), "connected"
            else:
                kept[key], outcome = (False, t), "failed"
            yield _OUTCOME(key, row["event_id"], outcome)
        _put(self.kept, before, kept)

    def close(self) -> None:
        pass


CACHED = IN_FLIGHT

_ALLOWED = Row("key", "event_id", "allowed")


class WindowLimit(StatefulProcessor):
    """Rows (key, ts, t in s, event_id): ``most`` hits in windows of ``seconds`` that begin with a key's first hit after the last one.

    A key that is idle for ``idle`` seconds is forgotten, by a timer of the watermark, so that state follows the callers of late.
    """

    def __init__(self, most: int, seconds: float, idle: float):
        self.most, self.seconds, self.idle = most, seconds, max(idle, seconds)

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", "key long, start double, used long, last double")

    def _held(self) -> dict:
        return {key: (start, used, last) for key, start, used, last in self.windows.get()}

    def _until(self, windows: dict) -> None:
        self.handle.registerTimer(int((min(last for _, _, last in windows.values()) + self.idle) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._held()
        windows = dict(before)
        for row in _in_order(rows):
            key, t = row["key"], row["t"]
            start, used, _ = windows.get(key, (None, 0, None))
            if start is None or t - start >= self.seconds:
                start, used = t, 0
            windows[key] = (start, used + 1, t)
            yield _ALLOWED(key, row["event_id"], used < self.most)
        _put(self.windows, before, windows)
        self._until(windows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, before = timerValues.getCurrentWatermarkInMs() / 1000, self._held()
        windows = {key: window for key, window in before.items() if window[2] + self.idle > now}
        _put(self.windows, before, windows)
        if windows:
            self._until(windows)
        return iter(())

    def close(self) -> None:
        pass


WINDOW_LIMIT = "key long, event_id long, allowed boolean"


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in (_PROVIDER, _CHANGES)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_CHANGES, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def folded(stream: DataFrame, processor: StatefulProcessor, schema: str, key: str = "key", time: str = "None") -> DataFrame:
    """The processor over the stream's buckets of keys. ``time`` is "EventTime" for one with timers."""
    return stream.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("bucket").transformWithState(processor, schema, "Append", time)


def drained(out: DataFrame, place: str) -> DataFrame:
    """Runs a stream, in as many micro-batches as its source makes, until the source has no more; its rows so far.

    What is written and the state are under ``place``: called again with the same place it goes on from there.
    """
    spark = out.sparkSession
    with _rocks(spark):
        running = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def capture(rows: DataFrame, folder: str, slices: int = 4, key: str = "key", time: str = "ts") -> float:
    """Writes rows as a source of files that come in order of time, a slice after the other; returns the longest slice's seconds.

    A key's rows of a slice are in one file, so that however files fall into micro-batches each key's rows come in order.
    A slice has a file for each core at most, however large it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    edges = [float(x) for x in rows.agg(F.percentile_approx(F.unix_micros(time).cast("double"), [i / slices for i in range(slices + 1)], 10_000)).first()[0] or []]
    at = F.unix_micros(time).cast("double")
    span = 0.0
    for i in range(len(edges) - 1):
        inside = (at >= edges[i] if i else F.lit(True)) & (at < edges[i + 1] if i < slices - 1 else F.lit(True))
        rows.where(inside).repartition(cores, key).write.mode("append").parquet(folder)
        span = max(span, (edges[i + 1] - edges[i]) / 1e6)
    return span


def _place(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/keyed-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(F.col("user_id").alias("key"), "ts", "event_id", "event_type", "value")


def _source(spark: SparkSession, folder: str, schema, files: int | None) -> DataFrame:
    """The files as they come, ``files`` in a micro-batch; without that a slice of ``capture``, so that there are as many micro-batches for any size of slices."""
    files = files or spark.sparkContext.defaultParallelism
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingestion_queue(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Events as a queue's: views, clicks and signups ask for work on a user's book, purchases and errors end it."""
    rows = _events(spark, sf_dir).select("key", "ts", F.unix_micros("ts").alias("t"), "event_id", F.when(F.col("event_type").isin("purchase", "error"), "done").otherwise("start").alias("kind"))
    place = _place(spark)
    capture(rows, f"{place}/source")
    stream = _source(spark, f"{place}/source", rows.schema, files).select("key", "t", "event_id", "kind")
    return drained(folded(stream, InFlight(), IN_FLIGHT), place).select(F.col("key").alias("user_id"), "event_id", "outcome")


#: What counts between two releases is the first start; a release counts if a start stands since the one before.
INGESTION_SQL = """with k as (select user_id, event_id, ts, event_type in ('purchase', 'error') as done from events),
  p as (select *, coalesce(sum(done::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as run from k),
  q as (select *, row_number() over (partition by user_id, run, done order by ts, event_id) as nth, count(*) filter (where not done) over (partition by user_id, run) as starts from p)
  select user_id, event_id, case when not done and nth = 1 then 'accepted' when not done then 'refused' when starts > 0 then 'released' else 'idle' end as outcome from q"""


def extraction_retries(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Each event as an extraction that fails as often as its value says: attempts and when they were made, in ms."""
    failing = (F.floor("value") % 5).cast("int")
    rows = _events(spark, sf_dir).select("key", "ts", F.unix_millis("ts").alias("t"), "event_id", failing.alias("failing"))
    place = _place(spark)
    late = int(capture(rows, f"{place}/source")) + 1
    # the clock goes on after the last event, or what still waits would wait for ever
    end = rows.agg((F.max("ts") + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(late * 2))).alias("ts"))
    end.where("ts is not null").select(F.lit(-1).cast("long").alias("key"), "ts", F.unix_millis("ts").alias("t"), F.lit(-1).cast("long").alias("event_id"), F.lit(0).alias("failing")).write.mode("append").parquet(f"{place}/source")
    stream = _source(spark, f"{place}/source", rows.schema, files).withWatermark("ts", f"{late} seconds")
    out = folded(stream, Retries(lambda attempt, failing: attempt > failing), RETRIES, time="EventTime")
    return drained(out, place).where("event_id >= 0").select("event_id", "attempt", "made_at", "ok")


RETRIES_SQL = f"""with recursive a as (
    select event_id, 1 as attempt, epoch_us(ts) // 1000 as made, floor(value)::int % 5 as failing from events
    union all select event_id, attempt + 1, made + {1000 * BASE_DELAY} * (1 << (attempt - 1)), failing from a where attempt <= failing and attempt < {ATTEMPTS})
  select event_id, attempt::int as attempt, made::bigint as made_at, attempt > failing as ok from a"""


def tool_cache(spark: SparkSession, sf_dir: str, files: int | None = None, cool_down: float = 86_400.0) -> DataFrame:
    """Events as requests for a user's tools, which a tenth of connections bring: outcome of each. Events come by the hour, so a failure cools for a day."""
    rows = _events(spark, sf_dir).select("key", "ts", (F.unix_micros("ts") / 1e6).alias("t"), "event_id", (F.floor(F.col("value") * 100) % 10 == 0).alias("ok"))
    place = _place(spark)
    capture(rows, f"{place}/source")
    stream = _source(spark, f"{place}/source", rows.schema, files).select("key", "t", "event_id", "ok")
    return drained(folded(stream, Cached(cool_down), CACHED), place).select(F.col("key").alias("user_id"), "event_id", "outcome")


CACHE_SQL = """with recursive h as (select user_id, event_id, epoch(ts) as t, floor(value * 100)::bigint % 10 = 0 as ok, row_number() over (partition by user_id order by ts, event_id) as k from events), r as (
    select user_id, k, event_id, case when ok then 'connected' else 'failed' end as outcome, ok as known, case when not ok then t end as failed from h where k = 1
    union all select h.user_id, h.k, h.event_id,
      case when r.known then 'cached' when h.t - r.failed < 86400 then 'cooling' when h.ok then 'connected' else 'failed' end,
      r.known or (coalesce(h.t - r.failed >= 86400, true) and h.ok),
      case when r.known or h.t - r.failed < 86400 then r.failed when not h.ok then h.t end
    from r join h on h.user_id = r.user_id and h.k = r.k + 1)
  select user_id, event_id, outcome from r"""


def limiter_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """event_id, allowed by the chat's limit, as a stream: three an hour from a caller's first hit; callers idle for two hours are forgotten."""
    rows = _events(spark, sf_dir).select("key", "ts", (F.unix_micros("ts").cast("double") / 1e6).alias("t"), "event_id")
    place = _place(spark)
    late = int(capture(rows, f"{place}/source")) + 1
    stream = _source(spark, f"{place}/source", rows.schema, files).withWatermark("ts", f"{late} seconds")
    return drained(folded(stream, WindowLimit(3, 3600, 7200), WINDOW_LIMIT, time="EventTime"), place).select("event_id", "allowed")
