"""Queue, retries and cache over several micro-batches, restarts, and odd rows, against plain folds."""

from __future__ import annotations

import pytest
from oracle import as_rows, sql_rows
from pyspark.sql import functions as F

from quillspark.streaming import keyed

SMALL = "/root/testdata/sf0.001"


def _queue_plainly(rows):
    busy, out = {}, []
    for key, t, event, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "start":
            out.append((key, event, "refused" if key in busy else "accepted"))
            busy.setdefault(key, event)
        else:
            out.append((key, event, "released" if busy.pop(key, None) is not None else "idle"))
    return sorted(out)


def _write(spark, rows, folder):
    spark.createDataFrame(rows, "key long, t long, event_id long, kind string").coalesce(1).write.mode("append").parquet(folder)


def test_a_book_in_flight_is_refused_until_it_is_done(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/q"
    first = [(1, 1, 1, "start"), (1, 2, 2, "start"), (2, 2, 3, "done"), (1, 3, 4, "done"), (1, 4, 5, "start"), (3, 4, 6, "start"), (1, 4, 5, "start")]
    later = [[(1, 5, 7, "start"), (1, 6, 8, "done"), (3, 6, 9, "start")], [(3, 7, 10, "done"), (3, 8, 11, "start"), (1, 9, 12, "done"), (1, 10, 13, "start")], [(4, 11, 14, "start")]]
    sent = list(first)
    _write(spark, first, source)

    def run():
        stream = keyed._source(spark, source, "key long, t long, event_id long, kind string", 1)
        return keyed.drained(keyed.folded(stream, keyed.InFlight(), keyed.IN_FLIGHT), place)

    assert sorted(map(tuple, run().collect())) == _queue_plainly(sent)
    for rows in later:  # each run is a restart from the checkpoint; what was answered before is not answered again
        _write(spark, rows, source)
        sent += rows
        assert sorted(map(tuple, run().collect())) == _queue_plainly(sent)
    assert sorted(map(tuple, run().collect())) == _queue_plainly(sent)


@pytest.mark.parametrize("files", [1, 100])
def test_batches_of_any_size_give_the_same(spark, files):
    assert as_rows(keyed.ingestion_queue(spark, SMALL, files).toPandas()) == as_rows(sql_rows(keyed.INGESTION_SQL, SMALL))


def test_retries_wait_for_their_timers_over_restarts(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/q"
    schema = "key long, ts timestamp, t long, event_id long, failing int"

    def send(rows):
        frame = spark.createDataFrame([(k, t, e, f) for k, t, e, f in rows], "key long, t long, event_id long, failing int")
        frame.select("key", F.timestamp_millis("t").alias("ts"), "t", "event_id", "failing").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = keyed._source(spark, source, schema, 1).withWatermark("ts", "0 seconds")
        out = keyed.drained(keyed.folded(stream, keyed.Retries(lambda n, failing: n > failing), keyed.RETRIES, time="EventTime"), place)
        return sorted((r["event_id"], r["attempt"], r["made_at"], r["ok"]) for r in out.where("key < 9").collect())

    send([(1, 1000, 1, 0), (1, 1000, 2, 1), (2, 1500, 3, 9)])
    assert run() == [(1, 1, 1000, True), (2, 1, 1000, False), (3, 1, 1500, False)]
    send([(9, 3200, 90, 0)])  # the clock passes 3000: the first retry is made, that of 3500 is not
    assert run() == [(1, 1, 1000, True), (2, 1, 1000, False), (2, 2, 3000, True), (3, 1, 1500, False)]
    send([(9, 90_000, 91, 0)])
    assert run() == [(1, 1, 1000, True), (2, 1, 1000, False), (2, 2, 3000, True), (3, 1, 1500, False), (3, 2, 3500, False), (3, 3, 7500, False)]


def test_cool_down_ends_and_success_stays(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [(1, 0.0, 1, False), (1, 29.9, 2, True), (1, 30.0, 3, False), (1, 59.0, 4, True), (1, 60.0, 5, True), (1, 61.0, 6, False), (2, 5.0, 7, True)]
    spark.createDataFrame(rows, "key long, t double, event_id long, ok boolean").coalesce(1).write.parquet(source)
    stream = keyed._source(spark, source, "key long, t double, event_id long, ok boolean", 1)
    out = keyed.drained(keyed.folded(stream.where("key > 0"), keyed.Cached(), keyed.CACHED), f"{tmp_path}/q").orderBy("event_id").collect()
    assert [r["outcome"] for r in out] == ["failed", "cooling", "failed", "cooling", "connected", "cached", "connected"]


def test_no_events(spark, tmp_path):
    empty = spark.read.parquet(f"{SMALL}/events.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/events.parquet")
    assert keyed.capture(empty.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")), f"{tmp_path}/s") == 0.0


def test_windows_begin_with_a_hit_and_idle_callers_are_forgotten(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/q"
    schema = "key long, ts timestamp, t double, event_id long"

    def send(rows):
        frame = spark.createDataFrame(rows, "key long, t double, event_id long")
        frame.select("key", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"), "t", "event_id").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = keyed._source(spark, source, schema, 1).withWatermark("ts", "0 seconds")
        out = keyed.drained(keyed.folded(stream, keyed.WindowLimit(2, 60, 120), keyed.WINDOW_LIMIT, time="EventTime"), place)
        return {r["event_id"]: r["allowed"] for r in out.collect()}

    send([(1, 10.0, 1), (1, 20.0, 2), (1, 69.9, 3), (1, 70.0, 4), (2, 30.0, 5)])
    assert run() == {1: True, 2: True, 3: False, 4: True, 5: True}
    send([(1, 75.0, 6), (1, 76.0, 7)])
    assert run() == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}
    send([(9, 1000.0, 8)])
    send([(1, 2000.0, 9), (1, 2001.0, 10), (1, 2002.0, 11)])
    out = run()
    assert (out[9], out[10], out[11]) == (True, True, False)


class _Counting:
    """A handle with one list of state, which counts calls to the store."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, set()

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


@pytest.mark.parametrize("events", [3, 300])
def test_calls_to_the_store_do_not_grow_with_what_waits(events):
    store, retries = _Counting(), keyed.Retries(lambda attempt, failing: attempt > failing)
    retries.init(store)
    rows = [{"key": i % 7, "t": 1000 + i, "event_id": i, "failing": i % 4} for i in range(events)]
    made = list(retries.handleInputRows((0,), iter(rows), _Clock(0)))
    while store.timers:
        at = min(store.timers)
        store.timers.remove(at)
        made += retries.handleExpiredTimer((0,), _Clock(at + 400), None)
    assert store.calls <= 16 and store.rows == []
    tried = [(i, n) for i in range(events) for n in range(1, min(i % 4 + 1, 3) + 1)]
    assert sorted((r["event_id"], r["attempt"]) for r in made) == tried
    assert all(r["key"] == r["event_id"] % 7 and r["made_at"] == 1000 + r["event_id"] + (0, 2000, 6000)[r["attempt"] - 1] and r["ok"] == (r["attempt"] > r["event_id"] % 4) for r in made)


@pytest.mark.parametrize("name", ["ingestion_queue", "tool_cache"])
def test_micro_batches_do_not_grow_with_the_partitions_of_a_shuffle(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(keyed, "_place", lambda _: f"{tmp_path}/{name}")
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = getattr(keyed, name)(spark, SMALL).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert as_rows(rows) == as_rows(sql_rows({"ingestion_queue": keyed.INGESTION_SQL, "tool_cache": keyed.CACHE_SQL}[name], SMALL))
    assert len(list((tmp_path / name / "state" / "offsets").glob("[0-9]*"))) <= 5
