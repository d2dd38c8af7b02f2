"""Stateful operators: rate limits, turns and rounds, and a queue read as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import shared_root
from ..sources.tables import table

#: Hits, seconds and segments of the sliding limits of a service: one for all callers, one for searches.
SLIDING, SLIDING_SEARCH = (60, 60, 6), (30, 60, 6)
#: Hits and seconds of fixed windows: administration's, and a chat's, which begins at a caller's first hit.
FIXED_ADMIN, FIXED_CHAT = (120, 60), (3, 3600)


class FixedWindow:
    """Windows that begin with the first hit after the last window's end; what a window does not admit does not count against another."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.start, self.used = limit, seconds, None, 0

    def admits(self, t: float) -> bool:
        if self.start is None or t - self.start >= self.seconds:
            self.start, self.used = t, 0
        self.used += 1
        return self.used <= self.limit


class SlidingWindow:
    """A window of equal segments of the clock; a hit is admitted if fewer than the limit were in it and the segments before."""

    def __init__(self, limit: int, seconds: float, segments: int):
        self.limit, self.width, self.segments, self.held = limit, seconds / segments, segments, {}

    def admits(self, t: float) -> bool:
        now = int(t // self.width)
        self.held = {k: n for k, n in self.held.items() if k > now - self.segments}
        if sum(self.held.values()) >= self.limit:
            return False
        self.held[now] = self.held.get(now, 0) + 1
        return True


def limited(hits: DataFrame, limiter: Callable[[], FixedWindow | SlidingWindow]) -> DataFrame:
    """event_id, allowed of hits (user_id, t, event_id).

    A window depends on the one before, so a caller's hits are folded in order of time: one caller is one task, which
    holds a few numbers of it at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, now = None, limiter()
        for batch in batches:
            allowed = []
            for who, t in zip(batch.user_id, batch.t, strict=True):
                if who != user:
                    user, now = who, limiter()
                allowed.append(now.admits(t))
            yield pd.DataFrame({"event_id": batch.event_id, "allowed": allowed})

    return hits.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(fold, "event_id long, allowed boolean")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"))


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, allowed by the chat's limit: three an hour from a caller's first hit."""
    return limited(_hits(spark, sf_dir), lambda: FixedWindow(*FIXED_CHAT))


_NUMBERED = "h as (select event_id, user_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events)"
FIXED_SQL = f"""with recursive {_NUMBERED}, r as (
    select user_id, k, event_id, t as start, 1 as used from h where k = 1
    union all select h.user_id, h.k, h.event_id, case when h.t - r.start >= 3600 then h.t else r.start end, case when h.t - r.start >= 3600 then 1 else r.used + 1 end from r join h on h.user_id = r.user_id and h.k = r.k + 1)
  select event_id, used <= 3 as allowed from r"""


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, allowed by a sliding limit of eight in six days of six segments: the service's limit of sixty in a minute of six segments, on events that come by the day."""
    return limited(_hits(spark, sf_dir), lambda: SlidingWindow(8, 6 * 86400, 6))


SLIDING_SQL = f"""with recursive {_NUMBERED}, s as (select *, floor(t / 86400)::bigint as seg from h), r as (
    select user_id, k, event_id, [seg] as held, true as allowed from s where k = 1
    union all select s.user_id, s.k, s.event_id, case when len(list_filter(r.held, lambda x: x > s.seg - 6)) < 8 then list_append(r.held, s.seg) else r.held end, len(list_filter(r.held, lambda x: x > s.seg - 6)) < 8 from r join s on s.user_id = r.user_id and s.k = r.k + 1)
  select event_id, allowed from r"""


def advanced(combats: DataFrame, combatants: DataFrame, order: list[Column]) -> DataFrame:
    """combat, round, current, timers of combats (combat, round, current, turns) after ``turns`` advances.

    Combatants (combat, id, timer) take turns in ``order``. Without a current one the top of the order has the turn; one
    that is gone sends the turn back to the top without a new round. Past the last comes the first and a new round,
    in which every timer loses one and goes at 0; a null timer stays. A combat has a handful of combatants.
    """
    placed = combatants.withColumn("place", F.row_number().over(Window.partitionBy("combat").orderBy(*order)) - 1)
    held = placed.groupBy("combat").agg(F.array_sort(F.collect_list(F.struct("place", "id", "timer"))).alias("held"))
    rows = combats.join(held, "combat")
    ids = F.transform("held", lambda h: h["id"])
    at = F.when(F.col("current").isNull(), F.lit(0)).otherwise(F.array_position(ids, F.col("current")).cast("int") - 1)
    size = F.size("held")
    steps = at + F.col("turns")
    new_rounds = F.when(F.col("turns") > 0, F.floor(steps / size)).otherwise(0).cast("int")
    now = F.when(F.col("turns") > 0, F.get(ids, F.pmod(steps, size).cast("int"))).otherwise(F.col("current"))
    # the counts become columns of their own before a lambda meets them
    moved = rows.select("combat", "held", (F.col("round") + new_rounds).alias("round"), new_rounds.alias("ticks"), now.alias("current"))
    timed = F.filter(F.transform("held", lambda x: x["timer"]), lambda t: t.isNotNull())
    left = F.when(F.col("ticks") == 0, timed).otherwise(F.filter(F.transform(timed, lambda t: t - F.col("ticks")), lambda t: t > 0))
    lasting = F.size(F.filter("held", lambda x: x["timer"].isNull()))
    return moved.select("combat", "round", "current", left.alias("timers"), lasting.alias("lasting"))


def turns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as combatants: rolls by quantity, lines over five without one; every third order has no current combatant, every other third one that is gone."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("combat"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") <= 5, F.floor("l_quantity").cast("int") % 20).alias("roll"), (F.col("l_suppkey") % 4).alias("modifier"), (F.col("l_linenumber") % 2 == 0).alias("is_player"), F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 4).cast("int")).alias("timer"))
    first = lines.groupBy("combat").agg(F.min("id").alias("first"))
    k = F.col("combat")
    combats = first.select("combat", F.lit(1).alias("round"), F.when(k % 3 == 0, None).when(k % 3 == 1, F.lit(-5)).otherwise(F.col("first")).cast("long").alias("current"), (k % 11).cast("int").alias("turns"))
    order = [F.col("roll").desc_nulls_last(), F.desc("modifier"), F.desc("is_player"), F.col("id")]
    return advanced(combats, lines, order).select("combat", "round", "current", F.size("timers").alias("timers"), "lasting")


TURNS_SQL = """with l as (select l_orderkey as combat, l_partkey * 10 + l_linenumber as id, case when l_linenumber <= 5 then floor(l_quantity)::int % 20 end as roll, l_suppkey % 4 as m, l_linenumber % 2 = 0 as pl, case when l_partkey % 3 <> 0 then (l_partkey % 4)::int end as timer from lineitem),
  c as (select combat, list(id order by roll desc nulls last, m desc, pl desc, id) as ids, list(timer) as timers, count(*) as n, count(*) filter (where timer is null) as lasting, min(id) as first from l group by 1),
  p as (select *, combat % 11 as turns, case when combat % 3 = 0 then 0 when combat % 3 = 1 then -1 else list_position(ids, first) - 1 end as pos, case when combat % 3 = 0 then null when combat % 3 = 1 then -5 else first end as current from c),
  q as (select *, case when turns > 0 then floor((pos + turns) / n)::int else 0 end as bumps from p)
  select combat, 1 + bumps as round, case when turns > 0 then ids[((pos + turns) % n) + 1] else current end as current, len(list_filter(timers, lambda t: t is not null and (bumps = 0 or t - bumps > 0)))::int as timers, lasting::int as lasting from q"""


def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items read as a stream until the source is drained: one of each kind for a book at a time.

    An item is a duplicate while one of its book and kind is in flight, forty days at most; what the watermark has
    passed is forgotten, so that state stays bounded.
    """
    events = table(spark, sf_dir, "events")
    place = f"{shared_root(spark)}/queue-{uuid.uuid4().hex}"
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    items = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days").select("user_id", "event_type", "ts").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    running = items.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(items.schema).parquet(f"{place}/out")


QUEUE_SQL = "select distinct user_id, event_type from events"
