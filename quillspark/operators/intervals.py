"""Points in intervals that are data: the first interval, in order of start, that holds a point.

Of intervals in order of start, one counts only beyond what those before it reach: what it shares with the furthest of
them begins later than that one and belongs to it or to one before.  So each is cut to its own part, and the parts are
disjoint.  Parts and points are sorted together into ranges of (book, page): a point is in the last part that begins at
or before it, or in none.  What the ranges before leave open is carried to each, one row for a range at most, so that
neither a long interval nor a large book multiplies rows or stands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import kept

#: The page that an open end reaches.
LAST = 1 << 40


def running_max(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the largest ``value`` of the rows of the group before each row; null for the first.

    A group may be most of the rows: rows are sorted into ranges, each range's maximum is found for itself, and only
    those (one for each range and group) meet in a window of the group.
    """
    placed = kept(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("_range", group).agg(F.max(value).alias("_top")).withColumn("_carried", F.max("_top").over(before)).drop("_top")
    own = placed.withColumn(name, F.max(value).over(within))
    return own.join(carried, ["_range", group]).withColumn(name, F.greatest(name, "_carried")).drop("_range", "_carried")


def next_start(sections: DataFrame, group: str, start: str, order: list[str]) -> DataFrame:
    """``_next``: the start of the row that follows in (start, order), by the same two levels."""
    placed = kept(sections.repartitionByRange(group, start, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", group).orderBy(start, *order)
    after = Window.partitionBy(group).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    carried = placed.groupBy("_range", group).agg(F.min(start).alias("_low")).withColumn("_carried", F.min("_low").over(after)).drop("_low")
    own = placed.withColumn("_next", F.lead(start).over(within))
    return own.join(carried, ["_range", group]).withColumn("_next", F.coalesce("_next", "_carried")).drop("_range", "_carried")


def own_parts(sections: DataFrame, group: str, start: str, end: str, order: str) -> DataFrame:
    """The sections with ``_from`` and ``_to``, the pages that are theirs by first match; those without any are left out.

    A null ``end`` reaches to the next start less one, the last one's has no bound.
    """
    ended = next_start(sections.where(F.col(start).isNotNull()), group, start, [order]).withColumn("_to", F.coalesce(end, F.col("_next") - 1, F.lit(LAST)).cast("long")).drop("_next")
    cut = running_max(ended, group, [start, order], "_to", "_reached")
    return cut.withColumn("_from", F.greatest(F.col(start).cast("long"), F.col("_reached") + 1)).drop("_reached").where("_from <= _to")


def first_interval(points: DataFrame, sections: DataFrame, group: str, point: str, start: str, end: str, order: str, take: list[str]) -> DataFrame:
    """``points`` with the columns ``take`` of the first section that holds each; nulls where none does.

    ``order`` tells sections of one start apart; a point or section without group is in none.
    """
    parts = own_parts(sections, group, start, end, order).where(F.col(group).isNotNull())
    parts = parts.select(group, F.col("_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"), F.struct("_to", *take).alias("_part"), F.lit(None).cast(points.schema).alias("_row"))
    # equal points may be many: their hash deals them over ranges
    asked = points.select(group, F.col(point).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*points.columns).alias("_salt"), F.lit(None).cast(parts.schema["_part"].dataType).alias("_part"), F.struct(*points.columns).alias("_row"))
    placed = kept(parts.unionByName(asked).repartitionByRange(group, "_at", "_kind", "_salt").drop("_salt").withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.where(F.col(group).isNotNull()).groupBy(group, "_range").agg(F.max(F.when(F.col("_kind") == 0, F.col("_at"))).alias("_at"))
    carried = starts.withColumn("_at", F.last("_at", ignorenulls=True).over(before)).where("_at is not null")
    # a range begins within one group at most, so these are no more than the ranges
    carried = placed.where("_kind = 0").drop("_range").join(F.broadcast(carried), [group, "_at"]).select(group, "_range", F.col("_part").alias("_carried"))
    met = placed.withColumn("_part", F.last("_part", ignorenulls=True).over(within)).where("_kind = 1").join(F.broadcast(carried), [group, "_range"], "left").withColumn("_part", F.coalesce("_part", "_carried"))
    holds = F.col("_at") <= F.col("_part._to")
    return met.select("_row.*", *[F.when(holds, F.col(f"_part.{c}")).alias(c) for c in take])
