"""Encounters built for parties from a table of monsters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import advice as A
from ..functions import rules
from .index import kept

#: Monsters that a search gives a builder, and the challenge below which none is asked for by itself. Fixed values of the service.
CANDIDATES, FLOOR = 20, 0.125

_ASK = ["levels", "target", "later", "theme", "cr_gte", "cr_lte"]


def bounded(asks: DataFrame) -> DataFrame:
    """Asks with ``low`` and ``high``, the challenges looked for, and ``inverted`` where both were given and contradict.

    Without a ceiling the highest challenge counts whose worth the target band's budget covers; without a floor 1/8. A
    bound that was given moves one that was not.
    """
    def budget(later: bool):
        bands = len((rules.BUDGETS_2024 if later else rules.BUDGETS_2014)[0])
        each = F.array(*[rules.party_budget(F.col("levels"), band, later) for band in range(bands)])
        return F.get(each, F.least(F.greatest(F.col("target") - 1, F.lit(0)), F.lit(bands - 1)))

    worth = F.when(F.col("later"), budget(True)).otherwise(budget(False))
    rows = asks.withColumn("_high", F.coalesce("cr_lte", A.highest_challenge(worth))).withColumn("_low", F.coalesce("cr_gte", F.lit(FLOOR)))
    crossed, given = F.col("_low") > F.col("_high"), F.col("cr_gte").isNotNull()
    rows = rows.withColumn("inverted", crossed & given & F.col("cr_lte").isNotNull())
    rows = rows.withColumn("high", F.when(crossed & given, F.col("_low")).otherwise(F.col("_high"))).withColumn("low", F.when(crossed & ~given, F.col("_high")).otherwise(F.col("_low")))
    return rows.drop("_high", "_low")


def candidates(sources: DataFrame, monsters: DataFrame) -> DataFrame:
    """later, theme, low, high, ids, xps: for each source of monsters the first twenty in order of ``place`` that fit.

    monsters: id, later, cr, keywords, place. Of one edition, keyword and challenge only the first twenty can be among
    them, so that what meets the sources is small whatever the number of monsters. A null theme takes any.
    """
    worth = rules.challenge_xp(F.col("cr"))
    known = monsters.where("cr is not null").select("id", "later", F.col("cr").cast("double").alias("cr"), worth.alias("xp"), "place", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)))).alias("_theme"))
    first = Window.partitionBy("later", "_theme", "cr").orderBy("place", "id")
    few = known.where("xp is not null").withColumn("_turn", F.row_number().over(first)).where(F.col("_turn") <= CANDIDATES).drop("_turn")
    met = sources.withColumn("_theme", F.lower(F.coalesce("theme", F.lit("")))).join(few, ["later", "_theme"]).where("cr between low and high")
    best = Window.partitionBy("later", "_theme", "low", "high").orderBy("place", "id")
    rows = met.withColumn("_turn", F.row_number().over(best)).where(F.col("_turn") <= CANDIDATES)
    listed = rows.groupBy("later", "_theme", "low", "high").agg(F.array_sort(F.collect_list(F.struct("_turn", "id", "xp"))).alias("c"))
    return listed.select("later", "_theme", "low", "high", F.transform("c", lambda x: x["id"]).alias("ids"), F.transform("c", lambda x: x["xp"].cast("int")).alias("xps"))


def built(asks: DataFrame, monsters: DataFrame) -> DataFrame:
    """``asks`` (levels, target 1 to 4, later, theme, cr_gte, cr_lte) with picked (ids), band, adjusted, matched, reason and over.

    Equal asks are built once. An ask whose bounds contradict has the reason ``inverted`` and no encounter.
    """
    # kept, so that bounds are worked out once for each distinct ask and not for every row that asks
    plans = kept(bounded(kept(asks.select(*_ASK).distinct())).withColumn("_theme", F.lower(F.coalesce("theme", F.lit("")))))
    sources = plans.where("not inverted").select("later", "theme", "low", "high").distinct()
    found = plans.join(candidates(sources, monsters), ["later", "_theme", "low", "high"], "left")
    shape = "struct<picked:array<int>,band:int,adjusted:int,matched:boolean,reason:string,over:int>"
    build = F.udf(lambda levels, target, later, xps: A.build_encounter(list(levels), target, later, list(xps) if xps is not None else []), shape, useArrow=True)
    each = found.repartition(asks.sparkSession.sparkContext.defaultParallelism).withColumn("b", F.when(~F.col("inverted"), build("levels", "target", "later", "xps")))
    picked = F.transform("b.picked", lambda i: F.get("ids", i))
    each = each.select(*_ASK, picked.alias("picked"), "b.band", "b.adjusted", "b.matched", F.when(F.col("inverted"), "inverted").otherwise(F.col("b.reason")).alias("reason"), "b.over", F.coalesce(F.when(~F.col("inverted"), F.size("xps")), F.lit(0)).alias("candidates"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("theme", "cr_gte", "cr_lte")] + [F.col(f"a.{c}") == F.col(f"e.{c}") for c in ("levels", "target", "later")]
    return asks.alias("a").join(each.alias("e"), same, "left").select("a.*", *[f"e.{c}" for c in ("picked", "band", "adjusted", "matched", "reason", "over", "candidates")])


def archetypes(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` (archetype, cap) with ``id``: the smallest of the records (id, name, cr) of that name, whatever its case, within the cap.

    Of a name and challenge only the smallest id counts, so that a name is one row with a short list.
    """
    least = known.where("name is not null and cr is not null").groupBy(F.lower("name").alias("_name"), "cr").agg(F.min("id").alias("id"))
    listed = least.groupBy("_name").agg(F.collect_list(F.struct("cr", "id")).alias("_c"))
    found = F.array_min(F.transform(F.filter("_c", lambda c: c["cr"] <= F.col("cap")), lambda c: c["id"]))
    return wanted.join(listed, F.lower("archetype") == F.col("_name"), "left").withColumn("id", found).drop("_name", "_c")
