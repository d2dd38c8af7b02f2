"""Listings by what no column says, and advice on builds and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontree as J
from ..functions.text import name_key
from .search import listed

#: Spells of a recommendation at most. Fixed value of the service.
MOST_SPELLS = 25
_NAMED = "array<struct<name:string>>"


def spell_classes(index: DataFrame, text: str = "text") -> DataFrame:
    """source, name, class of an index of JSON: source, then spell, then its classes and those of class variants, each once."""
    sources = index.select(F.explode(F.from_json(text, "map<string,map<string,string>>")).alias("source", "spells"))
    spells = sources.select("source", F.explode("spells").alias("name", "info"))
    names = F.concat(*[F.coalesce(F.from_json(F.get_json_object("info", f"$.{k}"), _NAMED), F.array().cast(_NAMED)) for k in ("class", "classVariant")])
    return spells.select("source", "name", F.explode(F.array_distinct(F.transform(names, lambda c: c["name"]))).alias("class")).where("class is not null")


def castable(spells: DataFrame, known: DataFrame, of: Column) -> DataFrame:
    """The ``spells`` (name, source) that a class casts: by name and source if that pair is known at all, else by name in any source."""
    keyed = known.select(name_key(F.col("name")).alias("_n"), name_key(F.col("source")).alias("_s"), (name_key(F.col("class")) == name_key(of)).alias("_has"))
    exact = keyed.groupBy("_n", "_s").agg(F.bool_or("_has").alias("_exact"))
    loose = keyed.groupBy(F.col("_n").alias("_m")).agg(F.bool_or("_has").alias("_loose"))
    met = spells.join(exact, (name_key(F.col("name")) == F.col("_n")) & (name_key(F.col("source")) == F.col("_s")), "left").join(loose, name_key(F.col("name")) == F.col("_m"), "left")
    return met.where(F.coalesce("_exact", "_loose", F.lit(False))).drop("_n", "_s", "_m", "_exact", "_loose")


def listed_spells(rows: DataFrame, where: Column, known: DataFrame, of: str, cap: int = 0) -> DataFrame:
    """The spells of a filter that a class casts, by id, with their exact number."""
    return listed(castable(rows.where(where & (F.col("type") == "Spell")), known, F.lit(of)), F.lit(True), cap)


def listed_races(rows: DataFrame, where: Column, ability: str, cap: int = 0) -> DataFrame:
    """The races of a filter that raise an ability, by a fixed bonus or by choice, by id, with their exact number."""
    raised = J.arrow(J.boosted, "array<string>")(F.col("fields"))
    return listed(rows.where(where & (F.col("type") == "Race")), F.array_contains(raised, ability.strip().lower()), cap)


def highest_spell_level(level: Column) -> Column:
    """The highest spells of a full caster of that level; of none, a first level's."""
    return F.when(level.isNull(), 1).otherwise(F.least(F.greatest(F.floor((level + 1) / 2), F.lit(1)), F.lit(9))).cast("int")


def recommended_spells(builds: DataFrame, spells: DataFrame) -> DataFrame:
    """``builds`` (build, class, level) with the ids of up to 25 spells (id, class, level) of their class, by level and id.

    Of a class and level only the first 25 can be among them, so that a class is a short list whatever its spells are.
    """
    each = spells.where("level between 1 and 9").groupBy(F.lower("class").alias("_class"), F.col("level").alias("_level")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, MOST_SPELLS).alias("ids"))
    by_class = each.groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("_level", "ids"))).alias("_lists"))
    met = builds.join(by_class, F.lower("class") == F.col("_class"), "left").withColumn("_top", highest_spell_level(F.col("level")))
    within = F.flatten(F.transform(F.filter("_lists", lambda x: x["_level"] <= F.col("_top")), lambda x: x["ids"]))
    return met.withColumn("spells", F.coalesce(F.slice(F.array_distinct(within), 1, MOST_SPELLS), F.array().cast("array<long>"))).drop("_class", "_lists", "_top")


def critique(sheets: DataFrame, classes: DataFrame) -> DataFrame:
    """sheet, kind, about: what sheets (sheet, class, level, subclass, have) leave open of their classes (class, title, features).

    ``UntakenChoice`` about the subclass from the first level whose feature holds its title, and about each feature of a
    level reached that the sheet does not record; the features that hold the title are the subclass's own place. A class
    that is not known says nothing.
    """
    known = classes.select(F.lower("class").alias("_class"), "title", F.explode("features").alias("f")).select("_class", "title", F.col("f.name").alias("feature"), F.col("f.level").alias("at"))
    titled = (F.trim("title") != "") & F.contains(F.lower("feature"), F.lower("title"))
    due = known.where(titled).groupBy("_class", "title").agg(F.min("at").alias("at"))
    mine = sheets.withColumn("_class", F.lower("class"))
    slot = mine.join(due, "_class").where("level >= at and coalesce(trim(subclass), '') = ''").select("sheet", F.lit("UntakenChoice").alias("kind"), F.col("title").alias("about"))
    plain = known.where(~F.coalesce(titled, F.lit(False))).select("_class", "feature", "at")
    recorded = sheets.select(F.col("sheet"), F.explode("have").alias("_have")).select("sheet", name_key(F.col("_have")).alias("_key")).distinct()
    owed = mine.join(plain, "_class").where("at <= level").withColumn("_key", name_key(F.col("feature")))
    missing = owed.join(recorded, ["sheet", "_key"], "left_anti").select("sheet", F.lit("UntakenChoice").alias("kind"), F.col("feature").alias("about"))
    return slot.unionByName(missing)


def word_jaccard(a: Column, b: Column) -> Column:
    """How many of both texts' words, between blanks, hyphens, apostrophes, brackets and colons, they share; case plays no part."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[ \-'():]"), lambda w: w != ""))
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both > 0, F.size(F.array_intersect(words(a), words(b))) / both).otherwise(0.0)


def merged_passages(hits: DataFrame, books: list[str] | None = None) -> DataFrame:
    """Hits (text, book, section, score) of several searches, each passage once with its best score; of some books, if any are given."""
    scope = hits.where(F.col("book").isin(books)) if books else hits
    return scope.groupBy("text", "book", "section").agg(F.max("score").alias("score"))
