"""Structure of converted books: tables of contents, sections, tables, stat blocks, candidates, grounding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import tokens
from .index import kept
from .mutations import spread, unfinished

#: Layout items between a heading and the table that it still names.
NAMES_WITHIN = 10
#: Items before a stat block in which its name is looked for.
LOOK_BACK = 18
PAGE_GAP = 3


def bookmark_category(title: Column, parent: Column) -> Column:
    """The title's category; its parent's where the title says nothing and the parent does."""
    own, above = L.heading_category(title), L.heading_category(parent)
    return F.when((own == "Rule") & (parent != "") & (above != "Rule"), above).otherwise(own)


def full_contents(headings: DataFrame, book: str, order: list[str], text: str, page: str) -> DataFrame:
    """book, place, title, category, page: every heading, untyped ones under the last typed one, and front matter before page one's first."""
    named = headings.where(F.trim(text) != "")
    w = Window.partitionBy(book).orderBy(*order)
    own = L.heading_category(F.col(text))
    rows = named.select(book, F.row_number().over(w).alias("place"), F.trim(text).alias("title"), F.coalesce(F.last(F.when(own != "Rule", own), ignorenulls=True).over(w), F.lit("Rule")).alias("category"), F.col(page).alias("page"))
    front = rows.where("place = 1 and page > 1").select(book, F.lit(0).alias("place"), F.lit("Front Matter").alias("title"), F.lit("Rule").alias("category"), F.lit(1).cast(dict(rows.dtypes)["page"]).alias("page"))
    return rows.unionByName(front)


def confident_contents(headings: DataFrame, text: str) -> DataFrame:
    """Headings whose category is a type of record; all others are dropped."""
    return headings.withColumn("category", L.heading_category(F.col(text))).where(F.trim(text) != "").where(L.record_type(F.col("category")).isNotNull())


def section_groups(blocks: DataFrame, book: str, by: list[str], title: str, page: str, text: str) -> DataFrame:
    """Runs of blocks, in the order of ``by``, with one title and no page gap over three: book, group, title, first place and page, texts joined by blank lines."""
    order = "place"
    blocks = spread(blocks, book).withColumn(order, F.row_number().over(Window.partitionBy(book).orderBy(*by)))
    w = Window.partitionBy(book).orderBy(order)
    run = F.sum(F.when(F.col(title).eqNullSafe(F.lag(title).over(w)), 0).otherwise(1)).over(w)
    named = blocks.withColumn("run", run)
    # where a gap breaks a run, the new page lies above all before it, so the run's highest page is the group's
    before = Window.partitionBy(book, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.col(page) - F.max(page).over(before) > PAGE_GAP, 1).otherwise(0)
    grouped = named.withColumn("gap", gap).withColumn("group", F.col("run") * 1_000_000 + F.sum("gap").over(Window.partitionBy(book, "run").orderBy(order)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return grouped.groupBy(book, "group").agg(F.first(title).alias("title"), F.min(order).alias("first_place"), F.min(page).alias("page"), F.array_join(F.transform(parts, lambda s: s[text]), "\n\n").alias("text"))


def named_tables(items: DataFrame, book: str, order: str) -> DataFrame:
    """The tables among items (kind, text, html): their caption, else the heading within ten items, else a number; and an id."""
    w = Window.partitionBy(book).orderBy(order)
    header = F.lower("kind") == "section_header"
    heads = header & (F.trim("text") != "")
    parsed = L.column_of(L.table_cells, "array<array<string>>")(F.col("html"))
    rows = items.withColumn("island", F.sum(F.when(heads, 1).otherwise(0)).over(w)).withColumn("heading", F.last(F.when(heads, F.col("text")), ignorenulls=True).over(w))
    inside = Window.partitionBy(book, "island").orderBy(order)
    rows = rows.withColumn("since", F.sum(F.when(~header, 1).otherwise(0)).over(inside) - 1)
    tables = rows.where((F.lower("kind") == "table") & (F.trim("html") != "")).withColumn("cells", parsed)
    number = F.sum(F.when(F.col("cells").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    tables = tables.withColumn("number", F.coalesce(number, F.lit(0))).where("cells is not null")
    name = F.when(F.trim("text") != "", F.col("text")).when(F.col("heading").isNotNull() & (F.col("since") <= NAMES_WITHIN), F.col("heading")).otherwise(F.concat(F.lit("Table "), (F.col("number") + 1).cast("string")))
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]+", "-"), "^-|-$", "")
    return tables.select(book, order, name.alias("name"), F.when(slug == "", F.concat(F.lit("t"), F.col("number").cast("string"))).otherwise(F.concat_ws("-", slug, F.col("number").cast("string"))).alias("slug"), "cells")


def stat_blocks(items: DataFrame, book: str, order: str) -> DataFrame:
    """Stat blocks among items (kind, text): a size line with an armor class in the two items after it, up to the next block or outer heading, under the nearest name before."""
    w = Window.partitionBy(book).orderBy(order)
    kind = F.lower(F.coalesce("kind", F.lit("")))
    header = kind.contains("header") | kind.contains("section") | (kind == "title")
    plain = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    outer = header & ~plain.isin("actions", "reactions", "legendary actions", "lair actions", "regional effects", "traits")
    armor = F.coalesce(L.has(F.lead("text", 1).over(w), "armor class"), F.lit(False)) | F.coalesce(L.has(F.lead("text", 2).over(w), "armor class"), F.lit(False))
    begins = F.col("text").rlike(L.SIZE_LINE) & armor
    name = F.trim("text")
    fits = outer & name.rlike(r"\p{L}") & (F.length(name) <= 48) & (F.size(F.filter(F.split(name, " "), lambda x: x != "")) <= 6)
    near = w.rowsBetween(-LOOK_BACK, -1)
    rows = items.withColumn("begins", begins).withColumn("name", F.last(F.when(fits, name), ignorenulls=True).over(near)).withColumn("block", F.sum(F.when(F.col("begins") | outer, 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, "text", "begins", "name")))
    blocks = rows.groupBy(book, "block").agg(parts.alias("parts"))
    first = F.col("parts")[0]
    return blocks.where(first["begins"] & first["name"].isNotNull()).select(book, first[order].alias(order), first["name"].alias("name"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def candidates(sections: DataFrame, category: str, title: str, monsters: DataFrame | None = None) -> DataFrame:
    """Sections with the type of record they may hold and its prior.

    Sections without a type are dropped, unless their title is a known monster (``monsters``: normalised ``key``,
    ``canonical``), or no section of the book has a type at all.
    """
    typed = sections.withColumn("type", L.record_type(F.coalesce(F.col(category), F.lit("Unknown")))).withColumn("failed", ~F.coalesce(F.bool_or(F.col("type").isNotNull()).over(Window.partitionBy("book")), F.lit(False)))
    if monsters is not None:
        key = F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}]", "")
        typed = typed.join(monsters, key == F.col("key"), "left").drop("key")
    else:
        typed = typed.withColumn("canonical", F.lit(None).cast("string"))
    recovered = F.col("type").isNull() & F.col("canonical").isNotNull()
    category_of = F.when(recovered, "Monster").when(F.col("type").isNull(), "Unknown").otherwise(F.col(category))
    out = typed.where(F.col("type").isNotNull() | recovered | F.col("failed")).withColumn("prior", L.type_prior(category_of)).withColumn("name", F.when(recovered, F.col("canonical")).otherwise(F.col(title)))
    return out.withColumn("type", F.coalesce("type", F.get("prior", 0))).drop("failed", "canonical")


def grounded_in(value: Column, source: Column) -> Column:
    """Whether every word of three letters or more of ``value`` is, but for a quarter of its letters (one at least), a word of ``source``."""
    words = F.array_distinct(F.filter(tokens(value), lambda t: F.length(t) >= 3))
    near = lambda a, b: (a == b) | (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / 4)))
    return (F.size(words) > 0) & F.forall(words, lambda a: F.exists(F.array_distinct(tokens(source)), lambda b: near(a, b)))


def verdict(tier0: Column, score: Column, floor: float, judged: Column, enabled: Column) -> Column:
    """Grounded, Ungrounded or Uncertain from word grounding, the nearest passage's score, and a judge's answer (null for none)."""
    below = score < floor
    return F.when(tier0, "Grounded").when(~enabled | score.isNull(), "Uncertain").when(~below & judged.isNotNull(), F.when(judged, "Grounded").otherwise("Ungrounded")).when(below, "Ungrounded").otherwise("Uncertain")


def disposition(status: Column, name: Column, confidence: Column) -> Column:
    doubtful = F.coalesce(confidence.isin("low", "medium"), F.lit(False)) | L.scanning_marks(name)
    return F.when(status == "Ungrounded", "Ungrounded").when((status == "Uncertain") | doubtful, "NeedsReview").otherwise("Accepted")


def action(status: Column, name: Column) -> Column:
    return F.when(status == "Ungrounded", "MarkUngrounded").when((status == "Grounded") & ~L.scanning_marks(name), "Promote").otherwise("LeaveFlagged")


# Types whose records must be known or look like one.
GATED = ("Spell", "Monster", "Class", "Race", "Background", "Feat", "Condition", "God")


def resolved_type(name: Column, text: Column, prior: Column, same_type: Column, match_type: Column) -> Column:
    """Force:<type>, Drop, Defer or Decline; ``same_type`` is the prior's own match, ``match_type`` any match's type (null for none)."""
    real = L.complete_stat_block(text) | L.object_stat_block(text) | L.magic_item(text) | L.level_progression(text)
    force = lambda t: F.concat(F.lit("Force:"), t)
    return (
        F.when(same_type.isNotNull(), force(same_type))
        .when(match_type.isNull() & ~L.name_like(name), "Drop")
        .when(L.object_stat_block(text), force(F.lit("Object")))
        .when(L.complete_stat_block(text), force(F.lit("Monster")))
        .when(L.magic_item(text), force(F.lit("MagicItem")))
        .when(match_type.isNotNull(), force(match_type))
        .when(F.array_contains(prior, "Object"), "Defer")
        .when(F.get(prior, 0).isin(*GATED) & ~real, "Decline")
        .otherwise("Defer")
    )


def promoted(blocks: DataFrame, book: str, order: str) -> DataFrame:
    """book, order, part, kind, text, level: the items of layout blocks (kind, text, level, html), in each book's order.

    A block is read with the headings before it in mind, so a book is folded in order by one task, a block at a time.
    """
    w = Window.partitionBy(book).orderBy(order)
    rows = blocks.select(book, order, "kind", "text", "level", "html", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))
    schema = f"{book} {dict(blocks.dtypes)[book]}, {order} {dict(blocks.dtypes)[order]}, part int, kind string, text string, level int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, promoter = None, L.Promoter()
        plain = lambda x: None if x is None or x != x else x
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r[0] != now:
                    now, promoter = r[0], L.Promoter()
                level = plain(r.level)
                for part, item in enumerate(promoter.items(r.kind, plain(r.text), None if level is None else int(level), plain(r.html), plain(r.before), plain(r.after))):
                    out.append((r[0], r[1], part, *item))
            frame = pd.DataFrame(out, columns=[book, order, "part", "kind", "text", "level"])
            yield frame.astype({"level": "Int32"})

    return rows.repartition(book).sortWithinPartitions(book, order).mapInPandas(fold, schema)


def reground(records: DataFrame, done: DataFrame, key: str, batch: int = 50) -> DataFrame:
    """Records (grounded, p_name) that a checkpoint does not list, each with its action and its batch.

    Places are counted within ranges of the key and then across them, so that records do not meet in one task. The
    ranges are written once: made twice, they need not be the same.
    """
    left = unfinished(records, done, key)
    ranged = kept(left.repartitionByRange(key).withColumn("_range", F.spark_partition_id())).withColumn("action", action(F.when(F.col("grounded"), "Grounded").otherwise("Uncertain"), F.col("p_name")))
    within = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1)
    before = within.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.select("_range", "_before"), "_range").withColumn("batch", F.floor((F.col("_before") + F.col("_place")) / batch)).drop("_range", "_place", "_before")
