"""Corpus curation: chunks, sections, duplicates, coverage, names, grounding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mutations import spread

CHUNK, OVERLAP, LOOK_BACK = 800, 100, 200


def split_long(text: str, most: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``most`` characters that prefer to end at a space in their last part; the next starts ``overlap`` before the end."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while True:
        stop = min(start + most, len(text))
        if stop < len(text):
            space = text.rfind(" ", stop - LOOK_BACK, stop)
            stop = space if space > start + overlap else stop
        out.append(text[start:stop])
        if stop >= len(text):
            return out
        start = max(start + 1, stop - overlap)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "pieces": [split_long(t or "") for t in batch.text]})

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, pieces array<string>").select("doc_id", F.posexplode("pieces").alias("chunk_index", "chunk"))


def sessions(rows: DataFrame, part: str, order: str, value: str, gap: int) -> DataFrame:
    """Gaps and islands: consecutive rows no further apart than ``gap`` share an island; nulls come last, and of equal rows each counts by itself."""
    w = Window.partitionBy(part).orderBy(F.asc_nulls_last(order), F.asc_nulls_last(value))
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def carried_forward(rows: DataFrame, part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(part).orderBy(*order)))


def winners(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("place = 1").drop("place")


def coverage(roster: DataFrame, held: DataFrame, key: str, kind: str) -> DataFrame:
    """Each kind's present, missing and extra keys, and the share present (100 for an empty roster; half to even)."""
    both = roster.select(kind, key).distinct().withColumn("r", F.lit(True)).join(held.select(kind, key).distinct().withColumn("h", F.lit(True)), [kind, key], "full_outer")
    sums = both.groupBy(kind).agg(F.count_if(F.col("r") & F.col("h")).alias("present"), F.count_if(F.col("r") & F.col("h").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("extra"))
    total = F.col("present") + F.col("missing")
    return sums.withColumn("percent", F.when(total == 0, 100.0).otherwise(F.bround(100.0 * F.col("present") / total, 1)))


def _deleted(name: Column, most: Column) -> Column:
    """The name and what is left of it after up to ``most`` (2 at most) deletions of a character."""
    shorter = lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    once = F.array_distinct(shorter(name))
    twice = F.array_distinct(F.flatten(F.transform(once, shorter)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(name), F.when(most >= 1, once).otherwise(none), F.when(most >= 2, twice).otherwise(none)))


def _pieces(name: Column, most: Column) -> Column:
    """The name cut into ``most`` + 1 runs: as many edits leave one of them whole."""
    wide = F.ceil(F.length(name) / (most + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), most), lambda i: F.substring(name, (i * wide + 1).cast("int"), wide))


def _probes(name: Column, most: Column) -> Column:
    """All runs of the name that may be such a piece of a name within two characters of its length."""
    widths = F.array_distinct(F.transform(F.sequence(F.length(name) - 2, F.length(name) + 2), lambda n: F.ceil(n / (F.floor((n + 2) / 10) + 1)).cast("int")))
    return F.array_distinct(F.flatten(F.transform(widths, lambda k: F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, k)))))


def fuzzy_matches(left: DataFrame, right: DataFrame, least: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """id, name, match, ratio: the name itself, or the best of those within two characters of length and the ratio; ``by`` columns must be equal.

    Names that a ratio of 0.9 leaves two edits at most (under 28 characters) meet on what deletions leave of both,
    which no common prefix makes a hot key; longer ones on a whole piece of one of them. Both lose no match.
    """
    if least < 0.9:
        raise ValueError("candidates are complete from a ratio of 0.9 on")
    by = by or []
    names = right.select(*by, F.col("name").alias("match")).distinct()
    exact = left.join(names.hint("merge"), (F.col("name") == F.col("match")) & _same(left, names, by), "left_semi").select(*by, "id", "name", F.col("name").alias("match"), F.lit(1.0).alias("ratio"))
    rest = left.select(*by, "id", "name").join(names.hint("merge"), (F.col("name") == F.col("match")) & _same(left, names, by), "left_anti")
    most = lambda c: F.floor((F.length(c) + 2) / 10).cast("int")
    keys = lambda df, c, other: df.withColumn("key", F.explode(F.when(most(F.col(c)) <= 2, _deleted(F.col(c), most(F.col(c)))).otherwise(F.array().cast("array<string>")))).unionByName(df.where(F.length(c) >= 26).withColumn("key", F.explode(F.transform(other(F.col(c), most(F.col(c))), lambda x: F.concat(F.lit("|"), x)))))
    probing = keys(rest, "name", _probes)
    offered = keys(names, "match", lambda c, m: _pieces(c, m))
    # some 18 keys for a name of up to 17 characters, ten times as many for one of up to 27
    rows = 18 * left.count() + 180 * right.count()
    deal = lambda df: spread(df, *by, "key", rows=rows)
    pairs = deal(probing).join(deal(offered).hint("merge"), [*by, "key"]).select(*by, "id", "name", "match").distinct()
    ratio = 1 - F.levenshtein("name", "match") / F.greatest(F.length("name"), F.length("match"))
    good = pairs.where(F.abs(F.length("name") - F.length("match")) <= 2).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= least)
    return winners(exact.unionByName(good), ["id"], [F.desc("ratio"), F.col("match")]).select("id", "name", "match", "ratio")


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & (left[c] == right[c])
    return out


def roster_states(roster: DataFrame, held: DataFrame, source: str) -> DataFrame:
    """name, state: of the source's roster (name, source) present or missing; held beyond it, extra_other if another source's roster has the name, else extra_unknown."""
    known = roster.groupBy("name").agg(F.bool_or(F.col("source") == source).alias("own"))
    both = known.join(held.select("name").distinct().withColumn("held", F.lit(True)), "name", "full_outer")
    own, here = F.coalesce("own", F.lit(False)), F.col("held").isNotNull()
    state = F.when(own & here, "present").when(own, "missing").when(here & F.col("own").isNotNull(), "extra_other").when(here, "extra_unknown")
    return both.withColumn("state", state).where("state is not null")


def cleaned_names(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Records (with backfill) of one name: backfilled ones go where a grounded one is; grounded ones after the first are flagged."""
    group = Window.partitionBy(*key)
    turn = F.row_number().over(Window.partitionBy(*key, "backfill").orderBy(order))
    counted = rows.withColumn("grounded", F.sum(F.when(~F.col("backfill"), 1).otherwise(0)).over(group)).withColumn("turn", turn)
    kept = counted.where(~(F.col("backfill") & (F.col("grounded") >= 1)))
    return kept.withColumn("flagged", (F.col("grounded") >= 2) & ~F.col("backfill") & (F.col("turn") > 1)).drop("grounded", "turn")


def authority_label(matched: Column, official: Column, verified: Column) -> Column:
    return F.when(matched, "canon").when(official, "canon-unindexed").when(F.coalesce(verified, F.lit(False)), "verified-thirdparty").otherwise("homebrew")


def item_type(rarity: Column) -> Column:
    return F.when(F.lower(rarity).isin("common", "uncommon", "rare", "very rare", "legendary", "artifact"), "MagicItem").otherwise("Item")


def registered(forms: DataFrame, sources: DataFrame) -> DataFrame:
    """Forms (file, name, version, type, source) with edition, book_type and result, the first thing wrong or ok."""
    edition = F.try_element_at(F.filter(F.array(*map(F.lit, ("Edition2014", "Edition2024"))), lambda k: F.lower(k) == F.lower("version")), F.lit(1))
    book_type = F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, ("Core", "Supplement", "Adventure", "Setting", "Unknown"))), lambda k: F.lower(k) == F.lower("type")), F.lit(1)), F.lit("Unknown"))
    known = forms.join(sources.select(F.lower("key").alias("_key")).distinct(), F.lower("source") == F.col("_key"), "left")
    wrong = (
        F.when(F.col("file").isNull(), "file is required.")
        .when(~F.lower("file").endswith(".pdf"), "Only PDF files are accepted.")
        .when(F.coalesce("name", F.lit("")) == "", "displayName is required.")
        .when(edition.isNull(), "Invalid version")
        .when(F.col("source").isNotNull() & F.col("_key").isNull(), "unknown source key")
    )
    return known.withColumn("result", F.coalesce(wrong, F.lit("ok"))).withColumn("edition", F.when(F.col("result") == "ok", edition)).withColumn("book_type", F.when(F.col("result") == "ok", book_type)).drop("_key")


def number_labelled(text: Column, value: str, label: str, wrong: list[str], window: int = 30) -> Column:
    """False where a whole occurrence of the number has a wrong label, and not its own, within ``window`` characters."""
    low = F.lower(text)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: (F.substring(low, i, len(value)) == value) & ~F.substring(low, i + len(value), 1).rlike("[0-9]") & ((i == 1) | ~F.substring(low, i - 1, 1).rlike("[0-9]")))
    first = lambda i: F.greatest(i - window, F.lit(1))
    near = lambda i: F.substring(low, first(i), i + len(value) + window - first(i))
    bad = lambda s: s.rlike("|".join(w.lower() for w in wrong)) & ~s.contains(label.lower())
    return ~F.exists(at, lambda i: bad(near(i)))
