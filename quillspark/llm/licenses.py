"""License notices: phrase places, and an exact set-similarity join with notice templates.

Everything is DataFrame expressions.  Blocks are the lines of a text and, for
notices wrapped over lines, all windows of its consecutive words that are as long
as a template and a quarter more (``WINDOW_SLACK``).  A block meets a template if
it holds at least ``CONTAINMENT`` of the template's distinct words.  Words are
ordered by the number of texts of the corpus that hold them.  A block must hold
one of the rarest words of a template (prefix filter), and enough words of any
template (length filter); and what stands before and after that word in the
ordered words of the template and of the block must still allow the containment
(positional filter) before it is counted.

Defined results: null and empty texts, and texts without words, have no labels;
rows that share a doc_id share labels and score; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTAINMENT = 0.9
#: Words of a window beyond the template's, as a share of them.
WINDOW_SLACK = 0.25
#: What stands between words; letters keep their case here.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notice templates and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def _word_count(text: Column) -> Column:
    pieces = F.size(F.split(text, _BETWEEN)) - text.rlike(r"\A" + _BETWEEN).cast("int") - text.rlike(_BETWEEN + r"\z").cast("int")
    return F.when(text == "", F.lit(0)).otherwise(pieces).cast("long")


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def stands(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)).otherwise(F.array().cast("array<int>"))


def phrase_places(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels (array); one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gap = _BETWEEN
    some = F.col("text").rlike("(?i)" + "|".join(gap.join(p.split(" ")) for p, _ in PHRASES))
    none = F.array().cast("array<string>")
    found = texts.select("doc_id", _word_count(F.col("text")).alias("n_words"), F.when(some, _words(F.col("text"))).otherwise(none).alias("w"))
    for k, (phrase, _) in enumerate(PHRASES):
        found = found.withColumn(f"at{k}", _places(F.col("w"), phrase))
    every = F.concat(*[F.col(f"at{k}") for k in range(len(PHRASES))])
    labels = F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    return found.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base_labels"))


def _blocks(low: Column, words: Column, rare: list[str], wide: int) -> Column:
    """Structs of probes (rare words), before, words: the lines with a rare word, before -1; around each rare word the ``wide`` - 1 words before it and after it."""
    known = F.array(*[F.lit(w) for w in rare])
    lines = F.filter(F.transform(F.split(low, "\n"), lambda line: F.array_distinct(_words(line))), lambda bag: F.arrays_overlap(bag, known))
    every = F.transform(lines, lambda bag: F.struct(F.array_intersect(bag, known).alias("probes"), F.lit(-1).alias("before"), bag.alias("words")))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare))
    before = lambda i: F.least(i, F.lit(wide - 1))
    around = F.transform(places, lambda i: F.struct(F.array(F.get(words, i)).alias("probes"), before(i).alias("before"), F.slice(words, i - before(i) + 1, before(i) + wide).alias("words")))
    return F.concat(every, around)


def template_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, label, containment (the highest) of every template that a line or a window of words meets."""
    spark = docs.sparkSession
    bags = [(i, text.split(" "), label) for i, (text, label) in enumerate(templates)]
    known = sorted({w for _, words, _ in bags for w in words})
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low")).withColumn("all_words", _words(F.col("low")))
    literal = F.array(*[F.lit(w) for w in known])
    # texts that each template word stands in, over the whole corpus; as many rows as template words
    counts = texts.select(F.explode(F.array_intersect("all_words", literal)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in counts}
    order = {w: i for i, w in enumerate(sorted(known, key=lambda w: (frequency.get(w, 0), w)))}
    rows = []
    for i, words, label in bags:
        ranked = sorted(set(words), key=order.__getitem__)
        need = math.ceil(containment * len(ranked) - 1e-9)
        wide = math.ceil(len(words) * (1 + WINDOW_SLACK))
        rows += [(i, label, len(ranked), need, wide, word, place, ranked) for place, word in enumerate(ranked[: len(ranked) - need + 1])]
    prefixes = spark.createDataFrame(rows, "template int, label string, size int, need int, wide int, word string, place int, template_words array<string>")
    globally = F.array(*[F.lit(w) for w in sorted(known, key=order.__getitem__)])
    rare = sorted({r[5] for r in rows})
    probing = texts.where(F.arrays_overlap("all_words", F.array(*[F.lit(w) for w in rare]))).select("doc_id", F.explode(_blocks(F.col("low"), F.col("all_words"), rare, max(r[4] for r in rows))).alias("block"))
    # the block's words that stand in any template, in the global order
    probing = probing.select("doc_id", "block.before", "block.words", F.array_intersect(globally, "block.words").alias("ordered"), F.explode("block.probes").alias("word"))
    # the templates' prefixes: some words for each template, fixed by this module
    pairs = probing.join(F.broadcast(prefixes), "word").where(F.size("ordered") >= F.col("need"))
    # common words before and after the probed one are at most as many as either side has there
    at = (F.array_position("ordered", F.col("word")) - 1).cast("int")
    pairs = pairs.where(F.least("place", at) + 1 + F.least(F.col("size") - F.col("place") - 1, F.size("ordered") - at - 1) >= F.col("need"))
    common = lambda words: F.size(F.array_intersect(words, "template_words"))
    near = pairs.where(common(F.col("words")) >= F.col("need"))
    # windows that hold the rare word: their first places in the block, from 1
    first, last = F.greatest(F.lit(1), F.col("before") - F.col("wide") + 2), F.col("before") + 1
    in_windows = F.array_max(F.transform(F.sequence(first, last), lambda at: common(F.slice("words", at, F.col("wide")))))
    met = near.withColumn("common", F.when(F.col("before") < 0, common(F.col("words"))).otherwise(in_windows)).where("common >= need")
    return met.groupBy("doc_id", "template", "label").agg(F.max(F.col("common") / F.col("size")).alias("containment")).drop("template")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of ``docs``."""
    base = phrase_places(docs)
    found = template_matches(docs).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    none = F.array().cast("array<string>")
    both = base.join(found, "doc_id", "left").withColumn("every", F.array_union("base_labels", F.coalesce("more", none)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(F.array_sort("every"), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for op5: all lines against all templates; equal where no notice is wrapped over lines."""
    phrase_rows = ", ".join(f"('{p}', '{label}', {len(p.split(' '))})" for p, label in PHRASES)
    template_rows = ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(TEMPLATES))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
    with phrases(phrase, label, k) as (values {phrase_rows}),
    templates as (select t, label, list_distinct(string_split(txt, ' ')) as bag from (values {template_rows}) v(t, txt, label)),
    docs as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as low from documents),
    worded as (select doc_id, low, regexp_extract_all(low, '{word}') as w from docs),
    places as (
      select d.doc_id, p.label, i
      from worded d, phrases p, unnest(range(0, greatest(len(d.w) - p.k + 1, 0))) u(i)
      where contains(d.low, string_split(p.phrase, ' ')[1]) and array_to_string(list_slice(d.w, i + 1, i + p.k), ' ') = p.phrase),
    base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as labels from places group by 1),
    lines as (select doc_id, list_distinct(regexp_extract_all(line, '{word}')) as bag from (select doc_id, unnest(string_split(low, chr(10))) as line from docs) where regexp_matches(line, '(mit|apache|gnu|cc|licen|permission|redistribution|mozilla|commons|software|source)')),
    met as (
      select l.doc_id, t.label, len(list_intersect(l.bag, t.bag)) / len(t.bag) as c from lines l, templates t
      where len(list_intersect(l.bag, t.bag)) >= ceil({CONTAINMENT} * len(t.bag) - 1e-9)),
    more as (select doc_id, list(distinct label) as labels, max(c) as score from met group by 1)
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word,
      coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') as labels,
      coalesce(m.score, 0.0)::double as score
    from worded d left join base b using (doc_id) left join more m using (doc_id)"""
