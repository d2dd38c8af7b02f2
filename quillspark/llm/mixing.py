"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order of their own and are read as
one stream of words, up to three times over, cut into blocks of equal length.
Slot j of the mix maps the golden-ratio point frac(j * phi) through the
cumulative target weights to a source; the slots of a source are ranked and
slot r takes the source's block r.  Prefix sums and ranks are two-level (within
buckets, then across), so that no source meets in one task.

Defined results: a null text has size 0; a null source is a source, the last;
documents of size 0 take nothing; an empty table gives an empty mix; repeated
rows are documents each; rows without a doc_id take part like others; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_table, map_batches, table
from .textblock import SPACED, blocks

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block at least and at most, and the slots that the mix has, about, between: a source's share is met to within a few blocks.
BLOCK_WORDS = (64, 1 << 16)
SLOTS = 1 << 17
#: Rows, about, that a bucket of the two-level sums holds.
BUCKET_ROWS = 4096
#: floor(2**32 / phi), odd: multiples of it modulo 2**32 are the golden-ratio points.
GOLDEN = 2654435769
_GRID = 12


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, block in blocks(batch.column(3)):
            counts = block.counts(block.spans(SPACED)[2])
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(row, stop - row) for k in range(3)], pa.array(counts)], ["doc_id", "source", "text_hash", "size"])


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size (words)."""
    text = F.col("text").cast("string")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_batches(wanted, _sizes, "doc_id long, source string, text_hash long, size long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """src (rank of the source), source, source_size, target.

    Targets fill by weight up to a common level; a source whose share would pass
    ``most`` times its size stops there.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("src", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(turn, (F.pmod("src", F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(most)).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", "src")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if all that fill earlier are full; the first that it does not fill has the true one
    levels = ranked.withColumn("level", level)
    levels = levels.withColumn("true_level", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(every))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce("true_level", F.lit(0.0)))
    return levels.select(F.col("src").cast("int").alias("src"), "source", "source_size", target.alias("target"))


def streams(sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Each document's place ``at`` in its source's shuffled stream of words."""
    bits = max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    placed = sized.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    placed = placed.withColumn("turn", F.xxhash64("doc_id", "size", "text_hash", F.lit("mix")))
    placed = placed.withColumn("bucket", F.shiftrightunsigned("turn", 64 - bits) if bits else F.lit(0).cast("long"))
    up_to = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(up_to), F.lit(0)))
    inside = Window.partitionBy("src", "bucket").orderBy("turn", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums.select("src", "bucket", "before"), ["src", "bucket"]).withColumn("at", F.col("before") + F.col("within")).drop("before", "within", "bucket", "turn")


def schedule(spark: SparkSession, targets: DataFrame, slots: int) -> DataFrame:
    """slot, src, block: the mix in order; ``block`` counts the source's slots."""
    whole = 1 << 32
    share = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    edges = targets.withColumn("past", F.sum("target").over(share)).withColumn("all", F.sum("target").over(Window.partitionBy()))
    edges = edges.withColumn("high", F.round(F.col("past") / F.col("all") * F.lit(float(whole))).cast("long"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0).cast("long"))).where("low < high")
    cell = 32 - _GRID
    edges = edges.select("src", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(whole)).alias("point")).withColumn("cell", F.shiftright("point", cell))
    drawn = points.join(edges, "cell").where("low <= point and point < high").select("slot", F.shiftright("slot", 14).alias("run"), "src")
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.groupBy("src", "run").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = drawn.withColumn("within", F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1)
    return ranked.join(runs.select("src", "run", "before"), ["src", "run"]).select("slot", "src", (F.col("before") + F.col("within")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_words: int | None = None) -> DataFrame:
    """slot, src, block, doc_id, source, text_hash, at, size, first, past: the pieces of documents that each slot of the mix takes (word offsets), and documents without any (slot null)."""
    spark = docs.sparkSession
    sized = keep_table(document_sizes(docs))
    whole = sized.agg(F.count("*").alias("rows"), F.sum("size").alias("words")).first()
    words = int(whole["words"] or 0)
    block_words = block_words or min(BLOCK_WORDS[1], max(BLOCK_WORDS[0], words // SLOTS))
    slots = -(-words // block_words)
    targets = keep_table(source_targets(sized, weights, most))
    plan = keep_table(schedule(spark, targets, slots))
    drawn = plan.groupBy("src").agg(F.count("*").alias("blocks"))
    limit = F.least(F.coalesce("blocks", F.lit(0)) * F.lit(block_words), F.round("target").cast("long"), F.col("source_size") * F.lit(most))
    placed = streams(sized, targets, whole["rows"]).join(drawn, "src", "left").withColumn("limit", limit).drop("blocks")
    turns = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    turns = turns.withColumn("from", F.col("turn") * F.col("source_size") + F.col("at")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("limit"))).where("from < to")
    pieces = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / F.lit(block_words)), F.floor((F.col("to") - 1) / F.lit(block_words)))))
    taken = pieces.join(plan, ["src", "block"]).select(
        "slot", "src", "block", "doc_id", "source", "text_hash", "at", "size", "source_size", "target",
        (F.greatest("from", F.col("block") * F.lit(block_words)) - F.col("from")).alias("first"),
        (F.least("to", (F.col("block") + 1) * F.lit(block_words)) - F.col("from")).alias("past"),
    )
    none = placed.where("size = 0 or at >= limit").select(F.lit(None).cast("long").alias("slot"), "src", F.lit(None).cast("long").alias("block"), "doc_id", "source", "text_hash", "at", "size", "source_size", "target", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("past"))
    return taken.unionByName(none)


def mixed_sizes(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row per row of ``docs``. ``by_text`` adds source and text_hash."""
    pieces = mix(docs)
    some = pieces.where("size > 0").groupBy("src", "at", "doc_id", "source", "text_hash", "size", "source_size", "target").agg(F.sum(F.col("past") - F.col("first")).alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken", *(["source", "text_hash"] if by_text else [])]
    return some.select(columns).unionByName(pieces.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, as the mix takes them: whole texts, and one cut after its last word taken.

    A row of which the mix takes n whole texts and some words more gives n + 1 rows; ``n_chars`` of a cut row is its own.
    Rows equal in doc_id, source and text share evenly what the mix takes of them; rows of which it takes nothing go.
    """
    sums = mixed_sizes(docs, by_text=True).where("size > 0").groupBy("doc_id", "source", "text_hash", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    each = F.floor(F.col("taken") / F.col("rows"))
    shares = sums.select(F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), "text_hash", F.floor(each / F.col("size")).cast("int").alias("whole"), (each % F.col("size")).alias("rest")).where("whole > 0 or rest > 0")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("mixed_id")) & F.col("source").cast("string").eqNullSafe(F.col("mixed_source")) & (F.xxhash64(F.col("text").cast("string")) == F.col("text_hash"))
    joined = docs.join(shares, same).select(*[docs[c] for c in docs.columns], "whole", "rest")
    # how many words a row keeps; -1 for all
    words = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole")), F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<long>")))
    return _cut_texts(joined.withColumn("words", F.explode(words)).drop("whole", "rest"), docs)


def _cut_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs`` and, last, the number of words to keep (-1: all)."""
    place = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            columns = list(batch.columns)[:-1]
            short = np.flatnonzero(keep >= 0)
            if len(short):
                texts = columns[place].to_pylist()
                lengths = columns[size].to_pylist() if size is not None else []
                for i in short.tolist():
                    for _, _, block in blocks(pa.array([texts[i]], pa.string())):
                        ends = block.spans(SPACED)[1]
                        texts[i] = texts[i].encode()[: int(ends[keep[i] - 1])].decode()
                    if size is not None:
                        lengths[i] = len(texts[i])
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if size is not None:
                    columns[size] = pa.array(lengths, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return map_batches(rows, cut, docs.schema)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))
