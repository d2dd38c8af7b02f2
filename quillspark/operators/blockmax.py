"""Sparse top-k that skips blocks: an index read in blocks of documents, with frequent slots' largest weight in each block beside it.

The sum of a query's largest weights in a block bounds the score of any document in it.  A query reads its slots' maxima,
scores the few blocks of the highest bounds, and takes the k-th score as the bar; only blocks that may pass it are read
further.  What it returns is what the sum over all postings returns.

A block is a range of keys, so that the postings are the index itself.  Maxima are stored where they are far fewer than
their postings; those of other slots are made of the postings by the search that asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from .index import kept, query_slots, stored, stored_index

#: Documents of a block, about, and blocks scored for the bar.
BLOCK_DOCUMENTS, SEEDS = 64, 4
#: Postings a block, on average, beyond which a slot's maxima are stored.
PER_BLOCK = 4
#: Sums of doubles in another order may differ by this share.
_SLACK = 1e-9


def _maxima(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("idx", "block").agg(F.max("weight").alias("top"), F.count("*").alias("n"))


def _block(key: str, low: int, width: int) -> Column:
    """The block of a key; a document without key stands in one before all others."""
    return F.coalesce(F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))


def build(postings: DataFrame, folder: str, key: str = "doc_id", block_documents: int = BLOCK_DOCUMENTS) -> None:
    """Writes ``span`` (low, width), from which a key's block follows, and ``maxima`` (idx, block, top, n) of frequent slots."""
    seen = postings.agg(F.min(key), F.max(key), F.approx_count_distinct(key)).first()
    low, keys = seen[0] or 0, (seen[1] or 0) - (seen[0] or 0) + 1
    width = max(1, keys * block_documents // max(1, seen[2]))
    postings.sparkSession.range(1).select(F.lit(low).cast("long").alias("low"), F.lit(width).cast("long").alias("width")).write.mode("overwrite").parquet(f"{folder}/span")
    frequent = postings.groupBy("idx").count().where(F.col("count") > PER_BLOCK * (keys // width + 1)).select("idx")
    maxima = _maxima(postings.join(R.small(frequent), "idx", "left_semi").withColumn("block", _block(key, low, width)))
    maxima.repartitionByRange("idx").sortWithinPartitions("idx", "block").write.mode("overwrite").parquet(f"{folder}/maxima")


def stored_blocks(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(postings with their block, maxima) of a table, built the first time that anyone asks for these very files."""
    postings = stored_index(docs, key)
    folder = stored(docs, f"maxima-{key}", lambda folder: build(postings, folder, key), "/maxima")
    span = docs.sparkSession.read.parquet(f"{folder}/span").first()
    return postings.withColumn("block", _block(key, span["low"], span["width"])), docs.sparkSession.read.parquet(f"{folder}/maxima")


class Search:
    """A query against blocks. ``rows`` is the number of its postings, ``read`` how many of them were read, those of which maxima were made twice."""

    def __init__(self, postings: DataFrame, maxima: DataFrame, query: str, k: int = 10, key: str = "doc_id", digits: int = 6):
        spark = postings.sparkSession
        times = query_slots(spark, {"q": query})["q"]
        slots = sorted(times)
        vector = F.broadcast(spark.createDataFrame([(slot, times[slot]) for slot in slots], "idx long, times long"))  # the query's own words
        held = postings.where(F.col("idx").isin(slots))
        few = maxima.where(F.col("idx").isin(slots))
        known = [r["idx"] for r in few.select("idx").distinct().collect()]  # of the query's own words
        few = few.withColumn("made", F.lit(0).cast("long")).unionByName(_maxima(held.where(~F.col("idx").isin(known))).withColumn("made", F.col("n")))
        bounds = kept(few.join(vector, "idx").groupBy("block").agg(F.sum(F.col("times") * F.col("top")).alias("bound"), F.sum("n").alias("n"), F.sum("made").alias("made")))

        def best(rows: DataFrame) -> DataFrame:
            scores = rows.join(vector, "idx").groupBy(key).agg(F.sum(F.col("times") * F.col("weight")).alias("score"))
            return R.top(scores.withColumn("score", F.round("score", digits)), k, key)

        seeds = bounds.orderBy(F.desc("bound"), "block").limit(SEEDS).collect()
        first = best(held.where(F.col("block").isin([r["block"] for r in seeds]))).collect()
        # a score may be rounded up to the bar
        bar = first[-1]["score"] * (1 - _SLACK) - 10.0**-digits if len(first) == k else float("-inf")
        passing = bounds.where(F.col("bound") >= bar)
        sums = bounds.agg(F.sum("n"), F.sum(F.when(F.col("bound") >= bar, F.col("n"))), F.sum("made")).first()
        self.rows, self.read = sums[0] or 0, (sums[1] or 0) + (sums[2] or 0) + sum(r["n"] for r in seeds if r["bound"] < bar)
        self.hits = best(held.join(R.small(passing.select("block")), "block", "left_semi"))
