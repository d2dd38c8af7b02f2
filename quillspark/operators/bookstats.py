"""Term statistics that follow the books: each book's own counts are kept, and of a change only the difference is written.

Under ``root``: ``books/book=…`` has a book's (term, df) and ``sizes/book=…`` its (documents, tokens); each change is a
folder of (term, delta) and one of (documents, tokens) deltas, named by its number, and ``base-…`` folders are the sums
of all changes up to theirs.  A change is applied in two steps, each of which may be repeated: the deltas are written
first, once; then the books' own counts are replaced.  A batch that comes again after a failure finds its deltas written
and only replaces the counts, so every change counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import tokens
from .index import folders, is_complete, kept, remove

#: Changes after which a base is written.
MANY_CHANGES = 20
#: The row by which a book is known that has no terms, or none any more.
_MARK = ""


class BookStats:
    """``apply`` takes the whole new content of some books; ``terms`` and ``totals`` are the sums over all books."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table by book; empty before anything is written."""
        kind = StructType.fromDDL(schema)
        return self.spark.read.schema(kind).parquet(f"{self.root}/{name}") if folders(self.spark, f"{self.root}/{name}") else self.spark.createDataFrame([], kind)

    def books(self) -> DataFrame:
        return self._read("books", "term string, df long, book string").where(F.col("term") != _MARK)

    def sizes(self) -> DataFrame:
        return self._read("sizes", "documents long, tokens long, book string")

    def _numbers(self, kind: str) -> list[int]:
        names = [n for n in folders(self.spark, self.root) if n.startswith(f"{kind}-")]
        return sorted(int(n.rsplit("-", 1)[1]) for n in names if is_complete(self.spark, f"{self.root}/{n}/terms") and is_complete(self.spark, f"{self.root}/{n}/totals"))

    def _changes(self, what: str, schema: str) -> DataFrame:
        """All changes of ``terms`` or ``totals``: the last base and what came after it."""
        base = max(self._numbers("base"), default=None)
        paths = [f"{self.root}/base-{base}/{what}"] if base is not None else []
        paths += [f"{self.root}/change-{n}/{what}" for n in self._numbers("change") if base is None or n > base]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def terms(self) -> DataFrame:
        """term, df; terms that no book has any more are gone."""
        return self._changes("terms", "term string, delta long").groupBy("term").agg(F.sum("delta").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """documents, tokens, avgdl in one row; never below 0, and a mean length of 1 for no documents."""
        sums = self._changes("totals", "documents long, tokens long").agg(*[F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(0)).alias(c) for c in ("documents", "tokens")])
        return sums.withColumn("avgdl", F.when(F.col("documents") == 0, 1.0).otherwise(F.col("tokens") / F.col("documents")))

    def apply(self, number: int, chunks: DataFrame) -> None:
        """Chunks (book, text, gone): the books named have these texts from now on; of a book that is gone, none.

        Counts of other books are neither read nor written: the books' folders are pruned by those of the change.
        """
        rows = kept(chunks.where("book is not null").select(F.col("book").cast("string").alias("book"), F.when(~F.coalesce("gone", F.lit(False)), F.coalesce("text", F.lit(""))).alias("text")))
        touched = rows.select("book").distinct()
        texts = rows.where("text is not null").select("book", tokens(F.col("text")).alias("w"))
        counts = kept(texts.select("book", F.explode(F.array_distinct("w")).alias("term")).groupBy("book", "term").agg(F.count("*").alias("df")))
        sizes = kept(touched.join(texts.groupBy("book").agg(F.count("*").alias("documents"), F.sum(F.size("w")).cast("long").alias("tokens")), "book", "left").na.fill(0))
        change = f"{self.root}/change-{number}"
        if not is_complete(self.spark, f"{change}/terms"):
            old = self.books().join(touched, "book", "left_semi").select("term", (-F.col("df")).alias("delta"))
            net = counts.select("term", F.col("df").alias("delta")).unionByName(old).groupBy("term").agg(F.sum("delta").alias("delta")).where("delta <> 0")
            net.write.mode("overwrite").parquet(f"{change}/terms")
        if not is_complete(self.spark, f"{change}/totals"):
            before = self.sizes().join(touched, "book", "left_semi").select((-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
            sizes.select("documents", "tokens").unionByName(before).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "tokens")]).write.mode("overwrite").parquet(f"{change}/totals")
        marks = touched.select(F.lit(_MARK).alias("term"), F.lit(0).cast("long").alias("df"), "book")
        self._replace(counts.select("term", "df", "book").unionByName(marks), "books")
        self._replace(sizes.select("documents", "tokens", "book"), "sizes")
        if len(self._numbers("change")) >= MANY_CHANGES:
            self.fold()

    def _replace(self, rows: DataFrame, name: str) -> None:
        """Only the folders of the books in ``rows`` are written anew; a large book's rows are split over tasks."""
        rows.hint("rebalance", "book").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(f"{self.root}/{name}")

    def fold(self) -> None:
        """Writes the sums of all changes as a base; the changes in it go."""
        numbers = self._numbers("change")
        if not numbers:
            return
        base, last = f"{self.root}/base-{numbers[-1]}", max(self._numbers("base"), default=None)
        self.terms().select("term", F.col("df").alias("delta")).write.mode("overwrite").parquet(f"{base}/terms")
        self.totals().select("documents", "tokens").write.mode("overwrite").parquet(f"{base}/totals")
        # the newest change stays: were its batch to come again, it must find its deltas
        for n in numbers[:-1]:
            remove(self.spark, f"{self.root}/change-{n}")
        if last is not None:
            remove(self.spark, f"{self.root}/base-{last}")

    def rebuilt(self) -> DataFrame:
        """term, df as the sum of all books' own counts: what ``terms`` must equal."""
        return self.books().groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def follow(chunks: DataFrame, stats: BookStats, checkpoint: str) -> None:
    """Applies a stream of whole books (book, text, gone) until its source has no more, a micro-batch at a time."""
    running = chunks.writeStream.foreachBatch(lambda rows, number: stats.apply(number, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
