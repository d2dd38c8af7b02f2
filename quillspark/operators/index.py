"""A stored index of hashed-term weights, built once for a table and read by slot.

Postings are (idx, key, weight), in files by slot and sorted by slot and key, so that a query's few slots prune pages.
``stored_index`` finds the index of a table again by the names, sizes and times of its files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slot_number, slot_of, term_hash, tokens
from .retrieval import K1, B, spread

#: Texts counted at a time.
COUNTED = 64
#: Postings of a partition, about: what one task sums and sorts; and those beyond which a slot is dealt in pieces.
PARTITION_ENTRIES, PIECE_ENTRIES = 1_000_000, 125_000
#: Parts into which slots are dealt, for each partition: they even out how many a partition gets.
PARTS = 8
#: Terms that are sent to all tasks, some 20 MB.
TERMS_SENT = 200_000
_KNOWN: dict[tuple, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a session of one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return _KNOWN.setdefault(("root", spark.sparkContext.applicationId), tempfile.mkdtemp(prefix="quill-"))


def kept(rows: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = f"{shared_root(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) as (key, length, terms, tfs, slots): a text's words counted where it is read."""
    for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, b.num_rows, COUNTED)):
        counts = [Counter(words) for words in batch.column(1).to_pylist()]
        rows = [pa.array([c.total() for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), pa.array([list(map(slot_number, c)) for c in counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *rows], ["key", "length", "terms", "tfs", "slots"])


def build_index(docs: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Writes the weight of each slot of each document to ``folder``; colliding terms add.

    Words are counted within their text. Up to TERMS_SENT terms are sent to all tasks, and weights are shuffled; beyond
    that words are dealt by slot, once, to where the slot's terms come too and the postings stay: a slot of many texts in
    pieces, each with all the slot's terms.
    """
    words = spread(docs.select(F.col(key).alias("key"), "text")).select("key", tokens(F.col("text")).alias("w"))
    # each term's texts, and at the empty term the number of texts and of their words
    seen = words.select(F.size("w").alias("n"), F.explode(F.concat(F.array_distinct(F.coalesce("w", F.array().cast("array<string>"))), F.array(F.lit("")))).alias("term"))
    vocabulary = kept(seen.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("total")))
    stats = vocabulary.where("term = ''").first()
    entries, different = vocabulary.agg(F.coalesce(F.sum("df"), F.lit(0)), F.count("*")).first()
    partitions = entries // PARTITION_ENTRIES + 1
    many, avgdl = (stats["df"], (stats["total"] or 0) / stats["df"]) if stats else (0, 1.0)
    terms = vocabulary.where("term <> ''").select("term", "df", term_hash("term").alias("idx"), (F.log((F.lit(many) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(avgdl))))
    counted = words.where("w is not null").mapInArrow(_counted, f"key {dict(docs.dtypes)[key]}, length int, terms array<string>, tfs array<int>, slots array<long>")
    counts = counted.select("key", "length", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("slots").alias("idx"))))
    if different <= TERMS_SENT:
        weights = counts.drop("idx").join(F.broadcast(terms.drop("df")), "term").select("idx", "key", weight.alias("weight"))
        postings = weights.repartitionByRange(partitions, "idx", "key").groupBy("idx", "key").agg(F.sum("weight").alias("weight"))
    else:
        postings = _dealt(counts, terms, partitions).groupBy("part", "idx", "key").agg(F.sum(weight).alias("weight")).drop("part")
    postings.withColumnRenamed("key", key).sortWithinPartitions("idx", key).write.mode("overwrite").parquet(folder)


def _dealt(counts: DataFrame, terms: DataFrame, partitions: int) -> DataFrame:
    """``counts`` with their term's idf, those of a slot and a text in one partition: words and terms are shuffled together."""
    many = terms.groupBy("idx").agg(F.ceil(F.sum("df") / PIECE_ENTRIES).cast("int").alias("pieces")).where("pieces > 1").collect()  # of 30,000 slots
    pieces = F.broadcast(terms.sparkSession.createDataFrame(many, "idx long, pieces int"))
    part, most = F.pmod(F.hash("idx", "piece"), F.lit(PARTS * partitions)).alias("part"), F.coalesce("pieces", F.lit(1))
    words = counts.join(pieces, "idx", "left").withColumn("piece", F.pmod(F.hash("key"), most)).select(part, "term", "key", "length", "tf")
    known = terms.join(pieces, "idx", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), most - 1))).select(part, "term", "idx", "idf")
    term = Window.partitionBy("part", "term")
    dealt = words.unionByName(known, allowMissingColumns=True).repartition(partitions, "part")
    return dealt.withColumn("idx", F.max("idx").over(term)).withColumn("idf", F.max("idf").over(term)).where("tf is not null")


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether Spark has finished writing the folder."""
    system, path = _file_system(spark, f"{folder}/_SUCCESS")
    return system.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    system, path = _file_system(spark, folder)
    system.delete(path, True)


def folders(spark: SparkSession, parent: str) -> list[str]:
    """Names of what stands in a folder; none if it is not there."""
    system, path = _file_system(spark, parent)
    return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []


def identity(table: DataFrame) -> str:
    """A name made of the names, sizes and times of a table's files, which are listed a folder at a time; no row is read."""
    spark, files = table.sparkSession, table.inputFiles()
    mark = hashlib.sha256()
    for parent in sorted({f.rsplit("/", 1)[0] for f in files}):
        system, path = _file_system(spark, parent)
        for status in sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in system.listStatus(path)):
            mark.update(repr(status).encode())
    mark.update(repr(sorted(files)).encode())
    return mark.hexdigest()[:32]


def stored(table: DataFrame, kind: str, build: Callable[[str], None], last: str = "") -> str:
    """The folder that ``build`` writes for these very files, ``last`` being what it writes last.

    Written once under spark.checkpoint.dir and found again by name by any session.
    """
    spark = table.sparkSession
    folder = f"{shared_root(spark)}/{kind}-{identity(table)}"
    if not is_complete(spark, folder + last):
        build(folder)
    return folder


def stored_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The postings of a table read from files; built the first time that anyone asks for these very files."""
    return docs.sparkSession.read.parquet(stored(docs, f"index-{key}", lambda folder: build_index(docs, folder, key)))


def query_slots(spark: SparkSession, queries: dict[str, str]) -> dict[str, dict[int, int]]:
    """How often each query's words fall into each slot. A query is a line of text: one row answers for all, without a shuffle."""
    names = [f"q{i}" for i in range(len(queries))]
    words = spark.range(1).select(*[tokens(F.lit(text)).alias(name) for name, text in zip(names, queries.values(), strict=True)])
    row = words.select(*[F.expr(f"transform({name}, t -> {slot_of('t')})").alias(name) for name in names]).first()
    return {query: dict(Counter(row[name])) for query, name in zip(queries, names, strict=True)}


def search_index(postings: DataFrame, queries: dict[str, str], key: str = "doc_id") -> DataFrame:
    """query_id, key, score of the documents that share a slot with a query; only those slots are read.

    What a slot is worth to each query stands in the plan as a constant, so that a search is one scan and one sum.
    """
    wanted = query_slots(postings.sparkSession, queries)
    by_slot: dict[int, list] = {}
    for query, slots in wanted.items():
        for slot, times in slots.items():
            by_slot.setdefault(slot, []).append(F.struct(F.lit(query).alias("query_id"), F.lit(times).cast("long").alias("times")))
    if not by_slot:
        return postings.where("false").select(F.lit("").alias("query_id"), key, F.col("weight").alias("score"))
    asked = F.create_map(*[x for slot, asks in sorted(by_slot.items()) for x in (F.lit(slot).cast("long"), F.array(*asks))])
    held = postings.where(F.col("idx").isin(sorted(by_slot))).select(key, "weight", F.inline(F.element_at(asked, F.col("idx"))))
    return held.groupBy("query_id", key).agg(F.sum(F.col("times") * F.col("weight")).alias("score"))
