"""Canonical documents: a file of JSON for each book, written whole or not at all.

The format ``canonical`` takes rows (slug, ordinal, record: JSON) and writes ``<slug>.json`` with the records of a slug in
order, as ``{"entities": [...]}``.  Tasks write to files of their own; only when all are done does the driver give them
their names, and a job that fails leaves the documents that were there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.index import folders

#: Where tasks write before a commit; names that begin so are no documents.
STAGING = ".staging-"


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class CanonicalWriter(DataSourceWriter):
    def __init__(self, path: str, key: str):
        self.path, self.job, self.key = path.rstrip("/"), uuid.uuid4().hex, key

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, rows: Iterator) -> Staged:
        """Rows come sorted by slug and ordinal: one document is open at a time, and no document is held."""
        system, folder = self._open()
        staging = f"{folder}/{STAGING}{self.job}"
        system.create_dir(staging, recursive=True)
        files: list[tuple[str, str]] = []
        out, now = None, None
        for row in rows:
            if row["slug"] != now:
                if out is not None:
                    out.write(b"]}")
                    out.close()
                now = row["slug"]
                if not now or now[0] in "._" or set(now) & set("/\\*?[]{}"):
                    raise ValueError(f"{now!r} names no document")
                files.append((f"{staging}/{uuid.uuid4().hex}", f"{folder}/{now}.json"))
                out = system.open_output_stream(files[-1][0])
                out.write(f"{{{json.dumps(self.key)}:[".encode())
            else:
                out.write(b",")
            json.loads(row["record"])  # what is no JSON ends the job, and with it nothing is changed
            out.write(row["record"].encode())
        if out is not None:
            out.write(b"]}")
            out.close()
        return Staged(files)

    def commit(self, messages: list[Staged]) -> None:
        system, folder = self._open()
        pairs = [pair for m in messages if m for pair in m.files]
        names = [name for _, name in pairs]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a slug's rows were in several tasks")
        for staged, name in pairs:
            system.move(staged, name)
        self._clear(system, folder)

    def abort(self, messages: list[Staged]) -> None:
        self._clear(*self._open())

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/{STAGING}{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{STAGING}{self.job}")


class Canonical(DataSource):
    @classmethod
    def name(cls) -> str:
        return "canonical"

    def schema(self) -> str:
        return "slug string, ordinal long, record string"

    def writer(self, schema, overwrite: bool) -> CanonicalWriter:
        return CanonicalWriter(self.options["path"], self.options.get("key", "entities"))


def write_documents(rows: DataFrame, path: str, key: str = "entities") -> None:
    """Writes the documents of (slug, ordinal, record), each an array under ``key``; documents of other slugs stay as they are."""
    rows.sparkSession.dataSource.register(Canonical)
    given = rows.select("slug", F.col("ordinal").cast("long").alias("ordinal"), "record")
    given.repartition("slug").sortWithinPartitions("slug", "ordinal").write.format("canonical").option("key", key).mode("append").save(path)


def read_documents(spark: SparkSession, path: str, slugs: list[str] | None = None) -> DataFrame:
    """slug, ordinal, record of the documents in a folder, or of some of them."""
    files = [f"{path}/{s}.json" for s in slugs] if slugs is not None else f"{path}/*.json"
    text = spark.read.text(files, wholetext=True).select(F.url_decode(F.replace(F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1), F.lit("+"), F.lit("%2B"))).alias("slug"), F.from_json("value", "entities array<string>").alias("d"))
    return text.select("slug", F.posexplode("d.entities").alias("ordinal", "record"))


def merge_shallow(record: F.Column, patch: F.Column) -> F.Column:
    """Both are JSON objects; a patch's fields take the place of the record's, or follow them. Values stay as they are written."""
    old, new = (F.from_json(c, "map<string,variant>") for c in (record, patch))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))


def patch_documents(spark: SparkSession, path: str, patches: DataFrame) -> None:
    """Patches (slug, id, patch: JSON object) merged into the records of that ``id``; only the documents they name are read and written."""
    slugs = [r["slug"] for r in patches.select("slug").distinct().collect()]  # names of the documents to be written anew
    if not slugs:
        return
    rows = read_documents(spark, path, slugs).withColumn("id", F.get_json_object("record", "$.id"))
    done = rows.join(patches, ["slug", "id"], "left").select("slug", "ordinal", F.coalesce(merge_shallow(F.col("record"), F.col("patch")), F.col("record")).alias("record"))
    write_documents(done, path)


def cached_documents(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """slug, ordinal, record and read_at (times that a document was read) of a folder's documents, of which only changed ones are read again.

    A document is known by the time and length of its file. What was read of it stands under ``cache``, in a folder of its
    slug; documents that are gone leave the result, and come back as changed ones.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]*)\.json$", 1), F.lit("+"), F.lit("%2B")))
    now = files.select(name.alias("slug"), F.col("modificationTime").alias("modified"), "length")  # contents are not asked for, so not read
    schema = "ordinal int, record string, modified timestamp, length long, read_at int, slug string"
    known = spark.read.schema(schema).parquet(cache) if folders(spark, cache) else spark.createDataFrame([], schema)
    before = known.groupBy("slug").agg(F.first("modified").alias("m"), F.first("length").alias("l"), F.max("read_at").alias("n"))
    stale = now.join(before, "slug", "left").where("m is null or m <> modified or l <> length").select("slug", "modified", "length", (F.coalesce("n", F.lit(0)) + 1).alias("read_at"))
    wanted = stale.collect()  # a row for each changed document
    if wanted:
        table = spark.createDataFrame(wanted, stale.schema)
        # a document without records is known by a row without one
        fresh = table.join(read_documents(spark, path, [r["slug"] for r in wanted]), "slug", "left").select("ordinal", "record", "modified", "length", "read_at", "slug")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(cache)
        known = spark.read.schema(schema).parquet(cache)
    return known.join(now.select("slug", "modified", "length"), ["slug", "modified", "length"], "left_semi").where("record is not null").select("slug", "ordinal", "record", "read_at")
