"""What the operators share: input tables, the shared folder, files in it."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch between an executor and its worker: texts are long, and both sides hold whole batches.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    Only a session of one process (tests) may be without that setting; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN_ROOTS.setdefault(context.applicationId, os.environ.get("QUILL_TEST_SHARED") or tempfile.mkdtemp(prefix="quill-shared-"))
    return f"{root.rstrip('/')}/quill-{uuid.uuid4().hex}"


#: Folders that keep_table has written, by who is to delete them; the innermost last.
_WRITTEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that were kept within it, but for those given to what it yields.

    What is to outlive it must have been kept itself: a table that is still to be computed would miss what it reads.
    """
    written: list[str] = []
    spared: set[str] = set()

    def spare(df: DataFrame) -> DataFrame:
        spared.update(f.rsplit("/", 1)[0] for f in df.inputFiles())
        return df

    _WRITTEN.append(written)
    try:
        yield spare
    finally:
        _WRITTEN.remove(written)
        names = {s.rsplit("/", 1)[-1] for s in spared}
        jvm = spark.sparkContext._jvm
        for folder in written:
            if folder.rsplit("/", 1)[-1] in names:
                if _WRITTEN:
                    _WRITTEN[-1].append(folder)
                continue
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """Hands memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call keeps it
        ctypes.CDLL(None).malloc_trim(0)


def frees_memory(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches whose worker, which Spark keeps for later tasks, gives memory back when a task ends."""

    def ends_lean(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return ends_lean


def map_batches(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_BYTES, or one longer row; workers give memory back when a task ends.

    Spark takes the bound from the session when the plan runs, so the session keeps it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(frees_memory(function), schema)


def keep_table(df: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.options(**options).mode("overwrite").parquet(path)
    if _WRITTEN and folder is None:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The mounted path of a file: URI, or None when only a file system client reaches it."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def open_output(uri: str):
    """A binary stream into a new file of the shared folder. Attempts of a task write to a name of their own, then rename."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def open_input(uri: str):
    """A seekable binary stream from a file of the shared folder."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)
