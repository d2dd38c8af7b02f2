"""A bitmap of ids, sized by their number up to a bound.

It spares shuffles of texts: rows whose bit is unset are surely not among the
ids, the few others are joined exactly.  For more ids than the bound suits there
is no bitmap, and all rows are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .textblock import mix

#: Bits of a bitmap for each id, and of the smallest and the largest bitmap (32 MB to each worker, 2**22 rows to the driver).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
_SALT = np.uint64(0x5851F42D4C957F2D)


def _places(ids: pa.Array, bits: int) -> np.ndarray:
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mix(values + _SALT) % np.uint64(bits)).astype(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray | None:
    """The bitmap of a one-column table of long ids, or-ed together by Spark; None for more ids than it suits."""
    count = ids.count()
    if count * BITS_EACH > 4 * MOST_BITS:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, count * BITS_EACH) - 1).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    rows = map_batches(ids, slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def among(ids: pa.Array, words: np.ndarray | None) -> np.ndarray:
    """Whether each id may be among those of the bitmap; all may without one."""
    if words is None:
        return np.ones(len(ids), dtype=bool)
    at = _places(ids, 64 * len(words))
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def maybe_among(docs: DataFrame, column: str, words, wanted: bool = True) -> DataFrame:
    """The rows of ``docs`` that may (or surely do not) have an id of the broadcast bitmap."""
    place = docs.columns.index(column)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(batch.column(place).cast(pa.int64()), words.value) == wanted))

    return map_batches(docs, chosen, docs.schema)


def without(docs: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one long column); only rows that may be are shuffled."""
    found = bitmap(ids)
    gone = ids.toDF("gone_id")
    if found is None:
        return docs.join(gone, docs[column].cast("long") == gone["gone_id"], "left_anti")
    words = docs.sparkSession.sparkContext.broadcast(found)
    maybe = maybe_among(docs, column, words)
    stay = maybe.join(gone, maybe[column].cast("long") == gone["gone_id"], "left_anti")
    return maybe_among(docs, column, words, wanted=False).unionByName(stay)
