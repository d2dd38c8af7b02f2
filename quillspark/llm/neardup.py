"""Near-duplicate documents: banded MinHash candidates, odd-sketch screening, exact confirmation.

Documents are sets of distinct shingles of ``SHINGLE`` words, or of as many as
the caller says.  Equal sets collapse to one
class first.  Class representatives are cut into bands of MinHash values;
members of a band bucket are paired with one centre of the bucket (the member
whose buckets are fullest), never with each other, so a bucket of n makes n pairs.  Each pair is screened by the XOR
population count of two odd sketches, then confirmed on the full sets.
Components are found by alternating star contractions.  Buckets that still
hold documents of different components get other centres, a random one per
band; what is still apart after that is compared across components, screened
inside the join by size, odd sketch and the odd sketch of the whole set, so
that no link between two texts of a bucket is lost.  The last of these never
rejects a link: two sets' parity bitmaps differ in at most as many bits as the
sets differ in shingles.

A pair at the threshold is missed by all bands with probability
(1 - 0.8**ROWS)**BANDS = 2.5e-7, and screened out with about 1e-8.

Defined results: null and empty texts, and texts without words, have no
shingles and are components of their own; rows that share a doc_id count as
one document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, map_batches, scratch, table
from .idfilter import among, bitmap, without
from .textblock import SPACED, Block, blocks, mix, windows

SHINGLE = 5
#: The words of a shingle in op2's results.
QUERY_SHINGLE = 2
SIMILARITY_PERCENT = 80
BANDS, ROWS = 50, 6
SKETCH_BITS = 512
#: Bits of the odd sketch of a whole shingle set.
PARITY_BITS = 2048
#: XOR population count of two sketches that 300 samples at a similarity of 0.60 are expected to have.
MOST_ODD_BITS = 156
#: Rounds of random bucket centres before components are compared across.
CENTRE_ROUNDS = 1
#: Members of a bucket that one task compares with all others of it.
GRID_ROWS = 512
_NUMBERS = np.random.default_rng(20240501)
_FLIP = _NUMBERS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_TURN = (_NUMBERS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of each text's distinct shingles, by text, then hash."""
    starts, ends, owner = block.spans(SPACED)
    hashes = block.hashes(starts, ends)
    keys, at = windows(hashes, owner, k)
    whose = owner[at]
    words = block.counts(owner)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        firsts = np.searchsorted(owner, short)
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            more = words[short] > j
            whole[more] = mix(whole[more] * np.uint64(3) + hashes[firsts[more] + j])
        keys, whose = np.concatenate([keys, mix(whole)]), np.concatenate([whose, short])
    order = np.argsort(keys)
    order = order[np.argsort(whose[order].astype(np.uint16 if block.n < 1 << 16 else np.int64), kind="stable")]
    keys, whose = keys[order], whose[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])
    return keys[new], whose[new]


def signatures(keys: np.ndarray, whose: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts that have shingles: their index, band keys (texts x BANDS), odd sketches (texts x SKETCH_BITS/64)."""
    have, heads = np.unique(whose, return_index=True)
    if not len(have):
        return have, np.zeros((0, BANDS), dtype=np.int64), np.zeros((0, SKETCH_BITS // 64), dtype=np.int64)
    samples = np.empty((BANDS * ROWS, len(have)), dtype=np.uint32)
    folded = (keys >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(folded)
    for i in range(BANDS * ROWS):
        np.bitwise_xor(folded, _FLIP[i], out=work)
        np.multiply(work, _TURN[i], out=work)
        np.minimum.reduceat(work, heads, out=samples[i])
    wide = samples.astype(np.uint64)
    bands = np.empty((len(have), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(have), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[b * ROWS + r])
        bands[:, b] = key
    sketches = np.empty((len(have), SKETCH_BITS // 64), dtype=np.int64)
    index = (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32))[:, None]
    for low in range(0, len(have), 4096):
        part = wide[:, low : low + 4096]
        place = (mix(part + index) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(part.shape[1]) * SKETCH_BITS
        odd = (np.bincount(place.ravel(), minlength=part.shape[1] * SKETCH_BITS) & 1).astype(np.uint8)
        sketches[low : low + 4096] = np.packbits(odd.reshape(part.shape[1], SKETCH_BITS), axis=1).view(np.int64)
    return have, bands.view(np.int64), sketches


def parities(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Odd sketches of whole sets (texts x PARITY_BITS/64); ``keys[edges[i]:edges[i + 1]]`` is the set of text i."""
    n = len(edges) - 1
    out = np.zeros((n, PARITY_BITS // 64), dtype=np.int64)
    for low in range(0, n, 1024):
        high = min(n, low + 1024)
        part = keys[edges[low] : edges[high]]
        whose = np.repeat(np.arange(high - low), np.diff(edges[low : high + 1]))
        place = (part % np.uint64(PARITY_BITS)).astype(np.int64) + whose * PARITY_BITS
        odd = (np.bincount(place, minlength=(high - low) * PARITY_BITS) & 1).astype(np.uint8)
        out[low:high] = np.packbits(odd.reshape(high - low, PARITY_BITS), axis=1).view(np.int64)
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "digest", "bands", "sketch", "parity"]
    for batch in batches:
        for row, stop, block in blocks(batch.column(1), lower=True, most=1 << 19):
            keys, whose = shingle_sets(block, k)
            sizes = np.bincount(whose, minlength=block.n).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            raw, at = memoryview(np.ascontiguousarray(keys)).cast("B"), (8 * edges).tolist()
            # of the whole sorted set, so that equal digests are equal sets
            digests = pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:])], pa.binary())
            have, bands, sketches = signatures(keys, whose, block.n)
            every_band = np.zeros((block.n, BANDS), dtype=np.int64)
            every_sketch = np.zeros((block.n, SKETCH_BITS // 64), dtype=np.int64)
            every_band[have], every_sketch[have] = bands, sketches
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(sizes), digests, _lists(every_band), _lists(every_sketch), _lists(parities(keys, edges))], names)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, block in blocks(batch.column(1), lower=True, most=1 << 19):
            keys, whose = shingle_sets(block, k)
            edges = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=block.n))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), lists], ["id", "shingles"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the whole set, band keys, the odd sketches of the samples and of the set."""
    return map_batches(_texts(docs), partial(_signed, k=shingle), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, parity array<long>")


def odd_bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two odd sketches."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def _alike(left: str, right: str) -> Column:
    """Whether sizes and odd sketches allow the similarity."""
    a, b = F.col(f"n_{left}"), F.col(f"n_{right}")
    sizes = F.lit(100) * F.least(a, b) >= F.lit(SIMILARITY_PERCENT) * F.greatest(a, b)
    return sizes & (odd_bits(F.col(f"sketch_{left}"), F.col(f"sketch_{right}")) <= MOST_ODD_BITS)


def _may_link(left: str, right: str) -> Column:
    """False only where the sets differ in more shingles than linked sets can: sizes m and n allow (m + n) * (100 - s) / (100 + s)."""
    flips = F.zip_with(F.col(f"parity_{left}"), F.col(f"parity_{right}"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(flips, F.lit(0), lambda total, x: total + x)
    return F.lit(100 + SIMILARITY_PERCENT) * bits <= F.lit(100 - SIMILARITY_PERCENT) * (F.col(f"n_{left}") + F.col(f"n_{right}"))


def _named(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    return pairs.join(_named(sketches, "a"), "a").join(_named(sketches, "b"), "b").where(_alike("a", "b")).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; the sets of the documents concerned are built again."""
    near = keep_table(pairs.distinct())
    needed = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = bitmap(needed)
    texts = _texts(docs) if chosen is not None else _texts(docs).join(needed, F.col("doc_id") == F.col("id"), "left_semi")
    words = docs.sparkSession.sparkContext.broadcast(chosen)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # chosen and cut by one worker: two functions in a row would hold two workers a task
        return _sets((batch.filter(pa.array(among(batch.column(0), words.value))) for batch in batches), shingle)

    found = keep_table(map_batches(texts, sets, "id long, shingles array<long>"))
    joined = near.join(found.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(found.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    common = joined.withColumn("common", F.size(F.array_intersect("set_a", "set_b"))).withColumn("union", F.size("set_a") + F.size("set_b") - F.col("common"))
    return keep_table(common.where(F.lit(100) * F.col("common") >= F.lit(SIMILARITY_PERCENT) * F.col("union")).select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id of ``edges`` (a, b); root is the smallest id reachable.

    Large-star and small-star contractions alternate, each written to the shared folder, until nothing changes.
    """
    spark = edges.sparkSession
    now = keep_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = keep_table(small)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
    return keep_table(now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))


def _still_open(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """band, id, root of the bucket members of which some belong to different components."""
    now = keep_table(placed.select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")))
    mixed = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return keep_table(now.join(mixed, "band", "left_semi"))


def _joined_up(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges."""
    if not edges.take(1):
        return roots
    return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(edges))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with an equal set); one row per row of ``docs``."""
    signed = keep_table(document_signatures(docs, shingle))
    prints = ["digest", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*prints).agg(F.min("doc_id").alias("class_id"))
    members = keep_table(signed.select("doc_id", *prints).join(classes, prints, "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")))
    leaders = members.where("n_shingles > 0 and doc_id = class_id").select(F.col("doc_id").alias("id")).distinct()
    leading = keep_table(signed.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch", "parity").join(leaders, "id", "left_semi"))
    sketches = leading.select("id", "n_shingles", "sketch")

    bands = leading.select("id", F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # the centre of a bucket is its member whose buckets are fullest: the text that the others are copies of
    crowded = keep_table(bands.join(full, "band"))
    weight = crowded.groupBy("id").agg(F.sum("n").alias("weight"))
    centres = crowded.join(weight, "id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("least"))).alias("c")).select("band", (-F.col("c.least")).alias("centre"))
    pairs = crowded.join(centres, "band").where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    roots = components(_confirmed(_screened(pairs, sketches), docs, shingle))

    placed = crowded.select("band", "id")
    for turn in range(CENTRE_ROUNDS):
        placed = _still_open(placed, roots)
        chosen = placed.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", "band", F.lit(turn)).alias("h"), "id", "root")).alias("c")).select("band", F.col("c.id").alias("centre"), F.col("c.root").alias("centre_root"))
        pairs = placed.join(chosen, "band").where("root <> centre_root").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        roots = _joined_up(roots, _confirmed(_screened(pairs, sketches), docs, shingle))
    rest = _still_open(placed, roots)
    shared = rest.groupBy("id").agg(F.collect_set("band").alias("shared"))  # BANDS entries at most
    wide = rest.join(shared.join(leading.select("id", "n_shingles", "sketch", "parity"), "id"), "id")
    columns = {"id": "", "root": "root_", "n_shingles": "n_", "sketch": "sketch_", "parity": "parity_", "shared": "shared_"}
    left, right = (wide.select("band", *(F.col(c).alias(f"{head}{x}") for c, head in columns.items())) for x in ("a", "b"))
    # members of a large bucket meet in a grid of tasks: a row on the left in one, on the right in all
    grid = rest.groupBy("band").agg(F.ceil(F.count("*") / GRID_ROWS).cast("int").alias("cells"))
    left = left.join(grid, "band").withColumn("cell", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int")).drop("cells")
    right = right.join(grid, "band").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    # a pair that shares several buckets is taken in one of them
    once = left["band"] == F.array_min(F.array_intersect("shared_a", "shared_b"))
    across = left.join(right, (left["band"] == right["band"]) & (left["cell"] == right["cell"]) & (F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b")) & _alike("a", "b") & _may_link("a", "b") & once)
    roots = _joined_up(roots, _confirmed(across.select("a", "b"), docs, shingle))

    found = members.join(roots, F.col("class_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("root", "class_id"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a smaller-numbered near duplicate."""
    with scratch(docs.sparkSession) as spare:
        gone = spare(keep_table(near_duplicates(docs).where("not kept").select("doc_id").distinct()))
    return without(docs, "doc_id", gone)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as spare:
        return spare(keep_table(near_duplicates(table(spark, sf_dir, "documents"), QUERY_SHINGLE)))
