"""Ranked lexical search: exact top-k from dual-sorted wavelet trees.

Documents are dealt into shards.  A shard numbers its documents in ascending
doc_id and lays the postings of all terms end to end, each term's by descending
impact: that sequence of document numbers is kept as a wavelet tree, level by
level, one bit for each posting and level.  As the tree splits stably, a term's
range in any node is still ordered by impact, so the range's first posting bounds
what the term can add to any document of the node.  Impacts need the number and
the mean length of all documents, but no term's frequency, so an index serves any
query.

A query walks all its terms' ranges down together.  Nodes are taken best bound
first, many at a time; a leaf is one document with its exact score.  A node that
cannot reach the k-th score so far, or only with larger doc_ids, is left out.  A
task carries its k best over from shard to shard, and Spark takes the k best of
all tasks' lists.  Queries go in blocks of bounded size, each against all shards.

Defined results: a null text has no terms; an item without terms, or whose terms
no document holds, gives no rows; rows without doc_id count and rank after equal
scores with one; repeated rows rank each; equal items count once, several texts
under one item_id are ranked each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_table, map_batches, scratch, table
from .textblock import ALNUM, blocks, text_array, words

#: Documents returned for an item.
TOP = 10
#: Text and documents of a shard at most (one longer text is a shard), shards of a file, and text of a block of queries.
SHARD_BYTES, SHARD_DOCS, SHARDS_A_FILE, QUERY_BYTES = 12 << 20, 1 << 16, 8, 4 << 20
#: Nodes taken from the frontier at a time.
WAVE = 256

_NO_ID = np.iinfo(np.int64).max
_SHARD = "ids array<bigint>, terms array<string>, starts binary, levels int, bits binary, impacts binary"


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            for _, _, block in blocks(batch.column(0), lower=True):
                counts = block.counts(block.spans(ALNUM)[2])
                n, length = n + int((counts > 0).sum()), length + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["n", "length"])

    row = map_batches(docs.select("text"), totals, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return row[0] or 0, row[1] or 0


def build_shard(ids: pa.Array, texts: pa.Array, n_docs: int, all_terms: int) -> pa.RecordBatch | None:
    """The row of a shard; None if no text has a term. n_docs and all_terms are the whole table's."""
    _, _, block = next(blocks(texts, lower=True, most=1 << 62))
    found, owner = words(block, ALNUM)
    if not len(found):
        return None
    lengths = block.counts(owner)
    have = np.flatnonzero(lengths)
    keys = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)[have]
    by_id = np.lexsort((have, np.asarray(ids.is_null())[have], keys))
    have = have[by_id]
    local = np.full(len(lengths), -1)
    local[have] = np.arange(len(have))

    coded = found.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    pair, tf = np.unique(rank[coded.indices.to_numpy()] * len(have) + local[owner], return_counts=True)
    term, doc = np.divmod(pair, len(have))
    m = np.array([10 + 90 * int(x) * n_docs // all_terms for x in lengths[have]], dtype=np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    by_impact = np.lexsort((doc, -impact, term))
    doc, impact = doc[by_impact], impact[by_impact].astype(np.uint32)
    starts = np.searchsorted(term, np.arange(len(order) + 1)).astype(np.int64)

    levels = max(1, int(len(have) - 1).bit_length())
    at, bits = doc, []
    for level in range(levels):
        bits.append(np.packbits((at >> (levels - 1 - level) & 1).astype(bool)))
        at = doc[np.argsort(doc >> (levels - 1 - level), kind="stable")]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids.take(pa.array(have)).to_pylist()], pa.list_(pa.int64())), pa.array([coded.dictionary.take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
         pa.array([starts.tobytes()]), pa.array([levels], pa.int32()), pa.array([np.concatenate(bits).tobytes()]), pa.array([impact.tobytes()])],
        ["ids", "terms", "starts", "levels", "bits", "impacts"],
    )


class Shard:
    """A shard's tree with, for each level, zeros before each place and the impacts in the level's order."""

    def __init__(self, row: dict, top: int = TOP):
        ids = row["ids"].values if isinstance(row["ids"], pa.ListScalar) else row["ids"]
        self.ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.levels, self.top = row["levels"], top
        self.starts = np.frombuffer(row["starts"], dtype=np.int64)
        first = np.frombuffer(row["impacts"], dtype=np.uint32)
        n, depth = len(first), self.levels
        packed = np.frombuffer(row["bits"], dtype=np.uint8).reshape(depth, -1)
        self.zeros = np.zeros((depth, n + 1), dtype=np.int32)
        self.impacts = np.empty((depth + 1, n), dtype=np.uint32)
        self.impacts[0] = first
        prefix = np.zeros(n, dtype=np.uint16 if depth <= 16 else np.int64)
        for level in range(depth):
            bit = np.unpackbits(packed[level], count=n)
            np.cumsum(bit == 0, dtype=np.int32, out=self.zeros[level, 1:])
            prefix = prefix * 2 + bit
            order = np.argsort(prefix, kind="stable")
            prefix = prefix[order]
            self.impacts[level + 1] = self.impacts[level][order]
        #: postings of documents before each; a node's place on every level
        self.before = np.zeros((1 << depth) + 1, dtype=np.int64)
        np.cumsum(np.bincount(prefix, minlength=1 << depth), out=self.before[1:])

    def best(self, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` best (scores, ids), best first, of those given and this shard's documents."""
        depth, weights = self.levels, weights.astype(np.int64)
        level, node = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        low, high = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        bound = (self.impacts[0][low].astype(np.int64) * weights).sum(axis=1)
        while len(bound):
            if len(scores) == self.top:
                least = self.ids[np.minimum(node << (depth - level), len(self.ids) - 1)]
                hope = (bound > scores[-1]) | ((bound == scores[-1]) & (least < ids[-1]))
                level, node, low, high, bound = level[hope], node[hope], low[hope], high[hope], bound[hope]
            if len(bound) > WAVE:
                picked = np.zeros(len(bound), dtype=bool)
                picked[np.argpartition(bound, len(bound) - WAVE)[len(bound) - WAVE :]] = True
            else:
                picked = np.ones(len(bound), dtype=bool)
            taken = [x[picked] for x in (level, node, low, high)]
            rest = [x[~picked] for x in (level, node, low, high, bound)]
            lv, nd, lo, hi = taken
            # both children of each node
            start = self.before[nd << (depth - lv)][:, None]
            middle = self.before[(2 * nd + 1) << (depth - lv - 1)][:, None]
            at = self.zeros[lv, start[:, 0]][:, None]
            zlo, zhi = self.zeros[lv[:, None], lo] - at, self.zeros[lv[:, None], hi] - at
            lo2 = np.concatenate([start + zlo, middle + (lo - start - zlo)])
            hi2 = np.concatenate([start + zhi, middle + (hi - start - zhi)])
            lv2, nd2 = np.concatenate([lv, lv]) + 1, np.concatenate([2 * nd, 2 * nd + 1])
            held = hi2 > lo2
            first = self.impacts[lv2[:, None], np.minimum(lo2, self.impacts.shape[1] - 1)].astype(np.int64)
            bound2 = (np.where(held, first, 0) * weights).sum(axis=1)
            leaf = (lv2 == depth) & (bound2 > 0)
            if leaf.any():
                scores, ids = np.concatenate([scores, bound2[leaf]]), np.concatenate([ids, self.ids[nd2[leaf]]])
                best = np.lexsort((ids, -scores))[: self.top]
                scores, ids = scores[best], ids[best]
            on = (lv2 < depth) & (bound2 > 0)
            level, node, low, high, bound = (np.concatenate([a, b[on]]) for a, b in zip(rest, (lv2, nd2, lo2, hi2, bound2), strict=True))
        return scores, ids


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int, int]:
    """The kept table of shards over all rows, and the two numbers of ``_sizes``."""
    n_docs, all_terms = _sizes(docs)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, texts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in rows.columns)
            if (row := build_shard(ids.cast(pa.int64()), text_array(texts), n_docs, all_terms)) is not None:
                yield row

        for batch in batches:
            for i in range(0, batch.num_rows, shard_docs):
                piece = batch.slice(i, shard_docs)
                if held and (sum(x.num_rows for x in held) + piece.num_rows > shard_docs or sum(x.nbytes for x in held) + piece.nbytes > shard_bytes):
                    yield from flush()
                held.append(piece)
        if held:
            yield from flush()

    return keep_table(map_batches(docs.select("doc_id", "text"), shards, _SHARD), maxRecordsPerFile=str(SHARDS_A_FILE)), n_docs, all_terms


def _queries(items: pa.Table) -> tuple[list, list[np.ndarray], pa.Array]:
    """Item ids, the distinct terms of each by number, and all distinct terms."""
    texts = text_array(items.column("text"))
    parts, owners = [], []
    for row, _, block in blocks(texts, lower=True):
        found, owner = words(block, ALNUM)
        parts.append(found)
        owners.append(owner + row)
    coded = pa.concat_arrays([pa.array([], pa.large_string()), *parts]).dictionary_encode()
    owner = np.concatenate([np.zeros(0, np.int64), *owners])
    codes = coded.indices.to_numpy()
    return items.column("item_id").to_pylist(), [np.unique(codes[owner == i]) for i in range(len(texts))], coded.dictionary


def _frequencies(shards: DataFrame, terms: pa.Array) -> np.ndarray:
    """How many documents hold each term."""
    wanted = shards.sparkSession.sparkContext.broadcast(terms)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), dtype=np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1), strict=True):
                at = pc.index_in(wanted.value, own.values.cast(pa.large_string())).fill_null(-1).to_numpy()
                total += np.where(at >= 0, np.diff(np.frombuffer(starts.as_py(), dtype=np.int64))[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    rows = map_batches(shards.select("terms", "starts"), held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), dtype=np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _searched(shards: DataFrame, n_docs: int, items: pa.Table, block: int, top: int) -> DataFrame:
    ids, asked, terms = _queries(items)
    df = _frequencies(shards, terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    sent = shards.sparkSession.sparkContext.broadcast((ids, [q[(weights[q] > 0) & (df[q] > 0)] for q in asked], terms, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, terms, weights = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("ids", "terms")} | {name: batch.column(name)[i].as_py() for name in ("starts", "levels", "bits", "impacts")}
                shard = Shard(row, top)
                at = pc.index_in(terms, row["terms"].values.cast(pa.large_string())).fill_null(-1).to_numpy()
                for q, own in enumerate(asked):
                    own = own[at[own] >= 0]
                    if len(own):
                        best[q] = shard.best(at[own].astype(np.int64), weights[own], *best[q])
        q = np.repeat(np.arange(len(ids)), [len(x[0]) for x in best])
        found = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block, pa.int32()), len(q)), pa.array(q, pa.int32()), pa.array([ids[i] for i in q], pa.int64()), pa.array(found, pa.int64(), mask=found == _NO_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[0] for x in best)]))],
            ["block", "query", "item_id", "doc_id", "score"],
        )

    return map_batches(shards, search, "block int, query int, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item."""
    shards, n_docs, _ = index(docs, shard_bytes, shard_docs)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n_blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    found = None
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).toArrow()
        part = _searched(shards, n_docs, own, block, top)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as spare:
        return spare(keep_table(ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))))


def oracle() -> str:
    """DuckDB SQL for op11: the sum over all postings of each item's terms."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""
    with asked as (select distinct item_id, unnest(regexp_extract_all({low}, '{term}')) as term from benchmark),
    docs as (select doc_id, regexp_extract_all({low}, '{term}') as terms from documents),
    sizes as (select count(*)::bigint as big_n, sum(len(terms))::bigint as big_l from docs where len(terms) > 0),
    postings as (select doc_id, len(terms)::bigint as n, term, count(*)::bigint as tf from (select doc_id, terms, unnest(terms) as term from docs) where term in (select term from asked) group by doc_id, terms, term),
    weights as (select term, floor(1000 * ln((2 * max(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, sizes group by term),
    scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint as score
      from asked join postings using (term) join weights using (term), sizes group by 1, 2),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
    select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP}"""
