"""Searches composed of filters, dense and sparse rankings, fusion, collapse and reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import retrieval as R
from .index import search_index

# The service's limits and thresholds.
MAX_TOP_K, POOL, LEAST_SCORE = 20, 20, 0.5
LIST_DEFAULT, LIST_MOST = 50, 200
# What makes the better of two records.
BOOK_RANK = {"Core": 4, "Supplement": 3, "Adventure": 2, "Setting": 1}
AUTHORITATIVE = ("5etools-backfill", "hand-authored")


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def block_filter(version=None, category=None, source_book=None, source_keys=None, entity_name=None, book_type=None) -> Column:
    """Rows that meet all that is asked for; blank or missing wishes ask for nothing, one of ``source_keys`` suffices."""
    wishes = {"version": version, "category": category, "source_book": source_book, "entity_name": entity_name, "book_type": book_type}
    equal = [F.col(c) == v for c, v in wishes.items() if v is not None and str(v).strip()]
    keys = [k for k in source_keys or [] if k and k.strip()]
    return all_of(equal + ([F.col("source_key").isin(keys)] if keys else []))


def entity_filter(
    type=None, source_book=None, edition=None, book_type=None, setting_tag=None, keyword=None, damage_type=None, spell_level=None,
    cr_lte=None, cr_gte=None, srd=None, srd52=None, basic_rules=None,
) -> Column:
    """As ``block_filter``; a range of challenge fails rows without one, and the flags ask for something only when true."""
    equal = {"type": type, "source_book": source_book, "edition": edition, "book_type": book_type, "spell_level": spell_level}
    held = {"setting_tags": setting_tag, "keywords": keyword, "damage_types": damage_type}
    flags = {"srd": srd, "srd52": srd52, "basic_rules": basic_rules}
    out = [F.col(c) == v for c, v in equal.items() if v is not None and v != ""]
    out += [F.array_contains(c, v) for c, v in held.items() if v]
    out += [F.col("cr_numeric") <= cr_lte] if cr_lte is not None else []
    out += [F.col("cr_numeric") >= cr_gte] if cr_gte is not None else []
    return all_of(out + [F.col(c) for c, v in flags.items() if v])


def lenient(value: Column, known: list[str], exact: bool = False) -> Column:
    """The known spelling of a wish; null, which asks for nothing, for any other."""
    if exact:
        return F.when(value.isin(known), value)
    table = F.create_map(*[F.lit(x) for k in known for x in (k.lower(), k)])
    return F.try_element_at(table, F.lower(F.trim(value)))


def page_window(rows: DataFrame, book: str, page: int, around: int = 2) -> DataFrame:
    return rows.where((F.col("source_book") == book) & F.col("page").between(page - around, page + around))


@dataclass
class Options:
    rerank: bool = True
    rerank_blocks: bool = True
    rerank_entities: bool = True
    hybrid_alpha: float = 0.5
    max_top_k: int = MAX_TOP_K
    pool: int = POOL
    least_score: float = LEAST_SCORE

    def hybrid(self, sparse_stored: bool) -> bool:
        """Sparse ranks take part if asked for at all and stored; how much is asked for plays no part."""
        return self.hybrid_alpha > 0 and sparse_stored

    def limit(self, top_k: int, rerank: bool) -> int:
        return min(self.max_top_k, self.pool) if rerank else min(top_k, self.max_top_k)


def _hits(blocks: DataFrame, where: Column, query: str, vector: list[float], postings: DataFrame | None, limit: int, options: Options) -> DataFrame:
    """doc_id, score of the filtered blocks: both rankings cut at ``limit`` and fused, or the dense one over the least score."""
    kept = blocks.where(where)
    dense = R.nearest(kept.where("embedding is not null").select("doc_id", "embedding"), vector).select("doc_id", "score")
    if not options.hybrid(postings is not None):
        return R.top(dense.where(F.col("score") >= options.least_score), limit, "doc_id")
    sparse = search_index(postings, {"q": query}).join(kept.select("doc_id"), "doc_id", "left_semi").withColumn("score", F.round("score", 6))
    fused = R.rrf(R.ranked(dense, "doc_id", limit), R.ranked(sparse.select("doc_id", "score"), "doc_id", limit), "doc_id")
    return R.top(fused, limit, "doc_id").select("doc_id", "score")


def prose_search(blocks: DataFrame, query: str, vector: list[float], postings: DataFrame | None, where: Column | None = None, top_k: int = 5, options: Options | None = None, diagnostic: bool = False) -> DataFrame:
    """doc_id, score, text: the best blocks; reranked unless switched off or diagnostic. Rows keep the score they were found with."""
    options = options or Options()
    rerank = options.rerank and options.rerank_blocks and not diagnostic
    where = F.lit(True) if where is None else where
    hits = _hits(blocks, where, query, vector, postings, options.limit(top_k, rerank), options).join(blocks.select("doc_id", "text"), "doc_id")
    top_k = min(top_k, options.max_top_k)
    return R.lexical_rerank(hits, query, top_k, "doc_id").drop("relevance") if rerank else R.top(hits, top_k, "doc_id")


def entity_search(entities: DataFrame, query: str, vector: list[float], where: Column, top_k: int = 0, options: Options | None = None) -> DataFrame:
    """id, score, text and the other columns of the nearest records that meet the filter; no threshold, ten by default."""
    options = options or Options()
    top_k = min(top_k if top_k > 0 else 10, options.max_top_k)
    rerank = options.rerank and options.rerank_entities
    hits = R.top(R.nearest(entities.where(where), vector), options.limit(top_k, rerank), "id").drop("embedding")
    return R.lexical_rerank(hits, query, top_k, "id").drop("relevance") if rerank else hits


def listed(rows: DataFrame, where: Column, cap: int = 0) -> DataFrame:
    """The filter's rows by id with their exact total: 50 by default, 200 at most."""
    return R.page(rows.where(where), ["id"], max(1, min(LIST_MOST, cap if cap > 0 else LIST_DEFAULT)))


def authority(book_type: str = "book_type", source: str = "data_source", review: str = "needs_review", text: str = "text", key: str = "id") -> list[Column]:
    """The order of equal records: book, source, not under review, longest text, smallest id."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BOOK_RANK.items() for x in pair]), F.col(book_type)), F.lit(0))
    return [F.desc(rank), F.desc(F.lower(source).isin(*AUTHORITATIVE).cast("int")), F.col(review).cast("int").asc(), F.desc(F.length(text)), F.col(key)]


def collapsed(hits: DataFrame, key: list[str], order: list[Column], place: str) -> DataFrame:
    """One hit for each key: the winner, with the best score of its group, at the place of the group's first."""
    group = Window.partitionBy(*key)
    rows = hits.withColumn("score", F.max("score").over(group)).withColumn(place, F.min(place).over(group)).withColumn("_turn", F.row_number().over(group.orderBy(*order)))
    return rows.where("_turn = 1").drop("_turn")


def duplicate_groups(rows: DataFrame, key: list[str], order: list[Column], name: str = "id") -> DataFrame:
    """key, n, winner and losers (in order) of keys that two rows or more have."""
    placed = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_turn", name))), lambda x: x[name])
    return placed.groupBy(*key).agg(F.count("*").alias("n"), ids.alias("ids")).where("n >= 2").select(*key, "n", F.col("ids")[0].alias("winner"), F.slice("ids", 2, F.size("ids")).alias("losers"))


def fused_search(prose: DataFrame, entities: DataFrame, query: str, top_k: int = 0, options: Options | None = None) -> DataFrame:
    """Prose and entity candidates (channel, id, text, score, place), prose first, reranked together; in that order where neither channel is reranked."""
    options = options or Options()
    top_k = min(top_k if top_k > 0 else 5, options.max_top_k)
    both = prose.withColumn("lead", F.lit(0)).unionByName(entities.withColumn("lead", F.lit(1)))
    if options.rerank and (options.rerank_blocks or options.rerank_entities):
        words = F.array_distinct(R.tokens(F.lit(query)))
        share = F.round(F.size(F.array_intersect(F.array_distinct(R.tokens(F.col("text"))), words)) / F.size(words), 6)
        return both.withColumn("relevance", share).orderBy(F.desc("relevance"), "lead", "place").limit(top_k).drop("relevance", "lead", "place")
    return both.orderBy("lead", "place").limit(top_k).drop("lead", "place")


def quantised_nearest(vectors: DataFrame, query: list[float], k: int, oversampling: float = 2.0, quantile: float = 0.99) -> DataFrame:
    """The nearest k by vectors of eight bits first, oversampled, then by the whole ones: the same k as by those alone.

    What the eight bits leave out of a vector bounds its score. The k-th score of the oversampled pool is the bar; any
    other vector whose bound reaches the bar is ranked as well.
    """
    edge = vectors.select(F.percentile_approx(F.array_max(F.transform("embedding", F.abs)), quantile, 10_000).alias("edge")).first()["edge"] or 1.0
    q = np.array(query, dtype=np.float64)
    size = float(np.sqrt((q * q).sum()))
    unit = q / size if size > 0 else q

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding")
            coarse, most = np.zeros(len(rows)), np.full(len(rows), np.inf)  # vectors of another length, or none, are ranked whole
            fit = np.flatnonzero(pc.equal(pc.list_value_length(rows), len(unit)).fill_null(False).to_numpy(zero_copy_only=False)) if len(unit) else np.zeros(0, dtype=np.int64)
            for at in range(0, len(fit), 4096):
                here = fit[at : at + 4096]
                whole = pc.list_flatten(rows.take(pa.array(here))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(here), -1)
                small = np.clip(np.rint(whole / edge * 127), -127, 127) * (edge / 127)
                lengths = np.sqrt((whole * whole).sum(axis=1))
                lengths[lengths == 0] = np.inf
                coarse[here] = small @ unit / lengths
                most[here] = coarse[here] + np.sqrt(((whole - small) ** 2).sum(axis=1)) / lengths
            yield batch.append_column("coarse", pa.array(coarse)).append_column("most", pa.array(most))

    bounded = vectors.mapInArrow(bounds, StructType([*vectors.schema.fields, StructField("coarse", DoubleType()), StructField("most", DoubleType())]))
    pool = bounded.orderBy(F.desc("coarse"), "vec_id").limit(int(k * oversampling)).drop("coarse", "most")
    first = R.top(R.nearest(pool, query), k, "vec_id").select("score").collect()
    # scores are rounded to six digits
    bar = first[-1]["score"] - 1e-6 if len(first) == k else float("-inf")
    return R.top(R.nearest(bounded.where(F.col("most") >= bar).drop("coarse", "most"), query), k, "vec_id")


def routed_turns(turns: DataFrame, groups: dict[str, str], centroids: DataFrame, floor: float = 0.45) -> DataFrame:
    """turns (with text and embedding) and their route: the one group whose signal they give, else the nearest centroid over the floor, else all."""
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(g)) for g, p in groups.items()]), lambda x: x.isNotNull())
    near = turns.crossJoin(R.small(centroids)).withColumn("similarity", F.round(R.cosine(F.col("embedding"), F.col("centroid")), 6))
    best = near.groupBy(*turns.columns).agg(F.max(F.struct("similarity", (-F.col("label")).alias("least"))).alias("b"))
    return best.withColumn("route", F.when(F.size(hits) == 1, hits[0]).when(F.col("b.similarity") >= floor, (-F.col("b.least")).cast("string")).otherwise("all")).drop("b")
