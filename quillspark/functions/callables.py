"""What SQL calls by name: an embedder, searches as table functions, and a reranker over any table.

``register`` makes them for the tables of a session.  The embedder and the scorers of the reranker are given by name, so
that others take their place without a change to a query::

    select * from rerank(table(select * from sparse_search('red widget', 20)), 'red widget', 5, 'lexical')
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn
from pyspark.sql.types import DoubleType, StructType

from ..operators import index as I
from ..operators import retrieval as R
from .text import slot_of

#: Characters of a text that an embedder sees. Fixed value of the service.
EMBEDDED = 800


def lexical(query: str, text: str | None) -> float:
    """The share of the query's distinct words that the text holds."""
    words = lambda t: {w for w in re.split(r"[^\w]+|_", t.lower()) if w}
    asked = words(query)
    return round(len(asked & words(text or "")) / len(asked), 6) if asked else 0.0


#: The words of a query, as the index has them.
_WORDS = r"filter(split(lower(sparse_search.q), '[^\\p{L}\\p{Nd}]+'), x -> x <> '')"
#: Scorers of (query, text) by name.
SCORERS: dict[str, Callable[[str, str | None], float]] = {"lexical": lexical}


class Rerank:
    """(table with ``text``, query, keep, scorer): the ``keep`` rows of most relevance, with it, and a row's other columns as they came.

    Rows of one relevance keep their order of ``score``, then of the first column. A pool to be reranked is small; of a
    large one no more than ``keep`` rows are held.
    """

    def __init__(self):
        self.rows: list = []
        self.n = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, query: AnalyzeArgument, keep: AnalyzeArgument, scorer: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "text" not in rows.dataType.names:
            raise ValueError("rerank takes a table with a column text")
        if scorer.value not in SCORERS:
            raise ValueError(f"no scorer {scorer.value!r}; there are {', '.join(sorted(SCORERS))}")
        if keep.value is None or keep.value < 0:
            raise ValueError("rerank keeps a number of rows")
        order = [OrderingColumn("score", ascending=False)] if "score" in rows.dataType.names else []
        schema = StructType(list(rows.dataType.fields)).add("relevance", DoubleType())
        return AnalyzeResult(schema=schema, withSinglePartition=True, orderBy=[*order, OrderingColumn(rows.dataType.names[0])])

    def eval(self, row, query: str, keep: int, scorer: str):
        relevance = SCORERS[scorer](query, row["text"])
        self.n += 1
        heapq.heappush(self.rows, (relevance, -self.n, tuple(row)))
        if len(self.rows) > keep:
            heapq.heappop(self.rows)

    def terminate(self):
        for relevance, _, row in sorted(self.rows, reverse=True):
            yield (*row, relevance)


def register(spark: SparkSession, docs: DataFrame, vectors: DataFrame, embedder: Callable[[pd.Series], pd.Series], key: str = "doc_id", vector_key: str = "vec_id") -> None:
    """``embed_text(text)``, ``sparse_search(query, k)``, ``dense_search(vector, k)``, ``fused_hits(query, vector, k)`` and ``rerank``, in this session.

    The searches are SQL over the stored index and the vectors, so that a call is planned with the query around it.
    """
    embed = F.pandas_udf(embedder, "array<double>")
    spark.udf.register("embed_whole", embed)
    spark.sql(f"create or replace temporary function embed_text(t string) returns array<double> return embed_whole(substring(t, 1, {EMBEDDED}))")
    I.stored_index(docs, key).createOrReplaceTempView("quill_postings")
    vectors.createOrReplaceTempView("quill_vectors")
    spark.sql(f"""create or replace temporary function sparse_search(q string, k int) returns table ({key} bigint, score double) return
      with wanted as (select {slot_of('w')} as idx, count(*) as times from (select explode({_WORDS}) as w) group by 1),
      scores as (select p.{key}, round(sum(times * weight), 6) as score from quill_postings p join wanted using (idx) group by p.{key})
      select {key}, score from (select *, row_number() over (order by score desc, {key}) as place from scores) where place <= sparse_search.k""")
    cosine = "aggregate(zip_with(cast(embedding as array<double>), dense_search.v, (a, b) -> a * b), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(embedding, 0D, (s, x) -> s + cast(x as double) * x)) * sqrt(aggregate(dense_search.v, 0D, (s, x) -> s + x * x)), 0D)"
    spark.sql(f"""create or replace temporary function dense_search(v array<double>, k int) returns table ({vector_key} bigint, score double) return
      with scores as (select {vector_key}, round(coalesce({cosine}, 0D), 6) as score from quill_vectors)
      select {vector_key}, score from (select *, row_number() over (order by score desc, {vector_key}) as place from scores) where place <= dense_search.k""")
    spark.sql(f"""create or replace temporary function fused_hits(q string, v array<double>, k int) returns table ({key} bigint, score double) return
      with sparse as (select {key}, row_number() over (order by score desc, {key}) as r from sparse_search(fused_hits.q, fused_hits.k)),
      dense as (select {vector_key} as {key}, row_number() over (order by score desc, {vector_key}) as r from dense_search(fused_hits.v, fused_hits.k)),
      fused as (select {key}, round(sum(1D / ({R.RRF_K} + r)), 6) as score from (select * from sparse union all select * from dense) group by {key})
      select {key}, score from (select *, row_number() over (order by score desc, {key}) as place from fused) where place <= fused_hits.k""")
    spark.udtf.register("rerank", F.udtf(Rerank))
