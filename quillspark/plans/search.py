"""Queries of the retrieval layer, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import snippet, term_hash, tokens
from ..operators import index as I
from ..operators import retrieval as R
from ..sources.tables import table

QUERY = "the that were and Erst"
_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
_HASH = """(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode(term))+1), lambda i: ('0x'||substr(hex(encode(term)),(2*i-1)::BIGINT,2))::BIGINT)), lambda a,b: (xor(a,b)*16777619) % 4294967296) % 30000)::bigint"""
_BM25 = f"""
  tok as (select doc_id, {_TOK} as w from documents),
  st as (select count(*) as n, sum(len(w)) as t from tok),
  tf as (select doc_id, term, count(*) as tf, any_value(l) as l from (select doc_id, len(w) as l, unnest(w) as term from tok) group by 1, 2),
  df as (select term, count(*) as df from tf group by 1),
  q as (select {_HASH} as idx, count(*) as weight from (select unnest({_TOK.replace("text", f"'{QUERY}'")}) as term) group by 1),
  th as (select term, df, {_HASH} as idx from df),
  bm as (select doc_id, sum(q.weight * (ln((n+1)/(df+1)) + 1) * (tf*2.5 / (tf + 1.5*(0.25 + 0.75*l/(t/n))))) as raw
         from tf join th using (term) join q using (idx), st group by 1)"""
_COS = "list_sum(list_transform(list_zip(e, v), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(e, lambda x: x::double*x::double))) * sqrt(list_sum(list_transform(v, lambda x: x::double*x::double))))"
_KNN = f"""
  qv as (select embedding as v from embeddings where vec_id = 0),
  kn as (select vec_id, label, round(coalesce({_COS}, 0), 6) as score from (select vec_id, label, embedding as e, v from embeddings, qv))"""


def _docs(spark, d):
    return table(spark, d, "documents")


def _bm25(spark, d):
    """Scores from the stored index, as the searches of a service read them."""
    return I.search_index(I.stored_index(_docs(spark, d)), {"q": QUERY}).select("doc_id", F.round("score", 6).alias("score"))


def _first_vector(spark, d):
    rows = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").take(1)
    return rows[0][0] if rows else []


def _knn(spark, d):
    return R.nearest(table(spark, d, "embeddings"), _first_vector(spark, d)).select("vec_id", "label", "score")


def bm25_topk(spark, d):
    return R.top(_bm25(spark, d), 10, "doc_id").select("doc_id", "score")


def hybrid_rrf(spark, d):
    """Dense and sparse rank lists of the same ids, each cut at 20, fused; vectors stand for the documents of their number."""
    dense = R.ranked(_knn(spark, d).withColumnRenamed("vec_id", "doc_id"), "doc_id", 20)
    sparse = R.ranked(_bm25(spark, d), "doc_id", 20)
    return R.top(R.rrf(dense, sparse, "doc_id"), 20, "doc_id").select("doc_id", "score")


def rerank_keep_score(spark, d):
    pool = R.top(_bm25(spark, d), 20, "doc_id").join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return R.lexical_rerank(pool, QUERY, 5, "doc_id").select("doc_id", "score", "relevance")


def fused_union(spark, d):
    """Prose hits, then entity hits, in that order and without merging scores."""
    prose = R.top(_bm25(spark, d), 5, "doc_id").select(F.lit("prose").alias("channel"), F.col("doc_id").alias("id"), "score")
    entity = R.top(_knn(spark, d), 5, "vec_id").select(F.lit("entity").alias("channel"), F.col("vec_id").alias("id"), "score")
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "id"))
    return prose.unionByName(entity).withColumn("place", place)


def passage_merge_max(spark, d):
    """Topics and the whole question as one batch of queries; each passage keeps its best score."""
    scores = I.search_index(I.stored_index(_docs(spark, d)), {"topic": " ".join(QUERY.split(" ")[:3]), "whole": QUERY}).withColumn("score", F.round("score", 6))
    most = F.when(F.col("query_id") == "whole", 10).otherwise(5)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("place", place).where(F.col("place") <= most).groupBy("doc_id").agg(F.max("score").alias("score"))


def filter_list_total(spark, d):
    """Filtered rows by id, at most 50, with the exact total; a filter column that is null never matches."""
    hits = table(spark, d, "part").where("p_size between 5 and 15 and p_type like 'S%'").select("p_partkey", "p_name")
    return R.page(hits, ["p_partkey"], 50)


def query_router(spark, d):
    """Signals by pattern; one group's hit wins, none or several send the turn to all tools."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    groups = {"rules": "(?i)(how|rule|can i)", "lore": "(?i)(who|where|story)", "combat": "(?i)(attack|damage|round)"}
    hits = [F.when(F.col("text").rlike(p), F.lit(g)) for g, p in groups.items()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return turns.select("conv_id", "turn", F.when(F.size(found) == 1, found[0]).otherwise("all").alias("route"))


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_without_index": lambda s, d: R.top(R.bm25_scores(_docs(s, d), QUERY).withColumn("score", F.round("score", 6)), 10, "doc_id").select("doc_id", "score"),
    "bm25_index_build": lambda s, d: I.stored_index(_docs(s, d)).groupBy("idx").agg(F.count("*").alias("documents"), F.round(F.sum("weight"), 4).alias("weight")),
    "corpus_stats": lambda s, d: R.corpus_stats(_docs(s, d)).withColumn("avgdl", F.round("avgdl", 6)),
    "term_df": lambda s, d: R.document_frequency(_docs(s, d)),
    "term_hash_weights": lambda s, d: R.document_frequency(_docs(s, d)).withColumn("idx", term_hash("term")).groupBy("idx").agg(F.count("*").alias("terms"), F.sum("df").alias("df")),
    "knn_cosine": lambda s, d: R.top(_knn(s, d), 10, "vec_id"),
    "knn_threshold": lambda s, d: _knn(s, d).where("score >= 0.5"),
    "centroid_route": lambda s, d: R.routed(table(s, d, "embeddings")),
    "hybrid_rrf": hybrid_rrf,
    "rerank_keep_score": rerank_keep_score,
    "fused_union": fused_union,
    "filter_list_total": filter_list_total,
    "filter_or_sources": lambda s, d: _docs(s, d).where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en")).select("doc_id", "source"),
    "unknown_source_count": lambda s, d: _docs(s, d).agg(F.count_if(~F.col("source").isin("src1", "src2", "src3") | F.col("source").isNull()).alias("unknown")),
    "cr_range_filter": lambda s, d: table(s, d, "part").where("p_size >= 3 and p_size <= 7").select("p_partkey", "p_size"),
    "snippet": lambda s, d: _docs(s, d).select("doc_id", snippet(F.col("text")).alias("snippet")),
    "query_router": query_router,
    "passage_merge_max": passage_merge_max,
    "token_counts": lambda s, d: _docs(s, d).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens")),
}

ORACLES = {
    "bm25_topk": f"with {_BM25} select doc_id, round(raw, 6) as score from bm order by score desc, doc_id limit 10",
    "bm25_without_index": f"with {_BM25} select doc_id, round(raw, 6) as score from bm order by score desc, doc_id limit 10",
    "bm25_index_build": f"with {_BM25}, p as (select th.idx, doc_id, sum((ln((n+1)/(df+1)) + 1) * (tf*2.5 / (tf + 1.5*(0.25 + 0.75*l/(t/n))))) as weight from tf join th using (term), st group by 1, 2) select idx, count(*) as documents, round(sum(weight), 4) as weight from p group by 1",
    "corpus_stats": f"with {_BM25} select n as documents, coalesce(t, 0)::bigint as total_tokens, round(case when n = 0 then 1.0 else t/n end, 6) as avgdl from st",
    "term_df": f"with {_BM25} select term, df from df",
    "term_hash_weights": f"with {_BM25} select idx, count(*) as terms, sum(df)::bigint as df from th group by 1",
    "knn_cosine": f"with {_KNN} select vec_id, label, score from kn order by score desc, vec_id limit 10",
    "knn_threshold": f"with {_KNN} select vec_id, label, score from kn where score >= 0.5",
    "centroid_route": f"""with u as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings),
      c as (select label, list(m order by i) as v from (select label, i, avg(x::double) as m from u group by 1, 2) group by 1),
      s as (select vec_id, label, round({_COS}, 6) as similarity from (select vec_id, c.label, embedding as e, v from embeddings, c)),
      r as (select *, row_number() over (partition by vec_id order by similarity desc, label) as k from s)
      select vec_id, case when similarity >= 0.45 then label end as route, similarity from r where k = 1""",
    "hybrid_rrf": f"""with {_BM25}, {_KNN},
      a as (select vec_id as doc_id, row_number() over (order by score desc, vec_id) as r from (select * from kn order by score desc, vec_id limit 20)),
      b as (select doc_id, row_number() over (order by score desc, doc_id) as r from (select doc_id, round(raw, 6) as score from bm order by score desc, doc_id limit 20))
      select coalesce(a.doc_id, b.doc_id) as doc_id, round(coalesce(1.0::double/(60+a.r), 0) + coalesce(1.0::double/(60+b.r), 0), 6) as score from a full join b on a.doc_id = b.doc_id order by score desc, doc_id limit 20""",
    "rerank_keep_score": f"""with {_BM25}, p as (select doc_id, round(raw, 6) as score from bm order by score desc, doc_id limit 20),
      x as (select doc_id, score, round(len(list_intersect(list_distinct(w), list_distinct({_TOK.replace("text", f"'{QUERY}'")}))) / len(list_distinct({_TOK.replace("text", f"'{QUERY}'")})), 6) as relevance from p join tok using (doc_id))
      select doc_id, score, relevance from x order by relevance desc, score desc, doc_id limit 5""",
    "fused_union": f"""with {_BM25}, {_KNN},
      u as ((select 'prose' as channel, doc_id as id, round(raw, 6) as score from bm order by score desc, id limit 5) union all (select 'entity', vec_id, score from kn order by score desc, vec_id limit 5))
      select channel, id, score, row_number() over (partition by channel order by score desc, id)::int as place from u""",
    "filter_list_total": "select p_partkey, p_name, count(*) over () as total from part where p_size between 5 and 15 and p_type like 'S%' order by p_partkey limit 50",
    "filter_or_sources": "select doc_id, source from documents where source in ('src1', 'src2') and lang = 'en'",
    "unknown_source_count": "select count(*) filter (where source not in ('src1', 'src2', 'src3') or source is null) as unknown from documents",
    "cr_range_filter": "select p_partkey, p_size from part where p_size >= 3 and p_size <= 7",
    "snippet": "select doc_id, case when length(text) > 240 then substr(text, 1, 240) || '…' else text end as snippet from documents",
    "query_router": """with h as (select conv_id, turn, list_filter([case when regexp_matches(text, '(?i)(how|rule|can i)') then 'rules' end, case when regexp_matches(text, '(?i)(who|where|story)') then 'lore' end, case when regexp_matches(text, '(?i)(attack|damage|round)') then 'combat' end], lambda x: x is not null) as f from conversations where role = 'user')
      select conv_id, turn, case when len(f) = 1 then f[1] else 'all' end as route from h""",
    "passage_merge_max": f"""with {_BM25}, qq as (select 'whole' as query_id, idx, weight from q union all select 'topic', {_HASH}, count(*) from (select unnest({_TOK.replace("text", repr(" ".join(QUERY.split(" ")[:3])))}) as term) group by 1, 2),
      s as (select query_id, doc_id, round(sum(qq.weight * (ln((n+1)/(df+1)) + 1) * (tf*2.5 / (tf + 1.5*(0.25 + 0.75*l/(t/n))))), 6) as score from tf join th using (term) join qq on th.idx = qq.idx, st group by 1, 2),
      r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as k from s)
      select doc_id, max(score) as score from r where k <= case when query_id = 'whole' then 10 else 5 end group by 1""",
    "token_counts": f"select doc_id, len({_TOK})::bigint as n_tokens from documents",
}
