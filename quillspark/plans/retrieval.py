"""Queries of composed searches over documents as blocks and parts as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import retrieval as R
from ..operators import search as S
from ..sources.tables import table
from .book import Book
from .search import _BM25, _KNN, _TOK, QUERY, _first_vector

BOOK = Book()
_QTOK = _TOK.replace("text", f"'{QUERY}'")


def _blocks(s, d) -> DataFrame:
    """Documents as blocks; the vector of a document's number is its own."""
    docs = table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("version"), F.col("source").alias("source_key"), F.lit(None).cast("string").alias("entity_name"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("source_book"), F.lit(None).cast("string").alias("book_type"))
    return docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


def _entities(s, d) -> DataFrame:
    """Parts as records; every record has the vector of its number, repeating."""
    k = F.col("p_partkey")
    n = table(s, d, "embeddings").count()
    rows = table(s, d, "part").select(
        F.concat(F.lit("e"), F.lpad(k.cast("string"), 6, "0")).alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("source_book"), F.when(k % 2 == 0, "2014").otherwise("2024").alias("edition"),
        F.when(k % 5 != 0, F.col("p_size") / 2).alias("cr_numeric"), F.array(F.split("p_name", " ")[0], F.split("p_name", " ")[1]).alias("keywords"), (k % 3 == 0).alias("srd"), (k % 7 == 0).alias("needs_review"),
        F.when(k % 11 == 0, "Hand-Authored").otherwise("llm").alias("data_source"), F.element_at(F.array(*map(F.lit, ("Core", "Supplement", "Homebrew"))), (k % 3 + 1).cast("int")).alias("book_type"), F.concat_ws(" ", "p_name", F.lit("that"), "p_type").alias("text"), (k % max(1, n)).alias("vec_id"),
    )
    return rows.join(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


_ENT = """ent as (select 'e' || lpad(p_partkey::varchar, 6, '0') as id, p_type as type, p_name as name, p_brand as source_book, case when p_partkey % 2 = 0 then '2014' else '2024' end as edition, case when p_partkey % 5 <> 0 then p_size / 2.0 end as cr, string_split(p_name, ' ') as kw,
  p_partkey % 3 = 0 as srd, p_partkey % 7 = 0 as review, p_partkey % 11 = 0 as authored, (['Core', 'Supplement', 'Homebrew'])[p_partkey % 3 + 1] as book_type, p_name || ' that ' || p_type as text, p_partkey % (select count(*) from embeddings) as vec_id from part)"""
_SHARE = f"round(len(list_intersect(list_distinct({_TOK}), list_distinct({_QTOK}))) / len(list_distinct({_QTOK})), 6)"
_PROSE = f"""with {_BM25}, {_KNN}, b as (select doc_id, text from documents where {{where}}),
  a as (select doc_id, row_number() over (order by score desc, doc_id) as r from (select vec_id as doc_id, score from kn join b on vec_id = doc_id order by score desc, doc_id limit {{n}})),
  p as (select doc_id, row_number() over (order by score desc, doc_id) as r from (select doc_id, round(raw, 6) as score from bm join b using (doc_id) order by score desc, doc_id limit {{n}})),
  f as (select coalesce(a.doc_id, p.doc_id) as doc_id, round(coalesce(1.0::double/(60+a.r), 0) + coalesce(1.0::double/(60+p.r), 0), 6) as score from a full join p on a.doc_id = p.doc_id order by score desc, doc_id limit {{n}})"""


def _prose(where: str, n: int) -> str:
    return _PROSE.replace("{where}", where).replace("{n}", str(n))


_EN_FEW = "lang in ('en', 'fr') and source in ('src1', 'src2', 'src3')"


def _where_few():
    return S.block_filter(version=" ", source_keys=["src1", "", "src2", "src3"]) & F.col("version").isin("en", "fr")


@BOOK("select doc_id from documents where lang = 'en' and source in ('src1', 'src2')")
def block_filter(s, d):
    return _blocks(s, d).where(S.block_filter(version="en", category="", source_keys=["src1", "src2", " "])).select("doc_id")


@BOOK(f"with {_ENT} select id from ent where edition = '2014' and cr >= 2.5 and cr <= 10 and list_contains(kw, 'ring') and srd")
def entity_filter(s, d):
    return _entities(s, d).where(S.entity_filter(edition="2014", cr_gte=2.5, cr_lte=10, keyword="ring", srd=True, srd52=False)).select("id")


@BOOK("select p_partkey, case when p_partkey % 3 = 0 then 'Monster' when p_partkey % 3 = 1 then 'Spell' end as type, case when p_partkey % 3 = 0 then 'Monster' end as exact_type from part")
def lenient_filters(s, d):
    """Wishes in any case are known by one interface, by the other only as written; unknown ones ask for nothing."""
    said = F.element_at(F.array(*map(F.lit, ("Monster", " spell", "Nothing"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", S.lenient(said, ["Monster", "Spell"]).alias("type"), S.lenient(said, ["Monster", "Spell"], exact=True).alias("exact_type"))


@BOOK(_prose(_EN_FEW, 20) + f" select doc_id, score from f join b using (doc_id) order by {_SHARE} desc, score desc, doc_id limit 5")
def prose_search(s, d):
    """Filtered inside both rankings, fused, reranked; the five best keep the score they were fused with."""
    return S.prose_search(_blocks(s, d), QUERY, _first_vector(s, d), I.stored_index(table(s, d, "documents")), _where_few()).select("doc_id", "score")


@BOOK(_prose("true", 20) + " select doc_id, score from f order by score desc, doc_id limit 20")
def prose_diagnostic(s, d):
    """Without reranking, and no more than the service's most."""
    return S.prose_search(_blocks(s, d), QUERY, _first_vector(s, d), I.stored_index(table(s, d, "documents")), top_k=50, diagnostic=True).select("doc_id", "score")


@BOOK(f"with {_KNN} select vec_id as doc_id, score from kn where score >= 0.5 and exists (select 1 from documents where doc_id = vec_id) order by score desc, doc_id limit 7")
def dense_only_search(s, d):
    """Sparse ranks switched off: the dense ones over the threshold."""
    return S.prose_search(_blocks(s, d), QUERY, _first_vector(s, d), None, top_k=7, options=S.Options(rerank=False)).select("doc_id", "score")


_ENTITY = f"with {_KNN}, {_ENT}, h as (select id, type, name, edition, review, authored, book_type, text, score from ent join kn using (vec_id) where {{where}} order by score desc, id limit 20)"


@BOOK(_ENTITY.replace("{where}", "type = 'PROMO'") + f" select id, score from h order by {_SHARE} desc, score desc, id limit 10")
def entity_search(s, d):
    return S.entity_search(_entities(s, d), QUERY, _first_vector(s, d), S.entity_filter(type="PROMO")).select("id", "score")


@BOOK(f"with {_ENT} select id, name, count(*) over () as total from ent where cr <= 3 order by id limit 200")
def entity_list(s, d):
    """A listing asked for 5000 rows gives 200, and the exact total."""
    return S.listed(_entities(s, d).select("id", "name", "cr_numeric"), S.entity_filter(cr_lte=3), 5000).select("id", "name", "total")


_RANKED = "order by case book_type when 'Core' then 4 when 'Supplement' then 3 else 0 end desc, authored desc, review, length(text) desc, id"


@BOOK(f"with {_ENT} select name, id as winner from (select *, row_number() over (partition by name {_RANKED}) as k from ent) where k = 1")
def authority_winner(s, d):
    """The better of records of one name, by the whole ladder."""
    return S.duplicate_groups(_entities(s, d).unionByName(_entities(s, d).withColumn("id", F.concat("id", F.lit("z"))).withColumn("book_type", F.lit("none")).withColumn("data_source", F.lit("x"))), ["name"], S.authority()).select("name", "winner")


@BOOK(f"with {_ENT}, r as (select *, row_number() over (partition by name, edition {_RANKED}) as k from ent) select name, edition, count(*) as n, max(case when k = 1 then id end) as winner, string_agg(case when k > 1 then id end, ',' order by k) as losers from r group by 1, 2 having count(*) >= 2")
def duplicate_groups(s, d):
    return S.duplicate_groups(_entities(s, d), ["name", "edition"], S.authority()).withColumn("losers", F.array_join("losers", ","))


_COLLAPSED = f""", c as (select *, row_number() over (order by score desc, id) as place from h), g as (select *, max(score) over (partition by name, edition) as best, min(place) over (partition by name, edition) as first_at, row_number() over (partition by name, edition {_RANKED}) as k from c), e as (select id, text, best as score, first_at as place from g where k = 1)"""


@BOOK(_ENTITY.replace("{where}", "true") + _COLLAPSED + " select id, score, place::int as place from e")
def hit_collapse_authority(s, d):
    hits = R.top(R.nearest(_entities(s, d), _first_vector(s, d)), 20, "id").withColumn("place", F.expr("row_number() over (order by score desc, id)"))
    return S.collapsed(hits, ["name", "edition"], S.authority(), "place").select("id", "score", "place")


@BOOK(
    _prose("true", 20).replace(_KNN, _KNN + ", " + _ENT)
    + ", h as (select id, type, name, edition, review, authored, book_type, text, score from ent join kn using (vec_id) order by score desc, id limit 20)"
    + _COLLAPSED
    + f""", u as (select 'prose' as channel, doc_id::varchar as id, text, score, 0 as lead, row_number() over (order by score desc, doc_id) as place from f join b using (doc_id) union all select 'entity', id, text, score, 1, place from e)
  select channel, id, score from u order by {_SHARE} desc, lead, place limit 5"""
)
def fused_search(s, d):
    """Prose and record candidates, records' duplicates collapsed, judged together; five by default, and no filter."""
    vector = _first_vector(s, d)
    options = S.Options(rerank=False)
    place = F.expr("row_number() over (order by score desc, id)")
    prose = S.prose_search(_blocks(s, d), QUERY, vector, I.stored_index(table(s, d, "documents")), top_k=20, options=options).select(F.lit("prose").alias("channel"), F.col("doc_id").alias("id"), "text", "score").withColumn("place", place).withColumn("id", F.col("id").cast("string"))
    hits = R.top(R.nearest(_entities(s, d), vector), 20, "id").withColumn("place", place)
    entity = S.collapsed(hits, ["name", "edition"], S.authority(), "place").select(F.lit("entity").alias("channel"), "id", "text", "score", "place")
    return S.fused_search(prose, entity, QUERY).select("channel", "id", "score")


@BOOK(f"with {_KNN} select vec_id, score from kn order by score desc, vec_id limit 10")
def quantised_search(s, d):
    """Eight bits first, then whole vectors: on these tables the same ten as by whole vectors alone."""
    return S.quantised_nearest(table(s, d, "embeddings"), _first_vector(s, d), 10).select("vec_id", "score")


@BOOK(_prose("source in ('src2', 'src4')", 10) + " select doc_id, score from f order by score desc, doc_id limit 10")
def scoped_search(s, d):
    """A subject's books only: ten blocks, not reranked."""
    return S.prose_search(_blocks(s, d), QUERY, _first_vector(s, d), I.stored_index(table(s, d, "documents")), S.block_filter(source_keys=["src2", "src4"]), top_k=10, options=S.Options(rerank=False)).select("doc_id", "score")


@BOOK("""with t as (select conv_id, turn, text, conv_id % (select count(*) from embeddings) as vec_id from conversations where role = 'user'),
  u as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings), c as (select label, list(m order by i) as v from (select label, i, avg(x::double) as m from u group by 1, 2) group by 1),
  z as (select conv_id, turn, text, c.label, round(list_sum(list_transform(list_zip(embedding, v), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))) * sqrt(list_sum(list_transform(v, lambda x: x::double*x::double)))), 6) as similarity from t join embeddings using (vec_id), c),
  b as (select *, row_number() over (partition by conv_id, turn order by similarity desc, label) as k, list_filter([case when regexp_matches(text, '(?i)(how|rule|can i)') then 'rules' end, case when regexp_matches(text, '(?i)(who|where|story)') then 'lore' end], lambda x: x is not null) as f from z)
  select conv_id, turn, case when len(f) = 1 then f[1] when similarity >= 0.45 then label::varchar else 'all' end as route from b where k = 1""")
def route_with_centroids(s, d):
    """One signal's group; without a single one the nearest centroid's, if near enough."""
    vectors = table(s, d, "embeddings")
    n = vectors.count()
    turns = table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", (F.col("conv_id") % n).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    return S.routed_turns(turns, {"rules": "(?i)(how|rule|can i)", "lore": "(?i)(who|where|story)"}, R.centroids(vectors)).select("conv_id", "turn", "route")


@BOOK("select p_partkey, case when n <= 0 then 1 when n > 50 then 20 when n > 20 then 20 else n end::int as top_k, case when n <= 0 then 50 else least(greatest(n, 1), 200) end::int as cap from (select p_partkey, p_partkey % 300 - 5 as n from part)")
def public_caps(s, d):
    """Asked-for sizes within the public bounds, and a search's own most."""
    n = (F.col("p_partkey") % 300 - 5).cast("int")
    return table(s, d, "part").select("p_partkey", F.least(F.least(F.greatest(n, F.lit(1)), F.lit(50)), F.lit(S.MAX_TOP_K)).alias("top_k"), F.least(F.greatest(F.when(n <= 0, S.LIST_DEFAULT).otherwise(n), F.lit(1)), F.lit(S.LIST_MOST)).alias("cap"))


@BOOK("select p_partkey from part where p_brand = 'Brand#5' and p_size between 8 and 12")
def page_window(s, d):
    return S.page_window(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("source_book"), F.col("p_size").alias("page")), "Brand#5", 10).select("p_partkey")


@BOOK("""with q as (select vec_id as qid, embedding as e, vec_id % 50 as page, label from embeddings where vec_id % 20 = 0), z as (select qid, round(list_sum(list_transform(list_zip(e, embedding), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(e, lambda x: x::double*x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double)))), 6) as score
  from q join embeddings v on v.label = q.label and v.vec_id % 50 between q.page - 2 and q.page + 2 and v.vec_id <> qid) select q.qid as vec_id, coalesce(max(score), 0.0)::double as score, coalesce(max(score), 0.0) < 0.5 as below_floor from q left join z using (qid) group by 1""")
def nearest_passage_on_page(s, d):
    """Each record's best passage of its own book within two pages; none counts as 0."""
    v = table(s, d, "embeddings").withColumn("page", F.col("vec_id") % 50)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e"), F.col("page").alias("at"), F.col("label").alias("book"))
    pages = q.withColumn("page", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)))
    near = pages.join(v, (F.col("book") == F.col("label")) & (pages["page"] == v["page"]) & (F.col("qid") != F.col("vec_id"))).groupBy("qid").agg(F.max(F.round(R.cosine(F.col("e"), F.col("embedding")), 6)).alias("score"))
    return q.select("qid").join(near, "qid", "left").select(F.col("qid").alias("vec_id"), F.coalesce("score", F.lit(0.0)).alias("score")).withColumn("below_floor", F.col("score") < S.LEAST_SCORE)
