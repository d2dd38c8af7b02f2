"""Queries of services that keep something between calls: queues, retries, caches, statistics, indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import advice as A
from ..functions import callables
from ..functions import layout as L
from ..operators import advisor, blockmax, intervals, outline, renames, schemas, vectors
from ..operators import mutations as M
from ..operators import retrieval as R
from ..operators.bookstats import BookStats, follow
from ..operators.index import shared_root
from ..sources import canonical
from ..sources.tables import table
from ..streaming import keyed, limits
from .book import Book
from .layout import _case
from .records import _letter_counts
from .retrieval import _SHARE
from .search import _BM25, _COS, _KNN, _TOK, QUERY, _first_vector

BOOK = Book()

ingestion_queue = BOOK(keyed.INGESTION_SQL)(keyed.ingestion_queue)
extraction_retries = BOOK(keyed.RETRIES_SQL)(keyed.extraction_retries)
tool_cache = BOOK(keyed.CACHE_SQL)(keyed.tool_cache)
limiter_stream = BOOK(limits.FIXED_SQL)(keyed.limiter_stream)


_SECTIONS = "select o_custkey as book, o_orderkey as section, (o_orderkey * 7 % 400)::bigint as first, case when o_orderkey % 3 <> 0 then (o_orderkey * 7 % 400 + o_orderkey % 90 - 5)::bigint end as last from orders"


@BOOK(f"""with s as ({_SECTIONS}), e as (select book, section, first, coalesce(last, lead(first) over (partition by book order by first, section) - 1, 1099511627776) as last from s),
  p as (select l_orderkey, l_linenumber, l_orderkey % (select count(*) from customer) as book, (l_partkey * 13 + l_linenumber) % 450 as page from lineitem)
  select l_orderkey, l_linenumber, page, arg_min(section, (first, section)) as section from p left join e on e.book = p.book and page between first and last group by 1, 2, 3""")
def section_of_page(s, d):
    """Orders as sections of a customer's pages, which overlap, some without an end; lines as pages, each in the first section that holds it."""
    k = F.col("o_orderkey")
    first = (k * 7 % 400).cast("long")
    sections = table(s, d, "orders").select(F.col("o_custkey").alias("book"), k.alias("section"), first.alias("first"), F.when(k % 3 != 0, first + k % 90 - 5).alias("last"))
    books = table(s, d, "customer").count()
    pages = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % books).alias("book"), ((F.col("l_partkey") * 13 + F.col("l_linenumber")) % 450).alias("page"))
    return intervals.first_interval(pages, sections, "book", "page", "first", "last", "section", ["section"]).select("l_orderkey", "l_linenumber", "page", "section").distinct()


_TITLE_SQL = "case o_orderkey % 5 when 0 then ' x ' when 1 then '' when 2 then 'Monsters (A-Z)' when 3 then 'Spells of ' || o_orderpriority else 'Entry ' || o_orderkey end"


@BOOK(f"""with recursive b as (select o_orderkey as id, {_TITLE_SQL} as title, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders),
  w as (select id, title, null::varchar as parent_title, case when length(trim(title)) >= 3 then title end as context from b where parent is null
    union all select b.id, b.title, w.context, case when length(trim(b.title)) >= 3 then b.title else w.context end from b join w on b.parent = w.id)
  select id, title, parent_title, case when {_case('title')} = 'Rule' and parent_title is not null then {_case('parent_title')} else {_case('title')} end as category from w where length(trim(title)) >= 3""")
def bookmark_outline(s, d):
    """A customer's orders as a chain of bookmarks, each under the one before; titles of fewer than three characters are passed over."""
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, " x ").when(k % 5 == 1, "").when(k % 5 == 2, "Monsters (A-Z)").when(k % 5 == 3, F.concat(F.lit("Spells of "), "o_orderpriority")).otherwise(F.concat(F.lit("Entry "), k.cast("string")))
    chain = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    marks = table(s, d, "orders").select(k.alias("id"), title.alias("title"), F.lag("o_orderkey").over(chain).alias("parent"))
    rows = outline.outline(marks, "id", "parent", "title")
    own, above = L.heading_category(F.col("title")), L.heading_category(F.col("parent_title"))
    return rows.select("id", "title", "parent_title", F.when((own == "Rule") & F.col("parent_title").isNotNull(), above).otherwise(own).alias("category"))


def _id_sql(k: str, new: bool) -> str:
    kind = f"(['item', 'weapon', 'spell'])[{k} % 3 + 1]"
    kind = f"case when {k} % 5 = 0 then 'armor' else {kind} end" if new else kind
    return f"'book' || {k} % 7 || '.' || {kind} || '.n' || {k}"


_RECORD_SQL = "'{\"id\":\"' || {own} || '\",\"n\":' || k || ',\"see\":[\"' || {up} || '\",{\"\\\"q\\\"\":\"' || {old} || ' too\",\"of\":\"' || {far} || '\"}]}'"


def _record_sql() -> str:
    parts = {"own": _id_sql("k", True), "up": _id_sql("up", True), "old": _id_sql("k", False), "far": _id_sql("far", True)}
    out = _RECORD_SQL
    for name, sql in parts.items():
        out = out.replace("{" + name + "}", f"({sql})")
    return out


@BOOK(f"""with n as (select p_partkey as k, p_partkey % 7 + (p_partkey // 14) * 7 as up, p_partkey % 7 + 7 * (p_partkey // 70) as far from part)
  select k as p_partkey, {_id_sql('k', True)} as id, {_record_sql()} as record, ((k % 5 = 0)::int + (up % 5 = 0)::int + (far % 5 = 0)::int)::bigint as references from n""")
def type_renames(s, d):
    """Parts as records that name themselves, two others, and their own id within a longer text; every fifth is an armor by the roster."""
    def old(k):
        return F.concat(F.lit("book"), (k % 7).cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("item", "weapon", "spell"))), (k % 3 + 1).cast("int")), F.lit(".n"), k.cast("string"))

    k = F.col("p_partkey")
    up, far = k % 7 + F.expr("p_partkey div 14") * 7, k % 7 + F.expr("p_partkey div 70") * 7
    text = F.concat(F.lit('{"id":"'), old(k), F.lit('","n":'), k.cast("string"), F.lit(',"see":["'), old(up), F.lit('",{"\\"q\\"":"'), old(k), F.lit(' too","of":"'), old(far), F.lit('"}]}'))
    records = table(s, d, "part").select("p_partkey", (k % 7).alias("book"), old(k).alias("id"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.lower("p_brand").alias("source"), F.split_part(old(k), F.lit("."), F.lit(2)).alias("type"), text.alias("record"))
    lookup = records.where("p_partkey % 5 = 0").select(F.lower("name").alias("name_key"), F.upper("source").alias("source_key"), F.lit("Armor").alias("type"))
    changes = renames.corrections(records, lookup)
    done = M.spread(renames.renamed(records, changes, "p_partkey"), "book", "id", rows=records.count()).join(changes.select(F.col("old_id").alias("id"), "book", "new_id").hint("merge"), ["book", "id"], "left")
    return done.select("p_partkey", F.coalesce("new_id", "id").alias("id"), "record", "references")


_BOOKS = "b as (select * from documents where source is not null and source <> 'src2' and (source <> 'src1' or doc_id % 40 < 20) and (source <> 'src3' or doc_id % 40 >= 20))"


@BOOK(f"""with {_BOOKS}, t as (select {_TOK} as w from b), d as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from t) group by 1)
  select term, df, (select count(*) from t) as documents, (select sum(len(w)) from t)::bigint as tokens from d""")
def stats_stored(s, d):
    """Sources as books that come as a stream: all of them, then one with fewer texts, then one that goes and one that comes again, over restarts."""
    place = f"{shared_root(s)}/stats-{uuid.uuid4().hex}"
    stats = BookStats(s, f"{place}/stats")
    docs = table(s, d, "documents").select(F.col("source").alias("book"), "text", "doc_id", F.lit(False).alias("gone"))
    again = docs.where("book = 'src3' and doc_id % 40 >= 20")
    gone = docs.where("book = 'src2'").select("book", "text", "doc_id", F.lit(True).alias("gone"))
    for rows in (docs, docs.where("book = 'src1' and doc_id % 40 < 20"), again.unionByName(gone)):
        # a book's texts are in one file, so that a micro-batch has it whole
        rows.drop("doc_id").repartition("book").write.mode("append").parquet(f"{place}/source")
        stream = s.readStream.schema(rows.drop("doc_id").schema).option("maxFilesPerTrigger", 8).parquet(f"{place}/source")
        follow(stream, stats, f"{place}/state")
    return stats.terms().crossJoin(F.broadcast(stats.totals().select("documents", "tokens")))  # one row


@BOOK(f"""with edge as (select quantile_disc(abs(x::double), 0.99) as edge from (select unnest(embedding) as x from embeddings)),
  codes as (select vec_id, embedding as e, list_transform(embedding, lambda x: greatest(-127.0, least(127.0, round_even(x::double / edge * 127, 0)))) as c from embeddings, edge),
  sized as (select *, sqrt(list_sum(list_transform(c, lambda x: x * x))) as size from codes),
  pairs as (select q.vec_id as query_id, v.vec_id, q.e as v_, v.e as e, case when q.size * v.size > 0 then list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) / (q.size * v.size) else 0 end as coarse from sized q, sized v where q.vec_id % 20 = 0),
  few as (select * from pairs qualify row_number() over (partition by query_id order by coarse desc, vec_id) <= 20),
  scored as (select query_id, vec_id, round(coalesce({_COS.replace(" e,", " e,").replace(", v)", ", v_)").replace("(v,", "(v_,")}, 0), 6) as score from few)
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored qualify rank <= 10""")
def quantised_stored(s, d):
    """Each twentieth vector against all: the nearest ten by codes of eight bits, oversampled by two, then by the whole vectors."""
    rows = table(s, d, "embeddings")
    return vectors.nearest_stored(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@BOOK(f"with {_BM25} select doc_id, round(raw, 6) as score from bm order by 2 desc, 1 limit 10")
def bm25_topk_blocks(s, d):
    """The ten best of the sparse search with blocks skipped that cannot hold one."""
    return blockmax.Search(*blockmax.stored_blocks(table(s, d, "documents")), QUERY).hits


def _called(s, d):
    callables.register(s, table(s, d, "documents"), table(s, d, "embeddings"), _letter_counts)


@BOOK(f"with {_BM25} select doc_id, round(raw, 6) as score from bm order by 2 desc, 1 limit 10")
def sql_sparse_search(s, d):
    """The sparse search called by name from SQL."""
    _called(s, d)
    return s.sql("select doc_id, score from sparse_search(:q, 10)", {"q": QUERY})


@BOOK(f"with {_KNN} select vec_id, score from kn order by score desc, vec_id limit 10")
def sql_dense_search(s, d):
    """The dense search called by name, with the vector of a row."""
    _called(s, d)
    return s.sql("select vec_id, score from dense_search(:v, 10)", {"v": [float(x) for x in _first_vector(s, d)]})


@BOOK(f"with {_BM25}, p as (select doc_id, round(raw, 6) as score from bm order by 2 desc, 1 limit 20) select doc_id, score, {_SHARE} as relevance from p join documents using (doc_id) order by relevance desc, score desc, doc_id limit 5")
def sql_reranked_search(s, d):
    """The sparse search's hits joined to their texts and handed to the reranker, all in SQL."""
    _called(s, d)
    table(s, d, "documents").createOrReplaceTempView("quill_documents")
    return s.sql("select doc_id, score, relevance from rerank(table(select doc_id, score, text from sparse_search(:q, 20) join quill_documents using (doc_id)), :q, 5, 'lexical')", {"q": QUERY})


@BOOK("select doc_id, len(regexp_extract_all(substr(text, 1, 800), 'e'))::double as e, len(regexp_extract_all(substr(text, 1, 800), 'n'))::double as n from documents where text is not null")
def sql_embedded(s, d):
    """A given embedder called by name; it sees a text's first 800 characters."""
    _called(s, d)
    table(s, d, "documents").createOrReplaceTempView("quill_documents")
    return s.sql("select doc_id, v[0] as e, v[1] as n from (select doc_id, embed_text(text) as v from quill_documents where text is not null)")


@BOOK("""select p_brand as slug, (row_number() over (partition by p_brand order by p_partkey) - 1)::int as ordinal, 'p' || p_partkey as id, case when p_partkey % 7 = 0 then 'patched' else p_name end as name, p_size as size, case when p_partkey % 7 = 0 then p_type end as extra from part""")
def canonical_patch(s, d):
    """Parts as documents of a brand, written by files of their own; every seventh record is patched, and all are read back."""
    path = f"{shared_root(s)}/canonical-{uuid.uuid4().hex}"
    id = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    part = table(s, d, "part").withColumn("slug", F.col("p_brand"))
    record = F.to_json(F.struct(id.alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array(F.lit("a"), F.lit('"q"')).alias("list")))
    canonical.write_documents(part.select("slug", F.col("p_partkey").alias("ordinal"), record.alias("record")), path)
    patch = F.to_json(F.struct(F.lit("patched").alias("name"), F.col("p_type").alias("extra")))
    canonical.patch_documents(s, path, part.where("p_partkey % 7 = 0").select("slug", id.alias("id"), patch.alias("patch")))
    got = lambda p: F.get_json_object("record", f"$.{p}").alias(p)
    return canonical.read_documents(s, path).select("slug", "ordinal", got("id"), got("name"), got("size").cast("int").alias("size"), got("extra"))


_SHAPED = """'{"id":' || p_partkey || ',"name":' || to_json(p_name) || ',"price":' || p_retailprice || case p_partkey % 3 when 0 then ',"sizes":[' || p_size || ',' || p_partkey || ']' when 1 then ',"odd":' || case when p_partkey % 2 = 0 then '1' else '"one"' end else ',"in":{"brand":' || to_json(p_brand) || ',"new":' || (p_size > 20) || '}' end || '}'"""


@BOOK(rf"""with r as (select (['ring', 'tool'])[p_partkey % 2 + 1] as type, ({_SHAPED})::json as record from part), t as (select q.type, j.fullkey, j.type as kind from r q, json_tree(q.record) j),
  n as (select type, regexp_replace(fullkey, '\[\d+\]', '[]', 'g') as path, case when kind in ('UBIGINT', 'BIGINT') then 'integer' when kind = 'DOUBLE' then 'number' when kind = 'VARCHAR' then 'string' else lower(kind) end as kind from t)
  select type, path, case when count(distinct kind) = 1 then min(kind) else 'any' end as kind from n group by 1, 2""")
def record_schemas(s, d):
    """What the schemas of parts as records say of each path, by type: some fields are a type's own, one is of two kinds."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    q = lambda c: F.to_json(F.array(c))
    name = F.regexp_extract(q(F.col("p_name")), r"^\[(.*)\]$", 1)
    brand = F.regexp_extract(q(F.col("p_brand")), r"^\[(.*)\]$", 1)
    more = F.when(k % 3 == 0, text(',"sizes":[', F.col("p_size").cast("string"), ",", k.cast("string"), "]")).when(k % 3 == 1, text(',"odd":', F.when(k % 2 == 0, "1").otherwise('"one"'))).otherwise(text(',"in":{"brand":', brand, ',"new":', (F.col("p_size") > 20).cast("string"), "}"))
    record = text('{"id":', k.cast("string"), ',"name":', name, ',"price":', F.col("p_retailprice").cast("string"), more, "}")
    rows = table(s, d, "part").select(F.when(k % 2 == 0, "ring").otherwise("tool").alias("type"), record.alias("record"))
    return schemas.schema_paths(schemas.json_schemas(rows))


_CLASSES = "(['Wizard', 'Bard', 'Cleric'])"


@BOOK(f"""with i as (select p_brand as source, p_name as name, unnest(case when p_size % 2 = 0 then [{_CLASSES}[p_partkey % 3 + 1], 'Druid'] else [{_CLASSES}[p_partkey % 3 + 1]] end) as class, p_partkey from part where p_partkey % 4 <> 0),
  e as (select lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as n, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) as s, bool_or(class = 'Druid') as has from i group by 1, 2), l as (select n, bool_or(has) as has from e group by 1),
  c as (select p_partkey from part left join e on e.n = lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) and e.s = lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) left join l on l.n = lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) where p_type <> 'PROMO' and coalesce(e.has, l.has, false))
  select p_partkey as id, (select count(*) from c) as total from c order by 1 limit 200""")
def spells_of_class(s, d):
    """Parts as spells, some unknown to the index: those that a druid casts, as a class or as a class's variant, with their exact number."""
    part = table(s, d, "part")
    k = F.col("p_partkey")
    one = F.element_at(F.array(*map(F.lit, ("Wizard", "Bard", "Cleric"))), (k % 3 + 1).cast("int"))
    named = lambda c: F.array(F.struct(c.alias("name")))
    info = F.struct(named(one).alias("class"), F.when(F.col("p_size") % 2 == 0, named(F.lit("Druid"))).alias("classVariant"))
    index = part.where("p_partkey % 4 <> 0").select(F.to_json(F.create_map("p_brand", F.create_map("p_name", F.to_json(info)))).alias("text"))
    rows = part.select(k.alias("id"), F.lit("Spell").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), "p_type")
    return advisor.listed_spells(rows, F.col("p_type") != "PROMO", advisor.spell_classes(index), "druid", 5000).select("id", "total")


@BOOK("""with c as (select p_partkey from part where p_partkey % 2 = 0 and (p_partkey % 3 = 0 or (p_partkey % 3 = 1 and p_size > 20))) select p_partkey as id, (select count(*) from c) as total from c order by 1 limit 50""")
def races_of_ability(s, d):
    """Parts as races: those that raise wisdom by themselves or by choice, with their exact number; fifty are listed."""
    k = F.col("p_partkey")
    fields = F.when(k % 3 == 0, '{"ability":[{"str":2,"WIS":1}]}').when((k % 3 == 1) & (F.col("p_size") > 20), '{"ability":[{"choose":{"from":["int","wis"]}}]}').otherwise('{"ability":[{"cha":2}]}')
    rows = table(s, d, "part").select(k.alias("id"), F.when(k % 2 == 0, "Race").otherwise("Feat").alias("type"), fields.alias("fields"))
    return advisor.listed_races(rows, F.lit(True), " Wis ").select("id", "total")


@BOOK(f"""with b as (select o_orderkey, {_CLASSES}[o_orderkey % 3 + 1] as class, case when o_orderkey % 5 <> 0 then o_orderkey % 23 end as level from orders),
  p as (select {_CLASSES}[p_partkey % 3 + 1] as class, p_size % 11 as level, p_partkey as id from part), r as (select class, level, id from p where level between 1 and 9 qualify row_number() over (partition by class, level order by id) <= 25),
  m as (select distinct class, level from b), l as (select m.class, m.level, list(id order by r.level, id)[1:25] as ids from m join r on r.class = m.class and r.level <= case when m.level is null then 1 else least(greatest((m.level + 1) // 2, 1), 9) end group by 1, 2)
  select o_orderkey, coalesce(array_to_string(ids, ','), '') as spells from b left join l on l.class = b.class and l.level is not distinct from b.level""")
def build_spells(s, d):
    """Orders as builds of a class, some without a level: the spells recommended to each."""
    k = F.col("o_orderkey")
    one = lambda key: F.element_at(F.array(*map(F.lit, ("Wizard", "Bard", "Cleric"))), (key % 3 + 1).cast("int"))
    builds = table(s, d, "orders").select("o_orderkey", one(k).alias("class"), F.when(k % 5 != 0, k % 23).alias("level"))
    spells = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.upper(one(F.col("p_partkey"))).alias("class"), (F.col("p_size") % 11).alias("level"))
    return advisor.recommended_spells(builds, spells).select("o_orderkey", F.array_join("spells", ",").alias("spells"))


_FEATURES = [("Rage", 1), ("Reckless Attack", 2), ("Primal Path", 3), ("Fast Movement", 5), ("Path feature", 6), ("Feral Instinct", 7)]


@BOOK(f"""with s as (select o_orderkey as sheet, o_orderkey % 9 as level, o_orderkey % 4 = 0 as chosen, o_orderkey % 8 as have from orders where o_orderkey % 7 <> 0),
  f as (select * from (values {', '.join(f"('{n}', {v}, {i})" for i, (n, v) in enumerate(_FEATURES))}) v(name, since, place))
  select sheet, 'UntakenChoice' as kind, 'Path' as about from s where level >= 3 and not chosen
  union all select sheet, 'UntakenChoice', name from s, f where since <= level and not contains(name, 'Path') and place >= have""")
def sheet_critique(s, d):
    """Orders as sheets of a class that record its first few features; one in seven is of a class that is not known."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(n.upper().replace(" ", "-")) for n, _ in _FEATURES])
    sheets = table(s, d, "orders").select(k.alias("sheet"), F.when(k % 7 == 0, "Mystic").otherwise("barbarian").alias("class"), (k % 9).alias("level"), F.when(k % 4 == 0, "Totem").otherwise(" ").alias("subclass"))
    sheets = sheets.withColumn("have", F.slice(names, F.lit(1), (F.col("sheet") % 8).cast("int")))
    classes = s.range(1).select(F.lit("Barbarian").alias("class"), F.lit("Path").alias("title"), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("level")) for n, v in _FEATURES]).alias("features"))
    return advisor.critique(sheets, classes)


@BOOK("""with t as (select p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name || '''s (' || p_type || '): x-' || p_brand), '[ \\-''():]'), lambda w: w <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower('RING-' || p_type || ' s'), '[ \\-''():]'), lambda w: w <> '')) as b from part)
  select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)::double as similarity from t""")
def name_similarity(s, d):
    """Word similarity of names with all marks that part words."""
    a, b = F.concat("p_name", F.lit("'s ("), "p_type", F.lit("): x-"), "p_brand"), F.concat(F.lit("RING-"), "p_type", F.lit(" s"))
    return table(s, d, "part").select("p_partkey", F.round(advisor.word_jaccard(a, b), 6).alias("similarity"))


@BOOK("""select p_name as text, p_brand as book, p_type as section, max(p_size * 1.0)::double as score from part where p_brand in ('Brand#3', 'Brand#7', 'Brand#9') group by 1, 2, 3""")
def passages_of_books(s, d):
    """Parts as hits of several searches: a passage of some books once, with its best score."""
    hits = table(s, d, "part").select(F.col("p_name").alias("text"), F.col("p_brand").alias("book"), F.col("p_type").alias("section"), F.col("p_size").cast("double").alias("score"))
    return advisor.merged_passages(hits, ["Brand#3", "Brand#7", "Brand#9"])


@BOOK("""with x as (select label, embedding, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(embedding[i]::double) as m from x group by 1, 2), n as (select label, sqrt(sum(m * m)) as size from m group by 1)
  select label, (i - 1)::int as place, round(m / size, 6) as weight from m join n using (label)""")
def unit_centroids(s, d):
    """Each label's mean vector, of length one."""
    return R.centroids(table(s, d, "embeddings"), unit=True).select("label", F.posexplode("centroid").alias("place", "weight")).withColumn("weight", F.round("weight", 6))


@BOOK("""with b as (select o_orderkey as id, o_orderstatus as status, o_custkey % 50 as slug from orders), r as (select o_orderkey as id from orders where o_orderkey % 3 = 0 union select c_custkey + 1000000000 from customer),
  j as (select r.id, slug, case when b.id is null then 'not found' when status = 'P' then 'conflict' else 'deleted' end as outcome from r left join b using (id)),
  h as (select distinct slug from b where id not in (select id from j where outcome = 'deleted'))
  select id, outcome, outcome = 'deleted' and slug not in (select slug from h) as file_goes from j""")
def book_deletions(s, d):
    """Every third order as a book to be deleted, some being worked on, some not there; files of a slug stay while a book has it."""
    books = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).alias("slug"))
    wanted = books.where("id % 3 = 0").select("id").unionByName(table(s, d, "customer").select((F.col("c_custkey") + 1000000000).alias("id")))
    return M.deletions(wanted, books, ("P",))


@BOOK("select event_id from events where not (user_id % 10 = 3 and (case when event_type = 'view' then null else event_type end) is null) and not (user_id % 10 = 4 and event_type = 'click')")
def chat_cleared(s, d):
    """Events as turns of a user and a campaign, which views have none of; two chats are cleared."""
    rows = table(s, d, "events").select("event_id", (F.col("user_id") % 10).alias("user"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("campaign"))
    keys = s.createDataFrame([(3, None), (4, "click")], "user long, campaign string")
    return M.cleared(rows, keys).select("event_id")


@BOOK("""with s as (select p_partkey as id, (p_partkey % 5)::int as version, p_name as state from part)
  select id, case when g.p_partkey is not null and coalesce(p_size_v, -1) >= s.version then p_size_v else s.version end as version, case when g.p_partkey is not null and coalesce(p_size_v, -1) >= s.version then 'given' else s.state end as state from s left join (select p_partkey, case when p_size % 7 <> 0 then (p_size % 7)::int end as p_size_v from part where p_partkey % 2 = 0) g on g.p_partkey = s.id""")
def upsert_versions(s, d):
    """Records put into a store, where the higher version stands and of equal ones the new record."""
    part = table(s, d, "part")
    k = F.col("p_partkey")
    stored = part.select(k.alias("id"), (k % 5).cast("int").alias("version"), F.col("p_name").alias("state"))
    given = part.where("p_partkey % 2 = 0").select(k.alias("id"), F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 7).cast("int")).alias("version"), F.lit("given").alias("state"))
    return M.upsert_newer(stored, given, "id", "version")


@BOOK("""with h as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages), a as (select page_id, host from h where host like '%.example.com' or host = 'example.com' or host = 'blog.example.net')
  select host, page_id, (row_number() over (partition by host order by page_id))::int as place from a qualify place <= 5""")
def web_results(s, d):
    """Pages as results of a search: hosts of an allow-list or under one of them, the first five of each."""
    pages = table(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    allowed = [(F.col("host") == h) | F.col("host").endswith(f".{h}") for h in ("example.com", "blog.example.net")]
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return pages.where(allowed[0] | allowed[1]).withColumn("place", place).where("place <= 5").select("host", "page_id", "place")


@BOOK("""select c_custkey, c_name, n_name, (row_number() over (partition by c_mktsegment order by n_name, c_name, c_custkey))::int as place from customer join nation on n_nationkey = c_nationkey where c_mktsegment in ('BUILDING', 'MACHINERY')""")
def heroes_of_users(s, d):
    """Heroes of two users' campaigns, in order of campaign and name."""
    rows = table(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("n_name", "c_name", "c_custkey"))
    return rows.select("c_custkey", "c_name", "n_name", place.alias("place"))


@BOOK("""with s as (select p_partkey, (p_size % 20 + 1)::int as v, p_partkey % 3 as f, p_partkey % 2 = 0 as caster, p_partkey % 5 = 0 as chosen from part)
  select p_partkey, array_to_string(list_filter([case when f = 0 then 'ability' end, case when f = 1 and not chosen then 'subclass' end, case when caster and least((v + 1) // 2, 9) > least(v // 2, 9) then 'spells' end], lambda x: x is not null), ',') as choices from s""")
def level_choices(s, d):
    """Parts as heroes that reach a level: what it leaves to choose."""
    k = F.col("p_partkey")
    gained = F.when(k % 3 == 0, F.array(F.lit("Ability Score Improvement"))).when(k % 3 == 1, F.array(F.lit("x"), F.lit("Martial archetype feature"))).otherwise(F.array(F.lit("Rage")))
    choices = A.level_choices((F.col("p_size") % 20 + 1).cast("int"), gained, F.lit("Martial Archetype"), F.when(k % 5 == 0, "Champion"), k % 2 == 0)
    return table(s, d, "part").select("p_partkey", F.array_join(choices, ",").alias("choices"))


@BOOK("""select p_brand as slug, count(*) as records, case when p_brand in (select p_brand from part where p_partkey % 50 = 7) then 2 else 1 end::int as read_at from part group by 1""")
def cached_loads(s, d):
    """Parts as documents that are loaded, patched here and there and loaded again: what has changed is read twice, all else once."""
    place = f"{shared_root(s)}/cached-{uuid.uuid4().hex}"
    id = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    part = table(s, d, "part").withColumn("slug", F.col("p_brand"))
    canonical.write_documents(part.select("slug", F.col("p_partkey").alias("ordinal"), F.to_json(F.struct(id.alias("id"), "p_name")).alias("record")), f"{place}/docs")
    canonical.cached_documents(s, f"{place}/docs", f"{place}/cache").count()
    canonical.patch_documents(s, f"{place}/docs", part.where("p_partkey % 50 = 7").select("slug", id.alias("id"), F.lit('{"more":"than before"}').alias("patch")))
    return canonical.cached_documents(s, f"{place}/docs", f"{place}/cache").groupBy("slug").agg(F.count("*").alias("records"), F.max("read_at").alias("read_at"))
