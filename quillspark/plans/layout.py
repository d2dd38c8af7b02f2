"""Queries over the structure of books, on headings and items made of the given tables or of literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..operators import layout as S
from ..sources.tables import table
from .book import Book, literal

BOOK = Book()
WORDS = ["Spell Lists", "DRAGON lairs", "Class Features", "Using Equipment", "Traps", "Combat", "History of", "Personality", "Notes", "The Planes", "Backgrounds of", "Nine gods", "Treasure", "Races", "Chapter"]
def _head():
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS) + 1).cast("int")), "p_name")
_HEAD_SQL = f"({literal(WORDS)})[p_partkey % {len(WORDS)} + 1] || ' ' || p_name"


def _case(title: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({title}), '{'|'.join(words)}') then '{name}'" for name, words in L.CATEGORIES) + " else 'Rule' end"


_TYPE = "case c " + " ".join(f"when '{a}' then '{b}'" for a, b in L.RECORD_TYPES.items()) + " end"


@BOOK(f"select p_partkey, {_HEAD_SQL} as heading, {_case(_HEAD_SQL)} as category from part")
def heading_category(s, d):
    return table(s, d, "part").select("p_partkey", _head().alias("heading")).withColumn("category", L.heading_category(F.col("heading")))


_CONFUSED = "case c " + " ".join(f"when '{a}' then {literal(list(b))}" for a, b in L.CONFUSED.items()) + " else []::varchar[] end"


@BOOK(f"with h as (select p_partkey, {_case(_HEAD_SQL)} as c from part), l as (select p_partkey, list_concat([c], {_CONFUSED}, {literal(list(L.FREQUENT))}) as l from h) select p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as prior from l")
def heading_prior(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(L.category_prior(L.heading_category(_head())), ",").alias("prior"))


@BOOK(f"with b as (select p_partkey, p_name as title, {_HEAD_SQL} as parent from part) select p_partkey, case when {_case('title')} = 'Rule' and parent <> '' then {_case('parent')} else {_case('title')} end as category from b")
def bookmark_contents(s, d):
    return table(s, d, "part").select("p_partkey", S.bookmark_category(F.col("p_name"), _head()).alias("category"))


def _order_head():
    return F.element_at(F.array(*map(F.lit, WORDS)), (F.col("o_orderkey") % len(WORDS) + 1).cast("int"))
_ORDER_HEAD_SQL = f"({literal(WORDS)})[o_orderkey % {len(WORDS)} + 1]"


@BOOK(f"""with h as (select o_custkey, o_orderkey, {_ORDER_HEAD_SQL} as title, (o_orderkey % 400)::int as page from orders),
  t as (select *, {_case('title')} as c, row_number() over (partition by o_custkey order by o_orderkey)::int as place from h),
  f as (select o_custkey, place, title, coalesce(last_value(case when c <> 'Rule' then c end ignore nulls) over (partition by o_custkey order by place rows unbounded preceding), 'Rule') as category, page from t)
  select * from f union all select o_custkey, 0, 'Front Matter', 'Rule', 1 from f where place = 1 and page > 1""")
def full_heading_contents(s, d):
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey", _order_head().alias("text"), (F.col("o_orderkey") % 400).cast("int").alias("page"))
    return S.full_contents(rows, "o_custkey", ["o_orderkey"], "text", "page")


@BOOK(f"select o_orderkey, c as category from (select o_orderkey, {_case(_ORDER_HEAD_SQL)} as c from orders) where {_TYPE} is not null")
def confident_contents(s, d):
    return S.confident_contents(table(s, d, "orders").select("o_orderkey", _order_head().alias("text")), "text").select("o_orderkey", "category")


@BOOK("""select l_orderkey, l_linenumber, 'part ' || l_partkey || ' & more' as cell, l_quantity::int::varchar as amount from lineitem where l_orderkey % 3 <> 0""")
def html_table_rows(s, d):
    """Lines as tables of one row; every third has one column only and is no table."""
    cell = lambda c: F.concat(F.lit("<TD class='x'><b>"), c, F.lit("</b>\n</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("part&nbsp;"), F.col("l_partkey").cast("string"), F.lit(" &amp; more"))), F.when(F.col("l_orderkey") % 3 != 0, cell(F.col("l_quantity").cast("int").cast("string"))).otherwise(""), F.lit("</tr>"))
    head = F.when(F.col("l_orderkey") % 3 != 0, "<table><tr><th>Name</th><th>Amount</th></tr>").otherwise("<table><tr><th>Name</th></tr>")
    tables = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.column_of(L.table_cells, "array<array<string>>")(F.concat(head, row, F.lit("</table>"))).alias("cells"))
    return tables.where("cells is not null").select("l_orderkey", "l_linenumber", F.col("cells")[1][0].alias("cell"), F.col("cells")[1][1].alias("amount"))


def _item():
    return F.when(F.col("event_type") == "view", "section_header").when(F.col("event_type") == "error", "table").otherwise("text")


@BOOK("""with i as (select *, case when event_type = 'view' then 'section_header' when event_type = 'error' then 'table' else 'text' end as kind, case when event_type = 'view' then 'Heading ' || event_id when event_id % 7 = 0 then 'Caption ' || event_id else '' end as txt from events),
  h as (select *, sum(case when kind = 'section_header' then 1 else 0 end) over w as island, last_value(case when kind = 'section_header' then txt end ignore nulls) over w as heading from i window w as (partition by user_id order by event_id rows unbounded preceding)),
  n as (select *, sum(case when kind <> 'section_header' then 1 else 0 end) over (partition by user_id, island order by event_id rows unbounded preceding) - 1 as since, sum(case when kind = 'table' and event_id % 5 <> 0 then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as k from h)
  select user_id, event_id, case when txt <> '' then txt when heading is not null and since <= 10 then heading else 'Table ' || k end as name from n where kind = 'table' and event_id % 5 <> 0""")
def table_names(s, d):
    """Events as layout items; every fifth table is of one column and so none."""
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("Heading "), F.col("event_id").cast("string"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("Caption "), F.col("event_id").cast("string"))).otherwise("")
    markup = F.when(F.col("event_id") % 5 == 0, "<tr><td>a</td></tr><tr><td>b</td></tr>").otherwise("<tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr>")
    items = table(s, d, "events").select("user_id", "event_id", _item().alias("kind"), text.alias("text"), markup.alias("html"))
    return S.named_tables(items, "user_id", "event_id").select("user_id", "event_id", "name")


@BOOK("""with b as (select l_orderkey as book, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as place, l_returnflag as title, floor(l_quantity)::int as page from lineitem),
  r as (select *, sum(case when title = p then 0 else 1 end) over (partition by book order by place rows unbounded preceding) as run from (select *, lag(title) over (partition by book order by place) as p from b)),
  g as (select *, case when page - max(page) over (partition by book, run order by place rows between unbounded preceding and 1 preceding) > 3 then 1 else 0 end as gap from r),
  x as (select *, sum(gap) over (partition by book, run order by place rows unbounded preceding) as part from g)
  select book, any_value(title) as title, min(place) as first_place, min(page) as page, string_agg('p' || page, chr(10) || chr(10) order by place) as text from x group by book, run, part""")
def section_groups(s, d):
    by = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    blocks = table(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), *by, F.col("l_returnflag").alias("title"), F.floor("l_quantity").cast("int").alias("page"), F.concat(F.lit("p"), F.floor("l_quantity").cast("string")).alias("body"))
    return S.section_groups(blocks, "book", by, "title", "page", "body").drop("group")


@BOOK(f"""with c as (select o_orderkey, o_custkey as book, {_ORDER_HEAD_SQL} as title, case when o_custkey % 4 = 0 then 'Rule' else {_case(_ORDER_HEAD_SQL)} end as c from orders),
  t as (select *, {_TYPE} as type, bool_and({_TYPE} is null) over (partition by book) as failed, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) = 'chapter' as monster from c)
  select o_orderkey, coalesce(type, 'Monster') as type, case when type is null and monster then 'The Chapter' else title end as name from t where type is not null or monster or failed""")
def section_candidates(s, d):
    """Orders as sections of their customer's book; every fourth book has no typed section, and ``Chapter`` is a known monster."""
    rows = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("book"), _order_head().alias("title"))
    rows = rows.withColumn("category", F.when(F.col("book") % 4 == 0, "Rule").otherwise(L.heading_category(F.col("title"))))
    return S.candidates(rows, "category", "title", s.createDataFrame([("chapter", "The Chapter")], "key string, canonical string")).select("o_orderkey", "type", "name")


_NAMES = ["upper(p_name)", "p_name", "'f ' || p_name", "p_name || '... 3'", "replace(p_name, 'i', 'I')", "'X'"]


@BOOK(f"""with n as (select p_partkey, case p_partkey % 6 {' '.join(f'when {i} then {e}' for i, e in enumerate(_NAMES))} end as name from part),
  w as (select p_partkey, name, list_max(list_transform(string_split(replace(name, '-', ' '), ' '), lambda x: length(regexp_replace(regexp_replace(regexp_replace(x, '[^A-Za-z]', '', 'g'), '[A-Z]+', '1', 'g'), '[a-z]+', '0', 'g')))) as runs from n)
  select p_partkey, (length(name) > 1 and name = upper(name)) or regexp_matches(name, '(?i)(^| )[a-z] [a-z]') or contains(name, '...') or runs >= 3 as marks from w""")
def name_scanning_marks(s, d):
    name = F.expr(f"case p_partkey % 6 {' '.join(f'when {i} then {e}' for i, e in enumerate(_NAMES))} end")
    return table(s, d, "part").select("p_partkey", L.scanning_marks(name).alias("marks"))


@BOOK("select p_partkey, case when p_partkey % 2 = 0 then upper(p_name[1]) || p_name[2:] else p_name end as name from part")
def name_without_stat_line(s, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, " Medium humanoid (any race), any alignment").when(F.col("p_partkey") % 3 == 1, "  LARGE Dragon\nmore").otherwise("")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99))).otherwise(F.col("p_name"))
    return table(s, d, "part").select("p_partkey", L.without_stat_line(F.concat(name, tail)).alias("name"))


@BOOK("select p_partkey, p_name || ' of fire and (' || p_type || ')' as text from part")
def markup_stripped(s, d):
    text = F.concat(F.lit("{@item "), "p_name", F.lit("|PHB|x} of {@spell fire} and ({@b "), "p_type", F.lit("})"))
    return table(s, d, "part").select("p_partkey", L.without_markup(text).alias("text"))


_WORD_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: length(x) >= {}))"


@BOOK(f"""with r as (select o_orderkey, replace(lower(o_orderpriority), 'e', 'a') || case when o_orderkey % 3 = 0 then ' by ' || o_orderkey else '' end as said, o_orderkey // 10 || ' was ' || o_orderpriority || ' in ' || o_orderstatus as source from orders),
  w as (select o_orderkey, unnest({_WORD_SQL.format('said', 3)}) as v from r), s as (select o_orderkey, {_WORD_SQL.format('source', 1)} as src from r),
  m as (select o_orderkey, bool_and(len(list_filter(src, lambda b: v = b or levenshtein(v, b) <= greatest(1, least(length(v), length(b)) // 4))) > 0) as grounded from w join s using (o_orderkey) group by 1)
  select o_orderkey, coalesce(grounded, false) as grounded from orders left join m using (o_orderkey)""")
def grounding_by_words(s, d):
    """What is said of an order, misspelt and sometimes with its number, against the whole of its source."""
    k = F.col("o_orderkey")
    said = F.concat(F.replace(F.lower("o_orderpriority"), F.lit("e"), F.lit("a")), F.when(k % 3 == 0, F.concat(F.lit(" by "), k.cast("string"))).otherwise(""))
    source = F.concat(F.floor(k / 10).cast("string"), F.lit(" was "), "o_orderpriority", F.lit(" in "), "o_orderstatus")
    return table(s, d, "orders").select("o_orderkey", F.coalesce(S.grounded_in(said, source), F.lit(False)).alias("grounded"))


@BOOK("""with v as (select p_partkey, p_name as name, p_partkey % 5 = 0 as t0, case when p_partkey % 3 <> 0 then p_size / 50.0 end as score, case p_partkey % 4 when 0 then true when 1 then false end as judged, p_partkey % 7 <> 0 as enabled, case p_partkey % 6 when 0 then 'low' when 1 then 'high' end as conf from part),
  s as (select *, case when t0 then 'Grounded' when not enabled or score is null then 'Uncertain' when score >= 0.5 and judged is not null then case when judged then 'Grounded' else 'Ungrounded' end when score < 0.5 then 'Ungrounded' else 'Uncertain' end as status from v)
  select p_partkey, status, case when status = 'Ungrounded' then 'Ungrounded' when status = 'Uncertain' or coalesce(conf = 'low', false) then 'NeedsReview' else 'Accepted' end as disposition, case status when 'Ungrounded' then 'MarkUngrounded' when 'Grounded' then 'Promote' else 'LeaveFlagged' end as action from s""")
def grounding_verdicts(s, d):
    k = F.col("p_partkey")
    rows = table(s, d, "part").select("p_partkey", "p_name", (k % 5 == 0).alias("t0"), F.when(k % 3 != 0, F.col("p_size") / 50).alias("score"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("judged"), (k % 7 != 0).alias("enabled"), F.when(k % 6 == 0, "low").when(k % 6 == 1, "high").alias("conf"))
    rows = rows.withColumn("status", S.verdict(F.col("t0"), F.col("score"), 0.5, F.col("judged"), F.col("enabled")))
    return rows.select("p_partkey", "status", S.disposition(F.col("status"), F.col("p_name"), F.col("conf")).alias("disposition"), S.action(F.col("status"), F.col("p_name")).alias("action"))


@BOOK("""with n as (select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then p_name || ' x ray' else p_name end as name from part)
  select p_partkey, case when p_partkey % 3 = 0 then array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else name end as name, p_partkey % 3 = 1 as needs_review from n""")
def name_normalizer(s, d):
    """Names in capitals get title case; names that look misread are flagged; others stay."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" x ray"))).otherwise(F.col("p_name"))
    rows = table(s, d, "part").select("p_partkey", name.alias("name"))
    fixable = L.all_capitals(F.col("name")) & ~L.scanning_marks(F.lower("name"))
    return rows.select("p_partkey", F.when(fixable, L.title_case(F.col("name"))).otherwise(F.col("name")).alias("name"), (~fixable & L.scanning_marks(F.col("name"))).alias("needs_review"))


@BOOK("select doc_id, (case when length(text) // 4 <= 100 then 1 end)::int as chunks, length(text)::int as chars from documents where length(text) // 4 <= 100 and trim(text) <> ''")
def semantic_chunks_short(s, d):
    """Texts within the budget are one chunk, as they are."""
    cut = L.column_of(lambda t: L.semantic_chunks(t, 100), "array<string>")
    rows = table(s, d, "documents").where("floor(length(text) / 4) <= 100 and trim(text) <> ''").select("doc_id", cut(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.length(F.col("c")[0]).alias("chars"))


@BOOK("""with p as (select p_partkey, p_size, (row_number() over (order by p_partkey) - 1) // 50 as batch from part where p_partkey % 3 = 0 and p_partkey % 2 = 0) select batch, count(*) as records, count(*) filter (where p_size > 25) as promoted from p group by 1""")
def reground_batches(s, d):
    """Records still under review graded anew, in batches of fifty after which a checkpoint is written; those that one lists are left out."""
    rows = table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_size") > 25).alias("grounded"))
    done = table(s, d, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.lit("extracted").alias("state"))
    return S.reground(rows, done, "id").groupBy("batch").agg(F.count("*").alias("records"), F.count_if(F.col("action") == "Promote").alias("promoted"))
