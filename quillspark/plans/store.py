"""Queries over the relational store: joins, latest rows, upserts, paging, rule arithmetic, limiters, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import curation as C
from ..operators import retrieval as R
from ..sources.tables import table
from ..streaming import limits


def _t(name):
    return lambda s, d: table(s, d, name)


_orders, _customer, _events, _part, _lines, _docs = map(_t, ("orders", "customer", "events", "part", "lineitem", "documents"))


def latest_per_group(s, d):
    """Each customer's last order; ties go to the larger key; customers without any keep nulls."""
    last = _orders(s, d).groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"))
    return _customer(s, d).select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.col("o.o_totalprice").alias("o_totalprice"))


def count_per_parent(s, d):
    n = _orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _customer(s, d).select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


def upsert(s, d):
    """New versions replace old rows by key: the old ones without a new version, and the new ones."""
    old = _part(s, d).select("p_partkey", "p_size")
    new = old.where("p_partkey % 7 = 0").withColumn("p_size", F.col("p_size") + 100)
    return old.join(new, "p_partkey", "left_anti").unionByName(new)


def cascade_delete(s, d):
    """Lines left when one segment's customers go with all their orders."""
    gone = _orders(s, d).join(_customer(s, d).where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return _lines(s, d).join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("lines"))


def dedup_groups(s, d):
    rows = _part(s, d).withColumn("key", F.lower(F.regexp_replace("p_name", r"[^\p{L}\p{Nd}]", "")))
    best = Window.partitionBy("key").orderBy(F.desc("p_retailprice"), "p_partkey")
    placed = rows.withColumn("place", F.row_number().over(best))
    return placed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") == 1, F.col("p_partkey"))).alias("winner")).where("n >= 2")


def hit_collapse(s, d):
    """The winner of each (type, brand) carries the best score of its group."""
    rows = _part(s, d).withColumn("best", F.max("p_retailprice").over(Window.partitionBy("p_type", "p_brand")))
    return C.winners(rows, ["p_type", "p_brand"], [F.desc("p_size"), F.col("p_partkey")]).select("p_type", "p_brand", "p_partkey", "best")


def interval_section_join(s, d):
    """Sections are intervals of sizes; each part belongs to the first that holds its size."""
    starts = s.createDataFrame([("tiny", 1), ("small", 10), ("middle", 20), ("large", 35)], "title string, start int")
    ends = starts.withColumn("stop", F.coalesce(F.lead("start").over(Window.orderBy("start")) - 1, F.lit(2147483647)))
    joined = _part(s, d).join(F.broadcast(ends), (F.col("start") <= F.col("p_size")) & (F.col("p_size") <= F.col("stop")))  # four rows
    return joined.groupBy("title").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


def initiative_order(s, d):
    """Rolls with nulls last, then modifier, player, order added, id."""
    rows = _events(s, d).select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.floor("value").cast("int") % 20).alias("roll"), (F.col("user_id") % 4).alias("modifier"), (F.col("event_id") % 2 == 0).alias("is_player"))
    place = Window.partitionBy("user_id").orderBy(F.col("roll").desc_nulls_last(), F.desc("modifier"), F.desc("is_player"), "event_id")
    return rows.select("event_id", "user_id", F.row_number().over(place).alias("place"))


def encounter(s, d):
    """Each order as an encounter: its lines are monsters, adjusted by the count's multiplier for a party of four."""
    lines = _lines(s, d).withColumn("xp", rules.challenge_xp(F.least(F.floor("l_quantity"), F.lit(30))))
    sums = lines.groupBy("l_orderkey").agg(F.count("*").alias("monsters"), F.sum("xp").alias("xp"))
    return sums.withColumn("adjusted", F.round(F.col("xp") * rules.encounter_multiplier(F.col("monsters"), F.lit(4)), 2))


def encounter_difficulty(s, d):
    """Each order as an encounter of a party of one to seven members, judged by both editions."""
    key, xp, monsters = F.col("l_orderkey"), F.col("xp"), F.col("monsters")
    rows = encounter(s, d).withColumn("levels", F.transform(F.sequence(F.lit(1), (F.pmod(key, F.lit(7)) + 1).cast("int")), lambda i: F.pmod(key + i, F.lit(20)) + 1))
    return rows.select("l_orderkey", rules.party_budget(F.col("levels"), 2).alias("hard_from"), rules.difficulty(xp, monsters, F.col("levels")).alias("earlier"), rules.difficulty(xp, monsters, F.col("levels"), later=True).alias("later"))


def caster_levels(s, d):
    p = _part(s, d)
    lv = [(F.col("p_partkey") % k).cast("int") for k in (11, 7, 5, 9)]
    return p.select("p_partkey", rules.caster_level(*lv).alias("caster_level"), rules.proficiency(F.col("p_size")).alias("proficiency"), rules.ability_modifier(F.col("p_size")).alias("modifier"))


def dice_parse(s, d):
    """NdS+M expressions built from line numbers; out of bounds gives null."""
    text = F.concat(F.col("l_linenumber"), F.lit("d"), (F.col("l_quantity") % 20 + 1).cast("int"), F.when(F.col("l_linenumber") > 3, F.concat(F.lit("+"), (F.col("l_partkey") % 2000).cast("string"))).otherwise(""))
    rows = _lines(s, d).select("l_orderkey", "l_linenumber", text.alias("dice"))
    pattern = r"^(\d+)d(\d+)([+-]\d+)?$"
    n, sides = (F.regexp_extract("dice", pattern, i).cast("int") for i in (1, 2))
    extra = F.coalesce(F.expr(rf"try_cast(nullif(regexp_extract(dice, '^(\\d+)d(\\d+)([+-]\\d+)?$', 3), '') as int)"), F.lit(0))
    ok = n.between(1, 100) & (F.abs(extra) <= 1000)
    return rows.select("l_orderkey", "l_linenumber", F.when(ok, n * (sides + 1) / 2 + extra).alias("average"))


def percentile_nearest_rank(s, d):
    """Nearest rank: the value at place ceil(p * n), from counts of values that are combined before their shuffle."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return _events(s, d).groupBy("event_type").agg(at("0.50").alias("p50"), at("0.95").alias("p95"))


def fuzzy_name_match(s, d):
    names = _customer(s, d).select(F.col("c_custkey").alias("id"), F.concat(F.lit("Suplier"), F.substring("c_name", 9, 20)).alias("name"))
    return C.fuzzy_matches(names, table(s, d, "supplier").select(F.col("s_name").alias("name")))


def full_outer_coverage(s, d):
    roster = _lines(s, d).where("l_returnflag = 'R'").select(F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("key"))
    held = _lines(s, d).where("l_returnflag = 'A'").select(F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("key"))
    return C.coverage(roster, held, "key", "kind")


QUERIES = {
    "latest_per_group": latest_per_group,
    "count_per_parent": count_per_parent,
    "ownership_semi": lambda s, d: _orders(s, d).join(_customer(s, d).where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey"),
    "orphan_anti": lambda s, d: _customer(s, d).join(_orders(s, d).where("o_orderstatus = 'F' and o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"),
    "hero_campaign_join": lambda s, d: _customer(s, d).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name"),
    "upsert_by_key": upsert,
    "cascade_delete": cascade_delete,
    "dedup_groups": dedup_groups,
    "dedup_winner": lambda s, d: C.winners(_part(s, d), ["p_type"], [F.desc("p_retailprice"), F.desc(F.length("p_name")), F.col("p_partkey")]).select("p_type", "p_partkey"),
    "hit_collapse": hit_collapse,
    "interval_section_join": interval_section_join,
    "carry_forward_category": lambda s, d: C.carried_forward(_events(s, d), "user_id", ["ts", "event_id"], F.when(F.col("event_type") != "view", F.col("event_type")), "category").select("event_id", "category"),
    "page_block_order": lambda s, d: table(s, d, "conversations").where("trim(text) <> ''").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("block_order")),
    "chat_last_n": lambda s, d: table(s, d, "conversations").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 2").select("conv_id", "turn", "role"),
    "initiative_order": initiative_order,
    "encounter_multiplier_class": encounter,
    "encounter_difficulty": encounter_difficulty,
    "caster_level": caster_levels,
    "dice_parse": dice_parse,
    "percentile_nearest_rank": percentile_nearest_rank,
    "review_queue_paging": lambda s, d: R.page(table(s, d, "labels").where("quality = 0"), ["doc_id"], 10, skip=10),
    "scope_zero_counts": lambda s, d: s.createDataFrame([(f"src{i}",) for i in range(25)], "source string").join(_docs(s, d).groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n")),
    "union_case_insensitive": lambda s, d: _part(s, d).select(F.lower("p_brand").alias("k")).unionByName(_part(s, d).select(F.upper("p_brand").alias("k"))).select(F.lower("k").alias("k")).distinct(),
    "json_field_extract": lambda s, d: _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "name_slug": lambda s, d: _part(s, d).select("p_partkey", F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug")),
    "jaccard_suggest": lambda s, d: _part(s, d).select("p_partkey", F.split("p_type", " ").alias("a"), F.split(F.lit("STANDARD BRASS TIN"), " ").alias("b")).select("p_partkey", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("similarity")).where("similarity > 0.2").orderBy(F.desc("similarity"), "p_partkey").limit(3),
    "fuzzy_name_match": fuzzy_name_match,
    "full_outer_coverage": full_outer_coverage,
    "numeric_noise_filter": lambda s, d: _docs(s, d).where((F.length("text") >= 40) & (F.floor(F.regexp_count("text", F.lit(r"\p{L}")) * 100 / F.length("text")) >= 40)).select("doc_id"),
    "chunk_split": lambda s, d: C.chunks(_docs(s, d)).select("doc_id", "chunk_index", F.length("chunk").alias("chunk_chars")),
    "html_links": lambda s, d: table(s, d, "pages").select("page_id", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links")),
    "block_point_id": lambda s, d: _docs(s, d).select("doc_id", F.substring(F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256), 1, 32).alias("point_id")),
    "host_allow_list": lambda s, d: table(s, d, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).where(F.col("host").endswith(".example.com") | (F.col("host") == "example.com")).select("page_id", "host"),
    "fixed_window_limiter": limits.fixed_windows,
    "sliding_window_limiter": limits.sliding_counts,
    "queue_dedup_stream": limits.queue_stream,
}


def _sections(s, d):
    rows = _lines(s, d).select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity")).cast("int").alias("page"))
    return C.sessions(rows, "l_orderkey", "l_linenumber", "page", 3).groupBy("l_orderkey", "island").agg(F.count("*").alias("blocks"), F.min("page").alias("first_page"))


QUERIES["gaps_islands_sections"] = _sections


def _stop(first: str) -> str:
    """Where a window of a text of n characters ends, in SQL."""
    end = f"least({first} + 800, n)"
    back = f"strpos(reverse(substr(x, {end} - 199, 200)), ' ')"
    return f"case when {end} < n and {back} > 0 and {end} - {back} > {first} + 100 then {end} - {back} else {end} end"


_EASY, _MEDIUM, _HARD, _DEADLY = (str([row[i] for row in rules.BUDGETS_2014]) for i in range(4))
_LATER_EASY, _LATER_MEDIUM, _LATER_HARD = (str([row[i] for row in rules.BUDGETS_2024]) for i in range(3))
_XP = "[" + ",".join(str(rules.CR_XP[float(i)]) for i in range(1, 31)) + "]"
ORACLES = {
    "latest_per_group": "select c_custkey, o_orderkey, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) on c_custkey = o_custkey and k = 1",
    "count_per_parent": "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders from customer",
    "ownership_semi": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)",
    "orphan_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_totalprice > 150000)",
    "hero_campaign_join": "select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey",
    "upsert_by_key": "select p_partkey, case when p_partkey % 7 = 0 then p_size + 100 else p_size end as p_size from part",
    "cascade_delete": "select l_returnflag, count(*) as lines from lineitem where l_orderkey not in (select o_orderkey from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING') group by 1",
    "dedup_groups": r"select key, count(*) as n, arg_min(p_partkey, (-p_retailprice, p_partkey)) as winner from (select *, lower(regexp_replace(p_name, '[^\p{L}\p{Nd}]', '', 'g')) as key from part) group by 1 having count(*) >= 2",
    "dedup_winner": "select p_type, p_partkey from (select *, row_number() over (partition by p_type order by p_retailprice desc, length(p_name) desc, p_partkey) as k from part) where k = 1",
    "hit_collapse": "select p_type, p_brand, p_partkey, best from (select *, row_number() over (partition by p_type, p_brand order by p_size desc, p_partkey) as k, max(p_retailprice) over (partition by p_type, p_brand) as best from part) where k = 1",
    "interval_section_join": "select case when p_size < 10 then 'tiny' when p_size < 20 then 'small' when p_size < 35 then 'middle' else 'large' end as title, count(*) as parts, min(p_partkey) as first_part from part group by 1",
    "carry_forward_category": "select event_id, last_value(case when event_type <> 'view' then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as category from events",
    "gaps_islands_sections": "with p as (select l_orderkey, l_linenumber, floor(l_quantity)::int as page from lineitem), n as (select *, case when page - lag(page) over (partition by l_orderkey order by l_linenumber, page) > 3 then 1 else 0 end as new from p), i as (select *, sum(new) over (partition by l_orderkey order by l_linenumber, page rows unbounded preceding)::bigint as island from n) select l_orderkey, island, count(*) as blocks, min(page) as first_page from i group by 1, 2",
    "page_block_order": "select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::int as block_order from conversations where trim(text) <> ''",
    "chat_last_n": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 2",
    "initiative_order": "with r as (select event_id, user_id, case when event_id % 5 <> 0 then floor(value)::int % 20 end as roll, user_id % 4 as m, event_id % 2 = 0 as pl from events) select event_id, user_id, row_number() over (partition by user_id order by roll desc nulls last, m desc, pl desc, event_id)::int as place from r",
    "encounter_multiplier_class": f"with s as (select l_orderkey, count(*) as monsters, sum(({_XP})[least(floor(l_quantity), 30)::int])::bigint as xp from lineitem group by 1) select l_orderkey, monsters, xp, round(xp * case when monsters >= 15 then 4.0 when monsters >= 11 then 3.0 when monsters >= 7 then 2.5 when monsters >= 3 then 2.0 when monsters >= 2 then 1.5 else 1.0 end::double, 2) as adjusted from s",
    "encounter_difficulty": f"""with s as (select l_orderkey, count(*) as monsters, sum(({_XP})[least(floor(l_quantity), 30)::int])::bigint as xp, l_orderkey % 7 + 1 as party from lineitem group by 1),
        b as (select l_orderkey, sum(({_EASY})[v]) as e, sum(({_MEDIUM})[v]) as m, sum(({_HARD})[v])::bigint as h, sum(({_DEADLY})[v]) as d, sum(({_LATER_EASY})[v]) as le, sum(({_LATER_MEDIUM})[v]) as lm, sum(({_LATER_HARD})[v]) as lh from (select l_orderkey, ((l_orderkey + unnest(range(1, party + 1))) % 20 + 1)::int as v from s) group by 1),
        k as (select *, case when monsters >= 15 then 6 when monsters >= 11 then 5 when monsters >= 7 then 4 when monsters >= 3 then 3 when monsters >= 2 then 2 else 1 end + case when party < 3 then 1 when party > 5 then -1 else 0 end as i from s),
        a as (select *, round(xp * [1.0, 1.5, 2.0, 2.5, 3.0, 4.0][greatest(1, least(6, i))]::double) as adjusted from k join b using (l_orderkey))
        select l_orderkey, h as hard_from, case when adjusted >= d then 'Deadly' when adjusted >= h then 'Hard' when adjusted >= m then 'Medium' when adjusted >= e then 'Easy' else 'Trivial' end as earlier,
            case when xp >= lh then 'Hard' when xp >= lm then 'Medium' when xp >= le then 'Easy' else 'Trivial' end as later from a""",
    "caster_level": "select p_partkey, (p_partkey % 11 + p_partkey % 7 // 2 + (p_partkey % 5 + 1) // 2 + p_partkey % 9 // 3)::int as caster_level, (2 + (greatest(1, p_size) - 1) // 4)::int as proficiency, floor((p_size - 10) / 2.0)::int as modifier from part",
    "dice_parse": "with d as (select l_orderkey, l_linenumber, l_linenumber as n, (l_quantity % 20 + 1)::int as sides, case when l_linenumber > 3 then l_partkey % 2000 else 0 end as extra from lineitem) select l_orderkey, l_linenumber, case when n between 1 and 100 and extra <= 1000 then n * (sides + 1) / 2 + extra end::double as average from d",
    "percentile_nearest_rank": "with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as k, count(*) over (partition by event_type) as n from events) select event_type, max(value) filter (where k = ceil(50 * n / 100)) as p50, max(value) filter (where k = ceil(95 * n / 100)) as p95 from r group by 1",
    "review_queue_paging": "select doc_id, quality, toxic, count(*) over () as total from labels where quality = 0 order by doc_id limit 10 offset 10",
    "scope_zero_counts": "select 'src' || i as source, (select count(*) from documents where source = 'src' || i) as n from range(25) t(i)",
    "union_case_insensitive": "select distinct lower(p_brand) as k from part",
    "json_field_extract": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "name_slug": "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part",
    "jaccard_suggest": "with s as (select p_partkey, string_split(p_type, ' ') as a, ['STANDARD', 'BRASS', 'TIN'] as b from part) select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity from s where len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.2 order by 2 desc, 1 limit 3",
    "fuzzy_name_match": "with p as (select id, name, s_name as match, round(1 - levenshtein(name, s_name) / greatest(length(name), length(s_name)), 6) as ratio from (select c_custkey as id, 'Suplier' || substr(c_name, 9, 20) as name from customer), supplier where abs(length(name) - length(s_name)) <= 2) select id, name, match, ratio from (select *, row_number() over (partition by id order by ratio desc, match) as k from p where ratio >= 0.9) where k = 1",
    "full_outer_coverage": "with r as (select distinct l_linestatus as kind, l_partkey as key from lineitem where l_returnflag = 'R'), h as (select distinct l_linestatus as kind, l_partkey as key from lineitem where l_returnflag = 'A'), b as (select coalesce(r.kind, h.kind) as kind, r.key as rk, h.key as hk from r full join h on r.kind = h.kind and r.key = h.key) select kind, count(*) filter (where rk is not null and hk is not null) as present, count(*) filter (where hk is null) as missing, count(*) filter (where rk is null) as extra, case when count(rk) = 0 then 100.0 else round_even(100.0::double * count(*) filter (where rk is not null and hk is not null) / count(rk), 1) end as percent from b group by 1",
    "numeric_noise_filter": r"select doc_id from documents where length(text) >= 40 and floor(len(regexp_extract_all(text, '\p{L}')) * 100 / length(text)) >= 40",
    "chunk_split": f"""with recursive t as (select doc_id, coalesce(text, '') as x, length(coalesce(text, '')) as n from documents), c as (
        select doc_id, 0 as chunk_index, 0 as first, {_stop('0')} as stop from t
        union all select doc_id, chunk_index + 1, greatest(first + 1, stop - 100), {_stop('greatest(first + 1, stop - 100)')} from c join t using (doc_id) where stop < n)
      select doc_id, chunk_index::int as chunk_index, (stop - first)::int as chunk_chars from c""",
    "html_links": "select page_id, ((length(html) - length(replace(html, '<a href=', ''))) // 8)::bigint as links from pages",
    "block_point_id": "select doc_id, substr(sha256(source || doc_id), 1, 32) as point_id from documents",
    "host_allow_list": "with h as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages) select page_id, host from h where host like '%.example.com' or host = 'example.com'",
    "sliding_window_limiter": limits.SLIDING_SQL,
    "fixed_window_limiter": limits.FIXED_SQL,
    "queue_dedup_stream": limits.QUEUE_SQL,
}
