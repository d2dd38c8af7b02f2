"""Queries over records kept as JSON, made of the given tables: merges, walks, tables, rosters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontree as J
from ..operators import rosters as O
from ..sources.tables import table
from .book import Book

BOOK = Book()


def _part(s, d) -> DataFrame:
    return table(s, d, "part")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _got(column: str, *paths: str) -> list[Column]:
    return [F.get_json_object(column, f"$.{p}").alias(p.replace(".", "_")) for p in paths]


@BOOK("""select p_partkey, upper(p_name) as name, case when p_partkey % 3 = 0 then p_size else p_size + 1 end::varchar as size, 'c' as entries, p_brand as meta_brand, '' as meta_x, '1' as meta_y,
  case when p_partkey % 2 = 0 then p_type end as extra, null::varchar as fluffEntries from part""")
def json_deep_merge(s, d):
    k = F.col("p_partkey")
    canonical = _json(name=F.col("p_name"), size=F.col("p_size"), entries=F.lit("c"), meta=F.struct(F.col("p_brand").alias("brand"), F.lit("").alias("x")))
    existing = _json(name=F.upper("p_name"), size=F.when(k % 3 != 0, F.col("p_size") + 1), entries=F.lit("e"), meta=F.struct(F.lit("").alias("brand"), F.lit(1).alias("y")), fluffEntries=F.lit("no"), extra=F.when(k % 2 == 0, F.col("p_type")).otherwise(""))
    merged = _part(s, d).select("p_partkey", J.arrow(J.deep_merge, "string")(canonical, existing).alias("m"))
    return merged.select("p_partkey", *_got("m", "name", "size", "entries", "meta.brand", "meta.x", "meta.y", "extra", "fluffEntries"))


@BOOK("""select o_custkey, count(*)::varchar as n, count(distinct o_orderpriority)::varchar as named, arg_min(o_orderkey, o_orderkey)::varchar as first
  from orders group by 1 having count(*) > 1""")
def json_partials_merge(s, d):
    """Each order as what one chunk gave of its customer: plain items run together, items of one name stay once, the first scalar stays."""
    part = _json(first=F.col("o_orderkey"), gone=F.lit(None).cast("string"), n=F.array("o_orderkey"), named=F.array(F.struct(F.col("o_orderpriority").alias("name"))))
    parts = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))).alias("ps")).where("size(ps) > 1")
    text = F.concat(F.lit("["), F.array_join(F.transform("ps", lambda x: x["p"]), ","), F.lit("]"))
    merged = parts.select("o_custkey", J.arrow(J.merge_partials, "string")(text).alias("m"))
    many = lambda key: F.json_array_length(F.get_json_object("m", f"$.{key}")).cast("string").alias(key)
    return merged.select("o_custkey", many("n"), many("named"), *_got("m", "first"))


@BOOK("""select p_partkey, case when p_partkey % 3 = 0 then p_size else -1 end::varchar as level, p_type as school, case when p_partkey % 3 = 0 then '["level","school"]' else '["school"]' end as filled, p_partkey % 3 = 0 or p_partkey % 4 <> 0 as changed from part""")
def json_field_fill(s, d):
    """Spells: ``level`` is the record's own unless a roster filled it before; ``school`` was filled with the roster's value in every fourth."""
    k = F.col("p_partkey")
    noted = F.when(k % 3 == 0, F.array(F.lit("level"), F.lit("school"))).otherwise(F.array(F.lit("school")))
    fields = F.to_json(F.struct(F.lit(-1).alias("level"), F.when(k % 4 == 0, F.col("p_type")).otherwise("old").alias("school"), noted.alias(J.FILLED)))
    roster = _json(level=F.col("p_size"), school=F.col("p_type"), page=F.lit(3))
    fill = J.arrow(lambda a, b: dict(zip(("fields", "changed"), J.filled(a, b, "Spell"))), "string")
    rows = _part(s, d).select("p_partkey", fill(fields, roster).alias("m"))
    return rows.select("p_partkey", F.get_json_object("m", "$.fields.level").alias("level"), F.get_json_object("m", "$.fields.school").alias("school"), F.get_json_object("m", f"$.fields.{J.FILLED}").alias("filled"), (F.get_json_object("m", "$.changed") == "true").alias("changed"))


@BOOK("select p_partkey, p_name as name, 7 as page, p_size as size from part")
def json_shallow_merge(s, d):
    """Maps of top-level fields: the patch's values win, others stay."""
    old = F.create_map(F.lit("name"), F.col("p_name"), F.lit("page"), F.lit("1"))
    patch = F.create_map(F.lit("page"), F.lit("7"), F.lit("size"), F.col("p_size").cast("string"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(patch, k)), patch)
    return _part(s, d).select("p_partkey", merged["name"].alias("name"), merged["page"].cast("int").alias("page"), merged["size"].cast("int").alias("size"))


@BOOK("""with l as (select p_partkey, unnest(['fields.a', 'fields.b[0]', 'fields.b[1].c']) as path, unnest(['brand.spell.x' || (p_partkey % 50), p_name, 'brand.item.x' || p_partkey]) as value from part)
  select p_partkey, path, value from l where path <> 'fields.b[0]' and not (path = 'fields.a' and p_partkey % 50 < 20)""")
def dangling_references(s, d):
    """Strings within a record that look like ids of records, and are none."""
    k = F.col("p_partkey")
    fields = _json(a=F.concat(F.lit("brand.spell.x"), (k % 50).cast("string")), b=F.array(F.to_json(F.struct(F.col("p_name").alias("n")))))
    fields = F.concat(F.lit('{"a":"brand.spell.x'), (k % 50).cast("string"), F.lit('","b":["'), F.col("p_name"), F.lit('",{"c":"brand.item.x'), k.cast("string"), F.lit('"}]}'))
    ids = s.range(20).select(F.concat(F.lit("brand.spell.x"), F.col("id").cast("string")).alias("id"))
    return O.dangling(_part(s, d).select("p_partkey", fields.alias("fields")), "p_partkey", "fields", ids)


@BOOK("select p_partkey, p_name as caption, 'Size | ' || p_type as columns, p_size::varchar || ' | a' as first_row, 2 as tables from part")
def captioned_tables(s, d):
    inner = '{"type":"table","caption":"In","colLabels":[],"rows":[]}'
    entity = F.concat(F.lit('{"x":[{"type":"table","caption":"'), "p_name", F.lit('","colLabels":["{@b Size}","'), "p_type", F.lit('"],"rows":[['), F.col("p_size").cast("string"), F.lit(',"{@i a|b}"]],"more":' + inner + '},{"type":"table","rows":[]}]}'))
    found = _part(s, d).select("p_partkey", J.arrow(J.captioned_tables, "array<struct<caption:string,columns:array<string>,rows:array<array<string>>>>")(entity).alias("t"))
    t = F.col("t")[0]
    return found.select("p_partkey", t["caption"].alias("caption"), F.array_join(t["columns"], " | ").alias("columns"), F.array_join(t["rows"][0], " | ").alias("first_row"), F.size("t").alias("tables"))


@BOOK("""select p_partkey, case when p_partkey % 3 = 2 then null else '{"n":"' || p_name || '","q":"a}b\\"]"}' end as json from part""")
def partial_json(s, d):
    """Answers cut off at different places."""
    k = F.col("p_partkey")
    good = F.concat(F.lit('{"n":"'), "p_name", F.lit('","q":"a}b\\"]"}'))
    raw = F.when(k % 3 == 0, F.concat(F.lit("  "), good, F.lit(' {"cut": [1, '))).when(k % 3 == 1, good).otherwise(F.concat(F.lit("no json ["), "p_name"))
    return _part(s, d).select("p_partkey", F.udf(J.recovered, "string", useArrow=True)(raw).alias("json"))


@BOOK("select p_partkey, 'F' || p_partkey as name, p_brand as source, p_size::int as level from part where p_partkey % 4 <> 0 and p_partkey % 4 <> 3")
def feature_references(s, d):
    k = F.col("p_partkey")
    ref = F.concat_ws("|", F.concat(F.lit(" F"), k.cast("string"), F.lit(" ")), F.when(k % 4 != 0, F.lit("Class")), *[F.when(k % 4 != 0, F.lit("PHB"))], F.col("p_brand"), F.when(k % 4 == 3, F.lit("x")).otherwise(F.col("p_size").cast("string")))
    refs = F.concat(F.lit('[{"classFeature":"'), ref, F.lit('"},7]'))
    found = J.arrow(lambda r: J.features(r, "classFeature"), "array<struct<name:string,source:string,level:int>>")
    return _part(s, d).select("p_partkey", F.inline(found(refs)))


@BOOK("""select p_partkey, case p_partkey % 4 when 0 then 'dex,str' when 1 then 'cha,con' when 2 then '' else '' end as abilities from part""")
def race_abilities(s, d):
    k = F.col("p_partkey")
    fields = F.when(k % 4 == 0, '{"Ability":[{"str":2,"DEX":1,"luck":3}]}').when(k % 4 == 1, '{"ability":[{"choose":{"from":["con","Cha","x"]}},5]}').when(k % 4 == 2, '{"ability":{"str":1}}').otherwise("[]")
    return _part(s, d).select("p_partkey", F.array_join(J.arrow(J.boosted, "array<string>")(fields), ",").alias("abilities"))


_VARIANTS = [
    {"requires": [{"type": "ECONOMY|X"}, {"big": True}], "excludes": {"brand": ["Brand#1", "Brand#2"]}, "inherits": {"namePrefix": "+1 ", "source": "DMG", "rarity": "rare", "bonus": 1, "entries": ["{=baseName/l} gets {=bonus} and {=none}"]}},
    {"requires": {"size": [11, 28]}, "inherits": {"nameSuffix": " of War"}},
    {"requires": {"size": 1}},
]


@BOOK("""select p_partkey, 0 as variant, '+1 ' || p_name as name, p_name || ' gets 1 and ' as entry from part where (p_type = 'ECONOMY' or p_size > 40) and p_brand not in ('Brand#1', 'Brand#2')
  union all select p_partkey, 1, p_name || ' of War', null from part where p_size in (11, 28)""")
def variant_items(s, d):
    base = _json(name=F.col("p_name"), type=F.concat("p_type", F.lit("|PHB")), brand=F.array("p_brand"), size=F.col("p_size"), big=F.when(F.col("p_size") > 40, True).otherwise(False))
    made = O.variant_items(_part(s, d).select("p_partkey", base.alias("base")), "base", _VARIANTS)
    return made.select("p_partkey", "variant", *_got("item", "name"), F.get_json_object("item", "$.entries[0]").alias("entry"))


@BOOK("""with r as (select p_partkey, p_name as name, p_brand as source, case p_partkey % 4 when 0 then 'Item' when 1 then 'Spell' when 2 then 'Subclass' else 'Feat' end as type, case p_partkey % 4 when 0 then 4 when 1 then 0 when 2 then 2 else 8 end as roster from part where not (p_partkey % 4 = 3 and p_size > 25)),
  i as (select lower(name) as k, upper(source) as s, arg_max(type, (roster, source, p_partkey)) as type from r group by 1, 2) select k as name_key, s as source_key, type from i""")
def roster_type_lookup(s, d):
    """Rosters read from JSON files; of equal names and sources, the last record's type stands."""
    return O.type_lookup(_rosters(s, d))


@BOOK("""with r as (select p_partkey, p_name, p_brand, p_type, case p_partkey % 4 when 0 then 'Item' when 1 then 'Spell' when 2 then 'Subclass' else 'Feat' end as type, case p_partkey % 4 when 0 then 4 when 1 then 0 when 2 then 2 else 8 end as roster from part where not (p_partkey % 4 = 3 and p_size > 25)),
  k as (select lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) as key, type, p_name as name, roster, p_brand, p_partkey, 0 as second from r union all select lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')), type, p_name, roster, p_brand, p_partkey, 1 from r where type = 'Subclass'),
  f as (select key, type, arg_min(name, (roster, p_brand, p_partkey, second)) as name, min((roster, p_brand, p_partkey, second)) as turn from k group by 1, 2)
  select key, type, name, turn = min(turn) over (partition by key) as first from f""")
def roster_name_index(s, d):
    """Each type that a normalised name has, with its first record's name; subclasses also by their short name, feats without fighting styles."""
    return O.name_index(_rosters(s, d))


@BOOK("select count(*) as records, count(*) filter (where p_partkey % 4 = 0) as items, sum(p_size)::bigint as sizes from part where not (p_partkey % 4 = 3 and p_size > 25)")
def roster_import(s, d):
    """All rosters of a folder by registry of file pattern, type and array key; sidecar files are left out."""
    return _rosters(s, d).agg(F.count("*").alias("records"), F.count_if(F.col("type") == "Item").alias("items"), F.sum(F.get_json_object("record", "$.size").cast("long")).alias("sizes"))


def _rosters(s, d) -> DataFrame:
    """The parts as rosters of a brand each, written as JSON files the way such rosters come, and read through the registry."""
    k = F.col("p_partkey")
    key = F.element_at(F.array(*map(F.lit, ("item", "spell", "subclass", "feat"))), (k % 4 + 1).cast("int"))
    record = _json(name=F.col("p_name"), source=F.col("p_brand"), size=F.col("p_size"), shortName=F.col("p_type"), category=F.when(F.col("p_size") > 25, "FS").otherwise("G"))
    return O.read_rosters(s, O.write_rosters(_part(s, d).select(key.alias("key"), F.col("p_brand").alias("source"), k.alias("ordinal"), record.alias("r"))))


@BOOK("""select case p_partkey % 4 when 0 then 'item' when 1 then 'spell' when 2 then 'subclass' else 'feat' end || '.' || p_name as id, max(p_partkey)::varchar as last from part where p_brand = 'Brand#7' and not (p_partkey % 4 = 3 and p_size > 25) group by 1""")
def roster_by_id(s, d):
    """One source's records by id; the last of an id stands."""
    k = F.col("p_partkey")
    key = F.element_at(F.array(*map(F.lit, ("item", "spell", "subclass", "feat"))), (k % 4 + 1).cast("int"))
    record = _json(name=F.col("p_name"), source=F.col("p_brand"), n=k, category=F.when(F.col("p_size") > 25, "FS"))
    rosters = O.read_rosters(s, O.write_rosters(_part(s, d).select(key.alias("key"), F.col("p_brand").alias("source"), k.alias("ordinal"), record.alias("r"))))
    return O.by_id(rosters, "brand#7", F.concat_ws(".", F.lower("type"), F.col("name"))).select("id", F.get_json_object("record", "$.n").alias("last"))


@BOOK("""with x as (select p_brand as source, p_name as spell, ['Wizard', 'Bard', 'Cleric'][p_partkey % 3 + 1] as class from part where p_size < 25),
  e as (select spell, source, list(distinct class) as c from x group by 1, 2), n as (select spell, list(distinct class) as c from x group by 1)
  select p_partkey, list_contains(coalesce(e.c, n.c), 'Bard') as castable from part p left join e on e.spell = p.p_name and e.source = p.p_brand left join n on n.spell = p.p_name where coalesce(e.c, n.c) is not null""")
def spell_class_join(s, d):
    """Classes by name and source; where that pair is unknown, by name alone."""
    p = _part(s, d)
    known = p.where("p_size < 25").select(F.col("p_brand").alias("source"), F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, ("Wizard", "Bard", "Cleric"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("class"))
    held = O.with_classes(p.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("source")), known)
    return held.where("classes is not null").select("p_partkey", F.array_contains("classes", "Bard").alias("castable"))


@BOOK("""select r_name as id, r_regionkey as year, case when r_name like 'X%' then substr(r_name, 2) else r_name end || '''' || lpad((r_regionkey % 100)::varchar, 2, '0') as abbr from (select r_name, 2010 + r_regionkey * 4 as r_regionkey from region union all select 'XGE', 2017)""")
def book_registry(s, d):
    """Books with their year and short name, which drops a leading X."""
    regions = table(s, d, "region").select(F.col("r_name").alias("id"), (2010 + F.col("r_regionkey") * 4).cast("int").alias("y")).unionByName(s.createDataFrame([("XGE", 2017)], "id string, y int"))
    return O.book_registry(regions.select(_json(id=F.col("id"), name=F.col("id"), published=F.concat(F.col("y").cast("string"), F.lit("-05-01"))).alias("book"))).select("id", "year", "abbr")


@BOOK("select intent, key from (values ('core books'), (' 2014 '), ('5.5e'), ('srd'), ('what')) i(intent), (select r_name as key, 2010 + r_regionkey * 4 as y, r_regionkey from region union all select 'srd52', 1900, 99) where (intent = 'core books' and r_regionkey = 0) or (trim(intent) = '2014' and y < 2020 and y > 1900) or (intent = '5.5e' and y >= 2024) or (intent = 'srd' and key = 'srd52')")
def intent_books(s, d):
    """The books that an intent names."""
    books = table(s, d, "region").select(F.col("r_name").alias("id"), (2010 + F.col("r_regionkey") * 4).alias("year"), F.when(F.col("r_regionkey") == 0, "Core").otherwise("setting").alias("group"))
    return O.books_of_intent(s.createDataFrame([(x,) for x in ("core books", " 2014 ", "5.5e", "srd", "what")], "intent string"), books).select("intent", F.col("id").alias("key"))


@BOOK("""with s as (select p_partkey, p_name, p_size, p_type, p_partkey % 4 as k from part) select p_partkey, case when k = 0 then 'Weapon' when k = 1 then 'Armor' else 'Item' end as kind from s where k <> 3""")
def base_item_partition(s, d):
    """Mundane items by kind: rarity none or missing, then weapon category, then armor type before its source."""
    k = F.col("p_partkey")
    item = F.when(k % 4 == 0, '{"weaponCategory":"simple","type":"LA"}').when(k % 4 == 1, '{"rarity":"None","type":"ha|XPHB"}').when(k % 4 == 2, '{"rarity":"none","type":"SCF"}').otherwise('{"rarity":"rare","type":"LA"}')
    rows = _part(s, d).select("p_partkey", item.alias("item"))
    return rows.where(O.is_mundane(F.col("item"))).select("p_partkey", O.base_kind(F.col("item")).alias("kind"))


@BOOK("""select p_partkey, case p_partkey % 5 when 0 then 0.125 when 1 then 0.5 when 2 then p_size::double else null end::double as cr, case when p_partkey % 3 = 0 then p_size end::int as spell_level, case p_partkey % 2 when 0 then 'fire' else 'cold' end as damage from part""")
def payload_flattening(s, d):
    """Index columns of records: challenge ratings as text, fraction or object; levels; damage from a list or an object."""
    k = F.col("p_partkey")
    cr = F.when(k % 5 == 0, '"1/8"').when(k % 5 == 1, '{"cr":"1/2","lair":"9"}').when(k % 5 == 2, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))).when(k % 5 == 3, '"Unknown"').otherwise("7")
    damage = F.when(k % 2 == 0, '"damageInflict":["fire","acid"]').otherwise('"damage":{"type":"cold"}')
    fields = F.concat(F.lit('{"cr":'), cr, F.when(k % 3 == 0, F.concat(F.lit(',"level":'), F.col("p_size").cast("string"))).otherwise(',"level":"3"'), F.lit(","), damage, F.lit("}"))
    f = _part(s, d).select("p_partkey", fields.alias("f"))
    return f.select("p_partkey", O.challenge_rating(F.col("f")).alias("cr"), O.spell_level(F.col("f")).alias("spell_level"), O.damage_types(F.col("f"))[0].alias("damage"))


@BOOK("""select p_partkey, case p_partkey % 4 when 0 then 'Armor,Item' when 1 then 'Item' when 2 then 'Weapon,MagicItem' else 'Item' end as kinds from part""")
def roster_guards(s, d):
    """Which rosters take an item; an armor code with a source is none here."""
    k = F.col("p_partkey")
    item = F.when(k % 4 == 0, '{"type":"la"}').when(k % 4 == 1, '{"type":"HA|XPHB","rarity":"None"}').when(k % 4 == 2, '{"weaponCategory":"simple","rarity":"rare"}').otherwise('{"rarity":"none"}')
    return _part(s, d).select("p_partkey", F.array_join(O.guarded(item), ",").alias("kinds"))


@BOOK("""select p_partkey, '[1,"x"]' as tags, p_name as name, p_size::varchar as size, null::varchar as wrong_kind, null::varchar as missing from part""")
def field_copies(s, d):
    f = F.concat(F.lit('{"tags":[1,"x"],"name":"'), "p_name", F.lit('","size":'), F.col("p_size").cast("string"), F.lit(',"nothing":null}'))
    rows = _part(s, d).select("p_partkey", f.alias("f"))
    got = lambda key, kind, name: O.copied(F.col("f"), key, kind).alias(name)
    return rows.select("p_partkey", got("tags", "array", "tags"), got("name", "string", "name"), got("size", "int", "size"), got("name", "array", "wrong_kind"), got("other", "any", "missing"))


@BOOK("""select p_partkey, case p_partkey % 5 when 0 then 'unreadable' when 1 then 'unknown version' when 2 then 'no book' else 'incomplete record' end as problem from part where p_partkey % 5 <> 4""")
def canonical_validation(s, d):
    """Documents of records checked as they are loaded."""
    k = F.col("p_partkey") % 5
    entity = F.when(k == 3, '{"id":"a.b.c","type":"Spell"}').otherwise('{"id":"a.b.c","type":"Spell","name":"N"}')
    text = F.when(k == 0, '{"schemaVersion":"1",').otherwise(F.concat(F.when(k == 1, '{"schemaVersion":"9"').otherwise('{"schemaVersion":"1"'), F.when(k == 2, "").otherwise(',"book":{"sourceBook":"B"}'), F.lit(',"entities":['), entity, F.lit("]}")))
    return O.validated(_part(s, d).select("p_partkey", text.alias("t")), "p_partkey", "t")


@BOOK("""with h as (select p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('block:' || p_partkey)) as g from part)
  select p_partkey, g[1:8] || '-' || g[9:12] || '-5' || g[14:16] || '-' || substr('89ab', strpos('0123456789abcdef', g[17]) % 4 + case when strpos('0123456789abcdef', g[17]) % 4 = 0 then 4 else 0 end, 1) || g[18:20] || '-' || g[21:32] as id from h""")
def name_uuids(s, d):
    return _part(s, d).select("p_partkey", O.name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("block:"), F.col("p_partkey").cast("string"))).alias("id"))


@BOOK("select 't' || p_partkey as id, case when p_partkey % 3 = 0 then 'resolution' else 'generic' end as source from part union all select 't' || p_partkey || '-spells', 'resolution' from part where p_partkey % 5 = 0")
def table_replacement(s, d):
    key = F.concat(F.lit("t"), F.col("p_partkey").cast("string"))
    generic = _part(s, d).select(key.alias("id"), F.lit("generic").alias("source"))
    made = _part(s, d).where("p_partkey % 3 = 0").select(key.alias("id"), F.lit("resolution").alias("source"))
    spells = _part(s, d).where("p_partkey % 5 = 0").select(F.concat(key, F.lit("-spells")).alias("id"), F.lit("resolution").alias("source"))
    return O.replaced_tables(generic, made.unionByName(spells), "id")


@BOOK("select doc_id, len(regexp_extract_all(substr(text, 1, 800), 'e'))::double as e, len(regexp_extract_all(substr(text, 1, 800), 'n'))::double as n from documents where text is not null")
def text_embeddings(s, d):
    """Vectors of a given embedder, here of letter counts; only a text's first 800 characters count."""
    rows = O.embedded(table(s, d, "documents").where("text is not null").select("doc_id", "text"), "text", _letter_counts)
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("e"), F.col("embedding")[1].cast("double").alias("n"))


def _letter_counts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(t.count("e")), float(t.count("n"))])


@BOOK("select p_partkey::varchar as hash, 2 as version, case when p_partkey % 3 = 0 then 'kept' else 'made of ' || p_name end as result from part")
def conversion_cache(s, d):
    """Results by content hash and converter version: kept ones are taken, those of older versions and unknown ones made anew."""
    files = _part(s, d).select(F.col("p_partkey").cast("string").alias("hash"), F.col("p_name").alias("content"))
    cache = files.where("cast(hash as int) % 3 <> 1").select("hash", F.when(F.col("hash").cast("int") % 3 == 0, 2).otherwise(1).alias("version"), F.lit("kept").alias("result"))
    return O.converted(files, cache, F.concat(F.lit("made of "), "content"), 2)
