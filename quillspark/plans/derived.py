"""Rule functions over rows made of the given tables, each with SQL that works out what they give in another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import advice as A
from ..functions import jsontree as J
from ..functions import layout as L
from ..functions.text import term_hash, tokens
from ..operators import curation as C
from ..operators import layout as S
from ..operators import mutations as M
from ..operators import rendering
from ..operators import rosters as O
from ..sources.tables import table
from .book import Book, literal
from .search import _HASH, _TOK

BOOK = Book()


def _part(s, d) -> DataFrame:
    return table(s, d, "part")


def _k() -> Column:
    return F.col("p_partkey")


def _pick(of: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (at % len(of) + 1).cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _capital(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@BOOK(f"select item_id, {_HASH} as idx, count(*) as weight from (select item_id, unnest({_TOK}) as term from benchmark) group by 1, 2")
def bm25_query_vector(s, d):
    """Each benchmark item as a query: how often its words fall into each slot."""
    words = table(s, d, "benchmark").select("item_id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.withColumn("idx", term_hash("term")).groupBy("item_id", "idx").agg(F.count("*").alias("weight"))


@BOOK("""with r as (select p_partkey, replace(p_name, ' ', '_') || case when p_partkey % 5 = 0 then '-' || (p_size % 4 + 2) else '' end as id from part),
  n as (select *, row_number() over (partition by id order by p_partkey) as n from r),
  u as (select regexp_extract(id, '^(.*)-(\\d+)$', 1) as base, list(distinct regexp_extract(id, '^(.*)-(\\d+)$', 2)::bigint) as used from r where regexp_matches(id, '-\\d+$') group by 1)
  select p_partkey, case when n = 1 then id else id || '-' || list_filter(range(2, n + len(coalesce(used, [])) + 1), lambda k: not list_contains(coalesce(used, []), k))[n - 1] end as id from n left join u on u.base = n.id""")
def id_suffixes(s, d):
    """Names as ids made unique in order; a suffix that an id of its own already has is passed over."""
    id = _text(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(_k() % 5 == 0, _text("-", (F.col("p_size") % 4 + 2).cast("string"))).otherwise(""))
    return M.unique_ids(_part(s, d).select(id.alias("id"), "p_partkey"), "id", ["p_partkey"]).select("p_partkey", "id")


@BOOK("""with f as (select p_partkey, case p_partkey % 5 when 0 then null when 1 then p_name || '.txt' when 2 then p_name || '.PDF' else p_name || '.pdf' end as file, case when p_partkey % 7 = 0 then '' else p_name end as name,
    (['edition2014', 'Edition2024', '2019'])[p_size % 3 + 1] as version, ([null, 'core', 'odd', 'SUPPLEMENT'])[p_size % 4 + 1] as type, ([null, 'asia', 'NOPE'])[p_partkey % 3 + 1] as source from part),
  c as (select *, case when file is null then 'file is required.' when not lower(file) like '%.pdf' then 'Only PDF files are accepted.' when name = '' then 'displayName is required.' when version = '2019' then 'Invalid version' when source = 'NOPE' then 'unknown source key' else 'ok' end as result from f)
  select p_partkey, case when result = 'ok' then 'Edition' || version[-4:] end as edition, case when result = 'ok' then case type when 'core' then 'Core' when 'SUPPLEMENT' then 'Supplement' else 'Unknown' end end as book_type, result from c""")
def book_registration(s, d):
    """Parts as forms checked in order, with regions as known sources."""
    file = F.when(_k() % 5 == 0, F.lit(None)).otherwise(_text(F.col("p_name"), F.when(_k() % 5 == 1, ".txt").when(_k() % 5 == 2, ".PDF").otherwise(".pdf")))
    forms = _part(s, d).select(
        "p_partkey", file.alias("file"), F.when(_k() % 7 == 0, "").otherwise(F.col("p_name")).alias("name"), _pick(["edition2014", "Edition2024", "2019"], F.col("p_size")).alias("version"),
        _pick([None, "core", "odd", "SUPPLEMENT"], F.col("p_size")).alias("type"), _pick([None, "asia", "NOPE"], _k()).alias("source"))
    return C.registered(forms, table(s, d, "region").select(F.col("r_name").alias("key"))).select("p_partkey", "edition", "book_type", "result")


@BOOK("""with t as (select p_partkey, 'total ' || repeat('z', p_size % 45) || ' 750' || case when p_partkey % 7 = 0 then '0' else '' end || ' ' || repeat('y', p_partkey % 45) || case when p_partkey % 3 = 0 then '' else ' adjusted' end as t from part),
  w as (select p_partkey, t, 8 + length(regexp_extract(t, '^total (z*)', 1)) as i from t), n as (select p_partkey, substr(t, greatest(i - 30, 1), i + 33 - greatest(i - 30, 1)) as near from w)
  select p_partkey, p_partkey % 7 = 0 or not (contains(near, 'total') and not contains(near, 'adjusted')) as ok from n""")
def number_labels(s, d):
    """Whether a number stands by its own label, with labels at distances that parts give."""
    text = _text("total ", F.repeat(F.lit("z"), F.col("p_size") % 45), " 750", F.when(_k() % 7 == 0, "0").otherwise(""), " ", F.expr("repeat('y', cast(p_partkey % 45 as int))"), F.when(_k() % 3 == 0, "").otherwise(" adjusted"))
    return _part(s, d).select("p_partkey", C.number_labelled(text, "750", "adjusted", ["total"]).alias("ok"))


@BOOK("""select p_partkey, level, '+' || (2 + (level - 1) // 4) as bonus, array_to_string(list_filter([case when level = 1 then 'Rage' end, case when level = p_size % 20 + 1 then p_name end, case when level = 3 then 'Path' end], lambda x: x is not null), ', ') as features,
  case when level - 1 + p_partkey % 3 = 0 then '' else (level - 1 + p_partkey % 3)::varchar end as rages from part, range(1, 21) r(level)""")
def class_progression(s, d):
    """Parts as classes: one gains its name at a level, and its table begins with another number."""
    features = F.array(F.lit('"Rage|B||1"'), _text('"', F.col("p_name"), "|B||", (F.col("p_size") % 20 + 1).cast("string"), '"'), F.lit('{"classFeature":"Path|B||3|","gainSubclassFeature":true}'), F.lit('"Gone|B||2|XYZ"'))
    rows = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.array(i + _k() % 3)))
    entry = _text('{"classFeatures":[', F.array_join(features, ","), '],"classTableGroups":[{"colLabels":["{@b Rages}"],"rows":', rows, "}]}")
    made = _part(s, d).select("p_partkey", F.explode(J.arrow(J.class_rows, "array<array<string>>")(entry)).alias("r"))
    return made.select("p_partkey", F.col("r")[0].cast("long").alias("level"), *[F.col("r")[i].alias(n) for i, n in enumerate(("bonus", "features", "rages"), 1)])


@BOOK("""with g as (select p_partkey, (p_size % 3 * 2 + 1)::int as level, 0 as o, p_brand as spell from part union all select p_partkey, 1, 1, p_name from part union all select p_partkey, 1, 2, p_type from part union all select p_partkey, 5, 3, 'c' from part)
  select p_partkey, level, string_agg(spell, ', ' order by o) as spells from g group by 1, 2""")
def subclass_spells(s, d):
    """Parts as subclasses whose prepared spells come at one of three levels."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name, kind, brand = (q(F.col(c)) for c in ("p_name", "p_type", "p_brand"))
    entry = _text('{"additionalSpells":[{"expanded":{"s1":[', name, ",", kind, ",", name, '],"s3":["c"]},"prepared":{"', (F.col("p_size") % 3 * 2 + 1).cast("string"), '":[', brand, ',{"choose":"x"}],"x":["no"]}},4]}')
    return _part(s, d).select("p_partkey", F.inline(J.arrow(J.subclass_spells, "array<struct<level:int,spells:string>>")(entry)))


@BOOK("""select p_partkey, case when p_partkey % 2 = 0 then p_name || ' two' || chr(10) || chr(10) || p_type || chr(10) || 'x' || chr(10) || chr(10) || '• ' || p_brand || chr(10) || '• I' || chr(10) || 'e' else 'A | ' || p_name || chr(10) || p_size || ' | 2 | ' || p_type end as text from part""")
def entry_text(s, d):
    """Parts as entries: a list within a section, or a table."""
    section = _text('["{@b ', F.col("p_name"), '} two",{"type":"entries","name":"', F.col("p_type"), '","entries":["x",{"type":"list","items":["', F.col("p_brand"), '","",{"type":"item","name":"I","entry":"e"}]}]}]')
    rows = _text('[{"type":"table","colLabels":["A","{@i ', F.col("p_name"), '}"],"rows":[["', F.col("p_size").cast("string"), '",2,{"type":"item","entry":"', F.col("p_type"), '"}],[],"no"]}]')
    flat = J.arrow(lambda e: J.flattened(e) if isinstance(e, list) else "", "string")
    return _part(s, d).select("p_partkey", flat(F.when(_k() % 2 == 0, section).otherwise(rows)).alias("text"))


@BOOK("""select p_partkey, p_name || case p_partkey % 7 when 0 then '. ' || lower(p_type) || ' magic item. Requires attunement.' when 1 then '. Type: G. Value: ' || p_size || ' gp.' when 2 then '. martial weapon. Damage: ' || p_size || 'd8 .' when 3 then '. HA armor. AC: ' || p_size || '.'
  when 4 then '. in ' || p_brand || '.' when 5 then ' (Trap)' else '. Goals: ' || p_type || '; ' || p_brand || '.' end as text from part""")
def canonical_text(s, d):
    """Parts as records of seven types, one of which cannot be read."""
    size, kind, brand = F.col("p_size").cast("string"), F.col("p_type"), F.col("p_brand")
    fields = (
        F.when(_k() % 7 == 0, _text('{"rarity":"', F.lower(kind), '","reqAttune":"by a bard"}')).when(_k() % 7 == 1, _text('{"type":"G","value":', (F.col("p_size") * 100 + 50).cast("string"), "}"))
        .when(_k() % 7 == 2, _text('{"weaponCategory":"martial","dmg1":"', size, 'd8"}')).when(_k() % 7 == 3, _text('{"type":"HA","ac":', size, "}")).when(_k() % 7 == 4, _text('{"setting":"', brand, '"}'))
        .when(_k() % 7 == 5, "broken").otherwise(_text('{"goals":["', kind, '","', brand, '","c"]}'))
    )
    kinds = ["MagicItem", "Item", "Weapon", "Armor", "Location", "Trap", "Faction"]
    return _part(s, d).select("p_partkey", O.rendered(_pick(kinds, _k()), F.col("p_name"), fields, F.lit("as stored")).alias("text"))


_ENDINGS = [".json", ".errors.json", ".declined.json", ".warnings.json", ".txt", ".progress.json", ".checkpoint.json"]


@BOOK(f"""with f as (select p_partkey, case when p_partkey % 11 = 0 then 'errors.json' else replace(p_name, ' ', '-') || p_partkey || ({literal(_ENDINGS)})[p_partkey % 7 + 1] end as file from part)
  select p_partkey, file from f where file = 'errors.json' or (p_partkey % 7 = 0)""")
def sidecar_scan(s, d):
    """Parts as files of a folder; those beside a record's file are left out."""
    file = F.when(_k() % 11 == 0, "errors.json").otherwise(_text(F.replace("p_name", F.lit(" "), F.lit("-")), _k().cast("string"), _pick(_ENDINGS, _k())))
    return O.without_sidecars(_part(s, d).select("p_partkey", file.alias("file")), "file")


@BOOK("""with h as (select p_partkey, p_name, upper(p_name) as u, p_partkey % 4 as k from part) select p_partkey,
  case when k = 2 then p_name when k = 1 and u[1] in ('A', 'I') then u[1] || ' ' || u[2:] when k = 3 and u[-1] in ('A', 'I') then u[:-2] || ' ' || u[-1] else u end as despaced from h""")
def heading_despaced(s, d):
    """Names in capitals, of which a first or a last letter came apart; names in small letters stay."""
    u = F.upper("p_name")
    heading = F.when(_k() % 4 == 0, u).when(_k() % 4 == 1, _text(F.substring(u, 1, 1), " ", F.expr("substring(upper(p_name), 2)"))).when(_k() % 4 == 2, F.col("p_name")).otherwise(F.expr("left(upper(p_name), length(p_name) - 1) || ' ' || right(upper(p_name), 1)"))
    return _part(s, d).select("p_partkey", L.column_of(L.despaced, "string")(heading).alias("despaced"))


_PROMOTED = [("text", "upper(p_name) || ' Conjuration cantrip'", "null"), ("text", "'Casting Time: 1 action'", "null"), ("text", "upper(p_type) || ' TRAITS'", "1"), ("text", "p_brand || ' is plain prose.'", "null"), ("text", "upper(p_type) || ' TRAITS'", "1"), ("table", "p_name", "null"), ("image", "'x'", "null")]


@BOOK("""select p_partkey as book, 0 as place, 0 as part, 'section_header' as kind, upper(p_name) as text, 2 as level from part union all select p_partkey, 0, 1, 'text', upper(p_name) || ' Conjuration cantrip', null from part
  union all select p_partkey, 1, 0, 'text', 'Casting Time: 1 action', null from part union all select p_partkey, 2, 0, 'section_header', upper(p_type), 1 from part union all select p_partkey, 3, 0, 'text', p_brand || ' is plain prose.', null from part
  union all select p_partkey, 4, 0, 'section_header', upper(p_type) || ' TRAITS', 1 from part union all select p_partkey, 5, 0, 'table', p_name, null from part""")
def heading_promotion(s, d):
    """Each part as a book of seven layout blocks: names of spells and races become headings."""
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.expr(text).alias("text"), F.expr(level).cast("int").alias("level"), F.when(F.lit(kind == "table"), "<tr>").alias("html")) for i, (kind, text, level) in enumerate(_PROMOTED)])
    return S.promoted(_part(s, d).select(_k().alias("book"), F.inline(rows)), "book", "place")


@BOOK("select p_partkey as book, 1 as place, p_name as name, (5 + p_size % 3)::int as lines from part where p_partkey % 3 <> 1")
def stat_blocks(s, d):
    """Each part as a book with one creature, some with more lines, every third without an armor class."""
    item = lambda place, kind, text: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), text.alias("text"))
    say = F.lit
    fixed = [
        item(0, "section_header", F.col("p_name")), item(1, "text", say("Small humanoid (goblinoid), neutral evil")), item(2, "text", F.when(_k() % 3 == 1, "Notes").otherwise(_text("Armor Class ", F.col("p_size").cast("string")))),
        item(3, "text", say("Hit Points 21")), item(50, "section_header", say("ACTIONS")), item(51, "text", say("Scimitar.")), item(60, "section_header", say("Lore")), item(61, "text", say("Large claims.")),
    ]
    more = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.struct((i + 9).alias("place"), F.lit("text").alias("kind"), F.lit("Speed 30 ft.").alias("text")))
    items = _part(s, d).select(_k().alias("book"), F.inline(F.concat(F.array(*fixed), F.slice(more, 2, 5))))
    return S.stat_blocks(items, "book", "place").select("book", "place", "name", F.size(F.split("text", "\n")).alias("lines"))


@BOOK(f"select p_partkey, {_capital('p_name')} || ' of the NPC-' || upper(p_type[1]) || lower(p_type[2:]) as title from part")
def name_title_case(s, d):
    return _part(s, d).select("p_partkey", L.title_case(_text(F.upper("p_name"), " OF the npc-", F.col("p_type"))).alias("title"))


_SIGN_TEXT = ["'Armor Class ' || p_size || ', Hit Points ' || p_partkey || ', Challenge 1/2'", "'Huge object. Armor Class 12. Hit Points ' || p_size", "'Ring of ' || p_name || ', very rare'", "p_size || 'd8 slashing'", "'Starting at 3rd level, and at sixth level, ' || p_name", "'at 3rd level and when you reach 3rd level'", "p_name"]


@BOOK("select p_partkey, (['stat', 'object', 'magic', 'item', 'levels', 'none', 'none'])[p_partkey % 7 + 1] as sign, p_partkey % 4 > 2 as name_like from part")
def content_signatures(s, d):
    """Texts of seven shapes with a part's own words and numbers, under names of which every fourth is none that counts as unlike a name."""
    t = F.expr(f"case p_partkey % 7 {' '.join(f'when {i} then {x}' for i, x in enumerate(_SIGN_TEXT))} end")
    sign = F.when(L.object_stat_block(t), "object").when(L.complete_stat_block(t), "stat").when(L.magic_item(t), "magic").when(L.plain_item(t), "item").when(L.level_progression(t), "levels").otherwise("none")
    name = F.when(_k() % 4 == 0, _text("Step ", F.col("p_size").cast("string"))).when(_k() % 4 == 1, "Actions").when(_k() % 4 == 2, _text(F.col("p_size").cast("string"), " men")).otherwise(F.initcap("p_name"))
    return _part(s, d).select("p_partkey", sign.alias("sign"), L.name_like(name).alias("name_like"))


@BOOK("""with a as (select p_partkey, p_partkey % 11 = 0 as same, p_partkey % 3 = 0 as other, p_partkey % 7 = 0 as step, p_partkey % 4 as t, p_partkey % 5 as prior from part)
  select p_partkey, case when same then 'Force:Spell' when not other and step then 'Drop' when t = 0 then 'Force:Object' when t = 1 then 'Force:Monster' when t = 2 then 'Force:MagicItem' when other then 'Force:Race' when prior = 0 then 'Defer' when prior < 3 then 'Decline' else 'Defer' end as outcome from a""")
def type_resolver(s, d):
    """Candidates whose names, texts, matches and priors vary apart from each other."""
    text = F.when(_k() % 4 == 0, "Large object, armor class 15, hit points 3").when(_k() % 4 == 1, "Armor Class 13 Hit Points 15 Challenge 1/2").when(_k() % 4 == 2, "A wondrous item").otherwise(F.lit("a tale"))
    prior = F.when(_k() % 5 == 0, F.array(F.lit("Monster"), F.lit("Object"))).when(_k() % 5 < 3, F.array(F.lit("Monster"))).otherwise(F.array(F.lit("Item")))
    name = F.when(_k() % 7 == 0, _text("Step ", F.col("p_size").cast("string"))).otherwise(F.initcap("p_name"))
    return _part(s, d).select("p_partkey", S.resolved_type(name, text, prior, F.when(_k() % 11 == 0, "Spell"), F.when(_k() % 3 == 0, "Race")).alias("outcome"))


@BOOK("""with recursive l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where length(text) // 4 > 100),
  b as (select doc_id, line, i, sum(case when trim(line) = '' or line like '## %' or line like '### %' then 1 else 0 end) over (partition by doc_id order by i) as block from l),
  s as (select doc_id, block, i, line, sum(length(line) + 1) over (partition by doc_id, block) - 1 as size, string_agg(line, chr(10)) over (partition by doc_id, block) as whole, row_number() over (partition by doc_id, block order by i) as first from b where trim(line) <> ''),
  p as (select doc_id, block, i, 0 as k, size::bigint as n from s where size // 4 <= 100 and first = 1
    union all select doc_id, block, i, k, least(length(line) - k, 400)::bigint from s, unnest(range(0, greatest(length(line), 1), 400)) u(k) where size // 4 > 100),
  o as (select doc_id, n, row_number() over (partition by doc_id order by block, i, k) as j from p),
  r as (select doc_id, j, 1 as chunk, n // 4 as filled, n as chars from o where j = 1
    union all select o.doc_id, o.j, case when r.filled + o.n // 4 > 100 then r.chunk + 1 else r.chunk end, case when r.filled + o.n // 4 > 100 then o.n // 4 else r.filled + o.n // 4 end, case when r.filled + o.n // 4 > 100 then o.n else r.chars + 1 + o.n end from r join o on o.doc_id = r.doc_id and o.j = r.j + 1)
  select doc_id, max(chunk)::int as chunks, arg_max(chars, j)::int as last_chars from r group by 1""")
def semantic_chunks(s, d):
    """Documents over the budget of a hundred tokens, cut at their blocks, lines and, where a line is too long, within it."""
    cut = L.column_of(lambda t: L.semantic_chunks(t, 100), "array<string>")
    rows = table(s, d, "documents").where("floor(length(text) / 4) > 100").select("doc_id", cut(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.length(F.element_at("c", -1)).alias("last_chars"))


_RARITIES = [" Common", "UNCOMMON", "rare", "very-rare", "Very Rare", "legendary", "artifact", None]


@BOOK("select p_partkey, ([1, 2, 10, 25, 25, 50, null, null])[p_partkey % 8 + 1]::int as workweeks, ([50, 200, 2000, 20000, 20000, 100000, null, null])[p_partkey % 8 + 1]::int as gold from part")
def magic_item_crafting(s, d):
    made = A.magic_craft(A.rarity_of(_pick(_RARITIES, _k())))
    return _part(s, d).select("p_partkey", made["workweeks"].alias("workweeks"), made["gold"].alias("gold"))


_DICE = [4, 6, 8, 10, 12, 20, 100, 7]
_MODES = [None, None, None, None, "adv", "disadvantage"]
_ROLL_SQL = f"""r as (select p_partkey, case when p_partkey % 4 = 0 then 1 else p_size * 3 - 2 end as n, ({_DICE})[p_partkey // 4 % 8 + 1] as die, (p_partkey * 7 % 1500 - 300)::int as m, ({literal(_MODES)})[p_partkey % 6 + 1] as mode from part),
  v as (select *, n between 1 and 100 and die <> 7 and abs(m) <= 1000 and (mode is null or (n = 1 and die = 20)) as valid from r)"""


def _rolls(s, d) -> DataFrame:
    n, die, m, mode = F.when(_k() % 4 == 0, 1).otherwise(F.col("p_size") * 3 - 2), _pick(_DICE, F.floor(_k() / 4)), _k() * 7 % 1500 - 300, _pick(_MODES, _k())
    sign = F.when(m < 0, _text(" - ", (-m).cast("string"))).when(m > 0, _text("+", m.cast("string"))).otherwise("")
    return _part(s, d).select("p_partkey", _text(n.cast("string"), "d", die.cast("string"), sign, F.coalesce(_text(" ", mode), F.lit(""))).alias("text"))


@BOOK(f"with {_ROLL_SQL} select p_partkey, case when valid then n end::int as count, case when valid then die end::int as die, case when valid then m end::int as modifier, case when valid then case mode when 'adv' then 'Advantage' when 'disadvantage' then 'Disadvantage' else 'Normal' end end as mode from v")
def dice_expressions(s, d):
    """Parts as expressions of dice, some of them out of bounds."""
    x = A.dice(F.col("text"))
    return _rolls(s, d).select("p_partkey", *[x[c].alias(c) for c in ("count", "die", "modifier", "mode")])


_FACE = "('0x' || substr(md5(p_partkey || ':' || i), 1, 8))::bigint % die + 1"


@BOOK(f"with {_ROLL_SQL} select p_partkey, case when valid then m + case mode when 'adv' then list_max(list_transform([1, 2], lambda i: {_FACE})) when 'disadvantage' then list_min(list_transform([1, 2], lambda i: {_FACE})) else list_sum(list_transform(range(1, n + 1), lambda i: {_FACE})) end end::bigint as total from v")
def dice_rolls(s, d):
    """The rolls of those expressions, by the part as seed."""
    return _rolls(s, d).select("p_partkey", A.rolled(F.col("text"), _k()).alias("total"))


_SUBSETS = [(k, ", ".join(v)) for k, v in A.SUBSETS.items()] + [("Nobody", "")]


@BOOK(f"select p_partkey, ({literal([p for _, p in _SUBSETS])})[p_partkey % {len(_SUBSETS)} + 1] as proficiencies from part")
def multiclass_proficiencies(s, d):
    """What a second class, here of each part, gives of its proficiencies."""
    held = F.create_map(*[F.lit(x) for k, v in _SUBSETS[:-1] for x in (k.lower(), v)])
    said = F.upper(_pick([k for k, _ in _SUBSETS], _k()))
    return _part(s, d).select("p_partkey", F.coalesce(F.try_element_at(held, F.lower(said)), F.lit("")).alias("proficiencies"))


@BOOK("""select p_partkey, p_brand as ancestry, lower(p_type) as damage_type, p_size || ' ft. cone' as breath_area, case p_partkey % 4 when 0 then 'Dexterity' when 1 then 'Constitution' when 2 then 'Lck' else '' end as save_ability, 0 as option from part""")
def draconic_ancestry(s, d):
    """Parts as races whose ancestry table stands within their entries: rows, and the option of each."""
    row = F.to_json(F.array(F.col("p_brand"), F.upper("p_type"), _text(F.col("p_size").cast("string"), " ft. cone", F.when(_k() % 4 == 0, " (Dex. save)").when(_k() % 4 == 1, " (con save)").when(_k() % 4 == 2, " (Lck. save)").otherwise(""))))
    race = _text('{"name":"Dragonborn","entries":["x",{"type":"entries","entries":[{"type":"table","caption":"Other","rows":[["a","b","c"]]},{"type":"table","caption":"Draconic Ancestry","rows":[', row, "]}]}]}")
    return _part(s, d).select("p_partkey", F.inline(J.arrow(J.ancestry_rows, "array<struct<ancestry:string,damage_type:string,breath_area:string,save_ability:string,option:int>>")(race)))


_N = "chr(10)"


@BOOK(f"""select p_partkey, case p_partkey % 4
  when 0 then p_name || ' — Small, Huge ' || lower(p_type) || ', Lawful Any alignment' || {_N} || 'AC ' || p_size || {_N} || 'HP ' || p_partkey || ' (2d6)' || {_N} || 'Speed walk 30 ft., fly ' || p_brand || {_N} || 'STR 10 CHA ' || p_size || {_N} || 'CR 1/' || p_size || {_N} || 'Traits:' || {_N} || '  Keen: has ' || p_name || {_N} || '  Odd' || {_N} || 'Legendary — Roar' || {_N}
  when 1 then p_name || ' — ' || case p_size % 5 when 0 then 'Evocation cantrip' when 1 then '1st-level Evocation' when 2 then '2nd-level Evocation' when 3 then '3rd-level Evocation' else '4th-level Evocation' end || {_N} || 'Casting Time: 1 action' || {_N} || 'Range: ' || p_size || ' feet' || {_N} || 'Components: V, M (' || p_brand || ')' || {_N} || 'Duration: Concentration, up to 1 minute' || {_N} || {_N} || 'A ' || p_type || '.' || {_N} || 'inner' || {_N} || {_N} || 'At Higher Levels: more' || {_N}
  when 2 then p_name || ' (' || p_type || ' subclass).' || {_N} || case when p_size > 7 then 'Features: ' || p_brand || ' (7), Aura (' || p_size || ').' else 'Features: Aura (' || p_size || '), ' || p_brand || ' (7).' end || {_N}
  else p_name || ' — Object' || {_N} || 'AC ?' || {_N} || 'HP ' || p_size || {_N} || 'Damage Immunities: poison, ' || lower(p_type) || {_N} || 'Actions:' || {_N} || '  Bolt: hits' || {_N} || 'A thing.' || {_N} end as text from part""")
def record_texts(s, d):
    """Parts as monsters, spells, subclasses and objects, told by their fields."""
    size, key = F.col("p_size").cast("string"), _k().cast("string")
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    monster = _text('{"size":["S","h"],"type":{"type":"', F.lower(kind), '","tags":["x"]},"alignment":["L","A"],"ac":[{"ac":', size, '}],"hp":{"average":', key, ',"formula":"2d6"},"speed":{"walk":30,"fly":"', brand, '"},"str":10,"cha":', size, ',"cr":{"cr":"1/', size, '"},"trait":[{"name":"Keen","entries":["has {@b ', name, '}"]},{"name":"Odd","entries":[{"x":1}]}],"legendary":[{"name":"Roar"}]}')
    spell = _text('{"level":', (F.col("p_size") % 5).cast("string"), ',"school":"v","time":[{"number":1,"unit":"action"}],"range":{"type":"point","distance":{"type":"feet","amount":', size, '}},"components":{"v":true,"m":{"text":"', brand, '"}},"duration":[{"type":"timed","duration":{"type":"minute","amount":1}}],"concentration":true,"entries":["A ', kind, '.",{"type":"entries","entries":[{"items":["inner"]}]}],"entriesHigherLevel":["more"]}')
    subclass = _text('{"className":"', kind, '","subclassFeatures":["Aura|Y||Z||', size, '",{"subclassFeature":"', brand, '|Y||Z||7","level":7},"bad","x|y"]}')
    thing = _text('{"ac":["special"],"hp":{"average":', size, '},"immune":["poison","', F.lower(kind), '"],"action":[{"name":"Bolt","entries":["hits"]}],"description":"A {@i thing}."}')
    fields = F.when(_k() % 4 == 0, monster).when(_k() % 4 == 1, spell).when(_k() % 4 == 2, subclass).otherwise(thing)
    rows = _part(s, d).select("p_partkey", _pick(["Monster", "Spell", "Subclass", "Object"], _k()).alias("kind"), name.alias("name"), fields.alias("fields"))
    return rows.select("p_partkey", rendering.rendered(F.col("kind"), F.col("name"), F.col("fields")).alias("text"))
