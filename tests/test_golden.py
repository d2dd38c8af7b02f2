"""Rule functions on given inputs with what they must give: literal rows, each next to its expected one."""

from __future__ import annotations

import json

import duckdb
import pytest
from oracle import as_rows
from pyspark.sql import functions as F

from quillspark.functions import advice as A
from quillspark.functions import jsontree as J
from quillspark.functions import layout as L
from quillspark.operators import curation as C
from quillspark.operators import layout as S
from quillspark.operators import mutations as M
from quillspark.operators import rosters as O
from quillspark.plans.book import Book, values

BOOK = Book()

_IDS = [("a", 1, "a"), ("a", 2, "a-3"), ("a-2", 3, "a-2"), ("a", 4, "a-4"), ("b", 5, "b"), ("b", 6, "b-2"), ("a-2", 7, "a-2-2")]
_FORMS = [("PHB.PDF", "Player", "edition2014", "core", None, "ok"), ("x.txt", "X", "Edition2024", None, None, "Only PDF files are accepted."), (None, "X", "Edition2014", None, None, "file is required."), ("a.pdf", "", "Edition2014", None, None, "displayName is required."), ("a.pdf", "A", "2019", None, None, "Invalid version"), ("a.pdf", "A", "Edition2024", "odd", "NOPE", "unknown source key")]
_LABELS = [("total 750 xp adjusted to 1125", True), ("total: 750 xp " + "z" * 40 + " adjusted", False), ("adjusted 750 xp, total", True), ("7500 total", True), ("", True), ("budget " + "x" * 40 + " 750 " + "y" * 40 + " total", True), ("in total: 750", False)]


@BOOK(f"select n, want as id from {values(_IDS, 'id, n, want')}")
def id_suffixes(s, d):
    """Ids made unique; a suffix that an id of its own already has is passed over."""
    return M.unique_ids(s.createDataFrame([r[:2] for r in _IDS], "id string, n int"), "id", ["n"])


@BOOK(f"select f as file, v as version, case when r = 'ok' then 'Edition2014' end as edition, case when r = 'ok' then 'Core' end as book_type, r as result from {values([(a, c, f) for a, _, c, _, _, f in _FORMS], 'f, v, r')}")
def book_registration(s, d):
    """Forms checked in order; unknown types of book are Unknown, unknown source keys are refused."""
    rows = s.createDataFrame([r[:5] for r in _FORMS], "file string, name string, version string, type string, source string")
    return C.registered(rows, s.createDataFrame([("PHB",)], "key string")).select("file", "version", "edition", "book_type", "result")


@BOOK(f"select t as text, w as ok from {values(_LABELS, 't, w')}")
def number_labels(s, d):
    """Whether a number stands by its own label: no whole occurrence has only a wrong one within thirty characters."""
    return s.createDataFrame([(t,) for t, _ in _LABELS], "text string").select("text", C.number_labelled(F.col("text"), "750", "adjusted", ["total"]).alias("ok"))

_CLASS = {
    "classFeatures": ["Rage|Barbarian||1", {"classFeature": "Path|Barbarian||3|", "gainSubclassFeature": True}, "Reckless|Barbarian||2", "Gone|Barbarian||2|XYZ", "Danger|Barbarian||2", 3],
    "classTableGroups": [{"colLabels": ["{@b Rages}"], "rows": [[k, "x"] for k in range(20)]}, {"colLabels": ["bad"]}, {"colLabels": ["1st"], "rowsSpellProgression": [["{@dice 1d4}"]]}],
}
_GAINED = {1: "Rage", 2: "Reckless, Danger", 3: "Path"}
_SUBCLASS = {"additionalSpells": [{"expanded": {"s1": ["a", "b", "a"], "s3": ["c"]}, "prepared": {"3": ["d"], "x": ["no"]}}, {"known": {"1": ["e", {"choose": "x"}], "9": [{"choose": "y"}]}}, 4]}
_ENTRIES = [
    ('["{@b One} two",{"type":"entries","name":"N","entries":["x",{"type":"list","items":["a","",{"type":"item","name":"I","entry":"e"}]}]}]', "One two\n\nN\nx\n\n• a\n• I\ne"),
    ('[{"type":"table","colLabels":["A","{@i B}"],"rows":[["1",2,{"type":"item","entry":"q"}],[],"no"]}]', "A | B\n1 | 2 | q"),
    ('[{"type":"inset","entries":["in","side"]},{"type":"other","entry":"one"},{"type":"image"},3]', "in\n\nside\n\none"),
    ('[{"type":"itemSpell","name":"S","entries":["t"]},{"entries":["bare"]}]', "S\nt\n\nbare"),
    ("{}", ""),
]
_RENDERED = [
    ("Class", "Bard", '{"hd":{"faces":8},"proficiency":["dex","cha"],"classFeatures":["Song|Bard||2","Jack|Bard|1",{"classFeature":"Late|x","level":9}]}', "Bard — d8 hit die.\nSaving throws: DEX, CHA.\nFeatures: Jack (1), Song (2), Late (9).\n"),
    ("Class", "Odd", "{}", "Odd — ? hit die.\n"),
    ("Race", "Elf", '{"size":["M","s"],"speed":30,"traitTags":["Darkvision"],"entries":["A {@b tall} folk."]}', "Elf — Medium/Small race. Speed: 30 ft. Traits: Darkvision. A tall folk."),
    ("Feat", "Grit", '{"prerequisite":[{"ability":[{"str":13,"dex":13},{"con":15}],"level":4},{"race":[{"name":"orc"}]}],"entries":[{"x":1}]}', "Grit. Prerequisite: Strength 13, Dexterity 13 or Constitution 15, Level 4 or orc."),
    ("MagicItem", "Orb", '{"rarity":"rare","reqAttune":"by a bard"}', "Orb. rare magic item. Requires attunement."),
    ("Item", "Cup", '{"type":"G","value":250}', "Cup. Type: G. Value: 2 gp."), ("Weapon", "Axe", '{"weaponCategory":"martial","dmg1":"1d8"}', "Axe. martial weapon. Damage: 1d8 ."), ("Armor", "Mail", '{"type":"HA","ac":16}', "Mail. HA armor. AC: 16."),
    ("God", "Sun", '{"alignment":["L","G"],"domains":["Light","War"],"symbol":"Disc"}', "Sun. Alignment: Lawful Good. Domains: Light, War. Symbol: Disc."), ("Rule", "Grid", '{"ruleType":"O"}', "Grid. optional rule."), ("Location", "Port", '{"setting":"Coast"}', "Port. in Coast."),
    ("Faction", "Ring", '{"goals":["a","b","c"]}', "Ring. Goals: a; b."), ("Background", "Sage", '{"skillProficiencies":[{"arcana":true,"history":true}]}', "Sage. Skills: arcana, history."), ("Condition", "Blind", '{"entries":["No sight."]}', "Blind. No sight."),
    ("Trap", "Pit", "broken", "Pit (Trap)"), ("Unheard", "X", "{}", "as stored"),
]


@BOOK(f"select level, '+' || (2 + (level - 1) // 4) as bonus, coalesce(g, '') as features, case when level = 1 then '' else (level - 1)::varchar end as rages, case when level = 1 then '1d4' else '' end as dice from range(1, 21) r(level) left join {values(list(_GAINED.items()), 'lv, g')} on lv = level")
def class_progression(s, d):
    rows = J.arrow(lambda c: J.class_rows({**c, "classFeatures": [f for f in c["classFeatures"] if f != 3]}), "array<array<string>>")
    found = s.createDataFrame([(json.dumps(_CLASS),)], "c string").select(F.explode(rows(F.col("c"))).alias("r"))
    return found.select(F.col("r")[0].cast("long").alias("level"), *[F.col("r")[i].alias(n) for i, n in enumerate(("bonus", "features", "rages", "dice"), 1)])


@BOOK("select l as level, t as spells from (values (1, 'a, b, e'), (3, 'd'), (5, 'c')) v(l, t)")
def subclass_spells(s, d):
    rows = J.arrow(J.subclass_spells, "array<struct<level:int,spells:string>>")
    return s.createDataFrame([(json.dumps(_SUBCLASS),)], "c string").select(F.inline(rows(F.col("c"))))


@BOOK(f"select i, t as text from {values([(i, t) for i, (_, t) in enumerate(_ENTRIES)], 'i, t')}")
def entry_text(s, d):
    """Entries of rosters as text; what is no array gives none."""
    flat = J.arrow(lambda e: J.flattened(e) if isinstance(e, list) else "", "string")
    return s.createDataFrame([(i, e) for i, (e, _) in enumerate(_ENTRIES)], "i int, e string").select("i", flat(F.col("e")).alias("text"))


@BOOK(f"select name, t as text from {values([(n, t) for _, n, _, t in _RENDERED], 'name, t')}")
def canonical_text(s, d):
    """Records as text by the sentences of their type."""
    rows = s.createDataFrame([r[:3] for r in _RENDERED], "type string, name string, fields string")
    return rows.select("name", O.rendered(F.col("type"), F.col("name"), F.col("fields"), F.lit("as stored")).alias("text"))


@BOOK("select f as file from (values ('a.json'), ('b.errors.json'), ('c.declined.json'), ('errors.json'), ('d.txt'), ('e.progress.json')) v(f) where f in ('a.json', 'errors.json')")
def sidecar_scan(s, d):
    return O.without_sidecars(s.createDataFrame([(f,) for f in ("a.json", "b.errors.json", "c.declined.json", "errors.json", "d.txt", "e.progress.json")], "file string"), "file")

_SPACED = [("B ULLYWUG", "BULLYWUG"), ("A CT IONS", "ACTIONS"), ("A CTI ONS", "A CTI ONS"), ("XP COSTS", "XP COSTS"), ("ABE ER RATIONS", "ABEERRATIONS"), ("THE GI ANT", "THE GIANT"), ("Mixed C ase", "Mixed C ase"), ("CHAPTER O F", "CHAPTER OF"), ("D20 ROLLS", "D20 ROLLS"), ("ONE", "ONE"), ("", ""), (None, None)]
_ITEMS = [
    ("section_header", "Goblin Boss"), ("text", "Small humanoid (goblinoid), neutral evil"), ("text", "Armor Class 17"), ("text", "Hit Points 21"), ("section_header", "ACTIONS"), ("text", "Scimitar."),
    ("section_header", "Lore"), ("text", "Large claims about goblins."), ("text", "Nothing more."), ("text", "Nor here."),
    ("section_header", "A heading that is far too long to be the name of any kind of creature"), ("text", "Huge giant, chaotic evil"), ("text", "Notes"), ("text", "armor class 14"), ("title", "Ogre"),
    ("text", "large giant"), ("text", "Armor Class 11"), ("text", "Medium beast, unaligned"), ("text", "Armor Class 12"), ("text", "end"),
]
_BLOCKS = [(1, "Goblin Boss", 5), (11, "Lore", 3), (15, "Ogre", 2), (17, "Ogre", 3)]
_TITLES = [("THE LORD OF THE RINGS", "The Lord of the Rings"), ("half-ORC and a GP", "Half-Orc and a GP"), ("(the npcs' guide)", "(The NPCs' Guide)"), ("AOE in D&D", "AoE in D&D"), ("-- x", "-- X"), ("", ""), ("MAN-OF-WAR", "Man-of-War"), ("ÉLAN vital!", "ÉLan Vital!")]
_SIGNS = [
    ("Armor class 12, hit points 3, Challenge 1/2", "Goblin", "stat"), ("Huge object. Armor Class 12. Hit Points 30", "Ballista", "object"), ("Ring of x, very rare", "Ring", "magic"), ("This Wondrous Item glows", "Orb", "magic"),
    ("1d8 slashing", "Sword", "item"), ("Armor Class 14, 30 gp", "Mail", "item"), ("Starting at 3rd level, and at sixth level", "Path", "levels"), ("at 3rd level and when you reach 3rd level", "Path", "none"),
    ("10th-level feature; 6th-level feature", "Oath", "levels"), ("nothing", "Step 2", "none"), ("nothing", "Actions", "none"), ("nothing", "12 men", "none"), ("nothing", "Dragon's Lair", "none"),
]
_LIKE = {"Step 2": False, "Actions": False, "12 men": False, "Dragon's Lair": False}
_RESOLVE = [
    ("Fireball", "nothing", ["Spell"], "Spell", "Spell", "Force:Spell"), ("Step 3", "x", ["Monster"], None, None, "Drop"), ("Boat", "Large object, armor class 15, hit points 3", ["Item"], None, None, "Force:Object"),
    ("Orc", "Armor Class 13 Hit Points 15 Challenge 1/2", ["Spell"], None, None, "Force:Monster"), ("Orb", "wondrous item", ["Item"], None, "Item", "Force:MagicItem"), ("Elf", "tall", ["Monster"], None, "Race", "Force:Race"),
    ("Cart", "wood", ["Monster", "Object"], None, None, "Defer"), ("Goblin King", "tale", ["Monster", "Item"], None, None, "Decline"), ("Potion", "red", ["Item"], None, None, "Defer"),
]
_CHUNKED = "## One\nalpha beta gamma delta\n\nplain words that go on for a while\n| a | b |\n|---|---|\n| 1 | 2 |\n" + "z" * 50 + "\n\n \n### Two\nend"
_CHUNKS = ["## One\nalpha beta gamma delta", "plain words that go on for a while", "| a | b |\n|---|---|\n| 1 | 2 |", "z" * 32, "z" * 18 + "\n### Two\nend"]
_RAW = [
    ("text", "ACID SPLASH Conjuration cantrip", None), ("text", "Casting Time: 1 action", None), ("text", "GNOME TRAITS", 1), ("text", "Your gnome has traits.", None), ("text", "GNOME TRAITS", 1), ("text", "Range: 60 feet", 2), ("text", "FIREBALL 3rd-level evocation", 1),
    ("table", "Loot", None), ("text", "AID\n2nd-level abjuration\nCasting Time: 1 action", None), ("text", "", None), ("image", "x", None), ("text", "2nd-level abjuration", None), ("text", "Plain prose of no level.", None),
]
_PROMOTED = [
    (0, 0, "section_header", "ACID SPLASH", 2), (0, 1, "text", "ACID SPLASH Conjuration cantrip", None), (1, 0, "text", "Casting Time: 1 action", None), (2, 0, "section_header", "GNOME", 1), (3, 0, "text", "Your gnome has traits.", None), (4, 0, "section_header", "GNOME TRAITS", 1), (5, 0, "text", "Range: 60 feet", None),
    (6, 0, "section_header", "FIREBALL", 1), (7, 0, "table", "Loot", None), (8, 0, "section_header", "AID", 2), (8, 1, "text", "AID\n2nd-level abjuration\nCasting Time: 1 action", None), (11, 0, "text", "2nd-level abjuration", None), (12, 0, "text", "Plain prose of no level.", None),
]


@BOOK(f"select h as heading, w as despaced from {values(_SPACED, 'h, w')}")
def heading_despaced(s, d):
    return s.createDataFrame([(a,) for a, _ in _SPACED], "heading string").select("heading", L.column_of(L.despaced, "string")(F.col("heading")).alias("despaced"))


@BOOK(f"select b as book, i as place, name, n as lines from range(3) r(b), {values(_BLOCKS, 'i, name, n')}")
def stat_blocks(s, d):
    """The same items in three books; a block ends where the next begins or an outer heading stands."""
    rows = [(b, i, kind, text) for b in range(3) for i, (kind, text) in enumerate(_ITEMS)]
    found = S.stat_blocks(s.createDataFrame(rows, "book long, place int, kind string, text string"), "book", "place")
    return found.select("book", "place", "name", F.size(F.split("text", "\n")).alias("lines"))


@BOOK(f"select n as name, t as title from {values(_TITLES, 'n, t')}")
def name_title_case(s, d):
    return s.createDataFrame([(a,) for a, _ in _TITLES], "name string").select("name", L.title_case(F.col("name")).alias("title"))


@BOOK(f"select text, name, sign, nl as name_like from {values([(*r, _LIKE.get(r[1], True)) for r in _SIGNS], 'text, name, sign, nl')}")
def content_signatures(s, d):
    t = F.col("text")
    sign = F.when(L.object_stat_block(t), "object").when(L.complete_stat_block(t), "stat").when(L.magic_item(t), "magic").when(L.plain_item(t), "item").when(L.level_progression(t), "levels").otherwise("none")
    return s.createDataFrame([r[:2] for r in _SIGNS], "text string, name string").select("text", "name", sign.alias("sign"), L.name_like(F.col("name")).alias("name_like"))


@BOOK(f"select name, o as outcome from {values([(r[0], r[5]) for r in _RESOLVE], 'name, o')}")
def type_resolver(s, d):
    rows = s.createDataFrame([r[:5] for r in _RESOLVE], "name string, text string, prior array<string>, same string, other string")
    return rows.select("name", S.resolved_type(*map(F.col, ("name", "text", "prior", "same", "other"))).alias("outcome"))


@BOOK(f"select i as chunk, t as text from {values(list(enumerate(_CHUNKS)), 'i, t')}")
def semantic_chunks(s, d):
    cut = L.column_of(lambda t: L.semantic_chunks(t, 8), "array<string>")
    return s.createDataFrame([(_CHUNKED,)], "t string").select(F.posexplode(cut(F.col("t"))).alias("chunk", "text"))


@BOOK(f"select b as book, i as place, p as part, k as kind, t as text, l::int as level from range(40) r(b), {values(_PROMOTED, 'i, p, k, t, l')}")
def heading_promotion(s, d):
    """The same layout blocks in forty books: names of spells and races become headings."""
    rows = [(b, i, kind, text, level, "<tr>" if kind == "table" else None) for b in range(40) for i, (kind, text, level) in enumerate(_RAW)]
    return S.promoted(s.createDataFrame(rows, "book long, place int, kind string, text string, level int, html string"), "book", "place")

_RARITIES = [(" Common", 1, 50), ("UNCOMMON", 2, 200), ("rare", 10, 2000), ("very-rare", 25, 20000), ("Very Rare", 25, 20000), ("legendary", 50, 100000), ("artifact", None, None), (None, None, None)]
_ROLLS = [("2d6+3", 2, 6, 3, "Normal"), ("d20 adv", 1, 20, 0, "Advantage"), (" 1D20 - 4 Disadvantage", 1, 20, -4, "Disadvantage"), ("2d20 adv", None, None, None, None), ("101d4", None, None, None, None), ("1d8+1001", None, None, None, None), ("3d7", None, None, None, None), ("", None, None, None, None), ("0d6", None, None, None, None), ("99999999999d6", None, None, None, None)]
_SUBSETS = [(k, ", ".join(v)) for k, v in A.SUBSETS.items()]


@BOOK(f"select r as rarity, w::int as workweeks, g::int as gold from {values(_RARITIES, 'r, w, g')}")
def magic_item_crafting(s, d):
    made = A.magic_craft(A.rarity_of(F.col("rarity")))
    return s.createDataFrame([(r,) for r, *_ in _RARITIES], "rarity string").select("rarity", made["workweeks"].alias("workweeks"), made["gold"].alias("gold"))


@BOOK(f"select t as text, c::int as count, d::int as die, m::int as modifier, o as mode from {values(_ROLLS, 't, c, d, m, o')}")
def dice_expressions(s, d):
    x = A.dice(F.col("text"))
    return s.createDataFrame([(r[0],) for r in _ROLLS], "text string").select("text", *[x[c].alias(c) for c in ("count", "die", "modifier", "mode")])


@BOOK(f"select c as class, p as proficiencies from {values([*_SUBSETS, ('Nobody', '')], 'c, p')}")
def multiclass_proficiencies(s, d):
    held = F.create_map(*[F.lit(x) for k, v in _SUBSETS for x in (k.lower(), v)])
    return s.createDataFrame([(k,) for k, _ in _SUBSETS] + [("Nobody",)], "class string").select("class", F.coalesce(F.try_element_at(held, F.lower("class")), F.lit("")).alias("proficiencies"))


@pytest.mark.parametrize("name", sorted(BOOK.queries))
def test_given_rows(spark, name):
    rows = BOOK.queries[name](spark, None).toPandas()
    wanted = duckdb.sql(BOOK.sql[name]).df()
    assert sorted(rows.columns) == sorted(wanted.columns)
    assert as_rows(rows) == as_rows(wanted)


def test_rolls_stay_within_their_dice(spark):
    texts = ["3d6+2", "d20 adv", "1d20-4 disadvantage", "101d4", "5d4"]
    rows = spark.createDataFrame([(t, i) for t in texts for i in range(200)], "text string, seed int")
    got = rows.select("text", A.rolled(F.col("text"), F.col("seed")).alias("n")).groupBy("text").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()
    found = {r[0]: tuple(r)[1:] for r in got}
    assert found["101d4"] == (None, None, 0)
    for text, low, high in (("3d6+2", 5, 20), ("d20 adv", 1, 20), ("1d20-4 disadvantage", -3, 16), ("5d4", 5, 20)):
        assert low <= found[text][0] and found[text][1] <= high and found[text][2] > 10
