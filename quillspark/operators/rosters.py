"""Rosters and books kept as JSON: reading by registry, indexes, lookups, variants, index columns, rendering."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontree as J
from ..functions.text import name_key
from ..sources.canonical import write_documents
from .index import shared_root

# Endings of files that stand beside records and are none, types of record in ids, armor codes.
SIDECARS = ("errors", "warnings", "declined", "progress", "checkpoint")
ID_TYPES = "class|subclass|race|subrace|background|feat|spell|weapon|armor|item|magicitem|monster|god|trap|condition|diseasepoison|vehiclemount|plane|faction|location|lore|rule|object"
ARMOR_CODES = ("la", "ma", "ha", "s")


@dataclass(frozen=True)
class Roster:
    """Files by pattern, whose ``key`` is an array of records of a type; a second name's field; the category that is left out."""

    pattern: str
    type: str
    key: str
    alias: str | None = None
    without_category: str | None = None


#: Which files hold which rosters, in the order in which their names count.
REGISTRY = (
    Roster("spells-*.json", "Spell", "spell"), Roster("class-*.json", "Class", "class"), Roster("class-*.json", "Subclass", "subclass", alias="shortName"),
    Roster("bestiary-*.json", "Monster", "monster"), Roster("items*.json", "Item", "item"), Roster("items-base*.json", "Item", "baseitem"),
    Roster("backgrounds*.json", "Background", "background"), Roster("races*.json", "Race", "race"), Roster("feats*.json", "Feat", "feat", without_category="FS"),
    Roster("conditionsdiseases*.json", "Condition", "condition"), Roster("deities*.json", "God", "deity"),
)


def write_rosters(rows: DataFrame, rosters: tuple[Roster, ...] = REGISTRY) -> str:
    """Rows (key, source, ordinal, r: JSON) as files of JSON, one for each roster and source, in a new shared folder; returns it.

    A file is written by the task that has its rows, a record at a time. Keys that no roster has are an error.
    """
    folder = f"{shared_root(rows.sparkSession)}/rosters-{uuid.uuid4().hex}"
    known = {r.key: r for r in rosters}
    if not rows.where(~F.coalesce(F.col("key").isin(*known), F.lit(False))).isEmpty():
        raise ValueError(f"rosters are of {', '.join(known)}")
    for key, roster in known.items():
        own = rows.where(F.col("key") == key)
        slug = F.concat(F.lit(roster.pattern.removesuffix(".json").rstrip("*").rstrip("-") + "-"), "source")
        write_documents(own.select(slug.alias("slug"), "ordinal", F.col("r").alias("record")), folder, key)
    return folder


def read_rosters(spark: SparkSession, folder: str, rosters: tuple[Roster, ...] = REGISTRY) -> DataFrame:
    """type, roster (its place), file, ordinal, alias and record (JSON) of every record; files of no roster and sidecars are not read."""
    parts = []
    for order, r in enumerate(rosters):
        files = spark.read.option("pathGlobFilter", r.pattern).text(folder, wholetext=True).where(~F.col("_metadata.file_name").rlike(rf"\.({'|'.join(SIDECARS)})\.json"))
        items = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.from_json(F.get_json_object("value", f"$.{r.key}"), "array<string>")).alias("ordinal", "record"))
        if r.without_category is not None:
            items = items.where(~F.coalesce(F.get_json_object("record", "$.category") == r.without_category, F.lit(False)))
        alias = F.get_json_object("record", f"$.{r.alias}") if r.alias else F.lit(None).cast("string")
        parts.append(items.select(F.lit(r.type).alias("type"), F.lit(order).alias("roster"), "file", "ordinal", alias.alias("alias"), "record"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(rosters: DataFrame) -> DataFrame:
    return rosters.select("type", _turn().alias("turn"), "alias", F.get_json_object("record", "$.name").alias("name"), F.get_json_object("record", "$.source").alias("source"))


def _turn() -> Column:
    """The order in which records are loaded: by roster, file and place."""
    return F.struct("roster", "file", "ordinal")


def type_lookup(rosters: DataFrame) -> DataFrame:
    """name_key, source_key, type: the last record of a lower-cased name and upper-cased source."""
    rows = _named(rosters).where("name is not null and source is not null")
    return rows.groupBy(F.lower("name").alias("name_key"), F.upper("source").alias("source_key")).agg(F.max_by("type", "turn").alias("type"))


def by_id(rosters: DataFrame, source: str, id: Column) -> DataFrame:
    """id and record of one source's records, by an id made of ``name``, ``type`` and ``source``; the last of an id stands."""
    rows = rosters.select("*", F.get_json_object("record", "$.name").alias("name"), F.get_json_object("record", "$.source").alias("source"))
    mine = rows.where((F.upper("source") == source.upper()) & F.col("name").isNotNull()).select(id.alias("id"), "record", _turn().alias("turn"))
    return mine.groupBy("id").agg(F.max_by("record", "turn").alias("record"))


def name_index(rosters: DataFrame) -> DataFrame:
    """key, type, name, first: the distinct types of a normalised name, each with its first record's name, and whether the name is known by it first.

    A second name is a key of its own for the record's name; it counts after the name itself.
    """
    rows = _named(rosters).where("name <> ''")
    keys = rows.select("type", "name", F.struct("turn", F.lit(0).alias("second")).alias("turn"), name_key(F.col("name")).alias("key"))
    more = rows.where("alias <> '' and alias <> name").select("type", "name", F.struct("turn", F.lit(1).alias("second")).alias("turn"), name_key(F.col("alias")).alias("key"))
    each = keys.unionByName(more).groupBy("key", "type").agg(F.min(F.struct("turn", "name")).alias("n"))
    lead = each.groupBy("key").agg(F.min("n.turn").alias("lead"))
    return each.join(lead, "key").select("key", "type", F.col("n.name").alias("name"), (F.col("n.turn") == F.col("lead")).alias("first"))


def dangling(records: DataFrame, key: str, fields: str, ids: DataFrame) -> DataFrame:
    """key, path, value of the strings within that look like ids (book.type.name) and are none of ``ids`` (id)."""
    walk = J.arrow(lambda v: list(J.leaves(v)), "array<struct<path:string,value:string>>")
    found = records.select(key, F.inline(walk(F.col(fields))))
    shaped = found.where(F.col("value").rlike(rf"^[\p{{L}}\p{{Nd}}-]*\.({ID_TYPES})\.[\p{{L}}\p{{Nd}}-]*$"))
    return shaped.join(ids, F.col("value") == F.col("id"), "left_anti")


def variant_items(bases: DataFrame, column: str, variants: list[dict]) -> DataFrame:
    """Every base item with every variant that it meets: variant (its place) and item (JSON). Variants are a few, so no rows are paired by a join."""
    held = json.dumps(variants)

    def make(base):
        rules = json.loads(held)
        made = [(i, J.expanded(v, base)) for i, v in enumerate(rules)] if isinstance(base, dict) else []
        return [(i, json.dumps(m, ensure_ascii=False)) for i, m in made if m is not None]

    return bases.select("*", F.inline(J.arrow(make, "array<struct<variant:int,item:string>>")(F.col(column))))


def with_classes(spells: DataFrame, known: DataFrame) -> DataFrame:
    """``spells`` (name, source) with the classes of ``known`` (name, source, class): of their name and source, else of their name."""
    keyed = known.select(name_key(F.col("name")).alias("kn"), name_key(F.col("source")).alias("ks"), "class")
    exact = keyed.groupBy("kn", "ks").agg(F.collect_set("class").alias("exact"))
    loose = keyed.groupBy(F.col("kn").alias("ln")).agg(F.collect_set("class").alias("loose"))
    joined = spells.join(exact, (name_key(F.col("name")) == F.col("kn")) & (name_key(F.col("source")) == F.col("ks")), "left").join(loose, name_key(F.col("name")) == F.col("ln"), "left")
    return joined.withColumn("classes", F.coalesce("exact", "loose")).drop("kn", "ks", "ln", "exact", "loose")


def book_registry(books: DataFrame) -> DataFrame:
    """id, name, group, year, abbr of books as JSON; without a date the year is 2000, without a group ``other``."""
    got = lambda k: F.get_json_object("book", f"$.{k}")
    year = F.substring(F.coalesce(got("published"), F.lit("2000-01-01")), 1, 4).cast("int")
    rows = books.select(got("id").alias("id"), got("name").alias("name"), F.coalesce(got("group"), F.lit("other")).alias("group"), year.alias("year"))
    return rows.withColumn("abbr", short_name(F.col("id"), F.col("year")))


def short_name(key: Column, year: Column) -> Column:
    return F.concat(F.regexp_replace(key, "^X", ""), F.lit("'"), F.lpad((year % 100).cast("string"), 2, "0"))


def books_of_intent(intents: DataFrame, books: DataFrame) -> DataFrame:
    """intent and the id of each book (id, year, group) that it names."""
    said, group = F.lower(F.trim("intent")), F.lower("group")
    # what a book is named by: an equality join, of any number of books and intents
    names = F.array_compact(F.array(
        *[F.when(group == word, F.lit(name)) for word, spelt in (("core", ("core", "core books")), ("supplement", ("supplement", "supplements")), ("setting", ("setting", "settings"))) for name in spelt],
        *[F.when(F.col("year") < 2020, F.lit(name)) for name in ("2014", "5e")], *[F.when(F.col("year") >= 2024, F.lit(name)) for name in ("2024", "5.5e")]))
    named = intents.withColumn("_said", said).join(books.select("id", F.explode(names).alias("_said")), "_said").select("intent", "id")
    return named.unionByName(intents.where(said.isin("srd", "free rules")).select("intent", F.lit("srd52").alias("id")))


def is_mundane(item: Column) -> Column:
    return F.coalesce(F.lower(F.get_json_object(item, "$.rarity")) == "none", F.lit(True))


def base_kind(item: Column) -> Column:
    code = F.lower(F.split(F.get_json_object(item, "$.type"), r"\|")[0])
    return F.when(F.get_json_object(item, "$.weaponCategory").isNotNull(), "Weapon").when(code.isin(*ARMOR_CODES), "Armor").otherwise("Item")


def challenge_rating(fields: Column) -> Column:
    """A record's challenge rating from text or an object of one; fractions are known, other words and bare numbers are none."""
    text = F.when(F.schema_of_variant(F.try_parse_json(fields)).rlike(r"\bcr: (STRING|OBJECT)"), F.coalesce(F.get_json_object(fields, "$.cr.cr"), F.get_json_object(fields, "$.cr")))
    return challenge_value(text)


def challenge_value(text: Column) -> Column:
    return F.when(text == "1/8", 0.125).when(text == "1/4", 0.25).when(text == "1/2", 0.5).otherwise(text.try_cast("double"))


def spell_level(fields: Column) -> Column:
    """A level that is a whole number; levels as text are none."""
    return F.when(F.schema_of_variant(F.try_parse_json(fields)).rlike(r"\blevel: BIGINT"), F.get_json_object(fields, "$.level").try_cast("int"))


def damage_types(fields: Column) -> Column:
    listed = F.from_json(F.get_json_object(fields, "$.damageInflict"), "array<string>")
    single = F.get_json_object(fields, "$.damage.type")
    return F.coalesce(listed, F.when(single.isNotNull(), F.array(single)))


# What codes in records stand for, and the sentences that each type of record is told in.
SIZES = {"T": "Tiny", "S": "Small", "M": "Medium", "L": "Large", "H": "Huge", "G": "Gargantuan"}
ALIGNMENTS = {"L": "Lawful", "C": "Chaotic", "G": "Good", "E": "Evil", "N": "Neutral", "U": "Unaligned", "A": "Any"}
RULE_TYPES = {"C": "core", "O": "optional", "V": "variant"}
ABILITY_NAMES = {"str": "Strength", "dex": "Dexterity", "con": "Constitution", "int": "Intelligence", "wis": "Wisdom", "cha": "Charisma"}
SENTENCES = {
    "Race": ("{name} — {sizes} race.", " Speed: {speed} ft.", " Traits: {traitTags}.", " {summary}"),
    "Subrace": ("{name}", " ({raceName} subrace).", " {summary}"),
    "Background": ("{name}.", " Skills: {skills}.", " {summary}"),
    "Feat": ("{name}.", " Prerequisite: {needs}.", " {summary}"),
    "Item": ("{name}.", " Type: {type}.", " Value: {gold} gp.", " {summary}"),
    "MagicItem": ("{name}. {rarity?} magic item", " ({type})", ".{attuned?}", " {summary}"),
    "Weapon": ("{name}.", " {weaponCategory} weapon.", " Damage: {dmg1} {dmgType?}.", " {summary}"),
    "Armor": ("{name}. {type?} armor.", " AC: {ac}.", " {summary}"),
    "God": ("{name}.", " {pantheon} pantheon.", " Alignment: {alignments}.", " Domains: {domains}.", " Symbol: {symbol}.", " {summary}"),
    "Trap": ("{name}.", " {trapHazType} trap.", " {summary}"),
    "Condition": ("{name}", ". {summary}"),
    "DiseasePoison": ("{name}", ". {summary}"),
    "VehicleMount": ("{name}.", " {vehicleType}.", " {summary}"),
    "Plane": ("{name}.", " {category}.", " {summary}"),
    "Faction": ("{name}.", " HQ: {headquarters}.", " Goals: {first_goals}.", " {summary}"),
    "Location": ("{name}.", " {category}", " in {setting}", ".", " {summary}"),
    "Lore": ("{name}.", " {category} lore.", " {summary}"),
    "Rule": ("{name}.", " {rule} rule.", " {summary}"),
    "Class": ("{name} — {die} hit die.\n", "Saving throws: {saves}.\n", "Features: {gained}.\n"),
}


def _texts(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _need(key: str, value) -> str:
    """One wish of a prerequisite as words."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    told = lambda e: e if isinstance(e, str) else " ".join(v for v in e.values() if isinstance(v, str)) if isinstance(e, dict) else ""
    groups = [g for g in value if isinstance(g, dict)] if isinstance(value, list) else []
    if key == "race":
        return " or ".join(g["name"] for g in groups if isinstance(g.get("name"), str) and g["name"])
    if key == "ability":
        each = (", ".join(f"{ABILITY_NAMES[a.lower()]} {n}" for a, n in g.items() if a.lower() in ABILITY_NAMES and whole(n)) for g in groups)
        return " or ".join(t for t in each if t)
    if key == "spellcasting":
        return "The ability to cast at least one spell" if value is True else ""
    if key == "level":
        level = value.get("level") if isinstance(value, dict) else value
        return f"Level {level}" if whole(level) else ""
    if key in ("proficiency", "other"):
        return ", ".join(t for t in map(told, value) if t) if isinstance(value, list) else told(value)
    return ""


def _gained(refs) -> str:
    """Features with their levels, by level; references of three parts or more, or objects that say the level."""
    out = []
    for ref in refs if isinstance(refs, list) else []:
        if isinstance(ref, str):
            parts = ref.split("|")
            out += [(parts[0], int(parts[-1]))] if len(parts) >= 3 and parts[-1].strip().isdigit() else []
        elif isinstance(ref, dict) and isinstance(ref.get("classFeature"), str) and isinstance(ref.get("level"), int):
            out.append((ref["classFeature"].split("|")[0], ref["level"]))
    return ", ".join(f"{n} ({level})" for n, level in sorted(out, key=lambda f: f[1]))


def _told(fields: dict) -> dict[str, str]:
    """What the sentences may name, besides the record's own texts and whole numbers."""
    hd, value, attuned = fields.get("hd"), fields.get("value"), fields.get("reqAttune")
    first = fields["entries"][0] if isinstance(fields.get("entries"), list) and fields["entries"] else ""
    wishes = [", ".join(t for t in (_need(k, v) for k, v in e.items()) if t) for e in fields.get("prerequisite") or [] if isinstance(e, dict)]
    own = {k: v if isinstance(v, str) else str(v) for k, v in fields.items() if isinstance(v, str) or (isinstance(v, int) and not isinstance(v, bool) and k in ("speed", "ac"))}
    return own | {
        "summary": J.plain(first) if isinstance(first, str) else "", "sizes": "/".join(SIZES.get(x.upper(), x) for x in _texts(fields.get("size"))) or "Unknown", "traitTags": ", ".join(_texts(fields.get("traitTags"))),
        "skills": ", ".join(k for e in fields.get("skillProficiencies") or [] if isinstance(e, dict) for k in e), "needs": " or ".join(w for w in wishes if w), "gold": str(value // 100) if isinstance(value, int) else "",
        "attuned": " Requires attunement." if attuned not in (None, False) else "", "alignments": " ".join(ALIGNMENTS.get(x.upper(), x) for x in _texts(fields.get("alignment"))), "domains": ", ".join(_texts(fields.get("domains"))),
        "first_goals": "; ".join(_texts(fields.get("goals"))[:2]), "rule": RULE_TYPES.get(str(fields.get("ruleType", "")).upper(), fields.get("ruleType") or ""),
        "die": f"d{hd['faces']}" if isinstance(hd, dict) else "?", "saves": ", ".join(p.upper() for p in fields.get("proficiency") or [] if p), "gained": _gained(fields.get("classFeatures")),
    }


def _render(kind: str | None, name: str | None, fields: str | None, stored: str | None) -> str | None:
    """The sentences whose values are all there (those marked ? may be empty)."""
    if kind not in SENTENCES:
        return stored
    try:
        said = _told(json.loads(fields or "")) | {"name": name or ""}
    except (ValueError, AttributeError, TypeError, KeyError):
        return f"{name} ({kind})"
    out = []
    for sentence in SENTENCES[kind]:
        wanted = [w.rstrip("?") for w in re.findall(r"\{(\w+\??)\}", sentence) if not w.endswith("?")]
        if all(said.get(w) for w in wanted):
            out.append(re.sub(r"\{(\w+)\??\}", lambda m: said.get(m[1]) or "", sentence))
    return "".join(out)


def rendered(kind: Column, name: Column, fields: Column, stored: Column) -> Column:
    """A record as text by its type; of types without sentences what is stored; its name and type where it cannot be read."""
    return F.udf(_render, "string", useArrow=True)(kind, name, fields, stored)


def guarded(item: Column) -> Column:
    """The kinds of roster that take an item: armor codes without a source, a weapon's category, and rarity."""
    got = lambda k: F.get_json_object(item, f"$.{k}")
    rare = got("rarity").isNotNull() & (F.lower(got("rarity")) != "none")
    kinds = F.array(F.when(F.lower(got("type")).isin(*ARMOR_CODES), "Armor"), F.when(got("weaponCategory").isNotNull(), "Weapon"), F.when(rare, "MagicItem").otherwise("Item"))
    return F.filter(kinds, lambda k: k.isNotNull())


def copied(fields: Column, key: str, kind: str) -> Column:
    """A field as JSON if it is of the kind asked for (array, string, int, any); null otherwise."""
    held = F.try_variant_get(F.try_parse_json(fields), f"$.{key}", "variant")
    shape = F.schema_of_variant(held)
    fits = {"array": shape.startswith("ARRAY"), "string": shape == "STRING", "int": shape == "BIGINT", "any": shape != "VOID"}[kind]
    return F.when(fits, F.variant_get(held, "$", "string") if kind in ("string", "int") else F.to_json(held))


def validated(documents: DataFrame, key: str, text: str, versions: tuple[str, ...] = ("1",)) -> DataFrame:
    """key, problem of documents that are no JSON, of an unknown version, without a book, or with a record that lacks id, type or name."""
    held = documents.select(key, F.try_parse_json(text).alias("_v"), F.col(text).alias("_t"))
    missing = F.exists(F.from_json(F.get_json_object("_t", "$.entities"), "array<struct<id:string,type:string,name:string>>"), lambda e: (F.coalesce(e["id"], F.lit("")) == "") | (F.coalesce(e["type"], F.lit("")) == "") | (F.coalesce(e["name"], F.lit("")) == ""))
    problem = (
        F.when(F.col("_v").isNull(), "unreadable")
        .when(~F.coalesce(F.get_json_object("_t", "$.schemaVersion").isin(*versions), F.lit(False)), "unknown version")
        .when(F.get_json_object("_t", "$.book.sourceBook").isNull(), "no book")
        .when(F.coalesce(missing, F.lit(True)), "incomplete record")
    )
    return held.select(key, problem.alias("problem")).where("problem is not null")


def without_sidecars(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.col(name).endswith(".json") & ~F.col(name).rlike(rf"\.({'|'.join(SIDECARS)})\.json$"))


def name_uuid(space: str, name: Column) -> Column:
    """The UUID of version 5 of a name within a name space (a UUID): SHA-1, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8).cast("int")))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def replaced_tables(generic: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Tables made for resolution take the place of generic ones of their id; those of spells stand beside."""
    return generic.join(resolved.select(key), key, "left_anti").unionByName(resolved)


def embedded(rows: DataFrame, text: str, embed, most: int = 800) -> DataFrame:
    """``rows`` with the vector of the text's first ``most`` characters; ``embed`` takes a pandas series of texts and gives one of lists."""
    return rows.withColumn("embedding", F.pandas_udf(embed, "array<float>")(F.substring(text, 1, most)))


def converted(files: DataFrame, cache: DataFrame | None, convert: Column, version: int) -> DataFrame:
    """hash, version, result of files (hash, content): from the cache where it has the hash in this version, else converted."""
    if cache is None:
        return files.select("hash", F.lit(version).alias("version"), convert.alias("result"))
    current = cache.where(F.col("version") == version)
    new = files.join(current, "hash", "left_anti").select("hash", F.lit(version).alias("version"), convert.alias("result"))
    return current.join(files.select("hash"), "hash", "left_semi").select("hash", "version", "result").unionByName(new)
