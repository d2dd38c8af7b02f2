"""Monsters, spells, subclasses and objects as text, by functions that Spark knows.

A record's fields are JSON. A line is told if the record has what it is about; what has another shape than a line asks
for is passed over. Markup within texts is read as its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What codes stand for. A monster's alignments differ from other records' in "any".
SIZES = {"T": "Tiny", "S": "Small", "M": "Medium", "L": "Large", "H": "Huge", "G": "Gargantuan"}
ALIGNMENTS = {"L": "Lawful", "C": "Chaotic", "G": "Good", "E": "Evil", "N": "Neutral", "U": "Unaligned", "A": "Any alignment", "NX": "non-chaotic", "NY": "non-evil"}
SCHOOLS = {"A": "Abjuration", "C": "Conjuration", "D": "Divination", "E": "Enchantment", "I": "Illusion", "N": "Necromancy", "T": "Transmutation", "V": "Evocation"}
ABILITIES = ("str", "dex", "con", "int", "wis", "cha")

_TOLD = "array<struct<name:string,entries:array<variant>>>"
_BODY = "ac:array<variant>,hp:struct<average:int,formula:string>,action:" + _TOLD
_MONSTER = f"struct<size:array<string>,type:variant,alignment:array<string>,speed:map<string,variant>,{','.join(a + ':int' for a in ABILITIES)},cr:variant,trait:{_TOLD},legendary:array<struct<name:string>>,{_BODY}>"
_OBJECT = f"struct<immune:array<variant>,resist:array<variant>,vulnerable:array<variant>,conditionImmune:array<variant>,description:string,{_BODY}>"
_SPELL = "struct<level:int,school:string,time:array<struct<number:int,unit:string>>,range:struct<type:string,distance:struct<type:string,amount:int>>,components:struct<v:boolean,s:boolean,m:variant>,duration:array<struct<type:string,duration:struct<type:string,amount:int>>>,concentration:boolean,classes:array<string>,entries:array<variant>,entriesHigherLevel:array<variant>>"
_SUBCLASS = "struct<className:string,subclassFeatures:array<variant>>"


def _is(v: Column, kind: str) -> Column:
    shape = F.schema_of_variant(v)
    return F.coalesce(shape.startswith("OBJECT") if kind == "OBJECT" else shape == kind, F.lit(False))


def _string(v: Column, path: str = "$") -> Column:
    """A variant's string there; null for anything else."""
    held = F.try_variant_get(v, path, "variant")
    return F.when(_is(held, "STRING"), F.try_variant_get(held, "$", "string"))


def _number(v: Column, path: str = "$") -> Column:
    """A variant's whole number there as text; null for anything else."""
    held = F.try_variant_get(v, path, "variant")
    return F.when(_is(held, "BIGINT"), F.try_variant_get(held, "$", "string"))


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"\{@\w+\s([^|}]+)[^}]*\}", "$1")


def _known(table: dict[str, str], code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.upper(code)), code)


def _joined(parts: Column, by: str) -> Column:
    """Null for no parts."""
    return F.when(F.size(parts) > 0, F.array_join(parts, by))


def _lines(*lines: Column) -> Column:
    """The lines that there are, each ended."""
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))


def _line(label: str, value: Column, end: str = "") -> Column:
    return F.concat(F.lit(label), value, F.lit(end))


def _armor(ac: Column) -> Column:
    first = F.get(ac, F.lit(0))
    return F.when(F.size(ac) > 0, _line("AC ", F.coalesce(_number(first), _number(first, "$.ac"), F.lit("?"))))


def _hit_points(hp: Column) -> Column:
    return F.when(hp.isNotNull(), F.concat(F.lit("HP "), F.coalesce(hp["average"].cast("string"), F.lit("")), F.coalesce(_line(" (", hp["formula"], ")"), F.lit(""))))


def _told(label: str, rows: Column) -> Column:
    """A heading and a line for each name, with its first entry where that is text."""
    each = F.transform(rows, lambda r: F.concat(F.lit("  "), F.coalesce(r["name"], F.lit("")), F.coalesce(_line(": ", F.nullif(without_tags(_string(F.get(r["entries"], F.lit(0)))), F.lit(""))), F.lit(""))))
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"{label}:\n"), F.array_join(each, "\n")))


def monster(name: Column, fields: Column) -> Column:
    f = F.from_json(fields, _MONSTER)
    size = F.coalesce(_joined(F.transform(f["size"], lambda s: _known(SIZES, s)), ", "), F.lit("Unknown"))
    kind = F.coalesce(_string(f["type"]), _string(f["type"], "$.type"), F.lit("unknown"))
    alignment = F.coalesce(_joined(F.transform(f["alignment"], lambda a: _known(ALIGNMENTS, a)), " "), F.lit("unaligned"))
    pace = lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(_line("", _number(e["value"]), " ft."), _string(e["value"]), F.lit("?")))
    scores = F.array_compact(F.array(*[_line(f"{a.upper()} ", f[a].cast("string")) for a in ABILITIES]))
    rating = F.coalesce(_string(f["cr"]), _string(f["cr"], "$.cr"), _number(f["cr"], "$.cr"), F.lit("?"))
    return _lines(
        F.concat(name, F.lit(" — "), size, F.lit(" "), kind, F.lit(", "), alignment), _armor(f["ac"]), _hit_points(f["hp"]),
        F.when(f["speed"].isNotNull(), _line("Speed ", F.array_join(F.transform(F.map_entries(f["speed"]), pace), ", "))), _joined(scores, " "), _line("CR ", rating),
        _told("Traits", f["trait"]), _told("Actions", f["action"]), _joined(F.transform(f["legendary"], lambda x: _line("Legendary — ", F.coalesce(x["name"], F.lit("")))), "\n"))


def thing(name: Column, fields: Column) -> Column:
    """An object, such as a siege weapon."""
    f = F.from_json(fields, _OBJECT)
    said = lambda label, rows: _line(f"{label}: ", _joined(F.filter(F.transform(rows, lambda v: F.coalesce(_string(v), F.to_json(v))), lambda t: F.trim(t) != ""), ", "))
    lists = (("Damage Immunities", "immune"), ("Damage Resistances", "resist"), ("Damage Vulnerabilities", "vulnerable"), ("Condition Immunities", "conditionImmune"))
    prose = F.when(F.trim(f["description"]) != "", without_tags(f["description"]))
    return _lines(F.concat(name, F.lit(" — Object")), _armor(f["ac"]), _hit_points(f["hp"]), *[said(label, f[key]) for label, key in lists], _told("Actions", f["action"]), prose)


def _prose(entries: Column, depth: int = 3) -> Column:
    """The texts of entries, of the entries or else the items within them, to a depth; null without any."""
    def texts(rows: Column, left: int) -> Column:
        own = lambda v: F.when(_is(v, "STRING"), F.array(without_tags(_string(v))))
        if not left:
            return F.flatten(F.transform(rows, lambda v: F.coalesce(own(v), F.array().cast("array<string>"))))
        inner = lambda v: texts(F.coalesce(F.try_variant_get(v, "$.entries", "array<variant>"), F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>")), left - 1)
        return F.flatten(F.transform(rows, lambda v: F.coalesce(own(v), inner(v))))

    return _joined(texts(entries, depth), "\n")


def spell(name: Column, fields: Column) -> Column:
    f = F.from_json(fields, _SPELL)
    school = F.coalesce(_known(SCHOOLS, f["school"]), F.lit(""))
    level = F.coalesce(f["level"], F.lit(0))
    nth = F.concat(level.cast("string"), F.when(level == 1, "st").when(level == 2, "nd").when(level == 3, "rd").otherwise("th"))
    words = lambda *parts: F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if not isinstance(p, str) else F.lit(p) for p in parts])
    time, lasts = F.get(f["time"], F.lit(0)), F.get(f["duration"], F.lit(0))
    reach, parts = f["range"]["distance"], f["components"]
    material = F.coalesce(_line("M (", F.coalesce(_string(parts["m"]), _string(parts["m"], "$.text")), ")"), F.when(parts["m"].isNotNull(), "M"))
    timed = F.when((lasts["type"] == "timed") & lasts["duration"]["amount"].isNotNull() & lasts["duration"]["type"].isNotNull(), words(lasts["duration"]["amount"], " ", lasts["duration"]["type"]))
    length = F.coalesce(F.when(lasts["type"] == "instant", "Instantaneous").when(lasts["type"] == "permanent", "Until dispelled"), timed, lasts["type"], F.lit(""))
    head = _lines(
        words(name, " — ", F.when(level == 0, words(school, " cantrip")).otherwise(words(nth, "-level ", school))),
        F.when(F.size(f["time"]) > 0, words("Casting Time: ", time["number"], " ", time["unit"])),
        F.when(reach["amount"].isNotNull(), words("Range: ", reach["amount"], " ", reach["type"])).when(f["range"].isNotNull(), words("Range: ", f["range"]["type"])),
        F.when(parts.isNotNull(), _line("Components: ", F.array_join(F.array_compact(F.array(F.when(parts["v"], "V"), F.when(parts["s"], "S"), material)), ", "))),
        F.when(F.size(f["duration"]) > 0, words("Duration: ", F.when(f["concentration"], "Concentration, up to "), length)),
        F.when(F.size(f["classes"]) > 0, _line("Classes: ", F.array_join(f["classes"], ", "))))
    body = F.coalesce(_line("", _prose(f["entries"]), "\n"), F.lit(""))
    higher = F.when(F.size(f["entriesHigherLevel"]) > 0, F.concat(F.lit("\nAt Higher Levels: "), F.coalesce(_line("", _prose(f["entriesHigherLevel"]), "\n"), F.lit(""))))
    return F.concat(head, F.lit("\n"), body, F.coalesce(higher, F.lit("")))


def subclass(name: Column, fields: Column) -> Column:
    """Features, by reference ``name|…|level`` or an object of one and its level, in order of level."""
    f = F.from_json(fields, _SUBCLASS)
    def told(v: Column, place: Column) -> Column:
        text, named = F.split(_string(v), r"\|"), _string(v, "$.subclassFeature")
        level = F.when(F.size(text) >= 2, F.element_at(text, -1).try_cast("int")).otherwise(F.when(named.isNotNull(), _number(v, "$.level").try_cast("int")))
        return F.struct(level.alias("level"), place.alias("place"), F.coalesce(F.get(text, F.lit(0)), F.split_part(named, F.lit("|"), F.lit(1))).alias("name"))

    levelled = F.filter(F.transform(F.coalesce(f["subclassFeatures"], F.array().cast("array<variant>")), told), lambda x: x["level"].isNotNull())
    gained = F.transform(F.array_sort(levelled), lambda x: F.concat(x["name"], F.lit(" ("), x["level"].cast("string"), F.lit(")")))
    return _lines(F.concat(name, F.lit(" ("), F.coalesce(f["className"], F.lit("")), F.lit(" subclass).")), _line("Features: ", _joined(gained, ", "), "."))


RENDERERS = {"Monster": monster, "Spell": spell, "Subclass": subclass, "Object": thing}


def rendered(kind: Column, name: Column, fields: Column) -> Column:
    """A record of one of the four types as text; of fields that are no JSON, its name and type. Null for other types."""
    readable = F.try_parse_json(fields).isNotNull()
    plain = F.concat(name, F.lit(" ("), kind, F.lit(")"))
    told = reduce(lambda out, k: out.when(kind == k, RENDERERS[k](name, fields)), RENDERERS, F.when(F.lit(False), name))
    return F.when(kind.isin(*RENDERERS), F.when(readable, F.coalesce(told, plain)).otherwise(plain))
