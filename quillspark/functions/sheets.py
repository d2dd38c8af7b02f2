"""Character-sheet arithmetic: spell slots, pact magic, armor class, saves, prerequisites, breath weapons."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ability_modifier, proficiency

# The published rules' tables.
#: Slots of spell levels 1 to 9 by combined caster level, from 1.
SLOTS = (
    (2, 0, 0, 0, 0, 0, 0, 0, 0),
    (3, 0, 0, 0, 0, 0, 0, 0, 0),
    (4, 2, 0, 0, 0, 0, 0, 0, 0),
    (4, 3, 0, 0, 0, 0, 0, 0, 0),
    (4, 3, 2, 0, 0, 0, 0, 0, 0),
    (4, 3, 3, 0, 0, 0, 0, 0, 0),
    (4, 3, 3, 1, 0, 0, 0, 0, 0),
    (4, 3, 3, 2, 0, 0, 0, 0, 0),
    (4, 3, 3, 3, 1, 0, 0, 0, 0),
    (4, 3, 3, 3, 2, 0, 0, 0, 0),
    (4, 3, 3, 3, 2, 1, 0, 0, 0),
    (4, 3, 3, 3, 2, 1, 0, 0, 0),
    (4, 3, 3, 3, 2, 1, 1, 0, 0),
    (4, 3, 3, 3, 2, 1, 1, 0, 0),
    (4, 3, 3, 3, 2, 1, 1, 1, 0),
    (4, 3, 3, 3, 2, 1, 1, 1, 0),
    (4, 3, 3, 3, 2, 1, 1, 1, 1),
    (4, 3, 3, 3, 3, 1, 1, 1, 1),
    (4, 3, 3, 3, 3, 2, 1, 1, 1),
    (4, 3, 3, 3, 3, 2, 2, 1, 1),
)
#: Base and category of each armor.
ARMOR = {"Padded": (11, "Light"), "Leather": (11, "Light"), "Studded Leather": (12, "Light"), "Hide": (12, "Medium"), "Chain Shirt": (13, "Medium"), "Scale Mail": (14, "Medium"), "Breastplate": (14, "Medium"), "Half Plate": (15, "Medium"), "Ring Mail": (14, "Heavy"), "Chain Mail": (16, "Heavy"), "Splint": (17, "Heavy"), "Plate": (18, "Heavy")}
#: The two saves a starting class is proficient in.
SAVES = {"Barbarian": ("Strength", "Constitution"), "Bard": ("Dexterity", "Charisma"), "Cleric": ("Wisdom", "Charisma"), "Druid": ("Intelligence", "Wisdom"), "Fighter": ("Strength", "Constitution"), "Monk": ("Strength", "Dexterity"), "Paladin": ("Wisdom", "Charisma"), "Ranger": ("Strength", "Dexterity"), "Rogue": ("Dexterity", "Intelligence"), "Sorcerer": ("Constitution", "Charisma"), "Warlock": ("Wisdom", "Charisma"), "Wizard": ("Intelligence", "Wisdom")}
#: Abilities of 13 or more that a second class asks for; all of one of the alternatives.
PREREQUISITES = {
    "Barbarian": (("Strength",),),
    "Bard": (("Charisma",),),
    "Cleric": (("Wisdom",),),
    "Druid": (("Wisdom",),),
    "Fighter": (("Strength",), ("Dexterity",)),
    "Monk": (("Dexterity", "Wisdom"),),
    "Paladin": (("Strength", "Charisma"),),
    "Ranger": (("Dexterity", "Wisdom"),),
    "Rogue": (("Dexterity",),),
    "Sorcerer": (("Charisma",),),
    "Warlock": (("Charisma",),),
    "Wizard": (("Intelligence",),),
    "Artificer": (("Intelligence",),),
}


def _lookup(table: dict, key: Column) -> Column:
    """The entry whose name equals ``key`` in any case; null for others."""
    pairs = [F.lit(x) for name, value in table.items() for x in (name.lower(), value)]
    return F.try_element_at(F.create_map(*pairs), F.lower(key))


def spell_slots(kind: Column, level: Column) -> Column:
    """Nine slot counts; kind is multiclass, half or third.

    A half caster has from level 2, a third caster from level 3, what the table gives a
    full caster of half or a third of the level, rounded up.  Levels beyond 20 count as 20;
    levels without slots and other kinds have nine zeros.
    """
    capped = F.least(level, F.lit(20))
    row = F.when(kind == "multiclass", capped).when((kind == "half") & (level >= 2), F.ceil(capped / 2)).when((kind == "third") & (level >= 3), F.ceil(capped / 3)).otherwise(0).cast("int")
    rows = F.array(*[F.array(*[F.lit(n) for n in (0,) * 9]), *[F.array(*[F.lit(n) for n in slots]) for slots in SLOTS]])
    return F.element_at(rows, F.greatest(F.coalesce(row, F.lit(0)), F.lit(0)) + 1)


def pact_slots(level: Column) -> Column:
    """Number of pact slots; null below level 1."""
    return F.when(level < 1, None).when(level == 1, 1).when(level <= 10, 2).when(level <= 16, 3).when(level > 16, 4)


def pact_slot_level(level: Column) -> Column:
    return F.when(level >= 1, F.least(F.floor((level + 1) / 2).cast("int"), F.lit(5)))


def armor_class(name: Column, classes: Column, dexterity: Column, constitution: Column, wisdom: Column, shield: Column, magic: Column) -> Column:
    """Armor class of scores, worn armor and an array of classes; null for an unknown armor, which needs review.

    Without armor, 10 and dexterity, or a barbarian's or (without a shield) a monk's defence if better.
    """
    dex = ability_modifier(dexterity)
    held = F.transform(classes, F.lower)
    tough = F.when(F.array_contains(held, "barbarian"), ability_modifier(constitution)).otherwise(0)
    calm = F.when(F.array_contains(held, "monk") & ~shield, ability_modifier(wisdom)).otherwise(0)
    bare = F.lower(F.trim(F.coalesce(name, F.lit("")))).isin("", "none")
    kind = _lookup({n: c for n, (_, c) in ARMOR.items()}, name)
    worn = _lookup({n: b for n, (b, _) in ARMOR.items()}, name) + F.when(kind == "Light", dex).when(kind == "Medium", F.least(dex, F.lit(2))).otherwise(0)
    base = F.when(bare, dex + 10 + F.greatest(tough, calm, F.lit(0))).otherwise(worn)
    return base + F.when(shield, 2).otherwise(0) + F.coalesce(magic, F.lit(0))


def save_bonus(start_class: Column, ability: Column, score: Column, level: Column) -> Column:
    """Saving-throw bonus; null for a class without known saves."""
    pairs = [x for name, pair in SAVES.items() for x in (F.lit(name.lower()), F.array(*[F.lit(a.lower()) for a in pair]))]
    skilled = F.array_contains(F.try_element_at(F.create_map(*pairs), F.lower(start_class)), F.lower(ability))
    return ability_modifier(score) + F.when(skilled, proficiency(level)).when(~skilled, 0)


def may_multiclass(wanted: Column, scores: dict[str, Column]) -> Column:
    """Whether the scores, by ability, let one take the class; false for an unknown class."""
    allowed = F.lit(False)
    for name, alternatives in PREREQUISITES.items():
        met = reduce(or_, (reduce(and_, (scores[ability] >= 13 for ability in group)) for group in alternatives))
        allowed = F.when(F.lower(wanted) == name.lower(), met).otherwise(allowed)
    return allowed


def breath_dice(level: Column) -> Column:
    return F.when(level <= 5, "1d10").when(level <= 10, "2d6").when(level <= 15, "3d6").otherwise("4d6")


def breath_save(level: Column, constitution: Column) -> Column:
    return 8 + proficiency(level) + ability_modifier(constitution)
