"""Character-sheet queries: the rows of ``part`` are read as sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sheets
from ..sources.tables import table

_CLASSES = list(sheets.PREREQUISITES)
_ARMOR = [*sheets.ARMOR, "None", "Bark"]


def _score(step: int):
    return (F.pmod(F.col("p_partkey") * step, F.lit(15)) + 6).cast("int")


def _pick(names: list[str], step: int):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.floor(F.col("p_partkey") / step), F.lit(len(names))) + 1).cast("int"))


def spell_slot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("multiclass"), F.lit("half"), F.lit("third"), F.lit("none")), (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int"))
    slots = sheets.spell_slots(kind, F.pmod(F.col("p_size"), F.lit(23)))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.array_join(slots.cast("array<string>"), ",").alias("slots"))


def pact_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.pmod(F.col("p_size"), F.lit(21))
    return table(spark, sf_dir, "part").select("p_partkey", sheets.pact_slots(level).alias("slots"), sheets.pact_slot_level(level).alias("slot_level"))


def armor_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sheets.armor_class(_pick(_ARMOR, 1), F.array(_pick(_CLASSES, 3), _pick(_CLASSES, 5)), _score(1), _score(2), _score(4), F.pmod(F.col("p_partkey"), F.lit(2)) == 0, F.pmod(F.col("p_size"), F.lit(3)))
    return table(spark, sf_dir, "part").select("p_partkey", total.alias("armor_class"))


def save_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = sheets.save_bonus(_pick(_CLASSES, 1), F.lit("wisdom"), _score(4), F.greatest(F.pmod(F.col("p_size"), F.lit(21)), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", bonus.alias("bonus"))


def multiclass_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {"Strength": _score(1), "Dexterity": _score(2), "Constitution": _score(4), "Intelligence": _score(7), "Wisdom": _score(8), "Charisma": _score(11)}
    return table(spark, sf_dir, "part").select("p_partkey", sheets.may_multiclass(_pick(_CLASSES, 1), scores).alias("allowed"))


def breath_weapon(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.pmod(F.col("p_size"), F.lit(20)) + 1
    return table(spark, sf_dir, "part").select("p_partkey", sheets.breath_dice(level).alias("dice"), sheets.breath_save(level, _score(2)).alias("save_dc"))


QUERIES = {f.__name__: f for f in (spell_slot_table, pact_magic, armor_class, save_bonus, multiclass_allowed, breath_weapon)}

_SLOT_ROWS = "[" + ",".join("'" + ",".join(map(str, row)) + "'" for row in sheets.SLOTS) + "]"
_NAMES = "[" + ",".join(f"'{n}'" for n in _CLASSES) + "]"
_WORN = "[" + ",".join(f"'{n}'" for n in _ARMOR) + "]"
_CASE = "case kind when 'multiclass' then l when 'half' then case when l < 2 then 0 else (l + 1) // 2 end when 'third' then case when l < 3 then 0 else (l + 2) // 3 end else 0 end"


def _modifier(step: int) -> str:
    return f"floor((p_partkey * {step} % 15 + 6 - 10) / 2.0)::int"


def _at_least(step: int) -> str:
    return f"(p_partkey * {step} % 15 + 6 >= 13)"


ORACLES = {
    "spell_slot_table": f"with s as (select p_partkey, ['multiclass','half','third','none'][p_partkey % 4 + 1] as kind, least(p_size % 23, 20) as l from part) select p_partkey, kind, coalesce({_SLOT_ROWS}[nullif({_CASE}, 0)], '0,0,0,0,0,0,0,0,0') as slots from s",
    "pact_magic": "with s as (select p_partkey, p_size % 21 as l from part) select p_partkey, case when l < 1 then null when l = 1 then 1 when l < 11 then 2 when l < 17 then 3 else 4 end as slots, case when l < 1 then null when l < 3 then 1 when l < 5 then 2 when l < 7 then 3 when l < 9 then 4 else 5 end as slot_level from s",
    "armor_class": f"""with s as (select p_partkey, {_WORN}[p_partkey % {len(_ARMOR)} + 1] as worn, [{_NAMES}[p_partkey // 3 % 13 + 1], {_NAMES}[p_partkey // 5 % 13 + 1]] as held, {_modifier(1)} as dex, {_modifier(2)} as con, {_modifier(4)} as wis, p_partkey % 2 = 0 as shield, p_size % 3 as magic from part)
        select p_partkey, case when worn = 'None' then 10 + dex + greatest(0, case when list_contains(held, 'Barbarian') then con else 0 end, case when list_contains(held, 'Monk') and not shield then wis else 0 end)
            when worn in ('Padded', 'Leather') then 11 + dex when worn = 'Studded Leather' then 12 + dex when worn = 'Hide' then 12 + least(dex, 2) when worn = 'Chain Shirt' then 13 + least(dex, 2)
            when worn in ('Scale Mail', 'Breastplate') then 14 + least(dex, 2) when worn = 'Half Plate' then 15 + least(dex, 2) when worn = 'Ring Mail' then 14 when worn = 'Chain Mail' then 16 when worn = 'Splint' then 17 when worn = 'Plate' then 18 end
            + case when shield then 2 else 0 end + magic as armor_class from s""",
    "save_bonus": f"with s as (select p_partkey, {_NAMES}[p_partkey % 13 + 1] as c, {_modifier(4)} as wis, greatest(p_size % 21, 1) as l from part) select p_partkey, case when c = 'Artificer' then null when c in ('Cleric', 'Druid', 'Paladin', 'Warlock', 'Wizard') then wis + 2 + (l - 1) // 4 else wis end::int as bonus from s",
    "multiclass_allowed": f"with s as (select p_partkey, {_NAMES}[p_partkey % 13 + 1] as c, {_at_least(1)} as st, {_at_least(2)} as de, {_at_least(7)} as it, {_at_least(8)} as wi, {_at_least(11)} as ch from part) select p_partkey, case when c = 'Barbarian' then st when c in ('Bard', 'Sorcerer', 'Warlock') then ch when c in ('Cleric', 'Druid') then wi when c = 'Fighter' then st or de when c in ('Monk', 'Ranger') then de and wi when c = 'Paladin' then st and ch when c = 'Rogue' then de else it end as allowed from s",
    "breath_weapon": f"with s as (select p_partkey, p_size % 20 + 1 as l, {_modifier(2)} as con from part) select p_partkey, case when l < 6 then '1d10' when l < 11 then '2d6' when l < 16 then '3d6' else '4d6' end as dice, (8 + 2 + (l - 1) // 4 + con)::int as save_dc from s",
}
