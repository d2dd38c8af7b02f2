"""Rules that advise: crafting, encounters built to a budget, dice with modes, levels gained, parsing of wishes."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# Workweeks and gold that a magic item of each rarity takes.
MAGIC_CRAFT = {"Common": (1, 50), "Uncommon": (2, 200), "Rare": (10, 2000), "VeryRare": (25, 20000), "Legendary": (50, 100000)}
# What another class brings by way of proficiencies.
SUBSETS = {
    "Barbarian": ("shields", "simple weapons", "martial weapons"),
    "Bard": ("light armor", "one skill", "one musical instrument"),
    "Cleric": ("light armor", "medium armor", "shields"),
    "Druid": ("light armor", "medium armor", "shields"),
    "Fighter": ("light armor", "medium armor", "shields", "simple weapons", "martial weapons"),
    "Monk": ("simple weapons", "shortswords"),
    "Paladin": ("light armor", "medium armor", "shields", "simple weapons", "martial weapons"),
    "Ranger": ("light armor", "medium armor", "shields", "simple weapons", "martial weapons", "one skill"),
    "Rogue": ("light armor", "one skill", "thieves' tools"),
    "Sorcerer": (),
    "Warlock": ("light armor", "simple weapons"),
    "Wizard": (),
    "Artificer": ("light armor", "medium armor", "shields", "thieves' tools", "tinker's tools"),
}
# Casting abilities, and parties by theme: the words that call for one, its roles and archetypes.
CASTING = {"Bard": "Charisma", "Cleric": "Wisdom", "Druid": "Wisdom", "Paladin": "Charisma", "Ranger": "Wisdom", "Sorcerer": "Charisma", "Warlock": "Charisma", "Wizard": "Intelligence", "Artificer": "Intelligence"}
ABILITIES = ("Strength", "Dexterity", "Constitution", "Intelligence", "Wisdom", "Charisma")
PARTIES = (
    ("criminal", ("criminal", "heist", "gang", "thie", "smuggl", "crime"), (("leader", "Bandit Captain"), ("enforcer", "Thug"), ("enforcer", "Thug"), ("informant", "Spy"))),
    ("military", ("military", "guard", "watch", "soldier", "mercenary", "garrison"), (("commander", "Veteran"), ("soldier", "Guard"), ("soldier", "Guard"), ("scout", "Scout"))),
    ("cult", ("cult", "temple", "zealot", "heretic", "sect"), (("high priest", "Cult Fanatic"), ("cultist", "Cultist"), ("cultist", "Cultist"), ("acolyte", "Acolyte"))),
    ("noble", ("noble", "court", "political", "intrigue", "house", "aristocra"), (("noble", "Noble"), ("bodyguard", "Guard"), ("bodyguard", "Guard"), ("agent", "Spy"))),
    ("arcane", ("arcane", "mage", "wizard", "arcanist", "sorcer"), (("archmage", "Mage"), ("apprentice", "Acolyte"), ("warden", "Guard"), ("warden", "Guard"))),
)
DEFAULT_PARTY = (("captain", "Veteran"), ("guard", "Guard"), ("guard", "Guard"), ("townsfolk", "Commoner"))
MOST_MONSTERS = 15
DICE = r"^\s*(\d+)?[dD](4|6|8|10|12|20|100)\s*([+-]\s*\d+)?\s*([aA][dD][vV](?:[aA][nN][tT][aA][gG][eE])?|[dD][iI][sS](?:[aA][dD][vV][aA][nN][tT][aA][gG][eE])?)?\s*$"


def craft_days(value: Column, crafters: Column) -> Column:
    """Days for an item of market value in gold: a workweek for each 50, shared by the crafters; null for none of value."""
    return F.when(value > 0, F.ceil(value / 50 / F.greatest(crafters, F.lit(1)) * 5).cast("int"))


def craft_materials(value: Column) -> Column:
    return F.when(value > 0, F.floor(value / 2).cast("int"))


def magic_craft(rarity: Column) -> Column:
    """struct of workweeks and gold; null for no rarity."""
    pairs = [x for k, (w, g) in MAGIC_CRAFT.items() for x in (F.lit(k), F.struct(F.lit(w).alias("workweeks"), F.lit(g).alias("gold")))]
    return F.try_element_at(F.create_map(*pairs), rarity)


def rarity_of(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("very rare", "veryrare", "very-rare"), "VeryRare").when(low.isin("common", "uncommon", "rare", "legendary"), F.initcap(low))


def edition_of(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)).isin("2024", "edition2024"), "Edition2024").otherwise("Edition2014")


def difficulty_of(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("trivial", "easy", "hard", "deadly"), F.initcap(low)).otherwise("Medium")


def edition_of_source(year: Column, key: Column, later: list[str]) -> Column:
    return F.when((year >= 2024) | key.isin(later), "Edition2024").otherwise("Edition2014")


def highest_challenge(xp: Column) -> Column:
    """The highest challenge rating worth no more than the experience; 0 for less than any."""
    held = F.array(*[F.struct(F.lit(float(c)).alias("cr"), F.lit(x).alias("xp")) for c, x in rules.CR_XP.items()])
    return F.coalesce(F.array_max(F.transform(F.filter(held, lambda p: p["xp"] <= xp), lambda p: p["cr"])), F.lit(0.0))


def dice(text: Column) -> Column:
    """struct of count, die, modifier and mode; null for what is no roll within bounds. A mode goes with one d20 only."""
    part = lambda i: F.regexp_extract(text, DICE, i)
    count = F.when(part(1) == "", F.lit(1)).otherwise(part(1).try_cast("int"))
    modifier = F.when(part(3) == "", F.lit(0)).otherwise(F.regexp_replace(part(3), " ", "").try_cast("int"))
    mode = F.when(part(4) == "", "Normal").when(F.lower(part(4)).startswith("adv"), "Advantage").otherwise("Disadvantage")
    die = part(2).try_cast("int")
    fits = text.rlike(DICE) & count.between(1, 100) & modifier.between(-1000, 1000) & ((mode == "Normal") | ((die == 20) & (count == 1)))
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(count.alias("count"), die.alias("die"), modifier.alias("modifier"), mode.alias("mode")))


def rolled(text: Column, seed: Column) -> Column:
    """A roll's total, by a seed: each die from a hash of the seed and its place, so that a roll is the same again. Null for what is no roll."""
    x = dice(text)
    face = lambda i: F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("long") % x["die"] + 1
    thrown = F.transform(F.sequence(F.lit(1), F.when(x["mode"] == "Normal", x["count"]).otherwise(2)), face)
    total = F.when(x["mode"] == "Normal", F.aggregate(thrown, F.lit(0).cast("long"), lambda s, n: s + n)).when(x["mode"] == "Advantage", F.array_max(thrown)).otherwise(F.array_min(thrown))
    return F.when(x.isNotNull(), total + x["modifier"])


def spell_numbers(level: Column, score: Column) -> tuple[Column, Column]:
    """(save DC, attack bonus) of a caster."""
    own = rules.proficiency(level) + rules.ability_modifier(score)
    return own + 8, own


def highest_ability(scores: list[str]) -> Column:
    """The first of the abilities, in their order, with the highest score."""
    top = F.greatest(*scores)
    out = F.lit(None).cast("string")
    for name in reversed(scores):
        out = F.when(F.col(name) == top, F.lit(name)).otherwise(out)
    return out


def level_up_hit_points(faces: Column, constitution: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(faces, F.lit(8)) / 2).cast("int") + 1 + rules.ability_modifier(constitution))


def party_of_theme(theme: Column) -> Column:
    """The first party of which a word stands in the theme, else the default one."""
    low = F.lower(F.coalesce(theme, F.lit("")))
    out = F.lit("default")
    for name, words, _ in reversed(PARTIES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


# -- encounters ------------------------------------------------------------------------------------------------------


def _budget(levels: list[int], later: bool) -> list[int]:
    table = rules.BUDGETS_2024 if later else rules.BUDGETS_2014
    return [sum(table[v - 1][band] for v in levels) for band in range(len(table[0]))]


def assess(levels: list[int], xps: list[int], later: bool) -> tuple[int, int]:
    """(band, 0 for trivial; adjusted experience) of monsters for a party."""
    total, n = sum(xps), len(xps)
    step = max((k for k, (least, _) in enumerate(rules.MULTIPLIERS) if n >= least), default=0)
    step += 1 if len(levels) < 3 else -1 if len(levels) > 5 else 0
    factor = 1.0 if later or not n else rules.STEPS[min(max(step, 0), len(rules.STEPS) - 1)]
    adjusted = int(total * factor + 0.5)
    return sum(adjusted >= b for b in _budget(levels, later)), adjusted


def build_encounter(levels: list[int], target: int, later: bool, xps: list[int]) -> tuple[list[int], int, int, bool, str | None, int | None]:
    """Monsters picked one by one (their places), the band and adjusted experience they come to, whether that is the target,
    and why not: ``overshoot`` with the band that every further monster would come to at least, or ``scarce``.

    The first pick is the anchor; later picks are worth less than it where any are. Each pick is the first of those that
    come to most without passing the target; at most fifteen. Bands end at hard in the later edition.
    """
    budget, n = _budget(levels, later), len(levels)
    target = min(target, len(budget))
    shift = 1 if n < 3 else -1 if n > 5 else 0
    picked: list[int] = []
    total = band = adjusted = 0
    reason, over = None, None
    while band != target and len(picked) < MOST_MONSTERS:
        step = max((k for k, (least, _) in enumerate(rules.MULTIPLIERS) if len(picked) + 1 >= least), default=0) + shift
        factor = 1.0 if later else rules.STEPS[min(max(step, 0), len(rules.STEPS) - 1)]
        cheaper = [i for i, x in enumerate(xps) if picked and x < xps[picked[0]]]
        best, passed = None, None
        for i in cheaper or range(len(xps)):
            worth = int((total + xps[i]) * factor + 0.5)
            at = sum(worth >= b for b in budget)
            if at > target:
                passed = at if passed is None else min(passed, at)
            elif best is None or worth > best[1]:
                best = (i, worth, at)
        if best is None:
            reason, over = ("overshoot", passed) if xps else (None, None)
            break
        picked.append(best[0])
        total, adjusted, band = total + xps[best[0]], best[1], best[2]
    matched = band == target
    return picked, band, adjusted, matched, None if matched else reason or "scarce", None if matched else over


def level_choices(level: Column, gained: Column, title: Column, subclass: Column, caster: Column) -> Column:
    """What a level just reached leaves to choose: an ability score improvement, the subclass at the first feature that holds its title, spells where a higher level of them opens."""
    holds = lambda word: F.exists(gained, lambda g: F.contains(F.lower(g), F.lower(word)))
    top = lambda v: F.when(v < 1, 0).otherwise(F.least(F.floor((v + 1) / 2), F.lit(9)))
    return F.array_compact(F.array(
        F.when(holds(F.lit("ability score improvement")), "ability"), F.when((F.trim(title) != "") & holds(title) & (F.trim(F.coalesce(subclass, F.lit(""))) == ""), "subclass"),
        F.when(caster & (top(level) > top(level - 1)), "spells")))
