"""Lookup-table arithmetic of the game rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules' tables.
CR_XP = {0.0: 10, 0.125: 25, 0.25: 50, 0.5: 100, 1.0: 200, 2.0: 450, 3.0: 700, 4.0: 1100, 5.0: 1800, 6.0: 2300, 7.0: 2900, 8.0: 3900, 9.0: 5000, 10.0: 5900, 11.0: 7200, 12.0: 8400, 13.0: 10000, 14.0: 11500, 15.0: 13000, 16.0: 15000, 17.0: 18000, 18.0: 20000, 19.0: 22000, 20.0: 25000, 21.0: 33000, 22.0: 41000, 23.0: 50000, 24.0: 62000, 25.0: 75000, 26.0: 90000, 27.0: 105000, 28.0: 120000, 29.0: 135000, 30.0: 155000}
#: Monster count from which each multiplier holds, for parties of three to five.
MULTIPLIERS = ((1, 1.0), (2, 1.5), (3, 2.0), (7, 2.5), (11, 3.0), (15, 4.0))
STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
#: Experience of a party member by level, from 1, from which an encounter is easy, medium, hard, deadly.
BUDGETS_2014 = (
    (25, 50, 75, 100),
    (50, 100, 150, 200),
    (75, 150, 225, 400),
    (125, 250, 375, 500),
    (250, 500, 750, 1100),
    (300, 600, 900, 1400),
    (350, 750, 1100, 1700),
    (450, 900, 1400, 2100),
    (550, 1100, 1600, 2400),
    (600, 1200, 1900, 2800),
    (800, 1600, 2400, 3600),
    (1000, 2000, 3000, 4500),
    (1100, 2200, 3400, 5100),
    (1250, 2500, 3800, 5700),
    (1400, 2800, 4300, 6400),
    (1600, 3200, 4800, 7200),
    (2000, 3900, 5900, 8800),
    (2100, 4200, 6300, 9500),
    (2400, 4900, 7300, 10900),
    (2800, 5700, 8500, 12700),
)
#: The same for the later edition, which has no deadly band.
BUDGETS_2024 = (
    (50, 75, 100),
    (100, 150, 200),
    (150, 225, 400),
    (250, 375, 500),
    (500, 750, 1100),
    (600, 1000, 1400),
    (750, 1300, 1700),
    (1000, 1700, 2100),
    (1300, 2000, 2600),
    (1600, 2300, 3100),
    (1900, 2900, 4100),
    (2200, 3700, 4700),
    (2600, 4200, 5400),
    (2900, 4900, 6200),
    (3300, 5400, 7800),
    (3800, 6100, 9800),
    (4500, 7200, 11700),
    (5000, 8700, 14200),
    (5500, 10700, 17200),
    (6400, 13200, 22000),
)
BANDS = ("Easy", "Medium", "Hard", "Deadly")


def ability_modifier(score: Column) -> Column:
    return F.floor((score - 10) / 2.0).cast("int")


def proficiency(level: Column) -> Column:
    return F.floor((F.greatest(level, F.lit(1)) - 1) / 4).cast("int") + 2


def challenge_xp(cr: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CR_XP.items() for x in pair]), cr.cast("double"))


def encounter_multiplier(monsters: Column, party: Column) -> Column:
    """The count's band, a band up for parties under three and down for parties over five, within the steps."""
    band = F.lit(0)
    for k, (least, _) in enumerate(MULTIPLIERS):
        band = F.when(monsters >= least, F.lit(k)).otherwise(band)
    shifted = band + F.when(party < 3, 1).when(party > 5, -1).otherwise(0)
    return F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.least(F.greatest(shifted, F.lit(0)), F.lit(len(STEPS) - 1)) + 1).cast("int"))


def party_budget(levels: Column, band: int, later: bool = False) -> Column:
    """Experience from which an encounter reaches the band (0 is easy); null where a level is not 1 to 20."""
    table = BUDGETS_2024 if later else BUDGETS_2014
    by_level = F.array(*[F.lit(row[band]).cast("long") for row in table])
    return F.aggregate(levels, F.lit(0).cast("long"), lambda total, level: total + F.get(by_level, (level - 1).cast("int")))


def difficulty(xp: Column, monsters: Column, levels: Column, later: bool = False) -> Column:
    """Trivial to Deadly (Hard at most for the later edition, which does not adjust for counts); null without a budget."""
    adjusted = xp if later else F.round(xp * encounter_multiplier(monsters, F.size(levels)))
    bands = len((BUDGETS_2024 if later else BUDGETS_2014)[0])
    name = F.when(party_budget(levels, 0, later).isNull(), None)
    for band in reversed(range(bands)):
        name = name.when(adjusted >= party_budget(levels, band, later), BANDS[band])
    return name.otherwise("Trivial")


def caster_level(full: Column, half: Column, artificer: Column, third: Column) -> Column:
    return (full + F.floor(half / 2) + F.floor((artificer + 1) / 2) + F.floor(third / 3)).cast("int")
