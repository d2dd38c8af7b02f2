"""Advice, listings and renderers on odd rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import advisor, rendering


def test_classes_and_their_variants(spark):
    index = {"PHB": {"Fire Bolt": {"class": [{"name": "Wizard"}, {"name": "Wizard"}], "classVariant": [{"name": "Bard"}]}, "Aid": {}, "Odd": {"class": "no"}}, "XGE": {"Fire-Bolt": {"class": [{"name": "Cleric"}]}}}
    rows = spark.createDataFrame([(json.dumps(index),), ("broken",), (None,)], "text string")
    known = advisor.spell_classes(rows)
    assert sorted(map(tuple, known.collect())) == [("PHB", "Fire Bolt", "Bard"), ("PHB", "Fire Bolt", "Wizard"), ("XGE", "Fire-Bolt", "Cleric")]
    spells = spark.createDataFrame([(1, "fire bolt", "phb"), (2, "FIRE BOLT", "XGE"), (3, "Fire bolt", "other"), (4, "Fire bolt", None), (5, "Aid", "PHB")], "id int, name string, source string")
    casts = lambda of: [r["id"] for r in advisor.castable(spells, known, F.lit(of)).orderBy("id").collect()]
    assert casts("bard") == [1, 3, 4] and casts("CLERIC") == [2, 3, 4] and casts("druid") == []


def test_recommended_spells_are_the_lowest(spark):
    spells = spark.createDataFrame([(i, "Wizard", 1 + i % 3) for i in range(100)] + [(0, "wizard", 1), (500, "Bard", 0), (501, "Bard", 10)], "id int, class string, level int")
    builds = spark.createDataFrame([(1, "WIZARD", None), (2, "wizard", 3), (3, "bard", 20), (4, "none", 5), (5, "wizard", 0)], "build int, class string, level int")
    got = {r["build"]: r["spells"] for r in advisor.recommended_spells(builds, spells).collect()}
    ones = list(range(0, 100, 3))
    assert got == {1: ones[:25], 2: ones[:25], 3: [], 4: [], 5: ones[:25]}


def test_critique_of_sheets(spark):
    features = [("Rage", 1), ("Primal Path", 3), ("Path feature", 6), ("Danger Sense", 2)]
    classes = spark.createDataFrame([("Barbarian", "Path", features), ("Monk", None, [("Ki", 2)]), ("Odd", " ", [("X", 1)])], "class string, title string, features array<struct<name:string,level:int>>")
    sheets = spark.createDataFrame([(1, "barbarian", 3, None, ["rage"]), (2, "Barbarian", 2, None, ["RAGE!", "danger-sense", None]), (3, "Barbarian", 9, "Totem", ["Rage", "Danger Sense"]), (4, "Monk", 5, None, []), (5, "Mystic", 5, None, ["x"]), (6, "odd", 1, None, None)], "sheet int, class string, level int, subclass string, have array<string>")
    got = sorted((r["sheet"], r["about"]) for r in advisor.critique(sheets, classes).collect())
    assert got == [(1, "Danger Sense"), (1, "Path"), (4, "Ki"), (6, "X")]


def test_similarity_of_words(spark):
    rows = [("Fire-Bolt (cantrip)", "fire bolt: CANTRIP", 1.0), ("", "", 0.0), ("a'b", "b", 0.5), ("a a b", "b a", 1.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select(advisor.word_jaccard(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == pytest.approx(r["want"]) for r in got)


@pytest.mark.parametrize("kind,fields,text", [
    ("Monster", {}, "N — Unknown unknown, unaligned\nCR ?\n"),
    ("Monster", {"size": ["M"], "type": "beast", "alignment": ["X"], "ac": [15], "cr": "5", "speed": {"walk": {"number": 3}}, "action": [{"name": "Bite"}]}, "N — Medium beast, X\nAC 15\nSpeed walk ?\nCR 5\nActions:\n  Bite\n"),
    ("Monster", {"type": {"type": {"choose": []}}, "cr": {"cr": 3}, "hp": {"formula": "1d8"}}, "N — Unknown unknown, unaligned\nHP  (1d8)\nCR 3\n"),
    ("Spell", {"level": 12, "school": "X"}, "N — 12th-level X\n\n"),
    ("Spell", {"level": 2, "school": "A", "duration": [{"type": "permanent"}], "components": {"s": True, "m": True}, "range": {"type": "self"}, "classes": ["Bard", "Druid"]}, "N — 2nd-level Abjuration\nRange: self\nComponents: S, M\nDuration: Until dispelled\nClasses: Bard, Druid\n\n"),
    ("Subclass", {"className": "Monk"}, "N (Monk subclass).\n"),
    ("Subclass", {"className": "Monk", "subclassFeatures": ["B|x|9", "A|x|3", {"subclassFeature": "C|x", "level": 9}, {"subclassFeature": "D"}, 4, "E"]}, "N (Monk subclass).\nFeatures: A (3), B (9), C (9).\n"),
    ("Object", {"ac": [{"ac": 19}], "hp": {"average": 50}, "resist": [{"a": 1}], "immune": []}, 'N — Object\nAC 19\nHP 50\nDamage Resistances: {"a":1}\n'),
])
def test_renderers(spark, kind, fields, text):
    row = spark.range(1).select(rendering.rendered(F.lit(kind), F.lit("N"), F.lit(json.dumps(fields))).alias("t")).first()
    assert row["t"] == text


def test_renderers_never_lose_a_record(spark):
    rows = spark.createDataFrame([("Monster", "A", "broken"), ("Spell", "B", None), ("Other", "C", "{}"), ("Object", "D", '"text"')], "kind string, name string, fields string")
    got = {r["name"]: r["t"] for r in rows.select("name", rendering.rendered(F.col("kind"), F.col("name"), F.col("fields")).alias("t")).collect()}
    assert got["A"] == "A (Monster)" and got["B"] == "B (Spell)" and got["C"] is None and got["D"].startswith("D")
