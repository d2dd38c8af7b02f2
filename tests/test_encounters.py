"""Encounters from tables, rosters read by registry, and books by intent, with many kinds and books."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators import encounters, rosters

_ASK = "id int, levels array<int>, target int, later boolean, theme string, cr_gte double, cr_lte double"


def _monsters(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, later boolean, cr double, keywords array<string>, place int")


def test_default_ceiling_floor_and_reasons(spark):
    every = [(int(10 * c), later, c, ["x"], i) for i, c in enumerate(rules.CR_XP) for later in (False,)]
    asks = [
        (1, [5] * 4, 2, False, None, None, None),  # 2000: nothing above 5 is looked for
        (2, [1], 1, False, None, 8.0, None),  # the floor lifts the ceiling
        (3, [1], 1, False, None, 8.0, 2.0),
        (4, [5] * 4, 2, False, "nothing", None, None),
        (5, [1], 1, False, None, None, 0.0),  # the ceiling lowers the floor
        (6, [20] * 4, 4, True, None, None, None),
    ]
    got = {r["id"]: r for r in encounters.built(spark.createDataFrame(asks, _ASK), _monsters(spark, *every)).collect()}
    assert got[1]["picked"][0] == 50 and 2000 <= got[1]["adjusted"] and got[1]["matched"]
    assert got[2]["reason"] == "overshoot" and got[2]["picked"] == [] and got[2]["candidates"] == 1
    assert got[3]["reason"] == "inverted" and got[3]["picked"] is None
    assert (got[4]["reason"], got[4]["candidates"]) == ("scarce", 0)
    assert got[5]["candidates"] == 1 and set(got[5]["picked"]) <= {0}
    assert got[6]["reason"] == "scarce" and got[6]["candidates"] == 0  # no monster of that edition


def test_candidates_are_the_first_twenty_in_range(spark):
    rows = [(i, False, [1.0, 2.0, 5.0][i % 3], ["Fire", "b"] if i % 2 else None, -i) for i in range(300)] + [(900, False, 1.5, None, -999), (901, False, None, None, -999)]
    asks = spark.createDataFrame([(1, [3] * 4, 1, False, "FIRE", 0.5, 2.0), (2, [3] * 4, 1, False, None, 5.0, 5.0)], _ASK)
    sources = encounters.bounded(asks).select("later", "theme", "low", "high")
    got = {r["_theme"]: r["ids"] for r in encounters.candidates(sources, _monsters(spark, *rows)).collect()}
    assert got["fire"] == [i for i in range(299, -1, -1) if i % 2 and i % 3 != 2][:20]
    assert got[""] == [i for i in range(299, -1, -1) if i % 3 == 2][:20]


def test_each_source_is_a_file_and_every_key_is_kept(spark):
    kinds = tuple(rosters.Roster(f"kind{i}-*.json", f"T{i}", f"k{i}") for i in range(12))
    rows = spark.range(1200).select(F.concat(F.lit("k"), (F.col("id") % 12).cast("string")).alias("key"), (F.col("id") % 7).cast("string").alias("source"), F.col("id").alias("ordinal"), F.to_json(F.struct(F.col("id").cast("string").alias("name"))).alias("r"))
    folder = rosters.write_rosters(rows, kinds)
    got = rosters.read_rosters(spark, folder, kinds).collect()
    assert len(got) == 1200 and len({r["file"] for r in got}) == 84 and len({r["type"] for r in got}) == 12
    try:
        rosters.write_rosters(rows, kinds[:3])
    except ValueError:
        return
    raise AssertionError("rows of no roster")


def test_sidecars_and_broken_files_are_left_out(spark, tmp_path):
    for name, text in {"feats-a.json": {"feat": [{"name": "A", "category": "FS"}, {"name": "B"}]}, "feats-a.errors.json": {"feat": [{"name": "E"}]}, "other.json": {"feat": [{"name": "O"}]}}.items():
        (tmp_path / name).write_text(json.dumps(text))
    (tmp_path / "feats-b.json").write_text("{broken")
    (tmp_path / "class-a.json").write_text(json.dumps({"class": [{"name": "Fighter"}], "subclass": [{"name": "Path of Rage", "shortName": "Rage"}, {"name": "Rage", "shortName": "Rage"}]}))
    rows = rosters.read_rosters(spark, str(tmp_path))
    assert {(r["type"], json.loads(r["record"])["name"]) for r in rows.collect()} == {("Feat", "B"), ("Class", "Fighter"), ("Subclass", "Path of Rage"), ("Subclass", "Rage")}
    index = {(r["key"], r["type"]): (r["name"], r["first"]) for r in rosters.name_index(rows).collect()}
    assert index[("rage", "Subclass")] == ("Path of Rage", True) and index[("pathofrage", "Subclass")] == ("Path of Rage", True)


def test_all_books_of_an_intent_are_found(spark):
    books = spark.range(10_050).select(F.col("id").cast("string").alias("id"), F.lit(2014).alias("year"), F.lit("Core").alias("group"))
    intents = spark.createDataFrame([("core",), ("srd",), ("none",)], "intent string")
    got = {r["intent"]: r["n"] for r in rosters.books_of_intent(intents, books).groupBy("intent").agg(F.count("*").alias("n")).collect()}
    assert got == {"core": 10_050, "srd": 1}
