"""Single operators on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules, sheets, text
from quillspark.operators import curation, retrieval
from quillspark.streaming import limits


@pytest.mark.parametrize(("term", "slot"), [("fireball", 20728), ("1d10", 49), ("the", 11980), ("éaux", 22901)])
def test_term_hash(spark, term, slot):
    assert spark.createDataFrame([(term,)], "t string").select(text.term_hash("t")).first()[0] == slot


@pytest.mark.parametrize(("cr", "xp"), [(0.0, 10), (0.25, 50), (1.0, 200), (5.0, 1800), (10.0, 5900), (20.0, 25000), (30.0, 155000)])
def test_challenge_xp(spark, cr, xp):
    assert spark.range(1).select(rules.challenge_xp(F.lit(cr))).first()[0] == xp


@pytest.mark.parametrize(("monsters", "party", "wanted"), [(1, 4, 1.0), (2, 4, 1.5), (4, 4, 2.0), (8, 4, 2.5), (12, 4, 3.0), (15, 4, 4.0), (1, 2, 1.5), (2, 2, 2.0), (2, 6, 1.0), (1, 6, 1.0), (15, 2, 4.0), (0, 4, 1.0)])
def test_multiplier(spark, monsters, party, wanted):
    assert spark.range(1).select(rules.encounter_multiplier(F.lit(monsters), F.lit(party))).first()[0] == wanted


def test_splitter():
    assert curation.split_long("") == [""]
    assert curation.split_long("x" * 800) == ["x" * 800]
    pieces = curation.split_long("word " * 400)
    assert all(len(p) <= 800 for p in pieces) and len(pieces) > 1
    assert pieces[1].startswith(pieces[0][-100:][:20])


def test_zero_vector_has_no_similarity(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert row.select(retrieval.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_query_weight_is_the_raw_count(spark):
    assert {r["idx"]: r["weight"] for r in retrieval.query_vector(spark, "The the fireball").collect()} == {11980: 2, 20728: 1}


def test_empty_corpus(spark):
    row = retrieval.corpus_stats(spark.createDataFrame([], "doc_id long, text string")).first()
    assert (row["documents"], row["total_tokens"], row["avgdl"]) == (0, 0, 1.0)


def test_coverage_of_an_empty_roster(spark):
    schema = "kind string, key string"
    rows = curation.coverage(spark.createDataFrame([], schema), spark.createDataFrame([("a", "x")], schema), "key", "kind").collect()
    assert [(r["present"], r["missing"], r["extra"], r["percent"]) for r in rows] == [(0, 0, 1, 100.0)]


def test_window_begins_with_the_first_hit_after_the_last():
    chat = limits.FixedWindow(3, 60)
    assert [chat.admits(t) for t in (0, 1, 2, 3, 59, 60, 61)] == [True, True, True, False, False, True, True]
    calls = limits.SlidingWindow(2, 60, 6)
    assert [calls.admits(t) for t in (0, 5, 9, 59, 60, 61, 119, 120)] == [True, True, False, False, True, True, False, True]


def test_without_llm(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "quillspark.llm":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert "bm25_topk" in entry.queries() and "op1_quality_forest" not in entry.queries()


@pytest.mark.parametrize(("kind", "level", "slots"), [("multiclass", 3, [4, 2]), ("multiclass", 20, [4, 3, 3, 3, 3, 2, 2, 1, 1]), ("half", 1, []), ("half", 5, [4, 2]), ("half", 19, [4, 3, 3, 3, 2]), ("third", 2, []), ("third", 4, [3]), ("third", 20, [4, 3, 3, 1]), ("none", 9, []), ("half", None, [])])
def test_spell_slots(spark, kind, level, slots):
    got = spark.range(1).select(sheets.spell_slots(F.lit(kind), F.lit(level).cast("int"))).first()[0]
    assert got == slots + [0] * (9 - len(slots))


@pytest.mark.parametrize(("level", "slots", "slot_level"), [(0, None, None), (1, 1, 1), (2, 2, 1), (3, 2, 2), (9, 2, 5), (11, 3, 5), (17, 4, 5)])
def test_pact(spark, level, slots, slot_level):
    assert tuple(spark.range(1).select(sheets.pact_slots(F.lit(level)), sheets.pact_slot_level(F.lit(level))).first()) == (slots, slot_level)


@pytest.mark.parametrize(("worn", "held", "shield", "total"), [(None, ["Wizard"], False, 13), ("none", ["barbarian"], True, 17), ("", ["Monk"], True, 15), (" ", ["Monk", "Barbarian"], False, 15), ("half plate", ["Monk"], False, 17), ("Plate", [], True, 20), ("Studded Leather", [], False, 15), ("Bark", [], False, None)])
def test_armor_class(spark, worn, held, shield, total):
    classes = F.array(*[F.lit(c) for c in held]).cast("array<string>")
    got = sheets.armor_class(F.lit(worn).cast("string"), classes, F.lit(16), F.lit(14), F.lit(12), F.lit(shield), F.lit(None).cast("int"))
    assert spark.range(1).select(got).first()[0] == total


def test_may_multiclass(spark):
    scores = dict.fromkeys(("Strength", "Intelligence", "Wisdom", "Charisma", "Constitution"), F.lit(8)) | {"Dexterity": F.lit(13)}
    got = spark.range(1).select(*[sheets.may_multiclass(F.lit(c), scores).alias(c) for c in ("Fighter", "Monk", "rogue", "Bard", "Jester")]).first()
    assert tuple(got) == (True, False, True, False, False)


@pytest.mark.parametrize(("xp", "monsters", "levels", "later", "wanted"), [(2100, 3, [5] * 4, False, "Hard"), (1400, 2, [5] * 4, True, "Trivial"), (3000, 2, [5] * 4, True, "Medium"), (2999, 2, [5] * 4, True, "Easy"), (99999, 1, [5] * 4, True, "Hard"), (4400, 1, [5] * 4, False, "Deadly"), (0, 0, [1], False, "Trivial"), (100, 1, [1, 21], False, None), (100, 1, None, False, None)])
def test_difficulty(spark, xp, monsters, levels, later, wanted):
    party = F.lit(None).cast("array<int>") if levels is None else F.array(*[F.lit(n) for n in levels])
    assert spark.range(1).select(rules.difficulty(F.lit(xp), F.lit(monsters), party, later)).first()[0] == wanted
