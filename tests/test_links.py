"""Intervals, outlines and renames against plain loops, with odd rows."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import intervals, outline, renames


def _first(book, page, sections):
    own = sorted((s for s in sections if s[0] == book and s[2] is not None), key=lambda s: (s[2], s[1]))
    for i, (_, name, first, last) in enumerate(own):
        end = last if last is not None else own[i + 1][2] - 1 if i + 1 < len(own) else 1 << 40
        if first <= page <= end:
            return name
    return None


@pytest.mark.parametrize("seed,spread,longest", [(1, 60, 20), (2, 5, 3), (3, 100_000, 70_000), (4, 300, 5)])
def test_first_interval_against_a_loop(spark, seed, spread, longest):
    dice = random.Random(seed)
    sections = [(0 if dice.random() < 0.5 else dice.randrange(5), i, dice.randrange(spread) if dice.random() < 0.97 else None, None) for i in range(150)]
    sections = [(b, i, s, None if s is None or dice.random() < 0.3 else s + dice.randrange(-3, longest)) for b, i, s, _ in sections]
    pages = [(i, dice.choice([0, 0, 0, 1, 2, 7, None]), dice.randrange(-5, 2 * spread) if dice.random() < 0.98 else None) for i in range(600)]
    s = spark.createDataFrame(sections, "book int, section int, first long, last long")
    p = spark.createDataFrame(pages, "id int, book int, page long")
    found = intervals.first_interval(p, s, "book", "page", "first", "last", "section", ["section"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["id"]: r["section"] for r in found.collect()}
    assert got == {i: None if b is None or page is None else _first(b, page, sections) for i, b, page in pages}


def test_first_interval_of_nothing(spark):
    s = spark.createDataFrame([], "book int, section int, first long, last long")
    p = spark.createDataFrame([(1, 1, 5), (1, 1, 5)], "id int, book int, page long")
    assert [r["section"] for r in intervals.first_interval(p, s, "book", "page", "first", "last", "section", ["section"]).collect()] == [None, None]
    assert intervals.first_interval(p.limit(0), s, "book", "page", "first", "last", "section", ["section"]).collect() == []


def test_outline_over_a_chain_of_a_thousand_levels(spark):
    rows = [(i, i - 1 if i else None, f"Title {i}" if i % 97 == 0 else " a ") for i in range(1000)] + [(2000, 999, "Leaf of it"), (2001, 5000, "Orphan"), (2002, None, None), (2003, 2002, "Under nothing")]
    marks = spark.createDataFrame(rows, "id int, up int, title string")
    got = {r["id"]: r["parent_title"] for r in outline.outline(marks, "id", "up", "title").collect()}
    assert got == {i: f"Title {i - 97}" if i else None for i in range(0, 1000, 97)} | {2000: "Title 970", 2001: None, 2003: None}


def test_outline_against_a_loop(spark):
    dice = random.Random(6)
    rows = [(i, dice.choice([None, 0, dice.randrange(i)]) if i else None, dice.choice(["ab", "abc", "", None, "Long one"])) for i in range(300)]
    by = {i: (up, t) for i, up, t in rows}
    means = lambda t: t is not None and len(t.strip()) >= 3

    def above(i):
        up = by[i][0]
        while up is not None and not means(by[up][1]):
            up = by[up][0]
        return up

    marks = spark.createDataFrame(rows, "id int, up int, title string")
    got = {r["node"]: r["above"] for r in outline.nearest_above(marks, "id", "up", F.length(F.trim("title")) >= 3).collect()}
    assert got == {i: above(i) for i in by}


def test_outline_in_a_circle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(outline, "ROUNDS", 4)
    marks = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id int, up int, title string")
    with pytest.raises(ValueError):
        outline.outline(marks, "id", "up", "title").collect()


def test_renames_leave_no_old_id(spark):
    old, other = "b.item.sword", "b.spell.fire.ball"
    texts = [
        json.dumps({"id": old, "deep": [{"a": [old, other, {"b": old}]}, f"{old} in a text", 'a "quoted" \\ one', old + ".more"], old: 1}),
        json.dumps({"id": other, "é": "日本", "n": 1.5, "none": None, "e": "", "s": 'x\\"' + old}),
        "[]", "not json at all \"", None, json.dumps(old), json.dumps(" " + old),
    ]
    records = spark.createDataFrame([(i, b, t, 1) for b in ("b", "c") for i, t in enumerate(texts, 100 * (b == "c"))], "k int, book string, record string, place int")
    changes = spark.createDataFrame([("b", old, "b.weapon.sword", "Weapon")], "book string, old_id string, new_id string, type string")
    got = {r["k"]: (r["record"], r["references"]) for r in renames.renamed(records, changes, "k").collect()}
    for i, text in enumerate(texts):
        # a quote within a string begins no string
        want, times = re.subn(rf'(?<!\\)"{re.escape(old)}"', '"b.weapon.sword"', text) if text else (text, 0)
        assert got[i] == (want, times)
        assert got[100 + i] == (text, 0)


def test_corrections(spark):
    records = spark.createDataFrame([("b", "b.item.x", "Sword", "phb", "Item"), ("b", "b.weapon.y", "sword", "PHB", "weapon"), ("b", "short.id", "Sword", "phb", "Item"), ("b", "b.item.z", None, "phb", "Item"), ("b", "b.item.deep.er", "Sword", "Phb", "Item")], "book string, id string, name string, source string, type string")
    lookup = spark.createDataFrame([("sword", "PHB", "Weapon")], "name_key string, source_key string, type string")
    assert sorted(map(tuple, renames.corrections(records, lookup).collect())) == [("b", "b.item.deep.er", "b.weapon.deep.er", "Weapon"), ("b", "b.item.x", "b.weapon.x", "Weapon")]
