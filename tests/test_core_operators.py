"""Operators against brute-force versions and golden values."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import advice, jsontree, layout, rules
from quillspark.operators import curation, index, mutations, rosters, search


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_matches_lose_no_pair(spark):
    source = random.Random(5)
    base = ["".join(source.choices("abc ", k=source.choice((6, 9, 10, 18, 19, 24, 27, 28, 29, 33, 41)))) for _ in range(40)]

    def bent(name: str) -> str:
        chars = list(name)
        for _ in range(source.randint(0, 3)):
            at = source.randrange(len(chars))
            chars[at : at + 1] = source.choice(([], ["z"], [chars[at], "y"]))
        return "".join(chars) or "q"

    left = [(i, bent(n)) for i, n in enumerate(base * 4)]
    right = [(n,) for n in base]
    got = {r["id"]: (r["match"], r["ratio"]) for r in curation.fuzzy_matches(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "name string")).collect()}
    wanted = {}
    for i, name in left:
        near = [(-round(1 - _distance(name, m) / max(len(name), len(m)), 6), m) for (m,) in right if abs(len(name) - len(m)) <= 2]
        best = min((x for x in near if -x[0] >= 0.9), default=None)
        if best:
            wanted[i] = (best[1], -best[0])
    assert got == wanted and len(wanted) > 60


def test_encounters_are_built_greedily():
    source = random.Random(3)
    worth = list(rules.CR_XP.values())[:16]
    for _ in range(150):
        levels = [source.randint(1, 12) for _ in range(source.randint(1, 7))]
        xps, target, later = source.sample(worth, source.randint(0, 8)), source.randint(1, 4), source.random() < 0.5
        goal = min(target, 3) if later else target
        chosen: list[int] = []
        why, over = "scarce", None
        while (now := advice.assess(levels, [xps[i] for i in chosen], later))[0] != goal and len(chosen) < 15:
            pool = [i for i in range(len(xps)) if chosen and xps[i] < xps[chosen[0]]] or list(range(len(xps)))
            best = None
            for i in pool:
                trial = advice.assess(levels, [xps[c] for c in chosen] + [xps[i]], later)
                if trial[0] <= goal and (best is None or trial[1] > best[1][1]):
                    best = (i, trial)
            if best is None:
                bands = [advice.assess(levels, [xps[c] for c in chosen] + [xps[i]], later)[0] for i in pool]
                why, over = ("overshoot", min(bands)) if xps else (why, over)
                break
            chosen.append(best[0])
        matched = now[0] == goal
        assert advice.build_encounter(levels, target, later, xps) == (chosen, *now, matched, None if matched else why, None if matched else over)


@pytest.mark.parametrize(("value", "crafters", "days", "materials"), [(1000, 1, 100, 500), (50, 1, 5, 25), (75, 1, 8, 37), (1000, 4, 25, 500), (1000, 0, 100, 500), (0, 1, None, None)])
def test_crafting(spark, value, crafters, days, materials):
    row = spark.range(1).select(advice.craft_days(F.lit(value), F.lit(crafters)), advice.craft_materials(F.lit(value))).first()
    assert tuple(row) == (days, materials)


@pytest.mark.parametrize(("cr", "wanted"), [("1/8", 0.125), ("1/2", 0.5), ("10", 10.0), ("Unknown", None)])
def test_challenge_text(spark, cr, wanted):
    assert spark.range(1).select(rosters.challenge_value(F.lit(cr))).first()[0] == wanted


def test_tables_of_markup():
    assert layout.table_cells("<table><TR><th>A</th><td>B &amp; C</td></tr><tr><td><b>1</b></td><td> 2\n3 </td></tr></table>") == [["A", "B & C"], ["1", "2 3"]]
    assert layout.table_cells("<tr><td>A</td></tr><tr><td>1</td></tr>") is None
    assert layout.table_cells("<tr><th>A</th><th>B</th></tr>") is None
    assert layout.table_cells("<tr><td>STR 10 (+0)</td><td>DEX 12</td></tr><tr><td>CON 9</td><td>x</td></tr>") is None
    assert layout.table_cells("") is None


def test_semantic_chunks_keep_all_text():
    source = random.Random(1)
    for _ in range(60):
        lines = [source.choice(("", "## Head", "word " * source.randint(1, 30), "| a | b |", "|---|---|", "y" * source.randint(1, 120))) for _ in range(source.randint(1, 25))]
        text, most = "\n".join(lines), source.randint(3, 40)
        pieces = layout.semantic_chunks(text, most)
        assert "".join("".join(pieces).split()) == "".join(text.split())
        if len(text) // 4 > most:
            assert all(sum(len(line) // 4 for line in p.split("\n")) <= most + 1 for p in pieces)


def test_json_merges():
    assert jsontree.deep_merge({"a": 1, "entries": ["c"], "o": {"x": ""}}, {"a": None, "entries": ["e"], "o": {"x": 2, "y": []}, "fluffEntries": [1], "z": 0}) == {"a": 1, "entries": ["c"], "o": {"x": 2}, "z": 0}
    assert jsontree.deep_merge([1], {"a": 1}) == [1]
    assert jsontree.merge_partials([{"a": [{"name": "x"}, 1], "b": None}, {"a": [{"name": "x", "y": 1}, 1], "b": 2, "c": 3}, {"c": 4}, 5]) == {"a": [{"name": "x"}, 1, 1], "b": 2, "c": 3}
    assert jsontree.filled({"level": 1}, {"level": 2, "school": "E", "other": 1}, "Spell") == ({"level": 1, "school": "E", jsontree.FILLED: ["school"]}, True)
    assert jsontree.filled({}, {"x": 1}, "Trap") == ({}, False)
    assert jsontree.recovered('{"a":[1,{"b":2}]} trailing {') == '{"a":[1,{"b":2}]}' and jsontree.recovered("nothing") is None and jsontree.recovered('{"a":1') is None
    assert jsontree.boosted(json.loads('{"ability":[{"choose":{"from":["STR","x"]}},{"int":1}]}')) == ["int", "str"]
    assert not jsontree.meets({"type": "M|PHB"}, {"type": "R"}) and jsontree.meets({"type": "M|PHB"}, {"type": "M"}) and not jsontree.meets({}, None)


def test_ids_stay_unique(spark):
    source = random.Random(2)
    rows = [(source.choice(("a", "a-2", "a-3", "b")), i) for i in range(30)]
    got = [r["id"] for r in mutations.unique_ids(spark.createDataFrame(rows, "id string, n int"), "id", ["n"]).collect()]
    assert len(got) == 30 and {"a", "a-2", "a-3", "b"} <= set(got)


def test_index_and_scan_agree(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red dragon red"), (2, "a dragon"), (3, ""), (4, None), (5, "red")], "doc_id long, text string")
    index.build_index(docs, f"{tmp_path}/index")
    found = index.search_index(spark.read.parquet(f"{tmp_path}/index"), {"q": "Red dragon", "none": "zzz"})
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 5} and {r["query_id"] for r in found.collect()} == {"q"}


def test_filters_ask_for_nothing_when_blank(spark):
    rows = spark.createDataFrame([("a", "k", None), (None, None, 2.0)], "version string, source_key string, cr_numeric double")
    assert rows.where(search.block_filter(version=" ", source_keys=["", None])).count() == 2
    assert rows.where(search.block_filter(version="a", source_keys=["k", "z"])).count() == 1
    assert rows.where(search.entity_filter(cr_lte=5)).count() == 1 and rows.where(search.entity_filter(srd=False)).count() == 2


def test_collapse_keeps_the_first_place_and_the_best_score(spark):
    hits = spark.createDataFrame([(0, "e1", "n", 0.9, "Setting", "llm", False, "x"), (1, "e2", "n", 0.8, "Core", "llm", True, "x"), (2, "e3", "m", 0.7, "Core", "llm", False, "x")], "place int, id string, name string, score double, book_type string, data_source string, needs_review boolean, text string")
    got = sorted((r["place"], r["id"], r["score"]) for r in search.collapsed(hits, ["name"], search.authority(), "place").collect())
    assert got == [(0, "e2", 0.9), (2, "e3", 0.7)]
