"""Documents written whole or not at all, functions called from SQL, schemas of records."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import callables
from quillspark.operators import schemas
from quillspark.sources import canonical


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "slug string, ordinal long, record string")


def test_documents_come_back_in_order(spark, tmp_path):
    rows = [(f"book {i % 3}#é", 100 - i, json.dumps({"id": f"r{i}", "t": 'a "b" \\ é\n'}, ensure_ascii=bool(i % 2))) for i in range(50)]
    canonical.write_documents(_rows(spark, *rows), str(tmp_path))
    got = canonical.read_documents(spark, str(tmp_path)).collect()
    for slug in {r[0] for r in rows}:
        assert [json.loads(r["record"]) for r in sorted((r for r in got if r["slug"] == slug), key=lambda r: r["ordinal"])] == [json.loads(r[2]) for r in sorted(r for r in rows if r[0] == slug)]
        assert isinstance(json.loads((tmp_path / f"{slug}.json").read_text())["entities"], list)
    canonical.write_documents(_rows(spark, ("book 1#é", 0, "{}")), str(tmp_path))
    assert {r["slug"]: r["n"] for r in canonical.read_documents(spark, str(tmp_path)).groupBy("slug").agg(F.count("*").alias("n")).collect()} == {"book 0#é": 17, "book 1#é": 1, "book 2#é": 16}


@pytest.mark.parametrize("bad", [("b", 1, "no json"), ("", 1, "{}"), ("a/b", 1, "{}"), (None, 1, "{}"), ("*", 1, "{}")])
def test_a_failed_job_leaves_the_old_documents(spark, tmp_path, bad):
    canonical.write_documents(_rows(spark, ("a", 0, '{"v":1}'), ("b", 0, '{"v":1}')), str(tmp_path))
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    with pytest.raises(Exception):
        canonical.write_documents(_rows(spark, ("a", 0, '{"v":2}'), ("b", 0, '{"v":2}'), bad), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before


def test_rows_of_a_slug_in_two_tasks_change_nothing(spark, tmp_path):
    spark.dataSource.register(canonical.Canonical)
    rows = _rows(spark, ("a", 0, "{}"), ("a", 1, "{}")).repartition(2)
    with pytest.raises(Exception):
        rows.write.format("canonical").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_patches_touch_only_their_documents(spark, tmp_path):
    canonical.write_documents(_rows(spark, ("a", 0, '{"id":"x","v":1,"deep":{"k":[1,2]}}'), ("a", 1, '{"id":"y"}'), ("b", 0, '{"id":"x"}')), str(tmp_path))
    other = (tmp_path / "b.json").stat().st_mtime_ns
    patches = spark.createDataFrame([("a", "x", '{"v":"two","new":{"z":null}}'), ("a", "gone", '{"v":3}')], "slug string, id string, patch string")
    canonical.patch_documents(spark, str(tmp_path), patches)
    assert [json.loads(r["record"]) for r in canonical.read_documents(spark, str(tmp_path), ["a"]).orderBy("ordinal").collect()] == [{"id": "x", "deep": {"k": [1, 2]}, "v": "two", "new": {"z": None}}, {"id": "y"}]
    assert (tmp_path / "b.json").stat().st_mtime_ns == other
    canonical.patch_documents(spark, str(tmp_path), patches.limit(0))


def test_callables_follow_the_query_around_them(spark, tmp_path):
    spark.createDataFrame([(i, f"red widget {i}" if i % 3 else "blue " * i) for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<float>")
    callables.register(spark, docs, vectors, lambda texts: pd.Series([[float(len(t))] for t in texts]))
    assert [r[0] for r in spark.sql("select embed_text(t)[0] from values (repeat('x', 900)), ('abc') as v(t)").collect()] == [800.0, 3.0]
    both = spark.sql("select q, s.doc_id from values ('widget 1'), ('blue'), ('none') as asked(q), lateral sparse_search(q, 2) s").collect()
    assert {r["q"] for r in both} == {"widget 1", "blue"} and {r["doc_id"] for r in both if r["q"] == "widget 1"} >= {1}
    assert {r["vec_id"]: r["score"] for r in spark.sql("select * from dense_search(array(0D, 1D), 9)").collect()}[9] == 0.0
    fused = spark.sql("select doc_id from fused_hits('widget 4', array(4D, 1D), 3) order by score desc, doc_id").collect()
    assert len(fused) == 3 and fused[0]["doc_id"] == 4
    callables.SCORERS["longest"] = lambda query, text: float(len(text or ""))
    try:
        docs.createOrReplaceTempView("own_docs")
        spark.udtf.register("rerank", F.udtf(callables.Rerank))
        assert [r["doc_id"] for r in spark.sql("select doc_id from rerank(table(own_docs), '', 2, 'lexical')").collect()] == [0, 1]
    finally:
        del callables.SCORERS["longest"]
    with pytest.raises(Exception, match="no scorer"):
        spark.sql("select * from rerank(table(own_docs), 'q', 2, 'unknown')").collect()
    with pytest.raises(Exception, match="column text"):
        spark.sql("select * from rerank(table(select 1 as x), 'q', 2, 'lexical')").collect()


def test_schemas_of_odd_records(spark):
    rows = [("a", '{"x":1,"y":[{"z":"s"},{"z":null,"w":1.5}]}'), ("a", '{"x":2,"a b,c:<d>":true,"`q`":{}}'), ("a", "no json"), ("a", None), ("b", "[1,2]"), ("b", '["x"]'), (None, "1")]
    got = {r["type"]: json.loads(r["schema"]) for r in schemas.json_schemas(spark.createDataFrame(rows, "type string, record string")).collect()}
    assert got["a"]["properties"]["x"] == {"type": "integer"} and got["a"]["properties"]["a b,c:<d>"] == {"type": "boolean"}
    assert got["a"]["properties"]["`q`"] == {"type": "object", "properties": {}}
    assert got["a"]["properties"]["y"]["items"]["properties"] == {"w": {"type": "number"}, "z": {"type": "string"}}
    assert got["b"]["type"] == "array" and "type" not in got["b"]["items"] and got[None]["type"] == "integer"


def test_only_changed_documents_are_read_again(spark, tmp_path):
    docs, cache = str(tmp_path / "docs"), str(tmp_path / "cache")
    canonical.write_documents(_rows(spark, ("a", 0, '{"v":1}'), ("b", 0, '{"v":1}'), ("b", 1, '{"v":2}'), ("c", 0, '{"v":3}')), docs)
    load = lambda: sorted((r["slug"], r["ordinal"], r["record"], r["read_at"]) for r in canonical.cached_documents(spark, docs, cache).collect())
    first = load()
    assert [r[3] for r in first] == [1, 1, 1, 1] and load() == first
    canonical.write_documents(_rows(spark, ("b", 0, '{"v":"longer"}')), docs)
    (tmp_path / "docs" / "c.json").unlink()
    (tmp_path / "docs" / "d.json").write_text('{"entities":[]}')
    assert load() == [("a", 0, '{"v":1}', 1), ("b", 0, '{"v":"longer"}', 2)]


def test_columns_that_are_not_asked_for_are_not_read(spark):
    plan = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").where("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
