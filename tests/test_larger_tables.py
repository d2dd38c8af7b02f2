"""Queries that differed from their SQL, or grew faster than their tables, on larger or odd tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest
from oracle import as_rows, sql_rows

from quillspark import catalog
from quillspark.operators import blockmax, index, mutations, vectors
from quillspark.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def write(folder, **tables: str):
    """Tables as parquet files, each made by SQL over sf0.001."""
    db = duckdb.connect()
    for name, sql in tables.items():
        db.execute(f"copy ({sql.replace('@', SMALL + '/')}) to '{folder}/{name}.parquet' (format parquet)")
    return str(folder)


def equals_sql(spark, name: str, folder: str) -> None:
    rows = catalog.queries()[name](spark, folder).toPandas()
    assert as_rows(rows) == as_rows(sql_rows(catalog.oracle_sql()[name], folder))


def test_party_levels_are_counted_before_campaigns_meet_heroes(spark, tmp_path):
    folder = write(
        tmp_path,
        customer="select (i // 2)::bigint as c_custkey, case when i % 7 <> 0 then i % 3 end::int as c_nationkey from range(400) t(i)",
        supplier="select case when i % 11 <> 0 then i % 500 end::bigint as s_suppkey, case when i % 13 <> 0 then i % 4 end::int as s_nationkey from range(900) t(i)",
    )
    equals_sql(spark, "party_levels", folder)
    plan = catalog.queries()["party_levels"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]


def test_facts_of_a_book_share_keys_with_other_books(spark, tmp_path):
    folder = write(
        tmp_path,
        part="select 1000000 + i as p_partkey, 'Brand#' || (i % 5) as p_brand from range(60) t(i)",
        customer="select i::bigint as c_custkey, (i % 3)::int as c_nationkey from range(90) t(i)",
    )
    equals_sql(spark, "structured_facts", folder)


def test_batches_are_counted_over_ranges_that_are_made_once(spark, tmp_path):
    folder = write(tmp_path, part="select * replace (p_partkey + i * 200 as p_partkey) from '@part.parquet', range(6000) t(i)")
    plan = catalog.queries()["reground_batches"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        equals_sql(spark, "reground_batches", folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sections_with_unknown_pages_stand_where_the_sql_puts_them(spark, tmp_path):
    folder = write(tmp_path, lineitem="select (i % 40)::bigint as l_orderkey, case when i % 5 <> 0 then i // 80 end::int as l_linenumber, case when i % 3 <> 0 then i * 7 % 41 + i / 1000 end::double as l_quantity from range(400) t(i)")
    ties = duckdb.sql(f"select count(*) from (select 1 from '{folder}/lineitem.parquet' group by l_orderkey, l_linenumber, floor(l_quantity) having count(*) > 1 and count(l_quantity) > 0)").fetchall()
    assert ties == [(0,)]
    equals_sql(spark, "gaps_islands_sections", folder)


def test_eight_bits_lose_no_nearest_vector(spark, tmp_path):
    # far below a step of the codes, but for the scores' six digits; one long vector, one zero, one null, one of another length
    near = "select i::bigint as vec_id, [1.0 + (i * 37 % 101) / 40000, 1.0, 0.5 - (i * 53 % 97) / 30000, 0.25]::float[] as embedding, (i % 3)::int as label from range(400) t(i)"
    folder = write(tmp_path, embeddings=f"{near} union all select 400, [0, 9, 0, 0]::float[], 1 union all select 401, null, 1 union all select 402, [0, 0, 1e-9, 0]::float[], 1")
    equals_sql(spark, "quantised_search", folder)


def test_best_codes_are_held_a_tile_at_a_time():
    assert vectors.TILE_QUERIES * vectors.TILE_CODES * 8 <= 16 << 20
    rng = np.random.default_rng(5)
    coarse, keys = rng.integers(0, 40, (30, 700)) / 40, rng.permutation(700)
    held = vectors._Best(30, 20)
    for at in range(0, 700, 90):
        held.add(keys[at : at + 90], coarse[:, at : at + 90])
    for row in range(30):
        wanted = sorted(zip(-coarse[row], keys, strict=True))[:20]
        assert list(zip(-held.coarse[held.row == row], held.key[held.row == row], strict=True)) == wanted


def test_the_edge_of_codes_is_the_exact_quantile_of_many_sizes(spark, tmp_path):
    folder = write(tmp_path, embeddings="select i::bigint as vec_id, list_transform(range(64), lambda j: ((hash(i * 64 + j) % 9000011)::double - 4500005) / 7e6)::float[] as embedding, 0 as label from range(10201) t(i)")
    exact = duckdb.sql(f"select quantile_disc(abs(x::double), 0.99) from (select unnest(embedding) as x from '{folder}/embeddings.parquet')").fetchall()[0][0]
    assert vectors.step_edge(table(spark, folder, "embeddings")) == exact
    odd = spark.createDataFrame([([0.5, None, -3.0],), (None,), ([],), ([-0.0, 1.0],)], "embedding array<float>")
    assert [vectors.step_edge(odd, q) for q in (0.0, 0.25, 0.5, 0.51, 1.0)] == [1.0, 1.0, 0.5, 1.0, 3.0]
    assert vectors.step_edge(odd.where("embedding is null")) == 1.0


def test_queries_without_vector_find_the_first_keys(spark, tmp_path):
    folder = write(tmp_path, embeddings="select i::bigint as vec_id, case when i % 7 <> 3 then [sin(i * 1.1), cos(i * 2.3), sin(i * 0.7)]::float[] end as embedding, 0 as label from range(200) t(i)")
    equals_sql(spark, "quantised_stored", folder)


def test_an_index_shuffles_its_weights_once(spark, tmp_path):
    written = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    index.build_index(table(spark, "/root/testdata/sf0.01", "documents"), str(tmp_path / "index"))
    size = sum(f.stat().st_size for f in (tmp_path / "index").glob("*.parquet"))
    assert 0 < written() - before < 6 * size


def test_many_terms_meet_their_words_in_one_shuffle(spark, tmp_path, monkeypatch):
    rows = [(None if i == 3 else i, None if i == 5 else f"the {'Été naïve ' * (i % 3)}w{i % 90} x{i} 漢字 {'the ' * (i % 4)}ñ{i % 7}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    index.build_index(docs, f"{tmp_path}/sent")
    for name, value in (("TERMS_SENT", 0), ("PARTITION_ENTRIES", 500), ("PIECE_ENTRIES", 40)):
        monkeypatch.setattr(index, name, value)
    plans, made = [], index._dealt
    monkeypatch.setattr(index, "_dealt", lambda *args: plans.append(made(*args)) or plans[0])
    index.build_index(docs, f"{tmp_path}/dealt")
    sent, dealt = ({(r["idx"], r["doc_id"]): r["weight"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()} for name in ("sent", "dealt"))
    assert len(sent) > 2000 and sent.keys() == dealt.keys() and dealt == pytest.approx(sent)
    assert spark.read.parquet(f"{tmp_path}/dealt").count() == len(dealt)
    plan = plans[0].groupBy("part", "idx", "key").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" in plan and "SortMergeJoin" not in plan


def test_blocks_are_read_from_the_index_itself(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    size = lambda rows: sum(Path(f.removeprefix("file:")).stat().st_size for f in rows.inputFiles())
    whole = index.stored_index(docs)
    postings, maxima = blockmax.stored_blocks(docs)
    assert sorted(postings.inputFiles()) == sorted(whole.inputFiles())
    assert 0 < size(maxima) < size(whole) / 10
    assert maxima.groupBy("idx").agg({"n": "sum"}).where("`sum(n)` <= 64").count() == 0


def test_blocks_lose_no_document_without_key(spark, tmp_path):
    texts = [(None if i == 7 else i * 3 - 50, "common " * (1 + i % 5) + ("rare" if i in (7, 90) else f"w{i}")) for i in range(300)] + [(None, "rare rare")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for query in ("rare", "common rare", "common", "rare w5 nothing"):
        whole = index.search_index(index.stored_index(docs), {"q": query}).selectExpr("doc_id", "round(score, 6) as score").orderBy("score", ascending=False).collect()
        hits = blockmax.Search(*blockmax.stored_blocks(docs), query).hits.collect()
        assert [r["score"] for r in hits] == [r["score"] for r in whole][:10]
        assert set(map(tuple, hits)) <= set(map(tuple, whole)) and ("rare" not in query or None in {r["doc_id"] for r in hits})


def test_points_are_not_multiplied_by_the_lengths_of_sections(spark, tmp_path):
    # one page asked for by most, in a section that begins far before it
    folder = write(
        tmp_path,
        orders="select (i * 3)::bigint as o_orderkey, (i % 4)::bigint as o_custkey from range(300) t(i)",
        lineitem="select i::bigint as l_orderkey, (case when i % 10 < 8 then 7 else i end)::bigint as l_partkey, 1::int as l_linenumber from range(20000) t(i)",
        customer="select i::bigint as c_custkey from range(5) t(i)",
    )
    equals_sql(spark, "section_of_page", folder)
    plan = catalog.queries()["section_of_page"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("name", ["section_groups", "type_renames", "fuzzy_name_match", "typed_fuzzy_match"])
def test_partitions_grow_with_rows_and_exploded_rows_are_not_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(mutations, "ROWS_A_TASK", 300)
    frame = catalog.queries()[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan
    assert as_rows(frame.toPandas()) == as_rows(sql_rows(catalog.oracle_sql()[name], SMALL))
