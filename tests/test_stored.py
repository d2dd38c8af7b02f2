"""What is kept between calls: term statistics, codes of vectors, blocks of postings."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import blockmax, bookstats, index, vectors
from quillspark.operators import retrieval as R

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
_CHUNKS = "book string, text string, gone boolean"


def _plainly(state):
    df, documents, tokens = Counter(), 0, 0
    for texts in state.values():
        for t in texts:
            words = [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
            df.update(set(words))
            documents, tokens = documents + 1, tokens + len(words)
    return dict(df), documents, tokens


def _check(stats, state):
    df, documents, tokens = _plainly(state)
    assert {r["term"]: r["df"] for r in stats.terms().collect()} == df == {r["term"]: r["df"] for r in stats.rebuilt().collect()}
    totals = stats.totals().first()
    assert (totals["documents"], totals["tokens"]) == (documents, tokens)
    assert totals["avgdl"] == (tokens / documents if documents else 1.0)


def test_statistics_follow_any_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bookstats, "MANY_CHANGES", 3)
    dice = random.Random(3)
    stats, state = bookstats.BookStats(spark, str(tmp_path)), {}
    _check(stats, state)
    steps = [{b: [" ".join(dice.choices("abcde", k=dice.randrange(6))) for _ in range(dice.randrange(1, 4))] for b in dice.sample("xyzw", 2)} for _ in range(5)]
    steps[2]["x"] = None  # goes
    steps[3]["y"] = [None, ""]  # stays without terms
    steps[4]["never"] = None  # was never there
    for number, step in enumerate(steps):
        rows = [(b, t, False) for b, ts in step.items() for t in ts or []] + [(b, "ignored", True) for b, ts in step.items() if ts is None] + [(None, "no book", False)]
        stats.apply(number, spark.createDataFrame(rows, _CHUNKS))
        for b, ts in step.items():
            state.pop(b, None) if ts is None else state.update({b: ts})
        _check(stats, state)
    assert any(p.name.startswith("base-") for p in tmp_path.iterdir())


def test_a_repeated_batch_counts_once(spark, tmp_path):
    stats = bookstats.BookStats(spark, str(tmp_path))
    stats.apply(0, spark.createDataFrame([("x", "a b", False), ("y", "b", False)], _CHUNKS))
    change = spark.createDataFrame([("x", "c", False)], _CHUNKS)
    failing = bookstats.BookStats(spark, str(tmp_path))
    failing._replace = lambda rows, name: (_ for _ in ()).throw(RuntimeError("lost"))  # after the deltas are written
    with pytest.raises(RuntimeError):
        failing.apply(1, change)
    for _ in range(2):
        stats.apply(1, change)
        _check(stats, {"x": ["c"], "y": ["b"]})


def test_only_the_changed_books_files_are_written(spark, tmp_path):
    stats = bookstats.BookStats(spark, str(tmp_path))
    stats.apply(0, spark.createDataFrame([("x", "a b", False), ("y", "b", False), ("z", "c", False)], _CHUNKS))
    files = lambda b: {(p.name, p.stat().st_mtime_ns) for p in Path(tmp_path, "books", f"book={b}").iterdir()}
    before = {b: files(b) for b in "xyz"}
    stats.apply(1, spark.createDataFrame([("y", "d", False)], _CHUNKS))
    assert files("x") == before["x"] and files("z") == before["z"] and files("y") != before["y"]
    assert {r["term"] for r in spark.read.parquet(f"{tmp_path}/change-1/terms").collect()} == {"b", "d"}


def test_recall_of_codes(spark):
    """Each twentieth vector against all, by codes and by brute force."""
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    found = {}
    for r in vectors.nearest_stored(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    plain = rows.orderBy("vec_id").toPandas()
    matrix = np.array(plain.embedding.tolist(), dtype=np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    recall = []
    for i, vec_id in enumerate(plain.vec_id):
        if vec_id % 20 == 0:
            best = set(plain.vec_id[np.argsort(-(matrix @ matrix[i]), kind="stable")[:10]])
            recall.append(len(best & found[vec_id]) / 10)
    assert len(recall) == 25 and np.mean(recall) >= 0.9


def test_codes_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.9, 0.1]), (3, [0.9, 0.1]), (4, None), (None, [1.0, 1.0]), (5, [-100.0, 0.0])]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, coarse string").write.parquet(f"{tmp_path}/v.parquet")
    table = spark.read.parquet(f"{tmp_path}/v.parquet")
    got = vectors.nearest_stored(table, table.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got][0] == 1 and {r["vec_id"] for r in got} == {1, 3}
    codes = spark.read.parquet(index.stored(table, "codes-vec_id", lambda folder: None))
    assert codes.columns == ["vec_id", "code", "edge"] and codes.count() == 5


@pytest.mark.parametrize("query", ["the that were and Erst", "rare0 rare1 common", "nothing of it", "common common rare7"])
def test_blocks_give_what_all_postings_give(spark, tmp_path, query):
    dice = random.Random(9)
    texts = [f"common {'rare%d ' % (i // 10) * (1 + (i % 7 == 0))}" + " ".join(dice.choices(["the", "and", "filler", "were"], k=dice.randrange(1, 30))) for i in range(2000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    search = blockmax.Search(*blockmax.stored_blocks(docs), query)
    whole = R.top(index.search_index(index.stored_index(docs), {"q": query}).withColumn("score", F.round("score", 6)), 10, "doc_id").select("doc_id", "score")
    assert search.hits.collect() == whole.collect()
    assert search.read <= search.rows
    if "rare" in query:
        assert search.read < search.rows / 3, (search.read, search.rows)


def test_an_index_is_found_again_until_its_files_change(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    built = []

    def build(folder):
        built.append(folder)
        spark.range(1).write.parquet(folder)

    assert index.stored(docs, "try", build) == index.stored(docs, "try", build) and len(built) == 1
    spark.createDataFrame([(2, "c")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/d.parquet")
    assert index.stored(spark.read.parquet(f"{tmp_path}/d.parquet"), "try", build) != built[0] and len(built) == 2


def test_deletions_with_shared_files(spark):
    from quillspark.operators import mutations

    books = spark.createDataFrame([(1, "done", "a"), (2, "done", "a"), (3, "done", "b"), (4, "processing", "c"), (5, None, "d"), (6, "done", None)], "id int, status string, slug string")
    asked = spark.createDataFrame([(1,), (1,), (3,), (4,), (5,), (9,), (6,)], "id int")
    got = {r["id"]: (r["outcome"], r["file_goes"]) for r in mutations.deletions(asked, books).collect()}
    assert got == {1: ("deleted", False), 3: ("deleted", True), 4: ("conflict", False), 5: ("deleted", True), 9: ("not found", False), 6: ("deleted", True)}


def test_newer_versions_stand(spark):
    from quillspark.operators import mutations

    stored = spark.createDataFrame([(1, 2, "s"), (2, 2, "s"), (3, None, "s"), (4, 9, "s")], "id int, version int, state string")
    given = spark.createDataFrame([(1, 2, "g"), (2, 1, "g"), (3, None, "g"), (5, 1, "g"), (5, 3, "h")], "id int, version int, state string")
    got = {r["id"]: (r["version"], r["state"]) for r in mutations.upsert_newer(stored, given, "id", "version").collect()}
    assert got == {1: (2, "g"), 2: (2, "s"), 3: (None, "g"), 4: (9, "s"), 5: (3, "h")}
