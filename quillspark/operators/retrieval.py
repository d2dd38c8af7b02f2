"""Ranking: BM25 over hashed terms, dense cosine search, reciprocal-rank fusion, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_hash, tokens

K1, B = 1.5, 0.75
#: Constant of reciprocal-rank fusion.
RRF_K = 60


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, length of the document in tokens."""
    words = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_frequency(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    each = spread(docs.select("text")).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """documents, total_tokens, avgdl (1.0 for none)."""
    sums = docs.select(F.size(tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"))
    return sums.withColumn("avgdl", F.when(F.col("documents") == 0, 1.0).otherwise(F.col("total_tokens") / F.col("documents")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few for them; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query_vectors(spark, queries: dict[str, str]) -> DataFrame:
    """query_id, idx, weight: raw term counts of each query."""
    words = spark.createDataFrame(list(queries.items()), "query_id string, q string").select("query_id", F.explode(tokens(F.col("q"))).alias("term"))
    return words.withColumn("idx", term_hash("term")).groupBy("query_id", "idx").agg(F.count("*").alias("weight"))


def query_vector(spark, query: str) -> DataFrame:
    """idx, weight: raw term counts of the query."""
    return query_vectors(spark, {"q": query}).drop("query_id")


def bm25_many(docs: DataFrame, queries: dict[str, str], key: str = "doc_id") -> DataFrame:
    """query_id, key, score of every document that shares a slot with the query.

    Two scans of the texts, of which only the queries' terms are shuffled by document: the first scan counts terms
    (combined before its shuffle) together with the corpus sums, which stand at the empty term; the few terms in the
    queries' slots then select the tokens of the second, or meet them in a join if they are more than SMALL_ROWS.
    """
    words = spread(docs.select(key, "text")).select(key, tokens(F.col("text")).alias("w"))
    n = F.size("w")
    seen = words.select(n.alias("n"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit("")))).alias("term"))
    vocabulary = seen.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("total"))
    slots = term_hash("term").alias("idx")
    found = vocabulary.select("*", slots).join(F.broadcast(query_vectors(docs.sparkSession, queries)), "idx", "left").where("query_id is not null or term = ''")  # a query's words
    rows = found.limit(SMALL_ROWS + 1).collect()
    stats = next((r for r in rows if r["term"] == ""), None)
    if stats is None and len(rows) > SMALL_ROWS:
        stats = found.where("term = ''").first()
    many, avgdl = (stats["df"], stats["total"] / stats["df"]) if stats else (0, 1.0)
    schema = "term string, query_id string, weight long, df long"
    if len(rows) <= SMALL_ROWS:  # as good as always: the terms in a few of the slots
        known = [(r["term"], r["query_id"], r["weight"], r["df"]) for r in rows if r["term"] != ""]
        words = words.select(key, n.alias("length"), F.filter("w", lambda x: x.isin(sorted({t for t, *_ in known}))).alias("w"))
        terms = F.broadcast(docs.sparkSession.createDataFrame(known, schema))
    else:
        words, terms = words.select(key, n.alias("length"), "w"), found.where("term <> ''").select("term", "query_id", "weight", "df")
    terms = terms.withColumn("idf", F.log((F.lit(many) + 1) / (F.col("df") + 1)) + 1).withColumn("avgdl", F.lit(float(avgdl))).drop("df")
    held = words.select(key, "length", F.explode("w").alias("term")).join(terms, "term")
    counts = held.groupBy(key, "query_id", "term").agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in ("length", "weight", "avgdl", "idf")])
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return counts.groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("idf") * saturated).alias("score"))


def bm25_scores(docs: DataFrame, query: str) -> DataFrame:
    """doc_id, score: only terms that share a slot with the query are weighed."""
    return bm25_many(docs, {"q": query}).drop("query_id")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float]) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), 6))


def top(df: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def page(hits: DataFrame, order: list, most: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip`` + ``most`` in order, with the exact ``total`` of all hits: counted apart, so that hits meet in no single task."""
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(*order).offset(skip).limit(most).crossJoin(F.broadcast(total))  # one row


def ranked(df: DataFrame, key: str, k: int) -> DataFrame:
    """key, rank of the first k: the limit comes first, so that only k rows are numbered."""
    return top(df, k, key).select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def rrf(left: DataFrame, right: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    a, b = left.withColumnRenamed("rank", "rank_a"), right.withColumnRenamed("rank", "rank_b")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("score", F.round(part("rank_a") + part("rank_b"), 6))


#: Rows up to which the small side of a pairing is broadcast.
SMALL_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, once its rows are counted; as it is beyond SMALL_ROWS, where Spark pairs partitions."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def centroids(vectors: DataFrame, unit: bool = False) -> DataFrame:
    """label, centroid: the mean vector of each label, of length one if asked for; a mean of zeros stays."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    if not unit:
        return means
    return means.withColumn("_size", norm(F.col("centroid"))).withColumn("centroid", F.when(F.col("_size") > 0, F.transform("centroid", lambda x: x / F.col("_size"))).otherwise(F.col("centroid"))).drop("_size")


def routed(vectors: DataFrame, floor: float = 0.45) -> DataFrame:
    """vec_id, route (nearest centroid, null under the floor), similarity."""
    near = vectors.select("vec_id", "embedding").crossJoin(small(centroids(vectors))).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("centroid")), 6))
    best = near.groupBy("vec_id").agg(F.max(F.struct("similarity", (-F.col("label")).alias("least"))).alias("b"))
    return best.select("vec_id", F.when(F.col("b.similarity") >= floor, -F.col("b.least")).alias("route"), F.col("b.similarity").alias("similarity"))


def lexical_rerank(passages: DataFrame, query: str, keep: int, key: str) -> DataFrame:
    """First ``keep`` by share of query words held; rows keep the score they came with."""
    words = F.array_distinct(tokens(F.lit(query)))
    share = F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), words)) / F.size(words)
    return passages.withColumn("relevance", F.round(share, 6)).orderBy(F.desc("relevance"), F.desc("score"), key).limit(keep)
