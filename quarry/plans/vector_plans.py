"""Queries over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import vector as V
from quarry.plans.base import FILES, files, query, table

_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NORMS = "(sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_COS = f"{_DOT} / {_NORMS}"
_L2 = "sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)))"
_L1 = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: abs(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"
_FIRST = "(SELECT * FROM embeddings WHERE vec_id = 0) q"


def _query_vector(spark, sf_dir) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()
    return list(row["embedding"]) if row else [0.0]


def _rounded(df, *keep):
    return df.select("vec_id", *keep, F.round("score", 6).alias("score"))


@query("v1_cosine_top_k", f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, {_FIRST} ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def v1(spark, sf_dir):
    return _rounded(V.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10), "label")


@query("v1_cosine_top_k_filtered", f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, {_FIRST} WHERE e.label = q.label ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def v1_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = vectors.where("vec_id = 0").first()["label"]
    return _rounded(V.top_k(vectors, _query_vector(spark, sf_dir), 10, filters={"label": label}), "label")


_BATCH = """
scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {score} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS ord FROM scored)"""


def results(spark, sf_dir, k=10, metric="cosine"):
    """Top-k of every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return V.batch_top_k(vectors, vectors.where("vec_id % 50 = 0"), k, metric)


RESULTS = _BATCH.format(score=_COS) + ",\nresults AS (SELECT query_id, id, score, ord FROM ranked WHERE ord <= 10)"


@query("v1_batch_top_k", f"WITH {RESULTS} SELECT query_id, id, ord, round(score, 6) AS score FROM results")
def v1_batch(spark, sf_dir):
    return results(spark, sf_dir).select("query_id", "id", "ord", F.round("score", 6).alias("score"))


@query("v3_post_filtered_search", f"WITH n AS (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, {_FIRST} ORDER BY 3 DESC, 1 LIMIT 30) SELECT vec_id, label, round(score, 6) AS score FROM n WHERE label = 3 ORDER BY n.score DESC, vec_id LIMIT 10")
def v3(spark, sf_dir):
    return _rounded(V.post_filtered_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, {"label": 3}), "label")


@query("v4_filter_search", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 1000 AND o_totalprice < 200000 ORDER BY o_orderkey LIMIT 100")
def v4(spark, sf_dir):
    wanted = V.matches({"o_orderpriority": "1-URGENT", "o_totalprice": {"$gte": 1000.0, "$lt": 200000.0}})
    return table(spark, sf_dir, "orders").where(wanted).orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("v5_scan_filter", "WITH s AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 500) SELECT c_custkey, c_mktsegment FROM s WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50")
def v5(spark, sf_dir):
    first = table(spark, sf_dir, "customer").orderBy("c_custkey").limit(500)
    return first.where(V.matches({"c_mktsegment": "BUILDING"})).orderBy("c_custkey").limit(50).select("c_custkey", "c_mktsegment")


@query("v6_row_predicate", "SELECT l_orderkey, l_linenumber, coalesce(l_returnflag = 'R' AND l_quantity > 10 AND l_quantity <= 40, false) AS matches FROM lineitem")
def v6(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.matches({"l_returnflag": "R", "l_quantity": {"$gt": 10.0, "$lte": 40.0}}).alias("matches"))


@query("v7_normalised_inner_product", f"SELECT e.vec_id FROM embeddings e, {_FIRST} ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def v7(spark, sf_dir):
    return V.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 5).select("vec_id")


@query("v8_inner_product", f"WITH {_BATCH.format(score=_DOT)} SELECT query_id, id, ord, round(score, 6) AS score FROM ranked WHERE ord <= 5")
def v8(spark, sf_dir):
    return results(spark, sf_dir, 5, "dot_product").select("query_id", "id", "ord", F.round("score", 6).alias("score"))


@query("v9_score_threshold", f"WITH {RESULTS} SELECT query_id, id, round(score, 6) AS score FROM results WHERE score > 0.3")
def v9(spark, sf_dir):
    return results(spark, sf_dir).where("score > 0.3").select("query_id", "id", F.round("score", 6).alias("score"))


@query("v10_keyword_filter", f"WITH {FILES} SELECT file_path FROM files WHERE len(list_filter(['idiot', 'license', 'token'], lambda t: contains(lower(content), t))) > 0")
def v10(spark, sf_dir):
    terms = F.array(*map(F.lit, ["idiot", "license", "token"]))
    return files(spark, sf_dir).where(F.exists(terms, lambda t: F.contains(F.lower("content"), t))).select("file_path")


@query("v13_distance_metrics", f"SELECT e.vec_id, round(1 - {_COS}, 6) AS cosine_distance, round({_L2}, 6) AS euclidean, round({_DOT}, 6) AS dot_product FROM embeddings e, {_FIRST}")
def v13(spark, sf_dir):
    q, e = V.literal_vector(_query_vector(spark, sf_dir)), F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(1 - V.cosine(e, q), 6).alias("cosine_distance"), F.round(V.euclidean(e, q), 6).alias("euclidean"), F.round(V.dot(e, q), 6).alias("dot_product"))


@query("v13_batch_euclidean", f"WITH {_BATCH.format(score='-' + _L2)} SELECT query_id, id, ord, round(score, 6) AS score FROM ranked WHERE ord <= 10")
def v13_batch(spark, sf_dir):
    return results(spark, sf_dir, 10, "euclidean").select("query_id", "id", "ord", F.round("score", 6).alias("score"))


@query("v14_distance_operators", f"SELECT e.vec_id, round({_L2}, 6) AS l2, round({_L1}, 6) AS l1, round(-({_DOT}), 6) AS negative_dot FROM embeddings e, {_FIRST}")
def v14(spark, sf_dir):
    q, e = V.literal_vector(_query_vector(spark, sf_dir)), F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.euclidean(e, q), 6).alias("l2"), F.round(V.manhattan(e, q), 6).alias("l1"), F.round(-V.dot(e, q), 6).alias("negative_dot"))


@query("s15_collection_info", "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dimension, count(DISTINCT label) AS labels FROM embeddings")
def s15(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.countDistinct("label").alias("labels"))
