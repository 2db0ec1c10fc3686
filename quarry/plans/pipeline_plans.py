"""Queries over whole pipelines, file scans by suffix, round trips and the remaining orders."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions.text import estimated_tokens
from quarry.operators import activity, embedding, fusion, relations, rerank, vector
from quarry.plans.base import FILES, QUESTIONS, chunks, chunks_sql, embedded_sql, files, query, questions, table, vector_total
from quarry.plans.relation_plans import SEEDS, TYPED, seed_rows, typed_chunks
from quarry.plans.source_plans import stored
from quarry.plans.vector_plans import RESULTS, results
from quarry.session import scratch_path
from quarry.sources import records_io

@query("s5_tolerant_decoding", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def s5(spark, sf_dir):
    from quarry.sources.files import decoded

    broken = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("FFFE")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(decoded(broken).cast("binary")).alias("digest"))


@query("s6_file_lookup", f"WITH {TYPED} SELECT id, length(f.content) AS file_chars FROM typed JOIN files f USING (file_path)")
def s6(spark, sf_dir):
    return typed_chunks(spark, sf_dir).select("id", "file_path").join(files(spark, sf_dir).select("file_path", F.length("content").cast("long").alias("file_chars")), "file_path").select("id", "file_chars")


@query("s17_index_round_trip", "SELECT vec_id, label, len(embedding) AS dimension FROM embeddings")
def s17(spark, sf_dir):
    vectors, path = table(spark, sf_dir, "embeddings"), scratch_path(spark, "index")
    vectors.write.parquet(path)
    return spark.read.schema(vectors.schema).parquet(path).select("vec_id", "label", F.size("embedding").cast("long").alias("dimension"))


@query("s18_state_round_trip", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def s18(spark, sf_dir):
    state, path = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), scratch_path(spark, "state")
    records_io.backup(state, path)
    return records_io.read_state(spark, path, "user_id long, n long")


@query("k5_backup_restore", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def k5(spark, sf_dir):
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch_path(spark, "backup")
    records_io.backup(rows, path)
    return records_io.restore(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("k23_history_round_trip", "SELECT 'c' || o_custkey AS owner, count(*) AS total_calculations, md5(array_to_string(list(o_orderkey || ' = ' || o_orderpriority ORDER BY o_orderdate, o_orderkey), ';')) AS digest FROM orders GROUP BY o_custkey")
def k23(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "history")
    entry = F.concat("o_orderkey", F.lit(" = "), "o_orderpriority")
    records_io.save_history(orders.select(F.concat(F.lit("c"), "o_custkey").alias("owner"), F.struct("o_orderdate", "o_orderkey").alias("at"), entry.alias("entry")), path, "2024-01-10")
    assert records_io.file_info(spark, path)["exists"] and not records_io.file_info(spark, path + "-none")["exists"]
    return records_io.load_history(spark, path).select("owner", "total_calculations", F.md5(F.array_join("history", ";").cast("binary")).alias("digest"))


@query("k8_csv_round_trip", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def k8(spark, sf_dir):
    path = scratch_path(spark, "csv")
    records_io.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    return records_io.read_csv(spark, path)


@query("p1_exact_tokens")
def p1(spark, sf_dir):
    """Byte-level BPE counts with the environment's 50k vocabulary, which stands for one that is not on the box; an error without it."""
    import public_tokenizers

    from quarry.functions.tokens import with_token_counts

    return with_token_counts(files(spark, sf_dir).select("file_path", "content"), "content", public_tokenizers.path("byte_bpe_50k.json")).drop("content")


@query("p5_text_preparation", f"WITH {FILES} SELECT file_path, CASE WHEN contains(content, 'class ') OR contains(content, 'def ') THEN 'code' ELSE 'text' END AS kind FROM files")
def p5(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", F.when(Q.contains_any(F.col("content"), ["class ", "def "]), "code").otherwise("text").alias("kind"))


@query("e4_embedded_questions", f"WITH {QUESTIONS},{embedded_sql('questions', 'session_id, turn', 'query', 64)} SELECT session_id, turn, total FROM embedded")
def e4(spark, sf_dir):
    made = embedding.embed(questions(spark, sf_dir), F.col("query"), lambda: embedding.HashingEmbedder(64))
    return made.select("session_id", "turn", vector_total(F.col("embedding")).alias("total"))


@query("e6_ingest_without_blanks", f"WITH {chunks_sql(8)}, shown AS (SELECT * FROM chunks WHERE trim(content) <> ''),{embedded_sql('shown', 'id', 'content', 32)} SELECT id, total FROM embedded")
def e6(spark, sf_dir):
    kept = chunks(spark, sf_dir, 8).where(F.trim("content") != "").select("id", "content")
    return embedding.embed(kept, F.col("content"), lambda: embedding.HashingEmbedder(32)).select("id", vector_total(F.col("embedding")).alias("total"))


@query("j11_import_replacement", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE l_linenumber = m")
def j11(spark, sf_dir):
    return relations.replaced_imports(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_partkey", "l_linenumber")


@query("a9_fallback_fusion", f"WITH {SEEDS}, r AS (SELECT project_path, id, ord, CAST(sum(greatest(1, length(content) // 4)) OVER (PARTITION BY project_path ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM seeds) SELECT * FROM r WHERE running <= 500")
def a9(spark, sf_dir):
    return fusion.prefix_packing(seed_rows(spark, sf_dir), "project_path", 500, estimated_tokens(F.col("content"))).select("project_path", "id", "ord", "running")


@query("o3_by_importance", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def o3(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query("o5_by_distance", "SELECT e.vec_id FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 15")
def o5(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").first()["embedding"]
    return vector.top_k(vectors, first, 15, "dot_product").select("vec_id")


@query("o6_early_cap", f"WITH {SEEDS} SELECT id, ord FROM seeds ORDER BY ord, id LIMIT 15")
def o6(spark, sf_dir):
    return seed_rows(spark, sf_dir).orderBy("ord", "id").limit(15).select("id", "ord")


@query("o7_oldest_first", "SELECT o_orderkey AS session_id FROM orders EXCEPT SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200)")
def o7(spark, sf_dir):
    """A cache of a thousand sessions is full: the oldest fifth of its capacity goes."""
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("ts"))
    return activity.evict_oldest(sessions, 1_000).select("session_id")


@query("x4_answer_summary", f"WITH {SEEDS}, l AS (SELECT project_path, greatest(1, length(content) // 4) AS t, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY project_path ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM seeds) SELECT project_path, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens FROM l WHERE running <= 2000 GROUP BY project_path")
def x4(spark, sf_dir):
    tokens = estimated_tokens(F.col("content"))
    packed = fusion.prefix_packing(seed_rows(spark, sf_dir), "project_path", 2000, tokens)
    return packed.groupBy("project_path").agg(F.count("*").alias("chunks"), F.sum(tokens).alias("tokens"))


@query("x6_mode_router", "WITH q AS (SELECT conv_id AS session_id, turn, coalesce(text, '') AS query FROM conversations WHERE role = 'user') SELECT session_id, turn, CASE WHEN (contains(query, '.py') OR contains(query, '.js') OR contains(query, '.ts') OR contains(query, '.java') OR contains(query, '.kt')) AND (contains(lower(query), 'content') OR contains(lower(query), 'file')) THEN 'direct' WHEN query <> '' THEN 'relevant' ELSE 'full' END AS mode FROM q")
def x6(spark, sf_dir):
    q = F.col("query")
    return questions(spark, sf_dir).select("session_id", "turn", F.when(Q.direct_file_question(q), "direct").when(q != "", "relevant").otherwise("full").alias("mode"))
