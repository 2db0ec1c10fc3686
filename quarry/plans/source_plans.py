"""Queries over the chunk table's operations, code, embeddings and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import embedding, expansion, relations
from quarry.plans.base import FILES, chunks, chunks_sql, embedded_sql, files, query, table, vector_total
from quarry.plans.relation_plans import _PARENTS, TYPED, typed_chunks
from quarry.session import scratch_path
from quarry.sources import chunk_table as S


def stored(spark, sf_dir):
    """The vectors as chunk rows: one project a label."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("p"), "label").alias("project_path"), F.lit("x").alias("content"), "embedding", F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    return S.coerced(rows)


def kept_table(spark, sf_dir):
    """A chunk table of its own that holds ``stored``."""
    made = S.ChunkTable(spark, scratch_path(spark, "table"))
    made.write(stored(spark, sf_dir))
    return made


@query("s7_upsert", "SELECT 'v' || vec_id AS id, CASE WHEN label >= 5 THEN 'moved' ELSE 'p' || label END AS project_path FROM embeddings UNION ALL SELECT 'w' || vec_id, 'moved' FROM embeddings WHERE label >= 5")
def s7(spark, sf_dir):
    """Rows move between projects, an id occurs twice in the batch (the last wins), rows without a vector are skipped."""
    vectors = table(spark, sf_dir, "embeddings").where("label >= 5")
    made = lambda p, n: vectors.select(F.concat(F.lit(p), "vec_id").alias("id"), F.lit("moved" if n else "stale").alias("project_path"), "embedding", F.lit(n).alias("_at"))
    bare = vectors.select(F.concat(F.lit("u"), "vec_id").alias("id"), F.lit("moved").alias("project_path"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(2).alias("_at"))
    held = kept_table(spark, sf_dir)
    held.upsert(_ordered(made("v", 0).union(made("v", 1)).union(made("w", 1)).union(bare)))
    return held.read().select("id", "project_path")


def _ordered(batch):
    """The batch's order of arrival as its update times: the last row of an id wins."""
    return batch.withColumn("updated_at", F.timestamp_seconds(F.col("_at"))).drop("_at")


@query("s8_upsert_points", "SELECT 'v' || vec_id AS id, len(embedding) AS dimension, CASE WHEN label < 2 THEN 'again' ELSE 'p' || label END AS project FROM embeddings")
def s8(spark, sf_dir):
    """Points of a vector service, written over those of the same id."""
    points = S.as_points(stored(spark, sf_dir))
    again = S.as_points(stored(spark, sf_dir).where("project_path in ('p0', 'p1')").withColumn("project_path", F.lit("again")))
    merged = S.upserted(S.from_points(points), S.from_points(again))
    return S.as_points(merged).select("id", F.size("vector").cast("long").alias("dimension"), F.col("payload.project_path").alias("project"))


@query("s9_points", "SELECT 'v' || vec_id AS id, len(embedding) AS dimension, 'p' || label AS project FROM embeddings")
def s9(spark, sf_dir):
    points = S.as_points(stored(spark, sf_dir))
    return points.select("id", F.size("vector").cast("long").alias("dimension"), F.col("payload.project_path").alias("project"))


@query("s10_coerced_rows", "SELECT 'v' || vec_id AS id, 0 AS start_line, 'text' AS language, 'p' || label AS project_path FROM embeddings")
def s10(spark, sf_dir):
    back = S.from_points(S.as_points(stored(spark, sf_dir)))
    return back.select("id", "start_line", "language", "project_path")


@query("s11_delete_by_ids", "SELECT 'v' || vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier)")
def s11(spark, sf_dir):
    held = kept_table(spark, sf_dir)
    held.delete(table(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), "s_suppkey").alias("id")))
    held.delete(spark.createDataFrame([], "id string"))
    return held.read().select("id")


@query("s12_delete_project", "SELECT 'v' || vec_id AS id FROM embeddings WHERE label <> 3")
def s12(spark, sf_dir):
    held = kept_table(spark, sf_dir)
    held.delete_project("p3")
    held.delete_project("")
    return held.read().select("id")


@query("s13_clear", "SELECT 'before' AS state, count(*) AS n FROM embeddings UNION ALL SELECT 'after', 0 UNION ALL SELECT 'written again', count(*) FROM embeddings WHERE label = 1")
def s13(spark, sf_dir):
    held = kept_table(spark, sf_dir)
    count = lambda state: held.read().agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "n")
    before = count("before")  # read lazily, after the table has been cleared
    held.clear()
    after = count("after")
    held.upsert(stored(spark, sf_dir).where("project_path = 'p1'"))
    return before.union(after).union(count("written again"))


@query("s14_table_init", "SELECT 'p' || label AS project_path, count(*) AS n FROM embeddings WHERE label <= 2 GROUP BY 1")
def s14(spark, sf_dir):
    """An empty table with its schema, then one write for each project: only that project's files are made."""
    held = S.ChunkTable(spark, scratch_path(spark, "table"))
    held.create()
    for k in range(3):
        held.upsert(stored(spark, sf_dir).where(F.col("project_path") == f"p{k}"))
    return held.read().groupBy("project_path").agg(F.count("*").alias("n"))


@query("s16_health_probe", "SELECT 'kept' AS which, 'healthy' AS status UNION ALL SELECT 'empty', 'healthy'")
def s16(spark, sf_dir):
    empty = S.ChunkTable(spark, scratch_path(spark, "table"))
    return spark.createDataFrame([("kept", kept_table(spark, sf_dir).health()["status"]), ("empty", empty.health()["status"])], "which string, status string")


@query("s1_scan_by_extension", f"WITH {FILES} SELECT language, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM files WHERE ends_with(file_path, '.txt') GROUP BY language")
def s1(spark, sf_dir):
    return files(spark, sf_dir).where(F.endswith("file_path", F.lit(".txt"))).groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


@query("t14_common_directory", f"WITH {FILES} SELECT string_split(min(file_path), '/')[1] AS common FROM files")
def t14(spark, sf_dir):
    from quarry.sources.files import common_directory

    return spark.createDataFrame([(common_directory(files(spark, sf_dir)),)], "common string")


@query("p4_embedding_strategy", f"WITH {TYPED} SELECT id, CASE WHEN chunk_type = 'class_complete' THEN 'class' ELSE 'general' END AS strategy FROM typed")
def p4(spark, sf_dir):
    return typed_chunks(spark, sf_dir).select("id", embedding.strategy(F.col("chunk_type")).alias("strategy"))


@query("p3_embedding_text", f"WITH {chunks_sql(8)} SELECT id, md5('type: general | language: ' || language || ' | file: ' || string_split(file_path, '/')[-1] || CASE WHEN trim(regexp_extract(content, 'class ([^(:\\n]*)', 1)) <> '' THEN ' | class: ' || trim(regexp_extract(content, 'class ([^(:\\n]*)', 1)) ELSE '' END || ' | ' || content) AS digest FROM chunks")
def p3(spark, sf_dir):
    c = F.col
    text = embedding.embedding_text(c("chunk_type"), c("language"), c("file_path"), c("content"))
    return chunks(spark, sf_dir, 8).select("id", F.md5(text.cast("binary")).alias("digest"))


@query("p7_keyword_density", f"WITH {FILES} SELECT file_path, round(coalesce(len(list_filter(w, lambda x: list_contains(['the', 'and', 'der', 'que'], x))) / nullif(len(w), 0), 0), 6) AS density FROM (SELECT file_path, list_filter(regexp_split_to_array(content, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM files)")
def p7(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", F.round(embedding.keyword_density(F.col("content"), ["the", "and", "der", "que"]), 6).alias("density"))


@query("e1_embed_chunks", f"WITH {chunks_sql(50)},{embedded_sql('chunks', 'id', chr(39) + 'x ' + chr(39) + ' || content', 64)} SELECT id, 64 AS dimension, total FROM embedded")
def e1(spark, sf_dir):
    made = embedding.embed(chunks(spark, sf_dir, 50).select("id", "content"), F.concat(F.lit("x "), "content"), lambda: embedding.HashingEmbedder(64))
    return made.select("id", F.size("embedding").alias("dimension"), vector_total(F.col("embedding")).alias("total"))


@query(
    "e2_embedding_contexts",
    f"""WITH {TYPED},{_PARENTS},
    sib AS (SELECT a.id, count(*) AS n FROM parents a JOIN parents b ON a.parent_id = b.parent_id AND a.id <> b.id GROUP BY a.id)
    SELECT t.id, length(p.content) AS parent_chars, CAST(least(3, coalesce(sib.n, 0)) AS INTEGER) AS siblings
    FROM typed t LEFT JOIN parents x ON x.id = t.id LEFT JOIN typed p ON p.id = x.parent_id LEFT JOIN sib ON sib.id = t.id""",
)
def e2(spark, sf_dir):
    both = typed_chunks(spark, sf_dir)
    parents = relations.parents(both)
    found = embedding.embedding_contexts(both, parents, relations.siblings(both, parents))
    return found.select("id", F.length("parent_content").alias("parent_chars"), F.coalesce(F.size("sibling_contents"), F.lit(0)).alias("siblings"))


@query("e3_parent_blend", "SELECT e.vec_id, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: 0.95::DOUBLE * e.embedding[i]::DOUBLE + 0.05::DOUBLE * q.embedding[i]::DOUBLE)), 5) AS total FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q")
def e3(spark, sf_dir):
    from quarry.operators.vector import literal_vector

    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    blended = embedding.blend(F.transform("embedding", lambda x: x.cast("double")), literal_vector(first))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(blended, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("x1_window_expansion", f"WITH {TYPED}, l AS (SELECT s.*, string_split(f.content, chr(10)) AS ls, greatest(1, length(s.content) // 4) <= 1500 AS small FROM typed s JOIN files f USING (file_path)) SELECT id AS base_id, small AS expanded, CAST(CASE WHEN small THEN greatest(1, start_line - 15) ELSE start_line END AS BIGINT) AS start_line, CAST(CASE WHEN small THEN least(len(ls), end_line + 15) ELSE end_line END AS BIGINT) AS end_line FROM l")
def x1(spark, sf_dir):
    return expansion.expand_windows(typed_chunks(spark, sf_dir), files(spark, sf_dir)).select("base_id", "expanded", "start_line", "end_line")


@query(
    "p19_expanded_content",
    f"""WITH {TYPED},
    l AS (SELECT s.*, string_split(f.content, chr(10)) AS ls, greatest(1, length(s.content) // 4) <= 1500 AS small FROM typed s JOIN files f USING (file_path)),
    p AS (SELECT *, array_to_string(ls[greatest(1, start_line - 15) : start_line - 1], chr(10)) AS before, array_to_string(ls[end_line + 1 : end_line + 15], chr(10)) AS after FROM l)
    SELECT CASE WHEN small THEN id || '_expanded' ELSE id END AS id,
           md5(CASE WHEN small THEN concat_ws(chr(10), CASE WHEN before <> '' THEN '# --- Context Before ---' || chr(10) || before END, '# --- Main ---', content, CASE WHEN after <> '' THEN '# --- Context After ---' || chr(10) || after END) ELSE content END) AS digest
    FROM p""",
)
def p19(spark, sf_dir):
    return expansion.expand_windows(typed_chunks(spark, sf_dir), files(spark, sf_dir)).select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


