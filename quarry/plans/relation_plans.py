"""Queries that relate chunks, files and sessions to each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import relations as R
from quarry.plans.base import ACTIVITY, activity, chunks, chunks_sql, file_path, query, table
from quarry.plans.vector_plans import RESULTS, results


def typed_chunks(spark, sf_dir):
    """Chunks of 8 and of 20 lines together; the larger ones stand for whole classes."""
    small = chunks(spark, sf_dir, 8)
    large = chunks(spark, sf_dir, 20).withColumn("chunk_type", F.lit("class_complete"))
    both = large.unionByName(small).withColumn("id", F.md5(F.concat_ws("_", "id", "chunk_type").cast("binary")))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_type", "id")).cast("long"))


TYPED = f"""{chunks_sql(8)},
large AS (SELECT * FROM ({"WITH " + chunks_sql(20) + " SELECT * FROM chunks"})),
both_sizes AS (SELECT * REPLACE ('class_complete' AS chunk_type) FROM large UNION ALL BY NAME SELECT * FROM chunks),
typed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_type, id) AS ord)
          FROM (SELECT * REPLACE (md5(concat_ws('_', id, chunk_type)) AS id) FROM both_sizes))"""


def seed_rows(spark, sf_dir):
    """What the batch of vector questions retrieves, as chunks: of every file found the best small chunk, with the file's best hit as score.

    ``ord`` ranks the seeds of a project.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), file_path().alias("file_path"))
    hits = results(spark, sf_dir).join(docs, "id").groupBy("file_path").agg(F.round(F.max("score"), 5).alias("hit"))
    best = Window.partitionBy("file_path").orderBy(F.desc("score"), "id")
    small = typed_chunks(spark, sf_dir).where("chunk_type = 'text'").join(hits, "file_path").withColumn("_n", F.row_number().over(best)).where("_n = 1")
    ranked = small.withColumn("score", F.col("hit")).drop("_n", "hit")
    return ranked.withColumn("ord", F.row_number().over(Window.partitionBy("project_path").orderBy(F.desc("score"), "id")).cast("long"))


SEEDS = f"""{TYPED},{RESULTS},
hits AS (SELECT 'src/' || source || '/doc_' || doc_id || '.txt' AS file_path, round(max(score), 5) AS hit FROM results JOIN documents ON doc_id = id GROUP BY 1),
small AS (SELECT t.*, hit, row_number() OVER (PARTITION BY t.file_path ORDER BY score DESC, id) AS best FROM typed t JOIN hits ON hits.file_path = t.file_path WHERE chunk_type = 'text'),
seeds AS (SELECT * EXCLUDE (hit, best) REPLACE (hit AS score, row_number() OVER (PARTITION BY project_path ORDER BY hit DESC, id) AS ord) FROM small WHERE best = 1)"""

_RELATED = """
rel0 AS (SELECT s.id AS seed_id, c.id, c.ord, c.chunk_type, c.start_line, c.end_line, s.start_line AS ss, s.end_line AS se, s.chunk_type AS st,
                row_number() OVER (PARTITION BY s.id ORDER BY c.ord, c.id) AS n
         FROM seeds s JOIN typed c ON c.file_path = s.file_path AND c.id <> s.id WHERE s.chunk_type <> 'class_complete'),
rel1 AS (SELECT *, CASE WHEN chunk_type = 'class_complete' AND start_line <= ss AND end_line >= se THEN 'parent'
                        WHEN abs(start_line - ss) < 50 AND chunk_type = st THEN 'sibling'
                        WHEN start_line <= se AND end_line >= ss THEN 'overlap' END AS relation FROM rel0 WHERE n <= 20),
related AS (SELECT * FROM (SELECT seed_id, id, relation, row_number() OVER (PARTITION BY seed_id ORDER BY ord, id) AS rel_ord FROM rel1 WHERE relation IS NOT NULL) WHERE rel_ord <= 5)"""


@query("j1_related_chunks", f"WITH {SEEDS},{_RELATED} SELECT seed_id, id, relation, rel_ord FROM related")
def j1(spark, sf_dir):
    return R.related_chunks(seed_rows(spark, sf_dir), typed_chunks(spark, sf_dir))


@query(
    "j2_with_related",
    f"""WITH {SEEDS},{_RELATED},
    everything AS (SELECT id, score, ord AS seed_ord, 0 AS rel_ord FROM seeds
            UNION ALL SELECT r.id, s.score * CASE relation WHEN 'parent' THEN 0.9::DOUBLE WHEN 'sibling' THEN 0.7::DOUBLE WHEN 'overlap' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END, s.ord, r.rel_ord
            FROM related r JOIN seeds s ON s.id = r.seed_id),
    firsts AS (SELECT id, min({{'a': seed_ord, 'b': rel_ord, 'c': score}}) AS f FROM everything GROUP BY id)
    SELECT id, round(f.c, 6) AS score, f.a AS seed_ord, CAST(f.b AS BIGINT) AS rel_ord FROM firsts ORDER BY f.a, f.b, id LIMIT 90""",
)
def j2(spark, sf_dir):
    seeds, all_chunks = seed_rows(spark, sf_dir), typed_chunks(spark, sf_dir)
    found = R.with_related(seeds, R.related_chunks(seeds, all_chunks), all_chunks, cap=90)
    return found.withColumn("score", F.round("score", 6))


_PARENTS = """
parents AS (SELECT c.id, arg_min(p.id, {'a': p.start_line, 'b': p.ord, 'c': p.id}) AS parent_id FROM typed c JOIN typed p
            ON p.file_path = c.file_path AND p.id <> c.id AND p.start_line <= c.start_line AND p.end_line >= c.end_line GROUP BY c.id)"""


@query("j3_containing_parents", f"WITH {TYPED},{_PARENTS} SELECT id, parent_id FROM parents")
def j3(spark, sf_dir):
    return R.parents(typed_chunks(spark, sf_dir))


@query("j3_siblings", f"WITH {TYPED},{_PARENTS} SELECT a.id, b.id AS sibling_id FROM parents a JOIN parents b ON a.parent_id = b.parent_id AND a.id <> b.id")
def j3_siblings(spark, sf_dir):
    all_chunks = typed_chunks(spark, sf_dir)
    return R.siblings(all_chunks, R.parents(all_chunks))


@query("j4_overlap_edges", f"WITH {chunks_sql(8)} SELECT a.id AS src_id, b.id AS dst_id FROM chunks a JOIN chunks b ON a.file_path = b.file_path AND a.id <> b.id AND a.start_line <= b.end_line AND b.start_line <= a.end_line")
def j4(spark, sf_dir):
    return R.overlap_edges(chunks(spark, sf_dir, 8))


@query("j5_relation_lookup", f"WITH {SEEDS},{_RELATED} SELECT seed_id, count(*) AS n, string_agg(relation, ',' ORDER BY relation) AS relations FROM related WHERE relation IN ('sibling', 'parent') GROUP BY seed_id")
def j5(spark, sf_dir):
    found = R.related_chunks(seed_rows(spark, sf_dir), typed_chunks(spark, sf_dir)).where("relation in ('sibling', 'parent')")
    return found.groupBy("seed_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("relation")), ",").alias("relations"))


@query("j6_enclosing_class", f"WITH {TYPED} SELECT m.id, arg_min(c.id, {{'a': c.ord, 'b': c.id}}) AS class_id FROM typed m JOIN typed c ON m.file_path = c.file_path AND c.chunk_type = 'class_complete' AND m.chunk_type = 'text' AND c.start_line <= m.start_line AND c.end_line >= m.end_line GROUP BY m.id")
def j6(spark, sf_dir):
    both = typed_chunks(spark, sf_dir)
    owner = both.where("chunk_type = 'class_complete'").select("file_path", F.col("id").alias("c_id"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), F.col("ord").alias("c_ord"))
    inside = both.where("chunk_type = 'text'").join(owner, "file_path").where("c_start <= start_line and c_end >= end_line")
    return inside.groupBy("id").agg(F.min_by("c_id", F.struct("c_ord", "c_id")).alias("class_id"))


@query("j7_import_resolution", "SELECT DISTINCT 'nation/' || n_nationkey || '.py' AS file_path, 'region/' || n_regionkey || '.py' AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def j7(spark, sf_dir):
    imports = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), "n_nationkey", F.lit(".py")).alias("file_path"), F.concat(F.lit("region."), "n_regionkey").alias("module"))
    known = table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey", F.lit(".py")).alias("file_path"))
    return R.resolve_imports(imports, known)


@query(
    "j8_symbol_references",
    """WITH names AS (SELECT DISTINCT name FROM (SELECT split_part(p_type, ' ', 1) AS name FROM part UNION ALL SELECT lower(split_part(p_name, ' ', 1)) FROM part UNION ALL SELECT 'a' UNION ALL SELECT left(p_brand, 2) FROM part) WHERE name <> ''),
    imports AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS import_text, 'part_' || p_partkey AS file_path FROM part)
    SELECT DISTINCT file_path, name, 'names' AS defined_in FROM imports JOIN names ON contains(import_text, name)""",
)
def j8(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    names = part.select(word("p_type").alias("name")).union(part.select(F.lower(word("p_name")))).union(part.select(F.substring("p_brand", 1, 2))).union(spark.createDataFrame([("a",)], "name string"))
    imports = part.select(F.concat(F.lit("part_"), "p_partkey").alias("file_path"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("import_text"))
    return R.symbol_references(names.where("name <> ''").distinct().select("name", F.lit("names").alias("file_path")), imports)


@query("j9_dependency_context", "WITH sel AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), deps AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM sel)), seen AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') SELECT p_partkey, p_retailprice FROM part WHERE p_partkey IN (SELECT l_partkey FROM deps) AND p_partkey NOT IN (SELECT l_partkey FROM seen) ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def j9(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    of = lambda wanted: lines.join(orders.where(wanted), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    selected = F.col("o_orderstatus") == "P"
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return R.dependency_context(part, of(selected), of(selected & (F.col("o_orderpriority") == "1-URGENT")), "p_partkey", "p_retailprice", 25)


@query("j10_temporal_band_join", f"WITH {ACTIVITY}, e AS (SELECT DISTINCT file_path, session_id, ts FROM activity WHERE activity = 'edit') SELECT DISTINCT a.session_id, a.file_path AS a, b.file_path AS b FROM e a JOIN e b ON a.session_id = b.session_id AND a.file_path <> b.file_path AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600 * 1000000")
def j10(spark, sf_dir):
    return R.band_pairs(activity(spark, sf_dir).where("activity = 'edit'"), 600, within=["session_id"]).select("session_id", "a", "b")


@query("j12_unseen_results", f"WITH {SEEDS} SELECT id FROM typed WHERE id NOT IN (SELECT id FROM seeds)")
def j12(spark, sf_dir):
    return R.unseen(typed_chunks(spark, sf_dir), seed_rows(spark, sf_dir)).select("id")


_EXPANSION = """
x0 AS (SELECT s.id AS seed_id, c.id, c.ord, s.score AS seed_score, row_number() OVER (PARTITION BY s.id ORDER BY c.ord, c.id) AS n FROM seeds s JOIN typed c USING (file_path)),
x1 AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY ord, id) AS m FROM x0 WHERE n <= {fetched} AND id NOT IN (SELECT id FROM seeds))"""


@query("j13_conservative_expansion", f"WITH {SEEDS},{_EXPANSION.format(fetched=8)} SELECT seed_id, id, round(seed_score * 0.7::DOUBLE, 6) AS score FROM x1 WHERE m <= 3")
def j13(spark, sf_dir):
    found = R.same_file_expansion(seed_rows(spark, sf_dir), typed_chunks(spark, sf_dir), 8, 3, 0.7)
    return found.withColumn("score", F.round("score", 6))


@query("j13_aggressive_expansion", f"WITH {SEEDS},{_EXPANSION.format(fetched=15)} SELECT seed_id, id, 0.5::DOUBLE AS score FROM x1 WHERE m <= 15")
def j13_aggressive(spark, sf_dir):
    return R.same_file_expansion(seed_rows(spark, sf_dir), typed_chunks(spark, sf_dir), 15, 15, None)


_EDGES = "edges AS (SELECT DISTINCT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def nation_edges(spark, sf_dir):
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    a = supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return a.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).distinct()


@query("j14_related_symbols", f"WITH {_EDGES}, nb AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT node, count(*) AS degree FROM nb GROUP BY node), r AS (SELECT nb.node, other, d.degree * CASE WHEN left(nb.node, 1) = left(other, 1) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM nb JOIN d ON d.node = nb.other) SELECT node, other, score FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS n FROM r) WHERE n <= 5")
def j14(spark, sf_dir):
    near = R.neighbours(nation_edges(spark, sf_dir))
    degree = near.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("degree"))
    score = F.col("degree") * F.when(F.substring("node", 1, 1) == F.substring("other", 1, 1), 1.5).otherwise(1.0)
    ranked = near.join(degree, "other").withColumn("score", score)
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))).where("_n <= 5").select("node", "other", "score")


@query("u7_dependencies_and_dependents", f"WITH {_EDGES} SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges")
def u7(spark, sf_dir):
    return R.neighbours(nation_edges(spark, sf_dir))
