"""Whole retrievals over the driver's tables, and the flagship: questions in, packed contexts out.

A *chunk* is a document with an embedding, its file the document's source.  The
*questions* are the vectors whose id is divisible by 50, each with the words of a
conversation.  A further query of a question (a symbol, a follow-up) has the
vector that many numbers after the question's own.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.operators import retrieval
from quarry.plans.base import query, table
from quarry.plans.text_plans import _KEPT, _SYM, _UNIQUE, _WORDS, BROADER_SQL, TYPE_SQL

K = 5


def chunk_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("src/"), "source", F.lit(".py")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    kind = F.when(F.col("id") % 5 == 0, "class_complete").when(F.col("id") % 5 == 1, "function_definition").otherwise("text")
    start = (F.col("id") % 40) * 10 + 1
    end = start + F.when(F.col("id") % 5 == 0, 60).otherwise(F.col("id") % 13)
    return vectors.join(docs, "id").select("id", "file_path", kind.alias("chunk_type"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), "content", "embedding")


def asked_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select((F.col("conv_id") * 50).alias("question"), "text")
    vectors = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    more = F.element_at(F.array(F.lit("how does the class Data process the words and tokens"), F.lit("example usage: how to use the function Find with words"), F.lit("what is the meaning of class Node")), (F.col("question") / 50 % 3 + 1).cast("int"))
    return vectors.join(first, "question", "left").select("question", F.concat_ws(" ", F.substring(F.coalesce("text", F.lit("")), 1, 40), more).alias("query"), "vector")


def embed(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    return lambda more: more.join(vectors, F.col("question") + F.col("part") + 1 == F.col("_v")).drop("_v")


_TABLES = """
rows AS (SELECT e.vec_id AS id, 'src/' || source || '.py' AS file_path, CASE e.vec_id % 5 WHEN 0 THEN 'class_complete' WHEN 1 THEN 'function_definition' ELSE 'text' END AS chunk_type,
                e.vec_id % 40 * 10 + 1 AS start_line, e.vec_id % 40 * 10 + 1 + CASE WHEN e.vec_id % 5 = 0 THEN 60 ELSE e.vec_id % 13 END AS end_line, coalesce(text, '') AS content, embedding
         FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
srows AS (SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM rows),
turns AS (SELECT conv_id * 50 AS question, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
asked AS (SELECT vec_id AS question, concat_ws(' ', left(coalesce(text, ''), 40),
                 ['how does the class Data process the words and tokens', 'example usage: how to use the function Find with words', 'what is the meaning of class Node'][vec_id // 50 % 3 + 1]) AS query, embedding AS vector
          FROM embeddings LEFT JOIN turns ON question = vec_id WHERE vec_id % 50 = 0)"""


def retrieve_sql(name: str, asked: str, rows: str, k: int) -> str:
    """CTEs that end in ``name``: the results of ``asked`` over ``rows``."""
    cos = "list_inner_product(r.embedding::DOUBLE[], a.vector::DOUBLE[]) / (sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])) * sqrt(list_inner_product(a.vector::DOUBLE[], a.vector::DOUBLE[])))"
    n = name
    return f"""
{n}_near AS (SELECT question, id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS ord FROM (SELECT a.question, r.id, {cos} AS score FROM {asked} a, {rows} r)) WHERE ord <= {2 * k}),
{n}_place AS (SELECT * FROM (SELECT id, file_path, chunk_type, start_line, end_line, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM {rows}) WHERE place <= 21),
{n}_rel0 AS (SELECT s.question, s.id AS seed_id, c.id, s.score, s.ord AS seed_ord, c.place, c.chunk_type, c.start_line, c.end_line, r.chunk_type AS st, r.start_line AS ss, r.end_line AS se,
             row_number() OVER (PARTITION BY s.question, s.id ORDER BY c.place) AS n
       FROM {n}_near s JOIN {rows} r ON r.id = s.id JOIN {n}_place c ON c.file_path = r.file_path AND c.id <> s.id WHERE r.chunk_type <> 'class_complete'),
{n}_rel1 AS (SELECT *, CASE WHEN chunk_type = 'class_complete' AND start_line <= ss AND end_line >= se THEN 'parent' WHEN abs(start_line - ss) < 50 AND chunk_type = st THEN 'sibling'
             WHEN start_line <= se AND end_line >= ss THEN 'overlap' END AS relation FROM {n}_rel0 WHERE n <= 20),
{n}_rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, seed_id ORDER BY place) AS rel_ord FROM {n}_rel1 WHERE relation IS NOT NULL) WHERE rel_ord <= 5),
{n}_every AS (SELECT question, id, score, ord AS seed_ord, 0 AS rel_ord FROM {n}_near UNION ALL
         SELECT question, id, score * CASE relation WHEN 'parent' THEN 0.9::DOUBLE WHEN 'sibling' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END, seed_ord, rel_ord FROM {n}_rel),
{n}_first AS (SELECT question, id, min({{'a': seed_ord, 'b': rel_ord, 'c': score}}) AS f FROM {n}_every GROUP BY ALL),
{n}_cap AS (SELECT * FROM (SELECT question, id, f, row_number() OVER (PARTITION BY question ORDER BY f.a, f.b, id) AS n FROM {n}_first) WHERE n <= {int(1.5 * k)}),
{n}_text AS (SELECT c.question, c.id, f.a AS a, f.b AS b, f.c AS score, r.file_path, r.chunk_type, r.start_line, r.end_line, r.content, query, {TYPE_SQL} AS kind, {_SYM} AS names, {_WORDS} AS ws
         FROM {n}_cap c JOIN {rows} r USING (id) JOIN {asked} USING (question)),
{n}_score AS (SELECT question, id, a, b, file_path, chunk_type, start_line, end_line, content, score
         * CASE WHEN contains(lower(query), 'class') AND chunk_type = 'class_complete' THEN 1.2::DOUBLE ELSE 1 END
         * CASE WHEN (contains(lower(query), 'function') OR contains(lower(query), 'method') OR contains(lower(query), 'def')) AND chunk_type = 'function_definition' THEN 1.15::DOUBLE ELSE 1 END
         * (1 + 0.1::DOUBLE * len(list_filter(ws, lambda w: contains(lower(content), w))))
         * CASE kind WHEN 'DEFINITION' THEN CASE chunk_type WHEN 'class_complete' THEN 1.3::DOUBLE ELSE 1 END
                     WHEN 'IMPLEMENTATION' THEN CASE chunk_type WHEN 'function_definition' THEN 1.15::DOUBLE WHEN 'class_complete' THEN 1.1::DOUBLE ELSE 1 END
                     WHEN 'USAGE_EXAMPLES' THEN CASE WHEN contains(lower(content), 'example') OR contains(lower(content), 'test') OR contains(lower(content), 'demo') OR contains(lower(content), 'sample') THEN 1.2::DOUBLE ELSE 1 END ELSE 1 END
         * CASE WHEN len(list_filter(names, lambda s: contains(content, s))) > 0 THEN 1.1::DOUBLE ELSE 1 END
         * CASE WHEN ends_with(file_path, '.py') AND (kind <> 'USAGE_EXAMPLES' OR NOT contains(file_path, 'test')) THEN 1.05::DOUBLE ELSE 1 END AS score FROM {n}_text),
{n} AS (SELECT * EXCLUDE (a, b) FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, a, b, id) AS ord FROM {n}_score) WHERE ord <= {k})"""


_FOUND = f"{_TABLES},{retrieve_sql('found', 'asked', 'rows', K)}"


@query("v12_retrieve", f"WITH {_FOUND} SELECT question, id, round(score, 6) AS score, ord FROM found")
def v12_retrieve(spark, sf_dir):
    found = retrieval.retrieve(asked_rows(spark, sf_dir), chunk_rows(spark, sf_dir), K)
    return found.select("question", "id", F.round("score", 6).alias("score"), "ord")


_MORE = f"""
names AS (SELECT question, unnest(range(0, len(s))) AS part, unnest(s) AS query, many FROM (SELECT question, {_UNIQUE.format(x='x')}[1:3] AS s, len({_UNIQUE.format(x='x')}) AS many FROM (SELECT question, {_SYM} AS x FROM asked))),
broad AS (SELECT question, unnest(range(3, 3 + len(s))) AS part, unnest(s) AS query, NULL AS many FROM (SELECT question, ({BROADER_SQL})[1:2] AS s FROM asked)),
parts AS (SELECT m.question AS owner, part, query, many, m.question || '#' || part AS question, embedding AS vector FROM (SELECT * FROM names UNION ALL SELECT * FROM broad) m JOIN embeddings e ON e.vec_id = m.question + part + 1)"""

_STAGES = f"""{_FOUND},{_MORE},{retrieve_sql('again', 'parts', 'srows', K)},
kept AS (SELECT p.owner AS question, g.id, CASE WHEN part < 3 THEN CASE WHEN contains(content, query) THEN score * CASE WHEN contains(content, 'class ' || query) OR contains(content, 'def ' || query) THEN 1.5::DOUBLE ELSE 1.2::DOUBLE END END ELSE score * 0.7::DOUBLE END AS score,
                CASE WHEN part < 3 THEN part ELSE part + 1 END * 10000 + ord AS ord
         FROM again g JOIN parts p USING (question) WHERE ord <= CASE WHEN part < 3 THEN greatest({K} // many, 1) ELSE {max(1, K // 2)} END),
seen AS (SELECT CAST(question AS VARCHAR) AS question, id, score, ord FROM kept WHERE score IS NOT NULL UNION ALL SELECT CAST(question AS VARCHAR), CAST(id AS VARCHAR), score, 30000 + ord FROM found),
fold AS (SELECT question, id, list({{'s': score, 'n': 1}} ORDER BY ord) AS l FROM seen GROUP BY ALL),
fused AS (SELECT question, id, list_reduce(l, lambda a, x: {{'s': ((a.s + x.s) / 2) * (1 + 0.15::DOUBLE * a.n), 'n': a.n + 1}}).s AS score, len(l) AS sightings FROM fold),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS ord FROM fused) WHERE ord <= {K})"""


@query("r5_multi_stage_retrieval", f"WITH {_STAGES} SELECT question, id, round(score, 6) AS score, sightings, ord FROM best")
def r5_stages(spark, sf_dir):
    found = retrieval.multi_stage(asked_rows(spark, sf_dir), chunk_rows(spark, sf_dir), K, embed(spark, sf_dir))
    return found.select("question", "id", F.round("score", 6).alias("score"), "sightings", "ord")


_STATE = """
state AS (SELECT 'src/' || source || '.py' AS file_path, TIMESTAMP '2024-01-10' - to_hours(CAST(min(doc_id) % 200 AS INTEGER)) AS last_edited, TIMESTAMP '2024-01-10' - to_hours(CAST(max(doc_id) % 30 AS INTEGER)) AS last_opened, count(*) % 15 AS edit_frequency FROM documents GROUP BY source)"""


def state_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    ago = lambda c, most: F.lit("2024-01-10").cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col(c) % most).cast("int"))
    return docs.select(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("file_path"), ago("a", 200).alias("last_edited"), ago("b", 30).alias("last_opened"), (F.col("n") % 15).alias("edit_frequency"))


_STEM = "replace(split_part(lower(file_path), '/', -1), '.py', '')"
_ANY = lambda text, terms: "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


@query(
    "r9_boosted_results",
    f"""WITH {_TABLES},{retrieve_sql('found', 'asked', 'rows', 2 * K)},{_STATE},
    h AS (SELECT f.*, lower(query) AS low, (epoch_us(TIMESTAMP '2024-01-10') - epoch_us(last_edited)) / 3600e6::DOUBLE AS eh, (epoch_us(TIMESTAMP '2024-01-10') - epoch_us(last_opened)) / 3600e6::DOUBLE AS oh, edit_frequency AS edits
          FROM found f LEFT JOIN state USING (file_path) JOIN asked USING (question)),
    b AS (SELECT question, id, score, CASE WHEN eh >= 0 AND eh < 24 THEN 1 + 0.5::DOUBLE * greatest(0.1::DOUBLE, 1 - eh / 24) ELSE 1 END
        * CASE WHEN oh < 2 THEN greatest(1.0::DOUBLE, 1.3::DOUBLE * (1 - oh / 2)) ELSE 1 END
        * CASE WHEN edits > 3 THEN least(1.2::DOUBLE, 1 + 0.05::DOUBLE * edits) ELSE 1 END
        * CASE WHEN {_ANY("lower(split_part(file_path, '/', -1))", ['main', 'index', 'app', 'server'])} THEN 1.1::DOUBLE ELSE 1 END
        * CASE WHEN {_ANY("lower(split_part(file_path, '/', -1))", ['config', 'settings', '.env', 'setup'])} AND {_ANY('low', ['config', 'setting', 'env', 'setup'])} THEN 1.05::DOUBLE ELSE 1 END
        * CASE WHEN {_ANY('lower(file_path)', ['test', 'spec'])} AND NOT contains(low, 'test') THEN 0.9::DOUBLE ELSE 1 END
        * CASE WHEN contains(low, {_STEM}) THEN 1.3::DOUBLE ELSE 1 END
        * CASE WHEN len(list_filter(string_split(lower(file_path), '/'), lambda p: p <> '' AND contains(low, p))) > 0 THEN 1.1::DOUBLE ELSE 1 END AS boost FROM h),
    c AS (SELECT question, id, greatest(score * 0.5::DOUBLE, least(score * 3, score * boost)) AS score FROM b)
    SELECT question, id, round(score, 6) AS score, ord FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS ord FROM c) WHERE ord <= {K}""",
)
def r9_boosted(spark, sf_dir):
    found = retrieval.boosted(asked_rows(spark, sf_dir), chunk_rows(spark, sf_dir), state_rows(spark, sf_dir), "2024-01-10", K)
    return found.select("question", "id", F.round("score", 6).alias("score"), "ord")


@query("r4_broader_stage", f"WITH {_FOUND},{_MORE},{retrieve_sql('again', 'parts', 'srows', K)} SELECT p.owner AS question, part, g.id, round(score * 0.7::DOUBLE, 6) AS score FROM again g JOIN parts p USING (question) WHERE part >= 3 AND ord <= {max(1, K // 2)}")
def r4(spark, sf_dir):
    found = retrieval.broader_stage(asked_rows(spark, sf_dir), chunk_rows(spark, sf_dir), K, embed(spark, sf_dir))
    return found.select(F.col("owner").alias("question"), "part", "id", F.round("score", 6).alias("score"))


_EXPANDING = f"(SELECT question, {_KEPT(Q.EXPANSION_STOPS, 3)} AS kept, lower(query) AS low FROM asked)"
_FOLLOW = f"""
follow AS (SELECT question, unnest(range(0, len(s))) AS part, unnest(s) AS query FROM (SELECT question, list_concat(flatten(list_transform(kept, lambda w: [w || ' implementation', w || ' usage'])),
        CASE WHEN len(kept) >= 2 THEN [kept[1] || ' ' || kept[2]] ELSE [] END, CASE WHEN contains(low, 'error') OR contains(low, 'bug') THEN ['error handling debugging'] ELSE [] END,
        CASE WHEN contains(low, 'test') THEN ['test cases examples'] ELSE [] END)[1:2] AS s FROM {_EXPANDING})),
parts AS (SELECT f.question AS owner, part, query, f.question || '#' || part AS question, embedding AS vector FROM follow f JOIN embeddings e ON e.vec_id = f.question + part + 1)"""


def _near_sql(best: int, fetched: int, kept: int, score: str) -> str:
    return f"""
own_place AS (SELECT * FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM rows) WHERE place <= {fetched}),
near0 AS (SELECT f.question, f.id AS seed, p.id, f.score, row_number() OVER (PARTITION BY f.question, f.id ORDER BY place) AS n FROM found f JOIN own_place p USING (file_path)
          WHERE f.ord <= {best} AND NOT EXISTS (SELECT 1 FROM found o WHERE o.question = f.question AND o.id = p.id)),
near AS (SELECT question, id, max({score}) AS score, 1 AS stage FROM near0 WHERE n <= {kept} GROUP BY question, id)"""


_FOLLOWED = f"""{_FOLLOW},{retrieve_sql('again', 'parts', 'srows', 8)},
fresh AS (SELECT p.owner, CAST(g.id AS BIGINT) AS id, score, row_number() OVER (PARTITION BY question ORDER BY ord) AS n FROM again g JOIN parts p USING (question)
          WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.question = p.owner AND CAST(o.id AS VARCHAR) = g.id)),
more AS (SELECT owner AS question, id, max(score) * 0.8::DOUBLE AS score, 2 AS stage FROM fresh WHERE n <= 4 GROUP BY ALL)"""

_LEVELS = {
    "conservative": (_near_sql(5, 8, 3, "score * 0.7::DOUBLE"), ["near"]),
    "moderate": (_FOLLOWED, ["more"]),
    "aggressive": (_near_sql(3, 15, 15, "0.5::DOUBLE") + "," + _FOLLOWED, ["near", "more"]),
}


def _register_level(level: str) -> None:
    ctes, stages = _LEVELS[level]
    union = " ".join(f"UNION ALL SELECT question, id, score, stage FROM {s}" for s in stages)
    sql = f"""WITH {_FOUND},{ctes}, every AS (SELECT question, id, score, 0 AS stage FROM found {union}), one AS (SELECT question, id, arg_min(score, stage) AS score FROM every GROUP BY ALL)
        SELECT question, id, round(score, 6) AS score FROM one"""

    @query(f"x2_expansion_{level}", sql)
    def run(spark, sf_dir):
        found = retrieval.expanded(asked_rows(spark, sf_dir), chunk_rows(spark, sf_dir), K, level, embed(spark, sf_dir))
        return found.select("question", "id", F.round("score", 6).alias("score"))


for _level in _LEVELS:
    _register_level(_level)


BUDGET = 2_000


@query(
    "flagship_context",
    f"""WITH {_STAGES},
    texts AS (SELECT b.question, b.id, b.score, greatest(1, length(r.content) // 4) AS tokens, row_number() OVER (PARTITION BY b.question, md5(trim(r.content)) ORDER BY b.score DESC, b.id) AS copy FROM best b JOIN srows r USING (id)),
    packed AS (SELECT question, id, score, tokens, CAST(sum(tokens) OVER (PARTITION BY question ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM texts WHERE copy = 1)
    SELECT question, id, round(score, 6) AS score, tokens, running FROM packed WHERE running <= {BUDGET}""",
)
def flagship(spark, sf_dir):
    """For a batch of questions: search in stages, fuse by id, drop equal texts, pack in order of score into 2,000 estimated tokens."""
    from quarry.functions.text import estimated_tokens
    from quarry.operators.fusion import first_by_id, prefix_packing

    rows = chunk_rows(spark, sf_dir)
    found = retrieval.multi_stage(asked_rows(spark, sf_dir), rows, K, embed(spark, sf_dir))
    texts = found.drop("ord").join(rows.select(F.col("id").cast("string").alias("id"), "content"), "id")
    single = first_by_id(texts.withColumn("digest", F.md5(F.trim("content").cast("binary"))).withColumn("falling", -F.col("score")), ["question", "digest"], ["falling", "id"])
    tokens = estimated_tokens(F.col("content"))
    ordered = single.withColumn("ord", F.row_number().over(Window.partitionBy("question").orderBy("falling", "id")))
    return prefix_packing(ordered, "question", BUDGET, tokens).select("question", "id", F.round("score", 6).alias("score"), tokens.alias("tokens"), "running")


@query("x4_answers")
def x4_answers(spark, sf_dir):
    """Contexts of 4,000 tokens with their size; tests hold them against a fold in plain Python."""
    found = retrieval.retrieve(asked_rows(spark, sf_dir), chunk_rows(spark, sf_dir), K)
    return retrieval.packed(found, 4_000).select("question", F.md5(F.col("context").cast("binary")).alias("digest"), "tokens", "chunks")
