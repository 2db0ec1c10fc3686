"""Queries that unite, de-duplicate, merge and budget results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import fusion as U
from quarry.plans.base import FILES, QUESTIONS, chunks, chunks_sql, files, query, questions, table
from quarry.plans.relation_plans import SEEDS, TYPED, seed_rows, typed_chunks
from quarry.plans.vector_plans import _BATCH, _COS, _DOT, RESULTS, results
from quarry.sources.chunk_table import coerced, latest_by_id


def found_texts(spark, sf_dir):
    """Batch search results with the text of the document of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("file_path"))
    return results(spark, sf_dir).join(docs, "id").withColumn("start_line", (F.col("id") % 7 * 10 + 1).cast("long")).withColumn("end_line", (F.col("id") % 7 * 10 + 5 + F.col("id") % 13).cast("long")).withColumnRenamed("query_id", "question")


FOUND = f"""{RESULTS},
found AS (SELECT r.query_id AS question, r.id, r.score, r.ord, coalesce(text, '') AS content, source AS file_path,
                 CAST(r.id % 7 * 10 + 1 AS BIGINT) AS start_line, CAST(r.id % 7 * 10 + 5 + r.id % 13 AS BIGINT) AS end_line FROM results r JOIN documents d ON d.doc_id = r.id)"""


@query("u1_stage_union", f"WITH {RESULTS}, {_BATCH.replace('scored', 'scored2').replace('ranked', 'ranked2').format(score=_DOT)} SELECT 0::BIGINT AS stage, query_id, id, ord FROM results UNION ALL SELECT 1, query_id, id, ord FROM ranked2 WHERE ord <= 5")
def u1(spark, sf_dir):
    stage = lambda df, n: df.select(F.lit(n).cast("long").alias("stage"), "query_id", "id", "ord")
    return stage(results(spark, sf_dir), 0).unionByName(stage(results(spark, sf_dir, 5, "dot_product"), 1))


@query(
    "u2_score_fusion",
    f"""WITH {RESULTS}, {_BATCH.replace('scored', 'scored2').replace('ranked', 'ranked2').format(score=_DOT)},
    s AS (SELECT query_id, id, ord, score FROM results UNION ALL SELECT query_id, id, 100 + ord, score FROM ranked2 WHERE ord <= 10 UNION ALL SELECT query_id, id, 200 + ord, score * 0.7::DOUBLE FROM results WHERE ord <= 4),
    g AS (SELECT query_id, id, list({{'s': score, 'n': 1}} ORDER BY ord) AS l FROM s GROUP BY ALL)
    SELECT query_id, id, round(list_reduce(l, lambda a, x: {{'s': ((a.s + x.s) / 2) * (1 + 0.15::DOUBLE * a.n), 'n': a.n + 1}}).s, 6) AS score, len(l) AS sightings FROM g""",
)
def u2(spark, sf_dir):
    first = results(spark, sf_dir).select("query_id", "id", "ord", "score")
    dots = results(spark, sf_dir, 10, "dot_product").select("query_id", "id", (F.col("ord") + 100).alias("ord"), "score")
    again = first.where("ord <= 4").select("query_id", "id", (F.col("ord") + 200).alias("ord"), (F.col("score") * 0.7).alias("score"))
    return U.fuse_scores(first.union(dots).union(again), ["query_id", "id"]).withColumn("score", F.round("score", 6))


@query("u3_first_by_id", f"WITH {RESULTS} SELECT id, query_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_id, ord) AS n FROM results) WHERE n = 1")
def u3(spark, sf_dir):
    return U.first_by_id(results(spark, sf_dir), ["id"], ["query_id", "ord"]).select("id", "query_id", F.round("score", 6).alias("score"))


@query(
    "u4_drop_repeats",
    f"""WITH {FOUND},
    g AS (SELECT question, list({{'ord': ord, 'id': id, 'f': file_path, 'd': md5(trim(content)), 's': start_line, 'e': end_line}} ORDER BY ord) AS l FROM found GROUP BY question),
    k AS (SELECT question, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x:
        CASE WHEN len(list_filter(a, lambda k: k.d = x[1].d OR (k.f = x[1].f AND k.s <= x[1].e AND k.e >= x[1].s AND (x[1].e - x[1].s) <= (k.e - k.s)))) > 0 THEN a ELSE list_concat(a, x) END)) AS r FROM g)
    SELECT question, r.id AS id, r.ord AS ord FROM k""",
)
def u4(spark, sf_dir):
    return U.drop_repeats(found_texts(spark, sf_dir))


_LINES = "list_distinct(list_filter(list_transform(string_split(lower(content), chr(10)), lambda x: trim(x)), lambda x: x <> ''))"


@query(
    "u5_drop_alike",
    f"""WITH {FOUND},
    g AS (SELECT question, list({{'id': id, 'l': {_LINES}}} ORDER BY ord) AS l FROM found GROUP BY question),
    k AS (SELECT question, list_reduce(list_transform(l, lambda x: [x]), lambda a, x:
        CASE WHEN len(list_filter(a, lambda k: len(list_intersect(k.l, x[1].l)) / nullif(len(list_distinct(list_concat(k.l, x[1].l))), 0) > 0.8)) > 0 THEN a ELSE list_concat(a, x) END) AS r FROM g)
    SELECT question, unnest(list_transform(r, lambda x: x.id)) AS id, CAST(unnest(range(0, len(r))) AS BIGINT) AS ord FROM k""",
)
def u5(spark, sf_dir):
    return U.drop_alike(found_texts(spark, sf_dir))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(query), '[ \t\n\r\f\x0B]+'), lambda w: length(w) > 2))"


@query(
    "u6_similar_questions",
    f"""WITH {QUESTIONS}, w AS (SELECT session_id, turn, {_WORDS} AS w, lag({_WORDS}) OVER (PARTITION BY session_id ORDER BY turn) AS before FROM questions)
    SELECT session_id, turn, round(CASE WHEN len(w) = 0 OR len(before) = 0 THEN 0::DOUBLE ELSE len(list_intersect(w, before)) / len(list_distinct(list_concat(w, before))) END, 6) AS similarity FROM w WHERE before IS NOT NULL""",
)
def u6(spark, sf_dir):
    words = F.array_distinct(F.filter(X.words(F.col("query")), lambda w: F.length(w) > 2))
    asked = questions(spark, sf_dir).select("session_id", "turn", words.alias("w")).withColumn("before", F.lag("w").over(Window.partitionBy("session_id").orderBy("turn")))
    return asked.where("before is not null").select("session_id", "turn", F.round(X.jaccard(F.col("w"), F.col("before")), 6).alias("similarity"))


@query("u8_distinct_symbols", f"WITH {QUESTIONS}, t AS (SELECT session_id, unnest(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+')) AS s FROM questions) SELECT session_id, array_to_string(list_sort(list_distinct(list(s))), ',') AS symbols FROM t GROUP BY session_id")
def u8(spark, sf_dir):
    names = questions(spark, sf_dir).select("session_id", F.explode(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("s"))
    return names.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("symbols"))


@query("u9_keep_last_by_id", "SELECT 'e' || user_id AS id, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id")
def u9(spark, sf_dir):
    """A batch of chunk rows in which ids repeat: the last one of each stays."""
    events = table(spark, sf_dir, "events")
    batch = coerced(events.select(F.concat(F.lit("e"), "user_id").alias("id"), F.col("event_type").alias("content"), F.timestamp_seconds("event_id").alias("updated_at")))
    return latest_by_id(batch).select("id", "content")


@query("a1_group_by_file", f"WITH {SEEDS} SELECT file_path AS group_key, count(*) AS n, array_to_string(list(CAST(start_line AS VARCHAR) ORDER BY start_line, id), ',') AS starts FROM seeds GROUP BY file_path")
def a1(spark, sf_dir):
    starts = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id"))), lambda x: x["start_line"].cast("string"))
    return seed_rows(spark, sf_dir).groupBy(F.col("file_path").alias("group_key")).agg(F.count("*").alias("n"), F.array_join(starts, ",").alias("starts"))


@query("a2_group_by_type", f"WITH {TYPED} SELECT file_path || '#' || chunk_type AS group_key, count(*) AS n, round(max(score), 6) AS best FROM typed GROUP BY 1")
def a2(spark, sf_dir):
    return typed_chunks(spark, sf_dir).groupBy(F.concat("file_path", F.lit("#"), "chunk_type").alias("group_key")).agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


_ISLANDS = """
strong AS (SELECT * FROM chunks),
m AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM strong),
isl AS (SELECT *, sum(CASE WHEN start_line > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, ord ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


@query("a3_adjacent_spans", f"WITH {chunks_sql(8)},{_ISLANDS} SELECT file_path, CAST(island AS BIGINT) AS island, min(start_line) AS start_line, max(end_line) AS end_line, round(max(score), 6) AS score, count(*) AS merged FROM isl GROUP BY file_path, island")
def a3(spark, sf_dir):
    return U.merge_adjacent(chunks(spark, sf_dir, 8), ["file_path"]).drop("content").withColumn("score", F.round("score", 6))


@query(
    "a3_merged_content",
    f"""WITH {chunks_sql(8)},{_ISLANDS},
    g AS (SELECT file_path, CAST(island AS BIGINT) AS island, list({{'c': content, 's': start_line, 'e': end_line}} ORDER BY start_line, ord) AS l FROM isl GROUP BY ALL)
    SELECT file_path, island, list_reduce(l, lambda a, x: {{'c':
        CASE WHEN x.s <= a.e AND a.e - x.s + 1 < len(string_split(x.c, chr(10))) THEN CASE WHEN trim(array_to_string(string_split(x.c, chr(10))[a.e - x.s + 2:], chr(10))) <> '' THEN a.c || chr(10) || array_to_string(string_split(x.c, chr(10))[a.e - x.s + 2:], chr(10)) ELSE a.c END
             WHEN x.s <= a.e + 2 THEN a.c || chr(10) || x.c
             ELSE a.c || chr(10) || chr(10) || '# ... (gap) ...' || chr(10) || chr(10) || x.c END, 's': a.s, 'e': greatest(a.e, x.e)}}).c AS content FROM g""",
)
def a3_content(spark, sf_dir):
    return U.merge_adjacent(chunks(spark, sf_dir, 8), ["file_path"]).select("file_path", "island", "content")


_GROUPS = """
grp AS (SELECT project_path, file_path, count(*) AS n, avg(score) * CASE WHEN bool_or(chunk_type = 'class_complete') THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN count(*) > 1 THEN 1 + 0.1::DOUBLE * least(count(*), 5) ELSE 1 END AS group_score FROM typed GROUP BY ALL)"""


@query("a4_group_scores", f"WITH {TYPED},{_GROUPS} SELECT project_path, file_path, n, round(group_score, 6) AS group_score FROM grp")
def a4(spark, sf_dir):
    return U.group_scores(typed_chunks(spark, sf_dir), ["project_path", "file_path"]).withColumn("group_score", F.round("group_score", 6))


@query(
    "a5_budget_allocation",
    f"""WITH {SEEDS},
    grp AS (SELECT project_path, file_path, avg(score) * CASE WHEN bool_or(chunk_type = 'class_complete') THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN count(*) > 1 THEN 1 + 0.1::DOUBLE * least(count(*), 5) ELSE 1 END AS g FROM seeds GROUP BY ALL),
    l AS (SELECT project_path, list({{'k': file_path, 'g': g, 'left': 0::BIGINT, 't': 0::BIGINT, 'out': ''}} ORDER BY g DESC, file_path) AS l, sum(g) AS total FROM grp GROUP BY project_path),
    r AS (SELECT project_path, list_reduce(list_prepend({{'k': '', 'g': 0::DOUBLE, 'left': 3900::BIGINT, 't': 0::BIGINT, 'out': ''}}, l), lambda a, x:
        CASE WHEN a.left > 0 THEN {{'k': x.k, 'g': x.g, 'left': a.left - greatest(200, least(CAST(floor(a.left * x.g / total) AS BIGINT), a.left)), 't': greatest(200, least(CAST(floor(a.left * x.g / total) AS BIGINT), a.left)),
            'out': a.out || x.k || '=' || greatest(200, least(CAST(floor(a.left * x.g / total) AS BIGINT), a.left)) || ';'}} ELSE a END).out AS given FROM l)
    SELECT project_path, given FROM r""",
)
def a5(spark, sf_dir):
    groups = U.group_scores(seed_rows(spark, sf_dir), ["project_path", "file_path"])
    given = U.allocate_budget(groups, "project_path", "file_path", 4000)
    text = F.array_sort(F.collect_list(F.struct("ord", F.concat("file_path", F.lit("="), "tokens", F.lit(";")).alias("t"))))
    return given.groupBy("project_path").agg(F.array_join(F.transform(text, lambda x: x["t"]), "").alias("given"))


@query("a6_best_group_only", f"WITH {TYPED},{_GROUPS} SELECT project_path, file_path FROM (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY group_score DESC, file_path) AS r FROM grp) WHERE r = 1")
def a6(spark, sf_dir):
    return U.first_by_id(U.group_scores(typed_chunks(spark, sf_dir), ["project_path", "file_path"]).withColumn("k", -F.col("group_score")), ["project_path"], ["k", "file_path"]).select("project_path", "file_path")


#: Characters of the leading lines (each with its end) that fit into the rest of a budget, and how many lines those are.
_PREFIX = "list_filter(range(1, len({ls}) + 1), lambda n: list_sum(list_transform({ls}[1:n], lambda y: length(y) + 1)) <= {room})"
_A7_FIT = _PREFIX.format(ls="string_split(x.c, chr(10))", room="(400 - a.used) * 4")
_A7_SIZE = f"CAST(coalesce(list_sum(list_transform(string_split(x.c, chr(10))[1:len({_A7_FIT})], lambda y: length(y) + 1)), 0) AS BIGINT)"


@query(
    "a7_group_context",
    f"""WITH {chunks_sql(8)},
    g AS (SELECT file_path, list({{'c': content, 't': CAST(greatest(1, length(content) // 4) AS BIGINT), 'used': 0::BIGINT, 'done': false, 'parts': []::VARCHAR[]}} ORDER BY ord) AS l FROM chunks GROUP BY file_path),
    r AS (SELECT file_path, list_reduce(list_prepend({{'c': '', 't': 0::BIGINT, 'used': 0::BIGINT, 'done': false, 'parts': []::VARCHAR[]}}, l), lambda a, x:
        CASE WHEN a.done THEN a
             WHEN a.used + x.t <= 400 THEN {{'c': x.c, 't': x.t, 'used': a.used + x.t, 'done': false, 'parts': list_append(a.parts, x.c)}}
             WHEN 400 - a.used >= 50 AND len({_A7_FIT}) > 0 THEN {{'c': x.c, 't': x.t, 'used': a.used + {_A7_SIZE} // 4, 'done': true, 'parts': list_append(a.parts, array_to_string(string_split(x.c, chr(10))[1:len({_A7_FIT})], chr(10)))}}
             ELSE {{'c': x.c, 't': x.t, 'used': a.used, 'done': true, 'parts': a.parts}} END) AS f FROM g)
    SELECT file_path, array_to_string(f.parts, chr(10) || chr(10)) AS context, f.used AS used FROM r""",
)
def a7(spark, sf_dir):
    return U.group_context(chunks(spark, sf_dir, 8), "file_path", 400)


@query("a8_assembled_context", f"WITH {FOUND} SELECT question, array_to_string(list('## ' || file_path || chr(10) || content ORDER BY ord), chr(10) || chr(10)) AS context FROM found GROUP BY question")
def a8(spark, sf_dir):
    part = F.struct("ord", F.concat(F.lit("## "), "file_path", F.lit("\n"), "content").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n")
    return found_texts(spark, sf_dir).groupBy("question").agg(joined.alias("context"))


@query("a10_prefix_packing", f"WITH {FOUND}, r AS (SELECT question, id, ord, CAST(sum(length(content)) OVER (PARTITION BY question ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM found) SELECT * FROM r WHERE running <= 8000")
def a10(spark, sf_dir):
    return U.prefix_packing(found_texts(spark, sf_dir), "question", 8000).select("question", "id", "ord", "running")


@query(
    "a11_greedy_packing",
    f"""WITH {FOUND},
    l AS (SELECT question, list({{'id': id, 't': greatest(1, length(content) // 4), 'used': 0::BIGINT, 'out': ''}} ORDER BY score * (1 + id % 3) DESC, ord) AS l FROM found GROUP BY question),
    r AS (SELECT question, list_reduce(list_prepend({{'id': 0::BIGINT, 't': 0::BIGINT, 'used': 0::BIGINT, 'out': ''}}, l), lambda a, x:
        CASE WHEN a.used + x.t <= 2000 THEN {{'id': x.id, 't': x.t, 'used': a.used + x.t, 'out': a.out || x.id || ','}} ELSE a END).out AS taken FROM l)
    SELECT question, taken FROM r""",
)
def a11(spark, sf_dir):
    items = found_texts(spark, sf_dir).select("question", "id", "ord", "content", F.col("score").alias("relevance"), (1 + F.col("id") % 3).cast("double").alias("importance"), F.lit("symbol").alias("kind"))
    packed = U.greedy_packing(items, "question", 2000)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: F.concat(x["id"].cast("string"), F.lit(",")))
    taken = packed.groupBy("question").agg(F.array_join(ids, "").alias("taken"))
    return items.select("question").distinct().join(taken, "question", "left").select("question", F.coalesce("taken", F.lit("")).alias("taken"))


_A11_FIT = _PREFIX.format(ls="x.ls", room="(2000 - a.used) * 4")
_A11_SIZE = f"CAST(coalesce(list_sum(list_transform(x.ls[1:len({_A11_FIT})], lambda y: length(y) + 1)), 0) AS BIGINT)"
_A11_NONE = "[]::STRUCT(id BIGINT, tokens BIGINT, truncated BOOLEAN)[]"


@query(
    "a11_greedy_packing_files",
    f"""WITH {FOUND},
    l AS (SELECT question, list({{'id': id, 't': CAST(greatest(1, length(content) // 4) AS BIGINT), 'ls': string_split(content, chr(10)), 'used': 0::BIGINT, 'done': false, 'taken': {_A11_NONE}}} ORDER BY score DESC, ord) AS l FROM found GROUP BY question),
    r AS (SELECT question, list_reduce(list_prepend({{'id': 0::BIGINT, 't': 0::BIGINT, 'ls': []::VARCHAR[], 'used': 0::BIGINT, 'done': false, 'taken': {_A11_NONE}}}, l), lambda a, x:
        CASE WHEN a.done THEN a
             WHEN a.used + x.t <= 2000 THEN {{'id': x.id, 't': x.t, 'ls': x.ls, 'used': a.used + x.t, 'done': false, 'taken': list_append(a.taken, {{'id': x.id, 'tokens': x.t, 'truncated': false}})}}
             WHEN a.used < 1800 AND {_A11_SIZE} > 0 THEN {{'id': x.id, 't': x.t, 'ls': x.ls, 'used': a.used + greatest(1, {_A11_SIZE} // 4), 'done': true, 'taken': list_append(a.taken, {{'id': x.id, 'tokens': greatest(1, {_A11_SIZE} // 4), 'truncated': true}})}}
             ELSE a END).taken AS taken FROM l),
    u AS (SELECT question, unnest(range(0, len(taken))) AS ord, unnest(taken) AS t FROM r)
    SELECT question, t.id AS id, ord, t.tokens AS tokens, t.truncated AS truncated FROM u""",
)
def a11_files(spark, sf_dir):
    items = found_texts(spark, sf_dir).select("question", "id", "ord", "content", F.col("score").alias("relevance"), F.lit(1.0).alias("importance"), F.lit("file").alias("kind"))
    return U.greedy_packing(items, "question", 2000)


@query("a12_ranked_context", f"WITH {FOUND} SELECT question, count(*) AS items, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS tokens, count(DISTINCT file_path) AS files, array_to_string(list_sort(list_distinct(list(file_path))), ',') AS names FROM found GROUP BY question")
def a12(spark, sf_dir):
    tokens = X.estimated_tokens(F.col("content"))
    return found_texts(spark, sf_dir).groupBy("question").agg(F.count("*").alias("items"), F.sum(tokens).alias("tokens"), F.countDistinct("file_path").alias("files"), F.array_join(F.array_sort(F.collect_set("file_path")), ",").alias("names"))


@query("a13_full_context", f"WITH {FILES}, r AS (SELECT project_path, file_path, CAST(sum(greatest(1, length(content) // 4)) OVER (PARTITION BY project_path ORDER BY length(content) DESC, file_path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM files) SELECT * FROM r WHERE running <= 8000")
def a13(spark, sf_dir):
    order = Window.partitionBy("project_path").orderBy(F.desc(F.length("content")), "file_path").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(X.estimated_tokens(F.col("content"))).over(order)
    return files(spark, sf_dir).withColumn("running", running).where("running <= 8000").select("project_path", "file_path", "running")


@query("a14_query_coverage", f"WITH {FOUND}, t AS (SELECT unnest(['the', 'und', 'license', 'que', 'zzz']) AS term) SELECT question, round(least(1.0::DOUBLE, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END)), 6) AS coverage FROM (SELECT question, term, bool_or(contains(lower(content), term)) AS hit FROM found, t GROUP BY question, term) GROUP BY question")
def a14(spark, sf_dir):
    terms = ["the", "und", "license", "que", "zzz"]
    low = F.lower("content")
    hits = found_texts(spark, sf_dir).groupBy("question").agg(*[F.bool_or(F.contains(low, F.lit(t))).cast("double").alias(f"h{k}") for k, t in enumerate(terms)])
    return hits.select("question", F.round(F.least(F.lit(1.0), sum(F.col(f"h{k}") for k in range(len(terms))) / len(terms)), 6).alias("coverage"))


@query("a15_context_summary", f"WITH {chunks_sql(8)} SELECT language, chunk_type, count(*) AS n, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines FROM chunks GROUP BY ALL ORDER BY n DESC, language LIMIT 5")
def a15(spark, sf_dir):
    return chunks(spark, sf_dir, 8).groupBy("language", "chunk_type").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines")).orderBy(F.desc("n"), "language").limit(5)


@query("a21_project_dump", f"WITH {FILES} SELECT project_path, file_path, md5('# ' || file_path || chr(10) || content) AS digest, CAST(sum(length(file_path) + length(content) + 4) OVER (PARTITION BY project_path ORDER BY file_path) - length(file_path) - length(content) - 4 AS BIGINT) AS starts_at FROM files")
def a21(spark, sf_dir):
    """The dump of a project as its files' parts in order, each with the place where it begins: no task holds a whole project."""
    part = F.concat(F.lit("# "), "file_path", F.lit("\n"), "content")
    size = F.length(part) + 1  # and the line end between parts
    rows = files(spark, sf_dir).select("project_path", "file_path", F.md5(part.cast("binary")).alias("digest"), size.alias("size"))
    before = F.sum("size").over(Window.partitionBy("project_path").orderBy("file_path"))
    return rows.select("project_path", "file_path", "digest", (before - F.col("size")).cast("long").alias("starts_at"))


def part_symbols(spark, sf_dir):
    words = F.posexplode(F.split("p_name", " ")).alias("pos", "symbol")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("file_path"), words).select("file_path", "symbol", (F.col("pos") + 1).alias("start_line"))


_PART_SYMBOLS = "syms AS (SELECT 'f' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS file_path, unnest(string_split(p_name, ' ')) AS symbol, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS start_line FROM part)"


@query("a22_symbol_to_file", f"WITH {_PART_SYMBOLS} SELECT symbol, max(file_path) AS last_file, count(*) AS n FROM syms GROUP BY symbol")
def a22(spark, sf_dir):
    return U.symbol_map(part_symbols(spark, sf_dir)).select("symbol", F.col("file_path").alias("last_file"), "n")


@query("a22_symbols_by_file", f"WITH {_PART_SYMBOLS} SELECT file_path, array_to_string(list(symbol ORDER BY start_line, symbol), ',') AS symbols FROM syms GROUP BY file_path")
def a22_files(spark, sf_dir):
    return U.symbols_by_file(part_symbols(spark, sf_dir)).select("file_path", F.array_join("symbols", ",").alias("symbols"))


@query("o1_top_by_score", f"WITH {chunks_sql(8)} SELECT id, round(score, 6) AS score FROM chunks ORDER BY chunks.score DESC, id LIMIT 25")
def o1(spark, sf_dir):
    return chunks(spark, sf_dir, 8).orderBy(F.desc("score"), "id").limit(25).select("id", F.round("score", 6).alias("score"))


@query("o2_relevance_times_importance", f"WITH {chunks_sql(8)} SELECT id, round(score * ln(1 + start_line), 6) AS rank_value FROM chunks ORDER BY score * ln(1 + start_line) DESC, id LIMIT 25")
def o2(spark, sf_dir):
    value = F.col("score") * F.ln(1 + F.col("start_line"))
    return chunks(spark, sf_dir, 8).withColumn("v", value).orderBy(F.desc("v"), "id").limit(25).select("id", F.round("v", 6).alias("rank_value"))


@query("o4_group_order", f"WITH {chunks_sql(8)} SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, start_line) AS by_score, row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS by_line FROM chunks")
def o4(spark, sf_dir):
    by = lambda *cols: F.row_number().over(Window.partitionBy("file_path").orderBy(*cols)).cast("long")
    return chunks(spark, sf_dir, 8).select("file_path", "id", by(F.desc("score"), "start_line").alias("by_score"), by("start_line").alias("by_line"))
