"""Queries over files, chunks and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions import text as X
from quarry.operators import chunking
from quarry.plans.base import FILES, QUESTIONS, chunks, chunks_sql, files, query, questions


@query("t9_line_windows", f"WITH {chunks_sql(50)} SELECT id, file_path, content, start_line, end_line, ord FROM chunks")
def t9(spark, sf_dir):
    return chunks(spark, sf_dir, 50).select("id", "file_path", "content", "start_line", "end_line", "ord")


@query(
    "t10_overlaps",
    f"""WITH {chunks_sql(8)},
    pair AS (SELECT file_path, ord, start_line, end_line, lead(start_line) OVER w AS s2, lead(end_line) OVER w AS e2
             FROM chunks WINDOW w AS (PARTITION BY file_path ORDER BY ord)),
    o AS (SELECT file_path, ord, greatest(start_line, end_line - CAST(floor(0.2::DOUBLE * (end_line - start_line)) AS BIGINT)) AS start_line,
                 least(e2, s2 + CAST(floor(0.2::DOUBLE * (e2 - s2)) AS BIGINT)) AS end_line FROM pair WHERE s2 IS NOT NULL)
    SELECT file_path, ord, o.start_line, o.end_line, 'overlap' AS chunk_type, array_to_string(string_split(content, chr(10))[o.start_line : o.end_line], chr(10)) AS content
    FROM o JOIN files USING (file_path) WHERE end_line > start_line""",
)
def t10(spark, sf_dir):
    return chunking.overlap_chunks(chunks(spark, sf_dir, 8), files(spark, sf_dir))


@query("t15_chunk_ids", f"WITH {chunks_sql(20)} SELECT md5(concat_ws('_', file_path, language, chunk_type, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR))) AS chunk_id, count(*) AS n FROM chunks GROUP BY 1")
def t15(spark, sf_dir):
    made = chunking.chunk_id(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("start_line"), F.col("end_line"))
    return chunks(spark, sf_dir, 20).groupBy(made.alias("chunk_id")).agg(F.count("*").alias("n"))


@query("t18_chunk_quality_filter", f"WITH {chunks_sql(8)} SELECT id, greatest(1, length(content) // 4) AS tokens FROM chunks WHERE greatest(1, length(content) // 4) >= 50")
def t18(spark, sf_dir):
    return chunks(spark, sf_dir, 8).select("id", X.estimated_tokens(F.col("content")).alias("tokens")).where("tokens >= 50")


@query("p2_estimated_tokens", f"WITH {FILES} SELECT file_path, greatest(1, length(content) // 4) AS tokens, length(content) // 4 AS tokens_raw FROM files")
def p2(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", X.estimated_tokens(F.col("content")).alias("tokens"), X.estimated_tokens(F.col("content"), False).alias("tokens_raw"))


_P13 = {k: " + ".join(f"CAST(regexp_matches(lower(query), '{Q.bounded(p)}') AS INTEGER)" for p in ps) for k, ps in Q.TYPE_PATTERNS.items()}
_WORDS = "list_filter(regexp_split_to_array(lower(query), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"
_NAMES = r"regexp_extract_all(query, '[\p{L}\p{N}_]+(?:\(\))?')"
_FIT = r"""list_filter({names}, lambda s: regexp_full_match(s, '(?:[A-Z][a-zA-Z0-9]*|[a-z_][a-z0-9_]*[a-z0-9]|[a-zA-Z_][a-zA-Z0-9_]*\(\))') AND length(s) > 2 AND NOT list_contains([{stops}], lower(s)))"""
_SYM = _FIT.format(names=_NAMES, stops=", ".join(f"'{w}'" for w in Q.NO_SYMBOLS))
_UNIQUE = "list_filter({x}, lambda s, i: list_position({x}, s) = i)"


@query(
    "p13_query_type",
    f"""WITH {QUESTIONS},
    scored AS (SELECT session_id, turn, query, {", ".join(f"{e} AS {k.lower()}" for k, e in _P13.items())}, len({_WORDS}) AS n_words, {_SYM} AS syms FROM questions),
    best AS (SELECT *, greatest({", ".join(k.lower() for k in _P13)}) AS best FROM scored)
    SELECT session_id, turn,
           CASE WHEN n_words <= 3 THEN 'SYMBOL_LOOKUP' WHEN best = 0 THEN 'IMPLEMENTATION' {" ".join(f"WHEN {k.lower()} = best THEN '{k}'" for k in _P13)} END AS query_type,
           round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN best > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(syms) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n_words <= 5 THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence
    FROM best""",
)
def p13(spark, sf_dir):
    q = F.col("query")
    return questions(spark, sf_dir).select("session_id", "turn", Q.query_type(q).alias("query_type"), F.round(Q.confidence(q), 6).alias("confidence"))


@query("p13_query_symbols", f"WITH {QUESTIONS}, s AS (SELECT session_id, turn, {_SYM} AS x FROM questions) SELECT session_id, turn, array_to_string({_UNIQUE.format(x='x')}, ',') AS symbols FROM s")
def p13_symbols(spark, sf_dir):
    return questions(spark, sf_dir).select("session_id", "turn", F.array_join(Q.symbols(F.col("query")), ",").alias("symbols"))


_HAS = lambda terms: "(" + " OR ".join(f"contains(lower(query), '{t}')" for t in terms) + ")"


@query(
    "p14_query_features",
    rf"""WITH {QUESTIONS}
    SELECT session_id, turn,
           concat_ws(',', {", ".join(f"CASE WHEN {_HAS(t)} THEN '{n}' END" for n, t in Q.ACTIONS.items())}) AS actions,
           array_to_string(regexp_extract_all(query, '\.([a-zA-Z0-9]+)', 1), ',') AS extensions,
           array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}_]+'), lambda s: regexp_full_match(s, '(?:[a-z][a-zA-Z0-9_]*[A-Z][a-zA-Z0-9_]*|[a-zA-Z][a-zA-Z0-9_]*_[a-zA-Z0-9_]+|[A-Z][a-zA-Z0-9_]*)')))), ',') AS symbols,
           length(query) AS n_chars
    FROM questions""",
)
def p14(spark, sf_dir):
    q = F.col("query")
    return questions(spark, sf_dir).select("session_id", "turn", F.array_join(Q.actions(q), ",").alias("actions"), F.array_join(Q.extensions(q), ",").alias("extensions"), F.array_join(Q.case_symbols(q), ",").alias("symbols"), F.length(q).cast("long").alias("n_chars"))


_KEPT = lambda stops, n: f"list_filter({_WORDS}, lambda w: length(w) > 3 AND NOT list_contains([{', '.join(repr(s) for s in stops)}], w))[1:{n}]"


#: A question's type as DuckDB SQL over the column ``query``.
TYPE_SQL = f"CASE WHEN len({_WORDS}) <= 3 THEN 'SYMBOL_LOOKUP' WHEN greatest({', '.join(_P13.values())}) = 0 THEN 'IMPLEMENTATION' {' '.join(f'WHEN {e} = greatest({chr(44).join(_P13.values())}) THEN {chr(39)}{k}{chr(39)}' for k, e in _P13.items())} END"
BROADER_SQL = f"""CASE {TYPE_SQL} WHEN 'IMPLEMENTATION' THEN flatten(list_transform({_KEPT(Q.BROADER_STOPS, 2)}, lambda w: [w || ' implementation', w || ' process']))
    WHEN 'USAGE_EXAMPLES' THEN flatten(list_transform({_KEPT(Q.BROADER_STOPS, 2)}, lambda w: ['using ' || w, w || ' example'])) ELSE [] END"""


@query("p15_broader_queries", f"WITH {QUESTIONS} SELECT session_id, turn, array_to_string({BROADER_SQL}, '; ') AS broader FROM questions")
def p15(spark, sf_dir):
    return questions(spark, sf_dir).select("session_id", "turn", F.array_join(Q.broader_queries(F.col("query")), "; ").alias("broader"))


@query(
    "p15_expansion_queries",
    f"""WITH {QUESTIONS}, k AS (SELECT session_id, turn, lower(query) AS low, {_KEPT(Q.EXPANSION_STOPS, 3)} AS kept FROM questions)
    SELECT session_id, turn, array_to_string(list_concat(flatten(list_transform(kept, lambda w: [w || ' implementation', w || ' usage'])),
        CASE WHEN len(kept) >= 2 THEN [kept[1] || ' ' || kept[2]] ELSE [] END,
        CASE WHEN contains(low, 'error') OR contains(low, 'bug') THEN ['error handling debugging'] ELSE [] END,
        CASE WHEN contains(low, 'test') THEN ['test cases examples'] ELSE [] END)[1:4], '; ') AS expansion FROM k""",
)
def p15_expansion(spark, sf_dir):
    return questions(spark, sf_dir).select("session_id", "turn", F.array_join(Q.expansion_queries(F.col("query")), "; ").alias("expansion"))


@query("p16_query_signature", f"WITH {QUESTIONS} SELECT session_id, turn, substring(md5(query || ':' || CAST(session_id AS VARCHAR)), 1, 16) AS signature FROM questions")
def p16(spark, sf_dir):
    return questions(spark, sf_dir).select("session_id", "turn", Q.signature(F.col("query"), F.col("session_id").cast("string")).alias("signature"))


@query("p17_numbered_lines", f"WITH {chunks_sql(20)} SELECT id, array_to_string(list_transform(string_split(content, chr(10)), lambda l, i: format('{{:4d}} | ', start_line + i - 1) || l), chr(10)) AS shown FROM chunks")
def p17(spark, sf_dir):
    return chunks(spark, sf_dir, 20).select("id", X.numbered(F.col("content"), F.col("start_line")).alias("shown"))


@query(
    "p20_path_parts",
    f"""WITH {FILES} SELECT file_path, string_split(file_path, '/')[-1] AS name, regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]*$', '') AS stem,
           array_to_string(string_split(file_path, '/')[:-2], '/') AS directory, project_path = 'src0' OR project_path IS NOT NULL AS near_main FROM files""",
)
def p20(spark, sf_dir):
    path = F.col("file_path")
    return files(spark, sf_dir).select("file_path", X.basename(path).alias("name"), X.stem(path).alias("stem"), F.array_join(X.directories(path), "/").alias("directory"), X.related_directories(path, F.concat(F.lit("src/"), F.col("project_path"), F.lit("/main.py"))).alias("near_main"))


@query(
    "p21_fuzzy_match",
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part), terms AS (SELECT unnest(['steel', 'gren', 'blue', 'ab']) AS term)
    SELECT name, term, length(term) >= 3 AND length(name) >= length(term) AND len(list_filter(range(1, greatest(length(name) - length(term) + 2, 2)),
        lambda p: len(list_filter(range(1, length(term) + 1), lambda k: substring(term, k, 1) <> substring(name, p + k - 1, 1))) <= 1)) > 0 AS fuzzy
    FROM names, terms""",
)
def p21(spark, sf_dir):
    from quarry.plans.base import table

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    named = names.withColumn("term", F.explode(F.array(*map(F.lit, ["steel", "gren", "blue", "ab"]))))
    return named.select("name", "term", X.fuzzy_contains(F.col("term"), F.col("name")).alias("fuzzy"))


@query(
    "p22_truncate_at_lines",
    f"""WITH {FILES}, l AS (SELECT file_path, content, string_split(content, chr(10)) AS ls FROM files),
    n AS (SELECT *, list_reduce(list_transform(ls, lambda x: {{'used': length(x) + 1, 'n': 0, 'open': true}}),
              lambda a, x: CASE WHEN a.open AND a.used + x.used <= 2000 THEN {{'used': a.used + x.used, 'n': a.n + 1, 'open': true}} ELSE {{'used': a.used, 'n': a.n, 'open': false}} END,
              {{'used': 0::BIGINT, 'n': 0, 'open': true}}).n AS keep FROM l)
    SELECT file_path, CASE WHEN length(content) <= 2000 THEN content ELSE array_to_string(ls[1:keep], chr(10)) || chr(10) || '# ... (truncated)' END AS content FROM n""",
)
def p22(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", X.truncate_at_lines(F.col("content"), 2000).alias("content"))


@query("p23_chunk_summary", f"WITH {chunks_sql(20)} SELECT id, array_to_string(list_filter(string_split(content, chr(10))[1:5], lambda x: trim(x) <> '')[1:3], chr(10)) AS summary FROM chunks")
def p23(spark, sf_dir):
    return chunks(spark, sf_dir, 20).select("id", X.summary_lines(F.col("content")).alias("summary"))


@query("p24_project_match", f"WITH {FILES} SELECT file_path, project_path = '' OR contains(project_path, 'src1') OR contains('src1', project_path) AS matches FROM files")
def p24(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", X.project_match(F.col("project_path"), F.lit("src1")).alias("matches"))


_LEVEL = "CASE o_orderkey % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'moderate' WHEN 2 THEN 'aggressive' ELSE 'other' END"


@query(
    "p25_expansion_parameters",
    f"""WITH o AS (SELECT o_orderkey, {_LEVEL} AS level, CAST(o_custkey * 20 + 100 AS BIGINT) AS tokens, CAST(o_orderkey % 30 + 1 AS BIGINT) AS top_k FROM orders)
    SELECT o_orderkey, CAST(CASE level WHEN 'conservative' THEN least(floor(tokens * 1.5::DOUBLE), 16000) WHEN 'aggressive' THEN least(tokens * 3, 32000) ELSE least(tokens * 2, 24000) END AS BIGINT) AS max_tokens,
           CAST(floor(top_k * CASE level WHEN 'conservative' THEN 1.5::DOUBLE WHEN 'aggressive' THEN 2.5::DOUBLE ELSE 2.0::DOUBLE END) AS BIGINT) AS top_k FROM o""",
)
def p25(spark, sf_dir):
    from quarry.plans.base import table

    key = F.col("o_orderkey")
    level = F.when(key % 4 == 0, "conservative").when(key % 4 == 1, "moderate").when(key % 4 == 2, "aggressive").otherwise("other")
    made = Q.expansion_columns((F.col("o_custkey") * 20 + 100).cast("long"), (key % 30 + 1).cast("long"), level)
    return table(spark, sf_dir, "orders").select("o_orderkey", made["max_tokens"].alias("max_tokens"), made["top_k"].alias("top_k"))


@query(
    "a16_chunk_quality",
    f"""WITH {chunks_sql(50)}, t AS (SELECT greatest(1, length(content) // 4) AS t FROM chunks),
    b AS (SELECT count(*) AS chunks, min(t) AS min_tokens, max(t) AS max_tokens, round(avg(t), 6) AS avg_tokens, round(var_pop(t), 4) AS variance, count_if(t < 50)::BIGINT AS tiny, count_if(t > 2000)::BIGINT AS huge FROM t)
    SELECT *, coalesce(tiny / nullif(chunks, 0), 0) > 0.10 AS tiny_issue,
           CAST(greatest(0, 100 - CASE WHEN coalesce(tiny / nullif(chunks, 0), 0) > 0.15 THEN 30 ELSE 0 END - CASE WHEN huge > 0 THEN 20 ELSE 0 END - CASE WHEN variance > 1000000 THEN 10 ELSE 0 END) AS BIGINT) AS score FROM b""",
)
def a16(spark, sf_dir):
    report = chunking.quality_report(chunks(spark, sf_dir, 50))
    return report.withColumn("avg_tokens", F.round("avg_tokens", 6)).withColumn("variance", F.round("variance", 4))


@query("a17_index_summary", f"WITH {chunks_sql(50)} SELECT language, count(DISTINCT file_path) AS files, count(*) AS chunks, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines FROM chunks GROUP BY language")
def a17(spark, sf_dir):
    return chunks(spark, sf_dir, 50).groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
