"""Queries that re-score results, walk the dependency graph and use activity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions import text as X
from quarry.operators import activity as A
from quarry.operators import graph as G
from quarry.operators import rerank as R
from quarry.plans.base import ACTIVITY, QUESTIONS, activity, query, questions, table
from quarry.plans.relation_plans import _EDGES, SEEDS, TYPED, nation_edges, seed_rows, typed_chunks
from quarry.plans.vector_plans import RESULTS, results

ASKED = "how does the class function work with der die"
_TERMS = ", ".join(f"'{w}'" for w in ASKED.split())


@query("r1_lexical_rerank", f"WITH {TYPED} SELECT id, round(score * CASE WHEN chunk_type = 'class_complete' THEN 1.2::DOUBLE ELSE 1 END * (1 + 0.1::DOUBLE * len(list_filter([{_TERMS}], lambda w: contains(lower(content), w)))), 6) AS score FROM typed")
def r1(spark, sf_dir):
    c = F.col
    return typed_chunks(spark, sf_dir).select("id", F.round(R.lexical(c("score"), F.lit(ASKED), c("chunk_type"), c("content")), 6).alias("score"))


@query(
    "r2_question_type_rerank",
    f"""WITH {TYPED}, k AS (SELECT unnest(['DEFINITION', 'IMPLEMENTATION', 'USAGE_EXAMPLES']) AS kind)
    SELECT kind, id, round(score * CASE kind WHEN 'DEFINITION' THEN CASE chunk_type WHEN 'class_complete' THEN 1.3::DOUBLE ELSE 1 END WHEN 'IMPLEMENTATION' THEN CASE chunk_type WHEN 'class_complete' THEN 1.1::DOUBLE ELSE 1 END
        ELSE CASE WHEN contains(lower(content), 'example') OR contains(lower(content), 'test') OR contains(lower(content), 'demo') OR contains(lower(content), 'sample') THEN 1.2::DOUBLE ELSE 1 END END
        * CASE WHEN contains(content, 'Die') OR contains(content, 'The') THEN 1.1::DOUBLE ELSE 1 END, 6) AS score FROM typed, k""",
)
def r2(spark, sf_dir):
    c = F.col
    kinds = typed_chunks(spark, sf_dir).withColumn("kind", F.explode(F.array(F.lit("DEFINITION"), F.lit("IMPLEMENTATION"), F.lit("USAGE_EXAMPLES"))))
    score = R.by_question_type(c("score"), c("kind"), F.array(F.lit("Die"), F.lit("The")), c("chunk_type"), c("content"), c("file_path"))
    return kinds.select("kind", "id", F.round(score, 6).alias("score"))


@query(
    "r3_exact_symbol_search",
    f"""WITH {TYPED}, s AS (SELECT unnest(['The', 'Die', 'Les']) AS symbol),
    h AS (SELECT symbol, id, score * CASE WHEN contains(content, 'class ' || symbol) OR contains(content, 'def ' || symbol) THEN 1.5::DOUBLE ELSE 1.2::DOUBLE END AS score FROM typed, s WHERE contains(content, symbol))
    SELECT symbol, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS n FROM h) WHERE n <= 5""",
)
def r3(spark, sf_dir):
    asked = typed_chunks(spark, sf_dir).withColumn("symbol", F.explode(F.array(F.lit("The"), F.lit("Die"), F.lit("Les"))))
    hits = asked.withColumn("score", R.exact_symbol(F.col("score"), F.col("symbol"), F.col("content"))).where("score is not null")
    return G.rank_within(hits, "symbol", [F.desc("score"), F.asc("id")], 5).select("symbol", "id", F.round("score", 6).alias("score"))


@query("r6_relevance_feedback", f"WITH {RESULTS} SELECT query_id, id, round(score * CASE WHEN id % 10 = 1 THEN 1.5::DOUBLE WHEN id % 5 = 1 THEN 0.5::DOUBLE ELSE 1 END, 6) AS score FROM results")
def r6(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    boosted = R.feedback(results(spark, sf_dir), ids.where("id % 10 = 1"), ids.where("id % 5 = 1"))
    return boosted.select("query_id", "id", F.round("score", 6).alias("score"))


_STATE = """
state AS (SELECT file_path, max(ts) FILTER (activity = 'edit') AS last_edited, max(ts) FILTER (activity = 'open') AS last_opened,
                 count(*) FILTER (activity = 'edit') AS edits FROM activity GROUP BY file_path),
clock AS (SELECT max(ts) AS now FROM activity)"""


@query(
    "r7_boost_factor",
    f"""WITH {ACTIVITY},{_STATE},
    h AS (SELECT file_path, edits, (epoch_us(now) - epoch_us(last_edited)) / 3600e6::DOUBLE AS eh, (epoch_us(now) - epoch_us(last_opened)) / 3600e6::DOUBLE AS oh FROM state, clock)
    SELECT file_path, round(CASE WHEN eh >= 0 AND eh < 24 THEN 1 + 0.5::DOUBLE * greatest(0.1::DOUBLE, 1 - eh / 24) ELSE 1 END
        * CASE WHEN oh < 2 THEN greatest(1.0::DOUBLE, 1.3::DOUBLE * (1 - oh / 2)) ELSE 1 END
        * CASE WHEN edits > 3 THEN least(1.2::DOUBLE, 1 + 0.05::DOUBLE * edits) ELSE 1 END
        * CASE WHEN contains('fix file_7 in src', replace(split_part(file_path, '/', 2), '.py', '')) THEN 1.3::DOUBLE ELSE 1 END
        * CASE WHEN contains('fix file_7 in src', 'src') OR contains('fix file_7 in src', split_part(file_path, '/', 2)) THEN 1.1::DOUBLE ELSE 1 END, 6) AS boost FROM h""",
)
def r7(spark, sf_dir):
    events = activity(spark, sf_dir)
    now = events.agg(F.max("ts").alias("now"))
    state = A.file_state(events, ["file_path"]).join(F.broadcast(now))
    hours = lambda c: (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / F.lit(3600e6)
    boost = R.edit_recency(hours("last_edited")) * R.open_recency(hours("last_opened")) * R.edit_frequency(F.col("edit_frequency")) * R.name_patterns(F.col("file_path"), F.lit("fix file_7 in src"))
    return state.select("file_path", F.round(boost, 6).alias("boost"))


@query("r8_clamped_boost", f"WITH {RESULTS} SELECT query_id, id, round(greatest(score * 0.5::DOUBLE, least(score * 3, score * (id % 9) * 0.6::DOUBLE)), 6) AS score FROM results")
def r8(spark, sf_dir):
    boost = F.col("id") % 9 * F.lit(0.6)
    return results(spark, sf_dir).select("query_id", "id", F.round(R.clamped(F.col("score"), boost), 6).alias("score"))


_NAMES = "names AS (SELECT 'part/' || split_part(p_name, ' ', 1) || '.py' AS file_path, p_name AS name, p_size / 10.0::DOUBLE AS importance FROM part)"
_FUZZY = "length(t) >= 3 AND length(n) >= length(t) AND len(list_filter(range(1, greatest(length(n) - length(t) + 2, 2)), lambda p: len(list_filter(range(1, length(t) + 1), lambda k: substring(t, k, 1) <> substring(n, p + k - 1, 1))) <= 1)) > 0"


@query(
    "r10_relevant_files",
    f"""WITH {_NAMES}, terms AS (SELECT unnest(['steel', 'gren', 'blue']) AS t),
    rel AS (SELECT name, sum(CASE WHEN n = t THEN 3 WHEN contains(n, t) THEN 2 WHEN {_FUZZY} THEN 1 ELSE 0 END) AS r FROM (SELECT DISTINCT name, lower(name) AS n FROM names) x, terms GROUP BY name),
    rel_rows AS (SELECT a.file_path, sum(r * a.importance) AS s, sum(0.5::DOUBLE * r) AS e FROM names a JOIN rel USING (name) GROUP BY 1),
    fn AS (SELECT f.file_path, sum(CASE WHEN split_part(f.file_path, '/', 2) = t OR replace(split_part(f.file_path, '/', 2), '.py', '') = t THEN 10 WHEN contains(split_part(f.file_path, '/', 2), t) THEN 3 ELSE 0 END) AS w FROM (SELECT DISTINCT file_path FROM names) f, terms GROUP BY 1)
    SELECT file_path, round(s + e + w, 4) AS score FROM rel_rows JOIN fn USING (file_path) WHERE s + e + w > 0 ORDER BY s + e + w DESC, file_path LIMIT 15""",
)
def r10(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat(F.lit("part/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".py")).alias("file_path"), F.col("p_name").alias("name"), (F.col("p_size") / F.lit(10.0)).alias("importance"))
    return G.relevant_files(names, names, names, ["steel", "gren", "blue"], 15).withColumn("score", F.round("score", 4))


@query("r11_symbol_relevance", f"WITH {_NAMES}, terms AS (SELECT unnest(['steel', 'gren', 'blue']) AS t) SELECT name, CAST(sum(CASE WHEN n = t THEN 3 WHEN contains(n, t) THEN 2 WHEN {_FUZZY} THEN 1 ELSE 0 END) AS DOUBLE) AS relevance FROM (SELECT DISTINCT name, lower(name) AS n FROM names) x, terms GROUP BY name")
def r11(spark, sf_dir):
    terms = F.array(F.lit("steel"), F.lit("gren"), F.lit("blue"))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select("name", R.symbol_relevance(F.col("name"), terms).alias("relevance"))


@query("r12_file_item_score", f"WITH {TYPED} SELECT id, round(score * CASE WHEN ends_with(file_path, '.txt') THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN contains(lower(content), 'model') OR contains(lower(content), 'data') THEN 1.3::DOUBLE ELSE 1 END, 6) AS score FROM typed")
def r12(spark, sf_dir):
    low = F.lower("content")
    score = F.col("score") * F.when(F.endswith("file_path", F.lit(".txt")), 1.5).otherwise(1.0) * F.when(Q.contains_any(low, ["model", "data"]), 1.3).otherwise(1.0)
    return typed_chunks(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


@query("r13_symbol_item_score", f"WITH {_NAMES} SELECT DISTINCT name, round(0.1::DOUBLE * importance + CASE WHEN name = 'steel' THEN 5 ELSE 0 END + CASE WHEN contains(name, 'steel') THEN 2 ELSE 0 END + CASE WHEN contains(lower(name), 'blue') THEN 1 ELSE 0 END, 6) * CASE WHEN starts_with(name, '_') THEN 1 ELSE 1.05::DOUBLE END AS score FROM names")
def r13(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_size") / F.lit(10.0)).alias("importance"))
    one = lambda cond, v: F.when(cond, v).otherwise(0)
    base = 0.1 * F.col("importance") + one(F.col("name") == "steel", 5) + one(F.contains("name", F.lit("steel")), 2) + one(F.contains(F.lower("name"), F.lit("blue")), 1)
    return part.select("name", (F.round(base, 6) * F.when(F.startswith("name", F.lit("_")), 1.0).otherwise(1.05)).alias("score")).distinct()


_DEPS = """
deps AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
         UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
keys AS (SELECT src AS key FROM deps UNION SELECT dst FROM deps),
outdeg AS (SELECT src, count(*) AS d FROM deps GROUP BY src)"""


def dependencies(spark, sf_dir):
    pair = lambda name, a, ka, b, kb: table(spark, sf_dir, name).select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"))
    edges = pair("customer", "c", "c_custkey", "n", "c_nationkey").union(pair("nation", "n", "n_nationkey", "r", "n_regionkey")).union(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).distinct()
    return edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct(), edges


_ROUNDS = ",\n".join(f"s{k} AS (SELECT keys.key, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(s{k - 1}.s / d), 0) AS s FROM keys LEFT JOIN deps ON deps.dst = keys.key LEFT JOIN outdeg ON outdeg.src = deps.src LEFT JOIN s{k - 1} ON s{k - 1}.key = deps.src GROUP BY keys.key)" for k in range(1, 11))


@query("g2_importance", f"WITH {_DEPS}, s0 AS (SELECT key, 1.0::DOUBLE AS s FROM keys), {_ROUNDS} SELECT key, round(s, 6) AS importance FROM s10")
def g2(spark, sf_dir):
    nodes, edges = dependencies(spark, sf_dir)
    return G.importance(nodes, edges).select("key", F.round("importance", 6).alias("importance"))


@query("g3_shortest_paths", f"WITH RECURSIVE {_DEPS}, w AS (SELECT 'c1' AS key, 0 AS distance, 'c1' AS path UNION ALL SELECT dst, distance + 1, path || '>' || dst FROM w JOIN deps ON src = w.key WHERE distance < 20) SELECT key, min(distance) AS distance, min(path) AS path FROM w GROUP BY key")
def g3(spark, sf_dir):
    return G.shortest_paths(dependencies(spark, sf_dir)[1], "c1")


@query("g1_graph_nodes", f"WITH {_DEPS} SELECT left(key, 1) AS kind, count(*) AS n FROM keys GROUP BY 1")
def g1(spark, sf_dir):
    return dependencies(spark, sf_dir)[0].groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("a18_graph_statistics", f"WITH {_DEPS} SELECT (SELECT count(*) FROM keys) AS nodes, (SELECT count(*) FROM keys WHERE key LIKE 'n%') AS files, (SELECT count(*) FROM keys WHERE key NOT LIKE 'n%') AS symbols, (SELECT count(*) FROM deps) AS dependencies, round((SELECT count(*) FROM deps) / (SELECT count(*) FROM keys), 6) AS average")
def a18(spark, sf_dir):
    nodes, edges = dependencies(spark, sf_dir)
    kinds = nodes.withColumn("kind", F.when(F.startswith("key", F.lit("n")), "file").otherwise("symbol"))
    return G.statistics(kinds, edges).withColumn("average", F.round("average", 6))


@query("a18_most_depended", f"WITH {_DEPS} SELECT dst, count(*) AS dependents FROM deps GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10")
def a18_top(spark, sf_dir):
    return G.most_depended(dependencies(spark, sf_dir)[1], 10)


@query("a19_files_by_importance", f"WITH {_EDGES}, d AS (SELECT src, count(*) * 1.0::DOUBLE AS importance FROM edges GROUP BY src) SELECT n_name, coalesce(importance, 1.0::DOUBLE) AS importance FROM nation LEFT JOIN d ON d.src = 'n' || n_nationkey")
def a19(spark, sf_dir):
    degree = nation_edges(spark, sf_dir).groupBy("src").agg(F.count("*").cast("double").alias("importance"))
    nation = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("n"), "n_nationkey").alias("src"))
    return nation.join(degree, "src", "left").select("n_name", F.coalesce("importance", F.lit(1.0)).alias("importance"))


@query("w3_file_state", f"WITH {ACTIVITY} SELECT session_id, file_path, max(ts) FILTER (activity = 'edit') AS last_edited, max(ts) FILTER (activity = 'open') AS last_opened, count(*) FILTER (activity = 'edit') AS edit_frequency, count(*) FILTER (activity = 'open') AS open_frequency, round(sum(time_spent) FILTER (activity = 'close'), 4) AS time_spent FROM activity GROUP BY ALL")
def w3(spark, sf_dir):
    return A.file_state(activity(spark, sf_dir), ["session_id", "file_path"]).withColumn("time_spent", F.round("time_spent", 4))


_RECENT = "rf AS (SELECT session_id, file_path, row_number() OVER (PARTITION BY session_id ORDER BY latest DESC) - 1 AS position FROM (SELECT session_id, file_path, max({'a': ts, 'b': event_id}) AS latest FROM activity GROUP BY ALL))"


@query("w3_recent_files", f"WITH {ACTIVITY}, {_RECENT} SELECT * FROM rf WHERE position < 10")
def w3_recent(spark, sf_dir):
    return A.recent_files(activity(spark, sf_dir))


@query("w4_query_history", f"WITH {QUESTIONS} SELECT session_id, turn, query FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM questions) WHERE n <= 20")
def w4(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return questions(spark, sf_dir).withColumn("_n", F.row_number().over(order)).where("_n <= 20").select("session_id", "turn", "query")


@query("w5_state_cleanup", f"WITH {ACTIVITY}, st AS (SELECT session_id, file_path, max(ts) FILTER (activity = 'edit') AS e, max(ts) FILTER (activity = 'open') AS o, count(*) FILTER (activity = 'edit') AS n FROM activity GROUP BY ALL), c AS (SELECT max(ts) - INTERVAL 10 DAYS AS cutoff FROM activity) SELECT session_id, file_path FROM st, c WHERE NOT (coalesce(e < cutoff, true) AND coalesce(o < cutoff, true) AND n = 0)")
def w5(spark, sf_dir):
    events = activity(spark, sf_dir)
    now = events.agg(F.max("ts").alias("now"))
    state = A.file_state(events, ["session_id", "file_path"]).join(F.broadcast(now))
    return A.clean_up(state, F.col("now"), 10).select("session_id", "file_path")


@query("w6_bounded_log", f"WITH {ACTIVITY} SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM activity) WHERE n <= 25")
def w6(spark, sf_dir):
    return A.newest(activity(spark, sf_dir), "session_id", 25).select("session_id", "event_id")


@query(
    "w1_debounced_triggers",
    """WITH RECURSIVE e AS (SELECT user_id AS session_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM (SELECT DISTINCT user_id, ts FROM events)),
    w AS (SELECT session_id, n, ts, ts AS last, true AS fired FROM e WHERE n = 1
          UNION ALL SELECT e.session_id, e.n, e.ts, CASE WHEN epoch_us(e.ts) - epoch_us(w.last) > 86400000000 THEN e.ts ELSE w.last END, epoch_us(e.ts) - epoch_us(w.last) > 86400000000 FROM w JOIN e ON e.session_id = w.session_id AND e.n = w.n + 1)
    SELECT session_id, ts FROM w WHERE fired""",
)
def w1(spark, sf_dir):
    return A.debounced(activity(spark, sf_dir), "session_id", 86_400)


@query("w2_session_turns", f"WITH {ACTIVITY} SELECT session_id, event_id, row_number() OVER w AS turn, lag(event_id) OVER w AS previous_event FROM activity WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)")
def w2(spark, sf_dir):
    return A.session_counts(activity(spark, sf_dir)).select("session_id", "event_id", "turn", "previous_event")


@query("w2_evict_oldest", f"WITH {ACTIVITY}, s AS (SELECT session_id, max(ts) AS ts FROM activity GROUP BY session_id) SELECT session_id FROM s WHERE (SELECT count(*) FROM s) < 100 OR session_id NOT IN (SELECT session_id FROM s ORDER BY ts, session_id LIMIT 20)")
def w2_evict(spark, sf_dir):
    sessions = activity(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("ts"))
    return A.evict_oldest(sessions, 100).select("session_id")


@query("a20_most_edited", f"WITH {ACTIVITY} SELECT file_path, count(*) FILTER (activity = 'edit') AS edits FROM activity GROUP BY file_path ORDER BY 2 DESC, 1 LIMIT 10")
def a20(spark, sf_dir):
    return A.file_state(activity(spark, sf_dir), ["file_path"]).select("file_path", F.col("edit_frequency").alias("edits")).orderBy(F.desc("edits"), "file_path").limit(10)


@query("p12_question_flags", f"WITH {QUESTIONS} SELECT session_id, turn, contains(lower(query), 'function') OR contains(lower(query), 'class') AS is_code, regexp_matches(query, '[a-z][A-Z]') AS camel, contains(query, '_') AS snake, len(list_filter(regexp_split_to_array(lower(query), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) <= 3 AS short FROM questions")
def p12(spark, sf_dir):
    q = F.col("query")
    return questions(spark, sf_dir).select("session_id", "turn", Q.contains_any(F.lower(q), ["function", "class"]).alias("is_code"), q.rlike("[a-z][A-Z]").alias("camel"), F.contains(q, F.lit("_")).alias("snake"), (F.size(X.words(q)) <= 3).alias("short"))
