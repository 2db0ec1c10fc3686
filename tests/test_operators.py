"""Operators whose folds are hard to see in SQL, on small hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import activity, fusion, graph, records, relations, vector


def test_vector_goldens(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    got = row.select(*(f(F.col("a"), F.col("b")) for f in (vector.dot, vector.euclidean, vector.manhattan, vector.cosine))).first()
    assert list(got) == pytest.approx([32.0, 5.196152, 9.0, 0.974632], abs=1e-6)


def test_batch_search_equals_single_search_and_skips_null_vectors(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 5)]) for i in range(1, 60)] + [(99, None), (98, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {(r["query_id"], r["ord"]): r["id"] for r in vector.batch_top_k(vectors, vectors.where("vec_id in (3, 4)"), 5, block=1).collect()}
    for q in (3, 4):
        single = [r["vec_id"] for r in vector.top_k(vectors, rows[q - 1][1], 5).collect()]
        assert [found[q, k] for k in range(1, 6)] == single
    assert vector.top_k(vectors, [1.0, 0.0, 0.0], 100).count() == 59


def test_post_filter_may_return_fewer(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)], i % 10) for i in range(30)], "vec_id long, embedding array<float>, label int")
    assert vector.post_filtered_top_k(vectors, [1.0, 0.0], 3, {"label": 9}).count() == 0
    assert vector.top_k(vectors, [1.0, 0.0], 3, filters={"label": 9}).count() == 3


def test_drop_alike_forgets_all_but_the_last_kept(spark):
    rows = [(1, k, k, f"line {k % 60}\nmore {k % 60}") for k in range(130)]
    kept = fusion.drop_alike(spark.createDataFrame(rows, "question int, ord long, id long, content string"))
    seen, out = [], []
    for _, _, k, c in rows:
        if not any(s == c for s in seen):
            seen, out = [*seen, c], [*out, k]
            seen = seen[-25:] if len(seen) > 50 else seen
    assert [r["id"] for r in kept.orderBy("ord").collect()] == out and len(out) > 60


def test_greedy_packing_skips_and_truncates_files(spark):
    items = [(1, "a", 0, "x" * 400, 1.0, 1.0, "symbol"), (1, "b", 1, "y" * 8000, 0.9, 1.0, "symbol"), (1, "c", 2, "z" * 40, 0.8, 1.0, "symbol"), (1, "d", 3, "\n".join(["w" * 39] * 100), 0.7, 1.0, "file"), (1, "e", 4, "v", 0.1, 1.0, "symbol")]
    packed = fusion.greedy_packing(spark.createDataFrame(items, "question int, id string, ord int, content string, relevance double, importance double, kind string"), "question", 300)
    assert [(r["id"], r["tokens"], r["truncated"]) for r in packed.orderBy("ord").collect()] == [("a", 100, False), ("c", 10, False), ("d", 190, True)]


def test_group_context_cuts_the_first_overflow(spark):
    rows = [(1, 0, "a" * 400), (1, 1, "\n".join(["b" * 9] * 100)), (1, 2, "c")]
    got = fusion.group_context(spark.createDataFrame(rows, "question int, ord int, content string"), "question", 200).first()
    assert got["used"] == 200 and got["context"].count("b" * 9) == 40 and "c" not in got["context"]


def test_budget_may_overdraw_once(spark):
    groups = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)], "q int, k string, group_score double")
    given = [(r["k"], r["tokens"]) for r in fusion.allocate_budget(groups, "q", "k", 450).orderBy("ord").collect()]
    assert given == [("a", 200), ("b", 200)]


def test_band_pairs_equal_all_pairs(spark):
    events = [(k % 5, f"f{k % 7}", k * 131 % 5000) for k in range(200)]
    frame = spark.createDataFrame(events, "s long, file_path string, t long").select("s", "file_path", F.timestamp_seconds("t").alias("ts"))
    expected = {(s, a, b) for s, a, t in events for r, b, u in events if s == r and a != b and abs(t - u) < 60}
    assert {(r["s"], r["a"], r["b"]) for r in relations.band_pairs(frame, 60, within=["s"]).collect()} == expected


def test_importance_and_paths_of_a_small_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    score, out = dict.fromkeys("abcde", 1.0), {"a": 2, "b": 1, "c": 1, "d": 1}
    for _ in range(10):
        score = {v: 0.15 + 0.85 * sum(score[s] / out[s] for s, d in [tuple(e) for e in edges.collect()] if d == v) for v in score}
    got = {r["key"]: r["importance"] for r in graph.importance(nodes, edges).collect()}
    assert got == pytest.approx(score)
    assert {r["key"]: r["path"] for r in graph.shortest_paths(edges, "a").collect()} == {"a": "a", "b": "a>b", "c": "a>c", "d": "a>b>d"}


def test_debounce_folds_bursts(spark):
    times = [0, 3, 6, 9, 30, 31, 37]
    frame = spark.createDataFrame([(1, t) for t in times], "s int, t int").select("s", F.timestamp_seconds("t").alias("ts"))
    assert sorted(r["ts"].timestamp() % 60 for r in activity.debounced(frame, "s", 5).collect()) == [0, 6, 30, 37]


def test_records(spark):
    row = spark.createDataFrame([("a@b.co", "4539 1488 0343 6467", "Crème & Brûlée!", "Ab1!")], "e string, c string, s string, p string")
    got = row.select(records.is_email(F.col("e")), records.luhn(F.col("c")), records.luhn(F.lit("")), records.slug(F.col("s")), records.password_strength(F.col("p"))).first()
    assert list(got) == [True, True, False, "cr-me-br-l-e", 4]
    with pytest.raises(ValueError):
        records.QueryBuilder().select("a").build()


def test_truncation_and_fuzzy(spark):
    row = spark.createDataFrame([("one\ntwo\nthree", "usr", "my_user", "my_usr2")], "c string, t string, a string, b string")
    got = row.select(X.truncate_at_lines(F.col("c"), 9), X.fuzzy_contains(F.col("t"), F.col("b")), X.fuzzy_contains(F.col("t"), F.lit("abc")), X.class_name(F.lit("x\nclass Foo(Bar):"))).first()
    assert list(got) == ["one\ntwo\n# ... (truncated)", True, False, "Foo"]


def test_batch_search_in_several_scans(spark):
    """Questions beyond one scan's bytes, number and text keys: the same results."""
    from quarry.operators import vector

    pick = np.random.default_rng(2)
    rows = [(i, f"k{i:03d}", [float(x) for x in pick.normal(size=6)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, name string, embedding array<float>").repartition(4)
    whole = {(r["query_id"], r["ord"]): r["id"] for r in vector.batch_top_k(vectors, vectors.where("vec_id % 3 = 0"), 4).collect()}
    cut = {(r["query_id"], r["ord"]): r["id"] for r in vector.batch_top_k(vectors, vectors.where("vec_id % 3 = 0"), 4, scan_bytes=500).collect()}
    named = {(int(r["query_id"][1:]), r["ord"]): int(r["id"][1:]) for r in vector.batch_top_k(vectors, vectors.where("vec_id % 3 = 0"), 4, key="name").collect()}
    assert len(whole) == 160 and whole == cut == named


def test_packed_context_against_a_plain_fold(spark):
    """Repeats dropped, neighbours merged, packed by score: the query's contexts, made again row by row."""
    import hashlib

    from quarry.operators import retrieval
    from quarry.plans import retrieval_plans as plans

    data = "/root/testdata/sf0.001"
    found = [r.asDict() for r in retrieval.retrieve(plans.asked_rows(spark, data), plans.chunk_rows(spark, data), plans.K).collect()]
    made = {r["question"]: r for r in plans.x4_answers(spark, data).collect()}
    assert set(made) == {r["question"] for r in found}
    for question in made:
        rows = sorted((r for r in found if r["question"] == question), key=lambda r: (-r["score"], r["id"]))
        kept = []
        for r in rows:
            same = any(k["content"].strip(" ") == r["content"].strip(" ") for k in kept)
            inside = any(k["file_path"] == r["file_path"] and k["start_line"] <= r["end_line"] and k["end_line"] >= r["start_line"] and r["end_line"] - r["start_line"] <= k["end_line"] - k["start_line"] for k in kept)
            if not same and not inside:
                kept.append(r)
        islands = []
        for path in sorted({r["file_path"] for r in kept}):
            for r in sorted((r for r in kept if r["file_path"] == path), key=lambda r: (r["start_line"], rows.index(r))):
                last = islands[-1] if islands and islands[-1]["file_path"] == path else None
                if last is None or r["start_line"] > last["end_line"] + 5:
                    islands.append({**r, "n": 1})
                    continue
                lines, shared = r["content"].split("\n"), last["end_line"] - r["start_line"] + 1
                if r["start_line"] <= last["end_line"] and 0 < shared < len(lines):
                    rest = "\n".join(lines[shared:])
                    last["content"] += "\n" + rest if rest.strip(" ") else ""
                elif r["start_line"] <= last["end_line"] + 2:
                    last["content"] += "\n" + r["content"]
                else:
                    last["content"] += "\n\n# ... (gap) ...\n\n" + r["content"]
                last |= {"end_line": max(last["end_line"], r["end_line"]), "score": max(last["score"], r["score"]), "n": last["n"] + 1}
        used, parts = 0, []
        for r in sorted(islands, key=lambda r: (-r["score"], r["file_path"], r["start_line"])):
            text = f"# {r['file_path']}:{r['start_line']}-{r['end_line']}\n{r['content']}"
            size = max(1, len(text) // 4)
            if used + size <= 4000:
                parts.append(text)
                used += size
                continue
            fit, n = 0, 0
            for line in text.split("\n"):
                if fit + len(line) + 1 > (4000 - used) * 4:
                    break
                fit, n = fit + len(line) + 1, n + 1
            if 4000 - used >= 50 and n:
                parts.append("\n".join(text.split("\n")[:n]))
                used += fit // 4
            break
        row = made[question]
        assert (row["tokens"], row["chunks"]) == (used, sum(r["n"] for r in islands))
        assert row["digest"] == hashlib.md5("\n\n".join(parts).encode()).hexdigest()


def test_line_ranges_meet_in_buckets(spark):
    """Parents and overlaps of long and short ranges, against all pairs."""
    from quarry.operators import relations

    pick = np.random.default_rng(7)
    rows = []
    for i in range(150):
        start = int(pick.integers(1, 900))
        rows.append((f"c{i:03d}", f"f{i % 3}", start, start + int(pick.choice([0, 3, 60, 64, 200, 500])), i))
    chunks = spark.createDataFrame(rows, "id string, file_path string, start_line long, end_line long, ord long")
    met = {(a, b) for a, f, s, e, _ in rows for b, g, t, u, _ in rows if a != b and f == g and s <= u and t <= e}
    assert {tuple(r) for r in relations.overlap_edges(chunks).collect()} == met
    held = {}
    for a, f, s, e, _ in rows:
        over = [(t, k, b) for b, g, t, u, k in rows if a != b and f == g and t <= s and u >= e]
        if over:
            held[a] = min(over)[2]
    assert {r["id"]: r["parent_id"] for r in relations.parents(chunks).collect()} == held


@pytest.mark.parametrize("options", [{}, {"limit": 1}])
def test_cuts_of_imports_are_never_broadcast(spark, tmp_path, options):
    """A small table of imports is many times as large once it is cut; no plan may send the cuts to all tasks."""
    texts = [None, "", "a", "import abc", "import \U0001d4d0bc", "xyzabc", "ab"]
    spark.createDataFrame([(f"f{i}", texts[i % len(texts)]) for i in range(40)], "file_path string, import_text string").write.parquet(f"{tmp_path}/imports")
    names = [("a", "f2"), ("abc", "f3"), ("\U0001d4d0b", "n"), ("", "n"), (None, "n"), ("abc", "n"), ("zz", "n")]
    spark.createDataFrame(names, "name string, file_path string").write.parquet(f"{tmp_path}/names")
    found = relations.symbol_references(spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/imports"), **options)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted((f"f{i}", n, d) for i in range(40) for n, d in names if n and n in (texts[i % len(texts)] or "") and d != f"f{i}")
    lines = [(line.find("- "), line) for line in found._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert any("Generate explode" in line for _, line in lines)
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[k + 1 : next((j for j in range(k + 1, len(lines)) if lines[j][0] <= depth), len(lines))]
            assert not any("Generate explode" in x for _, x in below)
