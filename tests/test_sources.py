"""Files, the chunk table, the engine end to end, and streaming state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.sources.chunk_table import ChunkTable, coerced
from quarry.sources.files import common_directory, language, read_files
from quarry.streaming.activity_stream import debounce_stream, session_cache_stream


@pytest.fixture()
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "auth.py").write_text("import hashlib\n\n\nclass Auth:\n    def login(self, user):\n        return hashlib.sha256(user)\n")
    (tmp_path / "src" / "util.js").write_text("export function retry(f) {\n  return f();\n}\n")
    (tmp_path / "src" / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "notes.bin").write_bytes(b"\0")
    return str(tmp_path)


def test_read_files(spark, project):
    found = {r["file_path"].rsplit("/", 1)[-1]: r["content"] for r in read_files(spark, project).collect()}
    assert set(found) == {"auth.py", "util.js", "bad.py"} and found["bad.py"] == "x = ''\n"
    assert common_directory(read_files(spark, project)).endswith("/src")
    assert {r[0] for r in read_files(spark, project).select(language(F.col("file_path"))).collect()} == {"py", "js"}


def rows(spark, values):
    return coerced(spark.createDataFrame([(i, p, [float(v)] if v else None) for i, p, v in values], "id string, project_path string, embedding array<float>"))


def test_chunk_table(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    assert table.info()["count"] == 0 and not table.exists()
    assert table.upsert(rows(spark, [("a", "p", 1), ("b", "q", 2)]))
    assert not table.upsert(rows(spark, [("c", "p", 0)]))
    table.upsert(rows(spark, [("a", "p", 3), ("d", "p", 4)]))
    assert {r["id"]: r["embedding"] for r in table.read().collect()} == {"a": [3.0], "b": [2.0], "d": [4.0]}
    table.delete(spark.createDataFrame([("d",)], "id string"))
    assert table.delete(spark.createDataFrame([], "id string"))
    table.delete_project("q")
    assert [r["id"] for r in table.read().collect()] == ["a"]
    assert table.info() == {"count": 1, "dimension": 1, "path": table.path} and table.health()["status"] == "healthy"
    table.clear()
    assert table.info()["count"] == 0


def test_chunk_table_touches_only_its_projects(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    table.write(rows(spark, [(f"i{k}", f"p{k % 3}", k + 1) for k in range(9)]))
    first = table._parts()[0]["folder"]
    early = table.read()
    table.upsert(rows(spark, [("i0", "p0", 50), ("new", "p0", 60)]))
    parts = table._parts()
    assert [p["folder"] == first for p in parts] == [True, False] and parts[0]["projects"] == ["p1", "p2"] and parts[1]["projects"] == ["p0"]
    table.delete_project("p1")
    table.upsert(rows(spark, [("i2", "p0", 70)]))  # moves from p2 to p0
    assert {r["id"]: (r["project_path"], r["embedding"][0]) for r in table.read().collect()} == {"i0": ("p0", 50.0), "i3": ("p0", 4.0), "i6": ("p0", 7.0), "new": ("p0", 60.0), "i2": ("p0", 70.0), "i5": ("p2", 6.0), "i8": ("p2", 9.0)}
    assert early.count() == 9 and table.projects() == ["p0", "p2"]
    assert [r["id"] for r in table.read(["p2"]).orderBy("id").collect()] == ["i5", "i8"]
    for k in range(60):
        table.replace(["p2"], rows(spark, [(f"r{k}", "p2", 1)])) if k % 20 == 0 else table._commit(table._parts())
    assert len(table._manifests()) == table.keep and table.read(["p2"]).count() == 1


def test_chunk_table_of_many_writes_and_odd_names(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    table.create()
    assert table.exists() and table.read().count() == 0
    for k in range(28):  # more than are kept apart
        table.upsert(rows(spark, [(f"i{k}", f"p {k}/é='x'" if k % 3 else "", k + 1)]))
    assert table.read().count() == 28 and "" in table.projects() and len(table._parts()) < 28


def test_replaced_files_leave_no_old_chunks(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    make = lambda values: coerced(spark.createDataFrame([(i, f, p, [1.0]) for i, f, p in values], "id string, file_path string, project_path string, embedding array<float>"))
    table.replace_files(make([("a1", "a.py", "p"), ("a2", "a.py", "p"), ("b1", "b.py", "p"), ("c1", "c.py", "q")]))
    table.replace_files(make([("a3", "a.py", "p")]))
    assert {r["id"] for r in table.read().collect()} == {"a3", "b1", "c1"}
    table.replace_files(make([("a3", "a.py", "p")]))
    assert table.read().count() == 3


def test_engine(spark, project, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    counts = engine.index(project)
    assert counts["files"] == 3 and counts["chunks"] == counts["embedded"]
    row = engine.query("How does the login of Auth work?", project, top_k=3).first()
    assert "class Auth" in row["context"] and row["tokens"] <= 8000
    assert "class Auth" in engine.query("login", project, expand=True, level="moderate").first()["context"]
    assert engine.context(project, "retry").count() == 1
    fused = engine.multi_stage("How does the login of Auth work?", project, 3).collect()
    assert fused and fused[0]["sightings"] >= 1
    state = spark.createDataFrame([(project + "/src/util.js", datetime(2024, 1, 2), None, 9)], "file_path string, last_edited timestamp, last_opened timestamp, edit_frequency int")
    assert engine.boosted("retry", state, datetime(2024, 1, 2, 1), project, 2).first()["file_path"].endswith("util.js")


def test_records_and_config(spark, tmp_path):
    from quarry.config import Config
    from quarry.functions.tokens import with_token_counts
    from quarry.sources import records_io

    frame = spark.createDataFrame([("a", 'x "y", z', None), ("b", "line\nbreak", "1")], "k string, v string, n string")
    records_io.write_csv(frame, str(tmp_path / "csv"))
    assert records_io.read_csv(spark, str(tmp_path / "csv")).orderBy("k").first()["v"] == 'x "y", z'
    records_io.backup(frame, str(tmp_path / "json"))
    assert sorted(map(tuple, records_io.restore(spark, str(tmp_path / "json"), "k string, v string, n string").collect())) == sorted(map(tuple, frame.collect()))
    assert records_io.read_state(spark, str(tmp_path / "none"), "k string").count() == 0
    config = Config.preset("thorough")
    config.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == config and config.retrieval.top_k == 20
    with pytest.raises(ValueError):
        Config.of({"vectors": {"metric": "none"}})
    tokenizers = pytest.importorskip("public_tokenizers")
    counted = with_token_counts(frame, "v", tokenizers.path("byte_bpe_50k.json"))
    assert all(r["tokens"] > 0 for r in counted.collect())


def test_tokens_are_counted_in_bounded_steps(spark, monkeypatch):
    """Long texts and many texts are encoded little by little, with the counts of whole texts."""
    from quarry.functions import tokens

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    whole, pick, steps = tokens._tokenizer(path), random.Random(5), []
    parts = ["a", "word", "don't", "'s", "7", "+=", " ", "  ", "\n", "\t ", "\u00a0", "\u3000", "é", "語", "\U0001f600", "<|endoftext|>", "_", "\x1c"]
    texts = [None, "", " ", "x" * 900, " " * 900] + ["".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(pick.randrange(300))) for _ in range(150)]

    class Watched:
        def encode_batch_fast(self, held, **options):
            steps.append(held)
            return whole.encode_batch_fast(held, **options)

    monkeypatch.setattr(tokens, "_tokenizer", lambda _: Watched())
    expected = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for limit in (1, 20, 300):
        steps.clear()
        assert tokens.count_tokens(texts, path, limit) == expected
        assert all(len(held) == 1 or sum(map(len, held)) <= limit for held in steps)
    steps.clear()
    assert tokens.count_tokens(["many words " * 1000] * 3, path, 500) == [len(whole.encode("many words " * 1000, add_special_tokens=False).ids)] * 3
    assert len(steps) > 60 and max(sum(map(len, held)) for held in steps) < 520
    monkeypatch.setattr(tokens, "_cuts_at_spaces", lambda _: False)
    assert tokens.count_tokens(texts, path, 20) == expected

    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    tokens.with_token_counts(spark.createDataFrame([("a",)], "v string"), "v", path)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_debounce_and_sessions(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, start + timedelta(seconds=s)) for s in (0, 2, 6, 8, 20)], "session_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = debounce_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 5)
    query = stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["ts"] - start).total_seconds() for r in spark.table("fired").collect()) == [0.0, 6.0, 20.0]

    asked = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "session_id long, turn long, query string")
    asked.write.parquet(str(tmp_path / "q"))
    query = session_cache_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "q"))).writeStream.outputMode("update").format("memory").queryName("cache").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["session_id"], r["turns"], r["last_query"], r["previous_query"]) for r in spark.table("cache").collect()} == {(1, 2, "b", "a"), (2, 1, "c", None)}
