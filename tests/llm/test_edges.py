"""Every operator on odd rows (nulls, empties, repeats, very long texts, clashing columns) and on an empty table."""

import pytest

from quarry.llm import bpe, exact_dedup, fingerprint, html_extract, language_id, lm_score, near_dedup, packing, secret_scan, toxicity

from .conftest import ODD_ROWS


def labels(spark, docs):
    return docs.selectExpr("doc_id", "if(text like '%idiot%', 1, 0) as toxic")


def lm(docs):
    model, counts = lm_score.train(docs)
    return lm_score.score(docs, model, counts)


OPERATORS = {
    "language_id": lambda docs: language_id.predict(docs, language_id.train(docs)),
    "near_dedup": near_dedup.near_duplicates,
    "bpe": bpe.encode_decode,
    "fingerprint": fingerprint.edited_pairs,
    "fingerprints": fingerprint.fingerprints,
    "toxicity": lambda docs: toxicity.score(docs, toxicity.train(docs, labels(None, docs))),
    "lm_score": lm,
    "html": lambda docs: html_extract.extract(docs, "doc_id", "source", "text"),
    "secrets": secret_scan.scan,
    "redact": secret_scan.redact,
    "exact_dedup": exact_dedup.exact_groups,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_document(odd_docs, name):
    assert OPERATORS[name](odd_docs).count() == len(ODD_ROWS)


@pytest.mark.parametrize("name", [*sorted(OPERATORS), "packing"])
def test_empty_table(no_docs, name):
    run = packing.pack if name == "packing" else OPERATORS[name]
    assert run(no_docs).count() == 0


def test_packing_of_odd_rows(odd_docs):
    """Nulls and empties are one end id, repeats are packed for each row, a very long text whole."""
    from collections import Counter

    encode = packing.byte_ids(packing.default_path("byte_bpe_50k.json")).encode
    expected = Counter()
    for i, text in ODD_ROWS:
        expected[i] += len(encode(text or "")) // 4 + 1
    rows = packing.pack(odd_docs).collect()
    found = Counter()
    for r in rows:
        found[r["doc_id"]] += r["length"]
    assert found == expected
    assert all(r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2))
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_fingerprints_of_rows_without_id(odd_docs):
    rows = fingerprint.edited_pairs(odd_docs).collect()
    lost = next(r for r in rows if r["doc_id"] is None)
    text = "one two three"
    assert lost["near_next"] == pytest.approx(fingerprint.compare(*fingerprint.hex_digests(*fingerprint.bucket_codes([text.encode(), b""]))))
    last = next(r for r in rows if r["doc_id"] == 9)  # the first document follows the last
    import hashlib

    assert last["edited_sha256"] == hashlib.sha256(ODD_ROWS[-1][1][: last["n_chars"] - last["n_chars"] // 4].encode()).hexdigest()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, empty, tmp_path):
    """Every stage takes odd rows and none; null ids with a text that a named row has do not survive."""
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = (no_docs if empty else odd_docs).select(*columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(None, docs).write.parquet(str(tmp_path / "labels.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
    if empty:
        assert held.count() == 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    kept = {r["doc_id"] for r in held.collect()}
    assert None not in kept and {3, 4, 7, 8} <= kept and 5 not in kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_odd_results(odd_docs):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    lang = by(OPERATORS["language_id"](odd_docs))
    assert [lang[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    near = by(near_dedup.near_duplicates(odd_docs))
    assert [(near[i]["n_shingles"], near[i]["component_id"]) for i in (1, 2, 3, 4, 5, None)] == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 4), (1, 4)]
    exact = by(exact_dedup.exact_groups(odd_docs))
    assert exact[3]["keep_id"] == 3 and exact[1]["group_size"] == 3  # most code points of the empty texts
    assert exact[4]["group_size"] == 4 and exact[None]["keep_id"] == 4 and not exact[None]["kept"]
    spans = by(secret_scan.scan(odd_docs))
    assert [s["kind"] for s in spans[9]["spans"]] == ["assign"] and spans[1]["spans"] == []


def test_redact_keeps_all_columns(odd_docs):
    out = secret_scan.redact(odd_docs)
    assert out.columns == odd_docs.columns
    row = out.where("doc_id = 9").first()
    assert row["text"].startswith("[REDACTED]") and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 1").first()["text"] is None


def test_keep_clean_keeps_all_columns(odd_docs):
    model = toxicity.train(odd_docs, labels(None, odd_docs))
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
