"""BPE, packing, fingerprints, secrets, exact dedup and language against plain versions."""

import hashlib
import random
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries
from quarry.llm.bpe import WordBpe, default_path, merge_symbols
from quarry.llm.fingerprint import bucket_codes, compare, hex_digests
from quarry.llm.language_id import codewords, fit, gram_features
from quarry.llm.packing import Packer, StepGroups, byte_ids, pack
from quarry.llm.secret_scan import all_spans, base_spans, redact_text

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
#: Any code point, assigned or not.
ALPHABET = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("ab \n\t'sl.1é²Σ"))), max_size=60)


@pytest.fixture(scope="module")
def word():
    return WordBpe(WORD), tokenizers.Tokenizer.from_file(WORD)


def test_bpe_on_all_documents(word, texts):
    own, reference = word
    for text in texts.values():
        ids = reference.encode(text, add_special_tokens=False).ids
        assert array("I", own.encode(text)).tolist() == ids
        assert own.decode(own.encode(text)).decode() == reference.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_bpe_on_any_text(text):
    own, reference = test_bpe_on_any_text.pair
    for x in (text, text + "<|endoftext|>" + text):
        assert array("I", own.encode(x)).tolist() == reference.encode(x, add_special_tokens=False).ids


test_bpe_on_any_text.pair = (WordBpe(WORD), tokenizers.Tokenizer.from_file(WORD))


def test_bpe_of_every_code_point(word):
    own, reference = word
    texts = [f"a{chr(c)}1 {chr(c)}B x" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(texts), 100_000):
        part = texts[start : start + 100_000]
        for text, encoding in zip(part, reference.encode_batch(part, add_special_tokens=False), strict=True):
            assert array("I", own.encode(text)).tolist() == encoding.ids, hex(ord(text[1]))


def test_bpe_of_marks_and_compositions(word):
    """Canonical ordering and composition are those of the library, whose tables are older than Python's."""
    own, reference = word
    pick = random.Random(3)
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
    texts = ["".join(pick.choice(marks) if pick.random() < 0.6 else pick.choice("aA eé1Σ") for _ in range(8)) for _ in range(20_000)]
    texts += [unicodedata.normalize("NFD", t) for t in texts]
    for text, encoding in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert array("I", own.encode(text)).tolist() == encoding.ids, text


def test_merging_skips_stale_pairs():
    merges = {(1, 2): (0, 3), (2, 1): (1, 4), (3, 3): (2, 5)}
    assert merge_symbols([1, 2, 1, 2, 1], merges) == [5, 1]
    assert merge_symbols([], merges) == [] and merge_symbols([2], merges) == [2]


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_byte_ids_on_any_text(text):
    reference = test_byte_ids_on_any_text.reference
    for x in (text, text + "<|endoftext|>  " + text):
        assert array("I", byte_ids(BYTE).encode(x)).tolist() == reference.encode(x, add_special_tokens=False).ids


test_byte_ids_on_any_text.reference = tokenizers.Tokenizer.from_file(BYTE)


def test_packing_places_every_id_once(spark, data, texts):
    reference = tokenizers.Tokenizer.from_file(BYTE)
    ids = {i: np.array([*e.ids, 1], np.uint32) for i, e in zip(texts, reference.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    rows = queries.op4_packing(spark, data).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at == pieces[0]["sequence_tokens"]
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(2048, 20000))
def test_packer_never_pads(sizes, buffer):
    packer, sequences = Packer(buffer_tokens=buffer), []
    for k, n in enumerate(sizes):
        sequences += packer.add(k, array("I", range(n)).tobytes())
    sequences += packer.finish()
    assert sum(len(p[2]) // 4 for _, pieces in sequences for p in pieces) == sum(sizes)
    assert all(sum(len(p[2]) // 4 for p in pieces) == size and size & (size - 1) == 0 and size <= 2048 for size, pieces in sequences)


def test_step_groups_hold_equal_tokens(spark, data):
    """Exactly equal, but for the last group of each partition."""
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(3, "doc_id")
    groups = {}
    for r in pack(docs, group_tokens=4096).collect():
        groups[r["step_group"]] = groups.get(r["step_group"], 0) + r["length"]
    last = {max(g for g in groups if g >> 33 == part) for part in {g >> 33 for g in groups}}
    assert len(last) == 3 and len(groups) > 12
    assert all(n == 4096 for g, n in groups.items() if g not in last) and all(0 < groups[g] <= 4096 for g in last)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 64, 256, 512, 1024, 2048]), max_size=80))
def test_step_groups_of_any_sequences(sizes):
    balance, groups = StepGroups(4096), []
    for k, size in enumerate(sizes):
        groups += balance.add(size, (size, k))
    early = len(groups)
    groups += balance.finish()
    assert [g for g, _ in groups] == list(range(len(groups)))
    assert sorted(x for _, g in groups for x in g) == sorted((n, k) for k, n in enumerate(sizes))
    assert all(sum(n for n, _ in g) == 4096 for _, g in groups[:-1])
    assert all(len({n for n, _ in g}) == 1 for _, g in groups[:early])


def plain_digest(text):
    data = text.encode()
    data = data if not 0 < len(data) < 3 else data.ljust(3, b"\0")
    from quarry.llm import fingerprint as fp

    counts = [0] * 256
    for shape, tables in zip(fp.SHAPES, fp._TABLES, strict=True):
        for k in range(len(data) - shape[-1]):
            counts[tables[0][data[k]] ^ tables[1][data[k + shape[1]]] ^ tables[2][data[k + shape[2]]]] += 1
    ordered = sorted(counts)
    return [sum(c > ordered[q * 64 - 1] for q in (1, 2, 3)) for c in counts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_bucket_codes_match_plain_counts(texts):
    codes, _ = bucket_codes([t.encode() for t in texts])
    assert codes.tolist() == [plain_digest(t) for t in texts]


def test_edited_pairs_match_plain_edits(spark, data, texts):
    order = sorted(texts)
    rows = {r["doc_id"]: r for r in queries.op5_fingerprint(spark, data).collect()}
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(text)
        own, changed, other = (hex_digests(*bucket_codes([t.encode()]))[0] for t in (text, edited, after))
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (own, changed)
        assert rows[i]["near_edited"] == pytest.approx(compare(own, changed)) and rows[i]["near_next"] == pytest.approx(compare(own, other))
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.95


def plain_base(text):
    out = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_secrets_match_plain_patterns(spark, data, texts):
    rows = {r["doc_id"]: r for r in queries.op9_secret_scan(spark, data).collect()}
    for i, text in texts.items():
        spans = plain_base(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(rows[i]["spans"].split(","))


def test_secrets_on_random_texts():
    pick = random.Random(5)
    parts = ["token", "API_KEY", "ſecret", "secret", "=", ":", " ", '"', "AKIA", "ABCDEFGH", "0123456789", "abcdef", "é", "paſſword", "passwd", "-", "\n", "K"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert base_spans(text) == plain_base(text), text


def test_weak_parts_need_a_complement():
    near = "user = alice.b\npwd = hunter22\nhost = db.example.com"
    assert [k for _, _, k in all_spans(near, 120)[1]] == ["weak_identifier", "weak_secret", "weak_endpoint"]
    assert all_spans("user = alice.b and host = db.example.com", 120)[1] == []
    assert all_spans("user = alice.b" + " x" * 400 + "pwd = hunter22", 120)[1] == []
    assert redact_text("pwd = hunter22") == "pwd = hunter22"
    assert redact_text(near) == "[REDACTED]\n[REDACTED]\n[REDACTED]"


def test_weak_parts_that_contain_their_complement():
    text = "mysql://db1.internal/app?pwd=hunter2xyz"
    assert all_spans(text, 120)[1] == [(0, 39, "weak_endpoint"), (25, 39, "weak_secret")]
    assert redact_text(f"see {text} now") == "see [REDACTED] now"


def test_linked_parts_match_all_pairs():
    from quarry.llm.secret_scan import _WEAK, ROLES, SECRET

    pick = random.Random(8)
    pieces = ["mysql://db1.internal/app?", "pwd=hunter2xyz", "user=alice.b", "host: db.example.com", "AKIA" + "A1" * 8, "0123456789abcdef", "&", " ", "\n", " word" * 3]
    for _ in range(2000):
        text, scope = "".join(pick.choice(pieces) for _ in range(pick.randint(1, 9))), pick.choice([0, 3, 120])
        base = base_spans(text)
        weak = [(m.start(), m.end(), kind) for kind, _, pattern in _WEAK for m in pattern.finditer(text)]
        meets = lambda p, q: (ROLES[p[2]] == SECRET) != (ROLES[q[2]] == SECRET) and p[0] - q[1] <= 2 * scope and q[0] - p[1] <= 2 * scope  # noqa: E731, B023
        kept = [p for p in weak if any(meets(p, q) for q in [*base, *weak]) and not any(s < p[1] and p[0] < e for s, e, _ in base)]
        assert sorted(all_spans(text, scope)[1]) == sorted([*base, *kept]), text


def test_exact_groups_match_plain_groups(spark, data, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    rows = {r["doc_id"]: r for r in queries.op10_exact_dedup(spark, data).collect()}
    for bare, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i]), i))
        for i in ids:
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"], rows[i]["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(bare.encode()).hexdigest())


def test_runs_merge_over_several_rounds(spark):
    """70 partitions in rounds of two; copies of a text lie in all of them."""
    from quarry.llm.exact_dedup import exact_groups, merge_runs, digest_rows

    docs = spark.createDataFrame([(i, f" t{i % 9}" + " " * (i % 4)) for i in range(700)], "doc_id long, text string").repartition(70)
    merged = merge_runs(digest_rows(docs), fan_in=2, shard_rows=3).collect()
    assert len(merged) == 9 and sum(r["group_size"] for r in merged) == 700
    for r in exact_groups(docs).collect():
        same = [i for i in range(700) if i % 9 == r["doc_id"] % 9]
        assert r["keep_id"] == min(same, key=lambda i: (-(i % 4), i)) and r["group_size"] == len(same)


def test_language_held_out_accuracy(spark, data):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def plain_grams(text):
    """Hashed n-grams of one text, code point by code point."""
    from quarry.llm.language_id import BUCKET_BITS

    kept = []
    for c in text:
        low = c.lower() if c.isalpha() else " "
        point = ord(low) if len(low) == 1 else ord(c)
        if point != 32 or kept and kept[-1] != 32:
            kept.append(point)
    out, mask = [], 0xFFFFFFFF
    for k, c in enumerate(kept):
        b, a = (kept[k - 1] if k else 32), (kept[k - 2] if k > 1 else 32)
        one = c * 0x9E3779B1 & mask
        two = (one ^ (b * 0x85EBCA77 & mask)) * 0xC2B2AE3D & mask
        three = (two ^ (a * 0x27D4EB2F & mask)) * 0x165667B1 & mask
        out += [(one * 0x2545F491 & mask) >> 32 - BUCKET_BITS, two >> 32 - BUCKET_BITS, three >> 32 - BUCKET_BITS]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("abÄé 1."))), max_size=30), min_size=1, max_size=5))
def test_language_features_match_plain_grams(texts):
    grams, at, letters = gram_features(texts)
    assert [grams[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain_grams(t) for t in texts]
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_language_predictions_match_plain_decoding(spark, data, texts):
    """Margins, loss-weighted decoding and flags of the query, text by text."""
    import math

    from quarry.llm import language_id
    from quarry.llm.common import crc_remainder

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.train(docs.where(crc_remainder("doc_id", 4) != 2))
    rows = {r["doc_id"]: r for r in queries.op1_language_id(spark, data).collect()}
    for i, text in texts.items():
        grams = plain_grams(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
            continue
        margin = [sum(float(model.weights[g, b]) for g in grams) / (len(grams) + language_id.SHRINK) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margin, word, strict=True)) for word in model.code]
        odds = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        assert rows[i]["lang_pred"] == model.languages[best] and rows[i]["score"] == pytest.approx(odds[best] / sum(odds), rel=1e-3)
        second = sorted(odds)[-2] / sum(odds)
        assert rows[i]["ambiguous"] == (odds[best] / sum(odds) - second < 0.2)


def test_language_sample_is_bounded(spark):
    """Repeated ids, null ids and copies come back once, and no more than asked for."""
    from pyspark.sql import functions as F

    from quarry.llm.language_id import sample_labelled

    rows = [(7, "the same text again", "en")] * 400 + [(None, "no id but text", "en")] * 200 + [(k, f"text number {k}", "en") for k in range(300)] + [(k, f"der text {k}", "de") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sample_labelled(docs, F.col("lang"), F.col("text"), F.col("doc_id"), 100)
    assert [x for x, _ in found].count("en") == 100 and [x for x, _ in found].count("de") == 40


def test_codewords_are_apart_and_every_bit_splits():
    for k in (2, 3, 4, 5, 9, 40):
        code = codewords(k)
        assert len(code) == k and np.all(np.abs(code.sum(axis=0)) < k)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if k < 3 else 2)


def test_ambiguous_text_is_flagged():
    pick = random.Random(1)
    make = lambda words: " ".join(pick.choice(words) for _ in range(30))
    a, b = ["the", "with", "thing"], ["der", "und", "auch"]
    model = fit([make(a) for _ in range(40)] + [make(b) for _ in range(40)], ["en"] * 40 + ["de"] * 40)
    margins, _ = model.margins([make(a), make(a)[:60] + make(b)[:60]])
    _, score, second = model.decode(margins)
    assert score[0] - second[0] > score[1] - second[1]
