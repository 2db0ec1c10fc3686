"""Near duplicates, toxicity, language-model scores, HTML and the pipeline against plain versions."""

import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import html_extract, near_dedup, packing, queries, toxicity
from quarry.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(texts, percent=75):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def check_components(rows, texts):
    expected, sets = plain_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_match_all_pairs(spark, data, texts):
    check_components(queries.op2_near_dedup(spark, data).collect(), texts)


@pytest.mark.parametrize("small", [2, 24])
def test_groups_of_edited_copies(spark, small):
    """A hub with copies edited apart (many link only to the hub), a chain, and texts that share a passage."""
    pick = np.random.default_rng(3)
    word = lambda: "w" + str(pick.integers(0, 10**9))
    base, texts = [word() for _ in range(200)], {}
    for i in range(60):
        copy = list(base)
        for at in pick.choice(190, int(pick.integers(1, 9)), replace=False):
            copy[at] = word()
        texts[i] = " ".join(copy)
    texts[60] = " ".join(base)
    chain = [word() for _ in range(120)]
    for i in range(61, 75):
        chain = chain[6:] + [word() for _ in range(6)]
        texts[i] = " ".join(chain)
    for i in range(75, 95):
        texts[i] = " ".join([*base[:60], *(word() for _ in range(90))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check_components(near_dedup.near_duplicates(docs, small=small).collect(), texts)


def test_large_groups_of_copies(spark):
    """Hundreds of exact copies, of near copies edited apart, and of texts round one passage: as an exact join links them."""
    pick = np.random.default_rng(21)
    word = lambda: "w" + str(pick.integers(0, 10**9))
    base, passage, texts = [word() for _ in range(90)], [word() for _ in range(60)], {}
    for i in range(700):
        texts[i] = " ".join(base)
    for i in range(700, 1300):
        copy = list(base)
        for at in pick.choice(85, int(pick.integers(1, 4)), replace=False):
            copy[at] = word()
        texts[i] = " ".join(copy)
    for i in range(1300, 1600):  # the passage alone makes no links, a little more of it does
        own = int(pick.choice([4, 12, 40, 90]))
        texts[i] = " ".join([*passage, *(word() for _ in range(own))])
    docs = spark.createDataFrame([(i * 7 % 1601, t) for i, t in texts.items()], "doc_id long, text string").repartition(6)
    named = {i * 7 % 1601: t for i, t in texts.items()}
    by_text = {}
    for i, t in named.items():
        by_text.setdefault(t, []).append(i)
    sets = {min(ids): shingles(t) for t, ids in by_text.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for ids in holders.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                common[i, j] = common.get((i, j), 0) + 1
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    expected = {i: find(min(by_text[t])) for i, t in named.items()}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == expected


def test_split_join_matches_a_plain_join(spark):
    """Hot keys, cold keys, keys of one side alone, given sizes: the rows of an ordinary join."""
    from quarry.llm.common import unique_join, write_shared

    left = write_shared(spark.createDataFrame([(1 if k < 4000 else k % 50, k) for k in range(6000)], "key long, v long"), "left")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 60, 2)] + [(1, "hot")], "key long, w string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, left.join(right, "key", how).select("key", "v", "w").collect()), key=str)
        split = unique_join(left, right, ["key"], ["v"], how)
        assert sorted(map(tuple, split.select("key", "v", "w").collect()), key=str) == plain
        assert "_part" not in split.columns


@pytest.mark.parametrize("small", [1, 24])
def test_every_text_of_a_repeated_id_is_met(spark, small):
    pick = np.random.default_rng(12)
    base = [[f"w{pick.integers(0, 10**9)}" for _ in range(80)] for _ in range(4)]
    rows = [(1, " ".join(b)) for b in base] + [(i + 2, " ".join([*b[:-2], "x", "y"])) for i, b in enumerate(base)] + [(9, "some other text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, small=small).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}


def test_components_on_random_graphs(spark):
    pick = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in pick.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for n in list(parent)}


def test_toxicity_held_out(spark):
    """Toxic words share beginnings; labels say only which texts hold some."""
    pick = np.random.default_rng(6)
    clean = ["".join(pick.choice(list("abdeinorst"), int(pick.integers(3, 9)))) for _ in range(400)]
    rows = []
    for i in range(600):
        words = list(pick.choice(clean, 80))
        if i % 4 == 0:
            for at in pick.choice(80, 3, replace=False):
                words[at] = pick.choice(["moron", "vequ"]) + "".join(pick.choice(list("aeiou"), 3))
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, 80, 10)), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "y as toxic").where("doc_id < 400"))
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(scored[i]["predicted"], y) for i, _, y in rows if i >= 400]
    assert np.mean([p == y for p, y in held]) > 0.97
    spans = [(rows[i][1][s["start"] : s["end"]], s["p"]) for i in range(400, 600, 4) for s in scored[i]["spans"]]
    assert np.mean([w.startswith(("moron", "vequ")) for w, _ in spans]) > 0.9


def test_toxicity_query_against_plain_scores(spark, data, texts):
    """held_out, labels used, marginals by enumeration free recursion and document scores of the query."""
    from quarry.llm.common import byte_view, crc_remainder

    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(crc_remainder("doc_id", 5) != 0))
    rows = {r["doc_id"]: r for r in queries.op6_toxicity(spark, data).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        tokens = toxicity.tokenize(*byte_view(pa.array([text])))
        emission = (model.chain.weights[toxicity.feature_buckets(tokens)].sum(axis=1, dtype=np.float64) + model.chain.bias).tolist()
        moves, p = model.chain.moves, []
        for a, b in zip(tokens.sequence, tokens.sequence[1:], strict=False):
            e = emission[a:b]
            forward = [(0.0, e[0])] if len(e) else []
            for x in e[1:]:
                f0, f1 = forward[-1]
                forward.append((np.logaddexp(f0 + moves[0, 0], f1 + moves[1, 0]), x + np.logaddexp(f0 + moves[0, 1], f1 + moves[1, 1])))
            backward = [(0.0, 0.0)]
            for x in reversed(e[1:]):
                b0, b1 = backward[-1]
                backward.append((np.logaddexp(b0 + moves[0, 0], b1 + x + moves[0, 1]), np.logaddexp(b0 + moves[1, 0], b1 + x + moves[1, 1])))
            p += [1 / (1 + math.exp(min(700, (f0 + b0) - (f1 + b1)))) for (f0, f1), (b0, b1) in zip(forward, reversed(backward), strict=True)]
        top = min(max(max(p, default=0.0), 1e-4), 1 - 1e-4)
        x = [1.0, math.log(top / (1 - top)), math.log(sum(p) + 0.05), math.log((sum(p) + 0.01) / (len(p) + 10.0))]
        score = 1 / (1 + math.exp(-sum(float(u) * v for u, v in zip(model.beta, x, strict=True))))
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["score"] == pytest.approx(score, abs=1e-5) and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_recall_on_held_out_labels(spark):
    """Held-out recall and precision on the supplied labels of the larger table."""
    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, data).where("held_out").collect()
    met = [(r["predicted"], truth[r["doc_id"]]) for r in rows if truth.get(r["doc_id"]) is not None]
    caught = sum(p for p, y in met if y == 1) / sum(y == 1 for _, y in met)
    assert caught >= 0.8 and np.mean([p == y for p, y in met]) > 0.95


def test_chain_marginals_match_enumeration():
    from itertools import product

    chain = toxicity.Chain(moves=np.array([[0.3, -0.7], [-0.2, 0.9]]))
    score, sequence = np.array([0.5, -1.0, 2.0, 0.1, -0.4]), np.array([0, 3, 5])
    left, right, both = chain.forward_backward(score, sequence)
    for a, b in ((0, 3), (3, 5)):
        weight = {s: math.exp(sum(score[a + k] for k, v in enumerate(s) if v) + sum(chain.moves[x, y] for x, y in zip(s, s[1:], strict=False))) for s in product((0, 1), repeat=b - a)}
        for k in range(b - a):
            p = sum(w for s, w in weight.items() if s[k]) / sum(weight.values())
            assert 1 / (1 + math.exp(-both[a + k])) == pytest.approx(p)
    assert chain.pair_counts(score, left, right, sequence).sum() == pytest.approx(3.0)


def test_language_model_counts_and_gain(spark, data, texts):
    tokens = {i: [*WORDS.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = {}
    for i, ws in tokens.items():
        if not held[i]:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in queries.op7_lm_score(spark, data).collect()}
    for i, ws in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for i, r in rows.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_is_a_distribution(spark, data, texts):
    """Over the vocabulary, the probabilities of the next token, both factors computed plainly, sum to 1."""
    from quarry.llm import lm_score
    from quarry.llm.common import byte_view

    import pyarrow as pa

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, counts = lm_score.train(docs)
    t = lm_score.read_tokens(*byte_view(pa.array([texts[0][:200]])))
    own = model.classes(t)
    p = np.exp(model.log_probabilities(model.context(t, own)).astype(np.float64))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    hashes = counts.toArrow()["hash"].to_numpy().view(np.uint64)
    n = counts.toArrow()["n"].to_numpy()
    assert model.mass[: lm_score.SINGLES + lm_score.CLUSTERS].sum() == pytest.approx((n + 1).sum())
    # classes of the whole vocabulary: read it as one text
    words = sorted({w for x in texts.values() for w in WORDS.findall(x.translate(LOWER))})
    every = lm_score.read_tokens(*byte_view(pa.array([" ".join(words)])))
    classes, count = model.classes(every), dict(zip(hashes.tolist(), n.tolist(), strict=True))
    known = np.array([count.get(h, 0) for h in every.hash.tolist()])
    keep = known > 0
    digits, rows = lm_score.digits_of(every.hash), model.word_rows(t)
    for at in (0, 1, len(own) - 1):
        weight = model.words[0][rows[0, at]].astype(np.float64) + model.words[1][rows[1, at]]
        plain = (known + 1.0) * np.exp(weight[digits[0]] + weight[lm_score.DIGIT + digits[1]])
        for c in np.unique(classes[keep]):
            inside = keep & (classes == c)
            share = plain[inside] / plain[inside].sum()
            some = np.flatnonzero(inside)[:5]
            found, _, _ = model.within(np.repeat(rows[:, at : at + 1], len(some), axis=1), classes[some], digits[:, some])
            assert np.exp(found) * (known[some] + 1.0) == pytest.approx(share[:5], rel=1e-3)


def test_language_model_scores_head_and_tail_alike(spark):
    """Repeats of known and unknown tokens, with every token in the head, half of them, or a fifth."""
    from dataclasses import replace

    from quarry.llm import lm_score

    pick = np.random.default_rng(9)
    words = [f"w{k}" for k in range(40)]
    make = lambda own: " ".join(w for w in pick.choice(own, 30) for _ in range(int(pick.integers(1, 4))))
    docs = spark.createDataFrame([(i, make(words[:30]) if i < 60 else make(words) + " w1 w2 w1 w2") for i in range(90)], "doc_id long, text string").repartition(3, "doc_id")
    model, counts = lm_score.train(docs.where("doc_id < 60"))
    scores = []
    for step in (1, 2, 5):
        part = replace(model, head=model.head[::step], head_counts=model.head_counts[::step])
        rows = lm_score.score(docs, part, counts).collect()
        scores.append({r["doc_id"]: [r["n_known"], r["base_score"], r["score"]] for r in rows})
    for other in scores[1:]:
        assert all(other[i] == pytest.approx(scores[0][i], rel=1e-6) for i in scores[0])


def test_html_pages(spark, data):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op8_html_extract(spark, data).collect():
        page = pages[r["page_id"]]["html"]
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_furniture():
    page = """<title>X</title><header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a>a</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <main><article><h1>Title</h1><p>First &lt;para&gt; with <a href=x>link</a> and<br>more</p><div class=ad><p>Buy this great thing now.</p></div><p>Short.<p>Second&nbsp;one
    <aside>related</aside><form><label>Name</label></form><script>var a = "</p>";</script></article>
    <section id="comments"><p>I disagree with all of this for many long reasons.</p></section></main><footer>&copy; me</footer>"""
    assert html_extract.main_text(page) == "Title\n\nFirst <para> with link and more\n\nShort.\n\nSecond one"
    plain = "<div><a>Home</a> <a>About</a></div><h1>Some title</h1><p>" + "word " * 60 + "</p><p>" + "text " * 40 + "</p><div><a>x</a> <a>y</a></div>"
    assert html_extract.main_text(plain).split("\n\n")[0] == "Some title" and "About" not in html_extract.main_text(plain)
    assert html_extract.main_text("") == html_extract.main_text(None) == ""
    assert html_extract.main_text("<article><p>cut off in a tag <a href='") == "cut off in a tag"


def test_html_names_of_elements():
    body = "<p>One paragraph of the text itself.</p><p>Two.</p>"
    for page in (
        f'<body class="has-sidebar"><div class="layout sidebar-right"><article class="post">{body}</article></div></body>',
        f'<body><div class="header">Site name</div><ul class="main-menu"><li>Home</li></ul><div id="content"><div class="entry-content">{body}</div></div><div id="site-footer">Me</div></body>',
        f'<main class="with-comments">{body}<div class="comment-list"><article class="comment"><p>Reader words.</p></article><article><p>More reader words.</p></article></div></main>',
        f'<div class="notice">Please note.</div><div class="post-content">{body}<form><p>Your mail</p></form><div class="left_sidebar"><p>Side.</p></div></div><aside><article><p>Other story.</p></article></aside>',
    ):
        assert html_extract.main_text(page) == "One paragraph of the text itself.\n\nTwo."


def test_html_silent_elements_without_an_end_tag():
    body = "<article><p>One paragraph of the text itself.</p><p>Two.</p></article>"
    for page in (
        f"<html><head><title>T</title><script>write('<p>no</p>')</script><noscript><img src=x></noscript><body>{body}</body></html>",
        f"<head><meta charset=utf-8><title>A <b> in it</title><link href=x>{body}",
        f"<head><title>T</title></head><body><div><noscript><div><p>No script.</p></div></div>{body}</body>",
        f"<body><div><button>Press</div><div><svg><g><text>Drawn</text></div><ul><li><select><option>x</ul>{body}</body>",
        f"<body><div><template><div>Not shown</div><script>'</div>'</script></template></div>{body}</body>",
    ):
        assert html_extract.main_text(page) == "One paragraph of the text itself.\n\nTwo.", page


def test_html_marks_are_evidence():
    """A name alone never decides; attribute values are no attributes; raw text holds no markup."""
    body = "<p>One paragraph of the text itself.</p><p>Two.</p>"
    text = "One paragraph of the text itself.\n\nTwo."
    for page in (
        f'<article class="related-work">{body}</article>',
        f'<main id="search-main">{body}</main>',
        f'<article><p title="the hidden truth">One paragraph of the text itself.</p><p data-id="search" data-state="hidden-panel">Two.</p></article>',
        f'<article><p class="alert-box-explained">One paragraph of the text itself.</p><p>Two.</p></article>',
        f"<article>{body}</article><script>document.write('<!-- ad ')</script><footer>Foot of the page</footer>",
        f"<script>if (a <!--b) x()</script><article>{body}</article><footer>Foot</footer>",
        f"<article>{body}<div hidden><p>Not shown at all here.</p></div><p style='display: none'>Nor this.</p></article>",
    ):
        assert html_extract.main_text(page) == text, page
    long = "<p>" + "word " * 90 + "</p><p>" + "text " * 110 + "</p>"
    assert html_extract.main_text(f'<div class="widget"><h1>A title here</h1>{long}</div>').count("text") == 110  # nothing else is content
    assert html_extract.main_text(f'<article>{body}</article><div class="widget">{long}</div>') == text
    assert html_extract.main_text('<article><p>The text of it all.</p><div class="share-this-story"><a>Send</a> <a>Post</a></div></article>') == "The text of it all."


def test_html_tree_uses_neighbours():
    used = set()

    def walk(node):
        if node.keep is None:
            used.add(html_extract.FEATURES[node.feature])
            walk(node.left)
            walk(node.right)

    walk(html_extract.default_tree())
    assert {"words", "link_density", "tag", "name"} <= used and used & {"words_before", "density_before"} and used & {"words_after", "density_after"}
    rows = html_extract.labelled_rows()
    assert np.mean([html_extract.default_tree().decide(x) == bool(y) for x, y in rows]) > 0.97


@pytest.mark.parametrize("sizes", [(1, 3, 60, 2, 200, 5), (3,), (900, 1, 1, 1), (2, 2, 2, 2), (14, 31, 22, 4, 9)])
def test_html_articles_of_any_shape(sizes):
    """Every block of an article stays, and no furniture, whatever their lengths."""
    pick = np.random.default_rng(sum(sizes))
    words = lambda n: " ".join("".join(pick.choice(list("abcdefgh"), 5)) for _ in range(n))
    kept = [words(n) for n in sizes]
    other = [words(int(n)) for n in pick.integers(1, 120, 4)]
    page = f"<title>{other[0]}</title><nav><ul><li><a>{other[1]}</a></ul></nav><div class='ad'>{other[2]}</div><article><h1>{kept[0]}</h1>" + "".join(f"<p>{k}</p>" for k in kept[1:]) + f"</article><footer>{other[3]}</footer>"
    assert html_extract.main_text(page) == "\n\n".join(kept)


def test_pipeline_against_plain_stages(spark, data, texts, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_toxicity(spark, data).collect()}
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, data)
        out.write.parquet(str(tmp_path / f"{k}"))
        held = spark.read.parquet(str(tmp_path / f"{k}"))
        if name != "packing":
            assert held.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in held.select("doc_id", "text").collect()} if name != "packing" else None
        if name == "toxicity":
            expected = {i: t for i, t in texts.items() if not scores[i]}
        elif name == "exact_dedup":
            groups = {}
            for i, t in expected.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
            expected = {i: expected[i] for ids in groups.values() for i in [min(ids, key=lambda i: (-len(expected[i]), i))]}
        elif name == "near_dedup":
            component, _ = plain_components(expected)
            expected = {i: t for i, t in expected.items() if component[i] == i}
        elif name == "secret_scan":
            from quarry.llm.secret_scan import redact_text

            expected = {i: redact_text(t) for i, t in expected.items()}
        else:
            encode = packing.byte_ids(packing.default_path("byte_bpe_50k.json")).encode
            found = {r["doc_id"]: r["n"] for r in held.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
            assert found == {i: len(encode(t)) // 4 + 1 for i, t in expected.items()}
            continue
        assert left == expected
