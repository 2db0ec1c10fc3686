"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters and digits, lower-cased; a sequence is a sentence
(at most ``MAX_SEQUENCE`` tokens).  The two states are clean and toxic.  A
token's score sums hashed features: the word, its beginnings of four, six and
eight bytes, and the words on both sides; transitions have weights of their
own.  Forward-backward gives each token's marginal; documents aggregate them
(the strongest, the expected number and the share of toxic tokens) through a
logistic layer, and tokens likely to be toxic are returned as offsets.

Labels exist for whole documents only, so token labels are derived from them:
in documents labelled toxic, tokens are marked whose word or beginning is
significantly more frequent there than in clean ones.  Only labels teach: the
field is fitted on half of a bounded sample of labelled rows (at most
``per_label`` whole texts a label), the logistic layer on the other half,
weighted to the labels' true shares.  Scoring reads whole texts.

Null and empty texts get the score of a text without tokens.  If no row of
either label can be learned from, as on empty tables, every score is the share
of label 1 (0 where nothing is labelled).  Where an id has several rows or
labels, its text of least hash and its greatest label teach.  A score of exactly
one half predicts label 1; of tied ids the lesser hash is sampled.  Repeated
rows score alike, null ids too.  Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LETTER_WORDS, bounded_batches, byte_view, mix64, prefix_hashes, span_hashes, steps, word_spans

BITS = 17
MAX_SEQUENCE = 256
BEGINNINGS = (4, 6, 8)
#: Bytes that end a sentence: full stop, exclamation and question mark, line feed.
_STOPS = np.isin(np.arange(256), [46, 33, 63, 10])


@dataclass
class Tokens:
    """The tokens of a batch of texts, in order."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray  # tokens x (word, beginnings ...): 64-bit
    sequence: np.ndarray  # first token of each sequence, and the end


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    inside, value = LETTER_WORDS
    starts, ends, row = word_spans(data, offsets, inside)
    prefix = prefix_hashes(data, value)
    hashes = np.empty((len(starts), 1 + len(BEGINNINGS)), np.uint64, order="F")
    hashes[:, 0] = span_hashes(prefix, starts, ends)
    for k, n in enumerate(BEGINNINGS, 1):
        # a shorter word has no such beginning of its own: the feature is that it is short
        hashes[:, k] = np.where(ends - starts >= n, span_hashes(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(k), np.uint64(k))
    if not len(starts):
        return Tokens(starts, ends, row, hashes, np.zeros(1, np.int64))
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(row) != 0) | (np.diff(stops) != 0)
    heads = np.flatnonzero(fresh)
    at = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    return Tokens(starts, ends, row, hashes, np.append(np.flatnonzero(at % MAX_SEQUENCE == 0), len(starts)))


def tokenize_steps(texts: list[str], size: int = 1 << 18) -> Tokens:
    """The same of many texts, some characters at a time: only what is kept of them adds up."""
    parts, at, row, count = [], 0, 0, 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= size):
            chars += len(texts[stop])
            stop += 1
        t = tokenize(*byte_view(pa.array(texts[at:stop], pa.string())))
        parts.append(Tokens(t.starts, t.ends, t.row + row, t.hashes, t.sequence[:-1] + count))
        at, row, count = stop, stop, count + len(t.starts)
    if not parts:
        return tokenize(*byte_view(pa.array([], pa.string())))
    hashes = np.empty((count, parts[0].hashes.shape[1]), np.uint64, order="F")
    for k in range(hashes.shape[1]):
        hashes[:, k] = np.concatenate([p.hashes[:, k] for p in parts])
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Tokens(join("starts"), join("ends"), join("row"), hashes, np.append(join("sequence"), count))


def feature_buckets(tokens: Tokens) -> np.ndarray:
    """tokens x features: bucket of each feature (own ones, then the words before and after), column by column."""
    n, own = tokens.hashes.shape
    out = np.empty((n, own + 2), np.int32, order="F")
    bucket = lambda keys: mix64(keys) >> np.uint64(64 - BITS)
    for k in range(own):
        out[:, k] = bucket(tokens.hashes[:, k])
    if n:
        first = tokens.sequence[:-1]
        before = np.empty(n, np.uint64)
        before[1:] = tokens.hashes[:-1, 0]
        before[first] = 0
        out[:, own] = bucket(before + np.uint64(101))
        after = np.empty(n, np.uint64)
        after[:-1] = tokens.hashes[1:, 0]
        after[first[1:] - 1] = 0
        after[-1] = 0
        out[:, own + 1] = bucket(after + np.uint64(202))
    return out


@dataclass
class Chain:
    """Weights of the field: ``weights`` by bucket, ``bias``, and ``moves[i, j]`` from state i to j."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -2.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        out = np.full(len(buckets), self.bias)
        for k in range(buckets.shape[1]):  # column by column: no array of all features' weights
            out += self.weights[buckets[:, k]]
        return out

    def forward_backward(self, score: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of the toxic state: from the left (own score included), from the right, and both."""
        first, length = sequence[:-1], np.diff(sequence)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        t = self.moves
        left, right = score.copy(), np.zeros_like(score)
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # sequences with at least k tokens
        for k in range(1, longest):
            at = first[: active[k]] + k
            x = left[at - 1]
            left[at] += np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])
        for k in range(longest - 2, -1, -1):
            at = first[: active[k + 1]] + k
            x = score[at + 1] + right[at + 1]
            right[at] = np.logaddexp(x + t[1, 1], t[1, 0]) - np.logaddexp(x + t[0, 1], t[0, 0])
        return left, right, left + right

    def marginals(self, tokens: Tokens) -> np.ndarray:
        _, _, both = self.forward_backward(self.emissions(feature_buckets(tokens)), tokens.sequence)
        return 1.0 / (1.0 + np.exp(-np.clip(both, -40, 40)))

    def pair_counts(self, score: np.ndarray, left: np.ndarray, right: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Expected number of each move over all sequences."""
        after = np.ones(len(score), bool)
        after[sequence[:-1]] = False
        places, total = np.flatnonzero(after), np.zeros(4)
        for k in range(0, len(places), 1 << 15):
            at = places[k : k + (1 << 15)]
            a, b = left[at - 1], score[at] + right[at]
            logs = np.stack([np.full(len(at), self.moves[0, 0]), self.moves[0, 1] + b, self.moves[1, 0] + a, self.moves[1, 1] + a + b], axis=1)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            total += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
        return total.reshape(2, 2)


def fit_chain(tokens: Tokens, toxic: np.ndarray, rounds: int = 40, rate: float = 0.5, decay: float = 1e-6) -> Chain:
    """Maximum likelihood of the token labels by full-batch Adagrad."""
    chain, buckets = Chain(), feature_buckets(tokens)
    y, n = toxic.astype(np.float64), len(toxic)
    if not n:
        return chain
    after = np.ones(n, bool)
    after[tokens.sequence[:-1]] = False
    at = np.flatnonzero(after)
    seen_moves = np.bincount(2 * toxic[at - 1].astype(np.int64) + toxic[at], minlength=4).reshape(2, 2).astype(np.float64)
    weights = np.zeros(1 << BITS)
    g_w, g_m, g_b = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(rounds):
        chain.weights = weights
        score = chain.emissions(buckets)
        left, right, both = chain.forward_backward(score, tokens.sequence)
        miss = y - 1.0 / (1.0 + np.exp(-np.clip(both, -40, 40)))
        slope = -decay * n * weights
        for k in range(buckets.shape[1]):
            slope += np.bincount(buckets[:, k], miss, 1 << BITS)
        moves = seen_moves - chain.pair_counts(score, left, right, tokens.sequence)
        g_w += slope**2
        g_m += moves**2
        g_b += miss.sum() ** 2
        weights = weights + rate * slope / np.sqrt(g_w)
        chain.moves = chain.moves + rate * moves / np.sqrt(g_m)
        chain.bias += rate * miss.sum() / np.sqrt(g_b)
    chain.weights = weights.astype(np.float32)
    return chain


def derive_labels(tokens: Tokens, label: np.ndarray, least_z: float = 5.0, least_ratio: float = 4.0) -> np.ndarray:
    """Marks tokens of toxic rows whose word or beginning is significantly more frequent by document there."""
    marked = np.zeros(len(tokens.row), bool)
    n1, n0 = max(1, int(label.sum())), max(1, int((label == 0).sum()))
    for k in range(tokens.hashes.shape[1]):
        real = tokens.hashes[:, k] != np.uint64(k) if k else np.ones(len(marked), bool)
        kinds, inverse = np.unique(tokens.hashes[:, k], return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * len(label) + tokens.row)
        kind, toxic = pairs // max(1, len(label)), label[pairs % max(1, len(label))] == 1
        with1, with0 = np.bincount(kind[toxic], minlength=len(kinds)), np.bincount(kind[~toxic], minlength=len(kinds))
        p1, p0 = (with1 + 0.5) / (n1 + 1), (with0 + 0.5) / (n0 + 1)
        pooled = (with1 + with0 + 1) / (n1 + n0 + 2)
        z = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        marked |= ((z >= least_z) & (p1 >= least_ratio * p0))[inverse] & real
    return marked & (label[tokens.row] == 1)


def document_features(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n x 4: one, logit of the strongest marginal, log of the expected number, log of the share."""
    total, count, strongest = np.bincount(row, p, n), np.bincount(row, minlength=n), np.zeros(n)
    np.maximum.at(strongest, row, p)
    top = np.clip(strongest, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log(total + 0.05), np.log((total + 0.01) / (count + 10.0))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, halved where the loss would rise."""
    penalty = ridge * weight.sum() / len(y) * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    loss = lambda b: float((weight * np.logaddexp(0, -(2 * y - 1) * (x @ b))).sum() + b @ penalty @ b / 2)
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), slope)
        size = 1.0
        while size > 1e-4 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return beta


@dataclass
class Model:
    chain: Chain | None
    beta: np.ndarray
    prior: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Tokens | None, np.ndarray]:
        """Document scores, the tokens and their marginals."""
        n = len(offsets) - 1
        if self.chain is None:
            return np.full(n, self.prior), None, np.zeros(0)
        tokens = tokenize(data, offsets)
        p = self.chain.marginals(tokens)
        x = document_features(p, tokens.row, n)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30))), tokens, p


def fit(rows: list[tuple[str, int]], shares: tuple[float, float]) -> Model:
    """Fit on (text, label) rows in random order; ``shares`` are the labels' true shares."""
    label = np.array([y for _, y in rows], np.int64)
    prior = shares[1] / max(1e-9, sum(shares))
    if not len(label) or not 0 < label.sum() < len(label):
        return Model(None, np.zeros(4), prior if len(label) else 0.0)
    of = lambda part: tokenize_steps([rows[i][0] for i in part])
    fold = np.zeros(len(rows), bool)
    for y in (0, 1):
        fold[np.flatnonzero(label == y)[::2]] = True
    train, rest = np.flatnonzero(fold), np.flatnonzero(~fold)
    if not 0 < label[rest].sum() < len(rest):
        rest = train
    tokens = of(train)
    chain = fit_chain(tokens, derive_labels(tokens, label[train]))
    del tokens
    held = of(rest)
    x = document_features(chain.marginals(held), held.row, len(rest))
    y = label[rest]
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    return Model(chain, fit_logistic(x, y, weight), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1_500) -> Model:
    """Fit on a bounded sample: of each label the rows whose ids hash least.

    ``labels`` may have repeated and null rows (the greatest label of an id
    counts).  Only the sample's ids, at most about 2.5 x ``per_label``, are broadcast,
    and one text for each comes back, however often an id repeats.
    """
    span = 1 << 31
    keyed = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    keyed = keyed.withColumn("h", F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("toxic")), F.lit(span)))
    counts = {r["y"]: r["n"] for r in keyed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], (0.0, 0.0))
    limit = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(span, int(span * (1.2 * per_label + 60) / n) + 1))])[F.col("y")]
    chosen = keyed.where(F.col("h") < limit)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "k").groupBy("k", "y", "h").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("least")).select("k", "y", "h", "least.text").collect()
    # copies of one text count once, or their words would look typical of their label
    out = list({(y, text): (h, k, text, y) for h, k, text, y in sorted(((r["h"], r["k"], r["text"], r["y"]) for r in rows), reverse=True)}.values())
    kept = [r for y in (0, 1) for r in sorted(x for x in out if x[3] == y)[:per_label]]
    total = sum(counts.values())
    return fit([(text, y) for _, _, text, y in sorted(kept)], (counts.get(0, 0) / total, counts.get(1, 0) / total))


_COLUMNS = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", span_limit: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, spans): spans are code-point offsets of tokens at or above ``span_limit``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = byte_view(batch.column(1))
            scores, tokens, p = model.score(data, offsets)
            spans: list[list[dict]] = [[] for _ in scores]
            if tokens is not None:
                for i in np.flatnonzero(p >= span_limit).tolist():
                    r, base = int(tokens.row[i]), int(offsets[tokens.row[i]])
                    head = data[base : tokens.starts[i]]
                    start = int(((head & 0xC0) != 0x80).sum())
                    word = data[tokens.starts[i] : tokens.ends[i]]
                    spans[r].append({"start": start, "end": start + int(((word & 0xC0) != 0x80).sum()), "p": float(p[i])})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, _SPAN_TYPE)], ["doc_id", "score", "predicted", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _COLUMNS)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below ``limit``; no rows move."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            scores, _, _ = model.score(*byte_view(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(scores < limit))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
