"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary linear classifier
over hashed character n-grams (one to three code points, lower-cased, letters
only, other runs as one gap) predicts which side a text is on.  Decoding is
loss-weighted: a language's loss is the sum over bits of the logistic loss of
the bit's margin against its codeword, weighted by the bit's accuracy in
training; the language of least loss wins, and a text is flagged ambiguous
where the runner-up is close.

The classifiers are fitted on a bounded sample of labelled rows: at most
``per_language`` texts a language, those whose id and text hash least.  The
sample's texts are read whole too, on the executors; the driver gets their
n-gram counts, at most 2^``BUCKET_BITS`` a text.

``und`` with score 0 is predicted for null texts, texts without a letter, and
where nothing could be learned, so an empty table trains no model.  Of languages
with equal loss the first by name wins.  Rows repeated under one id with one
text are one row of the sample and are predicted alike; ids may be null or
repeated.  Only the named columns are read.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, steps

BUCKET_BITS = 15
UNDETERMINED = "und"
#: Grams' worth of doubt: short texts have smaller margins.
SHRINK = 24
#: Median size of a margin in training, which sets the scale of the scores.
TYPICAL_MARGIN = 2.5


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself lower-cased if it is a letter, else 32."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(low) if len(low := c.lower()) == 1 else point
    return table


def gram_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in a row, the offsets of each text's part, and its letter count.

    A text of n kept code points has 3 n grams: those of one, two and three
    points ending at each point (a gap stands before the first).
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    mapped = _letters()[points]
    start = np.concatenate([[0], np.cumsum(sizes)])
    gap = mapped == 32
    follows = np.zeros(len(mapped), bool)
    follows[1:] = gap[:-1]
    firsts = start[:-1][sizes > 0]
    follows[firsts] = True
    keep = ~(gap & follows)  # runs of other characters shrink to one gap; none leads a text
    kept = np.concatenate([[0], np.cumsum(keep)])[start]
    chars = mapped[keep]
    letters = np.concatenate([[0], np.cumsum(~gap)])[start]
    before = np.empty_like(chars)
    before[1:] = chars[:-1]
    before2 = np.empty_like(chars)
    before2[2:] = chars[:-2]
    heads = kept[:-1][np.diff(kept) > 0]
    before[heads] = 32
    before2[heads] = 32
    second = heads[np.diff(kept)[np.diff(kept) > 0] > 1] + 1
    before2[second] = 32
    one = chars * np.uint32(0x9E3779B1)
    two = (one ^ (before * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two ^ (before2 * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKET_BITS)
    grams = np.empty((len(chars), 3), np.uint32)
    grams[:, 0], grams[:, 1], grams[:, 2] = (one * np.uint32(0x2545F491)) >> shift, two >> shift, three >> shift
    return grams.reshape(-1), 3 * kept, np.diff(letters)


def codewords(k: int, bits: int | None = None) -> np.ndarray:
    """k rows of +-1.  Up to five languages: all splits into two sides (the exhaustive code).

    Beyond, rows are drawn from a fixed stream, each the farthest of 64 tries
    from those before it; columns that do not split the languages are turned.
    """
    if k < 3:
        return np.array([[1.0], [-1.0]])[:k]
    if k <= 5:
        sides = [set(s) | {0} for r in range(k - 1) for s in combinations(range(1, k), r)]
        return np.array([[1.0 if i in s else -1.0 for s in sides] for i in range(k)])
    bits = bits or 8 + 4 * int(np.ceil(np.log2(k)))
    stream = np.random.default_rng(k)
    rows: list[np.ndarray] = []
    for _ in range(k):
        tries = stream.choice([-1.0, 1.0], (64, bits))
        far = [min((int((t != r).sum()) for r in rows), default=bits) for t in tries]
        rows.append(tries[int(np.argmax(far))])
    code = np.array(rows)
    for b in np.flatnonzero(np.abs(code.sum(axis=0)) == k):
        code[b % k, b] *= -1
    return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, at, letters = gram_features(texts)
        out = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        for k in range(len(texts)):
            if at[k + 1] > at[k]:
                part = grams[at[k] : at[k + 1]]
                if len(part) < 2048:
                    out[k] = self.weights[part].mean(axis=0)
                else:
                    out[k] = np.bincount(part, minlength=len(self.weights)) @ self.weights / len(part)
                out[k] *= len(part) / (len(part) + SHRINK)
        return out + self.bias, letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score (0 to 1) and the runner-up's."""
        loss = (np.logaddexp(0.0, -margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = odds / odds.sum(axis=1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        rows = np.arange(len(share))
        second = share[rows, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(share))
        return order[:, 0], share[rows, order[:, 0]], second


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text that occur, and how often."""
    return np.unique(gram_features([text])[0], return_counts=True)


def fit(texts: list[str], labels: list[str], rounds: int = 40, rate: float = 1.0) -> Model | None:
    return fit_counts([gram_counts(t) for t in texts], labels, rounds, rate)


def fit_counts(cells: list[tuple[np.ndarray, np.ndarray]], labels: list[str], rounds: int = 40, rate: float = 1.0) -> Model | None:
    """Logistic bit classifiers on mean-pooled n-grams, by full-batch Adagrad."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages))
    buckets, texts = 1 << BUCKET_BITS, cells
    r = np.repeat(np.arange(len(texts), dtype=np.int32), [len(g) for g, _ in cells])
    g = np.concatenate([g for g, _ in cells]).astype(np.int32)
    value = np.concatenate([c / max(1, c.sum()) for _, c in cells])
    y = code[[languages.index(x) for x in labels]]
    share = np.bincount(g, value, buckets) / max(1, len(texts))
    scale = 1.0 / np.sqrt(share + 1e-4)  # rare grams count as much as common ones
    value *= scale[g]
    weights, bias, seen = np.zeros((buckets, code.shape[1]), order="F"), np.zeros(code.shape[1]), np.full((buckets, code.shape[1]), 1e-8, order="F")
    for step in range(rounds):
        for b in range(code.shape[1]):
            margin = np.bincount(r, value * weights[g, b], len(texts)) + bias[b]
            pull = y[:, b] / (1.0 + np.exp(np.clip(y[:, b] * margin, -30, 30))) / len(texts)
            slope = np.bincount(g, value * pull[r], buckets)
            seen[:, b] += slope**2
            weights[:, b] += rate * slope / np.sqrt(seen[:, b])
            bias[b] += pull.sum()
    scores = np.stack([np.bincount(r, value * weights[g, b], len(texts)) for b in range(code.shape[1])], axis=1) + bias
    right = (scores * y > 0).mean(axis=0)
    tempered = TYPICAL_MARGIN / max(float(np.median(np.abs(scores))), 1e-6)
    return Model(languages, code, (tempered * weights * scale[:, None]).astype(np.float32), tempered * bias, np.clip(2 * right - 1, 0.05, 1.0))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, h, text) to (label, h, grams, counts)."""
    for batch in steps(batches):
        cells = [gram_counts(t) for t in batch.column(2).to_pylist()]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g, _ in cells])]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([c[k] for c in cells]), pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["label", "h", "grams", "counts"])


def sample_labelled(docs: DataFrame, label: Column, text: Column, key: Column, per_label: int) -> list[tuple[str, tuple[np.ndarray, np.ndarray]]]:
    """(label, n-gram counts) of at most ``per_label`` distinct rows a label: those that hash least.

    The number of distinct rows by label fixes a hash limit, so one filter finds the rows: none are
    sorted.  Copies under one id, or under none, have one hash and count as one row.
    """
    span = 1 << 31
    labelled = docs.select(label.cast("string").alias("label"), key.cast("string").alias("key"), text.cast("string").alias("text")).where("label is not null and text <> ''")
    labelled = labelled.select("label", F.pmod(F.xxhash64("key", "text", F.lit("sample")), F.lit(span)).alias("h"), "text")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    # a share of the hashes that holds per_label rows all but surely, and not many more
    reach = {name: min(span, int(span * (1.2 * per_label + 60) / max(1, n)) + 1) for name, n in counts.items()}
    if not reach:
        return []
    limit = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])[F.col("label")]
    bounded_batches(docs.sparkSession)
    chosen = labelled.where(F.col("h") < limit).dropDuplicates(["label", "h"])
    table = chosen.select("label", "h", "text").mapInArrow(_sampled, "label string, h long, grams array<int>, counts array<int>").toArrow()
    labels, hashes = table["label"].to_pylist(), table["h"].to_pylist()
    out = []
    for name in sorted(reach):
        least = sorted((h, k) for k, (x, h) in enumerate(zip(labels, hashes, strict=True)) if x == name)[:per_label]
        out += [(name, tuple(table[c][k].values.to_numpy() for c in ("grams", "counts"))) for _, k in least]
    return out


_COLUMNS = "doc_id long, lang_pred string, score double, ambiguous boolean, runner_up double"


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous, runner_up) for each row; no rows move."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = len(texts)
            names, score, second = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            if model is not None:
                margins, letters = model.margins(texts)
                best, score, second = model.decode(margins)
                some = letters > 0
                names = [model.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score, second = np.where(some, score, 0.0), np.where(some, second, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(score - second < margin), pa.array(second)], [c.split()[0] for c in _COLUMNS.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _COLUMNS)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 500) -> Model | None:
    """Fit on a bounded sample of the labelled rows."""
    rows = sample_labelled(docs, F.col(label_col), F.col(text_col), F.col(id_col), per_language)
    return fit_counts([cells for _, cells in rows], [x for x, _ in rows])
