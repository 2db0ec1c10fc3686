"""Scoring texts with a hashed maximum-entropy language model.

The model factors a token over classes: P(token) = P(class | context) *
P(token | class, context).  Both factors are softmaxes over hashed features of
the context, trained by gradient updates:

* The class is drawn by the previous token's ending (n-gram), the ending of the
  one before (skip) and the classes of the last three tokens together.  Classes
  are the most frequent tokens, one each; word endings clustered by what stands
  before them; and two that repeat the last token or the one before it.
* Within its class a token t has (count + 1) * exp(f(t)) / Z.  The hash of t gives two
  digits, and f adds a weight for each, from the rows of the previous token
  (bigram) and of the token before it (skip), whole words hashed.  Z sums over
  all tokens of the class: tokens of one class and equal digits share their f,
  so the sum runs over ``CELLS`` masses, exactly.  The hashed rows grow with the
  number of distinct tokens, from 2^12 to 2^``WORD_BITS``.

Unknown tokens have, here as in the base model, the share 1 / (N + V + 1)
altogether, so the two can be compared token by token.

Training reads all training texts twice.  The first pass counts tokens and, for
the clustering, endings by what stands before them.  The second makes the
gradient updates: each partition runs Adagrad over its tokens from a common
start, and every weight row is averaged over the partitions by how often they
used it.  Scoring runs in numpy over sparse batches, in log space.

Only the most frequent tokens, at most ``HEAD_LIMIT``, reach every worker; the
rest of a text's tokens are joined to the counts by a shuffle and scored by the
same formula, whichever side a token is on.  Nulls count as empty texts (the end
token alone).  Without training texts, or on an empty table, the model is the
base model.  Ties: of tokens of equal count the one of least hash becomes a
class, and of clusters equally near the first is taken.  Repeated rows score
alike; rows with null ids are scored too.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_WORDS, bounded_batches, byte_view, mix64, prefix_hashes, span_hashes, steps, word_spans, write_shared

HEAD_LIMIT = 1 << 20
#: Classes: single tokens, clusters of endings, and repeats of the last token and the one before.
SINGLES, CLUSTERS = 10, 20
REPEAT, SKIP_REPEAT = SINGLES + CLUSTERS, SINGLES + CLUSTERS + 1
CLASSES = SINGLES + CLUSTERS + 2
#: Bins of endings that are clustered, bins of what stands before, and rows of each feature table.
ENDINGS, BEFORE, ROWS = 1024, 128, 4096
#: Hash of the end token; its last byte cannot occur in a word.
END = np.uint64(0xE5D_0F_7E87)
#: Two digits of a token's hash, of so many values each, and the cells that they span.
DIGIT = 16
CELLS = DIGIT * DIGIT
#: Most bits of the hashed rows of whole words.
WORD_BITS = 17
_START = 3  # tokens before a text's first have this ending bin
BATCH = 8192


@dataclass
class Tokens:
    """Tokens of a batch of texts, each text's end token included."""

    hash: np.ndarray  # 64-bit
    ending: np.ndarray  # hash of the last three bytes
    place: np.ndarray  # position in its text
    offsets: np.ndarray  # of the texts


def read_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    inside, value = SPACE_WORDS
    starts, ends, row = word_spans(data, offsets, inside)
    prefix = prefix_hashes(data, value)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    where = np.arange(len(starts)) + row
    hashes, endings = np.full(at[-1], END, np.uint64), np.full(at[-1], mix64(np.array([END]))[0], np.uint64)
    hashes[where] = span_hashes(prefix, starts, ends)
    endings[where] = span_hashes(prefix, np.maximum(starts, ends - 3), ends)
    return Tokens(hashes, endings, np.arange(at[-1]) - np.repeat(at[:-1], counts + 1), at)


def _shifted(x: np.ndarray, k: int, place: np.ndarray, start: int) -> np.ndarray:
    """x of the token k places before, or ``start`` where the text has none."""
    out = np.full(len(x), start, x.dtype)
    out[k:] = x[:-k]
    out[place < k] = start
    return out


def _shifted_exp(logits: np.ndarray) -> np.ndarray:
    """exp of the logits in place, less a shift for each row, which is returned.

    One shift for all rows is enough where none is so far below the greatest that it would vanish.
    """
    top = logits.max() if logits.size else np.float32(0)
    if logits.size and top - logits.min() > 60:
        shift = logits.max(axis=-1)
        logits -= shift[..., None]
    else:
        shift = np.full(logits.shape[:-1], top, np.float32)
        logits -= top
    np.exp(logits, out=logits)
    return shift


#: Sums of rows are products with a vector of ones, many times as fast as a reduction over a short axis.
_ONES = np.ones(max(CLASSES, DIGIT), np.float32)


def _sum_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index if index.max(initial=0) >> 16 else index.astype(np.uint16), kind="stable")  # 16 bits sort by radix
    ordered = index[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[heads], np.add.reduceat(rows[order], heads, axis=0)


# ---- first pass: counts


def _count(batches: Iterable[pa.RecordBatch], flush: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """(hash, ending bin, count) of a partition's tokens, and its ending matrix as rows with null hash."""
    held: list[tuple[np.ndarray, ...]] = []
    matrix = np.zeros(ENDINGS * BEFORE, np.int64)

    def merge() -> tuple[np.ndarray, ...]:
        keys, bins, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, bins, counts = keys[order], bins[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[heads], bins[heads], np.add.reduceat(counts, heads)

    def batch_of(keys: np.ndarray, bins: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bins, pa.int32()), pa.array(counts, pa.int64()), pa.nulls(n, pa.binary())], ["hash", "bin", "n", "block"])

    for batch in steps(batches, "text"):
        t = read_tokens(*byte_view(batch.column(0)))
        keys, first, counts = np.unique(t.hash, return_index=True, return_counts=True)
        held.append((keys, (t.ending[first] % np.uint64(ENDINGS)).astype(np.int32), counts.astype(np.int64)))
        bins = (t.ending % np.uint64(ENDINGS)).astype(np.int64)
        before = _shifted((t.ending >> np.uint64(32)).astype(np.int64) % BEFORE, 1, t.place, _START)
        matrix += np.bincount(bins * BEFORE + before, minlength=len(matrix))
        if sum(len(k) for k, _, _ in held) > flush:
            held = [merge()]
            if len(held[0][0]) > flush // 2:
                yield batch_of(*held.pop())
    if held:
        yield batch_of(*merge())
        blocks = [row.tobytes() for row in matrix.reshape(ENDINGS, BEFORE)]
        yield pa.RecordBatch.from_arrays([pa.nulls(ENDINGS, pa.int64()), pa.array(np.arange(ENDINGS), pa.int32()), pa.nulls(ENDINGS, pa.int64()), pa.array(blocks, pa.binary())], ["hash", "bin", "n", "block"])


def _sum_blocks(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("block").to_pylist())
    return pa.table({"bin": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})


def cluster_endings(matrix: np.ndarray, k: int = CLUSTERS, rounds: int = 25) -> np.ndarray:
    """Cluster of each ending: weighted k-means on the square roots of what stands before it."""
    weight = matrix.sum(axis=1).astype(np.float64)
    points = np.sqrt((matrix + 0.02) / (matrix + 0.02).sum(axis=1, keepdims=True))
    pick = np.random.default_rng(11)
    centres = [points[int(np.argmax(weight))]]
    while len(centres) < k:
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.sqrt(weight)
        centres.append(points[pick.choice(len(points), p=far / far.sum())] if far.sum() > 0 else points[len(centres) % len(points)])
    centre = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(points @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        for c in range(k):
            if (w := weight[near == c]).sum() > 0:
                centre[c] = (points[near == c] * w[:, None]).sum(axis=0) / w.sum()
    return np.argmax(points @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)


# ---- the model


@dataclass
class Model:
    total: int  # N
    kinds: int  # V
    singles: np.ndarray  # hashes of the tokens that are a class each
    cluster: np.ndarray  # class of each ending bin
    mass: np.ndarray  # sum of count + 1 in each class
    head: np.ndarray  # hashes of the most frequent tokens, ascending
    head_counts: np.ndarray
    tables: np.ndarray  # 3 x ROWS x CLASSES
    bias: np.ndarray
    cells: np.ndarray  # CLASSES x DIGIT x DIGIT: sum of count + 1 by class and digits
    word_bits: int
    words: np.ndarray | None = None  # 2 x 2**word_bits x 2 DIGIT: rows of the previous token and the one before

    def classes(self, t: Tokens) -> np.ndarray:
        """The class of each token, repeats aside."""
        out = self.cluster[(t.ending % np.uint64(ENDINGS)).astype(np.int64)]
        for k, h in enumerate(self.singles):
            out[t.hash == h] = k
        return out

    def context(self, t: Tokens, own: np.ndarray) -> np.ndarray:
        """3 x tokens: the rows of the feature tables."""
        bins = (t.ending >> np.uint64(20)).astype(np.int64) % ROWS
        one, two, three = (_shifted(own, k, t.place, CLASSES) for k in (1, 2, 3))
        mixed = mix64(((one * 64 + two) * 64 + three).astype(np.uint64)).astype(np.int64) & (ROWS - 1)
        return np.stack([_shifted(bins, 1, t.place, _START), _shifted(bins, 2, t.place, _START), mixed])

    def repeats(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        h = t.hash.view(np.int64)
        return _shifted(h, 1, t.place, 0) == h, _shifted(h, 2, t.place, 0) == h

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """tokens x classes."""
        logits = self.tables[0][rows[0]]
        logits += self.tables[1][rows[1]]
        logits += self.tables[2][rows[2]]
        logits += self.bias
        return logits

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """tokens x classes."""
        p = self.logits(rows)
        _shifted_exp(p)
        p /= (p @ _ONES[:CLASSES])[:, None]
        return p

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """tokens x classes, natural logarithms."""
        logits = self.logits(rows)
        p = logits.copy()
        shift = _shifted_exp(p)
        logits -= (shift + np.log(p @ _ONES[:CLASSES]))[:, None]
        return logits

    def word_rows(self, t: Tokens) -> np.ndarray:
        """2 x tokens: the hashed rows of the previous token and of the one before."""
        rows = (mix64(t.hash) >> np.uint64(64 - self.word_bits)).astype(np.int64)
        return np.stack([_shifted(rows, 1, t.place, _START), _shifted(rows, 2, t.place, _START)])

    def within(self, rows: np.ndarray, own: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log f / Z of each token, and the probabilities of both digits; ``own`` must be ascending."""
        logits = self.words[0][rows[0]]
        logits += self.words[1][rows[1]]
        n = len(own)
        k = np.arange(n)
        chosen = logits[k, digits[0]].astype(np.float64) + logits[k, DIGIT + digits[1]]
        first, second = logits[:, :DIGIT].copy(), logits[:, DIGIT:].copy()
        chosen -= _shifted_exp(first).astype(np.float64) + _shifted_exp(second)
        left, right = np.empty_like(first), np.empty_like(second)
        edges = [*np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), n] if n else []
        for a, b in zip(edges, edges[1:], strict=False):  # one class at a time
            mass = self.cells[own[a]]
            np.matmul(first[a:b], mass, out=right[a:b])
            np.matmul(second[a:b], mass.T, out=left[a:b])
        left *= first
        right *= second
        z = (right @ _ONES[:DIGIT]).astype(np.float64)
        scale = (1.0 / np.maximum(z, 1e-30))[:, None].astype(np.float32)
        return chosen - np.log(np.maximum(z, 1e-30)), left * scale, right * scale


def digits_of(hashes: np.ndarray) -> np.ndarray:
    """2 x tokens: the two digits of each hash (bits 8 to 11 and 12 to 15)."""
    return np.stack([hashes >> np.uint64(8), hashes >> np.uint64(12)]).astype(np.int64) & (DIGIT - 1)


def _step(weights: np.ndarray, squares: np.ndarray, index: np.ndarray, miss: np.ndarray, rate: float) -> None:
    """One Adagrad update of the rows that a batch uses."""
    kinds, slope = _sum_rows(index, miss)
    seen = squares[kinds]
    seen += slope * slope
    squares[kinds] = seen
    np.sqrt(seen, out=seen)
    slope *= rate
    slope /= seen
    weights[kinds] += slope


def _row_step(weights: np.ndarray, squares: np.ndarray, index: np.ndarray, miss: np.ndarray, rate: float) -> None:
    """The same with one accumulator a row: the rows of words are many, and mostly used a few times."""
    kinds, slope = _sum_rows(index, miss)
    seen = squares[kinds] + np.einsum("ij,ij->i", slope, slope) / slope.shape[1]
    squares[kinds] = seen
    slope *= (rate / np.sqrt(seen))[:, None]
    weights[kinds] += slope


def _learn(model: Model, rate: float = 0.4, word_rate: float = 0.2):
    """Adagrad over a partition's tokens; yields each table row with its use and use-weighted weights."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << model.word_bits
        words = np.zeros((2, size, 2 * DIGIT), np.float32)
        local = Model(**{**model.__dict__, "tables": model.tables.copy(), "bias": model.bias.copy(), "words": words})
        squares, used = np.full_like(local.tables, 1e-3), np.zeros((3, ROWS))
        word_squares, word_used = np.full((2, size), 1e-3, np.float32), np.zeros((2, size))
        bias_squares, seen = np.full(CLASSES, 1e-3, np.float32), 0
        for batch in steps(batches, "text"):
            t = read_tokens(*byte_view(batch.column(0)))
            own = local.classes(t)
            rows, word_rows, digits = local.context(t, own), local.word_rows(t), digits_of(t.hash)
            again, skip = local.repeats(t)
            target = np.where(again, REPEAT, np.where(skip, SKIP_REPEAT, own))
            for k in range(3):
                used[k] += np.bincount(rows[k], minlength=ROWS)
            seen += len(own)
            for at in range(0, len(own), BATCH):
                z = slice(at, at + BATCH)
                goal = target[z]
                miss = local.probabilities(rows[:, z])
                np.negative(miss, out=miss)
                miss[np.arange(len(goal)), goal] += 1.0
                for k in range(3):
                    _step(local.tables[k], squares[k], rows[k, z], miss, rate)
                slope = miss.sum(axis=0)
                bias_squares += slope * slope
                local.bias += rate * slope / np.sqrt(bias_squares)
                # the token within its class; classes of one token have nothing to learn there
                order = np.argsort(goal.astype(np.int8), kind="stable")
                order = order[slice(*np.searchsorted(goal[order], [SINGLES, REPEAT]))]
                if not len(order):
                    continue
                here, digit, n = word_rows[:, z][:, order], digits[:, z][:, order], np.arange(len(order))
                _, first, second = local.within(here, goal[order], digit)
                miss = np.concatenate([first, second], axis=1)
                np.negative(miss, out=miss)
                miss[n, digit[0]] += 1.0
                miss[n, DIGIT + digit[1]] += 1.0
                for k in range(2):
                    _row_step(words[k], word_squares[k], here[k], miss, word_rate)
                    word_used[k] += np.bincount(here[k], minlength=size)
        weights = np.concatenate([local.tables.reshape(-1, CLASSES), local.bias[None]])
        for start, table, use in ((0, weights, np.append(used.reshape(-1), seen)), (len(weights), words.reshape(-1, 2 * DIGIT), word_used.reshape(-1))):
            some = np.flatnonzero(use)
            for a in range(0, len(some), BATCH):
                part = some[a : a + BATCH]
                scaled = (table[part] * use[part, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(start + part, pa.int32()), pa.array(use[part]), *(pa.array(scaled[:, c]) for c in range(CLASSES))], ["row", "used", *(f"w{c}" for c in range(CLASSES))])

    return run


#: Bytes of text that one learner reads: each hands on its weights, however little it has read.
LEARNER_BYTES = 40 << 20


def _for_learners(texts: DataFrame) -> DataFrame:
    """The texts in fewer partitions where they are smaller than a learner's share; no rows are shuffled."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return texts.coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism, -(-size // LEARNER_BYTES)))


def train(texts: DataFrame) -> tuple[Model | None, DataFrame | None]:
    """Train on the column ``text``; returns the model and the counts (hash, n) of all tokens."""
    bounded_batches(texts.sparkSession)
    texts = _for_learners(texts.select("text"))
    counted = write_shared(texts.select("text").mapInArrow(_count, "hash long, bin int, n long, block binary"), "counted")
    counts = write_shared(counted.where("hash is not null").groupBy("hash").agg(F.sum("n").alias("n"), F.min("bin").alias("bin")), "counts")
    # at most ENDINGS x CELLS rows, whatever the corpus
    cell = F.shiftright("hash", 8).bitwiseAND(CELLS - 1).cast("int").alias("cell")
    by_cell = counts.groupBy("bin", cell).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    bin_of, cell_of, tokens_in, kinds_in = (by_cell[c].to_numpy() for c in ("bin", "cell", "n", "kinds"))
    total, kinds = int(tokens_in.sum()), int(kinds_in.sum())
    if not total:
        return None, None
    # the least count of the head: as many tokens as the limit allows, whole counts only
    least, within = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("kinds")).orderBy(F.desc("n")).toLocalIterator():
        if within + r["kinds"] > HEAD_LIMIT:
            break
        within, least = within + r["kinds"], r["n"]
    head = counts.where(F.col("n") >= least).select("hash", "n", "bin").toArrow() if least is not None else None
    hashes = head["hash"].to_numpy().view(np.uint64) if head is not None else np.zeros(0, np.uint64)
    number, bins = (head[c].to_numpy() for c in ("n", "bin")) if head is not None else (np.zeros(0, np.int64),) * 2
    order = np.argsort(hashes)
    hashes, number, bins = hashes[order], number[order], bins[order]
    top = np.argsort(-number, kind="stable")[:SINGLES]
    # partial sums first, so that no group grows with the number of partitions
    part = (F.abs(F.xxhash64(F.spark_partition_id())) % 64).cast("int").alias("part")
    blocks = counted.where("block is not null").select("bin", part, "block")
    for level in (64, 1):
        blocks = blocks.withColumn("part", F.col("part") % level).groupBy("bin", "part").applyInArrow(_sum_blocks, "bin int, part int, block binary")
    matrix = np.zeros((ENDINGS, BEFORE), np.int64)
    for r in blocks.collect():
        matrix[r["bin"]] = np.frombuffer(r["block"], np.int64)
    cluster = SINGLES + cluster_endings(matrix)
    # the cell's number has the second digit in its upper bits
    cells = np.bincount((cluster[bin_of] * DIGIT + cell_of % DIGIT) * DIGIT + cell_of // DIGIT, tokens_in + kinds_in, CLASSES * CELLS).reshape(CLASSES, DIGIT, DIGIT)
    for k, i in enumerate(top.tolist()):
        one, two = digits_of(hashes[i : i + 1])[:, 0]
        cells[k, one, two] = number[i] + 1
        cells[cluster[bins[i]], one, two] -= number[i] + 1
    mass = cells.sum(axis=(1, 2))
    start = np.log(np.maximum(mass, 1) / mass.sum()).astype(np.float32)
    start[[REPEAT, SKIP_REPEAT]] = np.log(1e-3)
    bits = min(WORD_BITS, max(12, kinds.bit_length()))
    model = Model(total, kinds, hashes[top], cluster, mass, hashes, number, np.zeros((3, ROWS, CLASSES), np.float32), start, cells.astype(np.float32), bits)
    columns = [f"w{c}" for c in range(CLASSES)]
    # the counts of the head are not needed here, so they do not travel with the task
    lean = Model(**{**model.__dict__, "head": np.zeros(0, np.uint64), "head_counts": np.zeros(0, np.int64)})
    learned = texts.select("text").mapInArrow(_learn(lean), "row int, used double, " + ", ".join(f"{c} float" for c in columns))
    learned = learned.groupBy("row").agg(F.sum("used").alias("used"), *(F.sum(c).alias(c) for c in columns)).select("row", *((F.col(c) / F.col("used")).cast("float").alias(c) for c in columns))
    learned = learned.toArrow()  # at most 3 ROWS + 1 + 2 * 2**WORD_BITS rows
    weights = np.zeros((3 * ROWS + 1 + (2 << bits), CLASSES), np.float32)
    at = learned["row"].to_numpy()
    for c, name in enumerate(columns):
        weights[at, c] = learned[name].to_numpy()
    model.tables, model.bias, model.words = weights[: 3 * ROWS].reshape(3, ROWS, CLASSES), weights[3 * ROWS], weights[3 * ROWS + 1 :].reshape(2, 1 << bits, 2 * DIGIT)
    return model, counts.select("hash", "n")


_SCORED = "key long, doc_id long, hash long, tokens long, fresh long, known long, base double, score double, repeats array<double>, draws array<double>"


def _score(load):
    """Two kinds of rows: with null hash a text's sums over head tokens, else a text's other tokens of one hash.

    The latter have the sum of the tokens that can only be drawn, and for each
    of their repeats its probability as a repeat and the factor of its draw.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = load()
        unknown = 1.0 / (model.total + model.kinds + 1)
        key = TaskContext.get().partitionId() << 33
        log_mass = np.log(np.maximum(model.mass, 1e-9))
        to_ten = 1.0 / np.log(10.0)
        for batch in steps(batches, "text"):
            t = read_tokens(*byte_view(batch.column(1)))
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(t.offsets))
            kinds, inverse = np.unique(t.hash, return_inverse=True)
            at = np.minimum(np.searchsorted(model.head, kinds), max(0, len(model.head) - 1))
            there = model.head[at] == kinds if len(model.head) else np.zeros(len(kinds), bool)
            count = np.where(there, model.head_counts[at] if len(model.head) else 0, 0)[inverse]
            known = there[inverse]
            own = model.classes(t)
            rows, word_rows, digits = model.context(t, own), model.word_rows(t), digits_of(t.hash)
            again, skip = model.repeats(t)
            score, repeats, draws = (np.empty(len(own)) for _ in range(3))
            for a in range(0, len(own), BATCH):
                z = slice(a, a + BATCH)
                mine = own[z]
                p, k = model.log_probabilities(rows[:, z]), np.arange(len(mine))
                drawn = p[k, mine].astype(np.float64)
                order = np.argsort(mine.astype(np.int8), kind="stable")
                alone = np.searchsorted(mine[order], SINGLES)
                drawn[order[:alone]] -= log_mass[mine[order[:alone]]]
                order = order[alone:]
                drawn[order] += model.within(word_rows[:, z][:, order], mine[order], digits[:, z][:, order])[0]
                with np.errstate(divide="ignore"):  # no repeat: log 0
                    repeat = np.logaddexp(np.where(again[z], p[k, REPEAT].astype(np.float64), -np.inf), np.where(skip[z], p[k, SKIP_REPEAT].astype(np.float64), -np.inf))
                # the frequency of a token of the tail is joined later
                whole = np.logaddexp(repeat, drawn + np.log(count[z] + 1.0))
                score[z] = np.where(known[z], whole, drawn) * to_ten
                repeats[z], draws[z] = np.exp(repeat) * (1.0 - unknown), np.exp(drawn) * (1.0 - unknown)
            score += np.log10(1.0 - unknown)
            sums = lambda x: np.bincount(row[known], x[known], n)
            base = np.log10((count + 1.0) * unknown)
            keys = key + np.arange(n)
            key += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0), pa.nulls(n, pa.int64()), pa.array(np.diff(t.offsets)), pa.array(np.zeros(n, np.int64)), pa.array(np.bincount(row[known], minlength=n)), pa.array(sums(base)), pa.array(sums(score)), *[pa.nulls(n, pa.list_(pa.float64()))] * 2],
                [c.split()[0] for c in _SCORED.split(", ")],
            )
            if (rest := np.flatnonzero(~known)).size:
                order = rest[np.lexsort((inverse[rest], row[rest]))]
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(inverse[order]) != 0)]))
                first = order[heads]
                add = lambda x: np.add.reduceat(x[order], heads)
                fresh = ~(again | skip)
                late = order[~fresh[order]]
                ends = pa.array(np.concatenate([[0], np.cumsum(add((~fresh).astype(np.int64)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[late])) for x in (repeats, draws)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row[first]]), pa.nulls(len(first), pa.int64()), pa.array(t.hash[first].view(np.int64)), pa.array(add(np.ones(len(row), np.int64))), pa.array(add(fresh.astype(np.int64))), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.float64()), pa.array(add(score * fresh)), *lists],
                    [c.split()[0] for c in _SCORED.split(", ")],
                )

    return run


def score(docs: DataFrame, model: Model | None, counts: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row; logs are decimal."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
        zero = F.lit(0.0)
        return source.select("doc_id", (F.size(words) + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = write_shared(source.mapInArrow(_score(lambda: sent.value), _SCORED), "scored")
    unknown = 1.0 / (model.total + model.kinds + 1)
    tail = scored.where("hash is not null").select("key", "hash", "tokens", "fresh", "score", "repeats", "draws").join(counts, "hash", "left")
    one = F.log10(F.coalesce("n", F.lit(0)) + 1.0)
    repeated = F.zip_with("repeats", "draws", lambda r, d: F.log10(F.greatest(r + d * (F.col("n") + 1), F.lit(1e-300))))
    late = F.aggregate(repeated, F.lit(0.0), lambda a, x: a + x)
    tail = tail.groupBy("key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tokens")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tokens") * (one + float(np.log10(unknown)))).alias("more_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("score") + F.col("fresh") * one + late).otherwise(F.col("tokens") * float(np.log10(unknown)))).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    joined = scored.where("hash is null").select("key", "doc_id", F.col("tokens").alias("n_tokens"), "known", "base", F.col("score").alias("own")).join(tail, "key", "left")
    return joined.select("doc_id", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("own", "more_score").alias("score"))
