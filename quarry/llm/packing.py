"""Hierarchical packing of documents into windows of several context sizes.

Every document becomes its token ids and one end id.  Whole windows of the
longest size are cut off first; the rest is routed to the smallest tier (window
size) that holds it.  Tiers are packed from long to short.  A window opens with
one document of its tier; its gap takes whole documents of shorter tiers, best
fit first, and what then remains is filled by cutting one more short document,
whose rest is routed anew.  So every window is exactly full.  At a partition's
end, a document that finds no filler is cut at the next shorter tier, and the
last few tokens are cut at powers of two, so nothing is padded.

Sequences of one size are dealt into step groups of exactly ``group_tokens``
tokens.  What is left of all sizes at a partition's end is dealt, longest first,
into groups of as many tokens; so every step group is equal but one a partition,
the last, which holds the rest.  Packing needs no exchange of rows: each partition
packs its own documents with at most ``buffer_tokens`` waiting, so the plan is
the same at every size and a lost task only repeats its own partition.

Null texts count as empty (the end id alone is packed).  Rows with a null id
are packed too; repeated rows are packed once for each row.  An empty table has
no pieces.  Of pieces that fill a gap equally well the latest is taken.  A very
long document streams through as whole windows.  Only the named columns are read.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import byte_symbols, default_path
from quarry.llm.common import bounded_batches, steps, texts_of

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: How the byte-level tokenizer cuts a text into pieces (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class ByteIds:
    """Ids of the byte-level tokenizer file, the same that the tokenizers library gives for it.

    The file's merges are in the order of their ids, so its vocabulary serves
    as ranks for tiktoken, which encodes whole texts several times as fast.
    Special tokens in a text are special here as there.  Should tiktoken give
    up on a text, the tokenizers library encodes it.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.path = path

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except BaseException as error:
            if type(error).__name__ != "PanicException":
                raise
        from tokenizers import Tokenizer

        return array("I", Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids).tobytes()


@functools.cache
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


class Packer:
    """Packs the documents of one partition; ``add`` and ``finish`` yield full sequences.

    A sequence is (size, pieces); a piece is (doc_id, start, ids as bytes, doc_tokens).
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = 512 * 1024) -> None:
        self.tiers, self.longest, self.buffer = tuple(sorted(tiers)), max(tiers), buffer_tokens
        #: For each tier the waiting pieces, sorted by length.
        self.waiting: list[list[tuple]] = [[] for _ in self.tiers]
        self.tokens = self.serial = 0

    def _route(self, doc_id, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        if n:
            self.serial += 1
            insort(self.waiting[bisect_left(self.tiers, n)], (n, self.serial, doc_id, start, ids, total))
            self.tokens += n

    def _take(self, tier: int, at: int) -> tuple:
        item = self.waiting[tier].pop(at)
        self.tokens -= item[0]
        return item

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, step, at = len(ids) // 4, 4 * self.longest, 0
        while len(ids) - at >= step:
            yield self.longest, [(doc_id, at // 4, ids[at : at + step], total)]
            at += step
        self._route(doc_id, at // 4, ids[at:], total)
        if self.tokens >= self.buffer:
            yield from self._pack(last=False)

    def _filler(self, gap: int, below: int) -> tuple | None:
        """The longest waiting piece that fits the gap, from tiers up to ``below``; else a piece to cut."""
        for tier in range(below, -1, -1):
            if at := bisect_right(self.waiting[tier], gap, key=lambda x: x[0]):
                return self._take(tier, at - 1)
        for tier in range(below + 1):
            if self.waiting[tier]:
                n, _, doc_id, start, ids, total = self._take(tier, len(self.waiting[tier]) - 1)
                self._route(doc_id, start + gap, ids[4 * gap :], total)
                return gap, 0, doc_id, start, ids[: 4 * gap], total
        return None

    def _pack(self, last: bool) -> Iterator[tuple]:
        for tier in range(len(self.tiers) - 1, -1, -1):
            size, below, held = self.tiers[tier], max(tier - 1, 0), []
            while self.waiting[tier]:
                pieces = [self._take(tier, len(self.waiting[tier]) - 1)]
                gap = size - pieces[0][0]
                while gap and (more := self._filler(gap, below)):
                    pieces.append(more)
                    gap -= more[0]
                if not gap:
                    yield size, [p[2:] for p in pieces]
                elif not last:
                    held += pieces
                    break
                else:
                    yield from self._cut(pieces, size)
            for _, _, *piece in held:
                self._route(*piece)

    def _cut(self, pieces: list[tuple], size: int) -> Iterator[tuple]:
        """No filler is left: cut what there is at the greatest power of two that it fills."""
        while pieces:
            filled = sum(p[0] for p in pieces)
            size = 1 << (filled.bit_length() - 1)
            out, left, room = [], [], size
            for n, serial, doc_id, start, ids, total in pieces:
                here = min(n, room)
                room -= here
                if here:
                    out.append((doc_id, start, ids[: 4 * here], total))
                if here < n:
                    left.append((n - here, serial, doc_id, start + here, ids[4 * here :], total))
            yield size, out
            pieces = left

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(last=True)


class StepGroups:
    """Deals sequences into numbered groups of ``tokens`` tokens; an open group waits for each size."""

    def __init__(self, tokens: int) -> None:
        self.tokens, self.count = tokens, 0
        self.open: dict[int, list] = {}

    def _close(self, group: list) -> tuple[int, list]:
        self.count += 1
        return self.count - 1, group

    def add(self, size: int, sequence) -> Iterator[tuple[int, list]]:
        group = self.open.setdefault(size, [])
        group.append(sequence)
        if (len(group) + 1) * size > self.tokens:
            yield self._close(self.open.pop(size))

    def finish(self) -> Iterator[tuple[int, list]]:
        """The rest, longest first: where each size divides the next, all these groups but the last are full too."""
        group, held = [], 0
        for size, sequences in sorted(self.open.items(), reverse=True):
            for sequence in sequences:
                if held + size > self.tokens:
                    yield self._close(group)
                    group, held = [], 0
                group.append(sequence)
                held += size
        if group:
            yield self._close(group)
        self.open = {}


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = 16 * 2048,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it comes from in its document and where it lies in its sequence.

    ``sequence_tokens`` is the sequence's size, ``step_group`` the group of
    ``group_tokens`` tokens that it is trained in.  ``keep_ids`` adds the ids.
    """
    path = path or default_path("byte_bpe_50k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = byte_ids(path), Packer(tiers), array("I", [END_ID]).tobytes()
        base = TaskContext.get().partitionId() << 33
        count = 0
        rows: list[tuple] = []
        balance = StepGroups(group_tokens)

        def describe(sequence: tuple) -> list[list]:
            """The rows of a sequence, still without their step group."""
            nonlocal count
            size, pieces = sequence
            at, out = 0, []
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                out.append([doc_id, start, n, zlib.crc32(ids), total, base + count, at, size, None, array("I", ids).tolist() if keep_ids else None])
                at += n
            count += 1
            return out

        def deal(groups: Iterable[tuple[int, list]]) -> None:
            for number, group in groups:
                for row in itertools.chain.from_iterable(group):
                    row[8] = base + number
                    rows.append(row)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
            rows.clear()
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in columns[:9]]
            if keep_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[9], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in steps(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for sequence in packer.add(doc_id, encoder.encode(text) + end):
                    deal(balance.add(sequence[0], describe(sequence)))
            yield flush()
        for sequence in packer.finish():
            deal(balance.add(sequence[0], describe(sequence)))
        deal(balance.finish())
        yield flush()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COLUMNS + (", ids array<int>" if keep_ids else ""))
