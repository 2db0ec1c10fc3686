"""Byte-pair encoding and decoding from a tokenizer file.

A word becomes a doubly linked list of symbols.  A priority queue holds the
merge rank of every adjacent pair; the least rank (leftmost at ties) is popped,
entries whose pair no longer stands at that place are skipped as stale, and the
neighbours of a merged symbol are queued anew: n log n in the word's length.
Decoding concatenates the vocabulary's strings.

Words repeat, so each Python worker remembers the words it has encoded (a
bounded memo, emptied when full; results do not depend on it).  Texts are
encoded whole, whatever their length; null counts as empty; repeated rows give
equal results, rows with null ids too.  An empty table gives an empty one.  Of
pairs of equal rank the leftmost merges first; vocabularies have no other ties.
Only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches

#: Code points with the White_Space property (fixed values).
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most words that a worker remembers.
MEMO_WORDS = 400_000


#: Letters and numbers that came with Unicode 16, which the tokenizers library knows and
#: ``unicodedata`` does not yet (fixed values).
NEW_LETTERS = "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
NEW_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"


@functools.cache
def category_class(major: str) -> str:
    """The inside of a character class: all code points whose general category starts with ``major``."""
    out, start = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point)).startswith(major)
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(out)


def _split_pattern(letters: str, numbers: str) -> str:
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+"


#: Lower-case partners of capitals that are newer than ``unicodedata``; the library knows them
#: (fixed values: first capital, last capital, first partner, step).
NEW_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A, 1),
    (0xA7CB, 0xA7CB, 0x0264, 1),
    (0xA7CC, 0xA7CE, 0xA7CD, 2),
    (0xA7D2, 0xA7D4, 0xA7D3, 2),
    (0xA7DA, 0xA7DA, 0xA7DB, 1),
    (0xA7DC, 0xA7DC, 0x019B, 1),
    (0x10D50, 0x10D65, 0x10D70, 1),
    (0x16EA0, 0x16EB8, 0x16EBB, 1),
)
LOWER_TABLE = {c: to + c - first for first, last, to, step in NEW_LOWER for c in range(first, last + 1, step)}

#: Marks and compositions that came after Unicode 9, which the library's NFC does not know: nothing
#: moves past or merges with them (fixed values).
LATE_MARKS = "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U00011938\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
_LATE_MARK = re.compile(f"([{LATE_MARKS}])")


@functools.cache
def usual_pattern() -> regex.Pattern:
    """Splits lower-cased text as the word-end vocabulary does; white space falls away."""
    return regex.compile(_split_pattern(r"\p{L}", r"\p{N}"))


@functools.cache
def exact_pattern() -> re.Pattern:
    """The same with the library's classes spelt out, for texts with newer code points."""
    return re.compile(_split_pattern(category_class("L") + NEW_LETTERS, category_class("N") + NEW_NUMBERS))


def is_newer(point: str) -> bool:
    """Does ``unicodedata`` see this code point otherwise than the library: unassigned, or a late mark?"""
    return unicodedata.category(point) == "Cn" or _LATE_MARK.match(point) is not None


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the rest are numbered on from 256.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges in order of rank; ``merges`` maps a pair to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(*merges[pair], at) for at, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in merges]
    heapq.heapify(queue)
    while queue:
        rank, merged, at = heapq.heappop(queue)
        right = after[at]
        if symbols[at] < 0 or right >= n or merges.get((symbols[at], symbols[right])) != (rank, merged):
            continue  # stale: one of the two has been merged meanwhile
        symbols[at], symbols[right] = merged, -1
        beyond = after[at] = after[right]
        if beyond < n:
            before[beyond] = at
            if found := merges.get((merged, symbols[beyond])):
                heapq.heappush(queue, (*found, at))
        left = before[at]
        if left >= 0 and (found := merges.get((symbols[left], merged))):
            heapq.heappush(queue, (*found, left))
    return [s for s in symbols if s >= 0]


class _Memo(dict):
    """Encoded words (little-endian ids); emptied when it is full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = ids = array("I", self.encode(word)).tobytes()
        return ids


class WordBpe:
    """The tokenizer with word ends: NFC, lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in (self.vocab | self.specials).items()}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.inner = [self.vocab[s] for s in byte_symbols()]
        self.last = [self.vocab[s + self.suffix] for s in byte_symbols()]
        self.memo = _Memo(self.encode_word)
        self.usual = usual_pattern()
        #: Code points that have been seen and are not newer; it never outgrows Unicode.
        self.seen: set[str] = set()

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return merge_symbols([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]], self.merges)

    def has_newer(self, text: str) -> bool:
        """Looks at code points that no text before has had; one pass over the text's distinct ones."""
        fresh = set(text) - self.seen
        newer = {c for c in fresh if is_newer(c)}
        self.seen |= fresh - newer
        return bool(newer)

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case, for texts without newer code points."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # code point by code point: a capital sigma never takes its final form
        return text.replace("Σ", "σ").lower()

    def normalise_newer(self, text: str) -> str:
        """The same with newer code points: late marks stand between what NFC may join."""
        return "".join(self.normalise(part) for part in _LATE_MARK.split(text)).translate(LOWER_TABLE)

    def _plain(self, text: str) -> bytes:
        memo = self.memo
        if text.isascii():
            words = self.usual.findall(text.lower())
        elif self.has_newer(text):
            words = exact_pattern().findall(self.normalise_newer(text))
        else:
            words = self.usual.findall(self.normalise(text))
        return b"".join([memo[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return b"".join(array("I", [self.specials[p]]).tobytes() if p in self.specials else self._plain(p) for p in self.special.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary strings of the ids; the file names no decoder, so a space stands between."""
        strings = self.strings
        return b" ".join([strings[i] for i in array("I", ids)])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One tokenizer for each Python worker and file."""
    return WordBpe(path)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row."""
    path = path or default_path()
    kept = ", ids array<int>, decoded string" if keep else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = bpe.encode(text or "")
                decoded = bpe.decode(raw)
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if keep:
                    ids.append(array("I", raw).tolist())
                    texts.append(decoded.decode("utf-8"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if keep:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")
