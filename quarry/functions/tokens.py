"""Exact token counts with a tokenizer file, where the estimate will not do."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.session import bounded_batches

#: Characters that are encoded at once: what the library makes of a text is a hundred times as large.
STEP_CHARS = 1 << 18
#: Where a byte-level tokenizer always cuts: before a space that follows a letter or digit.
_CUT = re.compile(r"(?<=\w) ")


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _cuts_at_spaces(path: str) -> bool:
    """Whether the tokenizer sees a text and its parts, cut as by ``_CUT``, alike: the byte-level pattern, and nothing beside it that looks across spaces."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = [t for t in spec.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])]
    return plain and not added and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))


def _pieces(text: str, cut: bool, limit: int) -> Iterator[str]:
    """The whole text in parts of about ``limit`` characters that the tokenizer would part there too."""
    start = 0
    while cut and len(text) - start > limit and (found := _CUT.search(text, start + limit)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def count_tokens(texts: list[str | None], path: str, limit: int = STEP_CHARS) -> list[int]:
    """Tokens of each text; at most about ``limit`` characters, or one text that cannot be parted, are encoded at once."""
    counts, owners, held, size = [0] * len(texts), [], [], 0

    def encode() -> None:
        for k, found in zip(owners, _tokenizer(path).encode_batch_fast(held, add_special_tokens=False), strict=True):
            counts[k] += len(found)
        owners.clear()
        held.clear()

    cut = _cuts_at_spaces(path)
    for k, text in enumerate(texts):
        for piece in _pieces(text or "", cut, limit):
            if held and size + len(piece) > limit:
                encode()
                size = 0
            owners.append(k)
            held.append(piece)
            size += len(piece)
    encode()
    return counts


def with_token_counts(rows: DataFrame, text: str, path: str, out: str = "tokens") -> DataFrame:
    """Adds the number of tokens of ``text``; null texts have none.  One tokenizer a worker, batches and steps bounded by their texts."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_tokens(batch.column(batch.schema.get_field_index(text)).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{out}` long")
