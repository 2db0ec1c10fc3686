"""Embedding chunks and questions.

An embedder is anything with ``dimension`` and ``encode(texts) -> array``; it is
made once for each Python worker.  The default hashes words and character
trigrams into signed buckets, so it needs no model files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import class_name


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and character trigrams, L2-normalised.

    A gram's MD5 gives its place (the first four hex digits, modulo the dimension) and its
    sign (the fifth), so any engine can make the same vectors.
    """

    def __init__(self, dimension: int = 256) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                for gram in [word, *(word[k : k + 3] for k in range(len(word) - 2))]:
                    digest = hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()
                    out[row, (digest[0] << 8 | digest[1]) % self.dimension] += 1.0 if digest[2] & 0x80 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


#: Strategy of each chunk type (fixed values).
STRATEGIES = {"class_complete": "class", "class_definition": "class", "class_declaration": "class", "function_definition": "function", "method": "function", "function_declaration": "function", "method_declaration": "function", "docstring": "documentation", "comment": "documentation", "imports": "imports", "overlap": "overlap"}


def strategy(chunk_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])[chunk_type], F.lit("general"))


def embedding_text(chunk_type: Column, language: Column, path: Column, content: Column) -> Column:
    """What is embedded: strategy, language, file name and class name ahead of the content."""
    name = class_name(content)
    return F.concat_ws(" | ", F.concat(F.lit("type: "), strategy(chunk_type)), F.concat(F.lit("language: "), language), F.concat(F.lit("file: "), F.element_at(F.split(path, "/"), -1)), F.when(name != "", F.concat(F.lit("class: "), name)), content)


def class_structure(content: Column) -> Column:
    """Name, methods (without underscored ones, but for three) and bases of a Python class."""
    methods = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]+(?:async )?def ([A-Za-z_]\w*)"), 1)
    shown = F.filter(methods, lambda m: ~F.startswith(m, F.lit("__")) | m.isin("__init__", "__str__", "__call__"))
    bases = F.filter(F.transform(F.split(F.regexp_extract(content, r"class \w+\(([^)]*)\)", 1), ","), lambda b: F.trim(b)), lambda b: b != "")
    return F.struct(class_name(content).alias("name"), shown.alias("methods"), bases.alias("bases"))


def function_structure(content: Column) -> Column:
    """Name, parameters (types and defaults left out, without self) and the annotated return type or ``value``."""
    raw = F.split(F.regexp_extract(content, r"def \w+\(([^)]*)\)", 1), ",")
    names = F.transform(raw, lambda p: F.trim(F.regexp_replace(p, "[:=].*", "")))
    returns = F.trim(F.regexp_extract(content, r"\)\s*->\s*([^:\n]+):", 1))
    return F.struct(F.regexp_extract(content, r"def (\w+)", 1).alias("name"), F.filter(names, lambda p: ~p.isin("", "self", "cls")).alias("parameters"), F.when(returns != "", returns).otherwise("value").alias("returns"))


def import_structure(content: Column) -> Column:
    """Modules that are imported, and names imported from them."""
    plain = F.regexp_extract_all(content, F.lit(r"(?m)^import ([\w.]+)"), 1)
    modules = F.regexp_extract_all(content, F.lit(r"(?m)^from ([\w.]+) import"), 1)
    names = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^from [\w.]+ import ([^\n]+)"), 1), lambda x: F.transform(F.split(x, ","), lambda n: F.trim(n))))
    return F.struct(F.array_sort(F.array_distinct(F.concat(plain, modules))).alias("modules"), F.array_sort(F.array_distinct(names)).alias("names"))


#: Declarations by language, for chunks that no parser has read (fixed values).
SYMBOL_PATTERNS = {
    "py": [r"(?m)^\s*class\s+(\w+)", r"(?m)^\s*(?:async\s+)?def\s+(\w+)"],
    "js": [r"class\s+(\w+)", r"function\s+(\w+)", r"(?:const|let|var)\s+(\w+)\s*="],
    "java": [r"(?:class|interface|enum)\s+(\w+)", r"(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("],
}


def symbols_by_pattern(content: Column, language: Column) -> Column:
    """Names that a chunk declares, in order; TypeScript counts as JavaScript, other languages give none."""
    found = {k: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), 1) for p in ps]))) for k, ps in SYMBOL_PATTERNS.items()}
    return F.when(language == "py", found["py"]).when(language.isin("js", "ts", "jsx", "tsx"), found["js"]).when(language == "java", found["java"]).otherwise(F.array().cast("array<string>"))


def parent_summary(chunk_type: Column, content: Column) -> Column:
    """One line about an enclosing class, or the first line of anything else."""
    shape = class_structure(content)
    return F.when(strategy(chunk_type) == "class", F.concat(F.lit("class "), shape["name"], F.lit(" with "), F.array_join(shape["methods"], ", "))).otherwise(F.get(F.split(content, "\n"), F.lit(0)))


def keyword_density(content: Column, keywords: list[str]) -> Column:
    """Keyword hits for each word of the content."""
    words = F.filter(F.split(content, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(keywords)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def embed(rows: DataFrame, text: Column, make: Callable[[], Embedder] = HashingEmbedder, out: str = "embedding") -> DataFrame:
    """Adds the embedding of ``text``; null texts get null."""
    source = rows.withColumn("_text", text)
    at = source.columns.index("_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            vectors = embedder.encode([t or "" for t in texts])
            values = pa.array([None if t is None else v.tolist() for t, v in zip(texts, vectors, strict=True)], pa.list_(pa.float32()))
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, values], [*[n for k, n in enumerate(batch.schema.names) if k != at], out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return source.mapInArrow(run, f"{fields}, `{out}` array<float>")


def embedding_contexts(chunks: DataFrame, parent_of: DataFrame, sibling_of: DataFrame, most: int = 3) -> DataFrame:
    """(id, parent_content, sibling_contents): what stands around a chunk, at most ``most`` siblings by id."""
    content = chunks.select("id", "content")
    parent = parent_of.join(content.select(F.col("id").alias("parent_id"), F.col("content").alias("parent_content")), "parent_id").select("id", "parent_content")
    first = sibling_of.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("sibling_id"))).where(F.col("_n") <= most)
    shown = first.join(content.select(F.col("id").alias("sibling_id"), F.col("content").alias("c")), "sibling_id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sibling_id", "c"))), lambda x: x["c"]).alias("sibling_contents"))
    return chunks.select("id").join(parent, "id", "left").join(shown, "id", "left")


def blend(chunk: Column, parent: Column, share: float = 0.05) -> Column:
    """A chunk's vector with a little of its parent's."""
    return F.when(parent.isNull(), chunk).otherwise(F.zip_with(chunk, parent, lambda x, y: (1 - share) * x + share * y))
