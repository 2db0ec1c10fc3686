"""Source files as a DataFrame: recursive scans by extension, tolerant decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read by default, by purpose (fixed values).
CODE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".kt", ".go", ".scala", ".json", ".md")
INDEX_EXTENSIONS = (".py", ".js", ".ts", ".java", ".kt", ".go", ".scala")
EMBED_EXTENSIONS = (".py", ".java", ".kt", ".js", ".ts")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, malformed bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_files(spark: SparkSession, directory: str, extensions: tuple[str, ...] = CODE_EXTENSIONS, ignore: tuple[str, ...] = (), most_bytes: int | None = None, project: str | None = None) -> DataFrame:
    """(file_path, project_path, content, length) of all files below ``directory`` with one of the extensions.

    Unreadable files are skipped, files over ``most_bytes`` and paths with one
    of the ``ignore`` parts left out.  A file that several patterns match is read once.
    """
    pattern = "*{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(directory)
    if most_bytes is not None:
        found = found.where(F.col("length") <= most_bytes)
    for part in ignore:
        found = found.where(~F.contains("path", F.lit(part)))
    path = F.regexp_replace("path", "^file:/*", "/")
    return found.select(path.alias("file_path"), F.lit(project or directory).alias("project_path"), decoded(F.col("content")).alias("content"), "length")


def language(path: Column) -> Column:
    """The file's suffix without the dot; ``text`` where it has none."""
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.when(suffix == "", "text").otherwise(F.lower(suffix))


def common_directory(files: DataFrame, path: str = "file_path") -> str:
    """The longest directory that all files share; only the least and the greatest path are compared."""
    row = files.agg(F.min(path).alias("a"), F.max(path).alias("b")).first()
    if row["a"] is None:
        return ""
    shared = []
    for x, y in zip(row["a"].split("/")[:-1], row["b"].split("/")[:-1], strict=False):
        if x != y:
            break
        shared.append(x)
    return "/".join(shared)
