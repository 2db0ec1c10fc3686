"""The engine: index a code base, answer questions with a ranked, packed context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions.text import estimated_tokens
from quarry.operators import code, embedding, retrieval
from quarry.sources.chunk_table import ChunkTable, coerced
from quarry.sources.files import INDEX_EXTENSIONS, read_files


@dataclass
class Engine:
    """``index`` fills the chunk table, ``query`` reads it.  The embedder is exchangeable."""

    spark: SparkSession
    path: str
    make_embedder: Callable[[], embedding.Embedder] = field(default=embedding.HashingEmbedder)

    @property
    def table(self) -> ChunkTable:
        return ChunkTable(self.spark, self.path)

    def index(self, project_path: str, extensions: tuple[str, ...] = INDEX_EXTENSIONS, rebuild: bool = True) -> dict:
        """Reads, cuts, embeds and upserts a project's files; returns counts."""
        files = read_files(self.spark, project_path, extensions, project=project_path)
        chunks = code.chunk_files(files)
        text = embedding.embedding_text(F.col("chunk_type"), F.col("language"), F.col("file_path"), F.col("content"))
        embedded = embedding.embed(chunks, text, self.make_embedder)
        if rebuild:
            self.table.delete_project(project_path)
        self.table.upsert(coerced(embedded))
        row = self.table.read().where(F.col("project_path") == project_path).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), F.count("embedding").alias("embedded")).first()
        return row.asDict()

    def _asked(self, question: str) -> DataFrame:
        vector = [float(x) for x in self.make_embedder().encode([question])[0]]
        return self.spark.createDataFrame([(0, question, vector)], "question long, query string, vector array<float>")

    def _embed(self, more: DataFrame) -> DataFrame:
        return embedding.embed(more, F.col("query"), self.make_embedder, "vector")

    def _rows(self, project_path: str | None) -> DataFrame:
        return self.table.read([project_path] if project_path else None)

    def retrieve(self, question: str, project_path: str | None = None, top_k: int = 10) -> DataFrame:
        """Nearest chunks, with related ones of their files, re-ranked by words and by what the question is."""
        return retrieval.retrieve(self._asked(question), self._rows(project_path), top_k).orderBy("ord")

    def multi_stage(self, question: str, project_path: str | None = None, top_k: int = 10) -> DataFrame:
        """(id, score, sightings): exact-symbol, semantic and broader stages fused by id, best first."""
        return retrieval.multi_stage(self._asked(question), self._rows(project_path), top_k, self._embed).orderBy("ord").select("id", "score", "sightings")

    def boosted(self, question: str, activity_state: DataFrame, now, project_path: str | None = None, top_k: int = 10) -> DataFrame:
        """Twice the results, re-scored by recent work on their files (clamped), the best ``top_k``.

        ``activity_state`` has file_path, last_edited, last_opened and edit_frequency.
        """
        return retrieval.boosted(self._asked(question), self._rows(project_path), activity_state, now, top_k).orderBy("ord")

    def query(self, question: str, project_path: str | None = None, max_tokens: int = 8000, top_k: int = 10, expand: bool = False, level: str | None = None, seen: DataFrame | None = None) -> DataFrame:
        """One row: the packed context, its tokens and the number of chunks in it.

        ``level`` widens budget and results and adds what that level of expansion finds;
        ``expand`` shows the lines round each result; ``seen`` ids are left out.
        """
        asked, rows = self._asked(question), self._rows(project_path)
        if level is not None:
            max_tokens, top_k = Q.expansion_parameters(max_tokens, top_k, level)
            more = retrieval.expanded(asked, rows, top_k, level, self._embed).where(F.col("ord") <= top_k)
            found = more.join(rows.select("id", "file_path", "chunk_type", "start_line", "end_line", "content"), "id")
        else:
            found = retrieval.retrieve(asked, rows, top_k)
        files = read_files(self.spark, project_path, INDEX_EXTENSIONS, project=project_path) if expand and project_path else None
        packed = retrieval.packed(found, max_tokens, files, seen)
        return packed.select(F.lit(question).alias("question"), "context", "tokens", "chunks", F.lit(top_k).alias("top_k"))

    def context(self, project_path: str, question: str | None = None, max_tokens: int = 8000) -> DataFrame:
        """Whole files of a project by size and name within the budget, or those a question's words occur in."""
        files = read_files(self.spark, project_path, INDEX_EXTENSIONS, project=project_path)
        if question:
            terms = F.array(*[F.lit(w) for w in question.lower().split()] or [F.lit("")])
            files = files.where(F.exists(terms, lambda t: F.contains(F.lower("content"), t)))
        tokens = F.sum(estimated_tokens(F.col("content"))).over(Window.partitionBy("project_path").orderBy("file_path").rowsBetween(Window.unboundedPreceding, 0))
        return files.withColumn("running", tokens).where(F.col("running") <= max_tokens)

    def health(self) -> dict:
        return self.table.health()
