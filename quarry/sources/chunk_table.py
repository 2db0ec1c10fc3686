"""A keyed chunk table on Parquet: upsert, delete, scan, statistics.

A table is a folder of data folders, each partitioned by project, and numbered
manifests that say which projects are read from which data folder.  A write
makes a data folder for the projects it touches and then a new manifest, so other
projects' files are left alone, nobody sees half a write, and a failed job leaves
the last manifest in place.  The last ``keep`` manifests' data stay, so a table that
was read earlier can still be used.  There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import write_scratch

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("project_path", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("chunk_type", T.StringType(), False),
        T.StructField("start_byte", T.IntegerType()),
        T.StructField("end_byte", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def coerced(rows: DataFrame) -> DataFrame:
    """Any rows as chunks: missing columns and nulls become the schema's defaults."""
    defaults = {"project_path": F.lit(""), "start_byte": F.lit(0), "end_byte": F.lit(0), "start_line": F.lit(0), "end_line": F.lit(0), "content": F.lit(""), "language": F.lit("text"), "chunk_type": F.lit("text"), "file_path": F.lit("")}
    out = []
    for f in CHUNK_SCHEMA.fields:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        value = value.cast(f.dataType)
        if f.name == "id":
            value = F.coalesce(F.nullif(value, F.lit("")), F.expr("uuid()"))
        elif f.name in defaults:
            value = F.coalesce(value, defaults[f.name].cast(f.dataType))
        elif f.name in ("created_at", "updated_at"):
            value = F.coalesce(value, F.current_timestamp())
        out.append(value.alias(f.name))
    return rows.select(*out)


def latest_by_id(rows: DataFrame, order: str | None = None) -> DataFrame:
    """The last row of each id, by ``order`` or by updated_at."""
    at = F.col(order) if order else F.col("updated_at")
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), at).alias("_row")).select("_row.*")


def upserted(current: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """``current`` with the batch's rows replacing those of the same id; rows without an embedding are skipped."""
    new = latest_by_id(coerced(batch.where("embedding is not null and size(embedding) > 0")), order)
    kept = current.join(new.select("id"), "id", "left_anti")
    dated = current.select("id", F.col("created_at").alias("_first"))
    stamped = new.join(dated, "id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).withColumn("updated_at", F.current_timestamp()).drop("_first")
    return kept.unionByName(stamped)


def as_points(chunks: DataFrame) -> DataFrame:
    """(id, vector, payload): chunks as rows of a vector service."""
    payload = [c for c in chunks.columns if c not in ("id", "embedding")]
    return chunks.select("id", F.col("embedding").alias("vector"), F.struct(*payload).alias("payload"))


def from_points(points: DataFrame) -> DataFrame:
    return coerced(points.select("id", F.col("vector").alias("embedding"), "payload.*"))


#: Data folders from which a table is written anew as one.
COMPACT_AT = 24
_MANIFEST = "m-"


@dataclass
class ChunkTable:
    """A table at ``path``; every method reads or makes a version."""

    spark: SparkSession
    path: str
    keep: int = 3

    # ---- manifests

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path(self.path))]
        return sorted(n for n in names if n.startswith(_MANIFEST) and n.endswith(".json"))

    def _load(self, name: str) -> list[dict]:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _parts(self) -> list[dict]:
        """The newest manifest: data folders with the projects that are read from each."""
        names = self._manifests()
        return self._load(names[-1]) if names else []

    def _commit(self, parts: list[dict]) -> None:
        names = self._manifests()
        number = int(names[-1][len(_MANIFEST) : -len(".json")]) + 1 if names else 0
        fs, path = self._fs()
        draft, final = path(f"{self.path}/draft-{number}"), path(f"{self.path}/{_MANIFEST}{number:012d}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        fs.rename(draft, final)
        held = [*names, f"{_MANIFEST}{number:012d}.json"]
        used = {p["folder"] for name in held[-self.keep :] for p in self._load(name)}
        for name in held[: -self.keep]:
            for part in self._load(name):
                if part["folder"] not in used:
                    fs.delete(path(f"{self.path}/{part['folder']}"), True)
            fs.delete(path(f"{self.path}/{name}"), False)

    # ---- reading

    def create(self) -> None:
        """An empty table, if there is none yet."""
        if not self.exists():
            self._commit([])

    def exists(self) -> bool:
        return bool(self._manifests())

    def projects(self) -> list[str]:
        return sorted({p for part in self._parts() for p in part["projects"]})

    def read(self, projects: list[str] | None = None) -> DataFrame:
        """All rows, or those of some projects: only their files are listed and read."""
        found = None
        for part in self._parts():
            wanted = part["projects"] if projects is None else [p for p in part["projects"] if p in projects]
            if wanted:
                rows = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.path}/{part['folder']}")
                # an empty name is stored as null
                rows = rows.withColumn("project_path", F.coalesce("project_path", F.lit("")))
                rows = rows if set(wanted) == set(part["written"]) else rows.where(F.col("project_path").isin(wanted))
                found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], CHUNK_SCHEMA) if found is None else found

    # ---- writing

    def _written(self, rows: DataFrame) -> dict:
        folder = f"d-{uuid.uuid4().hex}"
        place = f"{self.path}/{folder}"
        rows.select(*[f.name for f in CHUNK_SCHEMA.fields]).write.partitionBy("project_path").parquet(place)
        names = self.spark.read.schema(CHUNK_SCHEMA).parquet(place).select(F.coalesce("project_path", F.lit("")).alias("p")).distinct().collect()
        projects = sorted(r["p"] for r in names)
        return {"folder": folder, "projects": projects, "written": projects}

    def write(self, rows: DataFrame) -> None:
        """Replaces all that the table holds."""
        part = self._written(rows)
        self._commit([part] if part["projects"] else [])

    def replace(self, projects: list[str], rows: DataFrame) -> None:
        """Replaces all rows of ``projects`` by ``rows``, which belong to them; other projects' files are left alone."""
        parts = self._parts()
        if len(parts) >= COMPACT_AT:
            self.write(self.read([p for p in self.projects() if p not in set(projects)]).unionByName(rows))
            return
        gone = set(projects)
        kept = [part | {"projects": [p for p in part["projects"] if p not in gone]} for part in parts]
        made = self._written(rows)
        self._commit([p for p in [*kept, made] if p["projects"]])

    def _touched(self, ids: DataFrame, key: str = "id") -> list[str]:
        """Projects in which rows with one of these ids (or paths) lie; reads two columns."""
        rows = self.read().select(key, "project_path").join(ids.select(key).distinct(), key, "left_semi")
        return [r["project_path"] for r in rows.select("project_path").distinct().collect()]

    def upsert(self, batch: DataFrame, order: str | None = None) -> bool:
        """False if the batch holds nothing to write."""
        batch = batch.where("embedding is not null and size(embedding) > 0")
        if batch.isEmpty():
            return False
        batch = write_scratch(coerced(batch) if order is None else coerced(batch).withColumn(order, batch[order]), "batch")  # ids that are made up must stay the same
        new = [r["project_path"] for r in batch.select("project_path").distinct().collect()]
        projects = sorted({*new, *self._touched(batch)})
        self.replace(projects, upserted(self.read(projects), batch, order))
        return True

    def replace_files(self, batch: DataFrame) -> bool:
        """As ``upsert``, but all that the table holds of the batch's files goes first: their old chunks do not linger."""
        batch = batch.where("embedding is not null and size(embedding) > 0")
        if batch.isEmpty():
            return False
        batch = write_scratch(coerced(batch), "batch")
        new = [r["project_path"] for r in batch.select("project_path").distinct().collect()]
        projects = sorted({*new, *self._touched(batch), *self._touched(batch, "file_path")})
        left = self.read(projects).join(batch.select("file_path").distinct(), "file_path", "left_anti").select(*[f.name for f in CHUNK_SCHEMA.fields])
        self.replace(projects, upserted(left, batch))
        return True

    def delete(self, ids: DataFrame) -> bool:
        """Deletes the ids; an empty list is no work and succeeds."""
        if projects := self._touched(ids):
            self.replace(projects, self.read(projects).join(ids.select("id").distinct(), "id", "left_anti"))
        return True

    def delete_project(self, project_path: str) -> bool:
        """Drops a project from the manifest: nothing is read or written.  An empty name is no work."""
        if project_path and project_path in self.projects():
            self._commit([p for part in self._parts() if (p := part | {"projects": [q for q in part["projects"] if q != project_path]})["projects"]])
        return True

    def clear(self) -> None:
        self._commit([])

    def info(self) -> dict:
        row = self.read().agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dimension")).first()
        return {"count": row["count"], "dimension": row["dimension"] or 0, "path": self.path}

    def health(self) -> dict:
        try:
            self.read().limit(1).count()
            return {"status": "healthy"}
        except Exception as error:  # the probe reports whatever keeps the table from being read
            return {"status": "unhealthy", "error": str(error)[:200]}
