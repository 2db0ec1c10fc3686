"""Session construction for tests, benchmarks and scripts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the own temporary folder of a local session, and the paths of the tables written so far.
_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}

#: Most bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def local_session(app: str = "quarry", cores: int | str | None = None, **extra: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE on).

    ``cores`` falls back to ``BENCH_CPUS`` and then to 8.  On a cluster the
    caller brings its own session; no operator depends on this function.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "6g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def on_workers_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is shipped with ``--py-files`` or installed; then
    the extra path does no harm.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, held) if p)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Bound the session's Arrow batches to ``rows`` rows and ``BATCH_BYTES``: texts may be long, and a batch is held whole on both sides.

    Plans run later than they are built, so the bounds stay in the session; a lower bound of its own is kept.
    """
    on_workers_path(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(name).rstrip("b")
        held = int(held) if held.lstrip("-").isdigit() else 0
        if not 0 < held <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session gets a temporary folder of its
    own, removed when the process ends; on a cluster that is an error, as every
    executor would write its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; ``drop_scratch`` removes what lies there."""
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the reread table.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application; results that still read them must be written before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
