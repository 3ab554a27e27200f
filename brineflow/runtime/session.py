"""Session helpers: tables, shared checkpoint storage, code shipping, parallelism."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brineflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BRINEFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Makes the package importable on remote executors; nothing to do in local mode."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local":
        return
    if getattr(context, "_brineflow_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="brineflow"), "brineflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, Path(_PACKAGE.name) / file.relative_to(_PACKAGE))
    context.addPyFile(path)
    context._brineflow_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="brineflow-checkpoint")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint, so a lost executor recomputes nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage through a Parquet table in the shared folder; columnar, so later reads prune columns.

    Tables lie in the application's own folder under the checkpoint folder; `discard` removes one that nothing reads
    any more, `discard_all` those left.
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._brineflow_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by `written`, once everything computed from them has been written itself."""
    for df in tables:
        if path := getattr(df, "_brineflow_path", None):
            _remove(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Removes all tables of this application, once its results are stored."""
    if base := spark.sparkContext.getCheckpointDir():
        _remove(spark, base)
        spark.sparkContext.setCheckpointDir(str(base).rstrip("/").rsplit("/", 1)[0])


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Gives a scan of few large files as many partitions as the session has shuffle partitions; larger scans stay as they are."""
    wanted = parallelism(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows if there are at most `limit`, else None: the size check before anything is broadcast."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows
