"""Session helpers.

Library code never creates its own session; it takes the caller's.  ``get_spark``
is for tests, the bench and local runs.  On a cluster the checkpoint folder is
the shared one the cluster names in ``spark.checkpoint.dir``; we only set our own
when that setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "carelens") -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cores}]"
    parts = shuffle_partitions or int(cores)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CARELENS_DRIVER_MEMORY", "16g"))
        # delete checkpoint files of RDDs that are no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one already set on
    the context); only when neither exists is a local folder created, and only for a local master.
    ``spark.checkpoint.dir`` is a core setting that cannot be changed at run time, so the
    folder is installed with ``SparkContext.setCheckpointDir``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="carelens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Put this package on the executors' Python path (once per Spark application)."""
    sc = spark.sparkContext
    if getattr(sc, "_carelens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # the driver serves this file to late executors too, so it stays while the session lives
    archive = os.path.join(tempfile.mkdtemp(prefix="carelens-"), "carelens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._carelens_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of the data files at or below ``path``, sorted.

    Files and folders whose name begins with ``_`` or ``.`` are left out, as Spark's readers do.
    """
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    found, todo = [], [fs.getFileStatus(where)]
    while todo:
        status = todo.pop()
        if not status.isDirectory():
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
            continue
        todo += [s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[0] not in "_."]
    return sorted(found)


def list_parts(spark: SparkSession, path: str, key: str, committed: bool = False) -> list[str]:
    """The values x of the folders ``path/key=x``, sorted; ``committed``: of finished writes only."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(where)
                  if s.getPath().getName().startswith(f"{key}=")
                  and (not committed or fs.exists(Path(s.getPath(), "_SUCCESS"))))


def list_committed(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of the folders ``path/key=n`` that a finished write left, sorted."""
    return sorted(map(int, list_parts(spark, path, key, committed=True)))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote and no longer needs, if it is there."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def commit_folder(spark: SparkSession, begun: str, path: str) -> None:
    """Move a folder that a finished write left to ``path`` and mark it committed there; what
    ``path`` held goes.  Without a folder ``begun`` (no row was written) ``path`` is empty."""
    fs, to = _file_system(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(to):
        fs.delete(to, True)
    if fs.exists(Path(begun)):
        fs.mkdirs(to.getParent())
        if not fs.rename(Path(begun), to):
            raise OSError(f"{begun} was not moved to {path}")
    else:
        fs.mkdirs(to)
    fs.create(Path(to, "_SUCCESS")).close()
