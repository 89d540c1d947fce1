"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SCALE_CONF = {
    # runtime re-planning: coalesce small shuffles, split skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "sheetmerge") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it is set by the cluster and only read here. Where it is
    unset (local tests) a private folder is created and used for the rest
    of the session.
    """
    found = None
    try:
        found = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a Connect session)
        found = None
    if not found:
        try:
            found = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            found = None
    if found:
        return found
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="sheetmerge-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(local)
        return spark.sparkContext.getCheckpointDir() or local
    except Exception:  # noqa: BLE001
        spark.conf.set("spark.checkpoint.dir", local)
        return local


#: The folder of the run that is going on, if it owns its landed tables.
_RUN: ContextVar[str | None] = ContextVar("sheetmerge_run", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder (never reused)."""
    base = _RUN.get() or checkpoint_dir(spark).rstrip("/")
    return f"{base}/sheetmerge-{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A run that owns what it lands: all of it is removed when the run ends well.

    Nothing that reads a landed table may outlive the scope. A run that
    fails leaves its folder, named ``sheetmerge-run-...``, for inspection.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sheetmerge-run-{uuid.uuid4().hex[:12]}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
    fs, path = file_system(spark, folder)
    fs.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers and writers see them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python file APIs can use the path."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


__all__ = [
    "SCALE_CONF",
    "apply_conf",
    "checkpoint_dir",
    "file_system",
    "is_local_path",
    "local_fs_path",
    "local_session",
    "run_scope",
    "scratch_path",
]

