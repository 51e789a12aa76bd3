"""Session defaults and the shared folder used for checkpoints and streaming tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(master: str | None = None, app: str = "stallwise", **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; every one can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split hot join keys even where that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in ``spark.checkpoint.dir``.

    Only a local session may do without: there every task sees the same disk, so a
    fresh temporary folder is made once and remembered in the session.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="stallwise-")
        spark.conf.set(CHECKPOINT_CONF, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, removed when the session's JVM ends."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    fs, target = _folder(spark, path)
    fs.deleteOnExit(target)
    return path


def enable_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable."""
    shared_dir(spark)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped[sc.applicationId] = folder = tempfile.TemporaryDirectory(prefix="stallwise-")
    package = Path(__file__).resolve().parent
    for source in package.rglob("*.py"):
        target = Path(folder.name, "src", package.name, source.relative_to(package))
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(source, target)
    sc.addPyFile(shutil.make_archive(f"{folder.name}/stallwise", "zip", f"{folder.name}/src"))


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _folder(spark, path)
    fs.delete(target, True)
