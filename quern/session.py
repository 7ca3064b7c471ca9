"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "quern") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one in spark.checkpoint.dir, which all executors share.

    Only a ``local`` master, whose executors are this process, may fall back to a
    temporary folder; elsewhere a missing setting is an error, because a folder
    of one machine is lost with that machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_dead(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that are done.

    It does when the driver's JVM collects those plans, which a driver that holds
    little would put off, while their files stay on the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package where they couldn't import it by themselves.

    They can if its folder is the working folder or on PYTHONPATH; else a zip of
    the sources is added to the application, once.
    """
    root = Path(__file__).resolve().parent.parent
    known = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p.resolve() == root for p in known):
        return
    folder = tempfile.mkdtemp(prefix="quern-package-")
    with zipfile.ZipFile(f"{folder}/quern.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "quern").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/quern.zip")
    _SHIPPED.add(app)
