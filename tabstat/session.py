"""Session for local runs, and what a session needs before operators run on it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(name: str = "tabstat", cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the workers and settle the checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where none
    is named, and only in local mode, a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabstat-"), "tabstat.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("tabstat", os.path.relpath(full, root)))
        sc.addPyFile(path)
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabstat-checkpoints-"))
    return spark


def need_checkpoint_dir(spark: SparkSession) -> None:
    """Iterations cut their lineage in a folder that all executors can reach."""
    prepare(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
