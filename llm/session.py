"""What the operators need of a session: their code on the workers, and a folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tabstat.session import need_checkpoint_dir

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and settle the shared folder (``spark.checkpoint.dir``)."""
    need_checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="llm-"), "llm.zip")
        with zipfile.ZipFile(path, "w") as z:
            for name in sorted(os.listdir(root)):
                if name.endswith(".py"):
                    z.write(os.path.join(root, name), f"llm/{name}")
        sc.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    ready(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends here, and lost executors cost nothing.

    The files stay until the folder is cleared.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
