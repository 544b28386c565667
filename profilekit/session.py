"""Session defaults and reliable materialisation.

Everything that must outlive a lost executor goes to the checkpoint folder the
cluster names in ``spark.checkpoint.dir``. Only a local session without that
setting gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "profilekit") -> SparkSession:
    """A session for tests and single-machine runs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="profilekit-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, kind: str = "tables") -> str:
    """A new path in the shared checkpoint folder; :func:`clear_materialised` removes it."""
    return f"{ensure_checkpoint_dir(spark)}/profilekit/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from a table in the checkpoint folder.

    A written table cuts the lineage, survives lost executors and, unlike the
    statistics a checkpointed plan inherits through repeated joins, its file size is a
    true size, so later joins are planned on facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside hand at most ``rows`` rows at once to Python, for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clear_materialised(spark: SparkSession) -> None:
    """Delete everything this application wrote to its :func:`scratch_path` folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{ensure_checkpoint_dir(spark)}/profilekit/{spark.sparkContext.applicationId}"
    )
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_profilekit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="profilekit-package-"), "profilekit.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("profilekit", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._profilekit_shipped = True
