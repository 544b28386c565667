"""Reusing finished steps by configuration hash."""

from __future__ import annotations

import uuid
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder a new name; fails when the name is taken, so nothing is overwritten."""
    old, new = spark._jvm.org.apache.hadoop.fs.Path(source), spark._jvm.org.apache.hadoop.fs.Path(target)
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    if files.exists(new) or not files.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole or not at all; False when the name is taken.

    The text is written under another name and renamed without overwriting, which HDFS does as one step: of several
    writers one wins. A local folder checks and renames in two steps.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    out = files.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, options)
        return True
    except Py4JJavaError:
        files.delete(part, False)
        if files.exists(target):
            return False
        raise


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, hidden ones left out; none when there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def step(spark: SparkSession, folder: str, name: str, config: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of a step: read when this configuration has finished it, otherwise computed and written.

    Spark writes ``_SUCCESS`` last, so a step that lost its job half-way is not taken for finished.
    """
    path = f"{folder.rstrip('/')}/{name}/{config}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
